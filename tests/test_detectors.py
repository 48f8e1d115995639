import pytest
from pyspark.sql import functions as F

from spanforge.operators import core, detectors, names
from spanforge.sources import detectors as read_manifest
from spanforge.sources import policies

ALL = (*detectors.NATIVE, *names.ARROW)
CASES = [
    ("EMAIL", "Почта клиента: ivan.petrov@example.test.", ["ivan.petrov@example.test"]),
    ("EMAIL", "a@b.com@c и x@y.comm_", []),
    ("PHONE", "Телефон: +7 912 345-67-89 доб. 321", ["+7 912 345-67-89 доб. 321"]),
    ("CARD", "Карта: 4276 1890 7414 4957", ["4276 1890 7414 4957"]),
    ("CARD", "Номер заказа 4276189074144957", []),
    ("INN", "ИНН 119098818444", ["119098818444"]),
    ("PASSPORT", "Паспорт: серия 45 12, номер 789012", ["45 12", "789012"]),
    ("DEPARTMENT_CODE", "Код подразделения: 770-123", ["770-123"]),
    ("ADDRESS", "Адрес клиента: Россия, 350000, г. Краснодар, ул. Северная, д. 15, кв. 8.", ["Россия", "350000", "Краснодар", "Северная", "15", "8"]),
    ("ADDRESS", "Адрес отделения: г. Москва, ул. Тверская, д. 7", []),
    ("BIRTH_PLACE", "Место рождения: г. Нижний Новгород", ["Нижний Новгород"]),
    ("BIRTH_PLACE", "Поэт Александр Пушкин родился в Москве", []),
    ("CITIZENSHIP", "Гражданство: Российская Федерация", ["Российская Федерация"]),
    ("PASSPORT_ISSUER", "Паспорт выдан УФМС России по г. Москве дата выдачи", ["УФМС России по г. Москве"]),
    ("PASSPORT_ISSUE_DATE", "Дата выдачи: 2015.13.04", ["2015.13.04"]),
    ("PASSPORT_ISSUE_DATE", "Паспорт выдан давно. Встреча 12.05.2016", []),
    ("DRIVER_LICENSE", "Водительское удостоверение: 77 12 345678", ["77 12 345678"]),
    ("CVV", "CVV: 12345", ["1234"]),
    ("PIN", "ПИН-код: 4321", ["4321"]),
    ("CARDHOLDER_NAME", "Cardholder: John Smith", ["John Smith"]),
    ("CARDHOLDER_NAME", "Держатель: ООО Ромашка", []),
    ("BIRTH_DATE", "Дата рождения: 04.13.1990", ["04.13.1990"]),
    ("BIRTH_DATE", "Дата рождения: двадцать третьего мая 1987 года", ["двадцать третьего мая 1987"]),
    ("BIRTH_DATE", "12.04.1990 — дата рождения", ["12.04.1990"]),
    ("BIRTH_DATE", "Поэт Александр Пушкин родился 06.06.1999", []),
    ("FULL_NAME", "клиент иван иванович петров", ["иван иванович петров"]),
    ("FULL_NAME", "КЛИЕНТ ИВАН ИВАНОВИЧ ПЕТРОВ", ["ИВАН ИВАНОВИЧ ПЕТРОВ"]),
    ("FULL_NAME", "Читаю стихи Александра Сергеевича Пушкина", []),
    ("FULL_NAME", "Фамилия: Кузнецов", ["Кузнецов"]),
]


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(CASES)], "doc_id int, text string")
    return {r["doc_id"]: r for r in core.restore(core.mask(core.resolve(core.detect(docs, ALL)), b"k" * 32)).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_values(found, i):
    category, text, want = CASES[i]
    row = found[i]
    assert [text[s["start"] : s["stop"]] for d in row["detections"] if d["category"] == category for s in d["sensitive"]] == want
    assert row["restored"] == text
    for m in row["mapping"]:
        assert m["token"] in row["masked_text"]


def test_offsets_are_code_points(spark):
    docs = spark.createDataFrame([(1, "😀😀 a@b.org 😀")], "doc_id int, text string")
    d = core.detect(docs, ("email",)).first()["detections"][0]
    assert (d["start"], d["stop"]) == (3, 10)


def test_null_and_empty_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id int, text string")
    rows = core.restore(core.mask(core.resolve(core.detect(docs, ALL)), b"k")).orderBy("doc_id").collect()
    assert [(r["detections"], r["masked_text"], r["restored"]) for r in rows] == [([], None, None), ([], "", "")]


def test_opaque_markers_avoid_those_in_the_text(spark):
    docs = spark.createDataFrame([(1, "[REDACTED-0] a@b.org c@d.org [REDACTED-2]")], "doc_id int, text string")
    r = core.restore(core.mask(core.resolve(core.detect(docs, ("email",))), b"k", action="opaque_token_full")).first()
    assert r["masked_text"] == "[REDACTED-0] [REDACTED-1] [REDACTED-3] [REDACTED-2]"
    assert r["restored"] == r["text"]


def test_equal_values_share_a_token_and_tokens_in_the_text_stay(spark):
    docs = spark.createDataFrame([(1, "a@b.org a@b.org ⟦PII:EMAIL:xxxxxxxxxxxxxxxxxxxxxx⟧")], "doc_id int, text string")
    r = core.restore(core.mask(core.resolve(core.detect(docs, ("email",))), b"k")).first()
    assert r["mapping"][0] == r["mapping"][1]
    assert r["restored"] == r["text"]


def test_touching_spans_merge(spark):
    rows = spark.createDataFrame([(1, 0, "A", 0, 3), (1, 1, "B", 3, 5), (1, 2, "C", 6, 7), (1, 3, "D", 0, 2)], "doc_id int, ord int, category string, start int, stop int")
    got = [(r["start"], r["stop"], r["category"], r["n_spans"]) for r in core.resolve_rows(rows).orderBy("seq").collect()]
    assert got == [(0, 5, "A", 3), (6, 7, "C", 1)]


def test_row_and_table_forms_of_resolve_agree(spark, sf):
    docs = core.detect(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), ("email", "phone", "card", "inn", "passport"))
    rows = core.resolve_rows(core.spans(docs).withColumn("ord", F.col("i") * 1000 + F.col("k"))).select("doc_id", "start", "stop", "category")
    arrays = core.resolve(docs).select("doc_id", F.explode("resolved").alias("r")).select("doc_id", "r.start", "r.stop", "r.category")
    assert rows.exceptAll(arrays).count() == 0 and arrays.exceptAll(rows).count() == 0


def test_invalid_spans_are_errors(spark):
    docs = core.detect(spark.createDataFrame([(1, "a@b.org")], "doc_id int, text string"), ("email",))
    broken = docs.withColumn("detections", F.transform("detections", lambda d: d.withField("sensitive", F.array(F.struct(F.lit(5).alias("start"), F.lit(5).alias("stop"))))))
    with pytest.raises(Exception, match="invalid span"):
        core.resolve(broken).collect()


def test_manifest_and_policies():
    manifest = {"detectors": [{"id": "email"}, {"id": "pin", "enabled": False}, {"id": "acc", "type": "regex", "category": "ACC", "pattern": "[0-9]{20}"}]}
    assert [d if isinstance(d, str) else d.detector_id for d in read_manifest(manifest)] == ["email", "acc"]
    with pytest.raises(ValueError, match="unknown detector"):
        read_manifest({"detectors": [{"id": "nope"}]})
    p = policies({"consumers": {"x": {"namespace": "x", "detect_types": "email, CARD"}}})["x"]
    assert p.categories(["EMAIL", "CARD"]) == ["EMAIL", "CARD"]
    with pytest.raises(ValueError, match="unknown categories"):
        p.categories(["EMAIL"])


def test_policy_keeps_a_pin_without_its_card(spark):
    docs = spark.createDataFrame([(1, "Карта 4276189074144957, PIN 4321"), (2, "Карта 4276189074144957\nPIN 4321")], "doc_id int, text string")
    policy = core.Policy("c", "c", combination_rules=(core.CombinationRule("r", "PIN", "CARD"),))
    rows = {r["doc_id"]: r["masked_text"] for r in core.apply_policy(docs, policy, b"k", ("card", "pin")).collect()}
    assert "4321" not in rows[1] and rows[2].endswith("PIN 4321")


def test_egress_reasons(spark):
    docs = core.mask(core.resolve(core.detect(spark.createDataFrame([(1, "a@b.org"), (2, "x")], "doc_id int, text string"), ("email",))), b"k")
    ok = core.Policy("c", "c", allow_llm_egress=True)
    rows = {r["doc_id"]: r["reasons"] for r in core.egress_reasons(docs, ok, "stub", ("detect", "resolve", "mask"), detectors=("email",)).collect()}
    assert rows == {1: [], 2: []}
    bad = core.egress_reasons(docs.withColumn("masked_text", F.col("text")), ok, "other", ("detect",), detectors=("email",)).filter("doc_id = 1").first()["reasons"]
    assert len(bad) == 5


@pytest.mark.parametrize(
    ("word", "part"),
    [(w, "last") for w in ("Иванов", "Иванову", "Ивановым", "Ивановых", "Иванова", "Ивановой", "Ивановою", "Ивановами", "Семёнов", "Шевченко")]
    + [(w, "patronymic") for w in ("Иванович", "Ивановича", "Ивановичем", "Ивановна", "Ивановне", "Ивановной", "Ивановною", "Петровичами", "Петровичах", "Ильинична", "Ильиничною")]
    + [(w, "first") for w in ("Иван", "Ивану", "Иванами", "Анною", "Марией", "Мариею", "Льва", "Льву", "Львом", "Игорем", "Фёдор")],
)
def test_forms_have_their_part(word, part):
    assert part in names.roles(word)


def test_every_form_of_the_paradigm_is_known():
    for part, bases in (("first", names.FIRST_NAMES), ("patronymic", names.PATRONYMICS), ("last", names.SURNAMES)):
        for base in bases:
            for gender in {base, names.feminine(base) if part != "first" else base} - {None}:
                for form in names.forms(gender):
                    assert (part, gender) in names.KNOWN[form] and part in names.roles(form)
    assert names.roles("стол") == frozenset() and names.roles("И.") == {"initial"}

import re

from pyspark.sql import functions as F

from spanforge.operators import core, detectors, names
from spanforge.functions.spans import find

ODD_CASES = (
    "PİN 1234", "pın 1234", "ПИН-КОД: 4321", "КОД ПОДРАЗДЕЛЕНИЯ 770-123", "ᲀодительские права 77 12 345678", "ву 77 12 345678", "СЕРИИ 45 12 № 789012", "пАсПоРт 4503 123456", "гРАжДанин Россия",
    "КЛИЕНТСКИЙ ID AB12CD34EF", "CVC 123", "Cvv 1234", "ᲁата ᲀыᲁачи 12.05.2010", "ᲀыᲁан ОВД Мира", "из ДОМА, д. 5", "АДРЕС: г. Пермь", "зАРЕГИСТРИРОВАН: ул. Мира", "НОМЕР ЗАКАЗА 4276189074144957", "заказ № 7707083893", "a@b.org", None, "", "ничего",
)


def test_searched_words_hide_no_match(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD_CASES)], "doc_id int, text string")
    found = {r["doc_id"]: r["detections"] for r in core.detect(docs).collect()}
    assert sum(bool(x) for x in found.values()) >= 15
    monkeypatch.setattr(detectors, "holds", lambda text, *words: F.lit(True))
    assert found == {r["doc_id"]: r["detections"] for r in core.detect(docs).collect()}


def test_name_detectors_share_one_pass(spark):
    docs = spark.createDataFrame([(0, "Клиент Иван Иванович Петров родился 12.04.1990 в Москве"), (1, None)], "doc_id int, text string")
    seen = core.detect(docs, tuple(names.ARROW))
    assert len(re.findall(r"(?m)^[^(\n]*ArrowEvalPython", seen._jdf.queryExecution().executedPlan().toString())) == 1
    rows = {r["doc_id"]: [d["category"] for d in r["detections"]] for r in seen.collect()}
    assert rows == {0: ["FULL_NAME", "BIRTH_DATE", "BIRTH_PLACE"], 1: []}

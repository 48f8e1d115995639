"""Detectors that are native Columns: a text gives an array of detections, in the order of the matches.

A detection is struct<category, detector_id, rule_id, score, start, stop, sensitive, signals>; start and stop bound the evidence, sensitive
holds the spans to mask. All are code points, half open. Detections of all detectors stay in one array column of the
document's row, so that detecting, resolving and masking need no shuffle and no join.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions import scalars as S
from spanforge.functions.spans import EXACT_CASE, cut_of, cuts_of, find, let

DETECTION = (
    "struct<category:string,detector_id:string,rule_id:string,score:double,start:int,stop:int,"
    "sensitive:array<struct<start:int,stop:int>>,signals:array<struct<name:string,value:double,kind:string>>>"
)
NONE = f"cast(array() as array<{DETECTION}>)"

# Patterns and word lists that define each category.
DASH = r"[\s\-–—]"
EMAIL = r"[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,63}"
EMAIL_BEFORE, EMAIL_BEHIND = r"(?<![A-Za-z0-9._%+-])", r"(?![A-Za-z0-9_%+@-]|\.[A-Za-z0-9])"
PHONE = rf"(?:\+7|8|7){DASH}*(?:\(\d{{3}}\)|\d{{3}}){DASH}*\d{{3}}{DASH}*\d{{2}}{DASH}*\d{{2}}(?:\s+(?:доб\.?|добавочный|ext\.?|extension)\s*\d{{1,6}})?"
CARD = "(?:\\d[ \\-\u00a0]?){12,18}\\d"
INN = r"(?:\d{10}|\d{12})"
SERIES = r"\d{2}[\s\-–—]?\d{2}"
PASSPORT_LABEL = (r"(?:серия|серии|серией)[\s:№]*", SERIES, r"[\s,;]*(?:номер|№|номером|номеру)?[\s:№]*", r"\d{6}")
PASSPORT_BARE = (r"(?:паспорт|паспорта|паспортом)[\s:№]*", SERIES, r"[\s\-–—]*", r"\d{6}")
PASSPORT_RAW = (SERIES, r"[\s\-–—]+", r"\d{6}")
DEPARTMENT = (r"код\s+подразделения[\s:]*", r"\d{3}[\s\-–—]*\d{3}")
ORDER_LABEL = r"номер\s+заказа|заказ\s+№|заказ\s+номер|id\s+заказа|номер\s+(?:договора|счёта|счета|операции|транзакции|документа|заявки|обращения|чека|квитанции|платежа|поручения)"
ISSUER_WORD = r"(?:[А-ЯЁа-яё]{1,2}\.|[А-ЯЁа-яё][А-ЯЁа-яё\-]*)"
ISSUER = (r"(?:кем\s+выдан|орган\s+выдачи|выдано|выдана|выдан)[ \t:]*", rf"{ISSUER_WORD}(?:[ \t]+{ISSUER_WORD}){{0,6}}")
ISSUER_START = r"(?iU)^(?:ОВД|УФМС|МВД|ГУВД|УВД|ФМС|ОМВД|УМВД|ГУМВД)\b"
ISSUER_STOP = r"(?iU)(?:дата\s+выдачи|код\s+подразделения|дата\s+рождения|место\s+рождения|гражданство|пол\b|фамилия|имя\b|отчество|серия|номер)[\s\S]*"
LICENSE = (r"(?:водительское\s+удостоверение|водительские\s+права|ВУ|удостоверение\s+водителя)[ \t:]*", r"\d{2}[ \t\-]*\d{2}[ \t\-]*\d{6}")
CVV = (r"(?:CVV-код|CVC-код|CVV|CVC|код\s+безопасности|код\s+с\s+обратной\s+стороны)[ \t:]*", r"\d{3,4}")
PIN = (r"(?:ПИН-код\s+карты|PIN-код\s+карты|пин\s+код\s+карты|PIN-код|ПИН-код|пин\s+код|PIN|ПИН)[ \t:]*", r"\d{3,8}")
CITIZENSHIP = (r"(?:гражданство|гражданин|гражданка)[ \t:]*", r"[А-ЯЁ][а-яё\-]+(?:\s+[А-ЯЁ][а-яё\-]+)?")
CLIENT_ID = (r"клиентский\s+(?:id|идентификатор)", r"[\s:№]*", r"[A-Z0-9]{8,12}")
_MONTH = "|".join(S.MONTHS + S.MONTHS_NOMINATIVE)
NUMERIC_DATE = (r"\b\d{1,2}", r"[./\-]", r"\d{1,2}", r"[./\-]", r"\d{4}\b")
ISO_DATE = (r"\b\d{4}", r"[./\-]", r"\d{1,2}", r"[./\-]", r"\d{1,2}\b")
WORDS_DATE = (r"\b\d{1,2}", r"\s+", f"(?:{_MONTH})", r"\s+", r"\d{4}", r"(?:\s+года)?\b")
ISSUE_NEAR = r"дата\s+выдачи|выдан|выдана|выдано"
BIRTH_NEAR = r"родился|родилась|дата\s+рождения|д\.?\s*р\.?|день\s+рождения"
NEUTRAL_NEAR = r"\b(?:встреча|срок\s+действия|год|заказ|порт|собрание|конференция|концерт|праздник|событие|мероприятие)\b"
ADDRESS_NEAR = (
    r"адрес|адреса|адресу|адресом|проживает|проживающ|зарегистрирован|"
    r"зарегистрирована|место\s+жительства|место\s+проживания|\bиз\s+дома\b"
)
OFFICE_NEAR = (
    r"адрес\s+отделения|адрес\s+офиса|адрес\s+банка|адрес\s+филиала|"
    r"адрес\s+организации|адрес\s+компании|адрес\s+представительства|"
    r"отделение\s+банка|офис\s+банка|филиал\s+банка|банк\s+расположен|"
    r"отделение\s+расположено|офис\s+расположен|банкомат\s+расположен"
)
PERSONAL_NEAR = (
    r"адрес\s+клиента|адрес\s+проживания|адрес\s+регистрации|"
    r"проживает|проживающ|зарегистрирован|зарегистрирована|"
    r"место\s+жительства|место\s+проживания|домашний\s+адрес|\bиз\s+дома\b"
)
COUNTRIES = (
    "россия", "рф", "беларусь", "белоруссия", "казахстан", "украина",
    "германия", "франция", "италия", "испания", "сша", "китай", "индия",
    "турция", "польша", "чехия", "финляндия", "швеция", "норвегия",
    "великобритания", "англия", "япония", "корея", "израиль", "грузия",
    "армения", "азербайджан", "узбекистан", "таджикистан", "киргизия",
    "молдова", "латвия", "литва", "эстония",
)
ADDRESS_PARTS = (
    ((r"(?:г\.|город)\s*", r"[А-ЯЁ][а-яё\-]+(?:\s+[А-ЯЁ][а-яё\-]+)?"), "", ""),
    ((r"(?:ул\.|улица|пер\.|переулок)\s*", r"[А-ЯЁ0-9][а-яё0-9\-]*(?:\s+[А-ЯЁ0-9][а-яё0-9\-]+)?"), "", ""),
    ((r"(?:д\.|дом)\s*", r"\d+[а-яё]?(?:[/\-]\d+[а-яё]?)?"), "", ""),
    ((r"(?:кв\.|квартира)\s*", r"\d+"), "", ""),
    ((r"(?:страна|страны|страну)[\s:]*", r"[А-ЯЁ][а-яё\-]+"), "", ""),
    ((r"(?:^|[,;:]\s*)", "(?:" + "|".join(COUNTRIES) + ")"), "", r"(?=\s*[,;]|\s*$)"),
    (("", r"\d{6}"), r"(?<!\w)", r"(?!\w)"),
)


def signals(*pairs: tuple[str, float]) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(v)).alias("value"), F.lit("positive").alias("kind")) for n, v in pairs])


def detection(category: str, detector_id: str, rule_id: Column | str, score: Column | float, start: Column, stop: Column, sensitive: Column, marks: Column) -> Column:
    made = F.struct(
        F.lit(category).alias("category"), F.lit(detector_id).alias("detector_id"), (F.lit(rule_id) if isinstance(rule_id, str) else rule_id).alias("rule_id"),
        (F.lit(float(score)) if isinstance(score, float) else score).cast("double").alias("score"), start.cast("int").alias("start"), stop.cast("int").alias("stop"), sensitive.alias("sensitive"), marks.alias("signals"),
    )
    return made.cast(DETECTION)


def span(start: Column, stop: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), stop.cast("int").alias("stop"))


def holds(text: Column, *words: str) -> Column:
    """Whether text holds one of words (upper case), in whatever case: a plain search that spares texts without any of them the patterns that need one.

    It has to find all that a pattern with (?iU) does, which takes letters as equal by the lower case of their upper case. Beside upper-case letters that
    is only more for i, as there is an upper-case one with a dot."""
    folded = F.upper(text)
    return functools.reduce(lambda a, b: a | b, [F.contains(folded, F.lit(w)) for w in words])


def labelled(text: Column, tiles: tuple[str, ...], values: tuple[int, ...], category: str, detector_id: str, rule_id: str, score: float, mark: str, before: str = "", behind: str = "", flags: str = "(?iU)", evidence_tiles: int | None = None, needs: tuple[str, ...] = ()) -> Column:
    """Detections of a pattern of which the tiles in values (from 0) are sensitive and the whole, or the first evidence_tiles, is evidence.

    A match has one of the words in needs."""
    edge = lambda m, i: m["start"] if i == 0 else m["cuts"][i - 1]  # noqa: E731, B023
    made = lambda m: detection(category, detector_id, rule_id, score, m["start"], m["stop"] if evidence_tiles is None else edge(m, evidence_tiles), F.array(*[span(edge(m, i), m["cuts"][i]) for i in values]), signals((mark, 1.0)))  # noqa: E731, B023
    found = F.transform(find(text, tiles, before, behind, flags), made)
    return F.when(holds(text, *needs), found).otherwise(F.expr(NONE)) if needs else found


def outside_orders(text: Column, found: Column) -> Column:
    """Matches that don't start within 40 characters behind an order or document label (a range anti join on arrays)."""
    return F.when((F.size(found) == 0) | ~holds(text, "ЗАКАЗ", "НОМЕР"), found).otherwise(let(find(text, (ORDER_LABEL,)), lambda orders: F.filter(found, lambda m: ~F.exists(orders, lambda o: m["start"].between(o["stop"], o["stop"] + 40)))))


def with_values(text: Column, found: Column, made: Callable[[Column, Column], Column]) -> Column:
    """made(match, its text) for all matches."""
    return let(found, lambda ms: F.when(F.size(ms) == 0, F.expr(NONE)).otherwise(F.zip_with(ms, cuts_of(text, ms), made)))


def email(text: Column) -> Column:
    return labelled(text, (EMAIL,), (0,), "EMAIL", "email", "email-structure", 0.95, "email_structure", EMAIL_BEFORE, EMAIL_BEHIND, "", needs=("@",))


def phone(text: Column) -> Column:
    return labelled(text, (PHONE,), (0,), "PHONE", "phone", "phone-format", 0.9, "phone_format", r"(?<!\d)", r"(?!\d)", EXACT_CASE)


def card(text: Column) -> Column:
    def made(m: Column, value: Column) -> Column:
        ok = S.luhn(F.regexp_replace(value, "[ \\-\u00a0]", ""))
        return detection("CARD", "card", "card-digits", F.when(ok, 0.85).otherwise(0.6), m["start"], m["stop"], F.array(span(m["start"], m["stop"])), F.when(ok, signals(("card_digits", 1.0), ("luhn_valid", 1.0))).otherwise(signals(("card_digits", 1.0), ("luhn_invalid", -0.2))))

    return with_values(text, let(find(text, (CARD,), r"(?<!\d)", r"(?!\d)", ""), lambda found: outside_orders(text, found)), made)


def inn(text: Column) -> Column:
    def made(m: Column, value: Column) -> Column:
        ok = S.inn_valid(value)
        return detection("INN", "inn", "inn-structure", F.when(ok, 0.8).otherwise(0.55), m["start"], m["stop"], F.array(span(m["start"], m["stop"])), F.when(ok, signals(("inn_length", 1.0), ("inn_checksum_valid", 1.0))).otherwise(signals(("inn_length", 1.0), ("inn_checksum_invalid", -0.2))))

    return with_values(text, let(find(text, (INN,), r"(?<!\d)", r"(?!\d)", ""), lambda found: outside_orders(text, found)), made)


def passport(text: Column) -> Column:
    forms = (
        labelled(text, PASSPORT_LABEL, (1, 3), "PASSPORT", "passport", "passport-series-number", 0.95, "passport_context", needs=("СЕРИ",)),
        labelled(text, PASSPORT_BARE, (1, 3), "PASSPORT", "passport", "passport-bare-label", 0.9, "passport_context", needs=("ПАСПОРТ",)),
        labelled(text, PASSPORT_RAW, (0, 2), "PASSPORT", "passport", "passport-raw-series-number", 0.7, "passport_structure", r"(?<!\d)", r"(?!\d)"),
    )
    return F.concat(*forms)


def department_code(text: Column) -> Column:
    return labelled(text, DEPARTMENT, (1,), "DEPARTMENT_CODE", "department_code", "department-code-context", 0.9, "department_code_context", needs=("ПОДРАЗДЕЛЕНИЯ",))


def driver_license(text: Column) -> Column:
    return labelled(text, LICENSE, (1,), "DRIVER_LICENSE", "driver_license", "driver-license-context", 0.9, "driver_license_context", needs=("ВОДИТЕЛ", "ВУ"))


def cvv(text: Column) -> Column:
    return labelled(text, CVV, (1,), "CVV", "cvv", "cvv-context", 0.9, "cvv_context", needs=("CV", "КОД"))


def pin(text: Column) -> Column:
    return labelled(text, PIN, (1,), "PIN", "pin", "pin-context", 0.9, "pin_context", needs=("PI", "Pİ", "ПИ"))


def citizenship(text: Column) -> Column:
    return labelled(text, CITIZENSHIP, (1,), "CITIZENSHIP", "citizenship", "citizenship-context", 0.9, "citizenship_context", needs=("ГРАЖДАН",))


def client_id(text: Column) -> Column:
    return labelled(text, CLIENT_ID, (2,), "SYNTHETIC_CLIENT_ID", "synthetic_client_id", "", 0.95, "signed_internal_id", evidence_tiles=1, needs=("КЛИЕНТСКИЙ",))


def passport_issuer(text: Column) -> Column:
    """An authority behind its label, cut off at the next field's label."""

    def made(m: Column) -> Column:
        named = cut_of(text, m["cuts"][0], m["stop"])
        kept = F.when(named.rlike(ISSUER_START), F.regexp_replace(F.regexp_replace(named, ISSUER_STOP, ""), r"(?U)\s+$", "")).otherwise("")
        stop = m["cuts"][0] + F.length(kept)
        return detection("PASSPORT_ISSUER", "passport_issuer", "passport-issuer-context", 0.85, m["start"], stop, F.array(span(m["cuts"][0], stop)), signals(("issuer_context", 1.0)))

    found = F.filter(F.transform(find(text, ISSUER), made), lambda d: d["sensitive"][0]["stop"] > d["sensitive"][0]["start"])
    return F.when(holds(text, "ВЫДА"), found).otherwise(F.expr(NONE))


def dated(text: Column, tiles: tuple[str, ...], kind: str) -> Column:
    """array<struct<start, stop, date>> of all plausible dates of one kind."""
    field = lambda m, i: cut_of(text, m["start"] if i == 0 else m["cuts"][i - 1], m["cuts"][i])  # noqa: E731, B023
    read = F.transform(find(text, tiles), lambda m: F.struct(m["start"].alias("start"), m["stop"].alias("stop"), S.parse_date(kind, field(m, 0), field(m, 2), field(m, 4)).alias("date")))
    return F.filter(read, lambda m: F.coalesce(S.date_plausible(m["date"]["day"], m["date"]["month"], m["date"]["year"]), F.lit(False)))


def _distance(position: Column, marks: Column) -> Column:
    """From a position to the nearer end of the nearest mark; null without marks."""
    return F.array_min(F.transform(marks, lambda c: F.least(F.abs(position - c["start"]), F.abs(position - c["stop"]))))


def passport_issue_date(text: Column) -> Column:
    """Dates to which an issue mark is nearer than any birth mark and at least as near as any neutral one (three nearest joins on arrays)."""

    kinds = {"numeric": NUMERIC_DATE, "iso": ISO_DATE, "words": WORDS_DATE}

    def gated(marks: Column) -> Column:
        is_issue = lambda m: let(_distance(m["start"], marks["issue"]), lambda d: d.isNotNull() & ~F.coalesce(_distance(m["start"], marks["neutral"]) < d, F.lit(False)) & F.coalesce(d < _distance(m["start"], marks["birth"]), F.lit(True)))
        made = lambda m, kind: detection("PASSPORT_ISSUE_DATE", "passport_issue_date", f"passport-issue-date-{kind}", 0.9, m["start"], m["stop"], F.array(span(m["start"], m["stop"])), signals(("issue_context", 1.0), (f"{kind}_date", 1.0)))
        return F.concat(*[F.transform(F.filter(marks[kind], is_issue), lambda m: made(m, kind)) for kind in kinds])  # noqa: B023

    # the finds stand beside each other in one struct: inside gated() each of them would be analysed again at every level of functions
    near = [find(text, (p,)).alias(n) for n, p in (("issue", ISSUE_NEAR), ("birth", BIRTH_NEAR), ("neutral", NEUTRAL_NEAR))]
    marks = F.struct(*near, *[dated(text, tiles, kind).alias(kind) for kind, tiles in kinds.items()])
    return F.when(holds(text, "ВЫДА") & text.rlike("(?iU)" + ISSUE_NEAR), let(marks, gated)).otherwise(F.expr(NONE))


def address(text: Column) -> Column:
    """All components near an address mark and not an office's, in one detection."""

    def one(marks: Column) -> Column:
        near = lambda at: F.exists(marks["near"], lambda c: at.between(c["start"] - 30, c["stop"] + 120))  # noqa: E731, B023
        office = lambda at: F.exists(marks["office"], lambda o: at.between(o["start"] - 5, o["stop"] + 120) & ~F.exists(marks["personal"], lambda p: (p["start"] > o["stop"]) & (p["stop"] <= at)))  # noqa: E731, B023
        parts = [F.transform(F.filter(marks[f"part{i}"], lambda m: near(m["start"]) & ~office(m["start"])), lambda m: span(m["cuts"][0], m["cuts"][1])) for i in range(len(ADDRESS_PARTS))]
        return let(F.sort_array(F.concat(*parts)), lambda s: F.when(F.size(s) > 0, F.array(detection("ADDRESS", "address", "address-components-context", 0.8, s[0]["start"], F.array_max(F.transform(s, lambda x: x["stop"])), s, signals(("address_context", 1.0))))).otherwise(F.expr(NONE)))

    near = [find(text, (p,)).alias(n) for n, p in (("near", ADDRESS_NEAR), ("office", OFFICE_NEAR), ("personal", PERSONAL_NEAR))]
    marks = F.struct(*near, *[find(text, *part).alias(f"part{i}") for i, part in enumerate(ADDRESS_PARTS)])
    return F.when(holds(text, "АДРЕС", "ПРОЖИВА", "РЕГИСТРИРОВАН", "МЕСТО", "ДОМА") & text.rlike("(?iU)" + ADDRESS_NEAR), let(marks, one)).otherwise(F.expr(NONE))


@dataclass(frozen=True)
class RegexDetector:
    """A detector from configuration: a pattern and, optionally, a context that has to stand near. Without any context in the text all matches count."""

    detector_id: str
    category: str
    pattern: str
    context: str | None = None
    context_window: int = 40

    def __call__(self, text: Column) -> Column:
        found = find(text, (self.pattern,), flags="(?U)")
        if self.context:
            found = let(find(text, (self.context,), flags="(?U)"), lambda cs: F.filter(find(text, (self.pattern,), flags="(?U)"), lambda m: (F.size(cs) == 0) | F.exists(cs, lambda c: m["start"].between(c["start"] - 10, c["stop"] + self.context_window))))
        return F.transform(found, lambda m: detection(self.category, self.detector_id, f"config-regex-{self.detector_id}", 0.8, m["start"], m["stop"], F.array(span(m["start"], m["stop"])), signals(("config_regex", 1.0))))


#: By id, in the order in which detections are emitted.
NATIVE: dict[str, Callable[[Column], Column]] = {
    "email": email, "phone": phone, "card": card, "passport": passport, "inn": inn, "department_code": department_code, "address": address, "citizenship": citizenship,
    "passport_issuer": passport_issuer, "passport_issue_date": passport_issue_date, "driver_license": driver_license, "cvv": cvv, "pin": pin, "synthetic_client_id": client_id,
}


@dataclass(frozen=True)
class TableDetector:
    """A detector in Python that a user registers: find gives (start, stop) or (start, stop, score) of every sensitive span of a text, in order.

    It runs as a table function joined laterally, which gives one row with all detections for each text, so that nothing is shuffled."""

    detector_id: str
    category: str
    find: Callable[[str], Iterable[tuple]]
    score: float = 0.8
    rule_id: str | None = None

    def rows(self, text: str | None) -> list[tuple]:
        out = []
        for start, stop, *score in self.find(text) if text is not None else ():
            if not 0 <= start < stop <= len(text):
                raise ValueError(f"{self.detector_id}: invalid span {start}..{stop} in a text of {len(text)} characters")
            out.append((self.category, self.detector_id, self.rule_id or self.detector_id, float(score[0] if score else self.score), start, stop, [(start, stop)], []))
        return out

    def joined(self, docs: DataFrame, text: str, out: str) -> DataFrame:
        """docs with the detections in a column out."""
        rows = self.rows

        class Found:
            def eval(self, value: str) -> Iterator[tuple]:
                yield (rows(value),)

        return docs.lateralJoin(F.udtf(Found, returnType=f"`{out}` array<{DETECTION}>")(F.col(text).outer()))


#: Detectors registered by id; core.detect takes the ids beside those of NATIVE.
REGISTERED: dict[str, TableDetector] = {}


def register(d: TableDetector) -> TableDetector:
    """Make a detector known by its id. An id is taken once, and not by one that is built in."""
    if d.detector_id in NATIVE or d.detector_id in REGISTERED:
        raise ValueError(f"detector exists: {d.detector_id}")
    REGISTERED[d.detector_id] = d
    return d

"""Relations that Spark derives from the test tables for operators whose inputs those tables don't hold as they are.

Every order gives a text: the form of its key, filled in with numbers made from the key and the order's own date. Spans, tags, predictions
and scores come from orders and events in the same way. Each relation is one SELECT that Spark and DuckDB both run, so a query and its SQL read the same rows
and both grow with the tables.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

TEXTS: tuple[str, ...] = (
    "Почта клиента: ivan.petrov@example.test.",
    "Телефон: +7 912 345-67-89 доб. 321, запасной 8 (495) 1234567",
    "Карта: 4276 1890 7414 4957 и 4111-1111-1111-1111",
    "Номер заказа 4276189074144957, карта 4276189074144957 ниже по тексту стоит далеко",
    "Паспорт: серия 45 12, номер 789012; паспорт 4503 123456",
    "паспорт: 4503 123456, без метки 0318 654321",
    "ИНН клиента: 119098818444, организация 7707083893, ошибочный 7707083894",
    "Код подразделения: 770-123; КОД ПОДРАЗДЕЛЕНИЯ 770 124",
    "Адрес клиента: Россия, 350000, г. Краснодар, ул. Северная, д. 15, кв. 8.",
    "Адрес отделения: г. Москва, ул. Тверская, д. 7. Клиент проживает: г. Пермь, ул. Мира, дом 3",
    "Место рождения: г. Нижний Новгород",
    "Гражданство: Российская Федерация",
    "Паспорт выдан УФМС России по г. Москве дата выдачи 12.05.2010",
    "кем выдан: ОВД Центрального района код подразделения 770-123",
    "Дата выдачи: 2015.13.04. Встреча 12.05.2016. Дата рождения 01.02.1990",
    "Водительское удостоверение: 77 12 345678",
    "CVV: 123, CVC-код 9876, код безопасности: 555",
    "ПИН-код: 4321, PIN 87654321",
    "Карта 4276189074144957, PIN 4321",
    "Карта 4276189074144957\nPIN 4321",
    "Клиентский ID: AB12CD34EF",
    "Счёт 40702810900000000001 и ещё 40702810900000000002",
    "Номер 40702810900000000003 без метки",
    "Дата рождения: двадцать третьего мая 1987 года",
    "Дата рождения клиента Р. Э. Иванова: 12 апреля 1990 года, 31.02.1991 — дата рождения",
    "Клиент Иван Иванович Петров родился 12.04.1990 в Москве",
    "Поэт Александр Сергеевич Пушкин родился 06.06.1799 в Москве",
    "ФИО: Смирнова Анна Павловна, держатель карты: ANNA SMIRNOVA сообщила",
    "Cardholder: John Smith",
    "Фамилия: Кузнецов\nИмя: Олег",
    "Обычный текст без данных. Г. Пермь; ул. Мира! Конец?\nВторая строка",
    "😀 почта a.b@c-d.org 😀 тел. 89123456789",
    "",
)
#: Spans labelled by hand: (doc_id, category, start, stop).
GOLD: tuple[tuple[int, str, int, int], ...] = ((0, "EMAIL", 15, 39), (2, "CARD", 7, 26), (2, "CARD", 29, 48), (6, "INN", 13, 25), (6, "INN", 39, 49), (15, "DRIVER_LICENSE", 28, 40), (16, "CVV", 5, 8), (18, "CARD", 6, 22), (18, "PIN", 28, 32))
FOUND: tuple[tuple[int, str, int, int], ...] = ((0, "EMAIL", 15, 39), (2, "CARD", 7, 26), (2, "CARD", 30, 48), (6, "INN", 13, 25), (15, "PASSPORT", 28, 40), (16, "CVV", 5, 8), (16, "CVV", 18, 22), (18, "CARD", 6, 22), (18, "PIN", 28, 32), (18, "PIN", 28, 32))
LIFECYCLE: tuple[tuple[str, str, int, str, str], ...] = (("a", "p", 1, "email a@b.com", "email X"), ("a", "p", 2, "email a@b.com", "email X"), ("a", "p", 3, "email X", "email X"), ("a", "p", 4, "email X", "email X"), ("a", "p", 5, "other", "other"), ("b", "p", 1, "no data", "no data"), ("b", "p", 2, "no data", "no data"), ("b", "q", 7, "other", "other"))


def quoted(x: object) -> str:
    if isinstance(x, str):
        return "'" + x.replace("'", "''") + "'"
    return repr(x)


def values(rows: Sequence[Sequence[object]], names: str) -> str:
    """A relation of literal rows as SQL."""
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows) + f") AS v({names}))"


def digits(width: int, salt: int, key: str = "o_orderkey") -> str:
    """So many digits made from the key, as SQL for both engines."""
    return f"lpad(CAST(({key} * {7919 + 104729 * salt} + {31 * salt}) % {10 ** min(width, 15)} AS STRING), {width}, '{salt % 10}')"


def two(part: str) -> str:
    return f"lpad(CAST({part}(o_orderdate) AS STRING), 2, '0')"


#: Dates by day, month and year, by year, day and month, and runs of digits.
_FIELD = re.compile(r"(?P<date>\d\d\.\d\d\.\d{4})|(?P<iso>\d{4}\.\d\d\.\d\d)|(?P<number>\d{2,})")


def form(text: str) -> str:
    """SQL that fills a form: its dates become the order's, its numbers those of the key, at the same width; single digits and the 8 of a phone stay."""
    parts, at = [], 0
    for salt, m in enumerate(_FIELD.finditer(text)):
        parts.append(quoted(text[at : m.start()]))
        if m["date"]:
            parts += [two("day"), "'.'", two("month"), "'.'", "CAST(year(o_orderdate) AS STRING)"]
        elif m["iso"]:
            parts += ["CAST(year(o_orderdate) AS STRING)", "'.'", two("day"), "'.'", two("month")]
        elif len(m[0]) == 11:
            parts += [quoted(m[0][0]), digits(10, salt)]
        else:
            parts.append(digits(len(m[0]), salt))
        at = m.end()
    return f"concat({', '.join([*parts, quoted(text[at:])])})"


def of_forms(key: str, rows: Sequence[Sequence[object]], names: str) -> str:
    """The rows (of which the first column is the number of a form) for each order that has the form."""
    rest = names.split(", ")[1:]
    return f"(SELECT o_orderkey AS {key}, {', '.join(rest)} FROM orders JOIN (VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)}) AS v(form, {', '.join(rest)}) ON o_orderkey % {len(TEXTS)} = form)"


_N = len(TEXTS)
TEXTS_SQL = f"(SELECT o_orderkey AS doc_id, CASE o_orderkey % {_N} {' '.join(f'WHEN {i} THEN {form(t)}' for i, t in enumerate(TEXTS))} END AS text FROM orders)"
GOLD_SQL = of_forms("doc_id", GOLD, "doc_id, category, start, stop")
#: Every second order of a form misses its tax numbers.
FOUND_SQL = f"(SELECT * FROM {of_forms('doc_id', FOUND, 'doc_id, category, start, stop')} AS f WHERE NOT (category = 'INN' AND doc_id % {2 * _N} < {_N}))"
PREDICTIONS_SQL = """(SELECT user_id AS doc_id, CAST(event_id % 3 AS INT) AS window, CAST(event_id % 50 AS INT) AS token, CAST(event_id % 7 AS INT) AS rank,
max(CASE event_type WHEN 'view' THEN 'B-PER' WHEN 'click' THEN 'I-PER' ELSE 'O' END) AS tag FROM events GROUP BY user_id, event_id % 3, event_id % 50, event_id % 7)"""
TAGS_SQL = """(SELECT doc_id, token, 6 * token AS start, CAST(6 * token + 5 + event_id % 2 AS INT) AS stop, tag, value AS score FROM (SELECT user_id AS doc_id, event_id, value,
CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INT) AS token, CASE event_type WHEN 'view' THEN 'B-PER' WHEN 'click' THEN 'I-PER' WHEN 'purchase' THEN 'B-LOC' ELSE 'O' END AS tag FROM events) AS t)"""
_ENTAIL, _NEUTRAL = "(event_id * 37 % 101) / 100.0", "(event_id * 53 % 11) / 100.0"
SCORES_SQL = f"""(SELECT CAST(floor(event_id / 3) AS BIGINT) AS span_id, CAST(event_id % 3 AS INT) AS hyp, CASE event_id % 3 WHEN 0 THEN 'private' ELSE 'public' END AS kind,
CASE CAST(floor(event_id / 3) AS BIGINT) % 4 WHEN 0 THEN 'education' ELSE '-' END AS topic, CAST({_ENTAIL} AS DOUBLE) AS entail, CAST({_NEUTRAL} AS DOUBLE) AS neutral, CAST(event_id * 17 % 23 / 100.0 AS DOUBLE) AS contra FROM events)"""
#: Originals v0 and v1, which would be masked to #v0 and #v1; every fourth request sends a masked one.
LIFECYCLE_SQL = """(SELECT event_type AS namespace, CAST(user_id AS STRING) AS payload_id, event_id AS seq, concat(CASE event_id % 4 WHEN 3 THEN '#v' ELSE 'v' END, CAST(event_id % 2 AS STRING)) AS text,
concat('#', CASE event_id % 4 WHEN 3 THEN '#v' ELSE 'v' END, CAST(event_id % 2 AS STRING)) AS masked_text FROM events)"""
INNS_SQL = f"(SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN {digits(12, 1)} WHEN 1 THEN {digits(3, 2)} ELSE {digits(10, 3)} END AS inn FROM orders)"
#: Day, month and year, swapped for every third order, out of range for every fifth.
DATES_SQL = f"""(SELECT o_orderkey, CASE o_orderkey % 2 WHEN 0 THEN 'numeric' ELSE 'iso' END AS kind,
CASE WHEN o_orderkey % 2 = 1 THEN CAST(year(o_orderdate) AS STRING) WHEN o_orderkey % 5 = 0 THEN '40' WHEN o_orderkey % 3 = 0 THEN {two('month')} ELSE {two('day')} END AS a,
CASE WHEN o_orderkey % 5 = 0 THEN '41' WHEN o_orderkey % 2 = 1 AND o_orderkey % 3 = 0 THEN {two('day')} WHEN o_orderkey % 2 = 1 THEN {two('month')} WHEN o_orderkey % 3 = 0 THEN {two('day')} ELSE {two('month')} END AS b,
CASE WHEN o_orderkey % 2 = 0 THEN CAST(year(o_orderdate) AS STRING) WHEN o_orderkey % 3 = 0 THEN {two('month')} ELSE {two('day')} END AS c FROM orders)"""


def relation(spark: SparkSession, sf_dir: str, select: str, *tables: str) -> DataFrame:
    """A relation of this module over the tables of sf_dir."""
    for t in tables:
        select = re.sub(rf"\bFROM {t}\b", f"FROM {{{t}}}", select)
    return spark.sql(f"SELECT * FROM {select} AS r", **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, TEXTS_SQL, "orders")

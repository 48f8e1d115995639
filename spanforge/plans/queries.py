"""A query for each operator, over the test tables or an inline relation, with the DuckDB SQL for the same rows."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions import scalars as S
from spanforge.functions import tables
from spanforge.functions.spans import cut_of, find, let
from spanforge.operators import core, detectors, evaluate, joins, lifecycle, models, mutate, names, ner, policies, semantic
from spanforge.sources import sinks

from . import duck, fixtures
from .fixtures import TEXTS_SQL, values

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
KEY = b"fixture-key-for-tests-only-00000"


def query(sql: str | None = None, name: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def span_rows(docs: DataFrame, *names) -> DataFrame:
    found = core.spans(core.detect(docs.select("doc_id", "text"), names))
    return found.select("doc_id", "category", "rule_id", "start", "stop", cut_of(F.col("text"), F.col("start"), F.col("stop")).alias("value"))


def _sensitive() -> Column:
    """category, start and stop of every sensitive span of a row's detections."""
    return F.flatten(F.transform("detections", lambda x: F.transform(x["sensitive"], lambda s: F.struct(x["category"].alias("category"), s["start"].alias("start"), s["stop"].alias("stop")))))


# Spans over documents and pages.
_D = r"[0-9]"
_DASH = r"[\s\-–—]"
EMAIL_SCAN = dict(pattern=detectors.EMAIL, first=r"[A-Za-z0-9._%+-]", before=r"[A-Za-z0-9._%+-]", tail=r"$|\.(?:$|[^A-Za-z0-9])|[^A-Za-z0-9_%+@.\-]")
CARD_SCAN = dict(pattern=detectors.CARD, first=_D, before=_D, tail="$|[^0-9]")
INN_SCAN = dict(pattern=r"(?:[0-9]{10}|[0-9]{12})", first=_D, before=_D, tail="$|[^0-9]")
PHONE_SCAN = dict(pattern=detectors.PHONE, first="[+78]", before=_D, tail="$|[^0-9]")
RAW_SCAN = dict(pattern="".join(detectors.PASSPORT_RAW), first=_D, before=_D, tail="$|[^0-9]")
_ORDERS = "(?i)" + detectors.ORDER_LABEL


def _spans_sql(relation: str, how: dict, category: str, rule: str, unless_order: bool = False) -> str:
    gate = f" WHERE NOT regexp_matches(substr(text, 1, start), {fixtures.quoted('(?i)(?:' + detectors.ORDER_LABEL + ')(?s:.{0,40})$')})" if unless_order else ""
    return f"WITH RECURSIVE {duck.scan(relation, name='f', **how)} SELECT doc_id, '{category}' AS category, '{rule}' AS rule_id, start, stop, substr(text, start + 1, stop - start) AS value FROM f{gate}"


_PAGES = "(SELECT page_id AS doc_id, html AS text FROM pages)"
for _name, _how, _category, _rule, _gate in (
    ("email", EMAIL_SCAN, "EMAIL", "email-structure", False), ("card", CARD_SCAN, "CARD", "card-digits", True), ("inn", INN_SCAN, "INN", "inn-structure", True), ("phone", PHONE_SCAN, "PHONE", "phone-format", False),
):
    query(_spans_sql("documents", _how, _category, _rule, _gate), f"{_name}_spans")(lambda spark, d, n=_name: span_rows(table(spark, d, "documents"), n))
    query(_spans_sql(_PAGES, _how, _category, _rule, _gate), f"pages_{_name}_spans")(lambda spark, d, n=_name: span_rows(table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text")), n))
    query(_spans_sql(TEXTS_SQL, _how, _category, _rule, _gate), f"det_{_name}")(lambda spark, d, n=_name: span_rows(fixtures.texts(spark, d), n))

def _mail(text: str):
    """E-mail addresses by Python's own expressions, as a user would write a detector."""
    return (m.span() for m in re.finditer(detectors.EMAIL_BEFORE + detectors.EMAIL + detectors.EMAIL_BEHIND, text))


if "registered_email" not in detectors.REGISTERED:
    detectors.register(detectors.TableDetector("registered_email", "EMAIL", _mail, 0.95, "email-structure"))
query(_spans_sql("documents", EMAIL_SCAN, "EMAIL", "email-structure"), "detector_extension")(lambda spark, d: span_rows(table(spark, d, "documents"), "registered_email"))

# Labelled detectors over the forms of orders.
for _name, _tiles, _at, _category, _rule in (
    ("department_code", detectors.DEPARTMENT, (1,), "DEPARTMENT_CODE", "department-code-context"), ("driver_license", detectors.LICENSE, (1,), "DRIVER_LICENSE", "driver-license-context"),
    ("cvv", detectors.CVV, (1,), "CVV", "cvv-context"), ("pin", detectors.PIN, (1,), "PIN", "pin-context"), ("citizenship", detectors.CITIZENSHIP, (1,), "CITIZENSHIP", "citizenship-context"),
    ("synthetic_client_id", detectors.CLIENT_ID, (2,), "SYNTHETIC_CLIENT_ID", ""),
):
    query(duck.tiles(TEXTS_SQL, _tiles, _at, _category, _rule), f"det_{_name}")(lambda spark, d, n=_name: span_rows(fixtures.texts(spark, d), n))

query(
    f"SELECT * FROM ({duck.tiles(TEXTS_SQL, detectors.PASSPORT_LABEL, (1, 3), 'PASSPORT', 'passport-series-number')}) UNION ALL SELECT * FROM ({duck.tiles(TEXTS_SQL, detectors.PASSPORT_BARE, (1, 3), 'PASSPORT', 'passport-bare-label')}) UNION ALL "
    f"SELECT * FROM (WITH RECURSIVE {duck.scan(TEXTS_SQL, name='f', **RAW_SCAN)}, g AS (SELECT doc_id, start, stop, substr(text, start + 1, stop - start) AS v FROM f), h AS (SELECT *, length(regexp_extract(v, '^{detectors.SERIES}')) AS n FROM g) "
    "SELECT doc_id, 'PASSPORT' AS category, 'passport-raw-series-number' AS rule_id, start, (start + n)::INT AS stop, substr(v, 1, n) AS value FROM h UNION ALL SELECT doc_id, 'PASSPORT', 'passport-raw-series-number', (stop - 6)::INT, stop, right(v, 6) FROM h)",
    "det_passport",
)(lambda spark, d: span_rows(fixtures.texts(spark, d), "passport"))

query(
    f"WITH a AS ({duck.tiles(TEXTS_SQL, detectors.ISSUER, (1,), 'PASSPORT_ISSUER', 'passport-issuer-context')}), b AS (SELECT doc_id, category, rule_id, start, regexp_replace(regexp_replace(value, {fixtures.quoted(detectors.ISSUER_STOP.replace('(?iU)', '(?i)').replace(chr(92) + 'b', ''))}, ''), '\\s+$', '') AS value FROM a "
    f"WHERE regexp_matches(value, {fixtures.quoted(detectors.ISSUER_START.replace('(?iU)', '(?i)').replace(chr(92) + 'b', '(?:$|[^а-яё])'))})) SELECT doc_id, category, rule_id, start, (start + length(value))::INT AS stop, value FROM b WHERE value <> ''",
    "det_passport_issuer",
)(lambda spark, d: span_rows(fixtures.texts(spark, d), "passport_issuer"))

for _name in ("address", "passport_issue_date", "full_name", "cardholder_name", "birth_date", "birth_place"):
    query(None, f"det_{_name}")(lambda spark, d, n=_name: span_rows(fixtures.texts(spark, d), n))

ACCOUNT = detectors.RegexDetector("account_number", "ACCOUNT_NUMBER", r"[0-9]{20}", "(?i)(?:счёт|счет|account)", 40)
query(
    f"WITH m AS ({duck.tiles(TEXTS_SQL, ('[0-9]{20}',), (0,), 'ACCOUNT_NUMBER', 'config-regex-account_number')}), c AS ({duck.tiles(TEXTS_SQL, ('счёт|счет|account',), (0,), 'c', 'c')}) "
    "SELECT m.* FROM m WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = m.doc_id) OR EXISTS (SELECT 1 FROM c WHERE c.doc_id = m.doc_id AND m.start BETWEEN c.start - 10 AND c.stop + 40)",
    "det_regex_config",
)(lambda spark, d: span_rows(fixtures.texts(spark, d), ACCOUNT))

# Core pipeline over documents: two detectors whose spans DuckDB finds, too.
_ISLANDS = f"""WITH RECURSIVE {duck.scan('documents', name='e', **EMAIL_SCAN)}, {duck.scan('documents', name='c', **CARD_SCAN)},
s AS (SELECT doc_id, start, stop, 'EMAIL' AS category, 0 AS o FROM e UNION ALL SELECT doc_id, start, stop, 'CARD', 1 FROM c),
w AS (SELECT *, max(stop) OVER (PARTITION BY doc_id ORDER BY start, start - stop, o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
n AS (SELECT *, sum((reach IS NULL OR start > reach)::INT) OVER (PARTITION BY doc_id ORDER BY start, start - stop, o) AS seq FROM w),
r AS (SELECT doc_id, seq, min(start) AS start, max(stop) AS stop, arg_min(category, (start, start - stop, o)) AS category, count(*) AS n_spans FROM n GROUP BY ALL)"""


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    return core.resolve(core.detect(table(spark, d, "documents").select("doc_id", "text"), ("email", "card")))


@query(_ISLANDS + " SELECT doc_id, seq::BIGINT AS seq, start, stop, category, n_spans FROM r")
def core_resolve(spark, d):
    rows = core.spans(core.detect(table(spark, d, "documents").select("doc_id", "text"), ("email", "card"))).withColumn("ord", F.col("i") * 1000 + F.col("k"))
    return core.resolve_rows(rows)


@query(_ISLANDS + " SELECT doc_id, category, count(*) AS n FROM r GROUP BY ALL")
def core_category_counts(spark, d):
    return core.category_counts(_resolved(spark, d))


_MASKED = _ISLANDS + """, p AS (SELECT r.doc_id, seq, text, start, stop, coalesce(lag(stop) OVER (PARTITION BY r.doc_id ORDER BY seq), 0) AS cursor FROM r JOIN documents USING (doc_id)),
m AS (SELECT doc_id, count(*) AS n, string_agg(substr(text, cursor + 1, start - cursor) || '[REDACTED-' || (seq - 1)::BIGINT || ']', '' ORDER BY seq) || substr(any_value(text), max(stop) + 1) AS masked FROM p GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_spans, sha256(coalesce(masked, text)) AS masked_sha256, true AS restored_ok FROM documents d LEFT JOIN m USING (doc_id)"""


def _roundtrip(docs: DataFrame) -> DataFrame:
    out = core.restore(docs)
    return out.select("doc_id", F.size("resolved").cast("long").alias("n_spans"), F.sha2("masked_text", 256).alias("masked_sha256"), (F.col("restored") == F.col("text")).alias("restored_ok"))


@query(_MASKED)
def core_mask_opaque(spark, d):
    """The flagship: detect, resolve, mask and restore every document in one pass without a shuffle."""
    return _roundtrip(core.mask(_resolved(spark, d), KEY, action="opaque_token_full"))


_BLOCK = KEY.ljust(64, b"\0")
_IPAD, _OPAD = (bytes(x ^ p for x in _BLOCK).hex() for p in (0x36, 0x5C))


def _hmac_sql(message: str) -> str:
    return f"sha256(unhex('{_OPAD}') || unhex(sha256(unhex('{_IPAD}') || encode({message}))))"


@query(
    f"SELECT doc_id, {_hmac_sql('text')} AS fingerprint, ({_hmac_sql('text')})[1:8] AS short FROM documents",
)
def fingerprint(spark, d):
    h = S.hmac_sha256(KEY, F.col("text"))
    return table(spark, d, "documents").select("doc_id", h.alias("fingerprint"), F.substring(h, 1, 8).alias("short"))


@query()
def core_mask_tokens(spark, d):
    """Typed tokens from a keyed digest; rows only, restored_ok says that the text came back."""
    return _roundtrip(core.mask(_resolved(spark, d), KEY, namespace="docs"))


@query()
def mask_all_categories(spark, d):
    """All detectors, the Arrow ones too, over the inline texts, masked with tokens and restored."""
    from spanforge.operators.names import ARROW

    return _roundtrip(core.mask(core.resolve(core.detect(fixtures.texts(spark, d), (*detectors.NATIVE, *ARROW))), KEY))


@query(
    _ISLANDS + ", x AS (SELECT r.doc_id, start, length(substr(text, 1, start)) - length(replace(substr(text, 1, start), chr(10), '')) AS line FROM r JOIN documents USING (doc_id)) SELECT doc_id, start, line::INT AS line FROM x"
)
def record_index(spark, d):
    r = _resolved(spark, d).select("doc_id", "text", F.explode_outer("resolved").alias("r")).filter("r IS NOT NULL")
    return r.select("doc_id", F.col("r.start").alias("start"), core.line_of(F.col("text"), F.col("r.start")).alias("line"))


@query(
    f"WITH RECURSIVE {duck.scan(TEXTS_SQL, name='c', **CARD_SCAN)}, p AS ({duck.tiles(TEXTS_SQL, detectors.PIN, (1,), 'PIN', 'pin')}), q AS ({duck.tiles(TEXTS_SQL, (''.join(detectors.PIN),), (0,), 'PIN', 'pin')}), "
    f"t AS (SELECT * FROM {TEXTS_SQL}), l AS (SELECT p.doc_id, p.start, p.stop, len(string_split(substr(text, 1, q.start), chr(10))) AS line FROM p JOIN q ON p.doc_id = q.doc_id AND p.start BETWEEN q.start AND q.stop JOIN t ON t.doc_id = p.doc_id), "
    "cl AS (SELECT c.doc_id, len(string_split(substr(text, 1, start), chr(10))) AS line FROM c) SELECT l.doc_id, l.start, l.stop, EXISTS (SELECT 1 FROM cl WHERE cl.doc_id = l.doc_id AND cl.line = l.line) AS masked FROM l"
)
def core_combination(spark, d):
    found = core.detect(fixtures.texts(spark, d), ("card", "pin"))
    after = core.combine(found, (core.CombinationRule("pin_requires_related_card", "PIN", "CARD"),))
    before = found.select("doc_id", F.explode_outer("detections").alias("d")).filter("d.category = 'PIN'").select("doc_id", F.col("d.start").alias("at"), F.col("d.sensitive")[0].alias("s"))
    now = after.select("doc_id", F.explode_outer("detections").alias("d")).filter("d.category = 'PIN'").select("doc_id", F.col("d.start").alias("at"), (F.size("d.sensitive") > 0).alias("masked"))
    return before.join(now, ["doc_id", "at"]).select("doc_id", "s.start", "s.stop", "masked")


@query()
def guard_egress(spark, d):
    policy = core.Policy("demo_chat", "demo-chat", allow_unmask=True, allow_llm_egress=False)
    masked = core.mask(_resolved(spark, d), KEY)
    return core.egress_reasons(masked, policy, "stub", ("detect", "resolve", "mask"), ("BEGIN SECRET",), ("email", "card")).select("doc_id", F.array_join("reasons", "; ").alias("reasons"), (F.size("reasons") == 0).alias("ok"))


# Scalars.
@query(f"SELECT doc_id, sha256(translate(text, {fixtures.quoted(S.SPACES + S.DASHES)}, {fixtures.quoted(' ' * len(S.SPACES) + '-' * len(S.DASHES))})) AS normal_sha256, ((length(text) + 3) // 4)::BIGINT AS tokens, (octet_length(encode(text)) + 512)::BIGINT AS size_bytes, octet_length(encode(text)) <= 4096 AS within_limit, 'pii:vault:docs:' || doc_id AS vault_key, (length(text) / 3.5)::DOUBLE::BIGINT AS unused FROM documents".replace(", (length(text) / 3.5)::DOUBLE::BIGINT AS unused", ""))
def scalar_text(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.sha2(S.norm_text(t), 256).alias("normal_sha256"), S.token_estimate(t).alias("tokens"), S.size_estimate(t).alias("size_bytes"), (F.octet_length(t) <= 4096).alias("within_limit"), S.vault_key(F.lit("docs"), F.col("doc_id").cast("string")).alias("vault_key"))


@query("SELECT doc_id, (instr(lower(text), 'the') - 1)::INT AS first_the FROM documents")
def norm_find(spark, d):
    return table(spark, d, "documents").select("doc_id", S.norm_find(F.col("text"), F.lit("THE")).alias("first_the"))


_LUHN = "(SELECT sum(CASE WHEN (length(v) - i) % 2 = 1 THEN CASE WHEN 2 * x > 9 THEN 2 * x - 9 ELSE 2 * x END ELSE x END) % 10 = 0 FROM (SELECT unnest(range(1, length(v) + 1)) AS i, unnest(list_transform(string_split(v, ''), lambda c: c::INT)) AS x))"


@query(f"WITH RECURSIVE {duck.scan('documents', name='f', **CARD_SCAN)}, v AS (SELECT doc_id, start, regexp_replace(substr(text, start + 1, stop - start), '[^0-9]', '', 'g') AS v FROM f), x AS (SELECT doc_id, start, v, unnest(range(1, length(v) + 1)) AS i FROM v), s AS (SELECT doc_id, start, sum(CASE WHEN (length(v) - i) % 2 = 1 THEN (2 * substr(v, i, 1)::INT) // 10 + (2 * substr(v, i, 1)::INT) % 10 ELSE substr(v, i, 1)::INT END) % 10 = 0 AS ok FROM x GROUP BY doc_id, start) SELECT count(*)::BIGINT AS n, count(*) FILTER (ok)::BIGINT AS n_valid FROM s")
def card_luhn_share(spark, d):
    t = F.col("text")
    c = table(spark, d, "documents").select("text", F.explode(find(t, (detectors.CARD,), r"(?<!\d)", r"(?!\d)", "")).alias("m"))
    ok = S.luhn(F.regexp_replace(cut_of(t, F.col("m.start"), F.col("m.stop")), "[^0-9]", ""))
    return c.agg(F.count("*").alias("n"), F.count_if(ok).alias("n_valid"))


def _inn_sql(weights, upto: str) -> str:
    total = " + ".join(f"{w} * substr(inn, {i + 1}, 1)::INT" for i, w in enumerate(weights))
    return f"(({total}) % 11 % 10 = {upto})"


@query(f"SELECT inn, CASE length(inn) WHEN 10 THEN {_inn_sql(S.INN_10, 'substr(inn, 10, 1)::INT')} WHEN 12 THEN {_inn_sql(S.INN_12A, 'substr(inn, 11, 1)::INT')} AND {_inn_sql(S.INN_12B, 'substr(inn, 12, 1)::INT')} ELSE false END AS valid, o_orderkey FROM {fixtures.INNS_SQL} AS i")
def inn_checksum(spark, d):
    return fixtures.relation(spark, d, fixtures.INNS_SQL, "orders").select("o_orderkey", "inn", S.inn_valid(F.col("inn")).alias("valid"))


@query(
    f"WITH t AS (SELECT o_orderkey, kind, a::INT AS a, b::INT AS b, c::INT AS c FROM {fixtures.DATES_SQL} AS r), p AS (SELECT *, CASE WHEN kind = 'numeric' THEN CASE WHEN b BETWEEN 1 AND 12 THEN a WHEN a BETWEEN 1 AND 12 THEN b END ELSE CASE WHEN b > 12 AND c BETWEEN 1 AND 12 THEN b ELSE c END END AS day, "
    "CASE WHEN kind = 'numeric' THEN CASE WHEN b BETWEEN 1 AND 12 THEN b WHEN a BETWEEN 1 AND 12 THEN a END ELSE CASE WHEN b > 12 AND c BETWEEN 1 AND 12 THEN c ELSE b END END AS month FROM t) "
    "SELECT o_orderkey, kind, a, b, c, day, month, coalesce(day BETWEEN 1 AND 31 AND month BETWEEN 1 AND 12 AND CASE WHEN kind = 'numeric' THEN c ELSE a END BETWEEN 1900 AND 2026, false) AS plausible FROM p"
)
def date_parse(spark, d):
    t = fixtures.relation(spark, d, fixtures.DATES_SQL, "orders")
    when = F.when(F.col("kind") == "numeric", S.parse_date("numeric", F.col("a"), F.col("b"), F.col("c"))).otherwise(S.parse_date("iso", F.col("a"), F.col("b"), F.col("c")))
    x = t.withColumn("d", when)
    return x.select("o_orderkey", "kind", *[F.col(n).cast("int").alias(n) for n in "abc"], "d.day", "d.month", F.coalesce(S.date_plausible(F.col("d.day"), F.col("d.month"), F.col("d.year")), F.lit(False)).alias("plausible"))


#: The day of an order in words, as tens and unit from 21 on, and its month in one of two cases.
_UNITS = sorted(S.DAY_UNITS, key=S.DAY_UNITS.get)
_DAY_WORDS = [w for w, _ in sorted(((w, n) for w, n in S.DAYS.items() if n <= 20 or n == 30), key=lambda x: x[1])]
_DAY_WORDS = {S.DAYS[w]: w for w in _DAY_WORDS} | {t + S.DAY_UNITS[u]: f"{name} {u}" for t, name in ((20, "двадцать"), (30, "тридцать")) for u in _UNITS if t + S.DAY_UNITS[u] <= 31}
_BY = lambda part, table: f"CASE {part}(o_orderdate) {' '.join(f'WHEN {k} THEN {fixtures.quoted(v)}' for k, v in table.items())} END"
_WORDS_SQL = f"(SELECT o_orderkey, o_orderdate, CASE o_orderkey % 3 WHEN 0 THEN upper({_BY('month', dict(enumerate(S.MONTHS, 1)))}) WHEN 1 THEN {_BY('month', dict(enumerate(S.MONTHS_NOMINATIVE, 1)))} ELSE 'foo' END AS month, {_BY('day', _DAY_WORDS)} AS day FROM orders)"


@query(f"SELECT o_orderkey, month, day, CASE o_orderkey % 3 WHEN 2 THEN 0 ELSE month(o_orderdate) END::INT AS month_number, day(o_orderdate)::INT AS day_number FROM {_WORDS_SQL} AS w")
def date_words(spark, d):
    return fixtures.relation(spark, d, _WORDS_SQL, "orders").select("o_orderkey", "month", "day", S.month_index(F.col("month")).alias("month_number"), S.day_number(F.col("day")).alias("day_number"))


@query()
def aead_roundtrip(spark, d):
    key, aad = F.lit(KEY), F.concat_ws("|", F.lit("v1"), F.lit("docs"), F.col("doc_id").cast("string"))
    sealed = table(spark, d, "documents").select("doc_id", "text", S.seal(F.col("text"), key, aad).alias("x"))
    return sealed.select("doc_id", (S.unseal(F.col("x"), key, aad) == F.col("text")).alias("ok"), S.unseal(F.col("x"), key, F.lit("other")).isNull().alias("bound"))


# Joins: events stand in for marks and positions (user as document, seconds as place).
_EV = "(SELECT user_id AS doc_id, event_id, floor(epoch(ts))::BIGINT AS start, floor(epoch(ts))::BIGINT + 5 AS stop, event_type AS category FROM events)"


def _events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    return e.select(F.col("user_id").alias("doc_id"), "event_id", at.alias("start"), (at + 5).alias("stop"), F.col("event_type").alias("category"))


@query(f"WITH e AS {_EV} SELECT a.event_id FROM e a WHERE category = 'purchase' AND EXISTS (SELECT 1 FROM e b WHERE b.doc_id = a.doc_id AND b.category = 'view' AND a.start BETWEEN b.start - 30 AND b.stop + 3600)")
def join_near(spark, d):
    e = _events(spark, d)
    return joins.near(e.filter("category = 'purchase'"), e.filter("category = 'view'").select("doc_id", "start", "stop"), 30, 3600).select("event_id")


@query(f"WITH e AS {_EV} SELECT a.event_id FROM e a WHERE category = 'purchase' AND NOT EXISTS (SELECT 1 FROM e b WHERE b.doc_id = a.doc_id AND b.category = 'view' AND a.start BETWEEN b.start AND b.stop + 3600)")
def join_near_anti(spark, d):
    e = _events(spark, d)
    return joins.near(e.filter("category = 'purchase'"), e.filter("category = 'view'").select("doc_id", "start", "stop"), 0, 3600, anti=True).select("event_id")


@query(f"""WITH e AS {_EV}, v AS (SELECT * FROM e WHERE category = 'view'), c AS (SELECT * FROM e WHERE category = 'click')
SELECT a.event_id FROM e a WHERE category = 'purchase' AND EXISTS (SELECT 1 FROM v WHERE v.doc_id = a.doc_id AND a.start BETWEEN v.start - 5 AND v.stop + 86400 AND NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = a.doc_id AND c.start > v.stop AND c.stop <= a.start))""")
def join_office(spark, d):
    """Purchases within a day behind a view with no click in between: a range join with a nested not-exists."""
    e = _events(spark, d)
    return joins.near_unless(e.filter("category = 'purchase'"), e.filter("category = 'view'"), e.filter("category = 'click'"), 5, 86400).select("event_id")


_WIDE = _EV.replace("+ 5 AS stop", "+ 60 + event_id % 7 * 30000 AS stop")


def _wide(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).withColumn("stop", F.col("start") + 60 + F.col("event_id") % 7 * 30000)


for _name, _test, _args in (
    ("join_span_overlap", "a.start < b.stop AND b.start < a.stop", {}), ("join_span_contain", "b.start <= a.start AND a.stop <= b.stop", {"contained": True}), ("join_touch", "a.start < b.stop AND b.start < a.stop", {"anti": True}),
    ("join_concealed", "b.start <= a.start AND a.stop <= b.stop AND a.kind = b.kind", {"contained": True, "same_category": True}),
):
    query(f"WITH e AS (SELECT *, event_id % 3 AS kind FROM {_WIDE} AS w) SELECT a.event_id FROM e a WHERE category = 'purchase' AND {'NOT ' if 'anti' in _args else ''}EXISTS (SELECT 1 FROM e b WHERE b.category = 'view' AND b.doc_id = a.doc_id AND {_test})", _name)(
        lambda spark, d, args=_args: joins.overlapping(*[_wide(spark, d).filter(F.col("category") == c).withColumn("category", F.col("event_id") % 3) for c in ("purchase", "view")], **args).select("event_id")
    )


@query(f"WITH e AS {_EV} SELECT a.event_id, max(b.start) AS start_found, max(b.event_id) FILTER (b.start = (SELECT max(c.start) FROM e c WHERE c.doc_id = a.doc_id AND c.category = 'view' AND c.start <= a.start)) AS view_id FROM e a LEFT JOIN e b ON b.doc_id = a.doc_id AND b.category = 'view' AND b.start <= a.start WHERE a.category = 'purchase' GROUP BY a.event_id, a.doc_id, a.start")
def join_as_of(spark, d):
    e = _events(spark, d)
    views = e.filter("category = 'view'").select("doc_id", "start", F.col("event_id").alias("view_id"))
    return joins.as_of(e.filter("category = 'purchase'"), views, "doc_id", "start", "view_id").select("event_id", "start_found", "view_id")


@query(f"WITH e AS {_EV} SELECT a.event_id, min(least(abs(a.start - b.start), abs(a.start - b.stop)))::BIGINT AS distance FROM e a LEFT JOIN e b ON b.doc_id = a.doc_id AND b.category = 'view' WHERE a.category = 'purchase' GROUP BY a.event_id")
def join_nearest(spark, d):
    e = _events(spark, d)
    return joins.nearest(e.filter("category = 'purchase'"), e.filter("category = 'view'").select("doc_id", "start", "stop")).select("event_id", "distance")


@query()
def join_sentence(spark, d):
    """The sentences of documents with the spans that start in them, of the categories whose sentence is looked at; sentences without spans, too."""
    docs = core.detect(table(spark, d, "documents").select("doc_id", "text"), [c.lower() for c in semantic.ELIGIBLE])
    found = docs.select("doc_id", F.explode_outer(let(_sensitive(), lambda s: joins.in_sentences(F.col("text"), s))).alias("x")).filter("x IS NOT NULL")
    return found.select("doc_id", F.col("x.start").cast("long").alias("start"), F.col("x.stop").cast("long").alias("stop"), "x.category", F.col("x.span_start").cast("long").alias("span_start"), F.col("x.span_stop").cast("long").alias("span_stop"))


# Evaluation over labelled spans.
_GOLD, _FOUND = (f"(SELECT * FROM {x} AS r)" for x in (fixtures.GOLD_SQL, fixtures.FOUND_SQL))


def _labelled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return fixtures.relation(spark, d, fixtures.GOLD_SQL, "orders"), fixtures.relation(spark, d, fixtures.FOUND_SQL, "orders")


_PRF = f"""WITH gs AS {_GOLD}, fs AS {_FOUND}, g AS (SELECT category, count(*) AS n_gold FROM gs GROUP BY 1), p AS (SELECT category, count(*) AS n_found FROM fs GROUP BY 1),
t AS (SELECT category, count(*) AS n_exact FROM gs WHERE EXISTS (SELECT 1 FROM fs WHERE fs.doc_id = gs.doc_id AND fs.category = gs.category AND fs.start = gs.start AND fs.stop = gs.stop) GROUP BY 1),
n AS (SELECT category, coalesce(n_gold, 0) AS n_gold, coalesce(n_found, 0) AS n_found, coalesce(n_exact, 0) AS n_exact FROM g FULL JOIN p USING (category) LEFT JOIN t USING (category)),
r AS (SELECT *, n_exact / nullif(n_found, 0)::DOUBLE AS precision, n_exact / nullif(n_gold, 0)::DOUBLE AS recall FROM n),
f AS (SELECT *, 2 * precision * recall / nullif(precision + recall, 0) AS f1, 2 * n_exact / nullif(n_gold + n_found, 0)::DOUBLE AS f1_counts FROM r)"""


@query(_PRF + " SELECT * FROM f")
def agg_cat_prf(spark, d):
    return evaluate.by_category(*_labelled(spark, d))


@query(_PRF + " SELECT round(avg(precision), 9) AS macro_precision, round(avg(recall), 9) AS macro_recall, round(avg(f1), 9) AS macro_f1 FROM f")
def agg_macro(spark, d):
    out = evaluate.macro(evaluate.by_category(*_labelled(spark, d)))
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@query(
    f"""WITH t AS (SELECT * FROM {TEXTS_SQL}), g AS (SELECT DISTINCT doc_id, unnest(range(start, stop)) AS p FROM {_GOLD}), f AS (SELECT DISTINCT doc_id, unnest(range(start, stop)) AS p FROM {_FOUND}),
c AS (SELECT doc_id, length(text) AS n, (SELECT count(*) FROM g WHERE g.doc_id = t.doc_id) AS g, (SELECT count(*) FROM f WHERE f.doc_id = t.doc_id) AS f, (SELECT count(*) FROM g JOIN f USING (doc_id, p) WHERE g.doc_id = t.doc_id) AS b FROM t)
SELECT doc_id, b / nullif(g, 0)::DOUBLE AS char_recall, b / nullif(f, 0)::DOUBLE AS char_precision, (f - b) / nullif(n - g, 0)::DOUBLE AS char_overmask FROM c"""
)
def agg_char_doc(spark, d):
    return evaluate.by_document_chars(fixtures.texts(spark, d), *_labelled(spark, d))


@query(
    f"""WITH g AS {_GOLD}, f AS {_FOUND} SELECT g.*, CASE WHEN EXISTS (SELECT 1 FROM f WHERE f.doc_id = g.doc_id AND f.category = g.category AND f.start = g.start AND f.stop = g.stop) THEN 'exact'
WHEN EXISTS (SELECT 1 FROM f WHERE f.doc_id = g.doc_id AND f.start < g.stop AND g.start < f.stop) THEN 'partial' ELSE 'missed' END AS outcome,
EXISTS (SELECT 1 FROM f WHERE f.doc_id = g.doc_id AND f.category = g.category AND f.start <= g.start AND g.stop <= f.stop) AS concealed FROM g"""
)
def agg_missed(spark, d):
    return evaluate.outcome_of_gold(*_labelled(spark, d))


@query(f"WITH g AS {_GOLD}, f AS {_FOUND} SELECT f.* FROM f ANTI JOIN g USING (doc_id, category, start, stop)")
def agg_false_pos(spark, d):
    return evaluate.false_positives(*_labelled(spark, d)).select("doc_id", "category", "start", "stop")


@query("SELECT event_type, count(value)::BIGINT AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, max(value) AS max FROM events GROUP BY 1")
def agg_timing(spark, d):
    out = evaluate.timing(table(spark, d, "events"), ["event_type"], "value")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "p50", "p95", "p99")})


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1")
def agg_pctl_nearest(spark, d):
    return evaluate.percentile_nearest(table(spark, d, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


@query("WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, max(value) FILTER (k = least(n - 1, floor(0.5 * n))) AS p50, max(value) FILTER (k = least(n - 1, floor(0.95 * n))) AS p95 FROM r GROUP BY 1")
def agg_pctl_floor(spark, d):
    return evaluate.percentile_floor(table(spark, d, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT event_type, count(*)::BIGINT AS n, round(quantile_cont(value, 0.95), 6) AS p95 FROM r WHERE k <= 1024 GROUP BY 1")
def win_last_n(spark, d):
    last = evaluate.last_n(table(spark, d, "events"), ["event_type"], ["ts", "event_id"], 1024)
    return last.groupBy("event_type").agg(F.count("*").alias("n")).join(evaluate.percentile_interpolated(last, ["event_type"], "value", {"p95": 0.95}), "event_type").withColumn("p95", F.round("p95", 6))


_BOUNDS = (1.0, 2.0, 5.0, 10.0, 20.0, 50.0)


@query(f"SELECT event_type, [{', '.join(f'count(*) FILTER ({test})::BIGINT' for test in [f'value <= {_BOUNDS[0]}', *[f'value > {a} AND value <= {b}' for a, b in zip(_BOUNDS, _BOUNDS[1:])], f'value > {_BOUNDS[-1]}'])}] AS buckets, count(value)::BIGINT AS count, round(sum(value), 4) AS sum FROM events GROUP BY 1")
def agg_hist(spark, d):
    """Histograms of two batches merged into one."""
    e = table(spark, d, "events")
    states = [evaluate.histogram(e.filter(F.col("event_id") % 2 == k), ["event_type"], "value", _BOUNDS) for k in (0, 1)]
    return evaluate.merge_histograms(states[0].unionByName(states[1]), ["event_type"], len(_BOUNDS) + 1).withColumn("sum", F.round("sum", 4))


@query(f"WITH g AS {_GOLD}, f AS {_FOUND} SELECT count(*)::BIGINT AS n_found, count(*) FILTER (hit)::BIGINT AS n_exact, round(count(*) FILTER (hit) / count(*)::DOUBLE, 9) AS boundary FROM (SELECT EXISTS (SELECT 1 FROM g WHERE g.doc_id = f.doc_id AND g.category = f.category AND g.start = f.start AND g.stop = f.stop) AS hit FROM f)")
def agg_boundary(spark, d):
    """The share of found spans whose bounds and category are exactly those of a gold one."""
    gold, found = _labelled(spark, d)
    marked = found.join(gold.distinct().withColumn("hit", F.lit(True)), ["doc_id", "category", "start", "stop"], "left")
    return marked.agg(F.count("*").alias("n_found"), F.count("hit").alias("n_exact"), F.round(evaluate.ratio(F.count("hit"), F.count("*")), 9).alias("boundary"))


@query("WITH r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rank FROM events) SELECT event_type, event_id, rank::INT AS rank FROM r WHERE rank <= 10")
def limit_failures(spark, d):
    return evaluate.first_n(table(spark, d, "events"), ["event_type"], ["ts", "event_id"]).select("event_type", "event_id", "rank")


@query("WITH b AS (SELECT event_type, epoch(date_trunc('second', ts))::BIGINT AS second, count(*)::BIGINT AS n FROM events GROUP BY ALL) SELECT event_type, second, n, sum(n) OVER (PARTITION BY event_type ORDER BY second RANGE BETWEEN 59 PRECEDING AND CURRENT ROW)::BIGINT AS n_window FROM b")
def win_rolling_rate(spark, d):
    return evaluate.rolling(table(spark, d, "events"), ["event_type"])


_STATUS = "CASE event_type WHEN 'purchase' THEN 'success' WHEN 'view' THEN 'overload' ELSE 'error' END"


@query(f"WITH e AS (SELECT user_id, {_STATUS} AS s FROM events) SELECT user_id, count(*)::BIGINT AS n, count(*) FILTER (s = 'success')::BIGINT AS n_success, count(*) FILTER (s = 'overload')::BIGINT AS n_overload, count(*) FILTER (s = 'error')::BIGINT AS n_error, count(*) FILTER (s = 'success') / count(*)::DOUBLE AS success_fraction FROM e GROUP BY 1")
def agg_observation(spark, d):
    return evaluate.success_fraction(table(spark, d, "events"), ["user_id"], F.expr(_STATUS))


@query("SELECT CASE WHEN length(text) < 5000 THEN 'short' WHEN length(text) < 50000 THEN 'medium' ELSE 'large' END AS bucket, count(*)::BIGINT AS n, sum((length(text) + 3) // 4)::BIGINT AS tokens FROM documents GROUP BY 1")
def agg_length_buckets(spark, d):
    n = F.length("text")
    b = table(spark, d, "documents").select(F.when(n < 5000, "short").when(n < 50000, "medium").otherwise("large").alias("bucket"), S.token_estimate(F.col("text")).alias("t"))
    return b.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("t").alias("tokens"))


@query("SELECT event_id, event_type IN ('purchase', 'view') AS kept FROM events")
def agg_label_sanitize(spark, d):
    labels = evaluate.sanitize(F.create_map(F.lit("operation"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string")), {"operation": ("purchase", "view")})
    return table(spark, d, "events").select("event_id", (F.size(labels) == 1).alias("kept"))


@query("SELECT source, grouping(lang)::INT AS all_langs, lang, count(*)::BIGINT AS n, avg(n_chars) AS mean_chars FROM documents GROUP BY GROUPING SETS ((source, lang), (source))")
def agg_summary(spark, d):
    return spark_grouping(table(spark, d, "documents"))


def spark_grouping(docs: DataFrame) -> DataFrame:
    g = docs.groupingSets([["source", "lang"], ["source"]], "source", "lang").agg(F.grouping("lang").cast("int").alias("all_langs"), F.count("*").alias("n"), F.avg("n_chars").alias("mean_chars"))
    return g.select("source", "all_langs", "lang", "n", "mean_chars")



# Lifecycle.
_LIFE = """w AS (SELECT *, first_value(text) OVER k AS first, first_value(masked_text) OVER k AS masked, row_number() OVER k AS n FROM e WINDOW k AS (PARTITION BY namespace, payload_id ORDER BY seq)),
o AS (SELECT *, CASE WHEN n = 1 THEN 'MASK' WHEN text = masked THEN 'RESTORE' WHEN text = first THEN 'MASK_REPLAY' ELSE 'CONFLICT' END AS outcome FROM w)
SELECT namespace, payload_id, seq, outcome, CASE WHEN outcome IN ('MASK', 'MASK_REPLAY') THEN masked WHEN outcome = 'RESTORE' THEN first END AS result FROM o"""


@query(f"WITH e AS (SELECT * FROM {fixtures.LIFECYCLE_SQL} AS r), " + _LIFE)
def life_process(spark, d):
    return lifecycle.process(fixtures.relation(spark, d, fixtures.LIFECYCLE_SQL, "events")).select("namespace", "payload_id", "seq", "outcome", "result")


@query("WITH e AS (SELECT role AS namespace, conv_id::VARCHAR AS payload_id, turn AS seq, text, 'masked: ' || text AS masked_text FROM conversations), " + _LIFE)
def life_process_conversations(spark, d):
    e = table(spark, d, "conversations").select(F.col("role").alias("namespace"), F.col("conv_id").cast("string").alias("payload_id"), F.col("turn").alias("seq"), "text", F.concat(F.lit("masked: "), "text").alias("masked_text"))
    return lifecycle.process(e).select("namespace", "payload_id", "seq", "outcome", "result")


@query("WITH l AS (SELECT event_type AS namespace, user_id AS key, max(ts) AS ts, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL) SELECT namespace, key, value FROM l WHERE ts + INTERVAL 3600 SECONDS > (SELECT max(ts) FROM events)")
def vault_ttl_state(spark, d):
    e = table(spark, d, "events")
    now = e.agg(F.max("ts").alias("now"))  # one row
    writes = e.groupBy(F.col("event_type").alias("namespace"), F.col("user_id").alias("key")).agg(F.max_by(F.struct("ts", "value"), F.struct("ts", "event_id")).alias("r")).select("namespace", "key", "r.ts", "r.value", F.lit(8).alias("size_bytes"))
    return lifecycle.live(writes, now).select("namespace", "key", "value")


@query("""WITH RECURSIVE e AS (SELECT event_type AS namespace, user_id AS key, event_id AS seq, 100 + user_id % 7 AS size, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events),
r AS (SELECT DISTINCT namespace, 0::BIGINT AS n, MAP([]::BIGINT[], []::BIGINT[]) AS held, NULL::BIGINT AS key, NULL::BIGINT AS seq, NULL::BOOLEAN AS accepted FROM e
UNION ALL SELECT namespace, n, CASE WHEN fits THEN then_held ELSE held END, key, seq, fits FROM (SELECT *, cardinality(then_held) <= 50 AND list_sum(map_values(then_held)) <= 5000 AS fits
FROM (SELECT r.namespace, e.n, r.held, e.key, e.seq, map_concat(r.held, MAP([e.key], [e.size])) AS then_held FROM r JOIN e ON e.namespace = r.namespace AND e.n = r.n + 1)))
SELECT namespace, key, seq, accepted FROM r WHERE n > 0""")
def vault_capacity(spark, d):
    w = table(spark, d, "events").select(F.col("event_type").alias("namespace"), F.col("user_id").alias("key"), F.col("event_id").alias("seq"), (100 + F.col("user_id") % 7).alias("size_bytes"))
    return lifecycle.within_capacity(w, 50, 5000).select("namespace", "key", "seq", "accepted")


@query("""WITH RECURSIVE e AS (SELECT event_type AS namespace, user_id AS key, event_id AS seq, event_id::DOUBLE AS t, 100.0 * (1 + event_id % 4) AS lease, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS n FROM events),
r AS (SELECT namespace, key, seq, n, true AS granted, t + lease AS until FROM e WHERE n = 1
UNION ALL SELECT e.namespace, e.key, e.seq, e.n, r.until <= e.t, CASE WHEN r.until <= e.t THEN e.t + e.lease ELSE r.until END FROM r JOIN e ON e.namespace = r.namespace AND e.key = r.key AND e.n = r.n + 1)
SELECT namespace, key, seq, granted FROM r""")
def vault_claims(spark, d):
    e = table(spark, d, "events")
    return lifecycle.claims(e.select(F.col("event_type").alias("namespace"), F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.lit("w").alias("owner"), F.col("event_id").cast("double").alias("at"), (100.0 * (1 + F.col("event_id") % 4)).alias("lease_seconds")))


@query("""WITH RECURSIVE e AS (SELECT event_type AS namespace, user_id AS key, event_id AS seq, ['claim', 'commit', 'reclaim', 'release', 'get', 'claim'][(event_id % 6 + 1)::INT] AS action, 'w' || ((event_id // 6) % 2) AS owner, event_id::DOUBLE AS t,
row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS n FROM events),
r AS (SELECT namespace, key, seq, n, action, action = 'claim' AS done, CASE WHEN action = 'claim' THEN {'owner': owner, 'working': true, 'lease': t + 300, 'gone': t + 2000} END AS held FROM e WHERE n = 1
UNION ALL SELECT namespace, key, seq, n, action, done, CASE WHEN done AND action = 'release' THEN NULL WHEN done AND action <> 'get' THEN {'owner': owner, 'working': action <> 'commit', 'lease': t + 300, 'gone': t + 2000} ELSE live END
FROM (SELECT *, CASE action WHEN 'claim' THEN live IS NULL WHEN 'get' THEN live IS NOT NULL WHEN 'reclaim' THEN live IS NOT NULL AND live.working AND live.lease <= t ELSE live IS NOT NULL AND live.owner = owner END AS done
FROM (SELECT e.*, CASE WHEN r.held.gone > e.t THEN r.held END AS live FROM r JOIN e ON e.namespace = r.namespace AND e.key = r.key AND e.n = r.n + 1)))
SELECT namespace, key, seq, action, done FROM r""")
def vault_records(spark, d):
    """Claim, commit, reclaim, release and get of records by two owners, with leases and expiry."""
    actions = F.array(*[F.lit(a) for a in ("claim", "commit", "reclaim", "release", "get", "claim")])
    n = F.col("event_id")
    e = table(spark, d, "events").select(F.col("event_type").alias("namespace"), F.col("user_id").alias("key"), n.alias("seq"), F.get(actions, (n % 6).cast("int")).alias("action"), F.concat(F.lit("w"), (F.floor(n / 6) % 2).cast("string")).alias("owner"), n.cast("double").alias("at"), F.lit(300.0).alias("lease_seconds"), F.lit(2000.0).alias("ttl_seconds"))
    return lifecycle.records(e).select("namespace", "key", "seq", "action", "done")


@query("""WITH s AS (SELECT conv_id, max(text) FILTER (turn = 0) AS original, upper(max(text) FILTER (turn = 0)) AS masked FROM conversations WHERE conv_id % 3 <> 0 GROUP BY conv_id),
q AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN upper(text) ELSE text END AS text FROM conversations)
SELECT q.conv_id, turn, CASE WHEN s.conv_id IS NULL THEN 'CONTEXT_MISSING' WHEN text = masked THEN 'RESTORED' ELSE 'CONFLICT' END AS outcome, CASE WHEN text = masked THEN original END AS result FROM q LEFT JOIN s USING (conv_id)""")
def life_unmask(spark, d):
    c = table(spark, d, "conversations").withColumn("namespace", F.lit("n"))
    first = F.max(F.when(F.col("turn") == 0, F.col("text")))
    stored = c.filter("conv_id % 3 <> 0").groupBy("namespace", F.col("conv_id").alias("payload_id")).agg(first.alias("original"), F.upper(first).alias("masked_text"))
    asked = c.select("namespace", F.col("conv_id").alias("payload_id"), "turn", F.when(F.col("turn") % 2 == 0, F.upper("text")).otherwise(F.col("text")).alias("text"))
    return lifecycle.unmask(asked, stored).select(F.col("payload_id").alias("conv_id"), "turn", "outcome", "result")


# Model parts: embeddings stand in for logits.
@query("WITH s AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), x AS (SELECT vec_id, list_transform(e, lambda v: exp(v - list_max(e))) AS x, (list_position(e, list_max(e)) - 1)::BIGINT AS best FROM s) SELECT vec_id, best, round(list_max(x) / list_sum(x), 9) AS top FROM x")
def ml_softmax(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", models.argmax(F.col("embedding")).alias("best"), F.round(F.array_max(models.softmax(F.col("embedding"))), 9).alias("top"))


@query("WITH n AS (SELECT doc_id, ((length(text) + 3) // 4)::BIGINT AS n FROM documents), w AS (SELECT doc_id, n, unnest(range(0, CASE WHEN n <= 254 THEN 1 ELSE ceil((n - 254) / 206.0)::BIGINT + 1 END)) AS k FROM n WHERE n > 0) SELECT doc_id, k::INT AS window, k * 206 AS first, least(k * 206 + 254, n) AS last FROM w")
def ml_ner_window(spark, d):
    return models.windows(table(spark, d, "documents").select("doc_id", S.token_estimate(F.col("text")).alias("n_tokens")))


@query(f"WITH p AS {fixtures.PREDICTIONS_SQL.replace(' AS window', ' AS "window"')} SELECT doc_id, \"window\", token, rank, tag FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, token ORDER BY rank DESC, \"window\") AS k FROM p) WHERE k = 1")
def ml_ner_select(spark, d):
    return models.select_predictions(fixtures.relation(spark, d, fixtures.PREDICTIONS_SQL, "events"))


@query(
    f"""WITH t AS (SELECT *, substr(tag, 3) AS label FROM {fixtures.TAGS_SQL} AS r WHERE tag <> 'O'),
j AS (SELECT *, CASE WHEN lag(label) OVER w = label AND lag(token) OVER w = token - 1 AND (starts_with(tag, 'I-') OR lag(stop) OVER w = start) THEN 0 ELSE 1 END AS fresh FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY start, stop)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY start, stop) AS entity FROM j)
SELECT doc_id, entity::BIGINT AS entity, min(start) AS start, max(stop) AS stop, any_value(label) AS label, round(avg(score::DOUBLE), 9) AS score FROM s GROUP BY doc_id, entity"""
)
def ml_bio_merge(spark, d):
    return models.merge_tags(fixtures.relation(spark, d, fixtures.TAGS_SQL, "events")).withColumn("score", F.round("score", 9))


@query(
    f"""WITH s AS {fixtures.SCORES_SQL}, q AS (SELECT *, kind = 'private' AND entail >= 0.8 AND entail - greatest(neutral, contra) >= 0.5 AND topic <> 'education' AS veto,
kind = 'public' AND entail >= CASE topic WHEN 'education' THEN 0.55 ELSE 0.8 END AND entail - greatest(neutral, contra) >= CASE topic WHEN 'education' THEN 0.1 ELSE 0.5 END AS pub FROM s),
g AS (SELECT span_id, bool_or(veto) AS veto, min(hyp) FILTER (pub) AS first FROM q GROUP BY 1)
SELECT span_id, CASE WHEN veto OR first IS NULL THEN 'MASK' ELSE 'KEEP' END AS decision, CASE WHEN veto THEN 'private' WHEN first IS NOT NULL THEN 'public:' || first ELSE 'uncertain-protected' END AS reason FROM g"""
)
def sem_decide(spark, d):
    return models.decide(fixtures.relation(spark, d, fixtures.SCORES_SQL, "events"))


# Mutations over labelled texts.
def _gold_docs(spark: SparkSession, d: str) -> DataFrame:
    gold = _labelled(spark, d)[0].groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "stop", "category"))).alias("gold"))
    return fixtures.texts(spark, d).join(gold, "doc_id", "left").withColumn("gold", F.coalesce(F.col("gold"), F.expr(f"cast(array() as {mutate.GOLD})")))


def _flat(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.explode("gold").alias("g")).select("doc_id", "text", "g.start", "g.stop", "g.category")


_LT = f"WITH t AS (SELECT * FROM {TEXTS_SQL}), g AS {_GOLD} SELECT doc_id, {{text}} AS text, {{start}} AS start, {{stop}} AS stop, category FROM g JOIN t USING (doc_id)"
for _name, _text, _start, _stop in (
    ("uppercase", "upper(text)", "start", "stop"), ("lowercase", "lower(text)", "start", "stop"), ("prefix_suffix", f"'{mutate.PREFIX}' || text || '{mutate.SUFFIX}'", f"start + {len(mutate.PREFIX)}", f"stop + {len(mutate.PREFIX)}"),
):
    query(_LT.format(text=_text, start=_start, stop=_stop), f"mut_{_name}")(lambda spark, d, n=_name: _flat(mutate.ALL[n](_gold_docs(spark, d))))
query(
    f"WITH t AS (SELECT * FROM {TEXTS_SQL}), g AS {_GOLD} SELECT doc_id, text || chr(10) || text AS text, (start + k * (length(text) + 1))::INT AS start, (stop + k * (length(text) + 1))::INT AS stop, category FROM g JOIN t USING (doc_id), (VALUES (0), (1)) AS c(k)",
    "mut_repeat_value",
)(lambda spark, d: _flat(mutate.repeat_value(_gold_docs(spark, d))))
query(
    f"WITH t AS (SELECT * FROM {TEXTS_SQL}), g AS {_GOLD}, f AS (SELECT doc_id, min(start) AS pos FROM g GROUP BY 1) SELECT doc_id, substr(text, 1, pos) || chr(10) || '---' || chr(10) || substr(text, pos + 1) AS text, (start + CASE WHEN start > pos THEN 5 ELSE 0 END)::INT AS start, (stop + CASE WHEN stop > pos THEN 5 ELSE 0 END)::INT AS stop, category FROM g JOIN t USING (doc_id) JOIN f USING (doc_id)",
    "mut_chunk_boundary",
)(lambda spark, d: _flat(mutate.chunk_boundary(_gold_docs(spark, d))))
for _name in ("nbsp_spaces", "dash_variants", "bracket_wrap", "reorder_fields", "emoji_combining"):
    query(None, f"mut_{_name}")(lambda spark, d, n=_name: _flat(mutate.ALL[n](_gold_docs(spark, d))))


@query()
def lab_action_a(spark, d):
    """Every mutation of the labelled texts masked and restored: which gold spans stay concealed."""
    docs = mutate.mutate_all(tables.stored(_gold_docs(spark, d), "labelled-texts"))  # each mutation reads them, none joins again
    done = core.restore(core.mask(core.resolve(core.detect(docs, ("email", "card", "inn", "driver_license", "cvv", "pin"))), KEY))
    hidden = F.size(F.filter("gold", lambda g: F.exists("resolved", lambda r: (r["start"] <= g["start"]) & (g["stop"] <= r["stop"]))))
    return done.groupBy("mutation").agg(F.sum(F.size("gold")).alias("n_gold"), F.sum(hidden).alias("n_concealed"), F.count_if(F.col("restored") != F.col("text")).alias("n_broken"))


# More aggregates and the parts around the scorer.
@query(f"""WITH g AS {_GOLD}, f AS {_FOUND}, o AS (SELECT g.doc_id, EXISTS (SELECT 1 FROM f WHERE f.doc_id = g.doc_id AND f.category = g.category AND f.start = g.start AND f.stop = g.stop) AS ok FROM g)
SELECT count(*)::BIGINT AS n_docs, count(*) FILTER (bad)::BIGINT AS n_with_miss FROM (SELECT doc_id, bool_or(NOT ok) AS bad FROM o GROUP BY 1)""")
def agg_req_miss(spark, d):
    o = evaluate.outcome_of_gold(*_labelled(spark, d)).groupBy("doc_id").agg(F.max(F.col("outcome") != "exact").alias("bad"))
    return o.agg(F.count("*").alias("n_docs"), F.count_if("bad").alias("n_with_miss"))


@query(f"""WITH g AS (SELECT DISTINCT category, unnest(range(start, stop)) AS p FROM {_GOLD}), f AS (SELECT DISTINCT category, unnest(range(start, stop)) AS p FROM {_FOUND})
SELECT category, count(g.p)::BIGINT AS n_gold, count(f.p)::BIGINT AS n_found, count(*) FILTER (g.p IS NOT NULL AND f.p IS NOT NULL)::BIGINT AS n_both
FROM (SELECT category, p, true AS x FROM g) g FULL JOIN (SELECT category, p, true AS y FROM f) f USING (category, p) GROUP BY category""")
def agg_char_cat(spark, d):
    """Character sets of a category over all documents at once, by raw offset."""
    return evaluate.by_category_chars(*_labelled(spark, d))


@query(f"""WITH t AS (SELECT * FROM {TEXTS_SQL}), c AS (SELECT DISTINCT s.doc_id, p, k FROM (SELECT doc_id, unnest(range(start, stop)) AS p, 1 AS k FROM {_GOLD} UNION ALL SELECT doc_id, unnest(range(start, stop)), 2 FROM {_FOUND}) s JOIN t USING (doc_id) WHERE regexp_matches(substr(text, p + 1, 1), '[^ ]')),
b AS (SELECT doc_id, p, sum(k) AS k FROM c GROUP BY ALL) SELECT doc_id, count(*) FILTER (k = 1)::BIGINT AS missing, count(*) FILTER (k = 2)::BIGINT AS unexpected, count(*) FILTER (k <> 3) = 0 AS exact FROM b GROUP BY 1""")
def agg_nonspace_chars(spark, d):
    return evaluate.nonspace_chars(fixtures.texts(spark, d), *_labelled(spark, d))


@query(_ISLANDS + " SELECT category, count(*)::BIGINT AS n FROM r GROUP BY 1")
def token_category_count(spark, d):
    """Categories counted from the tokens that stand in the masked texts."""
    masked = core.mask(_resolved(spark, d), KEY)
    names = F.regexp_extract_all("masked_text", F.lit("⟦PII:([A-Z_]+):[A-Za-z0-9_-]+⟧"), F.lit(1))
    return masked.select(F.explode_outer(names).alias("category")).filter("category IS NOT NULL").groupBy("category").agg(F.count("*").alias("n"))


@query("SELECT count(*)::BIGINT AS n, 1.0::DOUBLE AS share_restored FROM documents")
def agg_roundtrip(spark, d):
    out = core.restore(core.mask(_resolved(spark, d), KEY))
    return out.agg(F.count("*").alias("n"), F.avg((F.col("restored") == F.col("text")).cast("double")).alias("share_restored"))


@query(_ISLANDS + " SELECT doc_id, doc_id % 3 = 0 AS accepted FROM (SELECT DISTINCT doc_id FROM r)")
def mask_oracle(spark, d):
    """Whether a masked text is the original with each value replaced by tokens, by a pattern made for each row. Two thirds of the texts are spoiled first: by a
    further character at the end, or by a value that is put back in the place of its token."""
    masked = core.mask(_resolved(spark, d), KEY).filter("size(resolved) > 0")
    put_back = F.replace(F.col("masked_text"), F.get("mapping", F.lit(0))["token"], F.get("mapping", F.lit(0))["value"])
    seen = F.when(F.col("doc_id") % 3 == 0, F.col("masked_text")).when(F.col("doc_id") % 3 == 1, F.concat("masked_text", F.lit("x"))).otherwise(put_back)
    return masked.select("doc_id", evaluate.mask_accepted(F.col("text"), F.col("resolved"), seen).alias("accepted"))


#: Names' words in the forms, and a word behind a comma.
_NAME_WORDS = [(25, 7, 11), (25, 12, 20), (25, 21, 27), (26, 5, 14), (26, 15, 24), (27, 5, 13), (27, 14, 18), (27, 19, 27), (27, 29, 38)]


@query(f"SELECT o_orderkey AS doc_id, a::INT AS start, b::INT AS stop FROM orders JOIN (VALUES (25, 7, 20), (25, 12, 27), (26, 5, 24), (27, 5, 18), (27, 14, 27)) AS v(form, a, b) ON o_orderkey % {len(fixtures.TEXTS)} = form")
def sem_join_names(spark, d):
    spans = fixtures.relation(spark, d, fixtures.of_forms("doc_id", _NAME_WORDS, "doc_id, start, stop"), "orders")
    return models.join_names(spans.join(fixtures.texts(spark, d), "doc_id"))


_SEM = [(1, "Музей имени Ивана Петрова открыт."), (2, "Анкета клиента Ивана Петрова."), (3, "Учебник: теория Ивана Петрова о рефлексах."), (4, "Встретили Ивана Петрова. В газете опубликовано интервью."), (5, "В открытом каталоге указан автор Иван Петров.")]
_SEM_SPANS = [(1, "FULL_NAME", 12, 25), (2, "FULL_NAME", 15, 28), (3, "FULL_NAME", 16, 29), (4, "FULL_NAME", 10, 23), (5, "FULL_NAME", 33, 44)]


def stub_scorer(pairs: DataFrame) -> DataFrame:
    """Public questions are answered with yes, the private one with no."""
    yes = F.col("hypothesis") != semantic.PRIVATE_QUESTION
    return pairs.select("premise", "hypothesis", F.when(yes, 0.9).otherwise(0.1).alias("entail"), F.lit(0.05).alias("neutral"), F.when(yes, 0.05).otherwise(0.85).alias("contra"))


_SEM_ANSWERS = [(1, "KEEP", "institution-dedication"), (2, "MASK", "private-record"), (3, "KEEP", "public:0"), (4, "MASK", "uncertain-protected"), (5, "KEEP", "public-catalog-credit")]


def _sem_sql(rows: list[tuple], names: str) -> str:
    """Five passages in turn, one for each order."""
    return f"(SELECT o_orderkey AS doc_id, {names} FROM orders JOIN {values(rows, 'form, ' + names)} AS v ON o_orderkey % 5 + 1 = form)"


@query(f"SELECT * FROM {_sem_sql(_SEM_ANSWERS, 'decision, reason')}")
def sem_refine(spark, d):
    docs, spans = (fixtures.relation(spark, d, x, "orders") for x in (_sem_sql(_SEM, "text"), _sem_sql(_SEM_SPANS, "category, start, stop")))
    return semantic.refine(docs, spans, stub_scorer).select("doc_id", "decision", "reason")


# Policies: consumers and versions as a dimension.
LONG = detectors.RegexDetector("long_word", "LONG_WORD", "[a-z]{10,}")
OPENING = detectors.RegexDetector("opening", "OPENING", "[A-Z][a-z]{1,4}[.,]")
_KNOWN = ["LONG_WORD", "OPENING"]
_EVENT_TYPES = ("click", "error", "purchase", "view")


def _moment(day: int) -> datetime:
    return datetime(2024, 1, day, tzinfo=timezone.utc)


def event_policies(spark: SparkSession) -> DataFrame:
    """Three versions of every event type's policy from the third, tenth and twentieth of January on, and one update of purchases."""
    made = lambda n: [core.Policy(t, f"{t}-{n}", enabled=(t != "error" or n > 1), detect_types="all_required" if n == 3 else _KNOWN[(i + n) % 2]) for i, t in enumerate(_EVENT_TYPES)]
    dim = policies.dimension(spark, [(_moment(3), "v1", made(1)), (_moment(10), "v2", made(2)), (_moment(20), "v3", made(3))], _KNOWN)
    return policies.update(dim, "purchase", {"namespace": "purchase-4", "default_action": "opaque_token_full"}, _moment(25), "v4", _KNOWN)


_EVENT_DIM = "(VALUES " + ", ".join(
    [f"('{t}', TIMESTAMP '2024-01-{day:02d}', 'v{n}', '{t}-{n}', {t != 'error' or n > 1}, {'NULL' if n == 3 else repr(_KNOWN[(i + n) % 2])}, 'tokenize_full')" for n, day in ((1, 3), (2, 10), (3, 20)) for i, t in enumerate(_EVENT_TYPES)]
    + ["('purchase', TIMESTAMP '2024-01-25', 'v4', 'purchase-4', true, NULL, 'opaque_token_full')"]
) + ") AS d(consumer, valid_from, version, namespace, enabled, only_category, action)"


@query(f"""SELECT event_id, version, namespace, only_category, action, CASE WHEN version IS NULL THEN 'unknown consumer' WHEN NOT enabled THEN 'consumer disabled' END AS error
FROM events ASOF LEFT JOIN {_EVENT_DIM} ON events.event_type = d.consumer AND events.ts >= d.valid_from""")
def join_policy(spark, d):
    """The policy version in force for every event, by its type and time, with its columns."""
    rows = policies.join(table(spark, d, "events").select("event_id", F.col("event_type").alias("consumer"), F.col("ts").cast("timestamp").alias("ts")), event_policies(spark))
    return rows.select("event_id", "policy.version", "policy.namespace", F.get("policy.categories", F.lit(0)).alias("only_category"), "policy.action", policies.error().alias("error"))


@query(f"SELECT consumer, coalesce(version, '-') AS version, count(*)::BIGINT AS n FROM (SELECT event_type AS consumer, version FROM events ASOF LEFT JOIN {_EVENT_DIM} ON events.event_type = d.consumer AND events.ts >= d.valid_from) GROUP BY ALL")
def policy_update(spark, d):
    """How many events each version decides once the update has been appended."""
    rows = policies.join(table(spark, d, "events").select(F.col("event_type").alias("consumer"), F.col("ts").cast("timestamp").alias("ts")), event_policies(spark))
    return rows.groupBy("consumer", F.coalesce("policy.version", F.lit("-")).alias("version")).agg(F.count("*").alias("n"))


def _turns(spark: SparkSession, d: str) -> DataFrame:
    """Turns of conversations with gold: words of twelve small letters or more, and openings that end in a comma."""
    t = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.col("role").alias("consumer"), F.timestamp_seconds("conv_id").alias("ts"), "text")
    gold = lambda pattern, category: F.transform(find(F.col("text"), (pattern,), flags=""), lambda m: F.struct(m["start"].alias("start"), m["stop"].alias("stop"), F.lit(category).alias("category")))
    return t.withColumn("gold", F.concat(gold("[a-z]{12,}", "LONG_WORD"), gold("[A-Z][a-z]{1,4},", "OPENING")))


def turn_policies(spark: SparkSession) -> DataFrame:
    role = lambda name, types, action: core.Policy(name, name, detect_types=types, default_action=action)
    start, later = datetime(1969, 1, 1, tzinfo=timezone.utc), datetime(1970, 1, 1, 0, 0, 50, tzinfo=timezone.utc)
    return policies.dimension(spark, [(start, "active", [role("user", "LONG_WORD", "tokenize_full"), role("assistant", "all_required", "tokenize_full")]), (later, "candidate", [role("user", "all_required", "opaque_token_full"), role("assistant", "OPENING", "opaque_token_full")])], _KNOWN)


_TURNS = "(SELECT conv_id * 1000 + turn AS doc_id, role AS consumer, conv_id, text FROM conversations)"
_TURN_RUNS = f"""long AS ({duck.tiles(_TURNS, ('[a-z]{10,}',), (0,), 'LONG_WORD', 'r', flags='')}), opening AS ({duck.tiles(_TURNS, ('[A-Z][a-z]{1,4}[.,]',), (0,), 'OPENING', 'r', flags='')}),
goldlong AS ({duck.tiles(_TURNS, ('[a-z]{12,}',), (0,), 'LONG_WORD', 'r', flags='')}), goldopening AS ({duck.tiles(_TURNS, ('[A-Z][a-z]{1,4},',), (0,), 'OPENING', 'r', flags='')}),
g AS (SELECT doc_id, start, stop FROM goldlong UNION ALL SELECT doc_id, start, stop FROM goldopening), s AS (SELECT * FROM long UNION ALL SELECT * FROM opening),
p AS (SELECT * FROM (VALUES ('active', 'user', 'LONG_WORD'), ('active', 'assistant', NULL), ('candidate', 'user', NULL), ('candidate', 'assistant', 'OPENING')) AS v(version, consumer, only_category)),
t AS (SELECT doc_id, consumer, version, only_category, conv_id, text FROM {_TURNS} AS x JOIN p USING (consumer)),
w AS (SELECT t.doc_id, version, consumer, s.start, s.stop, s.category, max(s.stop) OVER (PARTITION BY t.doc_id, version ORDER BY s.start, s.stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM t JOIN s ON s.doc_id = t.doc_id AND (only_category IS NULL OR only_category = s.category)),
i AS (SELECT *, sum((reach IS NULL OR start > reach)::INT) OVER (PARTITION BY doc_id, version ORDER BY start, stop) AS seq FROM w),
m AS (SELECT doc_id, version, consumer, seq, min(start) AS start, max(stop) AS stop FROM i GROUP BY ALL),
missed AS (SELECT version, consumer, count(*) AS n FROM t JOIN g USING (doc_id) WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = t.doc_id AND m.version = t.version AND m.start < g.stop AND g.start < m.stop) GROUP BY ALL),
over AS (SELECT version, consumer, count(*) AS n FROM m WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = m.doc_id AND m.start < g.stop AND g.start < m.stop) GROUP BY ALL),
r AS (SELECT version, consumer, count(*)::BIGINT AS n, coalesce(any_value(missed.n), 0)::BIGINT AS missed, coalesce(any_value(over.n), 0)::BIGINT AS overmasked, 0::BIGINT AS round_trip_failures FROM t LEFT JOIN missed USING (version, consumer) LEFT JOIN over USING (version, consumer) GROUP BY version, consumer)"""


def _turn_runs(spark: SparkSession, d: str) -> DataFrame:
    return policies.runs(_turns(spark, d), turn_policies(spark), KEY, (LONG, OPENING))


@query(f"WITH {_TURN_RUNS} SELECT * FROM r")
def agg_policy_run(spark, d):
    """Missed and overmasked spans and failed round trips of every version, by consumer, from one scan."""
    return policies.summary(_turn_runs(spark, d), "consumer")


_DELTA = lambda keys: f"""WITH {_TURN_RUNS}, q AS (SELECT {keys}{', ' if keys else ''}{', '.join(f"sum({m}) FILTER (version = 'candidate')::BIGINT - sum({m}) FILTER (version = 'active')::BIGINT AS delta_{m}" for m in policies.METRICS)} FROM r {'GROUP BY ' + keys if keys else ''})
SELECT *, list_filter([{', '.join(f"CASE WHEN delta_{m} > 0 THEN '{m}' END" for m in policies.METRICS)}], lambda x: x IS NOT NULL) AS regressions, list_filter([{', '.join(f"CASE WHEN delta_{m} < 0 THEN '{m}' END" for m in policies.METRICS)}], lambda x: x IS NOT NULL) AS improvements FROM q"""  # noqa: E731


@query(_DELTA("consumer"))
def lab_action_b(spark, d):
    """The candidate's policies beside the active ones on the same labelled turns, by consumer."""
    return policies.compare(policies.summary(_turn_runs(spark, d), "consumer"), "active", "candidate", "consumer")


@query(_DELTA(""))
def agg_policy_delta(spark, d):
    return policies.compare(policies.summary(_turn_runs(spark, d)), "active", "candidate")


@query(f"""WITH RECURSIVE {_TURN_RUNS}, f AS (SELECT t.doc_id, text, CASE WHEN conv_id < 50 THEN 'active' ELSE 'candidate' END AS version FROM {_TURNS} AS t WHERE consumer IN ('user', 'assistant')),
k AS (SELECT f.doc_id, f.version, text, m.seq, m.start, m.stop, coalesce(lag(m.stop) OVER (PARTITION BY f.doc_id ORDER BY m.seq), 0) AS cursor FROM f JOIN m ON m.doc_id = f.doc_id AND m.version = f.version),
o AS (SELECT doc_id, count(*) AS n, string_agg(substr(text, cursor + 1, start - cursor) || '[REDACTED-' || (seq - 1)::BIGINT || ']', '' ORDER BY seq) || substr(any_value(text), max(stop) + 1) AS masked FROM k GROUP BY doc_id)
SELECT f.doc_id, f.version, coalesce(n, 0)::BIGINT AS n_spans, CASE WHEN f.version = 'candidate' THEN sha256(coalesce(masked, text)) END AS masked_sha256 FROM f LEFT JOIN o USING (doc_id)""")
def policy_mask(spark, d):
    """Turns masked under the version in force at their time; the hash is compared where spans are numbered, as tokens are keyed."""
    out = policies.apply(_turns(spark, d), turn_policies(spark), KEY, (LONG, OPENING)).filter("error IS NULL")
    return out.select("doc_id", "policy.version", F.size("resolved").cast("long").alias("n_spans"), F.when(F.col("policy.version") == "candidate", F.sha2("masked_text", 256)).alias("masked_sha256"))


# The store with leases, expiry and grace: the same requests as a batch fold and as a file stream.
_REQUESTS = """(SELECT 'store' AS namespace, CAST(user_id % 5 AS STRING) AS payload_id, event_id AS seq, ts AS moment,
CASE event_type WHEN 'view' THEN 'process' WHEN 'click' THEN 'claim' WHEN 'purchase' THEN 'commit' ELSE CASE event_id % 3 WHEN 0 THEN 'get' WHEN 1 THEN 'release' ELSE 'delete' END END AS action,
concat('w', CAST(event_id % 2 AS STRING)) AS owner, CASE event_id % 4 WHEN 3 THEN '#v0' ELSE concat('v', CAST(event_id % 2 AS STRING)) END AS text,
concat('#', CASE event_id % 4 WHEN 3 THEN '#v0' ELSE concat('v', CAST(event_id % 2 AS STRING)) END) AS masked_text FROM events)"""
_RECORD = "STRUCT(phase VARCHAR, text VARCHAR, masked VARCHAR, owner VARCHAR, lease BIGINT, gone BIGINT)"
_STORE = f"""WITH RECURSIVE e AS (SELECT *, epoch_ms(moment) AS ms, row_number() OVER (PARTITION BY payload_id ORDER BY moment, seq) AS n FROM {_REQUESTS} AS q),
r AS (SELECT DISTINCT payload_id, 0::BIGINT AS n, NULL::{_RECORD} AS held, NULL::BIGINT AS seq, NULL::VARCHAR AS outcome, NULL::VARCHAR AS result FROM e
UNION ALL SELECT payload_id, n, CASE WHEN outcome IN ('RELEASED', 'DELETED') THEN NULL WHEN outcome = 'COMMITTED' THEN {{'phase': 'READY', 'text': live.text, 'masked': masked_text, 'owner': owner, 'lease': 0, 'gone': ms + {1000 * lifecycle.RETENTION_SECONDS}}}::{_RECORD}
WHEN outcome IN ('CLAIMED', 'RECLAIMED') THEN {{'phase': 'PROCESSING', 'text': text, 'masked': NULL, 'owner': owner, 'lease': ms + {1000 * lifecycle.LEASE_SECONDS}, 'gone': ms + {1000 * lifecycle.RETENTION_SECONDS}}}::{_RECORD}
WHEN outcome = 'MASK' THEN {{'phase': 'READY', 'text': text, 'masked': masked_text, 'owner': owner, 'lease': 0, 'gone': ms + {1000 * lifecycle.RETENTION_SECONDS}}}::{_RECORD}
WHEN outcome = 'RESTORE' THEN {{'phase': 'RESTORED', 'text': live.text, 'masked': live.masked, 'owner': live.owner, 'lease': live.lease, 'gone': ms + {1000 * lifecycle.GRACE_SECONDS}}}::{_RECORD} ELSE live END, seq, outcome,
CASE outcome WHEN 'COMMITTED' THEN masked_text WHEN 'MASK' THEN masked_text WHEN 'FOUND' THEN live.masked WHEN 'MASK_REPLAY' THEN live.masked WHEN 'RESTORE' THEN live.text END
FROM (SELECT *, CASE action WHEN 'commit' THEN CASE WHEN mine THEN 'COMMITTED' ELSE 'LOST' END WHEN 'release' THEN CASE WHEN mine THEN 'RELEASED' ELSE 'LOST' END WHEN 'delete' THEN CASE WHEN live IS NULL THEN 'MISSING' ELSE 'DELETED' END
WHEN 'get' THEN CASE WHEN live IS NOT NULL AND live.phase <> 'PROCESSING' THEN 'FOUND' ELSE 'MISSING' END ELSE CASE WHEN live IS NULL THEN CASE action WHEN 'claim' THEN 'CLAIMED' ELSE 'MASK' END
WHEN live.phase = 'PROCESSING' THEN CASE WHEN text <> live.text THEN 'CONFLICT' WHEN live.lease > ms THEN 'WAIT' ELSE 'RECLAIMED' END WHEN action = 'process' AND text = live.masked THEN 'RESTORE' WHEN text = live.text OR text = live.masked THEN 'MASK_REPLAY' ELSE 'CONFLICT' END END AS outcome
FROM (SELECT *, coalesce(live.phase = 'PROCESSING' AND live.owner = owner, false) AS mine FROM (SELECT e.*, CASE WHEN r.held.gone > e.ms THEN r.held END AS live FROM r JOIN e ON e.payload_id = r.payload_id AND e.n = r.n + 1))))
SELECT payload_id, seq, outcome, result FROM r WHERE n > 0"""


def _store_requests(events: DataFrame) -> DataFrame:
    return events.sparkSession.sql(f"SELECT * FROM {_REQUESTS.replace('FROM events', 'FROM {events}')} AS q", events=events).withColumn("at", F.col("moment").cast("timestamp")).drop("moment")


@query(_STORE)
def vault_store(spark, d):
    return lifecycle.store(_store_requests(table(spark, d, "events"))).select("payload_id", "seq", "outcome", "result")


@query(_STORE)
def vault_stream(spark, d):
    """The same requests replayed as a file stream in the order of their times, with state, timers and a watermark."""
    from spanforge.streaming import vault

    stream = vault.replayed(_store_requests(table(spark, d, "events")), tables.shared_dir(spark))
    return vault.run_available(vault.process_stream(stream), tables.shared_dir(spark)).select("payload_id", "seq", "outcome", "result")


# Token windows, candidates and the rewrite of detections.
LABELS = ("O", "B-PER", "I-PER", "B-LOC")


def stub_classifier():
    """A stated scorer: a token's label follows from its id alone, its certainty from the id's last digit."""
    import numpy as np

    def score(ids, mask):
        out = np.zeros((*ids.shape, len(LABELS)))
        np.put_along_axis(out, (ids % 7 // 2)[..., None] % len(LABELS), (1 + ids % 10)[..., None].astype(float), axis=2)
        return out

    return score


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """The place of a public tokenizer's file; callers of operators.ner pass any other."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query()
def ner_windows(spark, d):
    """Windows over the tokenizer's own tokens, with the characters that each covers."""
    w = ner.token_windows(table(spark, d, "documents"), tokenizer_path())
    return w.select("doc_id", "window", "first", "last", "n_tokens", F.element_at("starts", 1).alias("start"), F.element_at("stops", -1).alias("stop"))


def _recognized(spark: SparkSession, d: str) -> DataFrame:
    return ner.recognize(table(spark, d, "documents"), tokenizer_path(), stub_classifier, LABELS)


@query()
def ner_entities(spark, d):
    # outer: of an inner explode Spark infers a filter that looks through the array first
    return _recognized(spark, d).select("doc_id", F.explode_outer("entities").alias("e")).filter("e IS NOT NULL").select("doc_id", "e.*")


@query()
def sem_ner_candidates(spark, d):
    """Entities that are new names beside what all detectors find, the one for full names too."""
    found = core.detect(_recognized(spark, d), (*detectors.NATIVE, *names.ARROW))
    found = found.select("doc_id", F.explode_outer(let(_sensitive(), lambda s: ner.new_names(F.col("text"), F.col("entities"), s))).alias("e"))
    return found.filter("e IS NOT NULL").select("doc_id", "e.*")


@query(f"WITH s AS (SELECT doc_id, category, start, stop FROM ({_spans_sql('documents', EMAIL_SCAN, 'EMAIL', 'r')}) UNION ALL SELECT doc_id, category, start, stop FROM ({_spans_sql('documents', PHONE_SCAN, 'PHONE', 'r')}) UNION ALL SELECT doc_id, category, start, stop FROM ({_spans_sql('documents', CARD_SCAN, 'CARD', 'card-digits', True)})) "
       "SELECT doc_id, category, start, stop, CASE WHEN category = 'CARD' OR start % 2 = 1 THEN 'MASK' ELSE 'KEEP' END AS decision, CASE WHEN category = 'CARD' THEN 'card-digits' WHEN start % 2 = 1 THEN 'semantic-private-record' ELSE 'semantic-public-context' END AS rule_id FROM s")
def sem_rewrite(spark, d):
    """Detections of e-mail addresses, phones and cards, of which the ones at even places are released; cards aren't eligible."""
    found = core.detect(table(spark, d, "documents").select("doc_id", "text"), ("email", "phone", "card"))
    decisions = F.flatten(F.transform("detections", lambda x: F.transform(x["sensitive"], lambda s: F.struct(x["category"].alias("category"), s["start"].alias("start"), s["stop"].alias("stop"), F.when(s["start"] % 2 == 0, "public-context").otherwise("private-record").alias("reason"), F.lit(0.9).alias("score")))))
    out = found.withColumn("decisions", decisions).withColumn("detections", ner.rewrite(F.col("detections"), F.col("decisions"))).select("doc_id", F.explode("detections").alias("x"))
    return out.select("doc_id", "x.category", "x.start", "x.stop", F.when(F.size("x.sensitive") > 0, "MASK").otherwise("KEEP").alias("decision"), "x.rule_id")


@query("SELECT octet_length(encode(coalesce(text, ''))) > 4096 AS rejected, count(*)::BIGINT AS n, sum(octet_length(encode(coalesce(text, ''))))::BIGINT AS bytes FROM documents GROUP BY 1")
def body_limit(spark, d):
    """Accepted and rejected documents, written and counted in one scan, and read back."""
    path = f"{tables.shared_dir(spark)}/spanforge/requests-{uuid.uuid4().hex}"
    counts = sinks.split_by_size(table(spark, d, "documents"), 4096, path)
    back = spark.read.parquet(path).withColumn("rejected", F.col("rejected").cast("boolean"))
    out = back.groupBy("rejected").agg(F.count("*").alias("n"), F.sum(F.octet_length(F.coalesce("text", F.lit("")))).cast("long").alias("bytes"))
    return out.filter((F.col("n") == F.when(F.col("rejected"), counts["rejected"]).otherwise(counts["accepted"])) | F.raise_error(F.lit("counts differ from what was written")).cast("boolean"))


@query("SELECT event_type AS namespace, user_id AS key, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL")
def snk_vault(spark, d):
    """The last write of every key, put by batches of a file stream of which one is delivered twice."""
    rows = table(spark, d, "events").select(F.col("event_type").alias("namespace"), F.col("user_id").alias("key"), "ts", "event_id", "value")
    path = f"{tables.shared_dir(spark)}/spanforge/vault-{uuid.uuid4().hex}"
    middle = rows.agg(F.percentile_approx("ts", 0.5)).first()[0]
    put = sinks.upsert(path, ["namespace", "key"], ["ts", "event_id"])
    for batch_id, part in ((0, F.col("ts") <= F.lit(middle)), (1, F.col("ts") > F.lit(middle)), (0, F.col("ts") <= F.lit(middle))):
        put(rows.filter(part), batch_id)
    return sinks.current(spark, path, ["namespace", "key"]).select("namespace", "key", "event_id", "value")

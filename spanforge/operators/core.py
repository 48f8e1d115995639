"""Detect, gate, resolve, mask and restore: everything stays in the document's row, so none of it shuffles."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanforge.functions.scalars import hmac_sha256
from spanforge.functions.spans import BLOCK, blocks_of, cuts_of, let, running

from .detectors import NATIVE, NONE, REGISTERED, RegexDetector, TableDetector

TOKEN = r"⟦PII:[A-Z_]+:[A-Za-z0-9_-]+⟧"
MARKER = r"\[REDACTED-\d+\]"
RESOLVED = "array<struct<start:int,stop:int,category:string,detector_ids:array<string>>>"


@dataclass(frozen=True)
class CombinationRule:
    """target is left unmasked unless a detection of requires lies in the same line."""

    rule_id: str
    target: str
    requires: str
    action_if_absent: str = "keep"


@dataclass(frozen=True)
class Policy:
    name: str
    namespace: str
    enabled: bool = True
    authentication: str = "api_key"
    detect_types: str = "all_required"
    default_action: str = "tokenize_full"
    allow_unmask: bool = False
    allow_llm_egress: bool = False
    combination_rules: tuple[CombinationRule, ...] = field(default_factory=tuple)

    def categories(self, known: Sequence[str]) -> list[str] | None:
        """None for all; an unknown name is an error. Registered categories, configured ones too, are known."""
        if self.detect_types.strip().lower() == "all_required":
            return None
        names = [x.strip().upper() for x in self.detect_types.split(",") if x.strip()]
        if unknown := [x for x in names if x not in known]:
            raise ValueError(f"unknown categories: {unknown}")
        return names


def detect(docs: DataFrame, detectors: Sequence[str | RegexDetector | TableDetector] = tuple(NATIVE), text: str = "text", out: str = "detections") -> DataFrame:
    """docs with the detections of the given detectors, in their order: native and registered ones and the Arrow detectors of operators.names by name."""
    from . import names

    parts: list[Column] = []
    columns = docs.columns
    for i, d in enumerate(detectors):
        d = REGISTERED.get(d, d) if isinstance(d, str) else d
        if isinstance(d, TableDetector):
            docs = d.joined(docs, text, f"__table_{i}")
            parts.append(F.col(f"__table_{i}"))
        elif isinstance(d, RegexDetector):
            parts.append(d(F.col(text)))
        elif d in NATIVE:
            parts.append(NATIVE[d](F.col(text)))
        elif d in names.ARROW:
            parts.append(names.arrow(d, F.col(text)))
        else:
            raise ValueError(f"unknown detector: {d}")
    found = F.concat(*parts) if parts else F.expr(NONE)
    return docs.select(*[c for c in columns if c != out], F.when(F.col(text).isNull(), F.expr(NONE)).otherwise(found).alias(out))


def keep_categories(docs: DataFrame, categories: Sequence[str] | None) -> DataFrame:
    return docs if categories is None else docs.withColumn("detections", F.filter("detections", lambda d: d["category"].isin(*categories)))


def line_of(text: Column, position: Column) -> Column:
    """Newlines before a position."""
    before = F.substring(text, F.lit(1), position)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))


def lines_of(text: Column, positions: Column) -> Column:
    """Newlines before each position (array<int>), from an index of the newlines before every block of the text, which is built once."""
    count = lambda s: F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))

    def line(blocks: Column, upto: Column, p: Column) -> Column:
        k = F.floor(p / BLOCK).cast("int")
        inside = count(F.substring(F.coalesce(F.get(blocks, k), F.lit("")), F.lit(1), p - k * BLOCK))
        return F.when(k > 0, F.get(upto, k - 1)).otherwise(0) + inside

    indexed = lambda blocks: let(running(F.transform(blocks, count), lambda a, b: a + b), lambda upto: F.transform(positions, lambda p: line(blocks, upto, p)))
    return F.when(F.size(positions) == 0, F.expr("cast(array() as array<int>)")).otherwise(let(blocks_of(text), indexed))


def unprotected(detections: Column, lines: Column, target: Column, requires: Column) -> Column:
    """For each detection whether it is a target with no required category in its line: sorted by line, a line's required ones first, a
    running maximum says which line had one last."""
    entry = lambda d, i: F.struct(F.get(lines, i).alias("line"), F.when(d["category"] == requires, 0).otherwise(1).alias("after"), i.alias("i"), (d["category"] == target).alias("target"))

    def flags(ordered: Column) -> Column:
        seen = running(F.transform(ordered, lambda e: F.when(e["after"] == 0, e["line"] + 1).otherwise(0)), F.greatest)
        back = let(seen, lambda last: F.sort_array(F.transform(ordered, lambda e, k: F.struct(e["i"].alias("i"), (e["target"] & (F.get(last, k) != e["line"] + 1)).alias("alone")))))
        return F.transform(back, lambda x: x["alone"])

    return let(F.sort_array(F.transform(detections, entry)), flags)


_UNMASKED = "cast(array() as array<struct<start:int,stop:int>>)"


def combine(docs: DataFrame, rules: Sequence[CombinationRule]) -> DataFrame:
    """Rules in turn: a target with no required detection in its line loses its spans and takes the rule's id (an anti join within the row)."""
    acting = [r for r in rules if r.action_if_absent == "keep"]
    if not acting:
        return docs
    text = F.col("text")

    def ruled(x: Column) -> Column:
        out = x["d"]
        for rule in acting:
            alone = unprotected(x["d"], x["lines"], F.lit(rule.target), F.lit(rule.requires))
            out = F.zip_with(out, alone, lambda d, a: F.when(a, d.withField("sensitive", F.expr(_UNMASKED)).withField("rule_id", F.lit(rule.rule_id))).otherwise(d))  # noqa: B023
        return out

    with_lines = let(F.col("detections"), lambda d: F.struct(d.alias("d"), lines_of(text, F.transform(d, lambda x: x["start"])).alias("lines")))
    return docs.withColumn("detections", let(with_lines, ruled))


def _merged(ordered: Column) -> Column:
    """Spans in order to islands: a span that starts at or before the last end joins, so touching ones merge too; the first gives the category."""

    def islands(spans: Column, upto: Column) -> Column:
        n = F.size(spans)
        places = F.when(n == 0, F.expr("cast(array() as array<int>)")).otherwise(F.sequence(F.lit(0), n - 1))
        firsts = F.filter(places, lambda i: (i == 0) | (F.get(spans, i)["start"] > F.get(upto, i - 1)))

        def island(first: Column, behind: Column) -> Column:
            ids = F.array_distinct(F.transform(F.slice(spans, first + 1, behind - first), lambda s: s["detector_id"]))
            return F.struct(F.get(spans, first)["start"].alias("start"), F.get(upto, behind - 1).alias("stop"), F.get(spans, first)["category"].alias("category"), ids.alias("detector_ids"))

        return let(firsts, lambda f: F.zip_with(f, F.concat(F.slice(f, F.lit(2), F.greatest(F.size(f) - 1, F.lit(0))), F.array(n)), lambda a, b: F.when(a.isNotNull(), island(a, b))))

    found = let(ordered, lambda spans: let(running(F.transform(spans, lambda s: s["stop"]), F.greatest), lambda upto: islands(spans, upto)))
    return F.filter(found, lambda s: s.isNotNull()).cast(RESOLVED)


def resolve(docs: DataFrame) -> DataFrame:
    """docs with resolved spans: sorted by start, the longer first, ties in detection order, and merged. An invalid span is an error."""

    def islands(detections: Column) -> Column:
        flat = F.flatten(F.transform(detections, lambda d, i: F.transform(d["sensitive"], lambda s, k: F.struct(s["start"].alias("start"), (s["start"] - s["stop"]).alias("shorter"), i.alias("i"), k.alias("k"), s["stop"].alias("stop"), d["category"].alias("category"), d["detector_id"].alias("detector_id")))))
        bad = lambda spans: let(F.length("text"), lambda n: F.exists(spans, lambda s: (s["start"] < 0) | (s["stop"] <= s["start"]) | (s["stop"] > n)))
        return let(flat, lambda spans: F.when(bad(spans), F.raise_error(F.lit("invalid span")).cast(RESOLVED)).otherwise(_merged(F.sort_array(spans))))

    # a column used once: a filter pushed below the projections would otherwise copy the detectors' expressions once for each use
    none = F.expr(f"cast(array() as {RESOLVED})")
    return docs.withColumn("resolved", let(F.col("detections"), lambda d: F.when(F.size(d) == 0, none).otherwise(islands(d))))


def spans(docs: DataFrame) -> DataFrame:
    """A row for each sensitive span: doc_id, text, ord (its place in detection order), category, detector_id, rule_id, score, start, stop."""
    # outer: of an inner explode Spark infers a filter on the array, which it pushes below the projections that make array and text. There the
    # detectors are worked out a second and third time, with the text's own expression copied into every place that uses it
    d = docs.select("doc_id", "text", F.posexplode_outer("detections").alias("i", "d")).filter("d IS NOT NULL")
    s = d.select("doc_id", "text", "i", "d", F.posexplode("d.sensitive").alias("k", "s"))
    return s.select("doc_id", "text", "i", "k", "d.category", "d.detector_id", "d.rule_id", "d.score", "s.start", "s.stop")


def resolve_rows(rows: DataFrame) -> DataFrame:
    """The same islands over span rows (doc_id, ord, category, start, stop): running maximum of ends, one shuffle by document."""
    w = W.partitionBy("doc_id").orderBy("start", (F.col("start") - F.col("stop")), "ord")
    ends = F.max("stop").over(w.rowsBetween(W.unboundedPreceding, -1))
    opened = rows.withColumn("new", (ends.isNull() | (F.col("start") > ends)).cast("int")).withColumn("rank", F.row_number().over(w))
    island = opened.withColumn("seq", F.sum("new").over(w))
    return island.groupBy("doc_id", "seq").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min_by("category", "rank").alias("category"), F.count("*").alias("n_spans"))


def token(key: bytes, namespace: Column, context: Column, category: Column, value: Column) -> Column:
    """⟦PII:CATEGORY:22 url-safe characters⟧, the first 128 bits of a keyed digest: equal values share a token, retries give the same one."""
    digest = hmac_sha256(key, F.concat_ws("\u0000", namespace, context, category, value))
    text = F.rtrim(F.translate(F.base64(F.unhex(F.substring(digest, 1, 32))), "+/=", "-_ "))
    return F.concat(F.lit("⟦PII:"), category, F.lit(":"), text, F.lit("⟧"))


def mask(docs: DataFrame, key: bytes, namespace: str | Column = "default", context: str = "doc_id", action: str | Column = "tokenize_full") -> DataFrame:
    """docs with masked_text and mapping (array<struct<token, value>>, in order). action opaque_token_full numbers the spans instead.

    namespace and action may be Columns, so that every row follows its own policy. A text without spans is its own masked text."""
    text = F.col("text")
    space = F.lit(namespace) if isinstance(namespace, str) else namespace
    opaque = F.lower(F.trim(F.lit(action) if isinstance(action, str) else action)) == "opaque_token_full"

    def numbers(resolved: Column) -> Column:
        # numbers count up from the span's place, past any that the text holds or an earlier span took
        name = lambda n: F.concat(F.lit("[REDACTED-"), n.cast("string"), F.lit("]"))
        taken = F.regexp_extract_all(text, F.lit(MARKER), F.lit(0))
        free = let(taken, lambda t: F.array_except(F.transform(F.sequence(F.lit(0), F.size(resolved) + F.size(t)), name), t))
        return let(free, lambda f: F.transform(resolved, lambda r, i: F.get(f, i)))

    def named(planted: Column, category: Column, value: Column) -> Column:
        made = lambda salt: token(key, space, F.concat(F.col(context).cast("string"), F.lit(salt)), category, value)
        free = [let(made(salt), lambda t: F.when(~planted | ~F.contains(text, t), t)) for salt in ("", "/1", "/2")]
        # three digests of 128 bits in one text are no chance: somebody has planted them
        return F.coalesce(*free, F.raise_error(F.lit("the text holds all tokens of a value")).cast("string"))

    def cut(r: Column) -> Column:
        """The spans, and of the text their values and what lies between, all cut in one go."""
        starts, stops = F.concat(F.array(F.lit(0)), F.transform(r, lambda s: s["stop"])), F.concat(F.transform(r, lambda s: s["start"]), F.array(F.length(text)))
        pair = lambda a, b: F.struct(a.alias("start"), b.alias("stop"))
        pieces = cuts_of(text, F.concat(F.transform(r, lambda s: pair(s["start"], s["stop"])), F.zip_with(starts, stops, pair)))
        return let(pieces, lambda p: F.struct(r.alias("r"), F.slice(p, F.lit(1), F.size(r)).alias("v"), F.slice(p, F.size(r) + 1, F.size(r) + 1).alias("gaps"), F.contains(text, F.lit("⟦PII:")).alias("planted")))

    def replaced(x: Column) -> Column:
        tokens = F.when(opaque, numbers(x["r"])).otherwise(F.zip_with(x["v"], x["r"], lambda v, r: named(x["planted"], r["category"], v)))
        return F.struct(F.zip_with(tokens, x["v"], lambda t, v: F.struct(t.alias("token"), v.alias("value"))).alias("mapping"), x["gaps"].alias("gaps"))

    def masked(y: Column) -> Column:
        whole = F.array_join(F.zip_with(y["gaps"], F.transform(y["mapping"], lambda m: m["token"]), lambda g, t: F.concat(g, F.coalesce(t, F.lit("")))), "")
        return F.struct(y["mapping"].alias("mapping"), F.when(text.isNotNull(), whole).alias("masked_text"))

    as_it_is = F.struct(F.expr("cast(array() as array<struct<token:string,value:string>>)").alias("mapping"), text.alias("masked_text"))
    made = let(F.col("resolved"), lambda r: F.when(F.size(r) > 0, let(let(cut(r), replaced), masked)).otherwise(as_it_is))
    rest = [c for c in docs.columns if c not in ("mapping", "masked_text")]
    return docs.withColumn("__masked", made).select(*rest, F.col("__masked.mapping").alias("mapping"), F.col("__masked.masked_text").alias("masked_text"))


def known_values(tokens: Column, mapping: Column) -> Column:
    """The value of each token, null if mapping has none: tokens and mapping sorted together, so that each token finds its entry before it."""
    place = lambda t, kind, i: F.struct(t.alias("token"), F.lit(kind).alias("kind"), i.alias("i"))
    both = F.concat(F.transform(mapping, lambda m, i: place(m["token"], 0, i)), F.transform(tokens, lambda t, i: place(t, 1, i)))

    def looked_up(ordered: Column) -> Column:
        last = running(F.transform(ordered, lambda e, k: F.when(e["kind"] == 0, k + 1).otherwise(0)), F.greatest)

        def entry(e: Column, k: Column) -> Column:
            own = F.when((k > 0) & (F.get(ordered, k - 1)["token"] == e["token"]), F.get(ordered, k - 1)["i"])
            return F.struct(e["i"].alias("i"), F.get(mapping, own)["value"].alias("value"))

        found = let(last, lambda at: F.filter(F.transform(ordered, lambda e, k: F.when(e["kind"] == 1, entry(e, F.get(at, k)))), lambda x: x.isNotNull()))
        return F.transform(F.sort_array(found), lambda x: x["value"])

    return let(F.sort_array(both), looked_up)


def restore(docs: DataFrame, source: str = "masked_text", out: str = "restored") -> DataFrame:
    """docs with every known token of mapping replaced by its value, in one pass from the left; unknown tokens stay."""
    either = f"(?:{TOKEN}|{MARKER})"

    def whole(x: Column) -> Column:
        values = let(F.regexp_extract_all(x["t"], F.lit(either), F.lit(0)), lambda tokens: F.zip_with(known_values(tokens, x["m"]), tokens, lambda v, t: F.coalesce(v, t)))
        joined = F.array_join(F.zip_with(F.split(x["t"], either), values, lambda g, v: F.concat(g, F.coalesce(v, F.lit("")))), "")
        return F.when(F.size(x["m"]) == 0, x["t"]).otherwise(joined)

    return docs.withColumn(out, let(F.struct(F.col("mapping").alias("m"), F.col(source).alias("t")), whole))


def guard_output(docs: DataFrame, key: bytes, detectors: Sequence[str | RegexDetector] = tuple(NATIVE), text: str = "text") -> DataFrame:
    """docs (doc_id, text, mapping) with guarded: sensitive values that an answer brought in masked for good, tokens of mapping left as they are.

    Known tokens are blanked out at equal length, so that nothing in them is detected and every offset stays; the new tokens' mapping is dropped."""
    found = F.regexp_extract_all(F.col(text), F.lit(TOKEN), F.lit(0))
    known = F.transform("mapping", lambda m: m["token"])
    blank = lambda t: F.when(F.array_contains(known, t), F.repeat(F.lit("\ue000"), F.length(t))).otherwise(t)
    hidden = F.array_join(F.zip_with(F.split(F.col(text), TOKEN), F.transform(found, blank), lambda g, t: F.concat(g, F.coalesce(t, F.lit("")))), "")
    seen = resolve(detect(docs.withColumn("__hidden", hidden), detectors, text="__hidden").withColumn("text", F.col(text)))
    return mask(seen, key).select(*docs.columns, F.col("masked_text").alias("guarded"))


def category_counts(docs: DataFrame) -> DataFrame:
    """doc_id, category and n of the resolved spans."""
    return docs.select("doc_id", F.explode_outer("resolved").alias("r")).filter("r IS NOT NULL").groupBy("doc_id", F.col("r.category").alias("category")).agg(F.count("*").alias("n"))


def apply_policy(docs: DataFrame, policy: Policy, key: bytes, detectors: Sequence[str | RegexDetector] = tuple(NATIVE)) -> DataFrame:
    """Detect to mask under one consumer's policy; a disabled policy is an error."""
    if not policy.enabled:
        raise ValueError(f"consumer disabled: {policy.name}")
    known = [d.category if isinstance(d, RegexDetector) else d.upper() for d in detectors]
    found = keep_categories(detect(docs, detectors), policy.categories(known))
    return mask(resolve(combine(found, policy.combination_rules)), key, policy.namespace, action=policy.default_action)


def egress_reasons(docs: DataFrame, policy: Policy, provider: str, stages: Sequence[str], forbidden: Sequence[str] = (), detectors: Sequence[str] = tuple(NATIVE)) -> DataFrame:
    """docs with reasons against sending masked_text out (none: it may go). Residual detections and leaked values are looked for in it again."""
    again = resolve(detect(docs.select("doc_id", F.col("masked_text").alias("text"), "mapping", F.col("text").alias("original")), detectors))
    fixed = [F.lit(m) for ok, m in ((policy.enabled, "consumer disabled"), (policy.allow_llm_egress, "llm egress not allowed by policy"), (provider == "stub", f"provider not allowed: {provider}")) if not ok]
    fixed += [F.lit(f"stage not completed: {s}") for s in ("detect", "resolve", "mask") if s not in stages]
    residual = F.when(F.size("resolved") > 0, F.concat(F.lit("residual sensitive spans detected in outbound text: "), F.size("resolved").cast("string")))
    leaked = F.when(F.exists("mapping", lambda m: (F.length(m["value"]) > 0) & F.contains(F.col("text"), m["value"])), F.lit("original sensitive value present in outbound text"))
    marked = [F.when(F.contains(F.col("text"), F.lit(x)), F.lit("forbidden secret marker in outbound text")) for x in forbidden]
    return again.select("doc_id", F.col("text").alias("masked_text"), F.array_compact(F.array(*fixed, residual, leaked, *marked)).alias("reasons"))

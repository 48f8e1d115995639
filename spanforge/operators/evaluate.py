"""Labelled quality and operational metrics as grouped aggregates."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanforge.functions.spans import cuts_of, let
from spanforge.functions.tables import stored

from .joins import exact, overlapping


def ratio(a: Column, b: Column) -> Column:
    """a / b, null for an empty denominator."""
    return a / F.nullif(b, F.lit(0))


def by_category(gold: DataFrame, found: DataFrame) -> DataFrame:
    """category, n_gold, n_found, n_exact, precision, recall, f1 (harmonic), f1_counts (2 tp / (gold + found))."""
    g = gold.groupBy("category").agg(F.count("*").alias("n_gold"))
    p = found.groupBy("category").agg(F.count("*").alias("n_found"))
    t = exact(gold, found.dropDuplicates(["doc_id", "category", "start", "stop"]), "left_semi").groupBy("category").agg(F.count("*").alias("n_exact"))
    n = g.join(p, "category", "full").join(t, "category", "left").fillna(0, ["n_gold", "n_found", "n_exact"])
    n = n.withColumn("precision", ratio(F.col("n_exact"), F.col("n_found"))).withColumn("recall", ratio(F.col("n_exact"), F.col("n_gold")))
    return n.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).withColumn("f1_counts", ratio(2 * F.col("n_exact"), F.col("n_gold") + F.col("n_found")))


def macro(per_category: DataFrame) -> DataFrame:
    return per_category.agg(*[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])


def covered_length(spans: DataFrame) -> DataFrame:
    """doc_id and chars: characters under a union of spans, by interval arithmetic instead of a row for each character."""
    w = W.partitionBy("doc_id").orderBy("start", "stop")
    reach = F.max("stop").over(w.rowsBetween(W.unboundedPreceding, -1))
    new = F.greatest(F.col("stop") - F.greatest(F.col("start"), F.coalesce(reach, F.lit(0))), F.lit(0))
    return spans.withColumn("__n", new).groupBy("doc_id").agg(F.sum("__n").cast("long").alias("chars"))


def by_document_chars(docs: DataFrame, gold: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, char_recall, char_precision, char_overmask; |both| = |gold| + |found| - |either|."""
    g, p = (covered_length(x.select("doc_id", "start", "stop")).withColumnRenamed("chars", n) for x, n in ((gold, "g"), (found, "p")))
    either = covered_length(gold.select("doc_id", "start", "stop").unionByName(found.select("doc_id", "start", "stop"))).withColumnRenamed("chars", "u")
    n = docs.select("doc_id", F.length("text").alias("n")).join(g, "doc_id", "left").join(p, "doc_id", "left").join(either, "doc_id", "left").fillna(0)
    both = F.col("g") + F.col("p") - F.col("u")
    return n.select("doc_id", ratio(both, F.col("g")).alias("char_recall"), ratio(both, F.col("p")).alias("char_precision"), ratio(F.col("p") - both, F.col("n") - F.col("g")).alias("char_overmask"))


def _segments(gold: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, at, until, g and f: the stretches between ends of spans, and how many spans of either side lie over each; a row for each end, none for a character."""
    ends = lambda df, side: df.select(*keys, F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("stop").alias("at"), F.lit(-1).alias("d")))).alias("e")).select(*keys, "e.at", *[(F.col("e.d") if s == side else F.lit(0)).alias(s) for s in ("g", "f")])
    steps = ends(gold, "g").unionByName(ends(found, "f")).groupBy(*keys, "at").agg(F.sum("g").alias("g"), F.sum("f").alias("f"))
    w = W.partitionBy(*keys).orderBy("at")
    return steps.select(*keys, "at", F.lead("at").over(w).alias("until"), *[F.sum(s).over(w.rowsBetween(W.unboundedPreceding, 0)).alias(s) for s in ("g", "f")]).filter("until IS NOT NULL AND (g > 0 OR f > 0)")


def by_category_chars(gold: DataFrame, found: DataFrame) -> DataFrame:
    """category, n_gold, n_found, n_both of character offsets, documents thrown together."""
    n = F.col("until") - F.col("at")
    of = lambda test: F.coalesce(F.sum(F.when(test, n)), F.lit(0)).cast("long")
    g, f = F.col("g") > 0, F.col("f") > 0
    return _segments(gold, found, ["category"]).groupBy("category").agg(of(g).alias("n_gold"), of(f).alias("n_found"), of(g & f).alias("n_both"))


def nonspace_chars(docs: DataFrame, gold: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, missing, unexpected, exact over characters that aren't white space: stretches on one side only, less the white space in them.

    A document's stretches are gathered as an array beside its text and cut out of it in one go. Documents of which only white space is covered are left out."""
    per = _segments(gold, found, ["doc_id"]).groupBy("doc_id").agg(F.collect_list(F.struct(F.col("at").alias("start"), F.col("until").alias("stop"), (F.col("g") > 0).alias("g"), (F.col("f") > 0).alias("f"))).alias("s"))
    visible = lambda piece: F.length(F.regexp_replace(piece, r"(?U)\s", ""))
    sized = per.join(docs.select("doc_id", "text"), "doc_id").withColumn("c", let(cuts_of(F.col("text"), F.col("s")), lambda cut: F.zip_with(F.col("s"), cut, lambda s, x: F.struct(s["g"].alias("g"), s["f"].alias("f"), visible(x).alias("n")))))
    total = lambda test: F.aggregate(F.filter("c", test), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    out = sized.select("doc_id", total(lambda x: x["g"] & ~x["f"]).alias("missing"), total(lambda x: x["f"] & ~x["g"]).alias("unexpected"), total(lambda x: F.lit(True)).alias("all"))
    return out.filter("all > 0").select("doc_id", "missing", "unexpected", ((F.col("missing") == 0) & (F.col("unexpected") == 0)).alias("exact"))


_TOKEN = r"⟦PII:[A-Z_]+:[A-Za-z0-9_-]+⟧"
_FIRST, _NEXT = re.compile(_TOKEN), re.compile(rf"[ \t\n\x0b\f\r]*{_TOKEN}")


def _ends(text: str, at: int) -> bool:
    """Whether text ends at a place, give or take one line end."""
    return text[at:] in ("", "\n", "\r\n", "\r", "\x85", "\u2028", "\u2029") and not text[max(at - 1, 0) :] == "\r\n"


def accepted(text: str, spans: Sequence[tuple[int, int]], masked: str) -> bool:
    """mask_accepted() of one text, without backtracking: the places that can be reached behind each piece, piece by piece.

    Neighbouring tokens can be dealt to the spans in exponentially many ways. But where a piece without a token's bracket is reached, and a token behind it,
    further tokens of that row of tokens reach nothing that the next span's tokens don't, so the first such place stands for all."""
    edges = [0, *(x for s in spans for x in s), len(text)]
    gaps = [text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]
    if not masked.startswith(gaps[0]):
        return False
    if not spans:
        return _ends(masked, len(gaps[0]))
    seen = {len(gaps[0])}
    for gap in gaps[1:-1]:
        reached, tried = set(), set()
        for p in seen:
            m = _FIRST.match(masked, p)
            while m and (q := m.end()) not in tried:
                tried.add(q)
                if masked.startswith(gap, q) and _FIRST.match(masked, q + len(gap)):
                    reached.add(q + len(gap))
                    if "⟦" not in gap:
                        break
                m = _NEXT.match(masked, q)
        seen = reached
    tried = set()
    for p in seen:
        m = _FIRST.match(masked, p)
        while m and (q := m.end()) not in tried:
            tried.add(q)
            if masked.startswith(gaps[-1], q) and _ends(masked, q + len(gaps[-1])):
                return True
            m = _NEXT.match(masked, q)
    return False


@F.pandas_udf(T.BooleanType())
def _accepted(text: pd.Series, starts: pd.Series, stops: pd.Series, masked: pd.Series) -> pd.Series:
    return pd.Series([None if t is None or a is None or m is None else accepted(t, list(zip(a, b, strict=True)), m) for t, a, b, m in zip(text, starts, stops, masked, strict=True)], dtype=object)


def mask_accepted(text: Column, resolved: Column, masked: Column) -> Column:
    """Whether masked is text with every resolved span replaced by one or more tokens, white space between them allowed."""
    return _accepted(text, F.transform(resolved, lambda r: r["start"]), F.transform(resolved, lambda r: r["stop"]), masked)


def outcome_of_gold(gold: DataFrame, found: DataFrame) -> DataFrame:
    """gold with outcome: exact, partial (some character found) or missed; concealed: covered as a whole by a span of its category."""
    keys = ["doc_id", "category", "start", "stop"]
    e = exact(gold.select(*keys), found.select(*keys), "left_semi").distinct().withColumn("e", F.lit(True))
    t = overlapping(gold.select(*keys), found.select(*keys)).distinct().withColumn("t", F.lit(True))
    c = overlapping(gold.select(*keys), found.select(*keys), same_category=True, contained=True).distinct().withColumn("c", F.lit(True))
    j = gold.join(e, keys, "left").join(t, keys, "left").join(c, keys, "left")
    return j.select(*gold.columns, F.when(F.col("e"), "exact").when(F.col("t"), "partial").otherwise("missed").alias("outcome"), F.coalesce("c", F.lit(False)).alias("concealed"))


def false_positives(gold: DataFrame, found: DataFrame) -> DataFrame:
    return exact(found, gold, "left_anti")


def order_statistics(rows: DataFrame, keys: Sequence[str], x: str, ranks: Callable[[Column], Mapping[str, Column]]) -> DataFrame:
    """keys, n (values that aren't null) and, for each name of ranks(n), the value at that rank, from 0, among a key's values in order.

    Values are counted, combined before the shuffle, and laid out by ranges of (keys, value) in a table in the shared folder. Ranges' counts add
    up to where each begins, which says in which range a rank lies; only there values are counted up. So a hot key is spread over as many
    tasks as it has ranges, and no task holds a key's values."""
    counts = rows.filter(F.col(x).isNotNull()).groupBy(F.struct(*keys).alias("__k"), F.col(x).alias("__x")).agg(F.count("*").alias("__c"))
    laid = stored(counts.repartitionByRange("__k", "__x").withColumn("__p", F.spark_partition_id()), "ranks")
    ranges = laid.groupBy("__k", "__p").agg(F.sum("__c").alias("__n"))
    w = W.partitionBy("__k")
    begun = ranges.withColumns({"__begin": F.coalesce(F.sum("__n").over(w.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), "n": F.sum("__n").over(w)})
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), r.cast("long").alias("rank")) for name, r in ranks(F.col("n")).items()])
    asked = begun.withColumn("__w", F.explode(F.filter(wanted, lambda r: r["rank"].between(F.col("__begin"), F.col("__begin") + F.col("__n") - 1))))
    asked = stored(asked.select("__k", "__p", "n", "__w.name", (F.col("__w.rank") - F.col("__begin")).alias("__local")), "ranks-asked")
    inside = laid.join(asked.select("__k", "__p").distinct(), ["__k", "__p"], "left_semi")
    upto = F.sum("__c").over(W.partitionBy("__k", "__p").orderBy("__x").rowsBetween(W.unboundedPreceding, 0))
    found = inside.withColumn("__upto", upto).join(asked, ["__k", "__p"]).filter((F.col("__local") < F.col("__upto")) & (F.col("__local") >= F.col("__upto") - F.col("__c")))
    out = found.groupBy("__k", "n").agg(*[F.max(F.when(F.col("name") == name, F.col("__x"))).alias(name) for name in ranks(F.lit(0))])
    return out.select(*[F.col("__k")[k].alias(k) for k in keys], "n", *ranks(F.lit(0)))


def percentile_floor(rows: DataFrame, keys: Sequence[str], x: str, qs: Mapping[str, float]) -> DataFrame:
    """keys and, for each name, the value at rank min(n - 1, floor(q n)) from 0."""
    return order_statistics(rows, keys, x, lambda n: {name: F.least(n - 1, F.floor(F.lit(q) * n)) for name, q in qs.items()}).drop("n")


def percentile_nearest(rows: DataFrame, keys: Sequence[str], x: str, qs: Mapping[str, float]) -> DataFrame:
    """keys and, for each name, the value at the nearest rank from above, ceil(q n) from 1."""
    return order_statistics(rows, keys, x, lambda n: {name: F.greatest(F.ceil(F.lit(q) * n), F.lit(1)) - 1 for name, q in qs.items()}).drop("n")


def percentile_interpolated(rows: DataFrame, keys: Sequence[str], x: str, qs: Mapping[str, float]) -> DataFrame:
    """keys and, for each name, the value interpolated between the two ranks around q (n - 1)."""
    place = lambda n, q: F.lit(q) * (n - 1)
    got = order_statistics(rows, keys, x, lambda n: {f"{name}{side}": f(place(n, q)) for name, q in qs.items() for side, f in (("_lo", F.floor), ("_hi", F.ceil))})
    between = lambda name, q: F.col(f"{name}_lo") + (F.col(f"{name}_hi") - F.col(f"{name}_lo")) * (place(F.col("n"), q) - F.floor(place(F.col("n"), q)))
    return got.select(*keys, *[between(name, q).alias(name) for name, q in qs.items()])


def timing(rows: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """keys, n, mean, p50, p95, p99 (interpolated) and max; null where a key has no value."""
    plain = rows.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.max(x).alias("max"))
    at = percentile_interpolated(rows, keys, x, {"p50": 0.5, "p95": 0.95, "p99": 0.99}).select(*[F.col(k).alias(f"__{k}") for k in keys], "p50", "p95", "p99")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return plain.join(at, same, "left").select(*keys, "n", "mean", "p50", "p95", "p99", "max")


def histogram(rows: DataFrame, keys: Sequence[str], x: str, bounds: Sequence[float]) -> DataFrame:
    """keys and a state of counts by bucket (up to each bound, and beyond the last), count and sum. States of several batches are merged by merge_histograms()."""
    bucket = F.lit(0)
    for b in bounds:
        bucket = bucket + (F.col(x) > b).cast("int")
    per = rows.filter(F.col(x).isNotNull()).groupBy(*keys).agg(*[F.count_if(bucket == i).alias(f"__{i}") for i in range(len(bounds) + 1)], F.count("*").alias("count"), F.sum(x).alias("sum"))
    return per.select(*keys, F.array(*[F.col(f"__{i}") for i in range(len(bounds) + 1)]).alias("buckets"), "count", "sum")


def merge_histograms(states: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """One state for each key from the states of several batches, in any order. A negative count is an error."""
    bad = F.exists("buckets", lambda c: c < 0)
    checked = states.withColumn("buckets", F.when(bad, F.raise_error(F.lit("counts can't fall")).cast("array<bigint>")).otherwise(F.col("buckets")))
    sums = checked.groupBy(*keys).agg(*[F.sum(F.get("buckets", F.lit(i))).alias(f"__{i}") for i in range(size)], F.sum("count").alias("count"), F.sum("sum").alias("sum"))
    return sums.select(*keys, F.array(*[F.col(f"__{i}") for i in range(size)]).alias("buckets"), "count", "sum")


def last_n(rows: DataFrame, keys: Sequence[str], order: Sequence[str], n: int = 8192) -> DataFrame:
    """The n latest rows of each key."""
    w = W.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n).drop("__r")


def first_n(rows: DataFrame, keys: Sequence[str], order: Sequence[str], n: int = 10) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def rolling(rows: DataFrame, keys: Sequence[str], ts: str = "ts", seconds: int = 60) -> DataFrame:
    """keys, second, n (in that second) and n_window (in the last seconds up to it): buckets first, so the window runs over seconds, not rows."""
    b = rows.withColumn("second", F.unix_seconds(F.col(ts).cast("timestamp"))).groupBy(*keys, "second").agg(F.count("*").alias("n"))
    w = W.partitionBy(*keys).orderBy("second").rangeBetween(-(seconds - 1), 0)
    return b.withColumn("n_window", F.sum("n").over(w))


def success_fraction(rows: DataFrame, keys: Sequence[str], status: Column) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.count_if(status == s).alias(f"n_{s}") for s in ("success", "overload", "error")], ratio(F.count_if(status == "success"), F.count("*")).alias("success_fraction"))


def sanitize(labels: Column, allowed: Mapping[str, Sequence[str]]) -> Column:
    """A label map with only allowed names and values."""
    def ok(k: Column, v: Column) -> Column:
        out = F.lit(False)
        for name, values in allowed.items():
            out = out | ((k == name) & v.isin(*values))
        return out

    return F.map_filter(labels, ok)


def policy_delta(active: DataFrame, candidate: DataFrame, names: Sequence[str]) -> DataFrame:
    """candidate - active for one-row summaries, with better/worse/same labels (less is better)."""
    a, c = active.select(F.lit(1).alias("__one"), *[F.col(n).alias(f"__a_{n}") for n in names]), candidate.select(F.lit(1).alias("__one"), *names)
    d = c.join(a, "__one")
    deltas = [(F.col(n) - F.col(f"__a_{n}")).alias(f"delta_{n}") for n in names]
    marks = [F.when(F.col(n) < F.col(f"__a_{n}"), "better").when(F.col(n) > F.col(f"__a_{n}"), "worse").otherwise("same").alias(f"label_{n}") for n in names]
    return d.select(*deltas, *marks)

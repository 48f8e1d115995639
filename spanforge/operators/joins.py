"""Interval, nearest and as-of joins over span rows.

Every join has the document (or another key) as an equality. None of them pairs rows up: as-of, range and overlap joins are sweeps, a union of both
sides and windows over blocks of places, with one row carried from block to block. Work grows with the rows, not with the pairs, and no task
holds a whole key.

Whether an interval that starts at or before a place reaches it, or a further end, follows from the largest end of all that start by then (reach());
near, overlapping and contained are that comparison with different starts, ends and places.

Sentences are cut and joined with spans within the text's row (in_sentences).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def reach(left: DataFrame, starts: DataFrame, key: str, at: Column, start: Column, stop: Column, width: float = 4096) -> DataFrame:
    """left with __reach, the largest stop of the rows of starts with the same key whose start is at or before at; null if there is none.

    No task gets all rows of a key, but those of a block of width places, and of a key's blocks one row each."""
    a = left.select(F.lit(1).alias("__side"), F.col(key).alias("__k"), at.alias("__at"), F.struct("*").alias("__row"))
    b = starts.filter(F.col(key).isNotNull()).select(F.lit(0).alias("__side"), F.col(key).alias("__k"), start.alias("__at"), stop.alias("__stop"))
    b = b.filter("__at IS NOT NULL AND __stop IS NOT NULL")
    both = a.unionByName(b, allowMissingColumns=True).withColumn("__block", F.floor(F.col("__at").cast("double") / width))
    inside = W.partitionBy("__k", "__block").orderBy("__at", "__side").rowsBetween(W.unboundedPreceding, 0)
    seen = both.withColumn("__here", F.max("__stop").over(inside)).filter("__side = 1")
    blocks = both.filter("__side = 0").groupBy("__k", "__block").agg(F.max("__stop").alias("__best"))
    # blocks of both sides, as one may hold places only
    places = both.filter("__k IS NOT NULL AND __block IS NOT NULL").select("__k", "__block").distinct().join(blocks, ["__k", "__block"], "left")
    before = W.partitionBy("__k").orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    carried = places.select("__k", "__block", F.max("__best").over(before).alias("__carried")).filter("__carried IS NOT NULL")
    return seen.join(carried, ["__k", "__block"], "left").select("__row.*", F.greatest("__here", "__carried").alias("__reach"))


def _chosen(found: DataFrame, hit: Column, anti: bool) -> DataFrame:
    hit = F.coalesce(hit, F.lit(False))
    return found.filter(~hit if anti else hit).drop("__reach")


def near(left: DataFrame, marks: DataFrame, before: int, behind: int, key: str = "doc_id", anti: bool = False, width: float = 4096) -> DataFrame:
    """left rows whose start lies in [mark.start - before, mark.stop + behind] of some mark; with anti, of none. A null key or start is near none."""
    return _chosen(reach(left, marks, key, F.col("start"), F.col("start") - before, F.col("stop") + behind, width), F.col("__reach") >= F.col("start"), anti)


def near_unless(left: DataFrame, marks: DataFrame, others: DataFrame, before: int, behind: int, key: str = "doc_id", anti: bool = False, width: float = 4096) -> DataFrame:
    """left rows whose start lies in [mark.start - before, mark.stop + behind] of some mark with no row of others between: starting behind the
    mark's end and ending at or before the row's start. With anti, the rest.

    The mark with the largest end is the nearest and leaves the least room for others, so it alone decides; of the others that end by the row's
    start the one with the largest start does."""
    found = reach(left, marks, key, F.col("start"), F.col("start") - before, F.col("stop"), width).withColumnRenamed("__reach", "__mark")
    between = reach(found, others, key, F.col("start"), F.col("stop"), F.col("start"), width)
    hit = (F.col("__mark") + behind >= F.col("start")) & ~F.coalesce(F.col("__reach") > F.col("__mark"), F.lit(False))
    return _chosen(between, hit, anti).drop("__mark")


def overlapping(left: DataFrame, right: DataFrame, key: str = "doc_id", same_category: bool = False, contained: bool = False, anti: bool = False, width: float = 4096) -> DataFrame:
    """left rows that share a character with (or with contained, lie inside) some right row; adjacency is no overlap."""
    keys = [key, "category"] if same_category else [key]
    one = lambda df: df.withColumn("__key", F.when(F.exists(F.array(*[F.col(k).isNull() for k in keys]), lambda x: x), None).otherwise(F.struct(*keys)))
    at, hit = (F.col("start"), F.col("__reach") >= F.col("stop")) if contained else (F.col("stop") - 1, F.col("__reach") > F.col("start"))
    return _chosen(reach(one(left), one(right), "__key", at, F.col("start"), F.col("stop"), width), hit, anti).drop("__key")


def exact(left: DataFrame, right: DataFrame, how: str = "inner", key: str = "doc_id") -> DataFrame:
    return left.join(right, [key, "category", "start", "stop"], how)


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str, forward: bool = False, width: float = 4096) -> DataFrame:
    """left with value of the latest right row at or before its place at (with forward, the earliest at or after it), and that row's place.

    Adds <value> and <at>_found, null if there is none, as for a null key or place. Of right rows at one place the largest value counts
    (forward: the least). No task gets all rows of a key, but those of a block of width places (seconds, for timestamps), and of a key's
    blocks one row each; what a block doesn't hold itself comes from the nearest block before it. width should hold some thousand rows."""
    b = right.filter(F.col(key).isNotNull() & F.col(at).isNotNull())
    a = left.select(F.lit(1).alias("__side"), F.col(key).alias("__k"), F.col(at).alias("__at"), F.struct("*").alias("__row"), F.lit(None).cast(right.schema[value].dataType).alias("__v"))
    b = b.select(F.lit(0).alias("__side"), F.col(key).alias("__k"), F.col(at).alias("__at"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), F.col(value).alias("__v"))
    both = a.unionByName(b).withColumn("__block", F.floor(F.col("__at").cast("double") / width))
    seen = F.when(F.col("__side") == 0, F.struct(F.col("__at").alias("at"), F.col("__v").alias("v")))
    order = [F.col("__at").desc(), F.col("__side"), F.col("__v").desc()] if forward else [F.col("__at"), F.col("__side"), F.col("__v")]
    inside = both.withColumn("__hit", F.last(seen, ignorenulls=True).over(W.partitionBy("__k", "__block").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))).filter("__side = 1")
    blocks = both.filter("__k IS NOT NULL AND __block IS NOT NULL").groupBy("__k", "__block").agg((F.min if forward else F.max)(seen).alias("best"))
    before = W.partitionBy("__k").orderBy(F.col("__block").desc() if forward else F.col("__block")).rowsBetween(W.unboundedPreceding, -1)
    carried = blocks.select("__k", "__block", F.last("best", ignorenulls=True).over(before).alias("__carried")).filter("__carried IS NOT NULL")
    found = inside.join(carried, ["__k", "__block"], "left").withColumn("__hit", F.coalesce("__hit", "__carried"))
    return found.select("__row.*", F.col("__hit.v").alias(value), F.col("__hit.at").alias(f"{at}_found"))


def nearest(left: DataFrame, marks: DataFrame, key: str = "doc_id") -> DataFrame:
    """left with distance, from its start to the nearer end of the nearest mark (null without marks).

    The nearest end is the last one before or the first one behind, so two as-of joins over the marks' ends find it."""
    ends = marks.select(key, F.explode(F.array("start", "stop")).alias("start")).withColumn("edge", F.col("start"))
    back = as_of(left, ends, key, "start", "edge").withColumnRenamed("edge", "__b").drop("start_found")
    both = as_of(back, ends, key, "start", "edge", forward=True).withColumnRenamed("edge", "__f").drop("start_found")
    return both.withColumn("distance", F.least(F.col("start") - F.col("__b"), F.col("__f") - F.col("start"))).drop("__b", "__f")


#: Abbreviations whose dot doesn't end a sentence.
ABBREVIATIONS = ("г", "ул", "д", "кв", "стр", "корп", "им", "пр", "пер", "обл", "р", "т")


def bounds(text: Column) -> Column:
    """array<struct<start, stop>> of the sentences of text: cut behind [.!?;] and white space, or newlines; a dot behind one letter or an abbreviation doesn't end one."""
    from spanforge.functions.spans import let, running

    sign = r"(?U)[.!?;][\s\x1c-\x1f]+|\n+"

    def ends(x: Column) -> Column:
        # the word before a sign is the end of the piece before it, so that nothing walks through the text again
        def one(gap: Column, m: Column) -> Column:
            word = F.when(m.startswith("."), F.regexp_extract(F.substring(gap, F.greatest(F.length(gap) - 11, F.lit(1)), F.lit(12)), "([А-ЯЁа-яёA-Za-z]+)$", 1)).otherwise("")
            size = F.length(gap) + F.length(m)
            return F.struct(size.alias("n"), ((F.length(word) != 1) & ~F.lower(word).isin(*ABBREVIATIONS)).alias("ends"))

        pieces = F.zip_with(F.slice(x["gaps"], F.lit(1), F.size(x["signs"])), x["signs"], one)
        at = lambda p: let(running(F.transform(p, lambda y: y["n"]), lambda a, b: a + b), lambda upto: F.transform(p, lambda y, i: F.when(y["ends"], F.get(upto, i))))
        return F.array_compact(let(pieces, at))

    cuts = let(F.struct(F.split(text, sign).alias("gaps"), F.regexp_extract_all(text, F.lit(sign), F.lit(0)).alias("signs")), ends)
    whole = let(F.length(text), lambda n: F.filter(F.array(F.struct(F.lit(0).alias("start"), n.alias("stop"))), lambda s: s["stop"] > 0))
    between = let(cuts, lambda c: F.zip_with(F.concat(F.array(F.lit(0)), c), F.concat(c, F.array(F.length(text))), lambda a, b: F.struct(a.alias("start"), b.alias("stop"))))
    return F.filter(F.when(text.rlike(sign), between).otherwise(whole), lambda s: s["start"] < s["stop"])


def sentences(docs: DataFrame) -> DataFrame:
    """doc_id, start, stop of the sentences of docs (doc_id, text)."""
    # outer: of an inner explode Spark infers a filter that cuts the text a second time
    return docs.select("doc_id", F.explode_outer(bounds(F.col("text"))).alias("s")).filter("s IS NOT NULL").select("doc_id", "s.start", "s.stop")


def in_sentences(text: Column, spans: Column) -> Column:
    """The sentences of text, each with every one of spans (array<struct<category, start, stop>>) that starts in it: array<struct<start, stop, category,
    span_start, span_stop>>, a sentence without spans once with nulls. Of the sentences that start at or before a span it has the last.

    Starts of both are sorted once and swept, so the work isn't that of all pairs, and nothing leaves the text's row."""
    from spanforge.functions.spans import let, running

    row = "struct<start:int,stop:int,category:string,span_start:int,span_stop:int>"
    made = lambda b, x: F.struct(b["start"].alias("start"), b["stop"].alias("stop"), x[0].alias("category"), x[1].alias("span_start"), x[2].alias("span_stop"))
    alone = lambda b: made(b, (F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(None).cast("int")))
    event = lambda at, kind, i: F.struct(at["start"].alias("at"), F.lit(kind).alias("kind"), i.alias("i"))

    def joined(b: Column) -> Column:
        def found(ordered: Column) -> Column:
            last = running(F.transform(ordered, lambda e: F.when(e["kind"] == 0, e["i"]).otherwise(0)), F.greatest)
            return let(last, lambda at: F.filter(F.transform(ordered, lambda e, k: F.when(e["kind"] == 1, F.struct(e["i"].alias("i"), F.get(at, k).alias("own")))), lambda x: x.isNotNull()))

        def rows(own: Column) -> Column:
            with_spans = F.transform(own, lambda o: let(F.get(spans, o["i"]), lambda s: made(F.get(b, o["own"]), (s["category"], s["start"], s["stop"]))))
            rest = F.array_except(F.sequence(F.lit(0), F.size(b) - 1), F.transform(own, lambda o: o["own"]))
            return F.concat(with_spans.cast(f"array<{row}>"), F.transform(rest, lambda i: alone(F.get(b, i))).cast(f"array<{row}>"))

        events = F.concat(F.transform(b, lambda x, i: event(x, 0, i)), F.transform(spans, lambda x, i: event(x, 1, i)))
        return F.when((F.size(spans) == 0) | (F.size(b) == 0), F.transform(b, alone).cast(f"array<{row}>")).otherwise(let(let(F.sort_array(events), found), rows))

    return let(bounds(text), joined)

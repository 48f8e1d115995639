"""Metamorphic mutations of labelled texts: (doc_id, text, gold array<struct<start, stop, category>>) to the same with the gold moved along.

The seeded ones draw from a hash of the document, the place and the seed, so that they are reproducible on any partitioning.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions.spans import let

GOLD = "array<struct<start:int,stop:int,category:string>>"
PREFIX, SUFFIX, CHUNK = "Запрос: ", " (обработано)", "\n---\n"
DASH_CHOICES = ("–", "—", "-", "/")


def _chars(text: Column) -> Column:
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(text, ""))


def _moved(gold: Column, place: Callable[[Column], Column]) -> Column:
    moved = F.transform(gold, lambda g: F.struct(place(g["start"]).cast("int").alias("start"), place(g["stop"]).cast("int").alias("stop"), g["category"].alias("category")))
    return F.filter(moved, lambda g: g["stop"] > g["start"]).cast(GOLD)


def _rewritten(docs: DataFrame, change: Callable[[Column, Column], Column], kept: Column | None = None) -> DataFrame:
    """Every character is replaced by change(character, place); gold ends move with the lengths. Where kept is true, nothing is changed."""
    new = F.transform(_chars(F.col("text")), change)
    if kept is not None:
        new = F.when(kept, F.when(F.col("text").isNotNull(), F.array("text"))).otherwise(new)
    out = docs.withColumn("__new", new)
    place = lambda p: F.length(F.array_join(F.slice("__new", F.lit(1), F.greatest(p, F.lit(0))), ""))
    return out.select("doc_id", F.array_join("__new", "").alias("text"), F.when(F.size("gold") == 0, F.expr(f"cast(array() as {GOLD})")).otherwise(_moved(F.col("gold"), place)).alias("gold"))


def _draw(seed: int, n: int) -> Callable[[Column], Column]:
    return lambda place: F.pmod(F.xxhash64(F.col("doc_id"), place, F.lit(seed)), F.lit(n))


def _recased(docs: DataFrame, change: Callable[[Column], Column]) -> DataFrame:
    """change is made to whole texts, but has to give what it gives character by character."""
    place = lambda p: F.length(change(F.substring(F.col("text"), F.lit(1), F.greatest(p, F.lit(0)))))
    # the new text gets its name last: inside a lambda, text would mean the column that is being made
    return docs.select("doc_id", change(F.col("text")).alias("__t"), _moved(F.col("gold"), place).alias("gold")).withColumnRenamed("__t", "text")


def uppercase(docs: DataFrame) -> DataFrame:
    return _recased(docs, F.upper)


def lowercase(docs: DataFrame) -> DataFrame:
    # a capital sigma is the one letter whose lower case depends on its neighbours
    return _recased(docs, lambda t: F.lower(F.translate(t, "\u03a3", "\u03c3")))


def nbsp_spaces(docs: DataFrame, seed: int = 20260922) -> DataFrame:
    """Each space becomes a no-break space or two spaces."""
    return _rewritten(docs, lambda c, i: F.when(c == " ", F.when(_draw(seed, 2)(i) == 0, " ").otherwise("  ")).otherwise(c))


def dash_variants(docs: DataFrame, seed: int = 20260922) -> DataFrame:
    return _rewritten(docs, lambda c, i: F.when(c == "-", F.get(F.array(*map(F.lit, DASH_CHOICES)), _draw(seed, 4)(i).cast("int"))).otherwise(c))


def bracket_wrap(docs: DataFrame) -> DataFrame:
    """[ before each gold start, ] behind the character at each gold end; the moved span starts with the bracket."""
    starts, stops = F.transform("gold", lambda g: g["start"]), F.transform("gold", lambda g: g["stop"])
    count = lambda a, i: F.size(F.filter(a, lambda x: x == i))
    return _inserted(docs, lambda c, i: (F.repeat(F.lit("["), count(starts, i)), c, F.repeat(F.lit("]"), count(stops, i))))


def emoji_combining(docs: DataFrame) -> DataFrame:
    """An emoji before and a combining accent behind the first character of each gold span, which then starts with the emoji."""
    starts = F.transform("gold", lambda g: g["start"])
    count = lambda i: F.size(F.filter(starts, lambda x: x == i))
    return _inserted(docs, lambda c, i: (F.repeat(F.lit("\U0001f600"), count(i)), c, F.repeat(F.lit("́"), count(i))))


def _inserted(docs: DataFrame, around: Callable[[Column, Column], tuple[Column, Column, Column]]) -> DataFrame:
    """Nothing is put into a text without gold."""
    return _rewritten(docs, lambda c, i: F.concat(*around(c, i)), F.size("gold") == 0)


def prefix_suffix(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.concat(F.lit(PREFIX), "text", F.lit(SUFFIX)).alias("text"), _moved(F.col("gold"), lambda p: p + len(PREFIX)).alias("gold"))


def repeat_value(docs: DataFrame) -> DataFrame:
    n = F.length("text") + 1
    # the new text gets its name last: inside a lambda, text would mean the column that is being made
    return docs.select("doc_id", F.concat("text", F.lit("\n"), "text").alias("__t"), F.flatten(F.transform("gold", lambda g: F.array(g, F.struct((g["start"] + n).alias("start"), (g["stop"] + n).alias("stop"), g["category"].alias("category"))))).cast(GOLD).alias("gold")).withColumnRenamed("__t", "text")


def chunk_boundary(docs: DataFrame) -> DataFrame:
    """A break before the first gold span, whose moved start stays in front of it."""
    at = F.get("gold", F.lit(0))["start"]
    text = F.concat(F.substring(F.col("text"), F.lit(1), at), F.lit(CHUNK), F.substring(F.col("text"), at + 1, F.length("text")))
    moved = _moved(F.col("gold"), lambda p: p + F.when(p > at, len(CHUNK)).otherwise(0))
    return docs.select("doc_id", F.when(F.size("gold") > 0, text).otherwise(F.col("text")).alias("text"), F.when(F.size("gold") > 0, moved).otherwise(F.col("gold")).cast(GOLD).alias("gold"))


def reorder_fields(docs: DataFrame, seed: int = 20260922) -> DataFrame:
    """Fields between ", " in the order of a seeded hash; unchanged where a gold span crosses a field's end."""
    fields = F.split("text", ", ")
    starts = F.aggregate(fields, F.array(F.lit(0)), lambda a, f: F.concat(a, F.array(F.element_at(a, -1) + F.length(f) + 2)))
    rows = F.zip_with(fields, F.slice(starts, F.lit(1), F.size(fields)), lambda f, s: F.struct(f.alias("f"), s.alias("s")))
    ordered = F.sort_array(F.transform(rows, lambda r, i: F.struct(F.xxhash64(F.col("doc_id"), i, F.lit(seed)).alias("h"), r["s"].alias("s"), r["f"].alias("f"))))

    def built(o: Column) -> Column:
        ends = F.aggregate(o, F.array(F.lit(0)), lambda a, r: F.concat(a, F.array(F.element_at(a, -1) + F.length(r["f"]) + 2)))
        return F.zip_with(o, F.slice(ends, F.lit(1), F.size(o)), lambda r, at: F.struct(r["f"].alias("f"), r["s"].alias("s"), at.alias("at")))

    # a text of one field stays as it is
    out = docs.withColumn("__o", F.when(F.contains("text", F.lit(", ")), let(ordered, built)))
    home = lambda g: F.filter("__o", lambda r: (r["s"] <= g["start"]) & (g["stop"] <= r["s"] + F.length(r["f"])))
    whole = F.col("__o").isNotNull() & F.forall("gold", lambda g: F.size(home(g)) > 0)
    shift = lambda g: let(F.get(home(g), F.lit(0)), lambda r: r["at"] - r["s"])
    gold = F.transform("gold", lambda g: F.struct((g["start"] + shift(g)).alias("start"), (g["stop"] + shift(g)).alias("stop"), g["category"].alias("category"))).cast(GOLD)
    return out.select("doc_id", F.when(whole, F.array_join(F.transform("__o", lambda r: r["f"]), ", ")).otherwise(F.col("text")).alias("text"), F.when(whole, gold).otherwise(F.col("gold")).alias("gold"))


ALL: dict[str, Callable[[DataFrame], DataFrame]] = {
    "uppercase": uppercase, "lowercase": lowercase, "nbsp_spaces": nbsp_spaces, "dash_variants": dash_variants, "bracket_wrap": bracket_wrap, "reorder_fields": reorder_fields,
    "prefix_suffix": prefix_suffix, "repeat_value": repeat_value, "chunk_boundary": chunk_boundary, "emoji_combining": emoji_combining,
}


def mutate_all(docs: DataFrame) -> DataFrame:
    """The rows of all mutations, with their names."""
    parts = [m(docs).withColumn("mutation", F.lit(name)) for name, m in ALL.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

"""Spans of regular-expression matches as native Columns, in code points.

Spark has no built-in that gives the offsets of all matches, and regexp_instr counts UTF-16 units. The places follow from what the
pattern leaves over: the pieces between matches (split) and the matches themselves (regexp_extract_all) alternate, so running sums of
their lengths are the offsets. A pattern is given in tiles, each a group of its own, so that every tile's place follows as well.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Case-insensitive, with \\s, \\d, \\w and \\b over all of Unicode, as in the patterns' definitions.
ANY_CASE, EXACT_CASE = "(?iU)", "(?U)"
#: Values in a slice of running(), and code points in a block of cuts_of().
SLICE, BLOCK = 64, 1024


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body).getItem(0)


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Inclusive running op (associative, over whole numbers from 0 up, with 0 as its neutral value) of an array of int.

    An array that grows in aggregate() is copied at each step, so the steps run over slices of 64 values and then over the slices' totals:
    copies grow with the values times 64, not with their square."""
    step = lambda acc, v: F.concat(acc, F.array(op(F.element_at(acc, -1), v)))

    def joined(slices: Column) -> Column:
        bases = F.aggregate(slices, F.array(F.lit(0)), lambda acc, s: step(acc, F.element_at(s, -1)))
        return F.flatten(F.zip_with(slices, F.slice(bases, F.lit(1), F.size(slices)), lambda s, b: F.transform(F.slice(s, F.lit(2), F.lit(SLICE)), lambda v: op(b, v))))

    def sliced(held: Column) -> Column:
        # held is bound once: in the lambda below an expression would be computed anew for every slice
        slices = F.transform(F.sequence(F.lit(1), F.size(held), F.lit(SLICE)), lambda i: F.aggregate(F.slice(held, i, F.lit(SLICE)), F.array(F.lit(0)), step))
        return F.when(F.size(held) == 0, F.expr("cast(array() as array<int>)")).otherwise(let(slices, joined))

    return let(values, sliced)


def tiled(tiles: Sequence[str], before: str = "", behind: str = "", flags: str = ANY_CASE) -> str:
    return flags + before + "".join(f"({t})" for t in tiles) + behind


def find(text: Column, tiles: Sequence[str], before: str = "", behind: str = "", flags: str = ANY_CASE) -> Column:
    """array<struct<start, stop, cuts>> of all matches, in order; cuts holds where each tile ends, behind the match's start.

    before and behind are zero-width conditions around the tiles. The pattern must not match the empty string."""
    p = F.lit(tiled(tiles, before, behind, flags))
    groups = [F.regexp_extract_all(text, p, F.lit(i)) for i in range(len(tiles) + 1)]

    def places(m: Column) -> Column:
        gaps = F.split(text, tiled(tiles, before, behind, flags))
        lengths = F.zip_with(F.slice(gaps, F.lit(1), F.size(m)), m, lambda g, x: F.length(g) + F.length(x))
        ends = let(lengths, lambda n: running(n, lambda a, b: a + b))
        return F.zip_with(m, ends, lambda x, e: F.struct((e - F.length(x)).alias("start"), e.alias("stop")))

    sizes = F.arrays_zip(*[F.transform(g, lambda x: F.length(x)).alias(f"g{i}") for i, g in enumerate(groups[1:])])

    def with_cuts(whole: Column) -> Column:
        def one(w: Column, s: Column) -> Column:
            upto = [w["start"]]
            for i in range(len(tiles)):
                upto.append(upto[-1] + s[f"g{i}"])
            return F.struct(w["start"].alias("start"), w["stop"].alias("stop"), F.array(*upto[1:]).alias("cuts"))

        return F.zip_with(whole, sizes, one)

    return F.when(text.rlike(tiled(tiles, before, behind, flags)), let(groups[0], lambda m: with_cuts(places(m)))).otherwise(F.array().cast("array<struct<start:int,stop:int,cuts:array<int>>>"))


def cut_of(text: Column, start: Column, stop: Column) -> Column:
    return F.substring(text, start + 1, stop - start)


def blocks_of(text: Column, block: int = BLOCK) -> Column:
    """text in blocks of so many code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block}}}"), F.lit(0))


def touched(spans: Column, others: Column, contained: bool = False) -> Column:
    """For each span (start, stop) whether it shares a character with one of others: of those that start before its end the running maximum of ends
    lies behind its start. With contained, whether it lies in one of them: of those that start by its start the maximum reaches its end. Sorted once,
    so the work isn't that of all pairs."""
    mine, theirs = (1, 0) if contained else (0, 1)  # which comes first at one place
    event = lambda at, kind, i, s: F.struct(at.alias("at"), F.lit(kind).alias("kind"), i.alias("i"), s["start"].alias("start"), s["stop"].alias("stop"))
    events = F.concat(F.transform(spans, lambda s, i: event(s["start"] if contained else s["stop"], mine, i, s)), F.transform(others, lambda s, i: event(s["start"], theirs, i, s)))

    def flags(ordered: Column) -> Column:
        reach = running(F.transform(ordered, lambda e: F.when(e["kind"] == theirs, e["stop"]).otherwise(0)), F.greatest)
        hit = lambda upto, e: upto >= e["stop"] if contained else upto > e["start"]
        hits = let(reach, lambda r: F.transform(ordered, lambda e, k: F.when(e["kind"] == mine, F.struct(e["i"].alias("i"), hit(F.get(r, k), e).alias("hit")))))
        return F.transform(F.sort_array(F.filter(hits, lambda h: h.isNotNull())), lambda h: h["hit"])

    return let(F.sort_array(events), flags)


def cuts_of(text: Column, pieces: Column, block: int = BLOCK) -> Column:
    """array<string> of the pieces (array<struct<start, stop>>) of text.

    substring() walks from the text's start; here it walks within the blocks of code points that a piece touches, so that all pieces
    together cost the text once and a block or two each."""

    def piece(blocks: Column, s: Column) -> Column:
        first, last = (F.floor(s[x] / block).cast("int") for x in ("start", "stop"))
        touched = F.when(first == last, F.coalesce(F.get(blocks, first), F.lit(""))).otherwise(F.array_join(F.slice(blocks, first + 1, last - first + 1), ""))
        return F.substring(touched, s["start"] - first * block + 1, s["stop"] - s["start"])

    return let(blocks_of(text, block), lambda blocks: F.transform(pieces, lambda s: piece(blocks, s)))

"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of 10 words of the benchmark items (an item of fewer words is one pattern). Patterns of one length share a
table: the shift of a block of two words says how far the search may jump, blocks that occur in no pattern allow the whole length,
a suffix-hash bucket (the last block, then the first word) selects patterns where the shift is 0, and a direct comparison of the
words confirms. The alphabet is words, so that a jump passes over up to ten words and most words of a text are never looked at.

Items are a stated query set and every document is searched for all of them. They are compiled in blocks of about BLOCK_BYTES of text, each
broadcast by itself; a compiled block takes about 50 times that in a worker. A long item lies in several blocks, as runs of words that
overlap by a window less a word. With more than one block the documents pass through one search after the other, each written before the
next, hits merged.

Edge cases: a null or wordless text has no words and isn't contaminated; null or wordless items have no pattern; rows that repeat an item_id add
their windows to the same item; an item without an id marks words but names no item; repeated documents each get a row; empty tables give
no rows or no hits; extra columns are ignored by search() and kept by clean().
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

WINDOW = 10
BLOCK_BYTES = 2 << 20
#: Windows of an item that may lie in one block.
RUN = 20_000
#: Maps A-Z to a-z and every byte that is no ASCII letter, digit or part of a longer character to a space.
_TABLE = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in bytes(range(256)).lower())


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class WuManber:
    """Finds all occurrences of windows of items; an item is its words, and a window is kept as its place in them."""

    def __init__(self, items: Iterable[tuple[int, list[bytes]]]):
        """items: a number that is reported, and words."""
        self.tables: list[tuple[int, dict, dict]] = []
        by_length: dict[int, tuple[dict, dict]] = {}
        for number, words in items:
            if not words:
                continue
            m = min(WINDOW, len(words))
            shift, bucket = by_length.setdefault(m, ({}, {}))
            for i in range(len(words) - m + 1):
                self._add(shift, bucket, words, i, m, number)
        self.tables = [(m, *by_length[m]) for m in sorted(by_length)]

    @staticmethod
    def _add(shift: dict, bucket: dict, words: list[bytes], i: int, m: int, number: int) -> None:
        if m == 1:
            shift[words[i]] = tuple(sorted({*shift.get(words[i], ()), number}))
            return
        key = (words[i + m - 2], words[i + m - 1], words[i])
        held = bucket.get(key, ())
        own = words[i : i + m]
        for k, (other, at, numbers) in enumerate(held):
            if other[at : at + m] == own:
                if number not in numbers:
                    bucket[key] = (*held[:k], (other, at, (*numbers, number)), *held[k + 1 :])
                return
        bucket[key] = (*held, (words, i, (number,)))
        # shift by the last word of a block, then by the one before it (None: any other)
        shift.setdefault(words[i], {})[None] = m - 1
        for j in range(1, m):
            blocks = shift.setdefault(words[i + j], {})
            before = words[i + j - 1]
            blocks[before] = min(blocks.get(before, m), m - 1 - j)

    def find(self, words: list[bytes]) -> Iterator[tuple[int, int, tuple[int, ...]]]:
        """start, end (in words) and the report of every occurrence; by length, then start."""
        n = len(words)
        for m, shift, bucket in self.tables:
            if m == 1:
                for i, w in enumerate(words):
                    if w in shift:
                        yield i, i + 1, shift[w]
                continue
            i = m - 1
            while i < n:
                blocks = shift.get(words[i])
                if blocks is None:
                    i += m
                    continue
                jump = blocks.get(words[i - 1])
                if jump is None:
                    i += blocks.get(None, m)
                elif jump:
                    i += jump
                else:
                    first = i - m + 1
                    for own, at, report in bucket.get((words[i - 1], words[i], words[first]), ()):
                        if words[first : i + 1] == own[at : at + m]:
                            yield first, i + 1, report
                    i += 1


def windows(words: list[bytes]) -> Iterable[tuple[bytes, ...]]:
    if not words:
        return []
    return (tuple(words[i : i + WINDOW]) for i in range(max(1, len(words) - WINDOW + 1)))


def compile_items(items: Iterable[tuple[object, str | None]]) -> tuple[WuManber, list[str | None]]:
    """The search for (item_id, text) rows and the ids that its reports point to."""
    names: dict[str | None, int] = {}
    same: dict[bytes, bytes] = {}
    numbered = [(names.setdefault(None if name is None else str(name), len(names)), [same.setdefault(w, w) for w in words_of(text)]) for name, text in items]
    return WuManber(numbered), list(names)


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """item_id and text of runs of at most RUN windows of an item's words, in order."""
    for b in batches:
        names, runs = [], []
        for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            words = words_of(text)
            for a in range(0, max(1, len(words) - WINDOW + 1), RUN):
                names.append(name)
                runs.append(b" ".join(words[a : a + RUN + WINDOW - 1]).decode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays([pa.array(names, b.column(0).type), pa.array(runs, pa.string())], names=["item_id", "text"])


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[object, str | None]]]:
    """The items, long ones as overlapping runs, in blocks of about BLOCK_BYTES of text, one at a time."""
    items = benchmark.select("item_id", "text").mapInArrow(_runs, f"item_id {benchmark.schema['item_id'].dataType.simpleString()}, text string")
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = max(1, math.ceil(size / BLOCK_BYTES))
    for k in range(n):
        yield [(r[0], r[1]) for r in (items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)).collect()]


def _searcher(held):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, names = held.value
        for b in batches:
            counts, spans, items = [], [], []
            for t, old_spans, old_items in zip(b.column("text"), b.column("spans"), b.column("items"), strict=True):
                words = words_of(t.as_py())
                found, at = [(x["a"], x["b"]) for x in old_spans.as_py()], set()
                for start, end, report in finder.find(words):
                    found.append((start, end))
                    at.update(report)
                counts.append(len(words))
                spans.append([{"a": x, "b": y} for x, y in merge(found)])
                items.append(sorted({*old_items.as_py(), *(names[i] for i in at if names[i] is not None)}))
            new = [pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), *new], names=["doc_id", "text", "n_words", "spans", "items"])

    return scan


_HITS = "n_words long, spans array<struct<a:int,b:int>>, items array<string>"


def search(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, spans (disjoint half-open word ranges that lie in an occurrence) and items (their ids as sorted strings) of every document."""
    sc = docs.sparkSession.sparkContext
    kind = docs.schema["doc_id"].dataType.simpleString()
    none = F.from_json(F.lit("[]"), "array<struct<a:int,b:int>>")
    state = docs.select("doc_id", "text", F.lit(0).cast("long").alias("n_words"), none.alias("spans"), F.array().cast("array<string>").alias("items"))
    first = True
    for block in item_blocks(benchmark):
        state = state if first else cut(state, "decontaminate")
        first = False
        held = sc.broadcast(compile_items(block))

        state = state.mapInArrow(_searcher(held), f"doc_id {kind}, text string, {_HITS}")
    return state.drop("text")


def _cleaner(held):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, _ = held.value
        for b in batches:
            yield b.filter(pa.array([next(finder.find(words_of(t.as_py())), None) is None for t in b.column("text")], pa.bool_()))

    return scan


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs in which no window of an item occurs."""
    sc = docs.sparkSession.sparkContext
    out, first = docs, True
    for block in item_blocks(benchmark):
        out = out if first else cut(out, "decontaminate-clean")
        first = False
        held = sc.broadcast(compile_items(block))

        out = out.mapInArrow(_cleaner(held), docs.schema)
    return out


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )

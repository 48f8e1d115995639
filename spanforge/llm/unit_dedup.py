"""Substring dedup by hashing stretches of lines and clauses.

A text is cut behind every newline and behind every sign of . ! ? , ; : that white space follows. From each such piece on, a unit takes as
many whole pieces as it needs to reach MIN_WORDS words: a long line or sentence is a unit by itself, short ones are joined with what
follows, over line ends too, so that none is exempt and a passage is found wherever the lines around it are broken. A unit is normalised
(A-Z in lower case, runs of white space made one space) and hashed with MD5. Over all documents the occurrence of a digest that ranks
first (least doc_id, then the earliest place) is kept and every other one removed, with its offsets in the original text; units overlap,
and what is cut out of a text is the union of its removed ones. A unit that overlaps the kept occurrence of its digest stays.

Pieces and digests are made once and lie in a table with a row for each document. Half digests that occur twice are counted first (a hash
aggregate of longs, combined before the shuffle), so that only units which may repeat are ranked. Every join reads both sides from tables, so that
a digest that thousands of documents share can be split over tasks, and ranks are aggregated, never gathered.

Edge cases: null and empty texts, and those of fewer than MIN_WORDS words, have no units; rows that repeat a doc_id and a text are one document (none of
them is cut because of the other, each gets the same result); of different texts under one id the one with the smaller hash ranks first;
a null doc_id ranks last; a text without any of the signs is one unit, however long; very long texts and empty tables are as any other;
extra columns are ignored by repeats() and kept by clean().
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, table

MIN_WORDS = 16
#: Where a piece ends: behind these signs, if white space follows, and behind a newline.
PIECE_END = re.compile(r"[.!?,;:](?=[ \t\x0b-\r])|\n")


def units_of(text: str) -> tuple[np.ndarray, np.ndarray, bytes]:
    """starts and stops (code points) of a text's units and their digests, 16 bytes each, end to end."""
    bounds = [m.end() for m in PIECE_END.finditer(text)]
    bounds.append(len(text))
    starts, stops, norms, counts = [], [], [], []
    a = 0
    for b in bounds:
        words = text[a:b].encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, and only ASCII white space parts words
        if words:
            starts.append(a)
            stops.append(b)
            norms.append(b" ".join(words))
            counts.append(len(words))
        a = b
    upto = np.cumsum(counts, dtype=np.int64)
    ends = np.searchsorted(upto, upto - np.array(counts, dtype=np.int64) + MIN_WORDS)  # the piece with which each unit is long enough
    n = int(np.searchsorted(ends, len(counts)))
    md5 = hashlib.md5
    digests = b"".join([md5(norms[i] if i == e else b" ".join(norms[i : e + 1])).digest() for i, e in enumerate(ends[:n].tolist())])
    return np.array(starts[:n], dtype=np.int32), np.array(stops, dtype=np.int32)[ends[:n]], digests


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [units_of(t) for t in b.column("text").to_pylist()]
        offsets = pa.array(np.cumsum([0, *(len(s) for s, _, _ in found)]), pa.int32())
        halves = np.frombuffer(b"".join(d for _, _, d in found), dtype=">i8").astype(np.int64).reshape(-1, 2)
        flat = [np.concatenate([np.zeros(0, np.int32), *(f[k] for f in found)]) for k in (0, 1)] + [halves[:, 0], halves[:, 1]]
        lists = [pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(x))) for x in flat]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), *lists], names=["doc_id", "text_hash", "starts", "stops", "high", "low"])


def repeats(docs: DataFrame) -> DataFrame:
    """The units to remove: doc_id, text_hash, start, stop, high and low (the halves of the digest) and of the one that is kept kept_doc_id, kept_start."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.filter("text <> ''").select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    made = texts.mapInArrow(_extract, f"doc_id {kind}, text_hash long, starts array<int>, stops array<int>, high array<long>, low array<long>")
    held = cut(made.withColumn("row", F.monotonically_increasing_id()), "dedup-units")
    twice = cut(held.select(F.explode("high").alias("high")).groupBy("high").agg(F.count("*").alias("n")).filter("n > 1").select("high"), "dedup-twice")
    flat = held.select("row", F.explode(F.arrays_zip("high", "low", "starts", "stops")).alias("u")).select("row", "u.high", "u.low", F.col("u.starts").alias("start"), F.col("u.stops").alias("stop"))
    found = cut(flat.join(twice, "high"), "dedup-candidates")
    # of rows that repeat an id and a text one stands for all
    rows = cut(held.groupBy("doc_id", "text_hash").agg(F.min("row").alias("row")), "dedup-rows")
    ranked = cut(found.join(rows, "row").withColumn("rank", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "start", "stop")), "dedup-ranked")
    firsts = cut(ranked.groupBy("high", "low").agg(F.min("rank").alias("first"), F.max("rank").alias("last"), F.min_by("row", "rank").alias("first_row")).filter("first <> last").drop("last"), "dedup-firsts")
    # a text that repeats itself at once keeps the first occurrence whole
    later = ranked.join(firsts, ["high", "low"]).filter("row <> first_row OR start >= first.stop")
    return later.select("doc_id", "text_hash", "start", "stop", "high", "low", F.col("first.doc_id").alias("kept_doc_id"), F.col("first.start").alias("kept_start"))


@F.pandas_udf(T.StringType())
def _without(texts: pd.Series, starts: pd.Series, stops: pd.Series) -> pd.Series:
    """texts without the stretches from starts (ascending) to stops."""

    def one(text, a, b):
        if a is None:
            return text
        kept, at = [], 0
        for x, y in zip(a, b, strict=True):
            kept.append(text[at:x])  # empty where stretches overlap
            at = max(at, y)
        return "".join([*kept, text[at:]])

    return pd.Series([one(t, a, b) for t, a, b in zip(texts, starts, stops, strict=True)], dtype=object)


def clean(docs: DataFrame) -> DataFrame:
    """docs with repeated units cut from their texts and n_chars, where it is there, counted anew.

    Rows are never dropped; a text of which nothing stays becomes empty."""
    spans = repeats(docs).groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__h")).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("__s"))
    spans = cut(spans.select("__id", "__h", F.col("__s.start").alias("__a"), F.col("__s.stop").alias("__b")), "dedup-spans")
    packed = docs.select(F.struct("*").alias("__row"), F.xxhash64("text").alias("__x"))
    joined = packed.join(spans, (F.col("__x") == F.col("__h")) & F.col("__row.doc_id").eqNullSafe(F.col("__id")), "left")
    out = joined.withColumn("__new", _without("__row.text", "__a", "__b"))
    fields = [F.col("__new").alias("text") if c == "text" else F.length("__new").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("__row")[c].alias(c) for c in docs.columns]
    return out.select(*fields)


def op2_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each removed unit, with its offsets in the original text."""
    digest = F.concat(*[F.lower(F.lpad(F.hex(c), 16, "0")) for c in ("high", "low")])
    return repeats(table(spark, sf_dir, "documents")).select("doc_id", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), digest.alias("digest"), "kept_doc_id", F.col("kept_start").cast("long").alias("kept_start"))

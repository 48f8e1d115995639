"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: its words (ASCII lower case, signs dropped), pairs of neighbours and pairs with one word between them, each hashed into
2^HASH_BITS coordinates; a coordinate is 1 if the text has the feature at all. Training is FTRL-proximal with a learning rate for each
coordinate and L1 and L2 terms; L1 leaves few weights that aren't 0, so the model is a small sorted table of coordinates and weights
(at most 2^HASH_BITS pairs, 12 MB) that is broadcast for scoring.

The model is fitted on a bounded sample: the TRAIN_ROWS labelled ids with the least hash among those whose crc32(doc_id) mod FOLDS isn't HELD,
one row of each and TRAIN_BYTES of text at most.
Features are extracted where the rows are, as coordinate arrays; one task of that bounded size trains. Every document is scored over its whole text.

Edge cases: a null or wordless text has no features and gets the score of the bias; without labelled rows (or an empty table) the bias
alone scores, under 0.5; a null label is left out; of several labels of an id the largest counts; rows that repeat an id are scored each
and one of them is trained on; a null doc_id is scored, counts as held out, and is never trained on; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, table, training_sample
from .decontaminate import words_of

HASH_BITS = 20
TRAIN_ROWS, TRAIN_BYTES = 15_000, 256 << 20
FOLDS, HELD = 5, 0
#: Words whose hashes a worker holds.
CACHE_WORDS = 400_000


@dataclass(frozen=True)
class Params:
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 12.0
    l2: float = 0.0
    epochs: int = 6


class Features:
    def __init__(self) -> None:
        self.cache: dict[bytes, int] = {}

    def __call__(self, text: str | None, wanted: np.ndarray | None = None) -> np.ndarray:
        """The distinct coordinates of a text, ascending; only those that wanted marks, if given."""
        words = words_of(text)
        if not words:
            return np.zeros(0, dtype=np.int64)
        cache = self.cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        for w in set(words).difference(cache):
            cache[w] = xxhash.xxh64_intdigest(w)
        h = np.array(list(map(cache.__getitem__, words)), dtype=np.uint64)
        near, far = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
        mix, down = np.uint64(0xD6E8FEB86659FD93), np.uint64(64 - HASH_BITS)
        pairs = (h[:-1] * near + h[1:] * far + np.uint64(1), h[:-2] * near + h[2:] * far + np.uint64(2))
        at = np.concatenate([(x ^ (x >> np.uint64(29))) * mix >> down for x in (h, *pairs)]).astype(np.int64)
        return np.unique(at if wanted is None else at[wanted[at]])


def train(rows: list[tuple[int, np.ndarray]], p: Params = Params()) -> tuple[float, np.ndarray, np.ndarray]:
    """bias, coordinates and weights from (label, coordinates) rows, in the order given."""
    z, n = np.zeros(1 << HASH_BITS), np.zeros(1 << HASH_BITS)
    positive = sum(y for y, _ in rows)
    bias = math.log((positive + 1) / (len(rows) - positive + 20))
    bias_n = 0.0

    def weights(at: np.ndarray) -> np.ndarray:
        za = z[at]
        return np.where(np.abs(za) <= p.l1, 0.0, -(za - np.sign(za) * p.l1) / ((p.beta + np.sqrt(n[at])) / p.alpha + p.l2))

    for _ in range(p.epochs if rows else 0):
        for y, at in rows:
            w = weights(at)
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, bias + float(w.sum()))))) - y
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / p.alpha * w
            n[at] = grown
            bias_n += g * g
            bias -= 0.05 * g / (1 + math.sqrt(bias_n))
    at = np.flatnonzero(np.abs(z) > p.l1)
    return bias, at, weights(at)


def fit(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> tuple[float, np.ndarray, np.ndarray]:
    """Trains in one task on the bounded sample and brings the sparse weights to the driver."""
    picked = training_sample(docs, labels, "toxic", FOLDS, HELD, TRAIN_ROWS, TRAIN_BYTES)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for b in batches:
            blobs = [features(t.as_py()).astype("<u4").tobytes() for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(blobs, pa.binary())], names=["rank", "y", "x"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r["rank"], r["y"], r["x"]) for b in batches for r in b.to_pylist())
        bias, at, w = train([(y, np.frombuffer(x, dtype="<u4").astype(np.int64)) for _, y, x in rows], p)
        yield pa.RecordBatch.from_arrays([pa.array([bias]), pa.array([at.astype("<u4").tobytes()]), pa.array([w.astype("<f8").tobytes()])], names=["bias", "at", "w"])

    x = picked.mapInArrow(extract, "rank long, y int, x binary").repartition(1)
    model = x.mapInArrow(learn, "bias double, at binary, w binary").collect()
    if not model:
        return train([], p)
    return model[0]["bias"], np.frombuffer(model[0]["at"], dtype="<u4").astype(np.int64), np.frombuffer(model[0]["w"], dtype="<f8")


def score(docs: DataFrame, model: tuple[float, np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id and score of every document, over its whole text."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, at, w = held.value
        weight, wanted = np.zeros(1 << HASH_BITS), np.zeros(1 << HASH_BITS, dtype=bool)
        weight[at], wanted[at] = w, True
        features = Features()
        for b in batches:
            total = np.array([bias + weight[features(t.as_py(), wanted)].sum() for t in b.column(1)], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD, F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

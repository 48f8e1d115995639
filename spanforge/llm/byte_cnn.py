"""Quality by a byte-level convolutional network in numpy.

Every filter is a set of tables, one for each of WIDTH neighbouring bytes, whose entries are summed (a convolution over one-hot bytes)
and rectified. A text is covered by chunks of CHUNK bytes that overlap by OVERLAP, from its first byte to its last; each filter is
max-pooled over a chunk. The chunk values are combined over the whole text by their mean and their maximum, and a hidden layer and an output
unit make one probability of them.

Training (Adam on the log loss; the gradient passes through the maxima only) runs in one task on a bounded sample: the TRAIN_ROWS labelled
ids with the least hash among those whose crc32(doc_id) mod FOLDS isn't HELD, one row of each and TRAIN_BYTES of text at most. Training and
scoring cover whole texts, every chunk at every byte position. The model has a fixed size (under 200 kB) and is broadcast.

Edge cases: a null or empty text is one chunk of zero bytes, as short texts are padded with them; without labelled rows every score is 0.5; a
null label is left out; of several labels of an id the largest counts; rows that repeat an id are scored each and one of them is trained on; a null doc_id is
scored, counts as held out, and is never trained on; extra columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, table, training_sample

WIDTH, FILTERS, HIDDEN = 6, 16, 16
CHUNK, OVERLAP = 512, 64
TRAIN_ROWS, TRAIN_BYTES, EPOCHS, BATCH, RATE = 3000, 32 << 20, 6, 32, 0.008
FOLDS, HELD = 3, 1
#: Texts are convolved in runs of this many bytes, a whole number of chunk steps.
RUN = (CHUNK - OVERLAP) * 256
#: Chunks that are convolved together in training.
TOGETHER = 128


@dataclass
class Model:
    tables: np.ndarray  # WIDTH, 256, FILTERS
    bias: np.ndarray
    hidden: np.ndarray  # 2 * FILTERS, HIDDEN
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray


def fresh(seed: int = 7) -> Model:
    r = np.random.default_rng(seed)
    return Model(r.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), r.normal(0, 0.2, (2 * FILTERS, HIDDEN)).astype(np.float32), np.zeros(HIDDEN, np.float32), np.zeros(HIDDEN, np.float32), np.zeros(1, np.float32))


def as_bytes(text: str | None) -> np.ndarray:
    """The bytes of a text, padded to whole chunk steps."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    step = CHUNK - OVERLAP
    n = max(1, -(-max(0, len(raw) - OVERLAP) // step))
    return np.frombuffer(raw.ljust(n * step + OVERLAP, b"\0"), dtype=np.uint8)


def starts_of(x: np.ndarray) -> np.ndarray:
    return np.arange(0, len(x) - OVERLAP, CHUNK - OVERLAP)


def convolve(m: Model, chunks: np.ndarray) -> np.ndarray:
    """chunks (n, CHUNK) to (n, positions, FILTERS), before bias and rectification."""
    positions = CHUNK - WIDTH + 1
    out = m.tables[0][chunks[:, :positions]]
    for k in range(1, WIDTH):
        out += m.tables[k][chunks[:, k : k + positions]]
    return out


def strongest(m: Model, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each filter is largest in each chunk, and how large, before bias and rectification."""
    at, top = [], []
    for a in range(0, len(chunks), TOGETHER):
        conv = convolve(m, chunks[a : a + TOGETHER])
        at.append(conv.argmax(axis=1))
        top.append(np.take_along_axis(conv, at[-1][:, None, :], axis=1)[:, 0])
    return np.concatenate(at), np.concatenate(top)


def head(m: Model, pooled: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pooled chunk values, and where each text's chunks start, to features, hidden values and probabilities."""
    counts = np.diff(np.append(rows, len(pooled)))[:, None]
    x = np.concatenate([np.add.reduceat(pooled, rows, axis=0) / counts, np.maximum.reduceat(pooled, rows, axis=0)], axis=1)
    h = np.maximum(x @ m.hidden + m.hidden_bias, 0)
    return x, h, 1 / (1 + np.exp(-np.clip(h @ m.out + m.out_bias, -35, 35)))


class Scorer:
    """Scores whole texts; pairs of bytes are looked up at once."""

    def __init__(self, m: Model):
        self.m = m
        pair = np.arange(1 << 16)
        self.pairs = [np.ascontiguousarray(m.tables[k][pair & 255] + m.tables[k + 1][pair >> 8]) for k in range(0, WIDTH, 2)]

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """Max-pooled, rectified filters of every chunk of padded bytes."""
        out = []
        for a in range(0, len(x) - OVERLAP, RUN):
            part = x[a : a + RUN + OVERLAP]
            n = len(part) - WIDTH + 1
            two = part[:-1].astype(np.uint16) | part[1:].astype(np.uint16) << 8
            conv = self.pairs[0].take(two[:n], axis=0)
            for k in range(1, WIDTH // 2):
                conv += self.pairs[k].take(two[2 * k : 2 * k + n], axis=0)
            at = np.arange(0, len(part) - OVERLAP, CHUNK - OVERLAP)
            bounds = np.stack([at, np.minimum(at + CHUNK - WIDTH + 1, n)], axis=1).ravel()
            # reduceat takes every second slice; the last one ends at n
            conv = np.concatenate([conv, conv[-1:]])
            out.append(np.maximum.reduceat(conv, bounds, axis=0)[::2])
        return np.maximum(np.concatenate(out) + self.m.bias, 0)

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        pooled = [self.pooled(as_bytes(t)) for t in texts]
        if not pooled:
            return np.zeros(0)
        sizes = [len(p) for p in pooled]
        return head(self.m, np.concatenate(pooled), np.cumsum([0, *sizes[:-1]]))[2].astype(np.float64)


def gradient(m: Model, texts: list[np.ndarray], labels: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean weighted log loss of texts, each given as its chunks (n, CHUNK)."""
    chunks = np.concatenate(texts)
    sizes = np.array([len(t) for t in texts])
    at, raw = strongest(m, chunks)
    raw = raw + m.bias
    pooled = np.maximum(raw, 0)
    rows = np.cumsum(sizes) - sizes
    x, h, p = head(m, pooled, rows)
    d = ((p - labels) * weight / len(texts)).astype(m.out.dtype)
    g = {"out": h.T @ d, "out_bias": d.sum(keepdims=True)}
    dh = np.outer(d, m.out) * (h > 0)
    g["hidden"], g["hidden_bias"] = x.T @ dh, dh.sum(axis=0)
    dx = dh @ m.hidden.T
    which = np.repeat(np.arange(len(texts)), sizes)
    top = (pooled == x[which, FILTERS:]).astype(m.out.dtype)
    top /= np.add.reduceat(top, rows, axis=0)[which]  # chunks that share the maximum share its gradient
    dp = (dx[which, :FILTERS] / sizes[which, None] + dx[which, FILTERS:] * top) * (raw > 0)
    g["bias"] = dp.sum(axis=0)
    g["tables"] = np.zeros_like(m.tables)
    row, col = np.nonzero(dp)
    start = at[row, col]
    for k in range(WIDTH):
        np.add.at(g["tables"][k], (chunks[row, start + k], col), dp[row, col])
    return g


def train(texts: list[str | None], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Model:
    m = fresh(seed)
    if not texts:
        return m
    r = np.random.default_rng(seed)
    data = []
    for t in texts:
        x = as_bytes(t)
        data.append(np.stack([x[a : a + CHUNK] for a in starts_of(x)]))
    rate = labels.mean()
    m.out_bias[:] = np.log((rate + 0.01) / (1.01 - rate))
    m.out[:] = r.normal(0, 0.2, HIDDEN)
    weight = np.where(labels == 1, 0.5 / max(rate, 0.05), 0.5 / max(1 - rate, 0.05)) ** 0.5
    names = ["tables", "bias", "hidden", "hidden_bias", "out", "out_bias"]
    first, second = {k: np.zeros_like(getattr(m, k)) for k in names}, {k: np.zeros_like(getattr(m, k)) for k in names}
    step = 0
    for epoch in range(epochs):
        order = r.permutation(len(data))
        for a in range(0, len(order), BATCH):
            own = order[a : a + BATCH]
            g = gradient(m, [data[i] for i in own], labels[own], weight[own])
            step += 1
            pace = RATE * (1 - 0.9 * epoch / epochs)
            for k in names:
                first[k] = 0.9 * first[k] + 0.1 * g[k]
                second[k] = 0.999 * second[k] + 0.001 * g[k] ** 2
                getattr(m, k)[...] -= pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-7)
    return m


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Trains in one task on the bounded sample and brings the model, of fixed size, to the driver."""
    picked = training_sample(docs, labels, "quality", FOLDS, HELD, TRAIN_ROWS, TRAIN_BYTES)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(((r["rank"], r["y"], r["text"]) for b in batches for r in b.to_pylist()), key=lambda r: (r[0], r[1]))
        m = train([t for _, _, t in rows], np.array([y for _, y, _ in rows], dtype=np.float32))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(m)], pa.binary())], names=["model"])

    model = picked.repartition(1).mapInArrow(learn, "model binary").collect()
    return pickle.loads(model[0]["model"]) if model else fresh()


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every document, over its whole text."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scorer(b.column(1).to_pylist()))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def op10_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD, F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

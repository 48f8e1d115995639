import math
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from spanforge.llm import byte_cnn as B
from spanforge.llm import toxicity as X
from spanforge.llm.common import training_sample


def labelled(spark, make, bad, n=400):
    r = random.Random(4)
    words = [f"{a}{b}" for a in "bcdfgl" for b in ("an", "er", "in", "ot")]
    texts, marks = [], []
    for i in range(n):
        t = [r.choice(words) for _ in range(r.randint(20, 120))]
        y = i % 3 == 0
        if y:
            for _ in range(4):
                t.insert(r.randrange(len(t)), r.choice(bad))
        texts.append(" ".join(t))
        marks.append(int(y))
    docs = make([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)])
    return docs, spark.createDataFrame([(i, 1 - y, y) for i, y in enumerate(marks)], "doc_id long, quality int, toxic int"), marks


def test_toxicity_on_held_out_rows(spark, make):
    docs, labels, marks = labelled(spark, make, ["vile", "nasty"])
    out = X.score(docs, X.fit(docs, labels)).withColumn("held", X.fold(F.col("doc_id"), X.FOLDS) == X.HELD).collect()
    held = [(r["score"] >= 0.5) == marks[r["doc_id"]] for r in out if r["held"]]
    assert len(held) > 40 and np.mean(held) > 0.95


def test_quality_on_held_out_rows(spark, make, monkeypatch):
    docs, labels, marks = labelled(spark, make, ["|", "%%%"])
    out = B.score(docs, B.fit(docs, labels)).withColumn("held", X.fold(F.col("doc_id"), B.FOLDS) == B.HELD).collect()
    held = [(r["score"] >= 0.5) == (marks[r["doc_id"]] == 0) for r in out if r["held"]]
    assert len(held) > 80 and np.mean(held) > 0.9


def test_both_forms_of_the_convolution_agree():
    r = np.random.default_rng(0)
    m = B.fresh()
    for n in (0, 1, 63, 64, 65, 447, 448, 511, 512, 513, 960, 961, 5000, B.RUN + 64, B.RUN + 65, 2 * B.RUN + 77):
        x = B.as_bytes("".join(chr(c) for c in r.integers(32, 127, n)))
        chunks = np.stack([x[a : a + B.CHUNK] for a in B.starts_of(x)])
        want = np.maximum(np.concatenate([B.convolve(m, chunks[i : i + 64]).max(axis=1) for i in range(0, len(chunks), 64)]) + m.bias, 0)
        assert np.allclose(B.Scorer(m).pooled(x), want, atol=1e-5), n


def test_training_gradient_moves_towards_labels():
    texts = ["aaaa " * 40, "zzzz " * 40] * 20
    m = B.train(texts, np.array([1, 0] * 20, dtype=np.float32), epochs=40)
    p = B.Scorer(m)(["aaaa " * 40, "zzzz " * 40])
    assert p[0] > 0.8 and p[1] < 0.2


def test_odd_rows_and_no_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    few = spark.createDataFrame([(1, None, None), (3, 1, 0), (3, 0, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, few):
        a, b = X.score(odd, X.fit(odd, labels)), B.score(odd, B.fit(odd, labels))
        assert a.count() == b.count() == odd.count()
        assert a.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0
        assert b.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert X.score(odd, X.fit(odd, none)).filter("score >= 0.5").count() == 0
    assert X.score(odd.filter("false"), X.train([])).count() == 0


def test_the_sample_is_bounded(spark, make):
    """Repeated rows of an id count once, and texts that don't fit are left out whole."""
    docs = make([(1, "some text", "en", "s", 9)] * 500 + [(i, "x" * 100, "en", "s", 1) for i in range(2, 40)] + [(40, "y" * 100_000, "en", "s", 1), (41, None, "en", "s", 0)]).withColumn("rank", F.lit("mine")).withColumn("y", F.lit(3))
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 42)], "doc_id long, quality int, toxic int")
    wanted = {i for i in range(1, 42) if zlib.crc32(str(i).encode()) % 3 != 1}
    rows = training_sample(docs, labels, "quality", 3, 1, 1000, 1 << 21).collect()
    assert len(rows) == len(wanted)
    rows = training_sample(docs, labels, "quality", 3, 1, 1000, 2000).collect()
    assert 10 <= len(rows) < len(wanted) and sum(len(r["text"] or "") for r in rows) <= 2000
    assert len(training_sample(docs, labels, "quality", 3, 1, 7, 1 << 20).collect()) == 7


@pytest.mark.parametrize("long_id", range(1, 42, 4))
def test_a_long_text_costs_its_own_row_only(spark, make, long_id):
    """Wherever its hash puts it, in front of all others too."""
    docs = make([(i, "x" * 100 if i != long_id else "y" * 100_000, "en", "s", 1) for i in range(1, 42)])
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 42)], "doc_id long, quality int, toxic int")
    for label, folds, held in (("quality", 3, 1), ("toxic", 5, 0)):
        wanted = {i for i in range(1, 42) if zlib.crc32(str(i).encode()) % folds != held} - {long_id}
        assert training_sample(docs, labels, label, folds, held, 1000, 50_000).count() == len(wanted)


def test_ftrl_by_plain_arithmetic():
    """The update written out for one coordinate at a time, as published, beside the vectorised one."""
    r = random.Random(3)
    rows = [(r.random() < 0.4, np.array(sorted(r.sample(range(30), r.randint(0, 8))), dtype=np.int64)) for _ in range(200)]
    rows = [(int(y), x) for y, x in rows]
    p = X.Params(alpha=0.5, beta=1.0, l1=0.3, l2=0.1, epochs=2)
    z, n = [0.0] * 30, [0.0] * 30
    positive = sum(y for y, _ in rows)
    bias, bias_n = math.log((positive + 1) / (len(rows) - positive + 20)), 0.0

    def weight(i):
        if abs(z[i]) <= p.l1:
            return 0.0
        return -(z[i] - math.copysign(p.l1, z[i])) / ((p.beta + math.sqrt(n[i])) / p.alpha + p.l2)

    for _ in range(p.epochs):
        for y, at in rows:
            w = {i: weight(i) for i in at.tolist()}
            g = 1 / (1 + math.exp(-(bias + sum(w.values())))) - y
            for i in w:
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / p.alpha
                z[i] += g - sigma * w[i]
                n[i] += g * g
            bias_n += g * g
            bias -= 0.05 * g / (1 + math.sqrt(bias_n))
    got_bias, at, w = X.train(rows, p)
    assert abs(got_bias - bias) < 1e-9 and at.tolist() == [i for i in range(30) if abs(z[i]) > p.l1]
    assert np.allclose(w, [weight(i) for i in at])


def test_features_by_brute_force():
    f = X.Features()
    for text in (None, "", "a", "a b", "The cat, the CAT sat on a mat.", "x " * 500):
        words = X.words_of(text)
        h = [xxhash.xxh64_intdigest(w) for w in words]
        m = (1 << 64) - 1
        raw = h + [(a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F + k) & m for k in (1, 2) for a, b in zip(h, h[k:])]
        assert f(text).tolist() == sorted({((x ^ x >> 29) * 0xD6E8FEB86659FD93 & m) >> 64 - X.HASH_BITS for x in raw})


def test_gradient_by_differences():
    """The gradient against finite differences of the loss."""
    texts, labels = ["abc " * 300, "xyz", "some other words " * 40], np.array([1, 0, 1], dtype=np.float32)
    m = B.fresh()
    for k in vars(m):
        setattr(m, k, getattr(m, k).astype(np.float64))
    m.out_bias[:] = 0.1
    m.out[:] = np.random.default_rng(1).normal(0, 0.5, B.HIDDEN)
    data = [np.stack([B.as_bytes(t)[a : a + B.CHUNK] for a in B.starts_of(B.as_bytes(t))]) for t in texts]
    weight = np.ones(3)

    def loss():
        sizes = np.array([len(d) for d in data])
        _, top = B.strongest(m, np.concatenate(data))
        p = B.head(m, np.maximum(top + m.bias, 0), np.cumsum(sizes) - sizes)[2]
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    grads = B.gradient(m, data, labels, weight)
    r = np.random.default_rng(2)
    for k in ("out", "out_bias", "hidden", "hidden_bias", "bias", "tables"):
        x = getattr(m, k)
        flat = np.flatnonzero(grads[k].ravel()) if k == "tables" else np.arange(x.size)
        for i in r.choice(flat, min(6, len(flat)), replace=False):
            keep, e = x.flat[i], 1e-5
            x.flat[i] = keep + e
            up = loss()
            x.flat[i] = keep - e
            down = loss()
            x.flat[i] = keep
            assert abs((up - down) / (2 * e) - grads[k].flat[i]) < 1e-5, k

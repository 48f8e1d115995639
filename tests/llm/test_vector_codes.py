import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from spanforge.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<double>, label int"


def by_hand(rows):
    """vec_id, code, error, label_error and the codebooks' digest, by full comparison."""
    kept = [(i, [math.floor(1024 * c) for c in v], k) for i, v, k in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    size = len(kept[0][1]) // 4
    seeds = sorted(kept, key=lambda r: (r[0] is None, r[0], r[1]))[:256]
    parts = [np.array([x[p * size : (p + 1) * size] for _, x, _ in kept]) for p in range(4)]
    books = [np.array([x[p * size : (p + 1) * size] for _, x, _ in seeds]) for p in range(4)]
    near = lambda p: ((parts[p][:, None, :] - books[p][None]) ** 2).sum(axis=2)
    for _ in range(4):
        for p in range(4):
            own = near(p).argmin(axis=1)
            for e in range(len(seeds)):
                if (own == e).any():
                    mine = parts[p][own == e]
                    books[p][e] = [int(s) // len(mine) for s in mine.sum(axis=0)]
    codes = [near(p).argmin(axis=1) for p in range(4)]
    errors = sum(near(p).min(axis=1) for p in range(4))
    by = defaultdict(int)
    for (_, _, k), e in zip(kept, errors):
        by[k] += int(e)
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()
    return sorted((str(i), "".join(f"{c[j]:02x}" for c in codes), int(errors[j]), by[k], digest) for j, (i, _, k) in enumerate(kept))


def run(df):
    coded, books = V.encode(df)
    out = V.with_label_error(V.cut(coded, "test-codes"))
    return sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"], V.fingerprint(books)) for r in out.collect())


def test_query_by_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in V.op13_vector_codes(spark, sf).collect())
    assert got == by_hand(rows)


def test_clusters_ties_and_odd_rows(spark):
    r = np.random.default_rng(5)
    centres = r.integers(-3, 4, size=(40, 8)) / 8
    rows = [(int(i), (centres[i % 40] + r.integers(0, 2, size=8) / 1024).tolist(), int(i) % 3) for i in range(700)]
    rows += [(5, rows[5][1], 1), (None, [0.0] * 8, None), (None, [-0.0001] * 8, None), (1000, None, 1), (1001, [None] + [0.0] * 7, 1), (1002, [float("nan")] * 8, 1), (1003, [float("-inf")] * 8, 1)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS x", "'c' AS code", "2 AS trees")
    assert run(df.repartition(3)) == by_hand(rows)


def test_few_and_strange_vectors(spark):
    make = lambda rows: spark.createDataFrame(rows, SCHEMA)
    assert run(make([])) == []
    assert [x[:4] for x in run(make([(1, [], 3), (2, [], None)]))] == [("1", "00000000", 0, 0), ("2", "00000000", 0, 0)]
    rows = [(1, [0.5, 1.0, 2.0, -3.25], 1), (2, [0.5, 1.0, 2.0, -3.25], None), (3, [1e6, -1e6, 3e5, 4e5], None)]
    assert run(make(rows)) == by_hand(rows)
    for bad in ([(1, [1.0] * 4, 1), (2, [1.0] * 8, 1)], [(1, [1.0] * 6, 1)]):
        with pytest.raises(ValueError, match="equal parts"):
            V.encode(make(bad))


@pytest.mark.parametrize("kind", [np.float64, object])
def test_trees_by_brute_force(kind):
    r = np.random.default_rng(2)
    for _ in range(60):
        reach, size = int(r.choice([2, 5, 50, 2000])), int(r.integers(1, 6))
        points = r.integers(-reach, reach + 1, size=(int(r.integers(1, 400)), size))
        book = r.integers(-reach, reach + 1, size=(int(r.integers(1, 40)), size))
        tree = V.Tree.unpacked(size, V.Tree.build(points).packed())
        codes, sums, counts = tree.assign(book, kind, each=True)
        want = ((points[:, None, :] - book[None]) ** 2).sum(axis=2).argmin(axis=1)
        total = np.zeros_like(book)
        np.add.at(total, want, points)
        assert (codes == want).all() and (counts == np.bincount(want, minlength=len(book))).all() and (sums == total).all()


def test_boxes_save_comparisons():
    """Far clusters: whole subtrees are assigned, so no leaf is compared point by point."""
    book = np.array([[0, 0], [10_000, 0], [0, 10_000], [10_000, 10_000]])
    points = np.repeat(book, 512, axis=0) + np.random.default_rng(1).integers(0, 9, size=(2048, 2))
    tree = V.Tree.build(points)
    tree.points = None  # only boxes, sums and counts are left
    assert tree.assign(book, np.float64, each=False)[2].tolist() == [512] * 4

import math

import numpy as np
import pytest

from spanforge.llm import whitening as Wh

SCHEMA = "vec_id long, embedding array<double>, label int"


def by_hand(vectors):
    """x, deviations, eigenvalues and components (columns) of plain lists."""
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for v in vectors])
    n, s = len(x), x.sum(axis=0)
    d = n * x - s
    e, u = np.linalg.eigh((d / n).T @ (d / n) / n)
    return d, (d.astype(object) ** 2).sum(axis=1), e[::-1], u[:, ::-1]


def test_against_plain_arithmetic(spark):
    r = np.random.default_rng(3)
    vectors = (r.normal(size=(300, 12)) * np.linspace(3, 0.2, 12)).tolist()
    rows = [(i, v, 0) for i, v in enumerate(vectors)] + [(900, None, 0), (901, [None] * 12, 0), (902, [float("nan")] * 12, 0), (903, [float("inf")] + [0.0] * 11, 0)]
    out = Wh.whiten(spark.createDataFrame(rows, SCHEMA)).toPandas()
    d, deviation, e, u = by_hand(vectors)
    assert len(out) == 300 * 8 and set(out["n"]) == {300}
    got = out.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    want = (d / 300) @ u[:, :8] / np.sqrt(e[:8])
    sign = np.sign((got * want).sum(axis=0))
    assert np.abs(got - want * sign).max() < 1e-9
    assert [int(x) for x in out[out.component == 1].sort_values("vec_id").deviation] == deviation.tolist()
    explained = out[out.vec_id == 0].sort_values("component").explained.to_numpy()
    assert np.abs(explained / (e[:8] / e.sum()) - 1).max() < 1e-9
    assert out.identity_error.nunique() == 1 and out.identity_error[0] < 1e-9


def test_query_over_its_table(spark, sf):
    from spanforge.llm.common import table

    vectors = [r["embedding"] for r in table(spark, sf, "embeddings").orderBy("vec_id").collect()]
    out = Wh.op12_whitening(spark, sf).toPandas()
    d, deviation, e, u = by_hand(vectors)
    got = out.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    want = (d / len(d)) @ u[:, :8] / np.sqrt(e[:8])
    assert np.abs(got - want * np.sign((got * want).sum(axis=0))).max() < 1e-8
    assert out[out.component == 1].sort_values("vec_id").deviation.tolist() == deviation.tolist()


def test_odd_tables(spark):
    make = lambda rows: spark.createDataFrame(rows, SCHEMA)
    assert Wh.whiten(make([])).count() == 0
    assert Wh.whiten(make([(1, [], 0), (2, None, 0)])).count() == 0
    assert Wh.whiten(make([(1, [1.0, 2.0], 0)] * 3)).count() == 0
    with pytest.raises(ValueError, match="entries"):
        Wh.whiten(make([(1, [1.0], 0), (2, [1.0, 2.0], 0)]))
    # one direction with variance, repeated rows, a null id, clashing columns
    rows = make([(1, [0.0, 1.0], 0), (1, [0.0, 1.0], 0), (None, [1.0, 1.0], 0)]).selectExpr("*", "1 AS x", "2 AS n", "3 AS w")
    out = Wh.whiten(rows).collect()
    assert len(out) == 3 and {r["component"] for r in out} == {1} and all(r["explained"] == pytest.approx(1) for r in out)
    assert sorted(abs(r["whitened"]) for r in out) == pytest.approx([math.sqrt(0.5), math.sqrt(0.5), math.sqrt(2)])


def test_large_deviations_are_exact(spark):
    rows = [(i, [float(v)], 0) for i, v in enumerate((-3e9, 1e9, 7e9))]
    out = {r["vec_id"]: int(r["deviation"]) for r in Wh.whiten(spark.createDataFrame(rows, SCHEMA)).collect()}
    x = [1024 * int(v) + 100_000 for v in (-3e9, 1e9, 7e9)]
    assert out == {i: (3 * v - sum(x)) ** 2 for i, v in enumerate(x)}

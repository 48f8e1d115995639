"""Whitening of embeddings by a distributed singular value decomposition.

Vectors become whole numbers, their sums are exact, and every row is centred as (n*x - S) / n, a whole number divided once, before MLlib
multiplies anything. RowMatrix.computeSVD then gives right singular vectors and singular values of the centred rows; an eigenvalue of the
covariance with divisor n is a squared singular value over n. All components are asked for, which makes MLlib decompose the summed products
of the rows (as many numbers as the square of the dimension) to double precision instead of iterating to a tolerance.

The total variance doesn't come from the singular values but from the rows' exact deviations, sums of (n*x - S)^2 in decimals, added up in
two halves so that no sum overflows. The whitened rows' covariance is computed a second time, centred by their own means, and its largest
distance from the identity is reported.

To the driver go counts, sums, means, covariances and components: their size follows from the dimension, never from the rows.

Edge cases: rows whose vector is null, or holds a null or non-finite entry, are dropped; a null vec_id keeps its row; repeated rows count as
often as they occur; vectors of different lengths are an error, and so is an entry too large for a long; empty vectors and an empty table
give no rows; a component without variance (its singular value under LEAST of the largest) is left out, so equal vectors
give no rows; equal eigenvalues leave the choice among their components open; extra columns are ignored. A deviation beyond a long is null in
op12_whitening; whiten() has it as a decimal.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, let, table

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Singular values below this share of the largest are rounding: squares of it are what summed products can hold.
LEAST = 1e-6
_HALF = 10**18


@dataclass(frozen=True)
class Fit:
    """n, sums of each dimension, eigenvalues (falling), components (a row each) and the trace of the covariance."""

    n: int
    sums: list[int]
    eigenvalues: list[float]
    components: np.ndarray
    trace: float


def usable(vector: str) -> Column:
    """Whether a vector has neither null nor non-finite entries."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.col(vector).isNotNull() & ~F.exists(F.col(vector).cast("array<double>"), bad)


def whole(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and x, the vector in whole numbers, of the usable rows."""
    to_long = lambda c: F.floor(c * float(SCALE)).cast("long") + SHIFT
    return rows.filter(usable(vector)).select(F.col(vec_id).alias("vec_id"), F.transform(F.col(vector).cast("array<double>"), to_long).alias("x"))


def literal(values: list, kind: str) -> Column:
    return F.lit(values).cast(f"array<{kind}>") if values else F.expr(f"cast(array() as array<{kind}>)")


def deviations(n: int, sums: list[int]) -> Column:
    """n*x - S for each dimension, exact."""
    kind = "long" if 2 * n * max((abs(s) for s in sums), default=0) < 2**62 else "decimal(38,0)"
    return F.zip_with(F.col("x"), literal([str(s) for s in sums], kind), lambda x, s: (F.lit(n).cast(kind) * x - s).cast(kind))


def squared(d: Column) -> Column:
    """The sum of squares, exact."""
    zero = F.lit(0).cast("decimal(38,0)")
    return F.aggregate(d, zero, lambda a, v: (a + v.cast("decimal(19,0)") * v.cast("decimal(19,0)")).cast("decimal(38,0)"))


def fit(x: DataFrame) -> Fit | None:
    """The components of x's rows (vec_id, x), a table; None without rows or dimensions."""
    shape = x.agg(F.count("*").alias("n"), F.min(F.size("x")).alias("lo"), F.max(F.size("x")).alias("hi")).first()
    if not shape["n"] or not shape["hi"]:
        return None
    if shape["lo"] != shape["hi"]:
        raise ValueError(f"vectors of {shape['lo']} and of {shape['hi']} entries")
    n, size = shape["n"], shape["hi"]
    by = x.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).collect()
    sums = [int(s) for _, s in sorted((r["i"], r["s"]) for r in by)]
    d = x.select(deviations(n, sums).alias("d"))
    halves = d.select(squared(F.col("d")).alias("q")).agg(F.sum(F.expr(f"q div {_HALF}").cast("decimal(38,0)")).alias("hi"), F.sum(F.expr(f"q % {_HALF}")).alias("lo")).first()
    trace = float((int(halves["hi"]) * _HALF + int(halves["lo"])) / n**3)  # whole numbers, divided once
    if not trace:
        return Fit(n, sums, [], np.zeros((0, size)), 0.0)
    centred = d.select(array_to_vector(F.transform("d", lambda v: v.cast("double") / float(n))).alias("v"))
    svd = RowMatrix(MLUtils.convertVectorColumnsFromML(centred, "v"), n, size).computeSVD(size, False, LEAST)
    values = [float(s) ** 2 / n for s in svd.s.toArray()]
    return Fit(n, sums, values, np.asarray(svd.V.toArray()).T, trace)


def identity_error(white: DataFrame, k: int) -> float:
    """The largest absolute entry of the covariance (divisor n, centred) of white.w, arrays of k, minus the identity."""
    at = lambda i: F.get("w", F.lit(i))
    means = white.agg(*[F.avg(at(i)).alias(f"m{i}") for i in range(k)]).first()
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    products = white.agg(*[F.avg((at(i) - means[i]) * (at(j) - means[j])).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(products[m] - (1.0 if i == j else 0.0)) for m, (i, j) in enumerate(pairs))


def whiten(rows: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error: a row for each usable row and component."""
    x = cut(whole(rows, vec_id, vector), "whitening-rows")
    found = fit(x)
    k = min(components, len(found.eigenvalues)) if found else 0
    if not k:
        parts = F.expr("cast(array() as array<struct<component:int,whitened:double,explained:double>>)")
        return x.select("vec_id", F.explode(parts).alias("p"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("decimal(38,0)").alias("deviation"), F.lit(0.0).alias("identity_error")).select("vec_id", "p.component", "n", "deviation", "p.whitened", "p.explained", "identity_error")

    def projected(d: Column) -> Column:
        """The centred row on each component, over the root of its eigenvalue."""
        axes = [literal([float(c) for c in (found.components[i] / np.sqrt(found.eigenvalues[i]))], "double") for i in range(k)]
        dot = lambda a: F.aggregate(F.zip_with(d, a, lambda v, c: v.cast("double") / float(found.n) * c), F.lit(0.0), lambda s, v: s + v)
        return F.struct(F.array(*[dot(a) for a in axes]).alias("w"), squared(d).alias("deviation"))

    white = cut(x.select("vec_id", let(deviations(found.n, found.sums), projected).alias("p")).select("vec_id", "p.w", "p.deviation"), "whitening-projected")
    error = identity_error(white, k)
    explained = literal([e / found.trace for e in found.eigenvalues[:k]], "double")
    out = white.select("vec_id", "deviation", F.posexplode("w").alias("i", "whitened"))
    return out.select("vec_id", (F.col("i") + 1).cast("int").alias("component"), F.lit(found.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("i")).alias("explained"), F.lit(error).alias("identity_error"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))

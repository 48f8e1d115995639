"""Shared helpers: durable intermediate tables, distributed prefix sums, let-bindings, text tokens."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: ASCII white space, the separators of words in several contracts.
SPACE = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir. Only a local session without the setting gets a temporary one."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not d:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = "file://" + os.path.join(tempfile.gettempdir(), "spanforge-" + spark.sparkContext.applicationId)
    return d.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: ends the lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/spanforge/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, wherever body uses it."""
    return F.transform(F.array(value), body).getItem(0)


def running_totals(df: DataFrame, keys: list[str], order: str, value: str, out: str, width: int = 512, levels: int = 3) -> DataFrame:
    """Exclusive running sum of value over the integer column order (unique within keys), added as out.

    Blocks of width consecutive order values are summed first, so no task gets more than a block, or the block totals of a key
    divided by width at each level; the top level alone is one window for each key."""
    if levels == 1:
        w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
        return df.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0).cast("long")))
    b, base = f"__b{levels}", f"__base{levels}"
    blocked = df.withColumn(b, F.floor(F.col(order) / width).cast("long"))
    sums = blocked.groupBy(*keys, b).agg(F.sum(value).alias(f"__v{levels}"))
    sums = running_totals(sums, keys, b, f"__v{levels}", base, width, levels - 1).drop(f"__v{levels}")
    w = W.partitionBy(*keys, b).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    local = blocked.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0).cast("long")))
    return local.join(sums, [*keys, b]).withColumn(out, F.col(out) + F.col(base)).drop(b, base)


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


#: A text of a training sample has at most this part of the sample's bytes.
LONGEST_SHARE = 16


def fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def training_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, rows: int, size: int) -> DataFrame:
    """rank, y and text of the rows to train on: one for each of the rows labelled ids with the least hash among those whose fold isn't held,
    as many of them, by hash, as have size bytes of text together. A text of more than size / LONGEST_SHARE bytes is left out by itself, so no
    single text shuts out those behind it.

    A null label is left out; of several labels of an id the largest counts; of several rows of an id the one with the least hash is taken."""
    marked = labels.groupBy("doc_id").agg(F.max(label).alias("y")).filter("y IS NOT NULL AND doc_id IS NOT NULL").filter(fold(F.col("doc_id"), folds) != held)
    sample = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("rank")).join(F.broadcast(sample), "doc_id")
    one = found.groupBy("doc_id").agg(F.min("rank").alias("rank"), F.min_by(F.coalesce(F.octet_length("text"), F.lit(0)), "rank").cast("long").alias("bytes"))
    fits = one.filter(F.col("bytes") <= size // LONGEST_SHARE).withColumn("upto", F.sum("bytes").over(W.orderBy("rank", "doc_id"))).filter(F.col("upto") <= size).select("doc_id", "rank")  # of at most rows ids
    return found.join(F.broadcast(fits), ["doc_id", "rank"]).dropDuplicates(["doc_id"]).select("rank", F.col("y").cast("int").alias("y"), "text")

"""From raw documents to packed training sequences: each stage works on all rows that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next stage's docs. All
but the last return the columns of documents:

1. quality_rules drops documents that the base rules or a certified threshold reject;
2. simhash_near_dedup keeps the document with the least id of every near-duplicate group;
3. substring_dedup cuts repeated lines and sentences out of the texts, keeping their first occurrence;
4. decontamination drops documents in which a window of a benchmark item occurs;
5. packing lays the ids of what is left into full windows at the sources' target proportions.

Null and empty texts fail the quality rules; rows without a doc_id pass through stages 1 to 5 as far as their text lets them; an empty
table gives empty tables; further columns of documents are carried along to packing, which ignores them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanforge.llm import decontaminate, packing, quality_rules, simhash, unit_dedup
from spanforge.llm.common import cut, table

#: SQL can't express the second and the last stage (XXH64 fingerprints, byte-pair ids); tests hold the pipeline against brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.representatives(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return unit_dedup.clean(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, with_ids=False)


STAGES = [
    ("quality_rules", quality_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the pieces of the last, without their ids' bytes."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

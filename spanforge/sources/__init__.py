"""Sources and sinks: request tables, policies and detector manifests, labelled cases, safe logs and reports."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanforge.operators.core import CombinationRule, Policy
from spanforge.operators.detectors import NATIVE, REGISTERED, RegexDetector

_S = T.StringType()
SCHEMAS: dict[str, T.StructType] = {
    "process": T.StructType([T.StructField("payload", _S), T.StructField("payload_id", _S)]),
    "mask": T.StructType([T.StructField("text", _S), T.StructField("consumer", _S), T.StructField("context_id", _S)]),
    "unmask": T.StructType([T.StructField("masked_text", _S), T.StructField("consumer", _S), T.StructField("context_id", _S)]),
    "chat": T.StructType([T.StructField("masked_text", _S), T.StructField("consumer", _S), T.StructField("context_id", _S), T.StructField("provider", _S)]),
    "restore": T.StructType([T.StructField("response", _S), T.StructField("consumer", _S), T.StructField("context_id", _S)]),
    "cases": T.StructType([T.StructField("cases", T.ArrayType(T.StructType([T.StructField("id", _S), T.StructField("detector", _S), T.StructField("tier", _S), T.StructField("family", _S), T.StructField("text", _S), T.StructField("sensitive", T.ArrayType(_S)), T.StructField("gold", T.ArrayType(T.StructType([T.StructField("category", _S), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", _S)])))])))]),
}
LOG_FIELDS = ("ts", "event", "operation", "status", "duration_ms", "counts", "policy_version", "error_code")


def requests(spark: SparkSession, path: str, kind: str = "process", stream: bool = False) -> DataFrame:
    """JSON-lines requests of a kind, with its fixed schema, in batch or as a stream."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(SCHEMAS[kind]).json(path)


def policies(config: Mapping[str, Any]) -> dict[str, Policy]:
    """Validated consumer policies of a parsed configuration; unknown keys and actions that aren't strings are errors."""
    out = {}
    for name, raw in config["consumers"].items():
        raw = dict(raw)
        rules = tuple(CombinationRule(r["id"], r["target_type"], r["requires_type"], r.get("action_if_absent", "keep")) for r in raw.pop("combination_rules", ()))
        raw.pop("synthetic_only", None)
        raw.pop("api_key_env", None)
        out[name] = Policy(name=name, combination_rules=rules, **raw)
    return out


def policy_versions(spark: SparkSession, versions: Sequence[tuple[str, Mapping[str, Any]]]) -> DataFrame:
    """Versioned dimension table of policies, the last version current; each version is validated as a whole before it counts."""
    rows = [(i, v, p.name, p.namespace, p.enabled, p.detect_types, p.default_action, p.allow_unmask, p.allow_llm_egress) for i, (v, c) in enumerate(versions) for p in policies(c).values()]
    df = spark.createDataFrame(rows, "ord int, version string, name string, namespace string, enabled boolean, detect_types string, default_action string, allow_unmask boolean, allow_llm_egress boolean")
    return df.withColumn("current", F.col("ord") == len(versions) - 1)


def detectors(manifest: Mapping[str, Any]) -> list[str | RegexDetector]:
    """Detectors of a parsed manifest in its order; disabled ones are left out, an unknown id is an error."""
    from spanforge.operators.names import ARROW

    out: list[str | RegexDetector] = []
    for d in manifest["detectors"]:
        if not d.get("enabled", True):
            continue
        if d.get("type") == "regex":
            out.append(RegexDetector(d["id"], d["category"], d["pattern"], d.get("context"), d.get("context_window", 40)))
        elif d["id"] in NATIVE or d["id"] in ARROW or d["id"] in REGISTERED:
            out.append(d["id"])
        else:
            raise ValueError(f"unknown detector: {d['id']}")
    return out


def manifest_version(manifest: Mapping[str, Any]) -> str:
    return str(manifest.get("detector_manifest_version", "unknown"))


def verify_files(spark: SparkSession, expected: Mapping[str, str]) -> DataFrame:
    """path, sha256, ok of files against their expected digests."""
    want = spark.createDataFrame(list(expected.items()), "path string, expected string")
    got = spark.read.format("binaryFile").load(list(expected)).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.sha2("content", 256).alias("sha256"))
    return want.join(got, "path", "left").select("path", "sha256", (F.col("sha256") == F.col("expected")).alias("ok"))


def cases(spark: SparkSession, path: str) -> DataFrame:
    """Labelled cases, one a row; gold spans have to be ordered, disjoint and true to their texts."""
    c = spark.read.schema(SCHEMAS["cases"]).option("multiLine", True).json(path).select(F.explode("cases").alias("c")).select("c.*")
    bad = F.exists("gold", lambda g: F.substring(F.col("text"), g["start"] + 1, g["end"] - g["start"]) != g["text"])
    order = F.exists(F.transform("gold", lambda g, i: (i > 0) & (g["start"] < F.get("gold", i - 1)["end"])), lambda x: F.coalesce(x, F.lit(False)))
    return c.withColumn("gold", F.when(F.coalesce(bad | order, F.lit(False)), F.raise_error(F.lit("gold spans out of order or not true to the text")).cast(c.schema["gold"].dataType)).otherwise(F.col("gold")))


def safe_log(rows: DataFrame, path: str) -> None:
    """Only allow-listed fields, as JSON lines."""
    keep = [c for c in LOG_FIELDS if c in rows.columns]
    rows.select(F.to_json(F.struct(*keep)).alias("value")).write.mode("append").text(path)


def report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def file_sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def to_record(row: Mapping[str, Any]) -> str:
    return json.dumps(row, ensure_ascii=False, sort_keys=True)

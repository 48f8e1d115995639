"""Consumer policies as a versioned dimension: every row follows the version of its consumer that is in force at its time.

A dimension has a row for each consumer and version with the time from which it holds; the next version's time ends it. Categories, action,
namespace and combination rules are columns, so rows of many consumers and versions are masked by one plan with one scan. Several versions are
compared over the same rows without detecting twice: detections are made once, then each row is unfolded over the versions.

A row without a policy in force, or whose consumer is disabled, has an error and no masked text: nothing passes unmasked.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanforge.functions.spans import let, touched

from . import core, joins
from .core import CombinationRule, Policy
from .detectors import NATIVE, NONE, RegexDetector

#: Up to so many versions are broadcast; more are joined as of their time by blocks.
BROADCAST_VERSIONS = 10_000
ACTIONS = ("tokenize_full", "opaque_token_full")
POLICY = (
    "struct<version:string,enabled:boolean,namespace:string,categories:array<string>,action:string,allow_unmask:boolean,allow_llm_egress:boolean,"
    "rules:array<struct<rule_id:string,target:string,requires:string>>>"
)
SCHEMA = f"consumer string, valid_from timestamp, policy {POLICY}"
METRICS = ("missed", "overmasked", "round_trip_failures")


class PolicyError(ValueError):
    """A policy or an update that doesn't hold; the values that were refused aren't repeated."""


def categories_of(detectors: Sequence[str | RegexDetector]) -> list[str]:
    return [d.category if isinstance(d, RegexDetector) else d.upper() for d in detectors]


def row_of(policy: Policy, version: str, known: Sequence[str]) -> tuple:
    """The dimension's struct for a policy; what isn't valid is an error."""
    try:
        names = policy.categories(known)
    except ValueError:
        raise PolicyError(f"invalid policy for consumer {policy.name!r}: unknown category") from None
    if policy.default_action not in ACTIONS:
        raise PolicyError(f"invalid policy for consumer {policy.name!r}: unknown action")
    rules = [(r.rule_id, r.target, r.requires) for r in policy.combination_rules if r.action_if_absent == "keep"]
    return (version, policy.enabled, policy.namespace, names, policy.default_action, policy.allow_unmask, policy.allow_llm_egress, rules)


def dimension(spark: SparkSession, versions: Sequence[tuple[datetime, str, Sequence[Policy]]], known: Sequence[str]) -> DataFrame:
    """The dimension of versions (valid from, name, policies); one invalid policy refuses all."""
    rows = [(p.name, at, row_of(p, version, known)) for at, version, policies in versions for p in policies]
    return spark.createDataFrame(rows, SCHEMA)


def current(dim: DataFrame, consumer: str) -> Policy | None:
    """The latest version of a consumer, as a policy."""
    last = dim.filter(F.col("consumer") == consumer).orderBy(F.col("valid_from").desc(), F.col("policy.version").desc()).limit(1).collect()
    if not last:
        return None
    p = last[0]["policy"]
    rules = tuple(CombinationRule(r["rule_id"], r["target"], r["requires"]) for r in p["rules"])
    return Policy(consumer, p["namespace"], p["enabled"], detect_types="all_required" if p["categories"] is None else ",".join(p["categories"]), default_action=p["action"], allow_unmask=p["allow_unmask"], allow_llm_egress=p["allow_llm_egress"], combination_rules=rules)


def update(dim: DataFrame, consumer: str, changes: Mapping[str, object], at: datetime, version: str, known: Sequence[str]) -> DataFrame:
    """The dimension with a further version of a consumer: its latest one with changes, validated before it counts. On an error dim is as it was."""
    now = current(dim, consumer)
    if now is None:
        raise PolicyError(f"unknown consumer: {consumer!r}")
    booleans = ("enabled", "allow_unmask", "allow_llm_egress")
    if set(changes) - set(asdict(now)) or any(not isinstance(v, bool if k in booleans else tuple if k == "combination_rules" else str) for k, v in changes.items()):
        raise PolicyError(f"invalid update for consumer {consumer!r}: rejected by validation")
    try:
        row = row_of(replace(now, **changes), version, known)
    except PolicyError:
        raise PolicyError(f"invalid update for consumer {consumer!r}: rejected by validation") from None
    return dim.unionByName(dim.sparkSession.createDataFrame([(consumer, at, row)], SCHEMA))


def join(rows: DataFrame, dim: DataFrame, consumer: str = "consumer", at: str = "ts") -> DataFrame:
    """rows with policy, the version of their consumer in force at their time (null: none); of versions from one time on the last by name.

    A dimension of at most BROADCAST_VERSIONS rows is broadcast as intervals. A larger one is joined as of the row's time by blocks of places, so
    that neither a consumer's rows nor its versions lie in one task."""
    if dim.limit(BROADCAST_VERSIONS + 1).count() > BROADCAST_VERSIONS:
        right = dim.select(F.col("consumer").alias(consumer), F.col("valid_from").alias(at), "policy")
        return joins.as_of(rows, right, consumer, at, "policy").drop(f"{at}_found")
    w = W.partitionBy("consumer").orderBy("valid_from", "policy.version")
    spans = dim.select(F.col("consumer").alias("__c"), F.col("valid_from").alias("__from"), F.lead("valid_from").over(w).alias("__to"), "policy")
    inside = (F.col(consumer) == F.col("__c")) & (F.col(at) >= F.col("__from")) & (F.col("__to").isNull() | (F.col(at) < F.col("__to")))
    return rows.join(F.broadcast(spans), inside, "left").drop("__c", "__from", "__to")


def error(policy: str = "policy") -> Column:
    """Why a row may not be processed; null if it may."""
    return F.when(F.col(policy).isNull(), "unknown consumer").when(~F.col(f"{policy}.enabled"), "consumer disabled")


def allowed(detections: Column, policy: Column, text: Column) -> Column:
    """The detections of the policy's categories, those that a combination rule leaves alone without spans and with the rule's id."""
    mine = F.filter(detections, lambda d: policy["categories"].isNull() | F.array_contains(policy["categories"], d["category"]))
    unmasked = F.expr("cast(array() as array<struct<start:int,stop:int>>)")

    def ruled(x: Column) -> Column:
        alone = F.transform(policy["rules"], lambda r: core.unprotected(x["d"], x["lines"], r["target"], r["requires"]))

        def apply(d: Column, i: Column) -> Column:
            last = F.element_at(F.filter(F.transform(alone, lambda a, k: F.when(F.get(a, i), k)), lambda k: k.isNotNull()), -1)
            return F.when(F.exists(alone, lambda a: F.get(a, i)), d.withField("sensitive", unmasked).withField("rule_id", F.get(policy["rules"], last)["rule_id"])).otherwise(d)

        return F.transform(x["d"], apply)

    with_lines = lambda d: F.struct(d.alias("d"), core.lines_of(text, F.transform(d, lambda v: v["start"])).alias("lines"))
    return let(mine, lambda d: F.when(F.size(policy["rules"]) == 0, d).otherwise(let(with_lines(d), ruled)))


def mask(found: DataFrame, key: bytes, context: str = "doc_id") -> DataFrame:
    """found (text, detections, policy) with error, resolved, mapping and masked_text by each row's own policy."""
    own = F.when(F.col("error").isNull(), allowed(F.col("detections"), F.col("policy"), F.col("text"))).otherwise(F.expr(NONE))
    gated = found.withColumn("error", error()).withColumn("detections", let(F.struct(own.alias("d")), lambda x: x["d"]))
    out = core.mask(core.resolve(gated), key, F.col("policy.namespace"), context, F.coalesce(F.col("policy.action"), F.lit(ACTIONS[0])))
    return out.withColumn("masked_text", F.when(F.col("error").isNull(), F.col("masked_text")))


def apply(rows: DataFrame, dim: DataFrame, key: bytes, detectors: Sequence[str | RegexDetector] = tuple(NATIVE), consumer: str = "consumer", at: str = "ts", context: str = "doc_id") -> DataFrame:
    """Detect to mask of rows (doc_id, text, a consumer and a time) under the policy in force for each."""
    return mask(join(core.detect(rows, detectors), dim, consumer, at), key, context)


def runs(docs: DataFrame, dim: DataFrame, key: bytes, detectors: Sequence[str | RegexDetector] = tuple(NATIVE), consumer: str = "consumer", context: str = "doc_id") -> DataFrame:
    """Every row of docs (doc_id, text, a consumer and gold: array<struct<start, stop, category>>) under every version of its consumer: consumer,
    version, missed (gold spans of which no character is masked), overmasked (masked spans without a gold character) and failed (not restored).

    Detections are made once, before rows are unfolded over the versions. The dimension's size is checked as in join()."""
    by = dim.groupBy(F.col("consumer").alias("__c")).agg(F.sort_array(F.collect_list("policy")).alias("__p"))
    small = dim.limit(BROADCAST_VERSIONS + 1).count() <= BROADCAST_VERSIONS
    found = core.detect(docs, detectors)
    held = found.join(F.broadcast(by) if small else by, F.col(consumer) == F.col("__c")).drop("__c")
    each = mask(held.withColumn("policy", F.explode("__p")).drop("__p"), key, context)
    done = core.restore(each)
    lost = lambda a, b: F.size(F.filter(touched(a, b), lambda hit: ~hit))
    return done.filter("error IS NULL").select(
        F.col(consumer).alias("consumer"), F.col("policy.version").alias("version"), context,
        lost(F.col("gold"), F.col("resolved")).alias("missed"), lost(F.col("resolved"), F.col("gold")).alias("overmasked"), (~F.col("restored").eqNullSafe(F.col("text"))).alias("failed"),
    )


def summary(each: DataFrame, *keys: str) -> DataFrame:
    """version, further keys, n and the metrics of runs()."""
    return each.groupBy("version", *keys).agg(F.count("*").alias("n"), F.sum("missed").alias("missed"), F.sum("overmasked").alias("overmasked"), F.count_if("failed").alias("round_trip_failures"))


def compare(summaries: DataFrame, active: str, candidate: str, *keys: str) -> DataFrame:
    """keys and, for each metric, delta_<metric> (candidate - active), with the names of those that got worse and better."""
    of = lambda m, v: F.coalesce(F.max(F.when(F.col("version") == v, F.col(m))), F.lit(0))
    deltas = summaries.groupBy(*keys).agg(*[(of(m, candidate) - of(m, active)).alias(f"delta_{m}") for m in METRICS])
    named = lambda test: F.array_compact(F.array(*[F.when(test(F.col(f"delta_{m}")), F.lit(m)) for m in METRICS]))
    return deltas.withColumns({"regressions": named(lambda d: d > 0), "improvements": named(lambda d: d < 0)})

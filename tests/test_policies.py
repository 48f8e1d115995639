from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from spanforge.operators import core, policies
from spanforge.operators.core import CombinationRule, Policy

KNOWN = ["EMAIL", "CARD", "PIN"]
RULE = CombinationRule("pin_with_card", "PIN", "CARD")


def day(n):
    return datetime(2024, 1, n, tzinfo=timezone.utc)


@pytest.fixture
def dim(spark):
    first = [Policy("a", "ns-a", detect_types="email"), Policy("b", "ns-b", enabled=False), Policy("c", "ns-c", default_action="opaque_token_full", combination_rules=(RULE,))]
    return policies.dimension(spark, [(day(1), "v1", first), (day(5), "v2", [Policy("a", "ns-a2", detect_types="card")])], KNOWN)


def rows(spark):
    text = "mail a.b@cd.org, card 4276189074144957\nPIN 4321"
    return spark.createDataFrame([(1, text, "a", day(2)), (2, text, "a", day(5)), (3, text, "b", day(9)), (4, text, "c", day(9)), (5, text, "x", day(9)), (6, text, "a", None), (7, None, "a", day(9)), (8, "card 4276189074144957 PIN 4321", "c", day(9))], "doc_id int, text string, consumer string, ts timestamp")


def test_every_row_follows_its_version(spark, dim):
    out = {r["doc_id"]: r for r in policies.apply(rows(spark), dim, b"k", ("email", "card", "pin")).collect()}
    spans = {i: [s["category"] for s in r["resolved"]] for i, r in out.items()}
    assert spans == {1: ["EMAIL"], 2: ["CARD"], 3: [], 4: ["EMAIL", "CARD"], 5: [], 6: [], 7: [], 8: ["CARD", "PIN"]}
    assert {i: r["error"] for i, r in out.items() if r["error"]} == {3: "consumer disabled", 5: "unknown consumer", 6: "unknown consumer"}
    assert all((r["masked_text"] is None) == (i in (3, 5, 6, 7)) for i, r in out.items())
    assert out[4]["masked_text"] == "mail [REDACTED-0], card [REDACTED-1]\nPIN 4321"
    kept = [d for d in out[4]["detections"] if d["category"] == "PIN"]
    assert [d["rule_id"] for d in kept] == ["pin_with_card"] and kept[0]["sensitive"] == []


def test_single_policies_give_the_same(spark, dim):
    docs = rows(spark).filter("doc_id = 4")
    one = core.apply_policy(docs, policies.current(dim, "c"), b"k", ("email", "card", "pin")).first()
    both = policies.apply(docs, dim, b"k", ("email", "card", "pin")).first()
    assert one["masked_text"] == both["masked_text"] and one["detections"] == both["detections"]


def test_large_dimensions_join_as_small_ones(spark, dim, monkeypatch):
    small = {r["doc_id"]: r["policy"] for r in policies.join(rows(spark), dim).collect()}
    monkeypatch.setattr(policies, "BROADCAST_VERSIONS", 1)
    large = {r["doc_id"]: r["policy"] for r in policies.join(rows(spark), dim).collect()}
    assert large == small and small[1]["version"] == "v1" and small[2]["version"] == "v2"


def test_updates_are_validated_before_they_count(spark, dim):
    out = policies.update(dim, "a", {"detect_types": "card, pin", "allow_unmask": True}, day(8), "v3", KNOWN)
    assert policies.current(out, "a").detect_types == "CARD,PIN" and policies.current(out, "a").namespace == "ns-a2"
    assert policies.current(dim, "a").detect_types == "CARD"
    for who, changes in (("nobody", {}), ("a", {"detect_types": "FULL_NMAE"}), ("a", {"enabled": "yes"}), ("a", {"secret_field": "s3cret"}), ("a", {"default_action": "drop"}), ("a", {"namespace": 7})):
        with pytest.raises(policies.PolicyError) as e:
            policies.update(dim, who, changes, day(8), "v3", KNOWN)
        assert not any(str(v) in str(e.value) for v in changes.values())
    with pytest.raises(policies.PolicyError):
        policies.dimension(spark, [(day(1), "v1", [Policy("a", "n"), Policy("b", "n", detect_types="nope")])], KNOWN)


def test_versions_are_compared_in_one_scan(spark, sf):
    from spanforge.plans import queries as Q

    each = Q._turn_runs(spark, sf)
    plan = each._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    got = {(r["version"], r["consumer"]): r for r in policies.summary(each, "consumer").collect()}
    assert got["active", "user"]["missed"] > 0 and got["candidate", "assistant"]["missed"] > got["active", "assistant"]["missed"]
    assert all(r["round_trip_failures"] == 0 for r in got.values())


def test_touched_by_all_pairs(spark):
    import random

    from spanforge.functions.spans import touched

    r = random.Random(1)
    span = lambda: (lambda a: (a, a + r.randint(1, 6)))(r.randint(0, 40))
    data = [([span() for _ in range(r.randint(0, 6))], [span() for _ in range(r.randint(0, 6))]) for _ in range(80)]
    df = spark.createDataFrame(data, "a array<struct<start:int,stop:int>>, b array<struct<start:int,stop:int>>")
    for row in df.select("a", "b", touched(F.col("a"), F.col("b")).alias("hit")).collect():
        assert row["hit"] == [any(x["start"] < y["stop"] and y["start"] < x["stop"] for y in row["b"]) for x in row["a"]]

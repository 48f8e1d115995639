import json

import pytest
from pyspark.sql import functions as F

from spanforge.operators import core, detectors, evaluate
from spanforge.sources import sinks


def test_a_batch_delivered_twice_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "store")
    put = sinks.upsert(path, ["k"], ["seq"])
    make = lambda rows: spark.createDataFrame(rows, "k string, seq int, v string")
    first, second = make([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")]), make([("a", 3, "w"), ("c", 1, None)])
    put(first, 0)
    put(second, 1)
    want = {("a", "w"), ("b", "z"), ("c", None)}
    state = lambda p: {(r["k"], r["v"]) for r in sinks.current(spark, p, ["k"]).collect()}
    assert state(path) == want
    put(second, 1)
    put(first, 0)
    assert state(path) == want
    sinks.compact(spark, path, str(tmp_path / "compact"), ["k"])
    assert state(str(tmp_path / "compact")) == want
    sinks.upsert(str(tmp_path / "compact"), ["k"], ["seq"])(first, 0)
    assert state(str(tmp_path / "compact")) == want
    assert {r["k"] for r in sinks.current(spark, path, ["k"], F.col("v").isNull()).collect()} == {"a", "b"}


def test_logs_hold_allowed_fields_and_rotate(spark, tmp_path):
    spark.dataSource.register(sinks.SafeLog)
    rows = spark.range(0, 300, 1, 3).select(F.lit("mask").alias("event"), F.lit("ok").alias("status"), F.lit("secret text").alias("text"), F.col("id").cast("double").alias("duration_ms"))
    rows.write.format("safe_log").option("max_bytes", 2000).mode("append").save(str(tmp_path / "log"))
    files = list((tmp_path / "log").iterdir())
    lines = [json.loads(x) for f in files for x in f.read_text().splitlines()]
    assert len(lines) == 300 and {tuple(sorted(x)) for x in lines} == {("duration_ms", "event", "status")}
    assert len(files) > 6 and all(f.stat().st_size <= 2000 and not f.name.startswith(".") for f in files)


def test_a_failed_job_leaves_no_log_file(spark, tmp_path):
    spark.dataSource.register(sinks.SafeLog)
    bad = spark.range(0, 100, 1, 4).select(F.when(F.col("id") == 99, F.raise_error(F.lit("broken"))).otherwise("ok").cast("string").alias("status"))
    with pytest.raises(Exception, match="broken"):
        bad.write.format("safe_log").option("max_bytes", 100).mode("append").save(str(tmp_path / "log"))
    assert not list((tmp_path / "log").iterdir())


def test_requests_are_split_and_counted_in_one_scan(spark, tmp_path):
    rows = spark.createDataFrame([(1, "ab"), (2, "я" * 3), (3, None), (4, "x" * 5)], "id int, text string")
    counts = sinks.split_by_size(rows, 5, str(tmp_path / "out"))
    assert counts == {"accepted": 3, "rejected": 1, "bytes": 13}
    assert [r["id"] for r in spark.read.parquet(str(tmp_path / "out")).filter("rejected = 'true'").collect()] == [2]


def test_table_detectors_keep_their_place_and_their_rows(spark):
    d = detectors.TableDetector("shouts", "SHOUT", lambda t: [(i, i + 1) for i, c in enumerate(t) if c == "!"])
    docs = spark.createDataFrame([(1, "a@b.org!"), (2, None), (3, "none"), (4, "!!")], "doc_id int, text string")
    found = core.detect(docs, (d, "email"))
    got = {r["doc_id"]: [(x["category"], x["start"], x["stop"]) for x in r["detections"]] for r in found.collect()}
    assert got == {1: [("SHOUT", 7, 8), ("EMAIL", 0, 7)], 2: [], 3: [], 4: [("SHOUT", 0, 1), ("SHOUT", 1, 2)]}
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError, match="exists"):
        detectors.register(detectors.TableDetector("email", "EMAIL", lambda t: []))
    with pytest.raises(ValueError, match="invalid span"):
        detectors.TableDetector("bad", "X", lambda t: [(0, 99)]).rows("abc")


def test_ranks_of_a_hot_key_by_sorting(spark):
    import random

    r = random.Random(4)
    data = [("hot", float(r.choice([1, 1, 1, r.randint(0, 500)]))) for _ in range(3000)] + [("one", 7.0), ("none", None), (None, 3.0), (None, 5.0)]
    rows = spark.createDataFrame(data, "k string, x double").repartition(5)
    qs = {"a": 0.0, "b": 0.37, "c": 0.95, "d": 1.0}
    values = {k: sorted(x for k2, x in data if k2 == k and x is not None) for k in {k for k, _ in data}}
    floor = {x["k"]: [x[q] for q in qs] for x in evaluate.percentile_floor(rows, ["k"], "x", qs).collect()}
    assert floor == {k: [v[min(len(v) - 1, int(q * len(v)))] for q in qs.values()] for k, v in values.items() if v}
    inter = {x["k"]: [x[q] for q in qs] for x in evaluate.percentile_interpolated(rows, ["k"], "x", qs).collect()}
    import numpy as np

    for k, v in values.items():
        if v:
            assert inter[k] == pytest.approx([np.quantile(v, q) for q in qs.values()])


def test_histograms_merge_in_any_order(spark):
    rows = spark.createDataFrame([("a", float(i)) for i in range(10)] + [("b", None)], "k string, x double")
    whole = evaluate.histogram(rows, ["k"], "x", [2.0, 5.0])
    parts = [evaluate.histogram(rows.filter(F.col("x") % 3 == i), ["k"], "x", [2.0, 5.0]) for i in range(3)]
    merged = evaluate.merge_histograms(parts[2].unionByName(parts[0]).unionByName(parts[1]), ["k"], 3)
    assert merged.collect() == whole.collect() and whole.first()["buckets"] == [3, 3, 4]
    with pytest.raises(Exception, match="fall"):
        evaluate.merge_histograms(whole.withColumn("buckets", F.array(F.lit(-1).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long"))), ["k"], 3).collect()

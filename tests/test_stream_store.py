from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from spanforge.operators import lifecycle
from spanforge.streaming import vault

SCHEMA = "namespace string, payload_id string, seq long, at timestamp, action string, owner string, text string, masked_text string"
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def request(seq, seconds, action, text="a@b.org", owner="w1", payload="p"):
    return ("n", payload, seq, START + timedelta(seconds=seconds), action, owner, text, text.replace("a@b.org", "[X]"))


#: Requests, batch by batch, and what each leads to.
STEPS = [
    [(request(1, 0, "claim"), "CLAIMED"), (request(2, 10, "claim", owner="w2"), "WAIT"), (request(3, 12, "claim", "other"), "CONFLICT"), (request(4, 29, "commit", owner="w2"), "LOST")],
    [(request(5, 30, "claim", owner="w2"), "RECLAIMED"), (request(6, 31, "commit"), "LOST"), (request(7, 32, "commit", owner="w2"), "COMMITTED"), (request(8, 33, "process", "[X]"), "RESTORE")],
    # the grace ends 300 s behind the restore; replays and conflicts don't renew it
    [(request(9, 200, "process"), "MASK_REPLAY"), (request(10, 300, "process", "other"), "CONFLICT"), (request(11, 332, "get"), "FOUND"), (request(12, 333, "get"), "MISSING")],
    [(request(13, 400, "process"), "MASK"), (request(14, 3999, "get"), "FOUND"), (request(15, 4000, "get"), "MISSING"), (request(16, 4001, "release"), "LOST")],
    [(request(17, 20_000, "process", payload="q"), "MASK"), (request(18, 20_001, "claim"), "CLAIMED"), (request(19, 20_002, "release"), "RELEASED"), (request(20, 20_003, "delete"), "MISSING")],
]


def run(spark, stream, tmp_path):
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", vault.PROVIDER)
    try:
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return q
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)


def test_leases_expiry_and_grace_with_advancing_watermarks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = vault.process_stream(spark.readStream.schema(SCHEMA).json(str(tmp_path / "in")), late="5 seconds")
    for i, batch in enumerate(STEPS):
        spark.createDataFrame([r for r, _ in batch], SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in" / f"batch={i}").replace("batch=", "b"))
        for f in (tmp_path / "in" / f"b{i}").glob("*.json"):
            f.rename(tmp_path / "in" / f"{i}-{f.name}")
        q = run(spark, stream, tmp_path)
    out = {r["seq"]: r["outcome"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r[2]: o for batch in STEPS for r, o in batch}
    assert out == want
    fold = lifecycle.store(spark.createDataFrame([r for batch in STEPS for r, _ in batch], SCHEMA))
    assert {r["seq"]: r["outcome"] for r in fold.collect()} == want
    # timers have removed the records that ended: only q's is left
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3


def test_late_requests_are_dropped(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = vault.process_stream(spark.readStream.schema(SCHEMA).json(str(tmp_path / "in")), late="5 seconds")
    for i, (seq, at) in enumerate([(1, 1000), (2, 0), (3, 996)]):
        spark.createDataFrame([request(seq, at, "process", payload=f"p{seq}")], SCHEMA).coalesce(1).write.json(str(tmp_path / f"b{i}"))
        for f in (tmp_path / f"b{i}").glob("*.json"):
            f.rename(tmp_path / "in" / f"{i}-{f.name}")
        run(spark, stream, tmp_path)
    assert {r["seq"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1, 3}


def test_retries_are_dropped_once(spark, tmp_path):
    rows = [("n", "p", "t", START), ("n", "p", "t", START + timedelta(seconds=3)), ("n", "p", "u", START)]
    spark.createDataFrame(rows, "namespace string, payload_id string, text string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    q = vault.drop_retries(spark.readStream.schema("namespace string, payload_id string, text string, ts timestamp").parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("retries").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("retries").count() == 2


def test_unknown_actions_are_errors():
    with pytest.raises(ValueError, match="unknown action"):
        lifecycle.step(None, "drop", None, None, None, 0)


def test_the_store_is_read_at_one_time(spark):
    writes = spark.createDataFrame([("n", "k", START, 1.0, 8), ("n", "l", START + timedelta(seconds=7200), 2.0, 8)], "namespace string, key string, ts timestamp, value double, size_bytes int")
    now = writes.agg(F.max("ts"))
    assert [r["key"] for r in lifecycle.live(writes, now).collect()] == ["l"]


def test_replayed_requests_come_in_bounded_batches_in_order_of_time(spark, tmp_path):
    """Requests that lie in any order, over more time than the watermark allows for, give what the fold gives; no batch holds them all."""
    actions = ["process", "claim", "commit", "get", "release", "process"]
    rows = [request(i, (i * 7919) % 40_000, actions[i % 6], ["a@b.org", "other", "[X]"][i % 3], f"w{i % 2}", f"p{i % 2}") for i in range(400)]
    requests = spark.createDataFrame(rows, SCHEMA).repartition(3)
    stream = vault.replayed(requests, str(tmp_path), rows=100)
    sizes = [r["count"] for r in spark.read.parquet(str(next(tmp_path.glob("replay-*/in")))).groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) == 4 and max(sizes) <= 150
    got = vault.run_available(vault.process_stream(stream), str(tmp_path)).select("payload_id", "seq", "outcome", "result")
    want = lifecycle.store(requests).select("payload_id", "seq", "outcome", "result")
    assert got.count() == 400 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()

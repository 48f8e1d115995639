"""Structured Streaming forms: the keyed store with leases, expiry and grace, rolling request rates, exact-retry suppression."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from spanforge.operators.lifecycle import Record, step

OUTPUT = "namespace string, payload_id string, seq long, at timestamp, outcome string, result string"
STATE = "phase string, text string, masked string, owner string, lease_ms long, end_ms long"
#: transformWithState keeps its state and timers in this store only.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Store(StatefulProcessor):
    """A record for each (namespace, payload_id), with a timer at its end.

    The record's end is compared with a request's own time as well, so one whose timer hasn't fired yet isn't served. Every change of the end sets a
    further timer; one that fires before the record's end, as it was renewed since, changes nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.record = handle.getValueState("record", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        before = record = Record(*self.record.get()) if self.record.exists() else None
        out = []
        # Spark gives a key's rows of a micro-batch in any order; a batch's size bounds them
        for r in sorted(rows, key=lambda r: (r["at"], r["seq"])):
            record, outcome, result = step(record, r["action"], r["owner"], r["text"], r["masked_text"], round(r["at"].timestamp() * 1000))
            out.append(Row(namespace=key[0], payload_id=key[1], seq=r["seq"], at=r["at"], outcome=outcome, result=result))
        if record is None:
            self.record.clear()
        elif record != before:
            self.record.update(tuple(record))
            if before is None or before.end_ms != record.end_ms:
                self.handle.registerTimer(record.end_ms)
        yield from out

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        if self.record.exists() and Record(*self.record.get()).end_ms <= expiredTimerInfo.getExpiryTimeInMs():
            self.record.clear()
        return iter(())

    def close(self) -> None:
        pass


def process_stream(requests: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The batch operator lifecycle.store on a stream (namespace, payload_id, seq, at, action, owner, text, masked_text) by event time.

    Records are removed once the watermark, late behind the latest request, passes their end. The session's state store has to be PROVIDER."""
    rows = requests.select("namespace", "payload_id", F.col("seq").cast("long").alias("seq"), "at", "action", "owner", "text", "masked_text")
    return rows.withWatermark("at", late).groupBy("namespace", "payload_id").transformWithState(Store(), OUTPUT, "Append", "EventTime")


#: Requests in a micro-batch of replayed(): a key's rows of one batch are sorted in a Python worker's memory.
BATCH_ROWS = 1_000_000


def replayed(requests: DataFrame, folder: str, rows: int = BATCH_ROWS) -> DataFrame:
    """Requests at hand (at: their event time) as a stream of about so many rows in a micro-batch, in the order of their times.

    They are dealt by range of time, and the ranges are written to the stream's folder one after the other, a file each, so that its files' times have
    the order of the requests' times: no batch holds requests from before an earlier one, and the watermark drops none. Rows of one moment stay together;
    more than so many at one moment make a larger batch. Rows without a time come first."""
    spark, base = requests.sparkSession, f"{folder.rstrip('/')}/replay-{uuid.uuid4().hex}"
    n = max(1, -(-requests.count() // rows))
    cuts = requests.select(F.col("at").cast("double").alias("at")).approxQuantile("at", [i / n for i in range(1, n)], 0.1 / n) if n > 1 else []
    place = F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda c: c < F.col("at").cast("double"))) if cuts else F.lit(0)
    # null times compare as null, which filter() leaves out: range 0
    requests.withColumn("__range", place).repartition("__range").write.partitionBy("__range").parquet(f"{base}/ranges")
    kept = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in requests.schema)}, __range int").parquet(f"{base}/ranges")
    for i in range(len(set(cuts)) + 1):
        kept.filter(F.col("__range") == i).drop("__range").coalesce(1).write.mode("append").parquet(f"{base}/in")
    return spark.readStream.schema(requests.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")


def run_available(stream: DataFrame, folder: str) -> DataFrame:
    """What a stream gives for all that there is now, as a table in a folder that all executors share."""
    spark, at = stream.sparkSession, f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}"
    conf = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(conf, None)
    spark.conf.set(conf, PROVIDER)
    try:
        stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(conf, was) if was else spark.conf.unset(conf)
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


def rolling_rate(events: DataFrame, ts: str = "ts", late: str = "2 minutes", window: str = "60 seconds", slide: str = "1 second") -> DataFrame:
    """Requests in sliding windows by event time; rows later than late are left out."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window, slide), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("stop"), "event_type", "n")


def bucket_rate(events: DataFrame, ts: str = "ts", late: str = "2 minutes") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.window(ts, "1 second"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("second"), "event_type", "n")


def drop_retries(events: DataFrame, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Exact retries (same key and text) within the watermark are dropped."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(["namespace", "payload_id", "text"])

"""Keyed mapping lifecycle in batch: what a sequence of requests for one (namespace, payload_id) leads to.

The first request of a key masks and fixes the record; it never changes afterwards, so every later outcome depends on that first row alone
and each row is compared with its key's first: a text equal to the masked one restores (tested first), the same original replays, anything else conflicts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import core

RETENTION_SECONDS, GRACE_SECONDS, LEASE_SECONDS = 3600, 300, 30


class Record(NamedTuple):
    """What the store holds of a key: the phase (PROCESSING, READY or RESTORED), the original, what it is masked to, who works on it, and when lease and record end."""

    phase: str
    text: str | None
    masked: str | None
    owner: str | None
    lease_ms: int
    end_ms: int


def step(record: Record | None, action: str, owner: str | None, text: str | None, masked: str | None, now_ms: int) -> tuple[Record | None, str, str | None]:
    """The record after a request, the outcome and the answer. A record is gone at its end, a lease can be taken over at its own.

    claim starts work on a text: CLAIMED without a record, RECLAIMED from an owner whose lease is over, WAIT while it lasts. commit and release
    finish or drop the work of their own owner only, else LOST. process masks at once. A text that equals the masked one restores, and only that shortens
    the record's end to the grace; the same original replays, anything else conflicts; neither changes the record."""
    if record and record.end_ms <= now_ms:
        record = None
    retained, leased = now_ms + 1000 * RETENTION_SECONDS, now_ms + 1000 * LEASE_SECONDS
    mine = record is not None and record.phase == "PROCESSING" and record.owner == owner
    if action == "commit":
        return (Record("READY", record.text, masked, owner, 0, retained), "COMMITTED", masked) if mine else (record, "LOST", None)
    if action == "release":
        return (None, "RELEASED", None) if mine else (record, "LOST", None)
    if action == "delete":
        return None, "DELETED" if record else "MISSING", None
    if action == "get":
        held = record is not None and record.phase != "PROCESSING"
        return record, "FOUND" if held else "MISSING", record.masked if held else None
    if action not in ("claim", "process"):
        raise ValueError(f"unknown action: {action}")
    if record is None:
        if action == "claim":
            return Record("PROCESSING", text, None, owner, leased, retained), "CLAIMED", None
        return Record("READY", text, masked, owner, 0, retained), "MASK", masked
    if record.phase == "PROCESSING":
        if text != record.text:
            return record, "CONFLICT", None
        if record.lease_ms > now_ms:
            return record, "WAIT", None
        return Record("PROCESSING", text, None, owner, leased, retained), "RECLAIMED", None
    if action == "process" and text == record.masked:
        return record._replace(phase="RESTORED", end_ms=now_ms + 1000 * GRACE_SECONDS), "RESTORE", record.text
    if text in (record.text, record.masked):
        return record, "MASK_REPLAY", record.masked
    return record, "CONFLICT", None


def process(events: DataFrame) -> DataFrame:
    """events (namespace, payload_id, seq, text, masked_text: what text would be masked to) with outcome and result."""
    keys = ["namespace", "payload_id"]
    first = events.groupBy(*keys).agg(F.min_by(F.struct("text", "masked_text", F.col("seq").alias("at")), F.struct("seq", "text")).alias("__first"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    e = events.join(first.select(*[F.col(k).alias(f"__{k}") for k in keys], "__first"), same).drop(*[f"__{k}" for k in keys])
    masked, original = F.col("__first.masked_text"), F.col("__first.text")
    begins = F.col("seq").eqNullSafe(F.col("__first.at")) & F.col("text").eqNullSafe(original)
    outcome = F.when(begins, "MASK").when(F.col("text") == masked, "RESTORE").when(F.col("text") == original, "MASK_REPLAY").otherwise("CONFLICT")
    out = e.withColumn("outcome", outcome)
    result = F.when(F.col("outcome").isin("MASK", "MASK_REPLAY"), masked).when(F.col("outcome") == "RESTORE", original)
    return out.withColumn("result", result).drop("__first")


def live(writes: DataFrame, now: Column | DataFrame, ttl_seconds: int = RETENTION_SECONDS) -> DataFrame:
    """The store at a time: the last write of each key, expired ones left out. writes: namespace, key, ts, value, size_bytes.

    now may be a table of one row and column."""
    last = writes.groupBy("namespace", "key").agg(F.max_by(F.struct("ts", "value", "size_bytes"), "ts").alias("r")).select("namespace", "key", "r.*")
    if isinstance(now, DataFrame):
        now = now.scalar()  # an error if it has more rows than one
    return last.filter(F.col("ts") + F.make_dt_interval(secs=F.lit(float(ttl_seconds))) > now).select("namespace", "key", "ts", "value", "size_bytes")


def in_order(rows: DataFrame, keys: Sequence[str], order: str, fold: Callable[[], Callable[[dict], Any]], out: str, kind: str) -> DataFrame:
    """rows with out: what fold() makes of each row of its keys, called in order.

    Each outcome depends on all before it, so a key's rows pass one task, but as a stream: nothing is held but the fold's own state. Rows
    are shuffled by key and sorted there, with spill; ties in order are taken by the rows' hash."""
    columns = rows.columns
    placed = rows.withColumn("__tie", F.xxhash64(*columns)).repartition(*keys).sortWithinPartitions(*keys, order, "__tie").drop("__tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, step = None, None
        for b in batches:
            made = []
            for row in b.to_pylist():
                own = tuple(row[k] for k in keys)
                if step is None or own != at:
                    at, step = own, fold()
                made.append(step(row))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, schema_type)], names=[*columns, out])

    schema = T.StructType([*placed.schema.fields, *T._parse_datatype_string(f"`{out}` {kind}").fields])  # noqa: SLF001
    schema_type = to_arrow_type(schema[out].dataType)
    return placed.mapInArrow(run, schema)


def store(requests: DataFrame) -> DataFrame:
    """requests (namespace, payload_id, seq, at: timestamp, action, owner, text, masked_text) with outcome and result, in the order of at and seq."""

    def fold() -> Callable[[dict], dict]:
        held: Record | None = None

        def one(row: dict) -> dict:
            nonlocal held
            held, outcome, result = step(held, row["action"], row["owner"], row["text"], row["masked_text"], row["__ms"])
            return {"outcome": outcome, "result": result}

        return one

    timed = requests.withColumn("__ms", F.unix_millis("at")).withColumn("__order", F.struct("at", "seq"))
    out = in_order(timed, ["namespace", "payload_id"], "__order", fold, "__o", "struct<outcome:string,result:string>")
    return out.select(*requests.columns, "__o.outcome", "__o.result")


def within_capacity(writes: DataFrame, max_entries: int, max_bytes: int, order: str = "seq") -> DataFrame:
    """writes (namespace, key, size_bytes) with accepted: whether entries and bytes held leave room. A rejected write changes nothing.

    A key that is held is replaced: it adds no entry, and its old size goes. A namespace is one store; its fold holds max_entries sizes at most."""

    def store() -> Callable[[dict], bool]:
        held: dict[Any, int] = {}
        used = 0

        def write(row: dict) -> bool:
            nonlocal used
            old = held.get(row["key"])
            after = used - (old or 0) + row["size_bytes"]
            if (old is None and len(held) >= max_entries) or after > max_bytes:
                return False
            held[row["key"]], used = row["size_bytes"], after
            return True

        return write

    return in_order(writes, ["namespace"], order, store, "accepted", "boolean")


def records(operations: DataFrame) -> DataFrame:
    """operations on records (namespace, key, seq, action, owner, at, lease_seconds, ttl_seconds) with done: whether each took effect.

    claim creates a record in work if there is none; commit and release, which completes or deletes it, take its owner; reclaim gives a record in
    work to another owner once its lease has run out (at its very end, too); get finds it; delete removes it. A record is gone when its
    ttl_seconds (null: never) since the last write have passed. One record is held for each key."""

    def record() -> Callable[[dict], bool]:
        held: dict | None = None

        def step(row: dict) -> bool:
            nonlocal held
            at, action = row["at"], row["action"]
            if held and held["gone"] is not None and held["gone"] <= at:
                held = None
            mine = held is not None and held["owner"] == row["owner"]
            done = {
                "claim": held is None,
                "commit": mine,
                "release": mine,
                "reclaim": held is not None and held["working"] and held["lease"] is not None and held["lease"] <= at,
                "get": held is not None,
                "delete": held is not None,
            }[action]
            if done and action in ("release", "delete"):
                held = None
            elif done and action != "get":
                until = lambda seconds: None if seconds is None else at + seconds
                held = {"owner": row["owner"], "working": action != "commit", "lease": until(row["lease_seconds"]), "gone": until(row["ttl_seconds"])}
            return done

        return step

    return in_order(operations, ["namespace", "key"], "seq", record, "done", "boolean")


def claims(requests: DataFrame) -> DataFrame:
    """Per key, the first request's owner holds the claim; a later request, of any owner, takes it over only once the lease has run out.

    requests: namespace, key, seq, owner, at, lease_seconds. Adds granted. A lease ends at its time: at that very moment it can be taken over."""

    def holder() -> Callable[[dict], bool]:
        until: float | None = None

        def ask(row: dict) -> bool:
            nonlocal until
            if until is not None and until > row["at"]:
                return False
            until = row["at"] + row["lease_seconds"]
            return True

        return ask

    kinds = requests.select("namespace", "key", F.col("seq").cast("long").alias("seq"), "owner", F.col("at").cast("double").alias("at"), F.col("lease_seconds").cast("double").alias("lease_seconds"))
    return in_order(kinds, ["namespace", "key"], "seq", holder, "granted", "boolean").select("namespace", "key", "seq", "granted")


def unmask(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """requests (namespace, payload_id, text) with outcome and result: RESTORED and the original where text is exactly the masked one, CONFLICT where it differs,
    CONTEXT_MISSING where there is no record. stored: namespace, payload_id, original, masked_text, a row for each key."""
    r = stored.select("namespace", "payload_id", F.col("original").alias("__original"), F.col("masked_text").alias("__masked"), F.lit(True).alias("__found"))
    both = requests.join(r, ["namespace", "payload_id"], "left")
    outcome = F.when(F.col("__found").isNull(), "CONTEXT_MISSING").when(F.col("text") == F.col("__masked"), "RESTORED").otherwise("CONFLICT")
    return both.withColumn("outcome", outcome).withColumn("result", F.when(F.col("outcome") == "RESTORED", F.col("__original"))).drop("__original", "__masked", "__found")


def restore_tokens(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """requests (namespace, payload_id, text) with restored: the known tokens of the record put back into a text that may have changed; null without a record.

    stored: namespace, payload_id, mapping."""
    found = requests.join(stored.select("namespace", "payload_id", "mapping", F.lit(True).alias("__found")), ["namespace", "payload_id"], "left")
    return core.restore(found, "text", "restored").withColumn("restored", F.when(F.col("__found"), F.col("restored"))).drop("mapping", "__found")

"""Mixture-controlled packing: deficit round-robin over source queues.

Every source is a queue of its documents (in the order they were read), whose ids are served in units of UNIT, documents joined end to end.
Round by round each queue gains a quantum, its target share of ROUND ids, and is served whole units while its credit lasts; what is
left is its deficit and carries over to the next round, across windows and partitions. An exhausted queue drops out and the others go on
at the same proportions to each other. Targets are given weights or, without them, shares of ids to the power TEMPER, which gives small
sources more room than they have in the data, until they are used up.

All queues hold their documents from the start, so a unit is served in the first round whose credit covers the units of its queue up to
and including it: round = ceil((units before + 1) * UNIT / quantum). That closed form is the same schedule without a sequential pass; the
running sums it needs are computed in blocks, so no source, however large, lies in one task. What is served, in order of round and
source, is laid end to end and cut at every window's end, so all windows but the very last are full. A round is one window long (longer
only where there are more sources than a window has units), so every window has each active source's share, give or take a unit.

Texts are encoded once, into a table with a key for each row; only keys and lengths are scheduled, and the places found are joined back.

Edge cases: a null text counts as empty and has just the end id; a null source is a queue of its own; rows that repeat an id are packed each,
told apart by their key; long texts are cut at unit and window ends; an empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, running_totals, table
from .tokens import encoder

VOCABULARY = "byte_bpe_50k.json"
WINDOW = 2048
UNIT = 32
TEMPER = 0.7
#: Rounds whose pieces are put in order by one task.
ROUNDS_A_BLOCK = 64


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """key, doc_id, queue, n (ids with the end id), before (ids of earlier rows of the queue in this part of the table) and ids of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary, True)
        part, row = TaskContext.get().partitionId(), 0
        so_far: dict[str, int] = defaultdict(int)
        for b in batches:
            sizes, before, blobs = [], [], []
            queues = b.column(2).to_pylist()
            for q, ids in zip(queues, coder.documents(b.column(1).to_pylist()), strict=True):
                sizes.append(len(ids))
                before.append(so_far[q])
                so_far[q] += len(ids)
                blobs.append(ids.tobytes())
            keys = (part << 33) + row + np.arange(len(sizes), dtype=np.int64)
            row += len(sizes)
            columns = [pa.array(keys), b.column(0), b.column(2), pa.array(sizes, pa.int64()), pa.array(before, pa.int64()), pa.array(blobs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "doc_id", "queue", "n", "before", "ids"])

    queue = F.when(F.col("source").isNull(), F.lit("none")).otherwise(F.concat(F.lit("source:"), F.col("source").cast("string")))
    return cut(docs.select("doc_id", "text", queue.alias("queue")).mapInArrow(run, f"key long, doc_id {kind}, queue string, n long, before long, ids binary"), "packing-ids")


def _quanta(totals: DataFrame, window: int, unit: int, temper: float, weights: dict[str, float] | None) -> DataFrame:
    """queue and quantum (ids a round, a whole number of one or more) from queue and total."""
    weight = F.pow("total", F.lit(temper))
    if weights:
        weight = F.coalesce(*[F.when(F.col("queue") == q, F.lit(float(x))) for q, x in weights.items()], F.lit(0.0))
    weighed = totals.select("queue", weight.alias("weight"), F.lit(1).alias("one"))
    over_all = F.broadcast(weighed.groupBy("one").agg(F.sum("weight").alias("all"), F.count("*").alias("queues")))  # one row
    round_ids = F.greatest(F.lit(window).cast("long"), F.col("queues") * unit)
    return weighed.join(over_all, "one").select("queue", F.greatest(F.lit(1).cast("long"), F.round(round_ids * F.col("weight") / F.col("all")).cast("long")).alias("quantum"))


def schedule(rows: DataFrame, window: int = WINDOW, unit: int = UNIT, temper: float = TEMPER, weights: dict[str, float] | None = None) -> DataFrame:
    """key, at (of a piece in its document), n, sequence_id and offset of every piece. rows: key, queue, n, before.

    weights, by queue ("source:" and the source, or "none"), are the targets; a queue without one is served one id a round at least."""
    part = F.shiftright("key", 33)
    sums = rows.groupBy("queue", part.alias("part")).agg(F.sum("n").alias("ids"))
    quanta = _quanta(sums.groupBy("queue").agg(F.sum("ids").alias("total")), window, unit, temper, weights)
    base = cut(running_totals(sums, ["queue"], "part", "ids", "base").join(quanta, "queue").select("queue", "part", "base", "quantum"), "packing-base")
    placed = rows.withColumn("part", part).join(base, ["queue", "part"]).select("key", "queue", "n", (F.col("base") + F.col("before")).alias("start"), "quantum")
    served = lambda u: F.expr(f"(({u} + 1) * {unit} + quantum - 1) div quantum")
    first, last = f"start div {unit}", f"(start + n - 1) div {unit}"
    # the rounds that serve a document; where a quantum is less than a unit there is one for each unit, and rounds between serve none
    rounds = F.when(F.col("quantum") >= unit, F.sequence(served(first), served(last))).otherwise(F.expr(f"transform(sequence({first}, {last}), u -> ((u + 1) * {unit} + quantum - 1) div quantum)"))
    each = placed.select("key", "queue", "n", "start", "quantum", F.explode(rounds).alias("round"))
    upto = lambda r: F.expr(f"{unit} * ((({r}) * quantum) div {unit})")
    each = each.withColumns({"from": F.greatest(F.col("start"), upto("round - 1")), "to": F.least(F.col("start") + F.col("n"), upto("round"))})
    pieces = cut(each.select("key", "queue", "round", "from", (F.col("from") - F.col("start")).alias("at"), (F.col("to") - F.col("from")).alias("n")).withColumn("block", F.expr(f"round div {ROUNDS_A_BLOCK}")), "packing-pieces")
    blocks = running_totals(pieces.groupBy("block").agg(F.sum("n").alias("ids")), [], "block", "ids", "block_base").select("block", "block_base")
    w = W.partitionBy("block").orderBy("round", "queue", "from").rowsBetween(W.unboundedPreceding, -1)
    local = pieces.withColumn("local", F.coalesce(F.sum("n").over(w), F.lit(0).cast("long")))
    laid = local.join(blocks, "block").select("key", "at", "n", (F.col("block_base") + F.col("local")).alias("place"))
    cuts = laid.select("*", F.explode(F.sequence(F.expr(f"place div {window}"), F.expr(f"(place + n - 1) div {window}"))).alias("sequence_id"))
    low, high = F.greatest(F.col("place"), F.col("sequence_id") * window), F.least(F.col("place") + F.col("n"), (F.col("sequence_id") + 1) * window)
    return cuts.select("key", (F.col("at") + low - F.col("place")).alias("at"), (high - low).alias("n"), "sequence_id", (low - F.col("sequence_id") * window).alias("offset"))


def _cutter(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pieces = b.column("pieces")
            rows = np.repeat(np.arange(b.num_rows), pieces.value_lengths().to_numpy())
            flat = pieces.flatten()
            at, n = (flat.field(c).to_numpy() for c in ("at", "n"))
            sizes, crc, blobs = b.column("n").to_pylist(), np.empty(len(rows), dtype=np.int64), []
            own: np.ndarray = np.zeros(0, dtype="<u4")
            before = -1
            for i, (row, a, z) in enumerate(zip(rows.tolist(), at.tolist(), (at + n).tolist(), strict=True)):
                if row != before:
                    blob, before = b.column("ids")[row].as_py(), row
                    own = np.frombuffer(blob, dtype=np.uint16 if len(blob) == 2 * sizes[row] else np.uint32).astype("<u4")
                crc[i] = zlib.crc32(own[a:z])
                if with_ids:
                    blobs.append(own[a:z].tobytes())
            pick = pa.array(rows)
            columns = {"doc_id": b.column("doc_id").take(pick), "start": flat.field("at"), "length": flat.field("n"), "ids_crc32": pa.array(crc), "doc_tokens": b.column("n").take(pick)}
            columns |= {"sequence_id": flat.field("sequence_id"), "offset": flat.field("offset"), "queue": b.column("queue").take(pick)}
            if with_ids:
                columns["ids"] = pa.array(blobs, pa.binary())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def pack(docs: DataFrame, window: int = WINDOW, unit: int = UNIT, vocabulary: str = VOCABULARY, temper: float = TEMPER, weights: dict[str, float] | None = None, with_ids: bool = True) -> DataFrame:
    """All pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue and, with_ids, ids (little-endian, 32 bits)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = encode(docs, vocabulary)
    pieces = schedule(rows.select("key", "queue", "n", "before"), window, unit, temper, weights)
    of = pieces.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("at", "n", "sequence_id", "offset"))).alias("pieces"))
    placed = rows.select("key", "doc_id", "queue", "n", "ids").join(of, "key").drop("key")
    return placed.mapInArrow(_cutter(with_ids), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long, queue string" + ", ids binary" * with_ids)


def sequences(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """sequence_id and ids, a window each: its pieces in order, zero-padded to the window where the length is no power of two."""
    whole = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    ids = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    n = F.octet_length("ids") / 4
    padded = F.when(F.log2(n) == F.floor(F.log2(n)), F.col("ids")).otherwise(F.rpad(F.col("ids"), 4 * window, F.lit(b"\0")))
    return whole.select("sequence_id", ids.alias("ids")).select("sequence_id", padded.alias("ids"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack(table(spark, sf_dir, "documents"), with_ids=False)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", F.regexp_replace("queue", "^source:", "").alias("source"))

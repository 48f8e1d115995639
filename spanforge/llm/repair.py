"""Token-id files compressed by Re-Pair grammars.

Texts are range-partitioned into ascending doc_id order, encoded, and packed into shards of about SHARD_IDS ids. In every shard frequent
pairs of symbols are replaced by new symbols (nonterminals), round after round, until no pair occurs MIN_COUNT times (each replaced one
saves a symbol of two bytes, a rule takes twelve). The first rounds replace those together that reach a bound, which falls to an eighth each time; then one
replaces all frequent ones, and from then on only pairs with a symbol of the round before can be frequent: they are counted where these
symbols stand. Of overlapping pairs the left one counts. No pair spans two documents.

A shard is one value: a header, the rules (two symbols each), the length of every rule's expansion, where each document starts in the
compressed symbols and among the ids, the documents' ids, and the symbols. A document is decoded by expanding its own symbols alone,
and any range of its ids by skipping with the expansion lengths. Shards are the rows of a Parquet table (shard, n_docs, n_ids, payload), ascending
by shard, so that Spark's writers commit them and any store that Spark reads can hold them.

Edge cases: a null text counts as empty, and every document gets the end id; a null doc_id comes first; rows that repeat an id are ordered by
the hash of their text, and equal rows are all written; a long text is never cut, its shard is longer; an empty table gives no shards;
extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, parts, running_totals, table
from .tokens import encoder

VOCABULARY = "word_bpe_49k.json"
SHARD_IDS = 2_000_000
#: Pieces whose ids a worker holds, twice over; there is more room for them here than where texts are packed.
CACHE_PIECES = 500_000
#: Shards of one partition have consecutive numbers below this factor.
PER_PARTITION = 1 << 16
MIN_COUNT, STEP, BIN_BITS = 24, 8, 19
_MAGIC, _HEAD = b"RPSH", struct.Struct("<4sIQQQQ")  # magic, first nonterminal, documents, rules, symbols, ids


def _frequent(keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys that occur MIN_COUNT times, and of the places at those where one stands, with its number among them."""
    pairs, which, times = np.unique(keys, return_inverse=True, return_counts=True)
    good = times >= MIN_COUNT
    hit = good[which]
    return pairs[good], at[hit], (np.cumsum(good) - 1)[which[hit]]


def _pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return left.astype(np.uint64) << np.uint64(32) | right


def _at_least(seq: np.ndarray, edges: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As _frequent for the pairs at all places of seq but edges: all pairs if least is MIN_COUNT, else only some of those that occur least times."""
    n = 1 << BIN_BITS
    left, right = seq[:-1], seq[1:]
    bins = ((left * np.uint32(0x9E3779B1) ^ right * np.uint32(0x85EBCA77)) >> np.uint32(32 - BIN_BITS)).astype(np.int64)
    bins[edges] = n
    counts = np.bincount(bins, minlength=n + 1)
    counts[n] = 0
    at = np.flatnonzero((counts >= least)[bins])
    if least == MIN_COUNT:
        return _frequent(_pair_keys(left[at], right[at]), at)
    own, where = _pair_keys(left[at], right[at]), bins[at]
    held = np.zeros(n + 1, dtype=np.uint64)
    held[where] = own  # one pair stands for a bin
    same = held[where] == own
    at, where = at[same], where[same]
    good = np.bincount(where, minlength=n + 1) >= least
    hit = good[where]
    return held[good], at[hit], (np.cumsum(good) - 1)[where[hit]]


def compress(ids: np.ndarray, starts: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """symbols, where each document starts in them, and rules (n, 2); nonterminal base + i stands for rules[i]. starts ascend from 0."""
    seq = ids.astype(np.uint32)
    fresh = np.zeros(len(seq), dtype=bool)
    fresh[starts] = True
    rules: list[np.ndarray] = []
    symbol, newest, least = base, base, max(len(seq) // 32, STEP * MIN_COUNT)
    while len(seq) > 1:
        if least == MIN_COUNT:
            # all frequent pairs have been replaced, so only one with a symbol of the last round can have become frequent
            new = np.flatnonzero(seq >= newest)
            at = np.unique(np.concatenate([new - 1, new]))
            at = at[(at >= 0) & (at < len(seq) - 1)]
            at = at[~fresh[at + 1]]
            pairs, at, chosen = _frequent(_pair_keys(seq[at], seq[at + 1]), at)
        else:
            least = max(MIN_COUNT, least // STEP)
            pairs, at, chosen = _at_least(seq, np.flatnonzero(fresh[1:]), least)
        if not len(pairs):
            if least == MIN_COUNT:
                break
            continue
        # of overlapping pairs every second one, counted from the left end of their run; so each is replaced or broken up
        first = np.concatenate(([True], np.diff(at) > 1))
        run = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
        even = (np.arange(len(at)) - run) % 2 == 0
        at, chosen = at[even], chosen[even]
        rules.append(np.stack([pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32))
        seq[at] = (symbol + chosen).astype(np.uint32)
        keep = np.ones(len(seq), dtype=bool)
        keep[at + 1] = False
        seq, fresh = seq[keep], fresh[keep]
        newest, symbol = symbol, symbol + len(pairs)
    return seq, np.flatnonzero(fresh), np.concatenate(rules) if rules else np.zeros((0, 2), dtype=np.uint32)


def expansion_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """Ids that each rule stands for. Rules refer to earlier ones only; those of a round never to each other."""
    lengths = np.ones(len(rules), dtype=np.int64)
    done = 0
    while done < len(rules):
        ready = done + int(np.argmax(np.append((rules[done:] >= base + done).any(axis=1), True)))
        side = rules[done:ready].astype(np.int64) - base
        lengths[done:ready] = np.where(side >= 0, lengths[np.maximum(side, 0)], 1).sum(axis=1)
        done = ready
    return lengths


def expand(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The ids that symbols stand for."""
    seq = symbols.astype(np.uint32)
    while len(rules) and (deep := seq >= base).any():
        size = 1 + deep.astype(np.int64)
        at = np.cumsum(size) - size
        out = np.empty(int(size.sum()), dtype=np.uint32)
        out[at] = seq
        pair = rules[seq[deep] - base]
        out[at[deep]], out[at[deep] + 1] = pair[:, 0], pair[:, 1]
        seq = out
    return seq


class Expander:
    """Expands symbols with the expansions of all rules, made once."""

    def __init__(self, rules: np.ndarray, lengths: np.ndarray, base: int):
        self.base, self.lengths = base, lengths.astype(np.int64)
        self.flat = expand(base + np.arange(len(rules)), rules, base)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def __call__(self, symbols: np.ndarray) -> np.ndarray:
        deep = np.flatnonzero(symbols >= self.base)
        rule = symbols[deep].astype(np.int64) - self.base
        took = self.lengths[rule]
        sizes = np.ones(len(symbols), dtype=np.int64)
        sizes[deep] = took
        out = np.repeat(symbols.astype(np.uint32), sizes)
        before = np.cumsum(took) - took
        inside = np.arange(int(took.sum())) - np.repeat(before, took)
        out[np.repeat((np.cumsum(sizes) - sizes)[deep], took) + inside] = self.flat[np.repeat(self.starts[rule], took) + inside]
        return out


class Shard:
    """A written shard; documents and ranges of their ids are decoded one by one."""

    def __init__(self, payload: bytes):
        magic, self.base, docs, rules, symbols, ids = _HEAD.unpack_from(payload)
        if magic != _MAGIC:
            raise ValueError("not a shard")
        at = _HEAD.size

        def take(n: int, kind: str) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, dtype=kind, count=n, offset=at)
            at += out.nbytes
            return out

        self.rules = take(2 * rules, "<u4").reshape(-1, 2)
        self.lengths = take(rules, "<u4")
        self.cuts = np.append(take(docs, "<u8"), symbols).astype(np.int64)
        self.starts = np.append(take(docs, "<u8"), ids).astype(np.int64)
        wide = self.base + rules > 1 << 16
        self.symbols = take(symbols, "<u4" if wide else "<u2")
        self.expand = Expander(self.rules, self.lengths, self.base)

    @staticmethod
    def pack(ids: np.ndarray, starts: np.ndarray, base: int) -> bytes:
        symbols, cuts, rules = compress(ids, starts, base)
        kind = "<u4" if base + len(rules) > 1 << 16 else "<u2"
        arrays = [rules.astype("<u4"), expansion_lengths(rules, base).astype("<u4"), cuts.astype("<u8"), starts.astype("<u8"), symbols.astype(kind)]
        return _HEAD.pack(_MAGIC, base, len(starts), len(rules), len(symbols), len(ids)) + b"".join(a.tobytes() for a in arrays)

    def document(self, i: int) -> np.ndarray:
        return self.expand(self.symbols[self.cuts[i] : self.cuts[i + 1]])

    def ids(self, i: int, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of document i; only the symbols that hold them are expanded."""
        own = self.symbols[self.cuts[i] : self.cuts[i + 1]].astype(np.int64)
        size = np.ones(len(own), dtype=np.int64)
        deep = own >= self.base
        size[deep] = self.lengths[own[deep] - self.base]
        ends = np.cumsum(size)
        a, b = int(np.searchsorted(ends, start, side="right")), int(np.searchsorted(ends, stop, side="left")) + 1
        before = int(ends[a] - size[a]) if a < len(ends) else start
        return self.expand(own[a:b])[start - before :][: max(0, stop - start)]


def write_shards(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Encodes and writes all of docs; the table of shards: shard, n_docs, n_ids, doc_ids, payload."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary, False, pieces=CACHE_PIECES)
        base = coder.tokenizer.get_vocab_size()
        names, held, size, k = [], [], 0, 0
        part = TaskContext.get().partitionId()

        def shard() -> pa.RecordBatch:
            counts = np.array([len(x) for x in held], dtype=np.int64)
            payload = Shard.pack(np.concatenate(held), np.cumsum(counts) - counts, base)
            columns = [pa.array([part * PER_PARTITION + k], pa.int64()), pa.array([len(held)], pa.int64()), pa.array([int(counts.sum())], pa.int64()), pa.array([names], pa.list_(id_type)), pa.array([payload], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["shard", "n_docs", "n_ids", "doc_ids", "payload"])

        id_type = None
        for b in batches:
            id_type = b.column(0).type
            for name, ids in zip(b.column(0).to_pylist(), coder.documents(b.column(1).to_pylist()), strict=True):
                names.append(name)
                held.append(ids)
                size += len(ids)
                if size >= SHARD_IDS:
                    yield shard()
                    names, held, size, k = [], [], 0, k + 1
        if held:
            yield shard()

    ordered = docs.select("doc_id", "text").repartitionByRange(parts(docs.sparkSession), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return cut(ordered.mapInArrow(pack, f"shard long, n_docs long, n_ids long, doc_ids array<{kind}>, payload binary"), "token-shards")


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for shard, names, payload in zip(b.column("shard"), b.column("doc_ids"), b.column("payload"), strict=True):
            s = Shard(payload.as_py())
            whole = s.expand(s.symbols).astype("<u4")
            crc = [zlib.crc32(whole[x:y]) for x, y in zip(s.starts[:-1], s.starts[1:], strict=True)]
            n = len(crc)
            columns = [pa.array([shard.as_py()] * n, pa.int64()), names.values, pa.array(s.starts[:-1]), pa.array(np.diff(s.starts)), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "doc_id", "at", "n_tokens", "ids_crc32"])


def read_documents(shards: DataFrame) -> DataFrame:
    """A row for each document, decoded from the shards: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()
    base = running_totals(shards.select("shard", "n_ids"), [], "shard", "n_ids", "base", width=PER_PARTITION, levels=2).select("shard", "base")
    rows = shards.select("shard", "doc_ids", "payload").mapInArrow(_decode, f"shard long, doc_id {kind}, at long, n_tokens long, ids_crc32 long")
    return rows.join(base, "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op4_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_documents(write_shards(table(spark, sf_dir, "documents")))

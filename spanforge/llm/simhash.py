"""SimHash near-duplicates by deletion-variant signatures.

Fingerprint: 64 bits over all 3-word shingles of the lower-cased text; a bit is 1 if more than half of the shingles' XXH64 (seed 42)
have it set. Documents whose fingerprints differ in at most two bits are linked.

Candidates: a fingerprint is cut into two segments of 32 bits, so of two linked ones at least one segment differs in at most one bit.
Each distinct fingerprint is indexed under every segment with one bit wildcarded (64 keys); an equality grouping on the key brings
candidates together and each pair is verified by its Hamming distance. A pair is reported from one key only. Buckets are counted first, with
partial sums before the shuffle, and only those of BUCKET_LIMIT fingerprints or less are gathered. Larger ones aren't paired up: their
members are indexed a second time under their own value and its 64 one-bit flips. Two values share such a point exactly if they differ in at most two bits, a point holds at most 65 values, and
every member is linked to the point's least, so that a hot bucket costs work in proportion to its size and loses no link.

Groups are connected components of distinct fingerprints, found by hooking and pointer jumping on tables in the shared folder; exact
copies are folded into one fingerprint first and never paired. All joins that a large group could skew read both sides from
tables, so that Spark can split them.

Edge cases: a null or wordless text has fingerprint 0; with one or two words the whole sequence is the one shingle; a null doc_id keeps its row
and is named by a group only if the group has no other id; repeated rows stay, each with its group; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

SEED, SHINGLE, BITS, MAX_DISTANCE = 42, 3, 64, 2
BUCKET_LIMIT = 32
MAX_ROUNDS = 60

#: Bits of a byte, for counting set bits by byte value.
_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)
_BLOCK = 1 << 18


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a text, unsigned."""
    if not text:
        return 0
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, and only ASCII white space parts words
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    n = max(1, len(words) - SHINGLE + 1)
    starts = np.concatenate(([0], ends[: n - 1] + 1))
    stops = ends[min(SHINGLE, len(words)) - 1 :]
    counts = np.zeros((8, 8), dtype=np.int64)
    one = xxhash.xxh64_intdigest
    for at in range(0, n, _BLOCK):
        pairs = zip(starts[at : at + _BLOCK].tolist(), stops[at : at + _BLOCK].tolist(), strict=True)
        hashes = np.array([one(joined[a:b], SEED) for a, b in pairs], dtype="<u8").view(np.uint8).reshape(-1, 8)
        for k in range(8):
            counts[k] += np.bincount(hashes[:, k], minlength=256) @ _BYTE_BITS
    bits = (2 * counts.reshape(-1) > n).astype(np.uint8)
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), dtype=np.uint64, count=b.num_rows).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_fingerprints, f"doc_id {kind}, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def variants(fps: DataFrame) -> DataFrame:
    """key and fp: one row for each segment and wildcarded bit. The key holds bit, segment and what is left of the segment."""
    keys = []
    for s in range(2):
        segment = F.shiftrightunsigned("fp", 32 * s).bitwiseAND(F.lit(0xFFFFFFFF))
        for b in range(32):
            keys.append(segment.bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << b))).bitwiseOR(F.lit((s << 37) | (b << 32))))
    return fps.select("fp", F.explode(F.array(*keys)).alias("key"))


def _segment(x: Column, s: int) -> Column:
    return F.shiftrightunsigned(x, 32 * s).bitwiseAND(F.lit(0xFFFFFFFF))


def links(fps: DataFrame) -> DataFrame:
    """a and b, different fingerprints at distance two or less: all such pairs from small buckets, spanning ones from large buckets."""
    sizes = cut(variants(fps).groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "simhash-keys")
    members = cut(variants(fps).join(sizes, "key"), "simhash-members")
    small = members.filter(f"size <= {BUCKET_LIMIT}").groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("m"))
    near = "flatten(transform(m, (x, i) -> transform(filter(slice(m, i + 2, size(m)), y -> bit_count(x ^ y) <= 2), y -> named_struct('a', x, 'b', y))))"
    pairs = small.select("key", F.explode(F.expr(near)).alias("p")).select("key", "p.a", "p.b")
    x = F.col("a").bitwiseXOR(F.col("b"))
    s, bit = F.shiftright("key", 37), F.shiftright("key", 32).bitwiseAND(F.lit(31))
    low, high = _segment(x, 0), _segment(x, 1)
    mine = F.when(s == 0, low).otherwise(high)
    # from the first segment that differs in one bit or none, and there from the bit that differs, or bit 0
    first = (s == 0) | (F.bit_count(low) > 1)
    at = F.when(mine == 0, bit == 0).otherwise(mine == F.expr("shiftleft(1L, cast(shiftright(key, 32) & 31 as int))"))
    small = pairs.filter(first & at).select("a", "b")
    hot = members.filter(f"size > {BUCKET_LIMIT}").select("fp").distinct()
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(BITS)])
    points = cut(hot.select("fp", F.explode(flips).alias("point")), "simhash-points")
    least = points.groupBy("point").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1").select("point", "a")
    stars = points.join(least, "point").filter("fp <> a").select("a", F.col("fp").alias("b")).distinct()
    return small.unionByName(stars)


def components(edges: DataFrame) -> DataFrame:
    """node and label of every node of edges (a, b); a component's label is its least node.

    Each round hooks the parent of a node, and the node, onto the least grandparent among its neighbours and then jumps to grandparents;
    rounds end when nothing changes. All tables lie in the shared folder."""
    e = cut(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "cc-edges")
    state = cut(e.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("f")), "cc-state")
    for _ in range(MAX_ROUNDS):
        up = state.select(F.col("node").alias("f"), F.col("f").alias("g"))
        t = cut(state.join(up, "f").select("node", "f", "g"), "cc-up")
        offered = e.join(t.select(F.col("node").alias("b"), F.col("g").alias("gb")), "b").groupBy("a").agg(F.min("gb").alias("m"))
        merged = t.join(offered, F.col("node") == F.col("a"))
        best = F.least("f", "g", "m")
        wanted = merged.select(F.explode(F.array(F.struct(F.col("node").alias("node"), best.alias("f"), F.col("f").alias("was")), F.struct(F.col("f").alias("node"), best.alias("f"), F.lit(None).cast("long").alias("was")))).alias("x")).select("x.*")
        new = cut(wanted.groupBy("node").agg(F.min("f").alias("f"), F.max("was").alias("was")), "cc-state")
        if not new.filter("f <> was").limit(1).count():
            return new.select("node", F.col("f").alias("label"))
        state = new.select("node", "f")
    raise RuntimeError("components did not settle; raise MAX_ROUNDS")


def groups(of: DataFrame) -> DataFrame:
    """fp, label (one for each group) and component_id (the group's least doc_id) of every fingerprint of of (doc_id, fp)."""
    distinct = cut(of.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    labels = components(links(distinct.select("fp")))
    named = cut(distinct.join(labels, distinct["fp"] == labels["node"], "left").select("fp", "first", F.coalesce("label", "fp").alias("label")), "simhash-labels")
    least = cut(named.groupBy("label").agg(F.min("first").alias("component_id")), "simhash-least")
    return cut(named.join(least, "label").select("fp", "label", "component_id"), "simhash-groups")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp (long) and component_id (least doc_id of the group) of every row of docs."""
    of = cut(fingerprints(docs), "simhash-fp")
    return of.join(groups(of), "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """One row of docs for each group: the one with the least id (a null one last), of several texts under it the one with the least hash.

    A row belongs to the group of its own text, whatever else its id names; of rows equal in id and text any one stays."""
    packed = docs.select(F.struct(*docs.columns).alias("__row"), F.col("doc_id").alias("__d"), F.xxhash64("text").alias("__h"))
    of = cut(fingerprints(packed.select(F.struct(F.col("__d").alias("doc_id"), "__h").alias("doc_id"), F.col("__row.text").alias("text"))).select("doc_id.*", "fp"), "simhash-fp")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "__h")
    chosen = cut(of.join(groups(of), "fp").groupBy("label").agg(F.min(rank).alias("r")).select(F.col("r.doc_id").alias("__id"), F.col("r.__h").alias("__own")), "simhash-chosen")
    kept = packed.join(chosen, (F.col("__h") == F.col("__own")) & F.col("__d").eqNullSafe(F.col("__id")), "left_semi")
    return kept.groupBy("__d", "__h").agg(F.first("__row").alias("__row")).select("__row.*")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

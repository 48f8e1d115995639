"""Product codes of vectors by filtering Lloyd.

Vectors become whole numbers and are cut into PARTS equal consecutive parts. Each part position has a codebook, which starts with that part of
the vectors with the least ids; a round assigns every part to its nearest entry and moves each entry to the mean of its parts, rounded down.

Every partition builds its kd-trees once, in blocks of at most BLOCK vectors: a tree for each part position, halved along the widest side
of a node's bounding box at the median, with boxes, sums and counts of all its nodes. The trees lie in a table in the shared folder, so a lost
executor costs the tasks it ran, and no round sorts or sums points again. A round walks a tree from the root, a level at a time: of a node's
remaining entries the one nearest to the middle of the box is compared with each other one, over the whole box (the difference of two squared
distances is linear, so its least value is at a corner); entries that are nowhere in the box better are eliminated. Where one entry is left,
it takes the whole subtree by the cached sums and counts. Only points in leaves with several entries left are compared one by one, with
those entries. Ties go to the lower index, in the elimination, too, so codes are exactly those of full comparison.

A task returns a sum and a count for each entry, part and dimension; codebooks are a fixed number of entries, and go to the driver and out again.
All arithmetic is in whole numbers: doubles that hold them exactly where the entries' size allows it, Python's integers where not.

Edge cases: rows whose vector is null or holds a null or non-finite entry are dropped; fewer vectors than entries give shorter codebooks; rows
that repeat an id are seeds and coded like any others (ties in the order of seeds by the vector); null ids come last among seeds; equal entries
leave all but the first without parts, and those stay as they are; vectors of different lengths, or of a length that PARTS doesn't divide, are an
error; empty vectors get code 0 everywhere; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .whitening import usable

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Vectors in a block, and points in a leaf at most.
BLOCK, LEAF = 16_384, 32
#: Whole numbers below this are exact as doubles.
EXACT = 2**53

_ARRAYS = ("points", "place", "first", "low", "high", "sums")


def arithmetic(size: int, largest: int) -> type:
    """The type in which squared distances between parts of size entries, none larger than largest, are exact."""
    return np.float64 if 16 * max(size, 1) * largest * largest < EXACT else object


class Tree:
    """A kd-tree over points (a row each): node k has the children 2k+1 and 2k+2, the last level are the leaves.

    points are in the order of the leaves, place is the row that each had; first[k] to first[k+1] are the points of leaf k."""

    def __init__(self, points: np.ndarray, place: np.ndarray, first: np.ndarray, low: np.ndarray, high: np.ndarray, sums: np.ndarray):
        self.points, self.place, self.first, self.low, self.high, self.sums = points, place, first, low, high, sums
        self.leaves = len(first) - 1
        self.levels = self.leaves.bit_length() - 1

    @classmethod
    def build(cls, points: np.ndarray) -> Tree:
        n = len(points)
        levels = max(0, int(np.ceil(np.log2(max(1, n / LEAF)))))
        place, bounds = np.arange(n), [0, n]
        for _ in range(levels):
            split = [0]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                own, half = place[a:b], (b - a) // 2
                box = points[own]
                side = int(np.argmax(box.max(axis=0) - box.min(axis=0))) if points.shape[1] else 0
                place[a:b] = own[np.argpartition(box[:, side], half)] if points.shape[1] else own
                split += [a + half, b]
            bounds = split
        ordered, first = points[place], np.array(bounds)
        low, high = np.minimum.reduceat(ordered, first[:-1]), np.maximum.reduceat(ordered, first[:-1])
        sums = np.add.reduceat(ordered, first[:-1])
        boxes = [(low, high, sums)]
        for _ in range(levels):
            low, high, sums = boxes[-1]
            boxes.append((np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2]), sums[::2] + sums[1::2]))
        return cls(ordered, place, first, *(np.concatenate([x[k] for x in boxes[::-1]]) for k in range(3)))

    def packed(self) -> list[bytes]:
        return [np.ascontiguousarray(x, dtype="<i8").tobytes() for x in (self.points, self.place, self.first, self.low, self.high, self.sums)]

    @classmethod
    def unpacked(cls, size: int, parts: list[bytes]) -> Tree:
        flat = [np.frombuffer(x, dtype="<i8") for x in parts]
        n = len(flat[1])
        rows = (n, 2 * len(flat[2]) - 3)
        return cls(flat[0].reshape(rows[0], size), flat[1], flat[2], *(x.reshape(rows[1], size) for x in flat[3:]))

    def assign(self, book: np.ndarray, kind: type, each: bool) -> tuple[np.ndarray | None, np.ndarray, np.ndarray]:
        """Codes by place (with each), and sums and counts of every entry of book."""
        m, size = book.shape
        c = book.astype(kind)
        norms = (c * c).sum(axis=1)
        sums, counts = np.zeros((m, size), dtype=np.int64), np.zeros(m, dtype=np.int64)
        codes = np.zeros(len(self.points), dtype=np.int64) if each else None
        span = self.first[np.arange(0, self.leaves + 1)]
        nodes, left = np.zeros(1, dtype=np.int64), np.ones((1, m), dtype=bool)
        for level in range(self.levels + 1):
            begin = 2**level - 1
            left = self._eliminate(begin + nodes, left, c, norms, kind)
            only = left.sum(axis=1) == 1
            if only.any():
                best = left[only].argmax(axis=1)
                width = 1 << (self.levels - level)
                a, b = span[nodes[only] * width], span[(nodes[only] + 1) * width]
                np.add.at(sums, best, self.sums[begin + nodes[only]])
                np.add.at(counts, best, b - a)
                if each:
                    for x, y, e in zip(a.tolist(), b.tolist(), best.tolist(), strict=True):
                        codes[x:y] = e
                nodes, left = nodes[~only], left[~only]
            if level < self.levels:
                nodes, left = np.repeat(2 * nodes, 2) + np.tile([0, 1], len(nodes)), np.repeat(left, 2, axis=0)
        for leaf, row in zip(nodes.tolist(), left, strict=True):
            a, b = int(span[leaf]), int(span[leaf + 1])
            entries = np.flatnonzero(row)
            near = entries[np.argmin(norms[entries][None, :] - 2 * (self.points[a:b].astype(kind) @ c[entries].T), axis=1)]
            np.add.at(sums, near, self.points[a:b])
            counts += np.bincount(near, minlength=m)
            if each:
                codes[a:b] = near
        if each:
            back = np.empty_like(codes)
            back[self.place] = codes
            codes = back
        return codes, sums, counts

    def _eliminate(self, at: np.ndarray, left: np.ndarray, c: np.ndarray, norms: np.ndarray, kind: type) -> np.ndarray:
        """left without the entries that another one beats everywhere in the node's box.

        With z* nearest to the box's middle, twice the least of |p-z|^2 - |p-z*|^2 over the box is
        2|z|^2 - 2|z*|^2 - 2 (low+high).(z-z*) - 2 (high-low).|z-z*|."""
        if not len(at):
            return left
        double = (self.low[at] + self.high[at]).astype(kind)
        wide = (self.high[at] - self.low[at]).astype(kind)
        toward = norms[None, :] - double @ c.T  # |middle - z|^2 without |middle|^2
        far = toward.max() + 1
        best = np.argmin(np.where(left, toward, far), axis=1)
        least = toward - toward[np.arange(len(at)), best][:, None]
        for z in np.unique(best):
            mine = best == z
            least[mine] -= wide[mine] @ np.abs(c - c[z]).T
        index = np.arange(len(c))[None, :]
        beaten = (least > 0) | ((least == 0) & (index > best[:, None]))
        beaten[np.arange(len(at)), best] = False
        return left & ~beaten


def _plant(size: int):
    """Rows (vec_id, label, x) to blocks: the ids and labels as lists and a tree for each part."""

    def build(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        x = rows["x"].combine_chunks()
        points = np.asarray(x.flatten() if not isinstance(x, pa.ChunkedArray) else pa.concat_arrays(x.chunks).flatten(), dtype=np.int64).reshape(len(rows), PARTS * size)
        trees = [Tree.build(np.ascontiguousarray(points[:, p * size : (p + 1) * size])).packed() for p in range(PARTS)]
        one = pa.array([0, len(rows)], pa.int32())
        ids, labels = (pa.ListArray.from_arrays(one, pa.concat_arrays(rows[c].chunks)) for c in ("vec_id", "label"))
        packed = pa.array([[dict(zip(_ARRAYS, t, strict=True)) for t in trees]], pa.list_(pa.struct([(n, pa.binary()) for n in _ARRAYS])))
        return pa.RecordBatch.from_arrays([ids, labels, packed], names=["vec_ids", "labels", "trees"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            while b.num_rows:
                part = b.slice(0, BLOCK - n)
                held.append(part)
                n, b = n + part.num_rows, b.slice(part.num_rows)
                if n == BLOCK:
                    yield build(held)
                    held, n = [], 0
        if held:
            yield build(held)

    return run


def _trees(b: pa.RecordBatch, size: int) -> Iterator[tuple[int, list[Tree]]]:
    for k, row in enumerate(b.column("trees")):
        yield k, [Tree.unpacked(size, [t[n].as_py() for n in _ARRAYS]) for t in row.values]


def _totals(books: list[np.ndarray], size: int, kind: type):
    """Blocks to a row for each part, entry and dimension: the sum and the count of the task's points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = len(books[0])
        sums, counts = np.zeros((PARTS, m, size), dtype=np.int64), np.zeros((PARTS, m), dtype=np.int64)
        for b in batches:
            for _, trees in _trees(b, size):
                for p, t in enumerate(trees):
                    _, s, n = t.assign(books[p], kind, each=False)
                    sums[p] += s
                    counts[p] += n
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]), pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * size, pa.int32()), pa.array(sums[part, entry].ravel()))],
            names=["part", "entry", "n", "sums"],
        )

    return run


def _coded(books: list[np.ndarray], size: int, kind: type):
    """Blocks to vec_id, label, code and error of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, trees in _trees(b, size):
                codes, error = [], 0
                for book, t in zip(books, trees, strict=True):
                    own = t.assign(book, kind, each=True)[0]
                    back = np.empty_like(t.points)
                    back[t.place] = t.points
                    d = (back - book[own]).astype(kind)
                    codes.append(own)
                    error = error + (d * d).sum(axis=1)
                text = np.char.mod("%02x", np.stack(codes, axis=1))
                yield pa.RecordBatch.from_arrays(
                    [b.column("vec_ids")[k].values, b.column("labels")[k].values, pa.array(["".join(r) for r in text.tolist()]), pa.array([int(e) for e in error], pa.int64())],
                    names=["vec_id", "label", "code", "error"],
                )

    return run


def whole(rows: DataFrame) -> DataFrame:
    """vec_id, label and x, the vector in whole numbers, of the usable rows."""
    x = F.transform(F.col("embedding").cast("array<double>"), lambda c: F.floor(c * float(SCALE)).cast("long"))
    return rows.filter(usable("embedding")).select("vec_id", "label", x.alias("x"))


def encode(rows: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """vec_id, label, code and error of rows (vec_id, embedding, label), and the final codebooks."""
    kept = whole(rows)
    kinds = {c: kept.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    shape = kept.agg(F.count("*").alias("n"), F.min(F.size("x")).alias("lo"), F.max(F.size("x")).alias("hi"), F.max(F.array_max(F.transform("x", F.abs))).alias("largest")).first()
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"
    if not shape["n"]:
        return kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), []
    if shape["lo"] != shape["hi"] or shape["hi"] % PARTS:
        raise ValueError(f"vectors of {shape['lo']} to {shape['hi']} entries can't be cut into {PARTS} equal parts")
    size = shape["hi"] // PARTS
    kind = arithmetic(size, shape["largest"] or 0)
    seeds = kept.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()  # a codebook
    first = np.array([r["x"] for r in seeds], dtype=np.int64).reshape(len(seeds), PARTS * size)
    books = [first[:, p * size : (p + 1) * size].copy() for p in range(PARTS)]
    blocks = cut(kept.mapInArrow(_plant(size), f"vec_ids array<{kinds['vec_id']}>, labels array<{kinds['label']}>, trees array<struct<{', '.join(f'{x}:binary' for x in _ARRAYS)}>>"), "vector-trees")
    for _ in range(rounds):
        flat = blocks.mapInArrow(_totals(books, size, kind), "part int, entry int, n long, sums array<long>").select("part", "entry", "n", F.posexplode_outer("sums").alias("i", "s"))
        # at most a row for each number of the codebooks
        for r in flat.groupBy("part", "entry", "i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect():
            if r["i"] is not None:
                books[r["part"]][r["entry"], r["i"]] = r["s"] // r["n"]
    return blocks.mapInArrow(_coded(books, size, kind), schema), books


def with_label_error(coded: DataFrame) -> DataFrame:
    """coded (a table) with the error summed over the rows of its label, null labels together."""
    totals = cut(coded.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error")), "vector-labels")
    return coded.join(totals, F.col("label").eqNullSafe(F.col("__label"))).drop("__label")


def fingerprint(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel()).encode()).hexdigest()


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = encode(table(spark, sf_dir, "embeddings"))
    out = with_label_error(cut(coded, "vector-codes"))
    return out.select("vec_id", "code", "error", "label_error", F.lit(fingerprint(books)).alias("codebooks_sha256"))

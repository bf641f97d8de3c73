"""Product codes of vectors by filtering Lloyd iterations over kd-trees.

Vectors become integers floor(SCALE * x) and are cut into PARTS consecutive
parts (equal ones where PARTS divides the length). Each part position has a
codebook, which starts as that part of the ENTRIES rows of smallest vec_id. A
round assigns every part to its nearest entry and puts the floored mean of its
parts in each entry's place; after ROUNDS rounds parts are assigned once more.

Every partition cuts its rows into blocks and builds a kd-tree over each part of
a block, once: the order of the rows by tree is written to the shared folder
with them, and a node is a run of that order, so prefix sums hold the sum and
count of every subtree. A round goes down all trees level by level: an entry
that is farther than the one nearest to the middle of a node's box even at the
box's corner on its own side is eliminated for the whole subtree, and a subtree
with one entry left is assigned at once, by its sum and count. Ties (equal
distances at that corner) stay unless the index decides them, so all is exact.
Tasks send sums and counts by entry, which Spark adds up; the driver holds
codebooks alone.

Rows of null vectors and of vectors that hold nulls or what isn't finite are
left out. Vectors of each length have codebooks of their own; lengths that
PARTS doesn't divide have parts that differ by one component, and parts without
components have distance 0. Fewer rows than ENTRIES make that many entries;
rows of equal vec_id start in order of their vectors, null ids last. Integers
are held to what keeps distances in 63 bits; label_error is null if that sum
isn't in them. An empty table gives an empty result. Only the id, vector and
label columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import let_go, staged
from .vectors import blocks, finite_rows, floored, largest_component

SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
LEAF = 8
BLOCK_COMPONENTS = 1 << 19
BLOCK_ROWS = 1 << 16  # an order is kept in 16 bits
BROADCAST_LABELS = 1 << 20
_FAR = np.iinfo(np.int64).max


def part_bounds(dimensions: int, parts: int = PARTS) -> list[int]:
    return [p * dimensions // parts for p in range(parts + 1)]


def _limit(dimensions: int) -> int:
    return largest_component(dimensions) // 4


class PartTree:
    """A balanced kd-tree over integer points: node i of level k is the run i*n >> k to (i+1)*n >> k of `order`."""

    def __init__(self, points: np.ndarray, order: np.ndarray | None = None):
        self.n = len(points)
        self.depth = max(0, (max(self.n, 1) - 1) // LEAF).bit_length()
        self.order = self._sorted(points) if order is None else order
        self.points = points[self.order]
        self.sums = np.vstack([np.zeros((1, points.shape[1]), np.int64), np.cumsum(self.points, axis=0)])

    def bounds(self, level: int) -> np.ndarray:
        return (np.arange((1 << level) + 1) * self.n) >> level

    def _sorted(self, points: np.ndarray) -> np.ndarray:
        order = np.arange(self.n)
        for level in range(self.depth):
            starts = self.bounds(level)
            now = points[order]
            spread = np.maximum.reduceat(now, starts[:-1]) - np.minimum.reduceat(now, starts[:-1])
            node = np.repeat(np.arange(1 << level), np.diff(starts))
            along = now[np.arange(self.n), spread.argmax(axis=1)[node]]
            order = order[np.lexsort((along, node))]
        return order

    def assigned(self, entries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(start, stop, entry) of runs of the order, which together are all points: each with the nearest entry, ties to the lower index."""
        nodes, able = np.zeros(1, np.int64), np.ones((1, len(entries)), bool)
        for level in range(self.depth + 1):
            starts = self.bounds(level)
            low, high = np.minimum.reduceat(self.points, starts[:-1]), np.maximum.reduceat(self.points, starts[:-1])
            below: list[tuple[np.ndarray, np.ndarray]] = []
            for at in range(0, len(nodes), 1024):
                own, left = nodes[at : at + 1024], self._filtered(entries, able[at : at + 1024], low[nodes[at : at + 1024]], high[nodes[at : at + 1024]])
                alone = left.sum(axis=1) == 1
                yield starts[own[alone]], starts[own[alone] + 1], left[alone].argmax(axis=1)
                own, left = own[~alone], left[~alone]
                if not len(own):
                    continue
                if level < self.depth:
                    below.append((np.stack([2 * own, 2 * own + 1], axis=1).ravel(), np.repeat(left, 2, axis=0)))
                else:
                    size = starts[own + 1] - starts[own]
                    at_points = np.repeat(starts[own] - np.cumsum(size) + size, size) + np.arange(size.sum())
                    distance = ((self.points[at_points][:, None, :] - entries[None]) ** 2).sum(axis=2)
                    yield at_points, at_points + 1, np.where(np.repeat(left, size, axis=0), distance, _FAR).argmin(axis=1)
            if not below:
                return
            nodes, able = np.concatenate([b[0] for b in below]), np.concatenate([b[1] for b in below])

    @staticmethod
    def _filtered(entries: np.ndarray, able: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Which of the able entries can be the nearest one of some point of each box."""
        middle = ((2 * entries[None] - (low + high)[:, None, :]) ** 2).sum(axis=2)
        best = np.where(able, middle, _FAR).argmin(axis=1)
        chosen = entries[best][:, None, :]
        corner = np.where(entries[None] > chosen, high[:, None, :], low[:, None, :])
        farther = ((entries[None] - corner) ** 2 - (chosen - corner) ** 2).sum(axis=2)
        index = np.arange(len(entries))[None]
        return able & ((farther < 0) | ((farther == 0) & (index <= best[:, None])))


def tree_blocks(rows: DataFrame, scale: int, parts: int) -> DataFrame:
    """One row for each block of a partition: its ids, labels, integers, and the order of its rows in the tree of each part."""
    label = rows.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for d, others, values in blocks(batches, scale, BLOCK_COMPONENTS, _limit):
            for at in range(0, len(values), BLOCK_ROWS):
                part, own = others.slice(at, BLOCK_ROWS), values[at : at + BLOCK_ROWS]
                cuts = part_bounds(d, parts)
                order = np.stack([PartTree(own[:, a:b]).order if b > a else np.arange(len(own)) for a, b in zip(cuts, cuts[1:], strict=False)]).astype("<u2")
                narrow = own.astype("<i4" if np.abs(own).max(initial=0) < 1 << 31 else "<i8")
                lists = [pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), part.column(c).combine_chunks()) for c in ("id", "label")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d], pa.int32()), *lists, pa.array([narrow.tobytes()], pa.binary()), pa.array([order.tobytes()], pa.binary())], ["d", "ids", "labels", "integers", "orders"]
                )

    return rows.mapInArrow(run, f"d int, ids array<bigint>, labels array<{label}>, integers binary, orders binary")


def _trees(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[tuple[int, pa.RecordBatch, Iterator[tuple[int, PartTree]]]]:
    """(dimensions, the block's row, its trees) of each block."""

    def grown(d: int, integers: np.ndarray, orders: np.ndarray) -> Iterator[tuple[int, PartTree]]:
        cuts = part_bounds(d, parts)
        for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if b > a:
                yield p, PartTree(integers[:, a:b].astype(np.int64), orders[p].astype(np.int64))

    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1)
            d, n = row.column("d")[0].as_py(), len(row.column("ids")[0])
            data = row.column("integers")[0].as_buffer()
            integers = np.frombuffer(data, "<i8" if data.size == 8 * n * d and d else "<i4").reshape(n, d)
            yield d, row, grown(d, integers, np.frombuffer(row.column("orders")[0].as_buffer(), "<u2").reshape(parts, n))


def improved(trees: DataFrame, codebooks: dict[int, np.ndarray], parts: int) -> dict[int, np.ndarray]:
    """The codebooks after one round."""
    shipped = trees.sparkSession.sparkContext.broadcast(codebooks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        books = shipped.value
        totals: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for d, _, own in _trees(batches, parts):
            counts, sums = totals.setdefault(d, (np.zeros((parts, len(books[d])), np.int64), np.zeros(books[d].shape, np.int64)))
            cuts = part_bounds(d, parts)
            for p, tree in own:
                at = slice(cuts[p], cuts[p + 1])
                for start, stop, entry in tree.assigned(books[d][:, at]):
                    np.add.at(counts[p], entry, stop - start)
                    np.add.at(sums[:, at], entry, tree.sums[stop] - tree.sums[start])
        for d, (counts, sums) in totals.items():
            part_of = np.repeat(np.arange(parts), np.diff(part_bounds(d, parts)))
            n = counts[part_of].T  # entry x component
            entry, component = np.nonzero(n)
            columns = [pa.array(np.full(len(entry), d, np.int32)), *(pa.array(c.astype(np.int64)) for c in (entry, component, n[entry, component], sums[entry, component]))]
            yield pa.RecordBatch.from_arrays(columns, ["d", "entry", "component", "n", "total"])

    tallies = trees.select("d", "ids", "integers", "orders").mapInArrow(run, "d int, entry long, component long, n long, total long")
    made = {d: book.copy() for d, book in codebooks.items()}
    for d, entry, component, n, total in tallies.groupBy("d", "entry", "component").agg(F.sum("n"), F.sum("total")).collect():
        made[d][entry, component] = total // n
    return made


def codebook_digest(book: np.ndarray, parts: int = PARTS) -> str:
    cuts = part_bounds(book.shape[1], parts)
    return hashlib.sha256(",".join(str(x) for a, b in zip(cuts, cuts[1:], strict=False) for x in book[:, a:b].ravel().tolist()).encode()).hexdigest()


def coded(trees: DataFrame, codebooks: dict[int, np.ndarray], parts: int) -> DataFrame:
    """vec_id, label, code, error, codebooks_sha256 of each row."""
    shipped = trees.sparkSession.sparkContext.broadcast((codebooks, {d: codebook_digest(b, parts) for d, b in codebooks.items()}))
    label = trees.schema["labels"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        books, digests = shipped.value
        for d, row, own in _trees(batches, parts):
            n, cuts = len(row.column("ids")[0]), part_bounds(d, parts)
            codes, error = np.zeros((n, parts), np.uint8), np.zeros(n, np.int64)
            for p, tree in own:
                book, found = books[d][:, cuts[p] : cuts[p + 1]], np.zeros(n, np.uint8)
                for start, stop, entry in tree.assigned(book):
                    size = stop - start
                    found[np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())] = np.repeat(entry, size)
                codes[tree.order, p] = found
                error[tree.order] += ((tree.points - book[found]) ** 2).sum(axis=1)
            text = codes.tobytes().hex()
            columns = [row.column("ids").flatten(), row.column("labels").flatten(), pa.array([text[2 * parts * k : 2 * parts * (k + 1)] for k in range(n)], pa.string()), pa.array(error), pa.array([digests[d]] * n, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error", "codebooks_sha256"])

    return trees.mapInArrow(run, f"vec_id bigint, label {label}, code string, error bigint, codebooks_sha256 string")


def first_codebooks(rows: DataFrame, scale: int, entries: int) -> dict[int, np.ndarray]:
    """By length, the integers of the rows of smallest id: as many vectors as entries for each length."""
    order = Window.partitionBy("d").orderBy(F.asc_nulls_last("id"), "v")
    first = rows.select("id", "v", F.size("v").alias("d")).withColumn("entry", F.row_number().over(order)).where(F.col("entry") <= entries)
    found: dict[int, list] = {}
    for r in sorted(first.select("d", "entry", "v").collect(), key=lambda r: (r["d"], r["entry"])):
        found.setdefault(r["d"], []).append(r["v"])
    return {d: floored(np.array(vs, np.float64).reshape(len(vs), d), scale, _limit(d)) for d, vs in found.items()}


def code_vectors(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label"
) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """(vec_id, label, code, error, codebooks_sha256) of each usable row, and by length of vector the codebooks: entries x components."""
    if not 0 < entries <= 256:
        raise ValueError("entries must be 1 to 256, as a code has two hex digits for each part")
    rows = finite_rows(vectors, F.col(id_column).cast("long").alias("id"), F.col(label_column).alias("label"), vector_column=vector_column)
    codebooks = first_codebooks(rows, scale, entries)
    trees = staged(tree_blocks(rows, scale, parts), "trees")
    for _ in range(rounds):
        codebooks = improved(trees, codebooks, parts)
    return coded(trees, codebooks, parts), codebooks


def codes_with_label_errors(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of each usable row."""
    rows = staged(code_vectors(vectors, **options)[0], "codes")
    totals = staged(rows.groupBy("label").agg(F.try_sum("error").alias("label_error")), "labels")
    few = totals.count() <= BROADCAST_LABELS
    # many labels are joined by a shuffle, where Spark splits those of many rows
    by_label = totals.select(F.col("label").alias("of_label"), "label_error")
    joined = rows.join(F.broadcast(by_label) if few else by_label, F.col("label").eqNullSafe(F.col("of_label")))
    return joined.select("vec_id", "code", "error", "label_error", "codebooks_sha256")

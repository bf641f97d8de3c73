"""Exact nearest rows by inner product of integers, by distributed histogram selection.

Components become floor(SCALE * x). Queries are taken in chunks of a fixed
number of bytes, which are sent to all tasks; each task scores its rows against
them in blocks, by matrix products. No scores are kept or sorted. A round counts
every score that lies in its query's current range in HISTOGRAM bins; Spark adds
the counts, the bin in which the k-th largest score lies becomes the range of
the next round, and when a bin is one value, that is the k-th value. Rows above
it are then taken in a last pass, and of those equal to it the smallest ids.

Of its counts a task sends only the bins down to its own k-th score: lower ones
can't hold the k-th of all. Equal query rows are searched once. The rows sent
are so at most k bins a query and block of rows, however scores are spread, and
of rows that tie, k a query and block.

A query's own row is no candidate; another row of the same id is, with its own
vector. Candidates of a query are the vectors of its length. Null vectors and
those holding nulls or what isn't finite take no part, nor does a null id as a
query; as a candidate it comes last among ties. Fewer than k candidates are all
returned. Integers are held to what keeps products in 63 bits. An empty table
gives an empty result. Only the id and vector columns are read.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let_go, shared_folder, staged
from .vectors import blocks, finite_rows, floored, largest_component

SCALE = 1024
HISTOGRAM_BITS = 11
CHUNK_BYTES = 16 << 20  # of queries, as 8-byte components
BLOCK_COMPONENTS = 1 << 21
TILE_SCORES = 1 << 21
_EXACT = 1 << 53


class Chunk:
    """Queries by length of vector, numbered on from one length to the next, and what is known of their k-th scores."""

    def __init__(self, rows: list, scale: int, largest: dict[int, int], k: int):
        self.k = k
        self.by_length: dict[int, tuple[int, np.ndarray]] = {}
        rows = sorted(rows, key=lambda r: len(r["v"]))
        self.ids = np.array([r["id"] for r in rows], np.int64)
        self.copies = [r["copies"] for r in rows]
        self.own, self.bound = np.zeros(len(rows), np.int64), 0
        at = 0
        while at < len(rows):
            d = len(rows[at]["v"])
            stop = at + sum(len(r["v"]) == d for r in rows[at:])
            vectors = floored(np.array([r["v"] for r in rows[at:stop]], np.float64).reshape(stop - at, d), scale, largest_component(d))
            self.own[at:stop] = (vectors * vectors).sum(axis=1)
            self.bound = max(self.bound, max(math.isqrt(int(s)) + 1 for s in self.own[at:stop].tolist()) * largest[d])
            self.by_length[d] = (at, vectors)
            at = stop
        self.bound = min(self.bound, (1 << 63) - 1)
        self.bits = (2 * self.bound).bit_length()
        self.low = [-self.bound] * len(rows)  # the range of each query is low .. low + 2^bits - 1
        self.need = np.full(len(rows), k, np.int64)  # which of the largest in the range the k-th of all is

    def __len__(self) -> int:
        return len(self.ids)


def scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer products; floating ones where they hold them."""
    most = int(np.abs(queries).max(initial=0)) * int(np.abs(rows).max(initial=0)) * max(queries.shape[1], 1)
    if most < _EXACT:
        return (queries.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    return queries @ rows.T


def _tiles(chunk: Chunk, batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first query, end, ids of rows, scores) of tiles that cover all queries and all rows of their length."""
    for d, others, values in blocks(batches, scale, BLOCK_COMPONENTS, largest_component):
        if d not in chunk.by_length:
            continue
        first, vectors = chunk.by_length[d]
        ids = others.column("id").combine_chunks()
        for a in range(0, len(values), 1 << 15):
            part = values[a : a + (1 << 15)]
            step = max(1, min(TILE_SCORES // len(part), 1024))  # each has a histogram
            for at in range(0, len(vectors), step):
                yield first + at, first + min(at + step, len(vectors)), ids.slice(a, len(part)), scores(vectors[at : at + step], part)


def _counted(rows: DataFrame, chunk: Chunk, shift: int, scale: int) -> DataFrame:
    """query, bin, n: how many scores of each query lie in each bin of 2^shift values of its range, its own row left out."""
    spark, k = rows.sparkSession, chunk.k
    shipped = spark.sparkContext.broadcast(chunk)
    bins = 1 << (chunk.bits - shift)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        chunk = shipped.value
        low = np.array(chunk.low, np.int64)
        for first, end, _, score in _tiles(chunk, batches, scale):
            # unsigned differences: what lies below the range wraps round to beyond it
            place = (score - low[first:end, None]).view(np.uint64) >> np.uint64(shift)
            query, row = np.nonzero((score >= low[first:end, None]) & (place < bins))
            counts = np.bincount(query * bins + place[query, row].astype(np.int64), minlength=(end - first) * bins).reshape(end - first, bins)
            above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
            query, found = np.nonzero((counts > 0) & (above <= k))  # one more than k, as one may be the query's own
            yield pa.RecordBatch.from_arrays([pa.array((query + first).astype(np.int32)), pa.array(found), pa.array(counts[query, found])], ["query", "bin", "n"])

    with_own = rows.mapInArrow(run, "query int, bin long, n long")
    own = [(q, (s - low) >> shift, -1) for q, (s, low) in enumerate(zip(chunk.own.tolist(), chunk.low, strict=True)) if low <= s < low + (1 << chunk.bits)]
    return with_own.unionByName(spark.createDataFrame(own, "query int, bin long, n long")) if own else with_own


def _refine(rows: DataFrame, chunk: Chunk, scale: int) -> None:
    """One round: narrow each query's range to the bin that holds its k-th score."""
    spark = rows.sparkSession
    shift = max(0, chunk.bits - HISTOGRAM_BITS)
    totals = _counted(rows, chunk, shift, scale).groupBy("query", "bin").agg(F.sum("n").alias("n")).where("n > 0")
    needs = spark.createDataFrame([(q, n) for q, n in enumerate(chunk.need.tolist())], "query int, need long")
    down = Window.partitionBy("query").orderBy(F.desc("bin"))
    held = totals.withColumn("to_here", F.sum("n").over(down)).join(F.broadcast(needs), "query")
    found = held.where((F.col("to_here") >= F.col("need")) & (F.col("to_here") - F.col("n") < F.col("need")))
    short = set(range(len(chunk)))
    for query, place, n, to_here in found.select("query", "bin", "n", "to_here").collect():
        chunk.low[query] += place << shift
        chunk.need[query] -= to_here - n
        short.discard(query)
    for query in short:  # fewer candidates than k: the lowest value there is, so all are taken
        chunk.need[query] = 0
    chunk.bits = shift


def _taken(rows: DataFrame, chunk: Chunk, scale: int) -> DataFrame:
    """query, vec_id, score of all rows above each query's k-th score, and of those equal to it the smallest ids of each tile."""
    shipped, k = rows.sparkSession.sparkContext.broadcast(chunk), chunk.k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        chunk = shipped.value
        low = np.array(chunk.low, np.int64)
        for first, end, ids, score in _tiles(chunk, batches, scale):
            kth = low[first:end, None]
            query, row = np.nonzero(score > kth)
            parts = [(query, row)]
            equal = score == kth
            number = ids.fill_null((1 << 63) - 1).to_numpy()
            for q in np.flatnonzero(equal.any(axis=1)).tolist():
                tied = np.flatnonzero(equal[q])
                if len(tied) > k + 1:
                    tied = tied[np.argpartition(number[tied], k)[: k + 1]]
                parts.append((np.full(len(tied), q), tied))
            query, row = (np.concatenate([p[c] for p in parts]) for c in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array((query + first).astype(np.int32)), ids.take(pa.array(row)), pa.array(score[query, row])], ["query", "vec_id", "score"])

    return rows.mapInArrow(run, "query int, vec_id long, score long")


def _search(rows: DataFrame, chunk: Chunk, scale: int) -> DataFrame:
    """query_id, rank, vec_id, score of the queries of a chunk."""
    spark, k = rows.sparkSession, chunk.k
    while chunk.bits:
        _refine(rows, chunk, scale)
    asked = spark.createDataFrame(list(zip(range(len(chunk)), chunk.ids.tolist(), chunk.own.tolist(), chunk.copies, strict=True)), "query int, query_id long, own long, copies long")
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    near = _taken(rows, chunk, scale).withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    own = F.when((F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own")), F.col("place"))
    placed = near.join(F.broadcast(asked), "query").withColumn("own_place", F.min(own).over(Window.partitionBy("query")))
    others = placed.where(F.col("own_place").isNull() | (F.col("place") != F.col("own_place")))
    rank = F.col("place") - F.when(F.col("place") > F.col("own_place"), 1).otherwise(0)
    once = others.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)
    return once.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("query_id", "rank", "vec_id", "score")


def largest_norms(rows: DataFrame, scale: int) -> dict[int, int]:
    """By length of vector, a whole number that no row's length exceeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        most: dict[int, int] = {}
        for d, _, values in blocks(batches, scale, BLOCK_COMPONENTS, largest_component):
            most[d] = max(most.get(d, 0), int((values * values).sum(axis=1).max(initial=0)))
        yield pa.RecordBatch.from_arrays([pa.array(most.keys(), pa.int32()), pa.array(most.values(), pa.int64())], ["d", "most"])

    found = rows.mapInArrow(run, "d int, most long").groupBy("d").agg(F.max("most")).collect()
    return {d: math.isqrt(most) + 1 for d, most in found}


def exact_neighbours(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = SCALE, id_column: str = "vec_id", vector_column: str = "embedding", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that is_query holds for the k rows of largest inner product."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    id_of = F.col(id_column).cast("long").alias("id")
    rows = staged(finite_rows(vectors, id_of, vector_column=vector_column), "vectors")
    asked = staged(finite_rows(vectors.where(is_query), id_of, vector_column=vector_column).where(F.col("id").isNotNull()).groupBy("id", "v").agg(F.count("*").alias("copies")), "queries")
    size = asked.agg(F.sum(8 * F.size("v") + 8)).first()[0]
    if not size:
        return spark.createDataFrame([], schema)
    largest = largest_norms(rows, scale)
    chunks = -(-size // chunk_bytes)
    path = f"{shared_folder(spark)}/nearest-{uuid.uuid4().hex}"
    for c in range(chunks):
        own = asked.where(F.pmod(F.xxhash64("id", "v"), F.lit(chunks)) == c).collect()
        if own:
            _search(rows, Chunk(own, scale, largest, k), scale).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)

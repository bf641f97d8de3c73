"""Nearest neighbours by largest inner product: hierarchical navigable small-world graphs, one per shard.

Rows go to shards by a hash of their id, each shard to a partition of its own.
A shard's graph is stored as flat neighbour arrays (one int32 matrix per layer)
and is built in growing batches: a batch's beam searches run in lockstep over
the graph so far, in numpy. The queries are sent to every shard and searched
there in blocks; each shard gives its best k by the exact double-precision
product (its terms added in the order of components), and a merge of at most
shards x k rows per query gives the result. Equal vectors of a shard are one
node of its graph. Searching two graphs takes two
beams, so the shard count follows the rows only beyond ROWS_PER_SHARD; a larger
graph would need a larger beam for the same recall.

Vectors of very unequal length make poor graphs for inner products, so a shard
is cut into bands of lengths that differ by a quarter at most, with a graph for
each; bands of few rows are scanned. A query goes through the bands from the
longest vectors down, and leaves when length x length can't beat its k-th best.
Within a band vectors get one more component that makes their lengths equal, so
that the largest product is the smallest distance.

Vectors that are null, zero, or hold a null or non-finite component take no
part, as rows or queries. Candidates of a query are the vectors with as many
components, in shards of their own. A query's own row is no candidate; rows that
share its id with another vector are. Rows equal in id and vector count once.
Fewer than k candidates are all returned. Ties go to the smaller id. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

SHARDS = 6
ROWS_PER_SHARD = 16_000  # up to which SEARCH_BEAM is measured to hold recall 0.9, see the tests
LEAST_SHARD = 1000  # rows, before a table is cut into shards
BAND_RATIO = 1.25
SCANNED_ROWS = 256
LINKS = 16
BUILD_BEAM = 96
SEARCH_BEAM = 192
BLOCK = 256


class SmallWorldGraph:
    """A layered proximity graph over unit-length-equalised float32 vectors."""

    def __init__(self, vectors: np.ndarray, links: int = LINKS, beam: int = BUILD_BEAM, seed: int = 7):
        lengths = np.einsum("ij,ij->i", vectors, vectors, dtype=np.float64)
        extra = np.sqrt(np.maximum(lengths.max(initial=0) - lengths, 0))
        self.points = np.hstack([vectors, extra[:, None]]).astype(np.float32)
        self.links, self.beam = links, beam
        self._marks = np.zeros(0, bool)
        n = len(vectors)
        draws = np.random.default_rng(seed).random(n)
        self.level = np.minimum((-np.log(np.maximum(draws, 1e-12)) / np.log(links)).astype(np.int64), 8)
        order = np.argsort(-self.level, kind="stable")
        self.points, self.order, self.place = self.points[order], order, np.argsort(order)
        self.level = self.level[order]  # the top layers come first, so each layer is a prefix of the rows
        self.layers = [np.full((int((self.level >= k).sum()), links * (2 if k == 0 else 1)), -1, np.int32) for k in range(int(self.level.max(initial=0)) + 1)]
        self._build(n)

    def _build(self, n: int) -> None:
        done = min(n, 1)
        while done < n:
            stop = min(n, done + max(1, min(done // 2, 512)))
            self._insert(done, stop)
            done = stop

    def _insert(self, start: int, stop: int) -> None:
        new = np.arange(start, stop)
        among = self.points[start:stop] @ self.points[start:stop].T
        np.fill_diagonal(among, -np.inf)
        entry = np.zeros(len(new), np.int64)
        for k in range(len(self.layers) - 1, -1, -1):
            size = len(self.layers[k])
            here = new < size
            if start >= size:
                if size:
                    entry = self._beam(self.points[new], k, entry, 1, start)[0][:, 0]
                continue
            ids, score = self._beam(self.points[new], k, entry, self.beam, start)
            rows = np.flatnonzero(here)
            side = min(len(rows), self.links)
            if len(rows) > 1:
                near = np.argpartition(-among[np.ix_(rows, rows)], side - 1, axis=1)[:, :side]
                near_ids = new[rows][near]
                near_score = np.take_along_axis(among[np.ix_(rows, rows)], near, axis=1)
                near_ids = np.where(np.isfinite(near_score), near_ids, -1)
                pool, pool_score = np.hstack([ids[rows], near_ids]), np.hstack([score[rows], near_score])
            else:
                pool, pool_score = ids[rows], score[rows]
            chosen = self._diverse(self.points[new[rows]], pool, pool_score, self.links)
            self.layers[k][new[rows], : chosen.shape[1]] = chosen
            self._link_back(k, new[rows], chosen)
            entry = ids[:, 0]

    def _diverse(self, points: np.ndarray, pool: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
        """From each row's pool the nearest that are nearer to the point than to any chosen one, then the nearest others."""
        width = min(pool.shape[1], 3 * most)
        top = np.argsort(-np.where(pool >= 0, score, -np.inf), axis=1, kind="stable")[:, :width]
        pool, score = np.take_along_axis(pool, top, axis=1), np.take_along_axis(score, top, axis=1)
        vectors = self.points[np.maximum(pool, 0)]
        mutual = np.einsum("bid,bjd->bij", vectors, vectors, optimize=True)
        good = pool >= 0
        taken = np.zeros(pool.shape, bool)
        blocked = ~good
        for j in range(width):
            can = ~blocked[:, j] & (taken.sum(axis=1) < most)
            taken[:, j] = can
            blocked |= can[:, None] & (mutual[:, j, :] > score)
        rank = np.where(taken, 0, np.where(good, 1, 2)) * width + np.arange(width)
        pick = np.argsort(rank, axis=1)[:, :most]
        return np.where(np.take_along_axis(good, pick, axis=1), np.take_along_axis(pool, pick, axis=1), -1).astype(np.int32)

    def _link_back(self, k: int, new: np.ndarray, chosen: np.ndarray) -> None:
        layer = self.layers[k]
        to, source = chosen.ravel(), np.repeat(new, chosen.shape[1])
        keep = to >= 0
        to, source = to[keep], source[keep]
        order = np.argsort(to, kind="stable")
        to, source = to[order], source[order]
        targets, begin, count = np.unique(to, return_index=True, return_counts=True)
        width = layer.shape[1]
        for at in range(0, len(targets), 2048):
            t, b, c = targets[at : at + 2048], begin[at : at + 2048], count[at : at + 2048]
            extra = np.full((len(t), int(c.max())), -1, np.int32)
            spots = np.arange(extra.shape[1])[None, :] < c[:, None]
            extra[spots] = source[b[0] : b[-1] + c[-1]]
            pool = np.hstack([layer[t], extra])
            over = (pool >= 0).sum(axis=1) > width
            packed = np.take_along_axis(pool, np.argsort(pool < 0, axis=1, kind="stable"), axis=1)[:, :width]
            layer[t[~over]] = packed[~over]
            if over.any():
                rows = t[over]
                score = np.einsum("bjd,bd->bj", self.points[np.maximum(pool[over], 0)], self.points[rows])
                layer[rows] = self._diverse(self.points[rows], pool[over], score, width)

    def _beam(self, queries: np.ndarray, k: int, entry: np.ndarray, width: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search of one layer for many queries at once: ids and products of the best `width`, best first."""
        layer, n = self.layers[k], min(len(self.layers[k]), limit)
        m = len(queries)
        if len(self._marks) < m * n:
            self._marks = np.zeros(m * n, bool)
        seen, marked = self._marks[: m * n].reshape(m, n), []  # all marks are taken back at the end, so no search pays for the whole matrix
        ids = np.full((m, width), -1, np.int64)
        score = np.full((m, width), -np.inf, np.float32)
        opened = np.ones((m, width), bool)
        ids[:, 0] = entry
        score[:, 0] = np.einsum("ij,ij->i", self.points[entry], queries)
        opened[:, 0] = False
        active = np.arange(m)
        seen[active, entry] = True
        marked.append((active, entry))
        step = 1 if width == 1 else max(4, width // 8)  # a wide beam opens more at once, else its rounds and their width would grow together
        while len(active):
            waiting = np.where(opened[active], -np.inf, score[active])
            best = np.argpartition(-waiting, step - 1, axis=1)[:, :step] if step < width else np.zeros((len(active), 1), np.int64)
            live = np.take_along_axis(waiting, best, axis=1) > -np.inf
            some = live.any(axis=1)
            active, best, live = active[some], best[some], live[some]
            if not len(active):
                break
            nodes = np.where(live, ids[active[:, None], best], -1)
            opened[active[:, None], best] = True
            near = np.where(nodes[:, :, None] >= 0, layer[np.maximum(nodes, 0)], -1).reshape(len(active), -1)
            near = np.where(near < n, near, -1)
            row, col = np.nonzero((near >= 0) & ~seen[active[:, None], np.maximum(near, 0)])
            found = near[row, col].astype(np.int64)
            if step > 1:  # the same neighbour of two opened nodes counts once
                keys = np.sort(row * n + found)
                row, found = np.divmod(keys[np.insert(keys[1:] != keys[:-1], 0, True)], n) if len(keys) else (row, found)
            seen[active[row], found] = True
            marked.append((active[row], found))
            value = np.einsum("ij,ij->i", self.points[found], queries[active[row]])
            # what is worse than all that a row holds would be left out again; most rows find little that is better
            better = value > score[active].min(axis=1)[row]
            row, found, value = row[better], found[better], value[better]
            count = np.bincount(row, minlength=len(active))
            some = np.flatnonzero(count)
            if not len(some):
                continue
            at = np.arange(len(row)) - np.repeat(np.cumsum(count[some]) - count[some], count[some])
            place, into = np.repeat(np.arange(len(some)), count[some]), active[some]
            new_ids, new_score = np.full((len(some), int(count.max())), -1, np.int64), np.full((len(some), int(count.max())), -np.inf, np.float32)
            new_ids[place, at], new_score[place, at] = found, value
            pool, pool_score = np.hstack([ids[into], new_ids]), np.hstack([score[into], new_score])
            pool_open = np.hstack([opened[into], new_ids < 0])
            top = np.argpartition(-pool_score, width - 1, axis=1)[:, :width]
            ids[into] = np.take_along_axis(pool, top, axis=1)
            score[into] = np.take_along_axis(pool_score, top, axis=1)
            opened[into] = np.take_along_axis(pool_open, top, axis=1)
        for rows, columns in marked:
            seen[rows, columns] = False
        order = np.argsort(-score, axis=1, kind="stable")
        return np.take_along_axis(ids, order, axis=1), np.take_along_axis(score, order, axis=1)

    def search(self, queries: np.ndarray, beam: int) -> np.ndarray:
        """For each query the rows found, best first, -1 where there are none."""
        n = len(self.order)
        queries = np.hstack([queries, np.zeros((len(queries), 1), np.float32)]).astype(np.float32)
        entry = np.zeros(len(queries), np.int64)
        for k in range(len(self.layers) - 1, 0, -1):
            entry = self._beam(queries, k, entry, 1, n)[0][:, 0]
        ids, _ = self._beam(queries, 0, entry, min(beam, n), n)
        return np.where(ids >= 0, self.order[np.maximum(ids, 0)], -1)


class ShardIndex:
    """Distinct vectors in bands by length, each a graph or, of few rows, a matrix."""

    def __init__(self, vectors: np.ndarray):
        lengths = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        self.order = np.argsort(-lengths, kind="stable")
        lengths = lengths[self.order]
        self.bands: list[tuple[int, int, float, SmallWorldGraph | np.ndarray]] = []
        start, n = 0, len(vectors)
        while start < n:
            like = int(np.searchsorted(-lengths, -lengths[start] / BAND_RATIO, side="right"))
            stop = min(n, max(like, start + SCANNED_ROWS))
            rows = vectors[self.order[start:stop]]
            self.bands.append((start, stop, float(lengths[start]), SmallWorldGraph(rows.astype(np.float32)) if stop - start > SCANNED_ROWS else rows))
            start = stop

    def search(self, queries: np.ndarray, k: int, beam: int) -> list[np.ndarray]:
        """For each query the rows that are among its k best as far as they are found, in no order."""
        m = len(queries)
        size = np.sqrt(np.einsum("ij,ij->i", queries, queries))
        best = np.full((m, k), -np.inf)
        found: list[list[np.ndarray]] = [[] for _ in range(m)]
        for start, stop, longest, held in self.bands:
            going = np.flatnonzero(longest * size * (1 + 1e-6) >= best.min(axis=1))
            if not len(going):
                break
            if isinstance(held, np.ndarray):
                score = queries[going] @ held.T
                at = max(0, score.shape[1] - k)
                least = np.partition(score, at, axis=1)[:, at]
                near = [np.flatnonzero(row >= low - 1e-9 * abs(low)) for row, low in zip(score, least, strict=True)]
                top = np.partition(score, at, axis=1)[:, at:]
            else:
                # smaller graphs need smaller beams for the same recall
                ids = held.search(queries[going].astype(np.float32), max(2 * k, round(beam * min(1.0, ((stop - start) / ROWS_PER_SHARD) ** 0.5))))
                near = [row[row >= 0] for row in ids]
                top = np.full((len(going), ids.shape[1]), -np.inf)
                for i, rows in enumerate(near):
                    top[i, : len(rows)] = self._vectors(held, rows) @ queries[going[i]]
            for q, rows in zip(going.tolist(), near, strict=True):
                found[q].append(self.order[start + rows])
            best[going] = -np.sort(-np.hstack([best[going], top]), axis=1)[:, :k]
        return [np.concatenate(rows) if rows else np.zeros(0, np.int64) for rows in found]

    @staticmethod
    def _vectors(graph: SmallWorldGraph, rows: np.ndarray) -> np.ndarray:
        return graph.points[graph.place[rows], :-1]


def _usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    v = F.col(vector_column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
    return rows.distinct()


def nearest_neighbours(
    vectors: DataFrame, queries: DataFrame, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding", shards: int | None = None, beam: int = SEARCH_BEAM
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each query row."""
    spark = vectors.sparkSession
    base = staged(_usable(vectors, id_column, vector_column).withColumn("d", F.size("v")), "vectors")
    asked = staged(_usable(queries, id_column, vector_column).select("id", "v", F.size("v").alias("d"), F.monotonically_increasing_id().alias("query")), "queries")
    dealt_to, total = [], 0
    for d, n in sorted(map(tuple, base.groupBy("d").agg(F.count("*")).collect())):
        own = shards or max(min(SHARDS, -(-n // LEAST_SHARD)), -(-n // ROWS_PER_SHARD))
        dealt_to.append((d, total, own))
        total += own
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    plan = F.broadcast(spark.createDataFrame(dealt_to, "d int, first int, own int"))
    rows = base.join(plan, "d").select((F.col("first") + F.pmod(F.xxhash64("id", "v"), F.col("own"))).cast("int").alias("shard"), F.lit(False).alias("asked"), F.lit(0).cast("long").alias("query"), "id", "v")
    sent = asked.join(plan, "d").select(F.explode(F.sequence(F.col("first"), F.col("first") + F.col("own") - 1)).alias("shard"), F.lit(True).alias("asked"), "query", "id", "v")
    dealt = rows.unionByName(sent).repartitionById(total, F.col("shard")).sortWithinPartitions("shard", "asked", "id")

    def matrix(column: pa.Array) -> np.ndarray:
        return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, held, index = None, [], [], None
        for batch in batches:
            number = batch.column("shard").to_numpy()
            is_query = batch.column("asked").to_numpy(zero_copy_only=False)
            change = np.flatnonzero((number[1:] != number[:-1]) | (is_query[1:] != is_query[:-1])) + 1
            for a, b in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows], strict=True):
                if number[a] != shard:
                    shard, ids, held, index = number[a], [], [], None
                part = batch.slice(a, b - a)
                values, keys = matrix(part.column("v")), part.column("id").to_numpy()
                if not is_query[a]:
                    ids.append(keys)
                    held.append(values)
                    continue
                if not held:
                    continue
                if index is None:
                    own = np.concatenate(ids)
                    every, which = np.unique(np.concatenate(held), axis=0, return_inverse=True)
                    order = np.lexsort((own, which.ravel()))
                    own, first = own[order], np.searchsorted(which.ravel()[order], np.arange(len(every) + 1))
                    index = ShardIndex(every)
                queries = part.column("query").to_numpy()
                for at in range(0, len(keys), BLOCK):
                    yield best(index, own, first, every, queries[at : at + BLOCK], keys[at : at + BLOCK], values[at : at + BLOCK])

    def best(index: ShardIndex, own: np.ndarray, first: np.ndarray, every: np.ndarray, queries: np.ndarray, keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        columns: list[list[np.ndarray]] = [[], [], [], []]
        for number, key, query, near in zip(queries, keys, values, index.search(values, k + 1, beam), strict=True):
            product = np.cumsum(every[near] * query, axis=1)[:, -1] if len(near) else np.zeros(0)
            lots = np.minimum(first[near + 1] - first[near], k + 1)  # of equal vectors the smallest ids are enough
            rows = np.repeat(first[near], lots) + np.arange(lots.sum()) - np.repeat(np.cumsum(lots) - lots, lots)
            ids, score = own[rows], np.repeat(product, lots)
            others = ~((ids == key) & np.repeat((every[near] == query).all(axis=1), lots))
            ids, score = ids[others], score[others]
            order = np.lexsort((ids, -score))[:k]
            for column, part in zip(columns, (np.full(len(order), number), np.full(len(order), key), ids[order], score[order]), strict=True):
                column.append(part)
        arrays = [pa.array(np.concatenate(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)]
        return pa.RecordBatch.from_arrays(arrays, ["query", "query_id", "vec_id", "score"])

    nearest = dealt.mapInArrow(run, "query long, query_id long, vec_id long, score double")
    ranked = nearest.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Benchmark decontamination by greedy string tiling.

A document and a benchmark item that share a run of MATCH_WORDS words (a seed,
found by Karp-Rabin hashes of all windows of the document) are tiled: the
longest match of unmarked words is marked again and again until none of
MATCH_WORDS is left. The item's share of marked words is its coverage, whatever
the order of its parts in the document. Items of fewer words count as one
window of all their words; items of a single word (MIN_WORDS) tell nothing and
match nothing.

The seeds of the benchmark are broadcast in blocks of at most BLOCK_BYTES of
item text (measured first), and every block passes over all documents: nothing
is shuffled and no task holds more than a block. Null or wordless items and
texts match nothing. Repeated items and repeated documents each give their own
rows; ties between longest matches go to the earliest word of the document,
then of the item. Empty tables give an empty result (of pairs) or all documents
(of clean ones). Other columns are not read, and clean documents keep theirs.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices, window_hashes, word_hashes

MATCH_WORDS = 5
MIN_WORDS = 2
COVERAGE = 0.5
BLOCK_BYTES = 8 << 20


def matches(doc: np.ndarray, item: np.ndarray, doc_seeds: list[int], places: dict[int, list[int]], width: int, codes: np.ndarray) -> list[tuple[int, int, int]]:
    """All maximal runs (length, document position, item position) of equal words that hold a seed."""
    found, ends = [], {}
    for p in doc_seeds:
        for q in places[int(codes[p])]:
            if p < ends.get(p - q, 0):
                continue  # inside a run of this diagonal
            n = min(len(doc) - p, len(item) - q)
            same = doc[p : p + n] == item[q : q + n]
            length = n if same.all() else int(same.argmin())
            if length >= width:
                found.append((length, p, q))
                ends[p - q] = p + length
    return found


def tiles(doc: np.ndarray, item: np.ndarray, found: list[tuple[int, int, int]], width: int) -> list[tuple[int, int, int]]:
    """Greedy tiling: the longest match of unmarked words is marked until none of `width` is left."""
    used_doc, used_item = np.zeros(len(doc), bool), np.zeros(len(item), bool)
    heap = [(-n, p, q) for n, p, q in found]
    heapq.heapify(heap)
    laid = []
    while heap:
        n, p, q = heapq.heappop(heap)
        n = -n
        free = ~(used_doc[p : p + n] | used_item[q : q + n])
        if free.all():
            used_doc[p : p + n] = used_item[q : q + n] = True
            laid.append((n, p, q))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[0], free.astype(np.int8), [0]])))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= width:
                heapq.heappush(heap, (a - b, p + a, q + a))
    return laid


class Benchmark:
    """One block of items with the hashes of their windows."""

    def __init__(self, items: list[tuple[int, str]]):
        hashes, offsets = word_hashes(pa.array([t for _, t in items], pa.string()))
        self.ids = [i for i, _ in items]
        self.words = [hashes[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        self.by_width: dict[int, dict[int, dict[int, list[int]]]] = {}
        for k, words in enumerate(self.words):
            width = min(MATCH_WORDS, len(words))
            if width >= MIN_WORDS:
                seeds = self.by_width.setdefault(width, defaultdict(lambda: defaultdict(list)))
                for q, code in enumerate(window_hashes(words, width).tolist()):
                    seeds[code][k].append(q)
        self.filters = {}
        for width, seeds in self.by_width.items():
            codes = np.sort(np.array(list(seeds), dtype=np.uint64))
            bits = max(16, 6 + len(codes).bit_length())
            sieve = np.zeros(1 << bits, bool)
            sieve[(codes & np.uint64((1 << bits) - 1)).astype(np.int64)] = True
            self.filters[width] = (codes, sieve, np.uint64((1 << bits) - 1))

    def hits(self, texts: pa.Array, least: float) -> list[list[tuple[int, float, int, int]]]:
        """For each text its items of enough coverage: (item id, coverage, tiles, longest tile)."""
        hashes, offsets = word_hashes(texts)
        found: list[dict[int, tuple[float, int, int]]] = [{} for _ in range(len(texts))]
        for width, (codes, sieve, mask) in self.filters.items():
            windows = window_hashes(hashes, width)
            at = np.flatnonzero(sieve[(windows & mask).astype(np.int64)])
            place = np.minimum(np.searchsorted(codes, windows[at]), len(codes) - 1)
            at = at[codes[place] == windows[at]]
            owner = np.searchsorted(offsets, at, side="right") - 1
            inside = at + width <= offsets[owner + 1]
            at, owner = at[inside], owner[inside]
            for k in np.unique(owner).tolist():
                start, stop = int(offsets[k]), int(offsets[k + 1])
                doc, seeds = hashes[start:stop], (at[owner == k] - start).tolist()
                by_item: dict[int, dict[int, list[int]]] = defaultdict(dict)
                starts: dict[int, list[int]] = defaultdict(list)
                for p in seeds:
                    code = int(windows[start + p])
                    for item, places in self.by_width[width][code].items():
                        by_item[item][code] = places
                        starts[item].append(p)
                for item, places in by_item.items():
                    words = self.words[item]
                    laid = tiles(doc, words, matches(doc, words, starts[item], places, width, windows[start:stop]), width)
                    share = sum(n for n, _, _ in laid) / len(words)
                    if laid and share >= least:
                        found[k][item] = (share, len(laid), max(n for n, _, _ in laid))
        return [[(self.ids[i], *v) for i, v in sorted(one.items())] for one in found]


def blocks(benchmark: DataFrame):
    """Broadcasts of the benchmark, each of at most about BLOCK_BYTES of text."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.length("text") > 0)
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // BLOCK_BYTES)
    for k in range(n):
        mine = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        rows = sorted(((r["item_id"], r["text"]) for r in mine.collect()), key=lambda r: (r[0] is None, r))
        if rows:
            yield benchmark.sparkSession.sparkContext.broadcast(rows)


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, coverage, n_tiles, longest_tile of each document and item with enough coverage."""
    schema = "doc_id long, item_id long, coverage double, n_tiles int, longest_tile int"
    out = docs.sparkSession.createDataFrame([], schema)
    for k, block in enumerate(blocks(benchmark)):

        def work(block=block):
            own = Benchmark(block.value)

            def step(part: pa.RecordBatch) -> pa.RecordBatch:
                rows = [(d, *hit) for d, hits in zip(part.column("doc_id").to_pylist(), own.hits(part.column("text"), coverage), strict=True) for hit in hits]
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32())
                columns = [pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)]
                return pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "coverage", "n_tiles", "longest_tile"])

            return step

        found = map_slices(docs.select("doc_id", "text"), "text", work, schema)
        out = found if k == 0 else out.unionByName(found)
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The rows of docs that cover no item, with all their columns."""
    for block in blocks(benchmark):

        def work(block=block):
            own = Benchmark(block.value)
            return lambda part: part.filter(pa.array([not hits for hits in own.hits(part.column("text"), coverage)], pa.bool_()))

        docs = map_slices(docs, "text", work, docs.schema)
    return docs

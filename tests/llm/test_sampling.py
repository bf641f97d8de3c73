"""Resampling, sharding and neighbours."""

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from bayerloom.llm import ann, quality, sharding
from bayerloom.llm.common import table
from bayerloom.llm.sharding import FeistelPermutation

SF = "/root/testdata/sf0.01"


def test_cut_is_the_kth_largest(spark):
    values = [5, -3, 2**62, -(2**63), 5, 0, -1, 2**63 - 1]
    keys = spark.createDataFrame([(v,) for v in values], "key long")
    for k in range(1, 9):
        assert quality.kth_largest(keys, "key", k) == sorted(values, reverse=True)[k - 1]
    assert quality.kth_largest(keys, "key", 9) is None


def test_resampling_equals_a_plain_version(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    good = {r["doc_id"] for r in labels.where("quality = 1 and toxic = 0").collect()}
    rows = docs.select("doc_id", "text").collect()
    target, raw = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    for r in rows:
        buckets, _ = quality._bucketed(pa.array([r["text"]]))
        np.add.at(raw, buckets, 1)
        if r["doc_id"] in good:
            np.add.at(target, buckets, 1)
    ratio = quality.model_ratio(target, raw)
    share = labels.where("quality = 1").count() / labels.count()
    keys = {r["doc_id"]: quality.weights(pa.array([r["text"]]), ratio, quality.SEED)[1][0] for r in rows}
    cut = sorted(keys.values(), reverse=True)[round(len(rows) * share) - 1]
    expected = {d for d, k in keys.items() if k >= cut}
    found = quality.resample(docs, labels).collect()
    assert len(found) == len(rows) and {r["doc_id"] for r in found if r["keep"]} == expected
    kept = quality.kept_documents(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == expected


def test_junk_goes_and_clean_stays(spark):
    kept = {r["doc_id"]: r["keep"] for r in quality.resample(table(spark, SF, "documents"), table(spark, SF, "labels")).collect()}
    by_quality = {q: [kept[r["doc_id"]] for r in table(spark, SF, "labels").collect() if r["quality"] == q] for q in (0, 1)}
    assert np.mean(by_quality[1]) > 0.98 and np.mean(by_quality[0]) < 0.25


def test_resampling_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(6, 1, 0), (10, 0, 0), (None, 1, 0), (5, None, None), (6, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.resample(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(np.isfinite(r["sampling_key"]) for r in rows)
    assert len({r["keep"] for r in rows if r["doc_id"] in (6, 7)}) == 1
    assert quality.kept_documents(odd_docs, labels).columns == odd_docs.columns
    none = labels.where("doc_id = 99")
    assert quality.kept_documents(odd_docs, none).count() == odd_docs.count()
    assert quality.resample(no_docs, labels).count() == 0 and quality.kept_documents(no_docs, none).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 7, 40, 1000, 4097])
def test_permutation_is_one_and_can_be_undone(n):
    p = FeistelPermutation(n, seed=3)
    places = p.position(np.arange(n))
    assert sorted(places.tolist()) == list(range(n))
    assert p.row(places).tolist() == list(range(n))
    assert p.position(np.array([n - 1]))[0] == places[-1]


def test_shards(spark):
    docs = table(spark, SF, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = sharding.shard_documents(docs).collect()
    assert len(rows) == len(texts)
    order = sorted(texts)
    permutation = FeistelPermutation(len(order), 20)
    for r in rows:
        p = int(permutation.position(np.array([order.index(r["doc_id"])]))[0])
        assert (r["shard"], r["slot"], r["law"], r["grown_shard"]) == (p % 40, p // 40, "rows", None)
        assert r["size"] == len(texts[r["doc_id"]].encode()) + 16 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode())
    again = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard_documents(docs.repartition(7)).collect()}
    assert again == {r["doc_id"]: (r["shard"], r["slot"]) for r in rows}


def test_shards_of_odd_rows(odd_docs, no_docs):
    rows = sharding.shard_documents(odd_docs, shards=4).collect()
    assert len(rows) == odd_docs.count()
    slots = [sorted(r["slot"] for r in rows if r["shard"] == s) for s in range(4)]
    assert all(x == list(range(len(x))) for x in slots) and max(map(len, slots)) - min(map(len, slots)) <= 1
    assert {(r["size"], r["text_crc32"]) for r in rows if r["doc_id"] == 0} == {(16, 0)}
    assert sharding.shard_documents(no_docs).count() == 0


def exact(vectors, queries, k):
    out = {}
    for q, v in queries.items():
        scores = sorted(((-float(np.dot(w, v)), i) for i, w in vectors.items() if i != q))[:k]
        out[q] = [i for _, i in scores]
    return out


def test_neighbours_reach_the_recall(spark):
    base = table(spark, "/root/testdata/sf0.1", "embeddings")
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in base.collect()}
    rows = ann.nearest_neighbours(base, base.where("vec_id % 20 = 0")).collect()
    expected = exact(vectors, {i: v for i, v in vectors.items() if i % 20 == 0}, 20)
    found = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append(r["vec_id"])
        assert r["score"] == pytest.approx(float(np.dot(vectors[r["query_id"]], vectors[r["vec_id"]])), abs=1e-12)
    assert found.keys() == expected.keys() and all(len(x) == 20 for x in found.values())
    assert np.mean([len(set(found[q]) & set(expected[q])) / 20 for q in expected]) >= 0.95


def test_one_large_graph_reaches_the_recall():
    rng = np.random.default_rng(2)
    points = rng.normal(size=(4000, 32)).astype(np.float32) * rng.uniform(0.5, 2, size=(4000, 1)).astype(np.float32)
    queries = rng.normal(size=(100, 32)).astype(np.float32)
    found = ann.SmallWorldGraph(points).search(queries, 192)[:, :20]
    best = np.argsort(-(queries @ points.T), axis=1)[:, :20]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(found, best, strict=True)]) >= 0.9


def test_rounds_of_a_search_do_not_grow_with_its_beam(monkeypatch):
    points = np.random.default_rng(5).normal(size=(3000, 16)).astype(np.float32)
    graph, rounds, nonzero = ann.SmallWorldGraph(points), {}, np.nonzero
    for beam in (64, 192):
        calls = []
        monkeypatch.setattr(ann.np, "nonzero", lambda a: calls.append(1) or nonzero(a))
        found = graph.search(points[:50], beam)
        rounds[beam] = len(calls)
        monkeypatch.undo()
        assert all(len(set(row.tolist())) == beam for row in found)  # none twice
    assert rounds[192] < 1.5 * rounds[64]


def test_a_full_shard_reaches_the_recall():
    """Random unit vectors, which have no structure to help, and queries from outside the graph."""
    n = ann.ROWS_PER_SHARD
    assert n <= 20_000, "recall is measured for no larger shards"
    rng = np.random.default_rng(9)
    points = rng.normal(size=(n + 200, 64))
    points = (points / np.linalg.norm(points, axis=1, keepdims=True)).astype(np.float32)
    found = ann.SmallWorldGraph(points[:n]).search(points[n:], ann.SEARCH_BEAM)[:, :20]
    best = np.argsort(-(points[n:] @ points[:n].T), axis=1)[:, :20]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(found, best, strict=True)]) >= 0.9


@pytest.mark.parametrize("lengths", ["equal", "0.5 to 2", "log-normal 0.3", "log-normal 0.7"])
def test_a_full_shard_of_unequal_vectors_reaches_the_recall(lengths):
    """The measure is the inner product, so lengths count; queries are from outside the index."""
    rng = np.random.default_rng(9)
    n = ann.ROWS_PER_SHARD
    points = rng.normal(size=(n + 200, 64))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    if lengths == "0.5 to 2":
        points *= rng.uniform(0.5, 2, (n + 200, 1))
    elif lengths != "equal":
        points *= np.exp(float(lengths.split()[1]) * rng.normal(size=(n + 200, 1)))
    index = ann.ShardIndex(points[:n])
    assert any(isinstance(band[3], ann.SmallWorldGraph) for band in index.bands)
    found = index.search(points[n:], 21, ann.SEARCH_BEAM)
    best = np.argsort(-(points[n:] @ points[:n].T), axis=1)[:, :20]
    assert np.mean([len(set(a.tolist()) & set(b.tolist())) / 20 for a, b in zip(found, best, strict=True)]) >= 0.92


def test_every_row_is_a_candidate_of_queries_of_its_length(spark):
    """Ids on several rows, equal rows, and vectors of two lengths."""
    rng = np.random.default_rng(3)
    data = [(k % 90, rng.normal(size=6 if k % 4 else 3).round(1).tolist()) for k in range(400)]
    rows = spark.createDataFrame(data + data[:50], "vec_id long, embedding array<double>")
    distinct = sorted({(i, tuple(v)) for i, v in data})
    expected = []
    for q, v in distinct:
        if q % 20 == 0:
            near = sorted((-float(np.cumsum(np.array(v) * np.array(w))[-1]), i) for i, w in distinct if len(w) == len(v) and (i, w) != (q, v))[:5]
            expected += [(q, rank, i, -s) for rank, (s, i) in enumerate(near, 1)]
    found = ann.nearest_neighbours(rows, rows.where("vec_id % 20 = 0"), k=5, shards=3).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found) == sorted(expected)


def test_full_shards_reach_the_recall_through_the_query(spark):
    """Two shards of 20,000 random unit vectors, with production parameters."""
    rng = np.random.default_rng(5)
    n = 2 * ann.ROWS_PER_SHARD
    points = rng.normal(size=(n, 64))
    points = (points / np.linalg.norm(points, axis=1, keepdims=True)).astype(np.float32)
    rows = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "embedding": points.tolist()})).selectExpr("vec_id", "cast(embedding as array<float>) embedding")
    asked = np.arange(0, n, 200)
    found = ann.nearest_neighbours(rows, rows.where("vec_id % 200 = 0"), shards=2).toPandas().sort_values(["query_id", "rank"]).groupby("query_id")["vec_id"].apply(list)
    product = points[asked] @ points.T
    product[np.arange(len(asked)), asked] = -np.inf
    best = np.argsort(-product, axis=1)[:, :20]
    assert np.mean([len(set(found[q]) & set(b)) / 20 for q, b in zip(asked.tolist(), best.tolist(), strict=True)]) >= 0.9


def test_odd_vectors(spark):
    good = [(k, [float(k % 5), 1.0, float(k)]) for k in range(12)]
    bad = [(100, None), (101, [0.0, 0.0, 0.0]), (102, [1.0, None, 2.0]), (103, [1.0, float("nan"), 2.0]), (104, [1.0, float("inf"), 2.0]), (105, [1.0]), (None, [1.0, 1.0, 1.0])]
    rows = spark.createDataFrame(good + bad + [good[0]] + [(200 + k, [3.0, 3.0, 3.0]) for k in range(60)], "vec_id long, embedding array<double>").selectExpr("*", "1 as score", "2 as shard", "3 as v")
    found = ann.nearest_neighbours(rows, rows.where("vec_id in (0, 11, 200, 100, 103)"), k=20).collect()
    vectors = {r["vec_id"]: np.array(r["embedding"]) for r in rows.where("vec_id < 100 or vec_id >= 200").collect()}
    expected = exact(vectors, {q: vectors[q] for q in (0, 11, 200)}, 20)
    lists = {q: [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q] for q in expected}
    assert lists == expected and len(found) == 60
    few = rows.where("vec_id < 4")
    assert ann.nearest_neighbours(few, few).count() == 12
    assert ann.nearest_neighbours(rows.where("vec_id = 101"), rows).count() == 0

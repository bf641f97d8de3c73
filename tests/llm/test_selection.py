"""Operators 11 to 13 against plain versions, and in odd cases."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bayerloom.llm import exact_search, resampling, vector_codes
from bayerloom.llm.common import staged
from tests.llm.test_oracles import connected, same

SF = "/root/testdata/sf0.01"
VECTORS = "vec_id long, embedding array<float>, label int, score long, query string, d int, v int, ids int"


# --- 11 ---------------------------------------------------------------------


def plain_features(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def plain_resampling(docs, target, share=25, least=20):
    s, t = Counter(), Counter()
    for texts, held in ((docs, s), (target, t)):
        for _, text in texts:
            held.update(zlib.crc32(f.encode()) % 10_000 for f in plain_features(text)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000)))) for b in range(10_000)]
    rows = []
    for doc_id, text in docs:
        words, feats = plain_features(text)
        weight = sum(gain[zlib.crc32(f.encode()) % 10_000] for f in feats) // len(feats) if feats else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(feats), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for rank, row in enumerate(able[: share * len(able) // 100], 1):
        row[4] = rank
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def ranked(rows):
    return sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in rows.collect()), key=repr)


@pytest.mark.parametrize("words", [["a"], ["Ab", "c" * 70, "é" * 40], ["x", "中文", "Ä", "0"], ["y" * 64, "z" * 65, "y" * 63], []])
def test_features_are_those_of_the_pattern(words):
    texts = [" ".join(words), "\n".join(words), "--".join(reversed(words)), None, "".join(words), "\0" + "\x7f".join(words) + "\n"]
    buckets, owner, count = resampling.features(pa.array(texts))
    for k, text in enumerate(texts):
        plain, feats = plain_features(text)
        assert count[k] == len(plain)
        assert sorted(buckets[owner == k].tolist()) == sorted(zlib.crc32(f.encode()) % resampling.BUCKETS for f in feats)


def test_resampling_of_odd_texts(spark, odd_docs, no_docs):
    target = spark.createDataFrame([(1, "The quick brown fox"), (2, None), (3, "")], "item_id long, text string")
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    expected = plain_resampling(docs, [(None, "The quick brown fox")], share=100)
    assert ranked(resampling.resample_towards(odd_docs, target, share=100)) == expected
    assert [r[4] for r in expected].count(None) == 11
    nothing = spark.createDataFrame([], "text string")
    assert ranked(resampling.resample_towards(odd_docs, nothing)) == plain_resampling(docs, [])
    assert resampling.resample_towards(no_docs, target).count() == 0
    drawn = resampling.drawn_documents(odd_docs, target, share=100)
    assert drawn.columns == odd_docs.columns and drawn.count() == 4


def test_resampling_of_one_id_on_many_rows(spark):
    """Half of all rows are one row; some of them fall to the draw's end."""
    texts = [" ".join(f"w{(k * j) % 37}" for j in range(25)) for k in range(300)]
    docs = [(k, t) for k, t in enumerate(texts)] + [(77, texts[77])] * 9000 + [(None, texts[5])] * 300
    target = [(None, " ".join(texts[77].split()[:9]))]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    for share in (0, 1, 60, 98):
        rows = resampling.resample_towards(frame, spark.createDataFrame([(target[0][1],)], "text string"), share=share)
        assert ranked(rows) == plain_resampling(docs, target, share)


def test_resampling_prefers_the_target(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = resampling.resample_towards(docs, docs.where("lang = 'de'").select("text"), share=20)
    drawn = rows.where("rank is not null").join(docs, "doc_id")
    assert drawn.where("lang = 'de'").count() > 3 * docs.where("lang = 'de'").count() / docs.count() * drawn.count() / 2


# --- 12 ---------------------------------------------------------------------


def plain_codes(rows, parts=16, entries=64, rounds=2, scale=256):
    """rows: (vec_id, vector, label) of one length. Codes, errors and codebooks by comparing all with all."""
    d = len(rows[0][1])
    whole = [(i, np.floor(np.array(v, np.float64) * scale).astype(np.int64), label) for i, v, label in rows]
    first = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, rows[k][1]))[:entries]
    values = np.stack([v for _, v, _ in whole])
    book = values[first].copy()
    cuts = [p * d // parts for p in range(parts + 1)]

    def nearest():
        found = np.zeros((len(rows), parts), np.int64)
        far = np.zeros((len(rows), parts), np.int64)
        for p in range(parts):
            a, b = cuts[p], cuts[p + 1]
            distance = ((values[:, None, a:b] - book[None, :, a:b]) ** 2).sum(axis=2)
            found[:, p], far[:, p] = distance.argmin(axis=1), distance.min(axis=1)
        return found, far.sum(axis=1)

    for _ in range(rounds):
        found, _ = nearest()
        for p in range(parts):
            for e in range(len(book)):
                own = values[found[:, p] == e, cuts[p] : cuts[p + 1]]
                if len(own):
                    book[e, cuts[p] : cuts[p + 1]] = own.sum(axis=0) // len(own)
    found, error = nearest()
    return [bytes(c).hex() for c in found.astype(np.uint8)], error.tolist(), book


def code_rows(df):
    return sorted((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in df.collect())


@pytest.mark.parametrize("kind", ["spread", "few values", "one value", "clusters"])
@pytest.mark.parametrize("n, k, w", [(1, 1, 2), (7, 5, 3), (300, 64, 4), (2000, 64, 4), (2000, 16, 1)])
def test_trees_assign_as_all_comparisons_do(kind, n, k, w):
    rng = np.random.default_rng(n + k)
    points = {"spread": rng.integers(-500, 500, (n, w)), "few values": rng.integers(0, 3, (n, w)), "one value": np.full((n, w), 5), "clusters": rng.integers(0, 4, (n, 1)) * 100 + rng.integers(-2, 3, (n, w))}[kind]
    entries = points[rng.integers(0, n, k)] + rng.integers(-1, 2, (k, w))
    tree = vector_codes.PartTree(points)
    found = np.full(n, -1)
    for start, stop, entry in tree.assigned(entries):
        for a, b, e in zip(start.tolist(), stop.tolist(), entry.tolist(), strict=True):
            assert (found[tree.order[a:b]] == -1).all()
            found[tree.order[a:b]] = e
            assert ((tree.sums[b] - tree.sums[a]) == points[tree.order[a:b]].sum(axis=0)).all()
    assert (found == ((points[:, None] - entries[None]) ** 2).sum(axis=2).argmin(axis=1)).all()


def test_subtrees_are_assigned_whole():
    rng = np.random.default_rng(3)
    centres = rng.integers(-1000, 1000, (16, 4))
    tree = vector_codes.PartTree(centres[rng.integers(0, 16, 20_000)] + rng.integers(-3, 4, (20_000, 4)))
    assert sum(len(entry) for _, _, entry in tree.assigned(centres)) < 1000


@pytest.mark.parametrize("components", [4096, vector_codes.BLOCK_COMPONENTS])
def test_codes_equal_plain_ones_over_blocks(spark, monkeypatch, components):
    monkeypatch.setattr(vector_codes, "BLOCK_COMPONENTS", components)
    rng = np.random.default_rng(4)
    rows = [(int(i), rng.normal(size=32).astype(np.float32).tolist(), int(i) % 3 or None) for i in rng.permutation(3000)]
    rows += [(5, rows[0][1], 1)] * 400  # copies that share an id
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(9)
    usable = frame.select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v"))
    assert vector_codes.tree_blocks(usable, 256, 16).count() >= len(rows) * 32 / components
    made, codebooks = vector_codes.code_vectors(frame)
    codes, errors, book = plain_codes(rows)
    assert (codebooks[32] == book).all()
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in made.collect()) == sorted((r[0], c, e) for r, c, e in zip(rows, codes, errors, strict=True))


def test_codes_of_odd_vectors(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None, 1), (2, [nan] * 20, 1), (3, [inf] * 20, None), (4, [None] * 20, 2), (9, [0.0] * 20, None), (9, [0.0] * 20, None), (None, [0.25] * 20, None), (7, [k / 7 for k in range(20)], 2), (8, [-k / 9 for k in range(20)], 1)]
    odd += [(20, [0.5, 1.0, -1.5], 2), (21, [0.5, 1.25, -1.5], None), (22, [], 1)]
    frame = spark.createDataFrame([(*r, 1, "x", 2, 3, 4) for r in odd], VECTORS)
    frame.write.parquet(f"{tmp_path}/embeddings.parquet")
    same(spark, connected(str(tmp_path)), "op12_filtering_lloyd_codes", str(tmp_path))
    rows = vector_codes.codes_with_label_errors(frame)
    assert rows.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and rows.count() == 8
    assert vector_codes.codes_with_label_errors(frame.where("false")).count() == 0
    huge = spark.createDataFrame([(1, [3e38] * 64, 1), (2, [-3e38] * 64, 1), (3, [0.0] * 64, 1)], "vec_id long, embedding array<float>, label int")
    assert vector_codes.codes_with_label_errors(huge).select("error").distinct().collect() == [(0,)]


def test_codes_of_few_entries_and_many_labels(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).round(1).tolist(), i // 2) for i in range(200)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    codes, errors, book = plain_codes(rows, parts=4, entries=5, rounds=3)
    expected = sorted((i, c, errors[i], errors[i - i % 2] + errors[i - i % 2 + 1], vector_codes.codebook_digest(book, 4)) for i, c in enumerate(codes))
    assert code_rows(vector_codes.codes_with_label_errors(frame, parts=4, entries=5, rounds=3)) == expected
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", 10)
    assert code_rows(vector_codes.codes_with_label_errors(frame, parts=4, entries=5, rounds=3)) == expected


# --- 13 ---------------------------------------------------------------------


def plain_neighbours(rows, asked, k, scale=1024):
    whole = [(i, np.floor(np.array(v, np.float64) * scale).astype(np.int64).astype(object)) for i, v in rows]
    out = []
    for q, (query_id, v) in enumerate(whole):
        if query_id is None or not asked(query_id):
            continue
        near = sorted(((-int((v * o).sum()), i is None, i or 0) for c, (i, o) in enumerate(whole) if c != q and len(o) == len(v)))[:k]
        out += [(query_id, rank, None if null else i, -s) for rank, (s, null, i) in enumerate(near, 1)]
    return sorted(out, key=repr)


def neighbour_rows(df):
    return sorted(((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("length", ["unit", "uneven", "large"])
def test_neighbours_equal_plain_ones(spark, length):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(1500, 24))
    v = v / np.linalg.norm(v, axis=1, keepdims=True) if length == "unit" else v * np.exp(rng.normal(size=(1500, 1))) if length == "uneven" else v * 1e5
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    expected = plain_neighbours(rows, lambda i: i % 50 == 0, 10)
    assert neighbour_rows(exact_search.exact_neighbours(frame, F.col("vec_id") % 50 == 0)) == expected
    # queries in several chunks
    assert neighbour_rows(exact_search.exact_neighbours(frame, F.col("vec_id") % 50 == 0, chunk_bytes=2000)) == expected


def test_neighbours_among_ties_and_copies(spark):
    """Two thirds of the rows are one vector, ids repeat, and queries are copies of each other."""
    rng = np.random.default_rng(7)
    rows = [(i, [1.0, 1.0, 0.5]) for i in range(800)] + [(100, [1.0, 1.0, 0.5])] * 3 + [(100, [0.0, 0.0, 0.0])] + [(i, rng.integers(-2, 3, 3).astype(float).tolist()) for i in range(300, 700)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
    for k in (1, 10):
        assert neighbour_rows(exact_search.exact_neighbours(frame, F.col("vec_id") % 100 == 0, k=k)) == plain_neighbours(rows, lambda i: i % 100 == 0, k)


def test_neighbours_of_odd_vectors(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    odd = [(100, None), (200, [nan, 1.0]), (300, [inf, 1.0]), (400, [None, 1.0]), (500, [0.0, 0.0]), (600, [1.0, 2.0]), (600, [1.0, 2.0]), (None, [1.0, 2.0]), (7, [-1.0, 0.3]), (700, [1.0, 2.0, 3.0]), (800, [])]
    frame = spark.createDataFrame([(i, v, 1, 2, "x", 2, 3, 4) for i, v in odd], VECTORS)
    frame.write.parquet(f"{tmp_path}/embeddings.parquet")
    same(spark, connected(str(tmp_path)), "op13_histogram_top_k", str(tmp_path))
    usable = [(i, v) for i, v in odd if v is not None and all(x is not None and abs(x) < inf for x in v)]
    assert neighbour_rows(exact_search.exact_neighbours(frame, F.col("vec_id") % 100 == 0)) == plain_neighbours(usable, lambda i: i % 100 == 0, 10)
    assert exact_search.exact_neighbours(frame.where("false"), F.col("vec_id") % 100 == 0).collect() == []
    assert exact_search.exact_neighbours(frame, F.col("vec_id") == 7).count() == 4
    assert exact_search.exact_neighbours(frame, F.col("vec_id") == -1).count() == 0


def test_a_round_sends_few_bins(spark):
    """Whatever the scores, a query has at most k + 1 full bins of each block of rows."""
    rng = np.random.default_rng(8)
    rows = [(i, x.tolist()) for i, x in enumerate(rng.normal(size=(4000, 8)))]
    frame = staged(spark.createDataFrame(rows, "id long, v array<double>").coalesce(2), "v")
    largest = exact_search.largest_norms(frame, 1024)
    chunk = exact_search.Chunk([r.asDict() | {"copies": 1} for r in frame.where("id < 30").collect()], 1024, largest, 10)
    sent = exact_search._counted(frame, chunk, chunk.bits - exact_search.HISTOGRAM_BITS, 1024).where("n > 0").groupBy("query").count().collect()
    assert max(r["count"] for r in sent) <= 2 * 11

"""Near duplicates against brute force, and what becomes of odd rows and large groups."""

import random

import numpy as np
import pyarrow as pa
import pytest

from bayerloom.llm import near_duplicates as nd
from bayerloom.llm.common import shingles_by_text, table, window_hashes, word_hashes, words_of

from ..conftest import SF


def brute(rows, idf, least):
    hashes, offsets = word_hashes(pa.array([t for _, t in rows], pa.string()))
    forms = [nd.weighted(s, idf) for s in shingles_by_text(hashes, offsets)]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][1] is not None and (rows[i][1] == rows[j][1] or nd.jaccard(forms[i], forms[j]) >= least):
                parent[root(i)] = root(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(i)
    return {i: min(rows[j][0] for j in g) for g in groups.values() for i in g}


def test_word_hashes_see_the_words():
    texts = ["Ab c-d 12,é É", "", None, "x", "  ", "ab"]
    hashes, offsets = word_hashes(pa.array(texts, pa.string()))
    assert np.diff(offsets).tolist() == [len(words_of(t)) for t in texts]
    assert hashes[0] == hashes[-1] and hashes[4] == hashes[5] and len(set(hashes.tolist())) == 6
    assert len(window_hashes(hashes, 5)) == len(hashes) - 4


def test_samples_estimate_weighted_jaccard():
    rng = np.random.default_rng(3)
    close = []
    for _ in range(60):
        shingles = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64))
        a, b = rng.uniform(0.5, 8, len(shingles)), rng.uniform(0.5, 8, len(shingles))
        exact = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        close.append((nd.samples(shingles, a) == nd.samples(shingles, b)).mean() - exact)
    assert abs(np.mean(close)) < 0.03


def test_classes_equal_brute_force(spark):
    docs = table(spark, SF, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    expected = brute(rows, nd.inverse_frequencies(docs), 0.8)
    found = {r["doc_id"]: (r["class_id"], r["class_size"]) for r in nd.duplicate_classes(docs).collect()}
    assert {k: c for k, (c, _) in found.items()} == {rows[i][0]: c for i, c in expected.items()}
    kept = nd.one_of_each_class(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(expected.values()))


@pytest.fixture(scope="module")
def family(spark):
    """Copies, a chain that drifts away from its start, near copies of one text, and texts that share half."""
    rng = random.Random(5)

    def words(n):
        return [f"w{rng.randrange(10**6)}" for _ in range(n)]

    base, texts = words(300), []
    texts += [" ".join(base)] * 40
    for _ in range(60):
        near = list(base)
        near[rng.randrange(300)] = "changed"
        texts.append(" ".join(near))
    drift = words(300)
    for k in range(12):
        drift[k * 20 : k * 20 + 20] = words(20)
        texts.append(" ".join(drift))
    half = words(150)
    texts += [" ".join(half + words(150)) for _ in range(20)]
    texts += [" ".join(words(200)) for _ in range(20)]
    rng.shuffle(texts)
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_groups_are_whole(spark, family, monkeypatch):
    rows = [tuple(r) for r in family.collect()]
    expected = brute(rows, nd.inverse_frequencies(family), 0.8)
    for small in (2048, 4):  # small buckets at once, and large ones after splitting
        monkeypatch.setattr(nd, "SMALL", small)
        assert {r["doc_id"]: r["class_id"] for r in nd.duplicate_classes(family).collect()} == {rows[i][0]: c for i, c in expected.items()}


def test_components(spark):
    links = spark.createDataFrame([("b", "a"), ("b", "c"), ("d", "c"), ("x", "y"), ("z", "y"), ("z", "x")], "a string, b string")
    assert {tuple(r) for r in nd.components(links).collect()} == {(n, "a") for n in "abcd"} | {(n, "x") for n in "xyz"}


def test_odd_rows(odd_docs, no_docs):
    rows = nd.duplicate_classes(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by_id = {r["doc_id"]: r["class_id"] for r in rows if r["doc_id"] is not None}
    assert by_id[0] == 0 and by_id[1] == 1 and by_id[7] == by_id[6] == 6 and by_id[4] == 4
    assert {r["class_size"] for r in rows if r["doc_id"] == 6} == {3}
    kept = nd.one_of_each_class(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(set(by_id.values()))
    assert nd.duplicate_classes(no_docs).count() == 0 and nd.one_of_each_class(no_docs).count() == 0


def test_pairs_that_splits_part_are_proposed(spark, monkeypatch):
    """In a large bucket every pair of its first shared band that agrees enough is tried in the last round, whatever the splits part."""
    monkeypatch.setattr(nd, "SMALL", 8)
    rng = np.random.default_rng(6)
    rows = []
    for k in range(60):
        a = rng.integers(0, 2**32, nd.SAMPLES, dtype=np.uint32)
        a[nd.ROWS : nd.ROWS * 2] = 7  # all in one bucket of band 1
        b = a.copy()
        b[: nd.ROWS] += 1
        b[nd.ROWS * 2 : nd.ROWS * 6] += 1  # no split by samples of near bands keeps the two together
        fine = rng.integers(0, 2**16, nd.FINE_SAMPLES, dtype=np.uint16).tobytes()
        rows += [(5, 1, f"n{k:02}{side}", bytearray(c.tobytes()), bytearray(fine)) for side, c in (("a", a), ("b", b))]
    every = spark.createDataFrame(rows, "bucket long, band int, node string, sketch binary, fine binary")
    of = spark.createDataFrame([], "node string, component string")
    links, _ = nd._cross_links(every.drop("fine"), of, every.select("node", "fine"), None, None, None)
    assert sorted(tuple(r) for r in links.collect()) == [(f"n{k:02}a", f"n{k:02}b") for k in range(60)]


def test_pairs_that_cannot_be_similar_are_told_without_their_texts():
    """The bound passes over no pair that is similar enough, and most of those well below."""
    rng = np.random.default_rng(6)
    idf = rng.uniform(1, 9, nd.SLOTS)
    forms = []
    for _ in range(120):
        frame = rng.integers(0, 1 << 63, 200).astype(np.uint64) if not forms or rng.random() < 0.1 else frame
        kept = frame[rng.random(len(frame)) < rng.uniform(0.85, 1)]
        forms.append(nd.weighted(np.concatenate([kept, rng.integers(0, 1 << 63, int(rng.integers(0, 40))).astype(np.uint64)]), idf))
    leads = [nd.leading(*f, idf, 0.8) for f in forms]
    group = nd.Leads([c.tobytes() for c, _, _ in leads], [r.tobytes() for _, r, _ in leads], [w for _, _, w in leads])
    every, told, low = np.arange(len(forms)), 0, 0
    for k in range(len(forms)):
        possible = group.possible(k, group, every, 0.8)
        for j in range(len(forms)):
            if nd.jaccard(forms[k], forms[j]) >= 0.8:
                assert possible[j]
            elif nd.jaccard(forms[k], forms[j]) < 0.6:
                low, told = low + 1, told + (not possible[j])
    assert told > 0.9 * low


def test_a_family_just_below_the_similarity_costs_few_verifications(spark, monkeypatch):
    """400 texts of one frame: 200 pairs that are similar enough, all others a little less than that."""
    frame = " ".join(f"frame{k}" for k in range(300))
    texts = [f"{frame} " + " ".join([f"pair{k // 2}x{j}" for j in range(4)] + [f"own{k}x{j}" for j in range(3)]) for k in range(400)]
    idf = nd.inverse_frequencies(spark.createDataFrame([(t,) for t in texts], "text string"))
    forms = []
    for text in texts:
        hashes, offsets = nd.word_hashes(pa.array([text]))
        forms.append(nd.weighted(next(nd.shingles_by_text(hashes, offsets)), idf))
    below = [nd.jaccard(forms[k], forms[j]) for k in range(0, 60, 2) for j in range(k + 2, 60)]
    assert min(nd.jaccard(forms[k], forms[k + 1]) for k in range(0, 400, 2)) >= 0.8 > max(below) and np.mean(below) > 0.72
    verified, plain = [], nd._verified

    def counting(links, *rest):
        verified.append(links.count())
        return plain(links, *rest)

    monkeypatch.setattr(nd, "_verified", counting)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["class_id"] for r in nd.duplicate_classes(docs).collect()}
    assert found == {k: k // 2 * 2 for k in range(400)}
    # two hubs of each bucket and the windows of 2 and 16 partners; the last round adds next to none
    assert sum(verified) < 400 * (2 * nd.BANDS + 2 + 16) and verified[-1] < 400

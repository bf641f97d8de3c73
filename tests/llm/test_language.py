"""The language field: its lattice against enumeration, held-out accuracy, switching text, odd rows."""

import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest

from bayerloom.llm import language_id as li
from bayerloom.llm.common import table

SF = "/root/testdata/sf0.01"


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    offsets = np.array([0, 4, 4, 5, 8])
    scores, move, start = rng.normal(size=(8, 3)), np.exp(rng.normal(size=(3, 3))), np.exp(rng.normal(size=3))
    lattice = li.Lattice(scores, offsets)
    marginals, pairs = li._gradient(lattice, move, start)
    expected, moved = np.zeros((8, 3)), np.zeros((3, 3))
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if a == b:
            continue
        paths = list(itertools.product(range(3), repeat=b - a))
        weights = np.array([np.exp(sum(scores[a + t, y] for t, y in enumerate(p))) * start[p[0]] * np.prod([move[x, y] for x, y in itertools.pairwise(p)]) for p in paths])
        for p, w in zip(paths, weights / weights.sum(), strict=True):
            for t, y in enumerate(p):
                expected[a + t, y] += w
            for x, y in itertools.pairwise(p):
                moved[x, y] += w
    assert np.allclose(marginals, expected) and np.allclose(pairs, moved)
    total = lattice.backward(lattice.forward(move, start), move)
    assert np.allclose(total, [expected[a:b].sum(axis=0) for a, b in zip(offsets[:-1], offsets[1:], strict=True)])


@pytest.fixture(scope="module")
def field(spark):
    return li.fit(table(spark, SF, "documents"))


def test_held_out_accuracy(spark, field):
    docs = table(spark, SF, "documents")
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    rows = li.identify_languages(docs, field).collect()
    assert len(rows) == len(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    own = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in own) / len(own) > 0.97


def test_words_of_switching_text(field):
    parts = ["the thing with hand and ther", "der die und schkeit nicht das verung", "que para los ciónes mente las"]
    offsets, scores = field.scores(pa.array([" ".join(parts)]))
    alpha = li.Lattice(scores, offsets)
    marginals, _ = li._gradient(alpha, np.exp(field.move), np.exp(field.start))
    best = [field.languages[k] for k in marginals.argmax(axis=1)]
    expected = ["en"] * 6 + ["de"] * 7 + ["es"] * 6
    assert sum(a == b for a, b in zip(best, expected, strict=True)) >= 16


def test_odd_rows(odd_docs, no_docs, field):
    rows = li.identify_languages(odd_docs, field).collect()
    assert len(rows) == odd_docs.count()
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert all(by_id[k]["lang_pred"] == "und" and by_id[k]["score"] == 0 for k in (0, 1, 2, 3, 10))
    assert by_id[6]["lang_pred"] == "en"
    assert all(r["held_out"] is False for r in rows if r["doc_id"] is None)
    assert li.fit(no_docs) is None and li.identify_languages(no_docs).count() == 0
    assert {r["lang_pred"] for r in li.identify_languages(odd_docs.withColumn("lang", odd_docs["source"])).collect()} == {"und"}


def test_the_sample_is_bounded_whatever_repeats(spark):
    """One id on most rows, copies of a row, a very long text and a very long word."""
    rows = [(7, f"hot text number {k} of many", "en") for k in range(3000)] + [(8, "copied", "en")] * 3000 + [(k, " ".join(f"w{k}x{j}" for j in range(5000)), "de") for k in range(20, 60)]
    rows += [(k, "z" * 50_000, "es") for k in range(100, 120)] + [(200, None, "en"), (201, "text", None), (None, "text", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)
    sample = li.drawn(docs, 10).collect()
    by_lang = {lang: [r for r in sample if r["lang"] == lang] for lang in ("en", "de", "es")}
    assert len(sample) == sum(map(len, by_lang.values())) and all(0 < len(own) <= 20 for own in by_lang.values())
    assert len({tuple(r) for r in sample}) == len(sample)
    assert all(len(r["text"].encode()) <= li.FIT_BYTES and len(r["text"].split()) <= li.FIT_WORDS for r in sample)
    whole = {r[0]: r[1] for r in rows if r[0] in range(20, 60)}
    assert all(r["text"] in whole[r["doc_id"]] for r in by_lang["de"])
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in sample)


def test_predictions_equal_a_plain_forward_backward(spark, field):
    """The whole query on whole texts against sums over the lattice written out."""
    docs = table(spark, SF, "documents").limit(60)
    expected = {}
    for r in docs.collect():
        offsets, scores = field.scores(pa.array([r["text"]]))
        n, k = scores.shape
        move, start = np.exp(field.move.astype(np.float64)), np.exp(field.start.astype(np.float64))
        if not n:
            expected[r["doc_id"]] = ("und", 0.0)
            continue
        forward, backward = np.zeros((n, k)), np.ones((n, k))
        for t in range(n):
            forward[t] = np.exp(scores[t] - scores[t].max()) * (start if t == 0 else forward[t - 1] @ move)
            forward[t] /= forward[t].sum()
        for t in range(n - 2, -1, -1):
            backward[t] = move @ (np.exp(scores[t + 1] - scores[t + 1].max()) * backward[t + 1])
            backward[t] /= backward[t].sum()
        each = forward * backward
        share = (each / each.sum(axis=1, keepdims=True)).mean(axis=0)
        expected[r["doc_id"]] = (field.languages[int(share.argmax())] if any(c.isalpha() for c in r["text"]) else "und", float(share.max()))
    for r in li.identify_languages(docs, field).collect():
        name, score = expected[r["doc_id"]]
        assert r["lang_pred"] == name and (name == "und" or r["score"] == pytest.approx(score, abs=2e-3))

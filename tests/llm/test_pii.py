"""Personal data: base spans against plain regular expressions, estimation, masking, odd rows."""

import hashlib
import random
import re

import numpy as np
import pytest

from bayerloom.llm import pii
from bayerloom.llm.common import table

SF = "/root/testdata/sf0.01"


def brute(text):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub(r"[ -]", "", m[0])
        total = sum(sum(divmod(int(c) * 2, 10)) if k % 2 else int(c) for k, c in enumerate(reversed(digits)))
        if 16 <= len(digits) <= 19 and total % 10 == 0:
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_base_spans_equal_plain_patterns():
    rng = random.Random(2)
    pool = ["1", "23", "255", "300", ".", ".", "@", "a", "b.c", "+", " ", "-", "(", ")", "4111111111111111", "é", "x@y.z", "\n", "1.2.3.4", "+1 555-", "at", "(at)"]
    for _ in range(20000):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 25)))
        assert pii.candidates(text)[0] == brute(text), text


@pytest.mark.parametrize("text", ["1" * 200000, "a" * 200000 + "@", "1." * 100000, "+" + "(" * 200000, "a-" * 100000 + "1", "@" * 100000, "[at]" * 50000])
def test_long_runs_take_no_longer_than_their_length(text):
    pii.candidates(text)


def test_estimation_finds_the_reliable_labelers():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.3
    right = np.array([0.95, 0.9, 0.6, 0.55, 0.85])
    votes = np.where(rng.random((4000, 5)) < right, truth[:, None], ~truth[:, None]) * 2 - 1
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    belief, tables = pii.estimate(patterns, counts.astype(float))
    where = {tuple(p): b for p, b in zip(patterns, belief, strict=True)}
    assert np.mean([(where[tuple(v)] > 0.5) == t for v, t in zip(votes, truth, strict=True)]) > 0.95
    assert tables[0, 1, 2] > tables[2, 1, 2] > tables[3, 1, 2] - 0.1


@pytest.fixture(scope="module")
def model(spark):
    return pii.fit(table(spark, SF, "documents"))


def test_query_columns(spark, model):
    docs = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    rows = pii.find_personal_data(table(spark, SF, "documents"), model).collect()
    assert len(rows) == len(docs)
    for r in rows:
        base = brute(docs[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.BASE_KINDS] == [sum(b[0] == k for b in base) for k in range(4)]
        assert r["base_sha256"] == hashlib.sha256(pii.listed(base).encode()).hexdigest()
        assert set(filter(None, pii.listed(base).split(","))) <= set(r["spans"].split(","))
    assert any("secret:" in r["spans"] for r in rows)


def test_what_the_classifier_adds(model):
    text = 'token = "48160bb3fce0c31ad44167de7d05e47a1227f75a" and plain words 2024 version 12'
    assert [text[s:e] for _, s, e in model.spans(text)[1]] == ["48160bb3fce0c31ad44167de7d05e47a1227f75a"]
    assert model.spans("Nothing to see in 1999, or at 10.5 percent.")[1] == []


def test_masking(spark, model):
    docs = table(spark, SF, "documents")
    out = {r["doc_id"]: r for r in pii.mask_personal_data(docs, model).collect()}
    for r in docs.collect():
        new = out[r["doc_id"]]
        spans = model.spans(r["text"])[1]
        assert (new["lang"], new["source"]) == (r["lang"], r["source"])
        assert new["text"] == (pii.masked(r["text"], spans) if spans else r["text"])
        assert new["n_chars"] == (len(new["text"]) if spans else r["n_chars"])
        assert not brute(new["text"])
    assert pii.masked("a 1.2.3.4 b x@y.z", [(1, 2, 9), (0, 12, 17)]) == "a <IP> b <EMAIL>"


def test_odd_rows(odd_docs, no_docs, model):
    rows = pii.find_personal_data(odd_docs, model).collect()
    assert len(rows) == odd_docs.count()
    assert {(r["n_email"], r["spans"]) for r in rows if r["doc_id"] in (0, 1)} == {(0, "")}
    assert pii.mask_personal_data(odd_docs, model).columns == odd_docs.columns
    assert pii.find_personal_data(no_docs).count() == 0 and pii.mask_personal_data(no_docs).count() == 0
    assert pii.fit(no_docs).weights == []


def test_the_classifier_is_fitted_on_every_candidate(spark):
    """More copies of one candidate than any bounded sample holds, and few of the others: the slope over all is 0."""
    rng = random.Random(3)
    rare = [f"mail to u{k}@site{k % 7}.{rng.choice(['com', 'zz'])} or {rng.randrange(400)}.{rng.randrange(300)}.3.{k}, key = Ab{rng.randrange(10**20, 10**22)}xY" for k in range(60)]
    texts = ["call +1 555-010-9999 now"] * 15000 + ["version 1.2.3.4"] * 15000 + rare
    found = [(t, *c) for t in set(texts) for c in pii.candidates(t)[1]]
    counts = np.array([texts.count(t) for t, *_ in found], float)
    ballots = [tuple(pii.votes(*c)) for c in found]
    belief = np.zeros(len(found))
    for kind in {c[1] for c in found}:
        own = [k for k, c in enumerate(found) if c[1] == kind]
        patterns = sorted({ballots[k] for k in own})
        p, _ = pii.estimate(np.array(patterns), np.array([sum(counts[k] for k in own if ballots[k] == v) for v in patterns]))
        belief[own] = [p[patterns.index(ballots[k])] for k in own]
    x = np.array([pii.features(*c[:4]) for c in found])
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    w = np.array(pii.fit(docs).weights)
    assert np.abs(x.T @ (counts * (belief - 1 / (1 + np.exp(-(x @ w))))) - w).max() < 1e-3


def test_long_keys_are_candidates(model):
    rng = random.Random(8)
    for n in (20, 200, 201, 5000):
        key = "sk-4" + "".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789_-") for _ in range(n - 4))
        text = f'api key = "{key}" and more'
        assert (4, 11, 11 + n, False) in pii.candidates(text)[1]
        assert (4, 11, 11 + n) in model.spans(text)[1]
    assert not [c for c in pii.candidates("a-" * 100000 + " " + "-" * 30)[1] if c[0] == 4]


def test_touching_is_told_as_by_definition():

    rng = random.Random(3)
    for _ in range(300):
        spans = [(a, a + rng.randint(1, 6)) for a in (rng.randint(0, 40) for _ in range(rng.randint(0, 8)))]
        taken = pii._joined(spans)
        for start in range(0, 48):
            for end in range(start + 1, start + 5):
                assert pii._touches(taken, start, end) == any(s < end and start < e for s, e in spans)

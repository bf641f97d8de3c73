"""Benchmark tiling and licence alignment."""

import random

import numpy as np
import pyarrow as pa

from bayerloom.llm import decontamination as dc
from bayerloom.llm import licenses as li
from bayerloom.llm.common import table, words_of

from ..conftest import SF


def slow_tiles(doc, item, width):
    """Greedy string tiling by trying every pair of places."""
    used_doc, used_item, laid = set(), set(), []
    while True:
        best = (0, 0, 0)
        for p in range(len(doc)):
            for q in range(len(item)):
                n = 0
                while p + n < len(doc) and q + n < len(item) and doc[p + n] == item[q + n] and p + n not in used_doc and q + n not in used_item:
                    n += 1
                if n > best[0]:
                    best = (n, p, q)
        if best[0] < width:
            return laid
        n, p, q = best
        used_doc |= set(range(p, p + n))
        used_item |= set(range(q, q + n))
        laid.append(best)


def test_tiling_equals_brute_force():
    rng = random.Random(2)
    for _ in range(150):
        item = [rng.choice("abcdef") for _ in range(rng.randint(5, 25))]
        doc = [rng.choice("abcdef") for _ in range(rng.randint(0, 40))]
        cut = rng.randint(0, len(item))
        doc[rng.randint(0, len(doc)) :] = item[cut:] + ["zz"] + item[:cut]
        expected = slow_tiles(doc, item, 5)
        ((hits),) = dc.Benchmark([(1, " ".join(item))]).hits(pa.array([" ".join(doc)]), 0.0)
        share = sum(n for n, _, _ in expected) / len(item)
        assert [(h[1], h[2], h[3]) for h in hits] == ([(share, len(expected), max(n for n, _, _ in expected))] if expected else [])


def test_reordered_passages_are_caught_and_clean_texts_are_not():
    item = [f"w{k}" for k in range(30)]
    moved = item[20:] + ["x"] + item[10:20] + ["y", "z"] + item[:10]
    own = dc.Benchmark([(7, " ".join(item)), (8, "short one"), (9, None), (10, "")])
    hits = own.hits(pa.array([" ".join(moved), " ".join(item[:10]), "a short one here", None, "", "short two one"]), dc.COVERAGE)
    assert [[h[0] for h in x] for x in hits] == [[7], [], [8], [], [], []]


def test_all_verbatim_items_are_found(spark, monkeypatch):
    docs, items = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    found = {(r["doc_id"], r["item_id"]) for r in dc.contaminated(docs, items).collect()}
    texts = {r["doc_id"]: " ".join(words_of(r["text"])) for r in docs.collect()}
    expected = {(d, r["item_id"]) for r in items.collect() for d, t in texts.items() if f" {' '.join(words_of(r['text']))} " in f" {t} "}
    assert expected and expected <= found
    clean = dc.clean_documents(docs, items)
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == set(texts) - {d for d, _ in found}
    monkeypatch.setattr(dc, "BLOCK_BYTES", 2000)  # several blocks give the same
    assert {(r["doc_id"], r["item_id"]) for r in dc.contaminated(docs, items).collect()} == found
    assert dc.clean_documents(docs, items).count() == clean.count()


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, None), (None, "lazy dog while seven wizards boil"), (2, ""), (3, "lazy dog while seven wizards boil")], "item_id long, text string")
    rows = dc.contaminated(odd_docs, items).collect()
    assert sorted((r["doc_id"], r["item_id"] or 0) for r in rows) == sorted((k, i) for k in (6, 6, 7, 8) for i in (0, 3))
    assert dc.clean_documents(odd_docs, items).count() == odd_docs.count() - 4
    for empty in (dc.contaminated(no_docs, items), dc.contaminated(odd_docs, items.where("item_id = 99")), dc.clean_documents(no_docs, items), li.scan_licenses(no_docs)):
        assert empty.count() == 0
    assert dc.clean_documents(odd_docs, items.where("item_id = 99")).count() == odd_docs.count()
    assert li.scan_licenses(odd_docs).count() == 0


def test_patience_keeps_order_and_only_equal_words():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.randrange(12) for _ in range(rng.randint(0, 20))] for _ in range(2))
        pairs = li.align(a, b)
        assert all(a[p] == b[q] for p, q in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))
    assert li.align([1, 2, 3, 9, 4], [1, 2, 3, 4]) == [(0, 0), (1, 1), (2, 2), (4, 3)]
    values = [rng.randrange(50) for _ in range(40)]
    chain = li.increasing(values)
    lengths = []
    for k, v in enumerate(values):
        lengths.append(1 + max((lengths[j] for j in range(k) if values[j] < v), default=0))
    assert len(chain) == max(lengths) and all(values[x] < values[y] for x, y in zip(chain, chain[1:], strict=False))


def test_notices(spark):
    scanner = li.Scanner()
    filler = " ".join(f"w{k}" for k in range(50))
    texts = [f"{filler} {t} {filler}" for _, t in li.TEMPLATES]
    for (name, text), hits in zip(li.TEMPLATES, scanner.scan(pa.array(texts), 0.8), strict=True):
        assert [(h[0], h[1]) for h in hits] == [(name, 1.0)], text
        assert hits[0][3] == 50
    mit = next(t for n, t in li.TEMPLATES if n == "MIT" and t.startswith("Permission"))
    worn = mit.replace("without limitation", "with no limit").replace("free of charge", "freely")
    twice = f"{filler} {worn}\n{worn} and more"
    assert [h[0] for h in scanner.scan(pa.array([twice]), 0.8)[0]] == ["MIT", "MIT"]
    assert scanner.scan(pa.array([filler, None, "", "released under the"]), 0.8) == [[], [], [], []]


def test_every_verbatim_notice_is_found(spark):
    docs = table(spark, SF, "documents")
    found = {}
    for r in li.scan_licenses(docs).collect():
        found[r["doc_id"], r["license"]] = found.get((r["doc_id"], r["license"]), 0) + 1
    lines = {"Apache-2.0": "Licensed under the Apache License, Version 2.0.", "MIT": "Released under the MIT License.", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0."}
    expected = {(r["doc_id"], n): r["text"].count(line) for r in docs.collect() for n, line in lines.items() if line in r["text"]}
    assert expected and all(found.get(k, 0) >= v for k, v in expected.items())
    assert np.isfinite([r["coverage"] for r in li.scan_licenses(docs).collect()]).all()


def test_notices_in_parts_are_found():
    scanner = li.Scanner()
    mit = words_of(next(t for n, t in li.TEMPLATES if n == "MIT" and t.startswith("Permission")))
    gpl = words_of(next(t for n, t in li.TEMPLATES if n == "GPL-2.0"))

    def names(*parts):
        return [(h[0], h[1]) for h in scanner.scan(pa.array([" ".join(w for p in parts for w in p)]), 0.8)[0]]

    for n in (10, 30, 500):
        page = [f"w{k}" for k in range(n)]
        for words, name in ((mit, "MIT"), (gpl, "GPL-2.0")):
            a, b = words[: len(words) // 2], words[len(words) // 2 :]
            assert names(page, a, page, b, page) == [(name, 1.0)]
            assert names(a, page, b, page, a, page, b) == [(name, 1.0)] * 2
            assert names(words, page, a, page, b, words) == [(name, 1.0)] * 3
        assert names(mit[:30], page, mit[30:60], page, mit[60:]) == [("MIT", 1.0)]
        assert names(mit[:80], page, mit[80:]) == [("MIT", 1.0)]
        assert names(mit[:40], page, words_of("Released under the BSD License."), page, mit[40:]) == [("MIT", 1.0), ("BSD", 1.0)]
        assert names(words_of("Licensed under CC BY-NC 4.0."), page, words_of("Licensed under CC BY-SA 4.0.")) == [("CC-BY-NC-4.0", 1.0), ("CC-BY-SA-4.0", 1.0)]


def test_names_and_versions_must_be_there():
    scanner = li.Scanner()

    def name(text):
        return [h[0] for h in scanner.scan(pa.array([f"some words before. {text} and some after"]), 0.8)[0]]

    assert name("Released under the Zlib License.") == ["Zlib"]
    assert name("Licensed under the Mozilla License.") == ["unknown"]
    assert name("Released under the Apache License.") == ["Apache"]
    assert name("This work is licensed under the GNU General Public License, version 1.") == ["unknown"]
    assert name("Licensed under CC BY 3.0.") == ["CC-BY-3.0"]
    assert name("This work is licensed under a Creative Commons Attribution 3.0 International License.") == ["CC-BY-3.0"]
    assert name("Licensed under CC BY-NC-ND 4.0.") == ["CC-BY-NC-ND-4.0"]
    assert name("Licensed under CC BY 7.0.") == ["unknown"]
    for text, right in [(t, n) for n, t in li.TEMPLATES]:
        assert name(text.replace("*", "")) == [right]


def slow_length(a, b):
    """The least length of a patience alignment by its definition: equal ends, then the longest increasing choice of words unique in both."""
    ends = 0
    while a and b and a[0] == b[0]:
        a, b, ends = a[1:], b[1:], ends + 1
    while a and b and a[-1] == b[-1]:
        a, b, ends = a[:-1], b[:-1], ends + 1
    both = [(p, b.index(w)) for p, w in enumerate(a) if a.count(w) == 1 and b.count(w) == 1]
    choices = [[both[k] for k in range(len(both)) if chosen >> k & 1] for chosen in range(1 << len(both))]
    rising = [c for c in choices if all(x[1] < y[1] for x, y in zip(c, c[1:], strict=False))]
    longest = max(map(len, rising))
    if not longest:
        return {ends}
    out = set()
    for chain in (c for c in rising if len(c) == longest):
        totals = {ends + longest}
        for (p, q), (p2, q2) in zip([(-1, -1), *chain], [*chain, (len(a), len(b))], strict=True):
            totals = {t + n for t in totals for n in slow_length(a[p + 1 : p2], b[q + 1 : q2])}
        out |= totals
    return out


def test_alignments_are_those_of_the_definition():
    """As long as an alignment that some longest choice of anchors gives, gaps aligned in the same way."""
    rng = random.Random(11)
    for _ in range(400):
        a, b = ([rng.randrange(8) for _ in range(rng.randint(0, 9))] for _ in range(2))
        assert len(li.align(a, b)) in slow_length(a, b)


def test_many_notices_in_one_text_take_time_in_proportion():
    import time

    scanner, notice = li.Scanner(), "Released under the MIT License. Licensed under CC BY 4.0. filler words here "
    seconds = []
    for n in (500, 2000):
        began = time.perf_counter()
        (hits,) = scanner.scan(pa.array([notice * n]), 0.8)
        seconds.append(time.perf_counter() - began)
        assert len(hits) == 2 * n
    assert seconds[1] < 12 * seconds[0] + 0.5


def test_items_of_one_word_match_nothing():
    own = dc.Benchmark([(1, "the"), (2, "the end")])
    assert [[h[0] for h in x] for x in own.hits(pa.array(["the start and the end", "the start"]), dc.COVERAGE)] == [[2], []]

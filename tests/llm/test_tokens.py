"""Token counts and encodings against the tokenizers library."""

import hashlib
import random
import sys

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from bayerloom.llm import bpe, token_counts
from bayerloom.llm.common import table

from ..conftest import SF

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["a", "b", " ", "  ", "\n", "\t", "é", "ñ", "Σ", "İ", "中", "１", "½", "Ⅷ", "'s", "'LL", "<|endoftext|>", "<|startoftext|>", "😀", "\x1c", "\x85", "́", "e", "th", "ing", "1", "234", "!!", "...", "\x00", "ß", "don't"]


@pytest.fixture(scope="module")
def word():
    return token_counts.PairMerger(open(WORD, "rb").read()), Tokenizer.from_file(WORD)


@pytest.fixture(scope="module")
def byte():
    return bpe.TrieEncoder(open(BYTE, "rb").read()), Tokenizer.from_file(BYTE)


def odd_texts(n=3000):
    rng = random.Random(1)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40))) for _ in range(n)] + ["a" * 5000, " " * 3000, "\n" * 777, "0123456789" * 100, "x" * 60000]


def test_counts_equal_the_library(word):
    merger, library = word
    texts = odd_texts()
    assert [token_counts.count_tokens(merger, t) for t in texts] == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_encodings_equal_the_library_and_decode(byte):
    encoder, library = byte
    texts = odd_texts()
    found = [ids for k in range(0, len(texts), 100) for ids in encoder.encode(texts[k : k + 100])]
    assert found == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [encoder.decode(ids) for ids in found] == [library.decode(ids, skip_special_tokens=False) for ids in found] == texts


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text_goes_round(byte, text):
    encoder, library = byte
    (ids,) = encoder.encode([text])
    assert ids == library.encode(text, add_special_tokens=False).ids and encoder.decode(ids) == text


def test_remembered_words_are_bounded(byte, monkeypatch):
    encoder, library = byte
    monkeypatch.setattr(bpe, "REMEMBERED_WORDS", 50)
    texts = [" ".join(f"w{k}x{j}" for j in range(40)) for k in range(20)]
    for text in texts + texts:
        assert encoder.encode([text]) == [library.encode(text, add_special_tokens=False).ids]
    assert len(encoder.words) <= 50 + 40 * 4


def test_queries_over_the_table(spark, word, byte):
    docs = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    for r in token_counts.token_counts(table(spark, SF, "documents"), WORD).collect():
        text = docs[r["doc_id"]]
        n = len(word[1].encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 2048)
    for r in bpe.round_trip_digests(table(spark, SF, "documents"), BYTE).collect():
        ids = byte[1].encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(byte[1].decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_rows(odd_docs, no_docs):
    rows = token_counts.token_counts(odd_docs, WORD).collect()
    assert len(rows) == odd_docs.count()
    assert {(r["n_bytes"], r["n_tokens"]) for r in rows if r["doc_id"] in (0, 1)} == {(0, 0)}
    encoded = bpe.encode_documents(odd_docs, BYTE)
    assert encoded.count() == odd_docs.count() and encoded.where("not lossless").isEmpty()
    texts = {r["doc_id"]: r["text"] for r in bpe.decode_documents(encoded, BYTE).where("doc_id is not null").collect()}
    assert texts == {r["doc_id"]: r["text"] or "" for r in odd_docs.where("doc_id is not null").collect()}
    for empty in (token_counts.token_counts(no_docs, WORD), bpe.encode_documents(no_docs, BYTE), bpe.round_trip_digests(no_docs, BYTE)):
        assert empty.count() == 0


def held_bytes(thing, seen: set) -> int:
    if id(thing) in seen:
        return 0
    seen.add(id(thing))
    inner = [x for pair in thing.items() for x in pair] if isinstance(thing, dict) else thing if isinstance(thing, (list, tuple)) else ()
    return sys.getsizeof(thing) + sum(held_bytes(x, seen) for x in inner)


def test_an_encoder_stays_small_with_all_it_remembers():
    """Below 150 MB once chunks, older chunks, moves and pairs have reached their bounds, on texts of few repeats."""
    rng = random.Random(2)
    encoder = bpe.TrieEncoder(open(BYTE, "rb").read())
    turns = 0
    for k in range(400):
        before = encoder.older
        letters = "abcdefghijklmnopqrstuvwxyzéß中文Σ0123456789-_./'"
        encoder.encode_arrays([" ".join("".join(rng.choices(letters, k=rng.randint(2, 14))) for _ in range(300)) for _ in range(20)])
        turns += encoder.older is not before
        if turns == 2 and encoder.held > 0.9 * bpe.REMEMBERED_BYTES:
            break
    assert turns == 2 and encoder.held > 0.9 * bpe.REMEMBERED_BYTES
    assert held_bytes(vars(encoder), set()) < 150e6

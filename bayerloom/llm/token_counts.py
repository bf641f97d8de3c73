"""Token counts by heap-and-linked-list byte-pair merging.

A word's symbols form a doubly linked list; a heap holds its adjacent pairs by
(rank, position). The lowest pair is merged again and again, stale heap entries
are skipped, and the count is the initial symbols minus the merges: no token
identifiers are made. Words repeat, so each task remembers the counts of the
short words that it has seen.

Nulls and empty texts have 0 bytes and 0 tokens. A null doc_id stays null, each
row gives one row (repeated rows too), an empty table gives an empty result,
and columns other than doc_id and text are not read.
"""

from __future__ import annotations

import json
import re
import unicodedata
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import map_slices

CONTEXT_TOKENS = 2048
REMEMBERED_WORDS = 400_000
REMEMBERED_LENGTH = 48

#: The Unicode white space, and the byte alphabet of byte-level vocabularies.
SPACE = r"\t-\r \x85\xa0  -     　"
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself where printable, else the next free one from U+0100."""
    printable, others = set(_PRINTABLE), iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class PairMerger:
    """Counts the symbols that remain of a word; missing words of `counts` are computed on access."""

    def __init__(self, vocabulary: bytes):
        spec = json.loads(vocabulary)
        model = spec["model"]
        ids = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        alphabet = byte_alphabet()
        self.inner = [ids.get(c) for c in alphabet]
        self.final = [ids.get(c + suffix) for c in alphabet]
        self.pairs = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.pairs[ids[left] << 32 | ids[right]] = (rank, ids[left + right])
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.special_split = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        owner = self

        class Counts(dict):
            def __missing__(self, word: str) -> int:
                n = owner.older.get(word)
                if n is None:
                    n = owner.count_symbols(word.encode())
                if len(word) <= REMEMBERED_LENGTH:
                    if len(self) >= REMEMBERED_WORDS:
                        owner.older = dict(self)
                        self.clear()
                    self[word] = n
                return n

        self.older: dict[str, int] = {}
        self.counts = Counts()

    def count_symbols(self, word: bytes) -> int:
        symbols = [s for s in [*map(self.inner.__getitem__, word[:-1]), self.final[word[-1]]] if s is not None]
        n, get = len(symbols), self.pairs.get
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = []
        for at in range(n - 1):
            found = get(symbols[at] << 32 | symbols[at + 1])
            if found:
                heap.append(found[0] << 32 | at)
        heapify(heap)
        merges = 0
        while heap:
            entry = heappop(heap)
            at = entry & 0xFFFFFFFF
            right = after[at]
            if right < 0 or symbols[at] < 0:
                continue
            found = get(symbols[at] << 32 | symbols[right])
            if found is None or found[0] != entry >> 32:
                continue
            merges += 1
            symbols[at], symbols[right] = found[1], -1
            after[at] = beyond = after[right]
            if beyond >= 0:
                before[beyond] = at
                made = get(symbols[at] << 32 | symbols[beyond])
                if made:
                    heappush(heap, made[0] << 32 | at)
            left = before[at]
            if left >= 0:
                made = get(symbols[left] << 32 | symbols[at])
                if made:
                    heappush(heap, made[0] << 32 | left)
        return n - merges


#: The contractions, then letters, one numeral, and other marks, as the vocabulary's file splits words.
_ASCII_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-z]+|[0-9]|[^%sA-Za-z0-9]+" % SPACE)
_ANY_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^%s\p{L}\p{N}]+" % SPACE)


def split_words(text: str) -> list[str]:
    if text.isascii():
        return _ASCII_WORD.findall(text.lower())
    return _ANY_WORD.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())


def count_tokens(merger: PairMerger, text: str | None) -> int:
    if not text:
        return 0
    get = merger.counts.__getitem__
    if merger.special_split is None or not any(s in text for s in merger.special):
        return sum(map(get, split_words(text)))
    parts = merger.special_split.split(text)
    return len(parts) - 1 + sum(sum(map(get, split_words(p))) for p in parts if p)


def token_counts(docs: DataFrame, vocabulary_path: str, limit: int = CONTEXT_TOKENS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs.

    The vocabulary (some MB, a fixed file) is read on the driver and broadcast.
    """
    with open(vocabulary_path, "rb") as file:
        shipped = docs.sparkSession.sparkContext.broadcast(file.read())

    def work():
        merger = PairMerger(shipped.value)

        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            n = pa.array([count_tokens(merger, t) for t in part.column("text").to_pylist()], pa.int64())
            size = pc.fill_null(pc.binary_length(part.column("text")), 0).cast(pa.int64())
            return pa.RecordBatch.from_arrays([part.column("doc_id"), size, n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

        return step

    return map_slices(docs.select("doc_id", "text"), "text", work, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

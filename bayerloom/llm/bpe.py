"""Byte-pair encoding and decoding by prefix-sharing trie traversal.

The encoding of a prefix is known from its last token: with last token t it is
the encoding of the prefix without t, then t, and t is the one vocabulary entry
ending there that may follow the last token of that shorter prefix. So the
distinct new words of a slice form a trie, and a depth-first walk computes one
last token for each node: what words have in common is encoded once. The trie
is held as its words in byte order, each with the length of the prefix that it
shares with the word before: that is the depth-first order of its nodes, and
only the states of the path to the current one are kept. Entries that end at a
node come from an automaton of the vocabulary, whose state is part of the node's.

Two tokens may stand side by side if no merge would ever join symbols across
their border; only the symbols that touch the border while each token is being
built (its spine) can take part.

Most texts consist of chunks between single spaces, and a chunk's words don't
depend on what is around it; so short chunks that were seen are looked up.
Worker processes keep an encoder from task to task: some 45 MB for the
vocabulary, REMEMBERED_BYTES twice for chunks, and fixed numbers of moves and
pairs of tokens, below 150 MB in all. A word of any length costs 4 bytes a byte
beside its tokens.

Nulls count as empty texts: 0 tokens, hashes of nothing. A null doc_id stays
null, every row gives one row, an empty table gives an empty result, and only
doc_id and text are read.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from array import array
from itertools import chain
from sys import getsizeof

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import kept, map_slices
from .token_counts import SPACE, byte_alphabet

REMEMBERED_WORDS = 250_000
REMEMBERED_BYTES = 28 << 20
REMEMBERED_LENGTH = 48
REMEMBERED_PAIRS = 250_000
REMEMBERED_MOVES = 125_000
REMEMBERED_SPINES = 4000
LONG_WORD = 256
SLICE_BYTES = 2 << 20
_ENTRY = 100  # bytes of a dict's entry, about
_NEVER = 1 << 40

#: How byte-level vocabularies cut texts into words before merging.
_ASCII_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^%(s)sA-Za-z0-9]+|[%(s)s]+(?![^%(s)s])|[%(s)s]+" % {"s": SPACE})
_ANY_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^%(s)s\p{L}\p{N}]+|[%(s)s]+(?![^%(s)s])|[%(s)s]+" % {"s": SPACE})


_AT_BORDER = re.compile(r"[%(s)s]|.*[%(s)s]\Z" % {"s": SPACE}, re.DOTALL)


def split_words(text: str) -> list[str]:
    return (_ASCII_WORD if text.isascii() else _ANY_WORD).findall(text)


def shared_lengths(words: list[bytes]) -> list[int]:
    """How many leading bytes each of the sorted words shares with the one before, up to LONG_WORD."""
    width = 32
    found = np.zeros(len(words), np.int64)
    for at in range(0, len(words), 1 << 16):
        part = words[max(at - 1, 0) : at + (1 << 16)]
        table = np.frombuffer(b"".join(w[:width].ljust(width, b"\0") for w in part), np.uint8).reshape(-1, width)
        differ = table[1:] != table[:-1]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        lengths = np.array([min(len(w), width) for w in part])
        found[at + (at == 0) : at + (1 << 16)] = np.minimum(first, np.minimum(lengths[1:], lengths[:-1]))
    out = found.tolist()
    for k in np.flatnonzero(found == width).tolist():
        a, b = words[k - 1], words[k]
        n, most = width, min(len(a), len(b), LONG_WORD)
        while n < most and a[n] == b[n]:
            n += 1
        out[k] = n
    return out


class TrieEncoder:
    """Texts to token ids, and ids back to bytes. Encodings of words and chunks are 4 bytes a token."""

    def __init__(self, vocabulary: bytes):
        spec = json.loads(vocabulary)
        ids, alphabet = spec["model"]["vocab"], byte_alphabet()
        to_byte = {c: b for b, c in enumerate(alphabet)}
        bytes_of: dict[int, bytes] = {i: bytes(to_byte[c] for c in t) for t, i in ids.items()}
        self.rank: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            made = ids[left + right]
            self.rank.setdefault(ids[left] << 32 | ids[right], rank)
            self.halves.setdefault(made, (rank, ids[left], ids[right]))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._spines: dict[int, tuple[list, list]] = {}
        self._pairs: dict[int, bool] = {}
        self._automaton({b: i for i, b in bytes_of.items()})
        bytes_of |= {i: s.encode() for s, i in self.special.items()}
        every = range(max(bytes_of, default=-1) + 1)
        self.bytes_of = [bytes_of.get(i, b"") for i in every]
        self.size = [len(b) for b in self.bytes_of]
        self.digits = [str(i) for i in every]
        self.words: dict[str, bytes] = {}  # what chunks are encoded to, and what was remembered before them
        self.older: dict[str, bytes] = {}
        self.held = 0

    def _automaton(self, id_of: dict[bytes, int]) -> None:
        """The vocabulary's own trie (edges), each node's longest proper suffix that is a node (fail), and the tokens that end there."""
        edges: dict[int, int] = {}
        parent, label, token_at = [0], [0], {}
        for text, token in id_of.items():
            node = 0
            for byte in text:
                key = node << 8 | byte
                if key not in edges:
                    edges[key] = len(parent)
                    parent.append(node)
                    label.append(byte)
                node = edges[key]
            token_at[node] = token
        depth = [0] * len(parent)
        for node in range(1, len(parent)):
            depth[node] = depth[parent[node]] + 1
        fail = [0] * len(parent)
        self.edges, self.fail = edges, fail
        whole: dict[int, bool] = {}
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * len(parent)
        for node in sorted(range(1, len(parent)), key=depth.__getitem__):
            if depth[node] > 1:
                back = fail[parent[node]]
                while back and back << 8 | label[node] not in edges:
                    back = fail[back]
                fail[node] = edges.get(back << 8 | label[node], 0)
            own = token_at.get(node)
            stand = own is not None and self.stands(own, whole)
            self.ends[node] = (((depth[node], own),) + self.ends[fail[node]]) if stand else self.ends[fail[node]]
        self.moves: dict[int, int] = {}

    def move(self, state: int, byte: int) -> int:
        """The automaton's next state, remembered."""
        at = state
        while at and at << 8 | byte not in self.edges:
            at = self.fail[at]
        if len(self.moves) >= REMEMBERED_MOVES:
            self.moves.clear()
        found = self.moves[state << 8 | byte] = self.edges.get(at << 8 | byte, 0)
        return found

    def spines(self, token: int) -> tuple[list, list]:
        """The symbols that touch the token's left and right border as it is built, each with the rank that ends it."""
        if token not in self._spines:
            if len(self._spines) >= REMEMBERED_SPINES:
                self._spines.clear()
            sides: tuple[list, list] = ([], [])
            for side, spine in enumerate(sides):
                symbol, ends = token, _NEVER
                while True:
                    spine.append((symbol, ends))
                    if symbol not in self.halves:
                        break
                    ends = self.halves[symbol][0]
                    symbol = self.halves[symbol][1 + side]
            self._spines[token] = sides
            return sides
        return self._spines[token]

    def stands(self, token: int, whole: dict[int, bool]) -> bool:
        """Whether the token's own bytes encode to it; whole: what is known of that."""
        known = whole.get(token)
        if known is None:
            known = True
            if token in self.halves:
                _, left, right = self.halves[token]
                known = self.stands(left, whole) and self.stands(right, whole) and self.meet(left, right) == self.halves[token][0]
            whole[token] = known
        return known

    def meet(self, left: int, right: int) -> int:
        """The rank of the first merge across the border of two finished tokens, or _NEVER."""
        first = _NEVER
        for symbol, ends in self.spines(left)[1]:
            for other, other_ends in self.spines(right)[0]:
                rank = self.rank.get(symbol << 32 | other, _NEVER)
                if rank < first and rank < ends and rank <= other_ends:
                    first = rank
        return first

    def may_follow(self, left: int, right: int) -> bool:
        known = self.meet(left, right) == _NEVER
        if len(self._pairs) >= REMEMBERED_PAIRS:
            self._pairs.clear()
        self._pairs[left << 32 | right] = known
        return known

    def encode_words(self, words: set[str]) -> dict[str, bytes]:
        """The encodings of distinct words by one depth-first walk over their trie."""
        made: dict[str, bytes] = {}
        if not words:
            return made
        moves, move, ends, pairs, may_follow = self.moves.get, self.move, self.ends, self._pairs.get, self.may_follow
        size = self.size
        # the path to the current node: its automaton states and the last tokens of its prefixes
        states, last = [0] * (LONG_WORD + 1), [0] * (LONG_WORD + 1)
        ordered = sorted((w.encode(), w) for w in words)
        for shared, (code, word) in zip(shared_lengths([c for c, _ in ordered]), ordered, strict=True):
            path = last
            if len(code) > LONG_WORD:
                path = array("i", last)
                path.frombytes(bytes(4 * (len(code) - LONG_WORD)))
            depth, state = shared, states[shared]
            for byte in memoryview(code)[shared:]:
                depth += 1
                known = moves(state << 8 | byte)
                state = move(state, byte) if known is None else known
                for length, token in ends[state]:
                    if length == depth:
                        break
                    before = path[depth - length]
                    fits = pairs(before << 32 | token)
                    if may_follow(before, token) if fits is None else fits:
                        break
                else:
                    raise ValueError("the vocabulary lacks a byte")
                path[depth] = token
                if depth <= LONG_WORD:
                    states[depth] = state
            if path is not last:
                last[:] = path[: LONG_WORD + 1].tolist()
            tokens, at = array("i"), depth
            while at:
                token = path[at]
                tokens.append(token)
                at -= size[token]
            tokens.reverse()
            made[word] = tokens.tobytes()
        return made

    def _remember(self, new: dict[str, bytes]) -> None:
        """Drop the long ones of the new chunks; what is kept becomes the older half, in place of the one before, when it is too much."""
        for text in [t for t in new if len(t) > REMEMBERED_LENGTH]:
            del self.words[text], new[text]
        self.held += sum(map(getsizeof, new)) + sum(map(getsizeof, new.values())) + _ENTRY * len(new)
        if len(self.words) > REMEMBERED_WORDS or self.held > REMEMBERED_BYTES:
            self.words, self.older, self.held = {}, self.words, 0

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Token ids of each text."""
        return [ids.tolist() for ids in self.encode_arrays(texts)]

    def encode_arrays(self, texts: list[str | None]) -> list[np.ndarray]:
        """Token ids of each text, equal texts once."""
        distinct = {t: k for k, t in enumerate(dict.fromkeys(texts))}
        collecting = gc.isenabled()
        gc.disable()  # no cycles are made, and looking for them among all that is remembered is slow
        try:
            found = [np.frombuffer(code, np.int32) for code in self._encode(list(distinct))]
        finally:
            if collecting:
                gc.enable()
        return [found[distinct[t]] for t in texts]

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        """Encodings of distinct texts. A part of a text is a special token's encoding, a list of words, or a (first words, chunks) pair."""
        cut: list[list] = []
        chunks: set[str] = set()
        special = {s: array("i", [i]).tobytes() for s, i in self.special.items()}
        for text in texts:
            if not text:
                cut.append([])
            elif self.special_split is not None and any(s in text for s in special):
                cut.append([special[p] if p in special else split_words(p) for p in self.special_split.split(text) if p])
            else:
                parts = text.split(" ")
                cut.append([(split_words(parts[0]), parts[1:])])
                chunks.update(parts[1:])
        new = chunks.difference(self.words)
        # a chunk that is empty or has white space at an end is not cut as it would be among its neighbours
        odd = {c for c in new if not c or _AT_BORDER.match(c)}
        new -= odd
        codes = {c: self.older[c] for c in new.intersection(self.older)}
        new.difference_update(codes)
        if odd:
            for k, parts in enumerate(cut):
                if parts and isinstance(parts[0], tuple) and not odd.isdisjoint(parts[0][1]):
                    cut[k] = [split_words(texts[k])]
        inside = {c: split_words(" " + c) for c in new}
        words = set(chain.from_iterable(inside.values()))
        for parts in cut:
            for part in parts:
                if not isinstance(part, bytes):
                    words.update(part[0] if isinstance(part, tuple) else part)
        get = self.encode_words(words).__getitem__
        for chunk, own in inside.items():
            codes[chunk] = get(own[0]) if len(own) == 1 else b"".join(map(get, own))
        self.words |= codes
        get_chunk = self.words.__getitem__
        found = []
        for parts in cut:
            pieces: list[bytes] = []
            for part in parts:
                if isinstance(part, bytes):
                    pieces.append(part)
                elif isinstance(part, tuple):
                    pieces += map(get, part[0])
                    pieces += map(get_chunk, part[1])
                else:
                    pieces += map(get, part)
            found.append(b"".join(pieces))
        self._remember(codes)
        return found

    def decode(self, ids: list[int] | np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids)).decode("utf-8", "replace")


def _encoder(vocabulary: bytes) -> TrieEncoder:
    """This process's encoder of a vocabulary: worker processes outlive their tasks."""
    return kept(hashlib.sha256(vocabulary).digest(), lambda: TrieEncoder(vocabulary))


def _mapped(docs: DataFrame, vocabulary_path: str, make, schema: str) -> DataFrame:
    """The vocabulary (some MB, a fixed file) is read on the driver and broadcast."""
    with open(vocabulary_path, "rb") as file:
        shipped = docs.sparkSession.sparkContext.broadcast(file.read())

    def work():
        encoder = _encoder(shipped.value)
        return lambda part: make(encoder, part)

    return map_slices(docs, "text", work, schema, SLICE_BYTES, keeps=True)


def encode_documents(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, ids, n_tokens, lossless: the token ids of each text, and whether they decode to it."""

    def make(encoder: TrieEncoder, part: pa.RecordBatch) -> pa.RecordBatch:
        texts = part.column("text").to_pylist()
        ids = encoder.encode_arrays(texts)
        same = [encoder.decode(i) == (t or "") for i, t in zip(ids, texts, strict=True)]
        lengths = np.array([len(i) for i in ids], np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
        columns = [part.column("doc_id"), lists, pa.array(lengths), pa.array(same, pa.bool_())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "n_tokens", "lossless"])

    return _mapped(docs.select("doc_id", "text"), vocabulary_path, make, "doc_id long, ids array<int>, n_tokens long, lossless boolean")


def decode_documents(encoded: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, text: the texts of doc_id, ids; null ids give an empty text."""
    with open(vocabulary_path, "rb") as file:
        shipped = encoded.sparkSession.sparkContext.broadcast(file.read())

    def run(batches):
        encoder = _encoder(shipped.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [encoder.decode(ids or []) for ids in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode, decode again, and keep digests only."""

    def make(encoder: TrieEncoder, part: pa.RecordBatch) -> pa.RecordBatch:
        counts, codes, texts = [], [], []
        for found in encoder.encode_arrays(part.column("text").to_pylist()):
            ids = found.tolist()
            counts.append(len(ids))
            codes.append(hashlib.sha256(",".join(map(encoder.digits.__getitem__, ids)).encode()).hexdigest())
            texts.append(hashlib.sha256(encoder.decode(ids).encode()).hexdigest())
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(codes, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _mapped(docs.select("doc_id", "text"), vocabulary_path, make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

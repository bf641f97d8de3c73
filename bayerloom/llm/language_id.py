"""Language of texts by a linear-chain conditional random field over words.

Every word has a score for each language from its affixes (one to three
characters at either end), its character pairs and triples and, for the
frequent words of the training texts, a lexicon entry; learned transitions tie
neighbouring words together. Forward-backward gives each word's
probabilities, also in text that switches languages, and their mean over the
words is the text's: lang_pred is the largest, score its share.

The field is fitted on a bounded sample: of each language about FIT_TEXTS (at
most twice as many) different labelled rows, drawn by a hash of id and text, and
of each a window of FIT_WORDS words and FIT_BYTES bytes, which is cut out before
anything is sent to the driver; windows of several languages are joined, so that
the transitions see switches.
Rows with crc32(doc_id) mod 5 = 0, and those with null text, lang or id, are never learned from.
Language, source and id play no part in predictions, which read whole texts.

Texts that are null or have no letter are `und` with score 0; so are all texts
if there is nothing to learn from. Ties go to the first language in order. Each
row gives one row; a null id counts as not held out. An empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, staged, word_hashes_and_places

UNKNOWN = "und"
FIT_TEXTS = 200
FIT_WORDS = 150
FIT_BYTES = 8192
BROADCAST_LANGUAGES = 100_000
FOLDS = 5
LEXICON_WORDS = 2000
GRAM_BITS = 17
ROUNDS = 30
RIDGE = 0.02
JOINT_BYTES = 8 << 20
_MASK = np.uint32((1 << GRAM_BITS) - 1)


class WordFeatures:
    """Feature ids of the distinct words of a slice, as one flat list with the word that each belongs to."""

    def __init__(self, lexicon: np.ndarray):
        self.lexicon = lexicon  # sorted word hashes
        self.size = (1 << GRAM_BITS) + len(lexicon) + 1

    def __call__(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(starts)
        framed = lengths + 2
        first = np.cumsum(framed) - framed
        word = np.repeat(np.arange(n), framed)
        place = np.arange(int(framed.sum())) - first[word]
        text = raw[np.clip(starts[word] + place - 1, 0, len(raw) - 1)].astype(np.uint32)
        text[first], text[first + framed - 1] = 1, 2
        codes, owners = [], []
        left = framed[word] - place
        with np.errstate(over="ignore"):
            for width, salt in ((2, 0x9E3779B1), (3, 0x85EBCA6B), (4, 0xC2B2AE35)):
                whole = left >= width
                if width == 4:  # of four, with the border, only the affixes
                    whole &= (place == 0) | (left == 4)
                at = np.flatnonzero(whole)
                code = np.zeros(len(at), np.uint32)
                for k in range(width):
                    code = (code ^ text[at + k]) * np.uint32(0x01000193) + np.uint32(salt)
                codes.append(((code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(3)) & _MASK)
                owners.append(word[at])
        known = np.minimum(np.searchsorted(self.lexicon, hashes), max(len(self.lexicon) - 1, 0))
        found = self.lexicon[known] == hashes if len(self.lexicon) else np.zeros(n, bool)
        codes.append(np.where(found, (1 << GRAM_BITS) + known, self.size - 1).astype(np.uint32))
        owners.append(np.arange(n))
        return np.concatenate(codes).astype(np.int64), np.concatenate(owners)

    def distinct(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word offsets of the texts, each word's distinct number, and the distinct words' features and owners."""
        hashes, offsets, raw, starts, ends = word_hashes_and_places(texts)
        unique, at, number = np.unique(hashes, return_index=True, return_inverse=True)
        codes, owners = self(raw, starts[at], (ends - starts)[at], unique) if len(at) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return offsets, number.ravel(), codes, owners


def word_scores(weights: np.ndarray, codes: np.ndarray, owners: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(owners, weights[codes, k], n) for k in range(weights.shape[1])], axis=1)


class Lattice:
    """Forward-backward of many chains at once, longest first, a step at a time."""

    def __init__(self, scores: np.ndarray, offsets: np.ndarray):
        lengths = np.diff(offsets)
        self.order = np.argsort(-lengths, kind="stable")
        self.begin = offsets[:-1][self.order]
        self.lengths = lengths[self.order]
        self.active = np.searchsorted(-self.lengths, -np.arange(int(lengths.max(initial=0))), side="left")
        self.potential = np.exp(scores - scores.max(axis=1, keepdims=True)) if len(scores) else scores

    def forward(self, move: np.ndarray, start: np.ndarray) -> np.ndarray:
        alpha = np.empty_like(self.potential)
        now = None
        for t, m in enumerate(self.active.tolist()):
            at = self.begin[:m] + t
            now = self.potential[at] * (start if now is None else now[:m] @ move)
            now /= now.sum(axis=1, keepdims=True)
            alpha[at] = now
        return alpha

    def backward(self, alpha: np.ndarray, move: np.ndarray, each=None) -> np.ndarray:
        """Marginal probabilities summed over each chain (in the chains' own order); each(t, at, marginal, beta, later) sees every step."""
        labels = alpha.shape[1]
        total = np.zeros((len(self.order), labels))
        beta = np.ones((len(self.order), labels))
        for t in range(len(self.active) - 1, -1, -1):
            m = int(self.active[t])
            at = self.begin[:m] + t
            marginal = alpha[at] * beta[:m]
            marginal /= marginal.sum(axis=1, keepdims=True)
            total[:m] += marginal
            if each:
                each(t, at, marginal, beta[:m])
            back = (self.potential[at] * beta[:m]) @ move.T
            beta[:m] = back / back.sum(axis=1, keepdims=True)
        out = np.empty_like(total)
        out[self.order] = total
        return out


def _gradient(lattice: Lattice, move: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of every word, and expected counts of every transition."""
    alpha = lattice.forward(move, start)
    marginals, pairs = np.empty_like(alpha), np.zeros_like(move)

    def each(t, at, marginal, beta):
        marginals[at] = marginal
        if t:
            later = lattice.potential[at] * beta
            before = alpha[at - 1]
            mass = ((before @ move) * later).sum(axis=1, keepdims=True)
            pairs[:] += move * (before.T @ (later / mass))

    lattice.backward(alpha, move, each)
    return marginals, pairs


class LanguageField:
    """A fitted field: languages in order, feature weights, transition and start potentials."""

    def __init__(self, languages: list[str], lexicon: np.ndarray):
        self.languages, self.features = languages, WordFeatures(lexicon)
        n = len(languages)
        self.weights, self.move, self.start = np.zeros((self.features.size, n)), np.zeros((n, n)), np.zeros(n)

    def fit(self, texts: list[str], languages: list[str], seed: int = 5, rounds: int = ROUNDS) -> LanguageField:
        rng, n = np.random.default_rng(seed), len(self.languages)
        label = np.array([self.languages.index(x) for x in languages])
        offsets, number, codes, owners = self.features.distinct(pa.array(texts, pa.string()))
        windows = []
        for k in range(len(texts)):
            size = int(offsets[k + 1] - offsets[k])
            if size:
                first = int(offsets[k]) + int(rng.integers(0, max(1, size - FIT_WORDS + 1)))
                windows.append((first, min(FIT_WORDS, size), label[k]))
        rng.shuffle(windows)
        words, gold, bounds, k = [], [], [0], 0
        while k < len(windows):
            joined = windows[k : k + int(rng.integers(1, 4))]
            k += len(joined)
            for first, size, y in joined:
                words.append(number[int(first) : int(first) + int(size)])
                gold.append(np.full(int(size), y))
            bounds.append(bounds[-1] + sum(int(size) for _, size, _ in joined))
        if not words:
            return self
        words, gold, bounds = np.concatenate(words), np.concatenate(gold), np.array(bounds)
        count = int(owners.max()) + 1
        truth = np.eye(n)[gold]
        heads = bounds[:-1]
        inner = np.setdiff1d(np.arange(len(gold)), heads)
        moved = np.zeros((n, n))
        np.add.at(moved, (gold[inner - 1], gold[inner]), 1)
        squares = [np.full(x.shape, 1e-8) for x in (self.weights, self.move, self.start)]
        for _ in range(rounds):
            scores = word_scores(self.weights, codes, owners, count)
            marginals, pairs = _gradient(Lattice(scores[words], bounds), np.exp(self.move), np.exp(self.start))
            error = truth - marginals
            by_word = np.stack([np.bincount(words, error[:, k], count) for k in range(n)], axis=1)
            slopes = [
                np.stack([np.bincount(codes, by_word[owners, k], self.features.size) for k in range(n)], axis=1) - RIDGE * self.weights,
                moved - pairs - self.move,
                error[heads].sum(axis=0) - self.start,
            ]
            for value, slope, square in zip((self.weights, self.move, self.start), slopes, squares, strict=True):
                square += slope**2
                value += 0.3 * slope / np.sqrt(square)
        self.weights = self.weights.astype(np.float32)
        return self

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Word offsets of the texts and the words' scores."""
        offsets, number, codes, owners = self.features.distinct(texts)
        n = int(number.max(initial=-1)) + 1
        return offsets, word_scores(self.weights, codes, owners, n).astype(np.float32)[number]

    def shares(self, scores: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean word probabilities of each text; 0 for one without words."""
        if not len(scores):
            return np.zeros((len(offsets) - 1, len(self.languages)))
        lattice = Lattice(scores, offsets)
        move = np.exp(self.move).astype(np.float32)
        total = lattice.backward(lattice.forward(move, np.exp(self.start).astype(np.float32)), move)
        return total / np.maximum(np.diff(offsets), 1)[:, None]

    def predict(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        parts = [self.scores(part.column(0)) for part in slices(pa.RecordBatch.from_arrays([texts], ["text"]), "text")]
        sizes = np.concatenate([np.diff(o) for o, _ in parts])
        shares = self.shares(np.concatenate([s for _, s in parts]), np.concatenate([[0], np.cumsum(sizes)]))
        letters = pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False).to_numpy(zero_copy_only=False) & (sizes > 0)
        best = shares.argmax(axis=1)
        score = np.clip(shares[np.arange(len(best)), best], 0, 1)
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)], [float(s) if ok else 0.0 for s, ok in zip(score, letters, strict=True)]


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def drawn(docs: DataFrame, most: int = FIT_TEXTS) -> DataFrame:
    """(doc_id, lang, text): of each language about `most` different rows that may be learned from, at most twice as many, and of their texts a window.

    Rows pass by their hash first, so few are compared or shuffled; copies of a
    row, which pass together, are folded in the tasks that read them.
    """
    rows = docs.where(F.col("doc_id").isNotNull() & ~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    space = 1 << 40
    limits = staged(rows.groupBy("lang").agg((F.lit(float(space * most)) / F.count("*")).alias("limit")), "languages")
    few = limits.count() <= BROADCAST_LANGUAGES
    joined = rows.join(F.broadcast(limits) if few else limits, "lang")
    passed = joined.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(space)) < F.col("limit")).select("doc_id", "lang", "text").distinct()
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", "text"), "doc_id", "text")
    kept = passed.withColumn("place", F.row_number().over(order)).where(F.col("place") <= 2 * most).select("doc_id", "lang", "text", F.xxhash64("doc_id", "text").alias("hash"))

    def window(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, turn: int) -> str:
        if not len(starts):
            return ""
        first = turn % max(1, len(starts) - FIT_WORDS + 1)
        starts, ends = starts[first : first + FIT_WORDS], ends[first : first + FIT_WORDS]
        whole = max(1, int(np.searchsorted(ends, starts[0] + FIT_BYTES, side="right")))
        return raw[starts[0] : min(ends[whole - 1], starts[0] + FIT_BYTES)].tobytes().decode("utf-8", "ignore")

    def cut(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                _, offsets, raw, starts, ends = word_hashes_and_places(part.column("text"))
                texts = [window(raw, starts[a:b], ends[a:b], h & (1 << 40) - 1) for a, b, h in zip(offsets[:-1].tolist(), offsets[1:].tolist(), part.column("hash").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), pa.array(texts, pa.string())], ["doc_id", "lang", "text"])

    return kept.mapInArrow(cut, "doc_id long, lang string, text string")


def fit(docs: DataFrame, most: int = FIT_TEXTS) -> LanguageField | None:
    """A field from about `most` rows of each language, or None if there is nothing to learn from."""
    sample = sorted(tuple(r) for r in drawn(docs, most).collect())
    if not sample:
        return None
    texts, languages = [r[2] for r in sample], [r[1] for r in sample]
    hashes = word_hashes_and_places(pa.array(texts, pa.string()))[0]
    unique, n = np.unique(hashes, return_counts=True)
    lexicon = np.sort(unique[np.argsort(-n, kind="stable")[:LEXICON_WORDS]])
    return LanguageField(sorted(set(languages)), lexicon).fit(texts, languages)


def identify_languages(docs: DataFrame, field: LanguageField | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs (doc_id, text, lang)."""
    field = field or fit(docs)
    shipped = docs.sparkSession.sparkContext.broadcast(field)
    schema = "doc_id long, held_out boolean, lang_pred string, score double"

    def run(batches):
        field = shipped.value
        for batch in batches:
            for part in slices(batch, "text", JOINT_BYTES):  # so many texts step through the lattice together
                texts = part.column("text")
                names, scores = field.predict(texts) if field else ([UNKNOWN] * len(texts), [0.0] * len(texts))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, schema)

"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Words and word pairs are hashed into BUCKETS buckets. The target model counts
those of good labelled documents (at most FIT_DOCUMENTS, those of smallest id
hash); the raw model counts those of all documents. A document's log weight
is the sum over its n-grams of log(target / raw), each rounded to DIGITS, as is
the sum, which so is the same in whatever order it is formed. Adding Gumbel noise, seeded by
the text, and keeping the k largest keys samples k documents without
replacement in proportion to their weights. k is the document count times the
share of good ones among the labelled.

Noise and weight belong to the text, so copies have equal keys and stay or go
together: the k-th largest key is the cut, and all that reach it stay. The cut
is found by radix selection over the keys' bits, four counts of at most 65,536
groups, not by a sort. Texts without words, null ones too, have weight 0.
Without labels or any good document every row is kept, with weight 0; so does
an empty table give an empty result. Only doc_id and text are read, but
`kept_documents` keeps all columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import let_go, map_slices, mix64, staged, word_hashes

BUCKETS = 1 << 14
FIT_DOCUMENTS = 20_000
SMOOTHING = 8.0
SEED = 11
REPEAT = np.uint64(1)
DIGITS = 6
NOISE_DIGITS = 9


def _bucketed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all texts, and the text that each is of."""
    hashes, offsets = word_hashes(texts, marks=True)
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    if not len(hashes):
        return np.zeros(0, np.int64), owner
    with np.errstate(over="ignore"):
        pairs = mix64(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:])
    pairs[hashes[:-1] == hashes[1:]] = REPEAT
    inside = owner[:-1] == owner[1:]
    grams = np.concatenate([hashes, pairs[inside]])
    return (grams & np.uint64(BUCKETS - 1)).astype(np.int64), np.concatenate([owner, owner[:-1][inside]])


def ngram_counts(docs: DataFrame, target_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket counts over the target documents and over all documents."""
    shipped = docs.sparkSession.sparkContext.broadcast(np.sort(target_ids))

    def run(batches):
        from .common import slices

        let_go()
        ids = shipped.value
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                buckets, owner = _bucketed(part.column("text"))
                keys = part.column("doc_id").fill_null(-(1 << 62)).to_numpy()
                at = np.minimum(np.searchsorted(ids, keys), max(len(ids) - 1, 0))
                good = ids[at] == keys if len(ids) else np.zeros(len(keys), bool)
                raw += np.bincount(buckets, minlength=BUCKETS)
                target += np.bincount(buckets[good[owner]], minlength=BUCKETS)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(target[some]), pa.array(raw[some])], ["bucket", "target", "raw"])

    counted = docs.select("doc_id", "text").mapInArrow(run, "bucket long, target long, raw long")
    rows = counted.groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw")).toPandas()
    target, raw = np.zeros(BUCKETS), np.zeros(BUCKETS)
    target[rows["bucket"]], raw[rows["bucket"]] = rows["target"], rows["raw"]
    return target, raw


def model_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log of target over raw probability of each bucket, drawn towards 0 where few n-grams are expected."""
    expected = raw * (target.sum() / raw.sum())
    return np.round(np.log((target + SMOOTHING) / (expected + SMOOTHING)), DIGITS)


def kth_largest(keys: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest value of a long column, by counting 16 bits of it at a time; None if there are not k."""
    prefix, left = 0, k
    for shift in (48, 32, 16, 0):
        # the sign bit is flipped, so that the digits sort as the values do
        flipped = F.col(column).bitwiseXOR(F.lit(-(1 << 63)))
        digit = F.shiftrightunsigned(flipped, shift).bitwiseAND(F.lit(0xFFFF))
        same = keys if shift == 48 else keys.where(F.shiftrightunsigned(flipped, shift + 16) == F.lit(prefix))
        counts = sorted(((r["digit"], r["n"]) for r in same.groupBy(digit.alias("digit")).agg(F.count("*").alias("n")).collect()), reverse=True)
        for value, n in counts:
            if n >= left:
                prefix = prefix << 16 | value
                break
            left -= n
        else:
            return None
    return prefix - (1 << 63)


def sampling_keys(docs: DataFrame, log_ratio: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, log_weight, sampling_key, and the key's bits as a sortable long, of each row."""
    shipped = docs.sparkSession.sparkContext.broadcast(log_ratio)

    def work():
        ratio = shipped.value

        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            weight, key = weights(part.column("text"), ratio, seed)
            bits = key.view(np.int64)
            bits = np.where(bits < 0, bits ^ np.int64((1 << 63) - 1), bits)
            return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(weight), pa.array(key), pa.array(bits)], ["doc_id", "log_weight", "sampling_key", "key_bits"])

        return step

    return map_slices(docs.select("doc_id", "text"), "text", work, "doc_id long, log_weight double, sampling_key double, key_bits long")


def weights(texts: pa.Array, log_ratio: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Log weights and Gumbel keys of texts."""
    buckets, owner = _bucketed(texts)
    n = len(texts)
    weight = np.round(np.bincount(owner, log_ratio[buckets], n).astype(np.float64) if len(buckets) else np.zeros(n), DIGITS)
    with np.errstate(over="ignore"):
        sums = np.zeros(n, np.uint64)
        np.add.at(sums, owner, mix64(buckets.astype(np.uint64) + np.uint64(1)))
        uniform = (mix64(sums + np.uint64(seed)) >> np.uint64(11)).astype(np.float64)
    noise = np.round(-np.log(-np.log((uniform + 0.5) * 2.0**-53)), NOISE_DIGITS)
    return weight, weight + noise + 0.0


class Resampler:
    """The fitted models and, for k of the documents, the key that a document must reach."""

    def __init__(self, docs: DataFrame, labels: DataFrame, most: int = FIT_DOCUMENTS, seed: int = SEED):
        self.seed = seed
        marked = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
        n_good, n_marked, n_target = marked.agg(F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)), F.count("*"), F.coalesce(F.sum(F.when(good, 1)), F.lit(0))).first()
        # hashes below this hold the `most` smallest ones, so that tasks send only about as many ids in all
        below = -(1 << 63) + (1 << 64) * min(n_target, most + most // 5 + 2000) // max(n_target, 1)
        chosen = marked.where(good & (F.xxhash64("doc_id") < F.lit(min(below, (1 << 63) - 1)))) if n_target > most else marked.where(good)
        chosen = chosen.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        ids = np.unique(np.array([r[0] for r in chosen.collect()], dtype=np.int64))
        self.log_ratio = np.zeros(BUCKETS)
        if len(ids):
            target, raw = ngram_counts(docs, ids)
            if target.any():
                self.log_ratio = model_ratio(target, raw)
        self.keys = staged(sampling_keys(docs, self.log_ratio, seed), "keys")
        n = self.keys.count()
        k = n if not self.log_ratio.any() else round(n * n_good / n_marked)
        cut = kth_largest(self.keys, "key_bits", k) if 0 < k <= n else None
        self.cut = -(1 << 63) if cut is None else cut


def resample(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, log_weight, sampling_key, keep for each row of docs."""
    fitted = Resampler(docs, labels, **options)
    return fitted.keys.select("doc_id", "log_weight", "sampling_key", (F.col("key_bits") >= fitted.cut).alias("keep"))


def kept_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that the sample holds, with all their columns."""
    fitted = Resampler(docs, labels, **options)
    shipped = docs.sparkSession.sparkContext.broadcast(fitted.log_ratio)
    cut, seed = fitted.cut, fitted.seed

    def work():
        ratio = shipped.value

        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            bits = weights(part.column("text"), ratio, seed)[1].view(np.int64)
            return part.filter(pa.array(np.where(bits < 0, bits ^ np.int64((1 << 63) - 1), bits) >= cut))

        return step

    return map_slices(docs, "text", work, docs.schema)

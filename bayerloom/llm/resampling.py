"""Importance resampling towards a target set: array-scored weights, then exact selection by score histogram.

Features of a text are its words (A-Z lower-cased, runs of ASCII letters and
digits and of what is not ASCII) and pairs of consecutive words joined by one
space, repeats counted. A feature's bucket is the unsigned crc32 of its UTF-8
bytes modulo BUCKETS. Both tables' features are counted by bucket in each task
and summed by Spark; of the two count arrays comes one array of whole gains,
floor(1000 ln((t+1)(S+BUCKETS) / ((s+1)(T+BUCKETS)))). A document's weight is
the floored mean gain of its features, its score the weight plus Gumbel noise of
a hash of its id, floored too.

Of the N documents with at least LEAST_WORDS words the floor(N * share / 100)
highest scores are drawn, ties to the smaller doc_id. No rows are sorted for
that: gains and noise are bounded by the logarithms of counts, so there are only
some ten thousands of whole scores however large the table is. Their histogram,
summed from the top, gives each score's rank offset and the score at which the
draw ends; only documents from there on are shuffled, equal rows folded into
one, and numbered by doc_id within their score.

Null texts have no words. A null doc_id is hashed as the empty string and comes
last among ties. Rows that are alike in all that counts get successive ranks.
Without features the weight is 0; an empty target table counts 0 everywhere; an
empty table gives an empty result. Only doc_id and text of docs and text of
target are read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import let_go, map_slices, slices, staged

BUCKETS = 10_000
LEAST_WORDS = 20
SHARE = 25
SEED = 7
UNIT = 1000
RUN = 4096  # equal rows that one row of the expansion stands for
_LONGEST = 64  # bytes of words whose crc32 shifts are tabled

#: Bytes of words as they are, capitals lowered, all others to a space.
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _shift_tables() -> np.ndarray:
    """[n][k][b]: what byte k = b of a crc32 becomes once n zero bytes follow, so that crc(A B) = shifted crc(A) ^ crc(B)."""
    one = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
    tables = np.zeros((_LONGEST + 1, 4, 256), np.uint32)
    for k in range(4):
        tables[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(1, _LONGEST + 1):
        before = tables[n - 1]
        tables[n] = (before >> np.uint32(8)) ^ one[before & np.uint32(255)]
    return tables


_SHIFTS = _shift_tables()


def _followed(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """crc32 values after zero bytes of the given numbers follow, without those bytes' own part."""
    out = np.zeros(len(crc), np.uint32)
    short = np.minimum(lengths, _LONGEST)
    for k in range(4):
        out ^= _SHIFTS[short, k, (crc >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features of the texts, the text that each is of, and each text's number of words."""
    words, count = [], np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts.to_pylist()):
        if text:
            own = text.encode().translate(_TO_WORDS).split()
            count[k] = len(own)
            words += own
    n = len(words)
    owner = np.repeat(np.arange(len(texts)), count)
    if not n:
        return np.zeros(0, np.int64), owner, count
    single = np.fromiter(map(zlib.crc32, words), np.uint32, n)
    length = np.fromiter(map(len, words), np.int64, n)
    before = np.flatnonzero(owner[:-1] == owner[1:])  # the first words of pairs
    spaced = _followed(single[before], np.ones(len(before), np.int64)) ^ np.uint32(zlib.crc32(b" "))
    pairs = _followed(spaced, length[before + 1]) ^ single[before + 1]
    for at in np.flatnonzero(length[before + 1] > _LONGEST).tolist():
        k = before[at]
        pairs[at] = zlib.crc32(words[k] + b" " + words[k + 1])
    return np.concatenate([single, pairs]).astype(np.int64) % BUCKETS, np.concatenate([owner, owner[before]]), count


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """The number of features of all texts in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                total += np.bincount(features(part.column("text"))[0], minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for bucket, n in texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Each bucket's whole gain."""
    t_all, s_all = float(target.sum() + BUCKETS), float(raw.sum() + BUCKETS)
    return np.array([math.floor(UNIT * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for t, s in zip(target.tolist(), raw.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-UNIT * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of each row."""
    shipped = docs.sparkSession.sparkContext.broadcast(gain)

    def work():
        held = shipped.value

        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            buckets, owner, n_words = features(part.column("text"))
            n = np.bincount(owner, minlength=part.num_rows)
            total = np.zeros(part.num_rows, np.int64)
            np.add.at(total, owner, held[buckets])
            weight = total // np.maximum(n, 1)
            score = weight + np.array([noise(d, seed) for d in part.column("doc_id").to_pylist()], np.int64)
            return pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, pa.int64()) for c in (n_words, n, weight, score))], ["doc_id", "n_words", "n_features", "weight", "score"])

        return step

    return map_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text", work, "doc_id long, n_words long, n_features long, weight long, score long")


def draw(rows: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score, rank of scored rows; rank is null where a row isn't drawn."""
    spark = rows.sparkSession
    able = F.col("n_words") >= least_words
    # whole scores lie within the logarithms of the counts, so this is some ten thousands of rows at any size
    histogram = sorted(((r["score"], r["n"]) for r in rows.where(able).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    most = share * sum(n for _, n in histogram) // 100
    offsets, above = [], 0
    for score, n in histogram:
        if above >= most:
            break
        offsets.append((score, above))
        above += n
    columns = ("doc_id", "n_features", "weight", "score")
    if not offsets:
        return rows.select(*columns, F.lit(None).cast("long").alias("rank"))
    surviving = able & (F.col("score") >= offsets[-1][0])
    # copies of a row are folded before the shuffle, so an id that occurs very often is one row of its score
    folded = rows.where(surviving).groupBy(*columns).agg(F.count("*").alias("copies"))
    within = Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "n_features")
    first = F.sum("copies").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("copies")
    placed = folded.withColumn("first", first).join(F.broadcast(spark.createDataFrame(offsets, "score long, above long")), "score")
    runs = placed.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {RUN}"))))
    spread = runs.repartition("doc_id", "run")
    each = spread.withColumn("copy", F.explode(F.sequence(F.col("run") * RUN, F.least(F.col("copies"), (F.col("run") + 1) * RUN) - 1)))
    rank = F.col("above") + F.col("first") + F.col("copy") + 1
    drawn = each.select(*columns, F.when(rank <= most, rank).alias("rank"))
    return rows.where(~surviving).select(*columns, F.lit(None).cast("long").alias("rank")).unionByName(drawn)


def resample_towards(docs: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of each row of docs, share percent of which are drawn after the texts of target."""
    gain = gains(bucket_counts(target), bucket_counts(docs))
    return draw(staged(scored(docs, gain, seed), "scored"), share, least_words)


def drawn_documents(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of docs that are drawn, with all their columns; rows of a repeated doc_id stay where any of them is drawn."""
    ranks = resample_towards(docs, target, **options)
    drawn = ranks.where(F.col("rank").isNotNull()).select(F.col("doc_id").alias("drawn_id")).distinct()
    return docs.join(drawn, docs["doc_id"].cast("long").eqNullSafe(drawn["drawn_id"]), "left_semi")

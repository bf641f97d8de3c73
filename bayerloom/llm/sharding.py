"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0 to n - 1 in the order of (doc_id, text checksum, size). A
keyed Feistel network permutes the numbers of the smallest power of two that
holds n; a number that lands at n or beyond is walked on until it falls below.
Position p of the shuffle is slot p div shards of shard p mod shards: shard
counts differ by one at most (law `rows`), slots have no gaps, and both follow
from the row number alone, forwards and backwards.

The texts are not shuffled: only id, size and checksum are range-partitioned.
Numbers need the row count of each partition, as many values on the driver as
there are shuffle partitions. Rows that agree in all three columns are alike,
so it doesn't matter which of them takes which number.

Null texts have size 16 and checksum 0; null ids come first. Repeated rows have
numbers of their own. An empty table gives an empty result. Other columns are
not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, staged

ROUNDS = 6
ROW_OVERHEAD = 16


class FeistelPermutation:
    """A keyed bijection of 0 .. n - 1, computable for any number by itself."""

    def __init__(self, n: int, seed: int = 0, rounds: int = ROUNDS):
        bits = max(2, (max(n, 1) - 1).bit_length())
        self.n, self.low, self.high = n, bits // 2, bits - bits // 2
        with np.errstate(over="ignore"):
            self.keys = mix64(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))

    def _once(self, x: np.ndarray, forward: bool) -> np.ndarray:
        """One pass over the network; the halves, of `high` and `low` bits, take turns to be changed."""
        low_bits, low_mask, high_mask = np.uint64(self.low), np.uint64((1 << self.low) - 1), np.uint64((1 << self.high) - 1)
        left, right = x >> low_bits, x & low_mask
        with np.errstate(over="ignore"):
            turns = list(enumerate(self.keys))
            for k, key in turns if forward else reversed(turns):
                if k % 2 == 0:
                    left = left ^ (mix64(right ^ key) & high_mask)
                else:
                    right = right ^ (mix64(left ^ key) & low_mask)
        return left << low_bits | right

    def _walk(self, x: np.ndarray, forward: bool) -> np.ndarray:
        out = self._once(np.asarray(x, dtype=np.uint64), forward)
        while (beyond := out >= np.uint64(self.n)).any():
            out[beyond] = self._once(out[beyond], forward)
        return out.astype(np.int64)

    def position(self, row: np.ndarray) -> np.ndarray:
        return self._walk(row, True)

    def row(self, position: np.ndarray) -> np.ndarray:
        return self._walk(position, False)


def numbered(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """rows with `row_number` 0 .. n - 1 in the given order, and n."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    within = (1 << 33) - 1  # the low bits of monotonically_increasing_id count the rows of a partition
    placed = ordered.select("*", F.monotonically_increasing_id().alias("__id"))
    placed = staged(placed.select(*rows.columns, F.shiftright("__id", 33).alias("__part"), F.col("__id").bitwiseAND(F.lit(within)).alias("__at")), "numbered")
    counts = {r["__part"]: r["n"] for r in placed.groupBy("__part").agg(F.count("*").alias("n")).collect()}
    starts, total = [], 0
    for part in sorted(counts):
        starts.append((part, total))
        total += counts[part]
    offsets = spark.createDataFrame(starts, "__part long, __start long")
    return placed.join(F.broadcast(offsets), "__part").select(*rows.columns, (F.col("__start") + F.col("__at")).alias("row_number")), total


def shard_documents(docs: DataFrame, shards: int = 40, seed: int = 20) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + F.lit(ROW_OVERHEAD)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows, n = numbered(rows, ["doc_id", "text_crc32", "size"])
    permutation = FeistelPermutation(n, seed)

    @F.pandas_udf("long")
    def position(row: pd.Series) -> pd.Series:
        return pd.Series(permutation.position(row.to_numpy()))

    placed = rows.withColumn("__position", position("row_number"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.pmod("__position", F.lit(shards)).cast("int").alias("shard"),
        F.expr(f"__position div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )

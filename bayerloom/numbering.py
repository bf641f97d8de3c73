"""Global order without one task that sees all rows: ranges, counts of ranges, and prefix sums of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .staging import scratch_folder

RANGE_ROWS = 1 << 20
_IN_RANGE = (1 << 33) - 1  # monotonically_increasing_id: the partition above these bits, the row's place in it below


def in_ranges(rows: DataFrame, column: str, range_rows: int = RANGE_ROWS) -> tuple[DataFrame, list[tuple]]:
    """The rows with `part` and `at`, the range of `column` that a row is in and its place there from 0; and what is known of ranges.

    One shuffle sorts the rows into ranges of about range_rows; they are written
    to the shared folder, so that the ranges hold for all that is done with them.
    Of each range that has rows, in order: (part, rows before it, rows, least, greatest).
    Equal values are in one range.
    """
    spark = rows.sparkSession
    path = scratch_folder(spark)
    n = rows.count()
    sorted_rows = rows.repartitionByRange(max(1, -(-n // range_rows)), column).sortWithinPartitions(column)
    sorted_rows.withColumn("__place", F.monotonically_increasing_id()).write.parquet(path)
    staged = spark.read.schema(StructType([*rows.schema.fields, StructField("__place", LongType())])).parquet(path)
    placed = staged.select(*rows.columns, F.shiftright("__place", 33).alias("part"), F.col("__place").bitwiseAND(F.lit(_IN_RANGE)).alias("at"))
    ranges, before = [], 0
    for part, count, least, most in sorted(map(tuple, placed.groupBy("part").agg(F.count("*"), F.min(column), F.max(column)).collect())):
        ranges.append((part, before, count, least, most))
        before += count
    return placed, ranges


def numbered(rows: DataFrame, column: str, name: str, range_rows: int = RANGE_ROWS) -> tuple[DataFrame, int]:
    """The rows with their number in the order of a column, from 0, as a long; and how many there are."""
    placed, ranges = in_ranges(rows, column, range_rows)
    befores = rows.sparkSession.createDataFrame([r[:2] for r in ranges], "part long, __before long")
    numbers = placed.join(F.broadcast(befores), "part").select(*rows.columns, (F.col("__before") + F.col("at")).alias(name))
    return numbers, sum(r[2] for r in ranges)


def with_previous(rows: DataFrame, column: str, name: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The rows with the value that comes before theirs in the order of a column; null for the first."""
    placed, ranges = in_ranges(rows, column, range_rows)
    kind = rows.schema[column].dataType.simpleString()
    lasts = [(after[0], before[4]) for before, after in zip(ranges, ranges[1:], strict=False)]
    within = F.lag(column).over(Window.partitionBy("part").orderBy("at"))
    joined = placed.withColumn("__within", within).join(F.broadcast(rows.sparkSession.createDataFrame(lasts, f"part long, __last {kind}")), "part", "left")
    return joined.select(*rows.columns, F.when(F.col("at") == 0, F.col("__last")).otherwise(F.col("__within")).alias(name))


def placed_sizes(rows: DataFrame, column: str, size: str, range_rows: int = RANGE_ROWS) -> tuple[DataFrame, int, int]:
    """The rows with `number`, from 0 in the order of a column, and `place`, the sum of the sizes before; how many there are, and the whole sum."""
    placed, ranges = in_ranges(rows, column, range_rows)
    sums = dict(map(tuple, placed.groupBy("part").agg(F.sum(size)).collect()))
    befores, total = [], 0
    for part, before, *_ in ranges:
        befores.append((part, before, total))
        total += sums[part]
    within = F.sum(size).over(Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)) - F.col(size)
    joined = placed.withColumn("__within", within).join(F.broadcast(rows.sparkSession.createDataFrame(befores, "part long, __before long, __place long")), "part")
    return joined.select(*rows.columns, (F.col("__before") + F.col("at")).alias("number"), (F.col("__place") + F.col("__within")).alias("place")), sum(r[2] for r in ranges), total

"""Frames made of the driver's tables: 20 x 10 pixels of 12 bits from `events`, wide ones from `lineitem`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH, HEIGHT = 20, 10

#: The same frames as SQL, for the oracle.
PX = """px as (
  select event_id // 200 as frame_no, cast((event_id % 200) // 20 as integer) as y, cast(event_id % 20 as integer) as x,
         cast((event_id * 7919 + user_id * 104729 + cast(round(value * 100) as bigint)) % 4096 as integer) as v
  from events)"""
P8 = PX + ", p8 as (select frame_no, y, x, v // 16 as v from px)"


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    value = (F.col("event_id") * 7919 + F.col("user_id") * 104729 + F.round(F.col("value") * 100).cast("long")) % 4096
    return events.select(
        F.expr("event_id div 200").alias("frame_no"), F.expr("cast((event_id % 200) div 20 as int)").alias("y"), F.expr("cast(event_id % 20 as int)").alias("x"), value.cast("int").alias("v")
    )


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longer frames for benchmarks: 256 orders each, 64 pixels a row."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    from pyspark.sql import Window

    order = Window.partitionBy(F.expr("l_orderkey div 256")).orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    at = F.row_number().over(order) - 1
    flat = lines.select(F.expr("l_orderkey div 256").alias("frame_no"), at.alias("i"), (F.round(F.col("l_extendedprice") * 100).cast("long") % 4096).cast("int").alias("v"))
    return flat.select("frame_no", F.expr("cast(i div 64 as int)").alias("y"), F.expr("cast(i % 64 as int)").alias("x"), "v")


def cube_text(n: int = 5) -> str:
    """A grid that turns the channels: (r, g, b) gives (g, b, r)."""
    lines = [f"LUT_3D_SIZE {n}"]
    for k in range(n**3):
        r, g, b = k % n, k // n % n, k // n**2
        lines.append(" ".join(f"{c / (n - 1):.6f}" for c in (g, b, r)))
    return "\n".join(lines)


def half_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixture as half frames (half_no, y, x, v) with headers in their first three bytes."""
    from ..operators import split_rows

    halves = split_rows(px(spark, sf_dir)).withColumnRenamed("frame_no", "half_no")
    counter, buffer = F.col("half_no") % 256, (F.expr("half_no div 2") + 1) % 4
    marker = F.when(F.col("half_no") % 2 == 1, F.lit(0xAA)).otherwise(F.lit(0x55))
    head = F.when(F.col("x") == 0, counter * 16 + F.expr("((half_no div 2) + 1) % 4 div 16")).otherwise(buffer % 16 * 256 + marker)
    return halves.withColumn("v", F.when((F.col("y") == 0) & (F.col("x") < 2), head).otherwise(F.col("v")).cast("int"))

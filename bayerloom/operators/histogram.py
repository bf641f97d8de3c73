"""12-bit histograms, and the range of bins worth plotting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..numbering import RANGE_ROWS

BINS = 4096


def histogram(px: DataFrame, dense: bool = False) -> DataFrame:
    """(frame_no, bin, n); dense gives exactly the 4096 bins of every frame.

    For that the bins that are there are put in order within their frame, and
    each brings those without pixels before it; these are neither shuffled nor
    held. Frames are dealt to tasks of some RANGE_ROWS pixels.
    """
    if not dense:
        return px.groupBy("frame_no", F.col("v").alias("bin")).agg(F.count("*").alias("n"))
    bins = F.when(F.col("v").between(0, BINS - 1), F.col("v")).otherwise(-1).cast("int")  # -1: what is in no bin; the frame counts
    dealt = px.select("frame_no", bins.alias("bin")).repartition(max(1, -(-px.count() // RANGE_ROWS)), "frame_no")
    counted = dealt.groupBy("frame_no", "bin").agg(F.count("*").alias("n"))
    order = Window.partitionBy("frame_no").orderBy("bin")
    low, high = F.coalesce(F.lag("bin").over(order) + 1, F.lit(0)), F.when(F.lead("bin").over(order).isNull(), F.lit(BINS - 1)).otherwise(F.col("bin"))
    runs = counted.select("frame_no", "n", F.col("bin").alias("own"), low.alias("low"), high.alias("high")).where("low <= high")
    filled = runs.select("frame_no", "n", "own", F.explode(F.sequence("low", "high")).alias("bin"))
    return filled.select("frame_no", "bin", F.when(F.col("bin") == F.col("own"), F.col("n")).otherwise(F.lit(0)).cast("long").alias("n"))


def plot_trim(counts: DataFrame) -> DataFrame:
    """(frame_no, first_bin, last_bin, peak): the bins that reach 1/2000 of the fullest, from the first to the last."""
    peak = F.max("n").over(Window.partitionBy("frame_no"))
    high = counts.withColumn("peak", peak).where(F.expr("n >= peak div 2000"))
    return high.groupBy("frame_no").agg(F.min("bin").alias("first_bin"), F.max("bin").alias("last_bin"), F.first("peak").alias("peak"))

"""Mean and variance over windows of n successive frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..numbering import numbered


def count_windows(frame_numbers: DataFrame, n: int) -> DataFrame:
    """(frame_no, window): full windows of n frames that are there, in order; an unfinished last one is left out."""
    at, count = numbered(frame_numbers.select("frame_no").distinct(), "frame_no", "at")
    return at.where(F.col("at") < count // n * n).select("frame_no", F.expr(f"at div {n}").cast("long").alias("window"))


def average(px: DataFrame, n: int, std: bool = False, dense: bool = False) -> DataFrame:
    """(frame_no, y, x, v), and with std also var, the population variance.

    dense: frame numbers have no gaps and start at 0, so that windows follow
    from the number alone and only windows that are full in every pixel count.
    """
    if dense:
        placed = px.withColumn("window", F.expr(f"frame_no div {n}").cast("long"))
    else:
        placed = px.join(count_windows(px, n), "frame_no")
    values = [F.avg("v").alias("v")] + ([F.var_pop("v").alias("var")] if std else []) + [F.count("*").alias("n")]
    out = placed.groupBy("window", "y", "x").agg(*values).where(F.col("n") == n)
    return out.select(F.col("window").alias("frame_no"), "y", "x", "v", *(["var"] if std else []))

"""Bit depth conversion: one projection each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bit_depth(px: DataFrame, depth: int, to: int = 8) -> DataFrame:
    """Samples of `depth` bits to `to` bits: the top 8 for 8; to 16 the value is kept, not scaled."""
    if to == depth or to == 16 and depth < 16:
        return px
    if to != 8 or depth < 8:
        raise ValueError(f"samples of {depth} bits can't become {to} bits")
    return px.withColumn("v", F.expr(f"cast(v div {1 << (depth - 8)} as int)"))


def fp32_to_u16(px: DataFrame, multiplier: float = 1.0) -> DataFrame:
    """Scale, round half away from zero, and saturate to 0 .. 65535."""
    scaled = F.round(F.col("v") * F.lit(float(multiplier)))
    return px.withColumn("v", F.least(F.greatest(scaled, F.lit(0.0)), F.lit(65535.0)).cast("int"))

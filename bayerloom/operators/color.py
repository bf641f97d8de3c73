"""Pedestal and gamma in hue, saturation and value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def color_voodoo(rgb: DataFrame, pedestal: int = 8, s_gamma: float = 1.0, v_gamma: float = 1.0) -> DataFrame:
    """Remove the pedestal, raise saturation and value to their gammas, and go back to 0 .. 255.

    A channel c is value x (1 - saturation x t) with t = (max - c) / (max - min),
    which hue alone decides; so t stays while value and saturation change.
    """
    if not (0 <= pedestal <= 255 and 0 <= s_gamma <= 100 and 0 <= v_gamma <= 100):
        raise ValueError("pedestal must be 0 to 255, gammas 0 to 100")

    def cleared(name: str) -> Column:
        level = (F.col(name) - F.lit(float(pedestal))) / F.lit(256.0 - pedestal)
        return F.least(F.greatest(level, F.lit(0.0)), F.lit(1.0)).alias(name)

    base = rgb.select("frame_no", "y", "x", *[cleared(c) for c in "rgb"])
    base = base.withColumns({"hi": F.greatest("r", "g", "b"), "lo": F.least("r", "g", "b")})
    span = F.col("hi") - F.col("lo")
    base = base.withColumns({"span": span, "sat": F.when(F.col("hi") > 0, span / F.col("hi")).otherwise(0.0)})

    def graded(name: str) -> Column:
        t = F.when(F.col("span") > 0, (F.col("hi") - F.col(name)) / F.col("span")).otherwise(0.0)
        level = F.pow("hi", F.lit(float(v_gamma))) * (1 - F.pow("sat", F.lit(float(s_gamma))) * t) * 256
        return F.least(F.greatest(F.floor(F.round(level, 6)), F.lit(0)), F.lit(255)).cast("int").alias(name)

    return base.select("frame_no", "y", "x", *[graded(c) for c in "rgb"])

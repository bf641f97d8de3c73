"""Dark-frame subtraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PEDESTAL = 128
#: A plane of so many pixels (some 100 MB as rows) is still broadcast.
BROADCAST_PIXELS = 1 << 22


def darkframe_subtract(px: DataFrame, dark: DataFrame, pixels: int | None = None) -> DataFrame:
    """v + pedestal - dark, rounded half away from zero and clamped to 12 bits; dark: (y, x, dark).

    `pixels`: width x height of the plane, where known; small planes are
    broadcast, others joined by shuffle (or as Spark decides at run time).
    """
    plane = F.broadcast(dark) if pixels is not None and pixels <= BROADCAST_PIXELS else dark
    level = F.round(F.col("v") + F.lit(PEDESTAL) - F.round("dark", 6))
    return px.join(plane, ["y", "x"]).select("frame_no", "y", "x", F.least(F.greatest(level, F.lit(0.0)), F.lit(4095.0)).cast("int").alias("v"))

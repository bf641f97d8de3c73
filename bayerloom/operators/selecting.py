"""Frame and column selection: limits, loops, ports, channel order, gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frames import chosen
from ..numbering import with_previous


def number_of_frames(frames: DataFrame, n: int) -> DataFrame:
    """The frames numbered below n; 0 means all. Others aren't read where the source can tell."""
    return chosen(frames, 0, n) if n else frames


def internal_loop(frames: DataFrame, times: int, count: int) -> DataFrame:
    """The `count` frames 0 .. count - 1 repeated, with numbers that go on; a projection, nothing is shuffled."""
    rounds = F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("__round")
    return frames.select("*", rounds).withColumn("frame_no", (F.col("frame_no") + F.col("__round") * F.lit(count)).cast("long")).drop("__round")


def split(ports: DataFrame, elements: list[str], element: int) -> DataFrame:
    """One of several outputs that share a pixel."""
    if not 0 <= element < len(elements):
        raise IndexError(f"there are {len(elements)} outputs, none has number {element}")
    return ports.select("frame_no", "y", "x", F.col(elements[element]).alias("v"))


def swap_red_blue(rgb: DataFrame) -> DataFrame:
    return rgb.select("frame_no", "y", "x", F.col("b").alias("r"), "g", F.col("r").alias("b"))


def sequence_gaps(frame_numbers: DataFrame) -> DataFrame:
    """(after_frame, missing) wherever numbers are skipped; numbers alone are ordered, in ranges."""
    pairs = with_previous(frame_numbers.select("frame_no").distinct(), "frame_no", "after_frame")
    return pairs.where(F.col("frame_no") - F.col("after_frame") > 1).select("after_frame", (F.col("frame_no") - F.col("after_frame") - 1).alias("missing"))

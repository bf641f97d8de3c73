"""12-bit packing (most significant bit first, two pixels in three bytes) as Spark expressions and in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unpack12(packed: np.ndarray) -> np.ndarray:
    """Samples of packed bytes; an unfinished pair at the end counts as far as it has whole samples."""
    n = len(packed) * 2 // 3
    padded = np.zeros(-(-len(packed) // 3) * 3, np.uint16)
    padded[: len(packed)] = packed
    a, b, c = padded[0::3], padded[1::3], padded[2::3]
    out = np.empty(2 * len(a), np.uint16)
    out[0::2], out[1::2] = a << 4 | b >> 4, (b & 0xF) << 8 | c
    return out[:n]


def pack12(samples: np.ndarray) -> np.ndarray:
    n = len(samples)
    even = np.zeros(n + n % 2, np.uint16)
    even[:n] = samples
    p, q = even[0::2], even[1::2]
    out = np.empty(3 * len(p), np.uint8)
    out[0::3], out[1::3], out[2::3] = p >> 4, (p & 0xF) << 4 | q >> 8, q & 0xFF
    return out[: -(-n * 3 // 2)]


def samples12(data: Column) -> Column:
    """All 12-bit samples of a BINARY column as ARRAY<INT>: sample i is the hex digits 3 i to 3 i + 2."""
    digits = F.hex(data)
    count = (F.length(data) * 2 / 3).cast("int")
    places = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.conv(F.substring(digits, i * 3 + 1, F.lit(3)), 16, 10).cast("int"))


def packed12(samples: Column) -> Column:
    """ARRAY<INT> of 12-bit samples, an even number of them, as packed BINARY."""
    return F.unhex(F.array_join(F.transform(samples, lambda v: F.lpad(F.hex(v), 3, "0")), ""))


def to_pixels(frames: DataFrame, width: int) -> DataFrame:
    """(frame_no, data) with packed 12-bit data to (frame_no, y, x, v)."""
    flat = frames.select("frame_no", F.posexplode(samples12(F.col("data"))).alias("i", "v"))
    return flat.select("frame_no", F.expr(f"cast(i div {width} as int)").alias("y"), F.expr(f"cast(i % {width} as int)").alias("x"), "v")


def to_frames(px: DataFrame) -> DataFrame:
    """(frame_no, y, x, v) to (frame_no, data), 12-bit packed in row order."""
    rows = px.groupBy("frame_no").agg(F.sort_array(F.collect_list(F.struct("y", "x", "v"))).alias("px"))
    return rows.select("frame_no", packed12(F.transform("px", lambda p: p["v"])).alias("data"))

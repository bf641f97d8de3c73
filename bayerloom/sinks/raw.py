"""Frames to files. Paths must lie on storage that driver and executors share."""

from __future__ import annotations

import json
import os
import shlex
import struct
import subprocess

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frames import BITS as SAMPLE_BITS
from ..frames import CHANNELS, pull_ordered, rows_of, whole
from ..numbering import placed_sizes
from ..staging import scratch_folder
from .placed import FrameFolder, PlacedBytes, Written, numbered_files_in, reported, write_together


def write_each(frames: DataFrame, path: str, suffix: str, profile: dict | None = None, replace: bool = False) -> Written:
    """NNNNNN.suffix for each frame, written where the frame is; gives the number of frames, and how many were skipped.

    The folder gets its name when all files are there.
    replace: earlier frames of that suffix in the folder go, once the new ones are there.
    """
    if os.path.isdir(path) and set(os.listdir(path)) - set(numbered_files_in(path, suffix) if replace else ()):
        raise FileExistsError(f"{path} isn't empty")
    return write_together(frames, FrameFolder, path, suffix=suffix, profile=json.dumps(profile or {}), replace=str(replace).lower())


def write_directory(frames: DataFrame, path: str, number_of_frames: int = 0) -> Written:
    from ..operators.selecting import number_of_frames as limited

    return write_each(limited(frames, number_of_frames), path, "data")


BROADCAST_PLACES = 1_000_000  # rows of 32 bytes

#: Marks of the seekable zstd format.
SEEK_TABLE, SEEK_END = 0x184D2A5E, 0x8F92EAB1
SEEK_MOST = 0x8000000


def write_blob(frames: DataFrame, path: str, number_of_frames: int = 0, compression: str | None = None, level: int = 3) -> Written:
    """All frames in order in one file, each written by the task that holds it; gives their number, and how many were skipped.

    Where a frame goes follows from its number if numbers have no gaps and
    frames one size; else frames are written to the shared folder first, and
    places are sums of their sizes over ranges of numbers. With compression
    "zstd" each frame is compressed for itself and the file ends with a table of
    their sizes, so that readers can start at any frame.
    """
    from ..operators.selecting import number_of_frames as limited

    if compression not in (None, "zstd"):
        raise ValueError("compression must be zstd or None")
    frames = limited(frames, number_of_frames)
    if compression is None:
        first = _even_frames(whole(frames))
        if first is not None:
            low, size = first
            fits = F.when(F.length("data") == size, F.col("data")).otherwise(F.raise_error(F.lit(f"a frame hasn't {size} bytes")).cast("binary"))
            kept = fits if "error" not in frames.columns else F.when(F.col("error").isNull(), fits)
            return write_together(frames.select(((F.col("frame_no") - low) * size).alias("place"), kept.alias("data")), PlacedBytes, path)
    return _write_sizes(frames, path, compression, level)


def _even_frames(frames: DataFrame) -> tuple[int, int] | None:
    """The first number and the bytes of a frame, where numbers have no gaps and frames one size."""
    shape = ("kind", "elem", "width", "height")
    seen = frames.agg(F.count("*").alias("n"), F.count_distinct("frame_no").alias("numbers"), F.min("frame_no").alias("low"), F.max("frame_no").alias("high"), *(f(c).alias(f"{name}_{c}") for c in shape for name, f in (("least", F.min), ("most", F.max)))).first()
    if not seen["n"] or not seen["n"] == seen["numbers"] == seen["high"] - seen["low"] + 1 or seen["least_elem"] not in SAMPLE_BITS or any(seen[f"least_{c}"] != seen[f"most_{c}"] for c in shape):
        return None
    return seen["low"], -(-seen["least_width"] * seen["least_height"] * CHANNELS[seen["least_kind"]] * SAMPLE_BITS[seen["least_elem"]] // 8)


def _write_sizes(frames: DataFrame, path: str, compression: str | None, level: int) -> Written:
    spark = frames.sparkSession

    def run(batches):
        import pyarrow as pa
        import zstandard

        packer = zstandard.ZstdCompressor(level=level)
        for batch in batches:
            for row in rows_of(batch):
                if row["data"] is not None and row.get("error") is None:
                    data = bytes(row["data"])
                    out = packer.compress(data) if compression else data
                    yield pa.RecordBatch.from_pydict({"frame_no": [row["frame_no"]], "size": [len(out)], "whole_size": [len(data)], "data": [out]})

    folder = scratch_folder(spark)
    error = ["error"] if "error" in frames.columns else []
    frames.select("frame_no", "data", *error).mapInArrow(run, "frame_no long, size long, whole_size long, data binary").write.option("parquet.block.size", 32 << 20).parquet(folder)
    staged = spark.read.schema("frame_no long, size long, whole_size long, data binary").parquet(folder)
    places, n, total = placed_sizes(staged.select("frame_no", "size", "whole_size"), "frame_no", "size")
    joined = staged.select("frame_no", "data").join(F.broadcast(places) if n <= BROADCAST_PLACES else places, "frame_no")
    rows = joined.select("place", "data")
    if compression:
        if n > SEEK_MOST:
            raise ValueError(f"a seekable file holds at most {SEEK_MOST} frames")

        def little(column: str):
            big = F.lpad(F.hex(column), 8, "0")
            return F.unhex(F.concat(*[F.substring(big, k, 2) for k in (7, 5, 3, 1)]))

        entries = places.select((F.lit(total + 8) + F.col("number") * 8).alias("place"), F.concat(little("size"), little("whole_size")).alias("data"))
        ends = [(total, bytearray(struct.pack("<II", SEEK_TABLE, 8 * n + 9))), (total + 8 + 8 * n, bytearray(struct.pack("<IBI", n, 0, SEEK_END)))]
        rows = rows.unionByName(entries).unionByName(spark.createDataFrame(ends, "place long, data binary"))
    write_together(rows, PlacedBytes, path)
    return reported(n, frames.where(F.col("error").isNotNull()).count() if error else 0, path)


def write_encoder(frames: DataFrame, output: str, input_options: str = "", program: str = "ffmpeg") -> int:
    """RGB frames in order to an encoder's standard input, a few at a time; waits for it and reports its failure."""
    frames = whole(frames)
    first = frames.select("width", "height", "fps", "kind").limit(1).collect()
    if not first or first[0]["kind"] != "rgb":
        raise ValueError("the encoder takes RGB frames")
    shape = first[0]
    command = [program, "-y", "-f", "rawvideo", "-pix_fmt", "rgb24", "-s", f"{shape['width']}x{shape['height']}", "-r", str(shape["fps"]), *shlex.split(input_options), "-i", "-", output]
    child = subprocess.Popen(command, stdin=subprocess.PIPE)
    n = 0
    for _, data in pull_ordered(frames):
        child.stdin.write(data)
        n += 1
    child.stdin.close()
    if child.wait():
        raise RuntimeError(f"{program} ended with {child.returncode}")
    return n

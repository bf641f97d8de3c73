"""Whole frames: one row each, its description in columns and its pixels packed in `data`.

elem: u8, p12 (12-bit packed), u16, f32, u32 (little endian), or ebc (compressed).

Frames may have one more column, `error`. With it, a frame that a step can't
work on keeps its number, loses its data and says why; later steps and writers
pass it over, and the other frames go on. Without it an error ends the query.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.packing import pack12, unpack12

COLUMNS = ("frame_no", "kind", "elem", "width", "height", "red_in_first_col", "red_in_first_row", "fps", "data")
SCHEMA = "frame_no long, kind string, elem string, width int, height int, red_in_first_col boolean, red_in_first_row boolean, fps double, data binary"
DEPTHS = {8: "u8", 12: "p12", 16: "u16", 32: "f32"}
BITS = {"u8": 8, "p12": 12, "u16": 16, "f32": 32, "u32": 32}
CHANNELS = {"raw": 1, "rgb": 3, "rgba": 4}
_DTYPES = {"u8": np.uint8, "u16": np.dtype("<u2"), "f32": np.dtype("<f4"), "u32": np.dtype("<u4")}


@dataclass
class Interpretation:
    """What a headerless reader is told."""

    width: int
    height: int
    bit_depth: int = 12
    red_in_first_col: bool = True
    red_in_first_row: bool = True
    rgb: bool = False
    fps: float = 24.0

    @property
    def kind(self) -> str:
        return "rgb" if self.rgb else "raw"

    @property
    def elem(self) -> str:
        return "u8" if self.rgb else DEPTHS[self.bit_depth]

    @property
    def frame_bytes(self) -> int:
        return -(-self.width * self.height * CHANNELS[self.kind] * BITS[self.elem] // 8)

    def columns(self) -> dict:
        return {"kind": self.kind, "elem": self.elem, "width": self.width, "height": self.height, "red_in_first_col": self.red_in_first_col, "red_in_first_row": self.red_in_first_row, "fps": float(self.fps)}


def described(frames: DataFrame, interpretation: Interpretation, *others: str) -> DataFrame:
    """(frame_no, data) with the description added, and other columns kept."""
    types = {"width": "int", "height": "int"}
    made_frames = frames.withColumns({k: F.lit(v).cast(types[k]) if k in types else F.lit(v) for k, v in interpretation.columns().items()}).select(*COLUMNS, *others)
    return _by(made_frames, frames, lambda f: described(f, interpretation, *others))


def _by(frames: DataFrame, given: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Notes that frames are step(given), and that the step keeps numbers."""
    frames.made_by = given, step
    return frames


def read_by(load: Callable[[int, int], DataFrame]) -> DataFrame:
    """load(0, ALL), noting that the frames of a range of numbers can be loaded without the others."""
    frames = load(0, ALL)
    frames.loaded_by = load
    return frames


ALL = 1 << 62


def chosen(frames: DataFrame, low: int, high: int = ALL) -> DataFrame:
    """The frames numbered low .. high - 1.

    The choice is made before the steps that keep numbers, which Spark can't
    look into, and by the source where it can: others are not read or worked on.
    """
    if not frames.is_cached:
        if hasattr(frames, "loaded_by"):
            return frames.loaded_by(low, high)
        if hasattr(frames, "made_by"):
            given, step = frames.made_by
            return step(chosen(given, low, high))
    return frames.where((F.col("frame_no") >= low) & (F.col("frame_no") < high))


def raw_frames(frames: DataFrame, width: int, height: int, elem: str, fps: float = 24.0) -> DataFrame:
    return described(frames, Interpretation(width, height, BITS[elem], fps=fps))


def array_of(row: dict) -> np.ndarray:
    """A frame's samples: height x width, with a third axis for channels."""
    data = np.frombuffer(row["data"], np.uint8)
    flat = unpack12(data) if row["elem"] == "p12" else data.view(_DTYPES[row["elem"]])
    channels = CHANNELS[row["kind"]]
    shape = (row["height"], row["width"]) + ((channels,) if channels > 1 else ())
    return flat[: int(np.prod(shape))].reshape(shape)


def _samples(array: np.ndarray, elem: str) -> np.ndarray:
    return pack12(array.ravel()) if elem == "p12" else np.ascontiguousarray(array, _DTYPES[elem])


def packed(array: np.ndarray, elem: str) -> bytes:
    return _samples(array, elem).tobytes()


def made(row: dict, array: np.ndarray, **changes) -> dict:
    """The frame `row` with other samples and what else changes."""
    new = row | changes
    return new | {"height": array.shape[0], "width": array.shape[1], "data": pa.py_buffer(_samples(array, new["elem"]))}


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """The frames of a batch; their data are views into it."""
    for k in range(batch.num_rows):
        yield {name: column[k].as_buffer() if name == "data" and column[k].is_valid else column[k].as_py() for name, column in zip(batch.schema.names, batch.columns, strict=True)}


def batch_of(row: dict, schema: pa.Schema) -> pa.RecordBatch:
    """One frame as a batch that shares its data."""
    columns = []
    for field in schema:
        value = row[field.name]
        if field.name == "data" and value is not None and field.type == pa.binary():
            value = pa.py_buffer(value)
            columns.append(pa.Array.from_buffers(field.type, 1, [None, pa.py_buffer(np.array([0, value.size], np.int32)), value]))
        else:
            columns.append(pa.array([value], field.type))
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def tolerant(frames: DataFrame) -> DataFrame:
    """Frames whose steps report errors instead of ending the query."""
    return frames if "error" in frames.columns else _by(frames.withColumn("error", F.lit(None).cast("string")), frames, tolerant)


def whole(frames: DataFrame) -> DataFrame:
    """The frames without an error; their numbers have gaps where the others were."""
    return _by(frames.where(F.col("error").isNull()).drop("error"), frames, whole) if "error" in frames.columns else frames


def failures(frames: DataFrame) -> DataFrame:
    """(frame_no, error) of the frames that some step couldn't work on."""
    if "error" in frames.columns:
        return frames.where(F.col("error").isNotNull()).select("frame_no", "error")
    return frames.sparkSession.createDataFrame([], "frame_no long, error string")


def worked(row: dict, work: Callable[[dict], list[dict]]) -> list[dict]:
    """What work makes of a frame; an error is in its place where frames may have one."""
    if row.get("error") is not None:
        return [row]
    try:
        return work(row)
    except Exception as e:
        if "error" not in row:
            raise
        print(f"error in frame {row['frame_no']}: {e}", file=sys.stderr)
        return [row | {"data": None, "error": f"{type(e).__name__}: {e}"}]


def _worked_batches(batches: Iterator[pa.RecordBatch], works: list[Callable[[dict], list[dict]]]) -> Iterator[tuple[dict, pa.Schema]]:
    """What all works, one after another, make of each frame."""
    for batch in batches:
        for row in rows_of(batch):
            rows = [row]
            for work in works:
                rows = [made_row for given in rows for made_row in worked(given, work)]
            for made_row in rows:
                yield made_row, batch.schema


def _works(frames: DataFrame) -> tuple[DataFrame, list[Callable[[dict], list[dict]]]]:
    """The frames and the works that these ones are made of, so that a task has one Python worker for all of them; of cached ones none."""
    return frames.worked_from if hasattr(frames, "worked_from") and not frames.is_cached else (frames, [])


def map_frames(frames: DataFrame, work: Callable[[dict], list[dict]], keeps_numbers: bool = True) -> DataFrame:
    """Apply work to each frame, one at a time: nothing is shuffled, and a task holds an Arrow batch of frames.

    keeps_numbers: what work gives has the number of the frame that it gets.
    """
    given, works = _works(frames)
    works = [*works, work]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, schema in _worked_batches(batches, works):
            yield batch_of(row, schema)

    made_frames = given.select(*given.columns).mapInArrow(run, frames.schema)
    made_frames.worked_from = given, works
    return _by(made_frames, frames, lambda f: map_frames(f, work)) if keeps_numbers else made_frames


LOOK_AHEAD = 64 << 20


def pull_ordered(frames: DataFrame, look_ahead: int = LOOK_AHEAD) -> Iterator[tuple[int, bytes]]:
    """(frame_no, data) of all frames without an error, in order, for what can only take them one after another.

    Tasks write frames to the shared folder as they come; numbers and sizes
    alone are put in order. Frames are then fetched by runs of numbers of at
    most look_ahead bytes, or one frame, so that is what the driver holds.
    """
    from .numbering import RANGE_ROWS, in_ranges
    from .staging import scratch_folder

    spark, folder = frames.sparkSession, scratch_folder(frames.sparkSession)
    whole(frames).select("frame_no", F.length("data").cast("long").alias("size"), "data").write.option("parquet.block.size", 32 << 20).parquet(folder)
    staged = spark.read.schema("frame_no long, size long, data binary").parquet(folder)
    placed, ranges = in_ranges(staged.select("frame_no", "size"), "frame_no", RANGE_ROWS)

    def fetched(low: int, high: int) -> Iterator[tuple[int, bytes]]:
        for row in sorted(staged.where(F.col("frame_no").between(low, high)).select("frame_no", "data").collect()):
            yield row["frame_no"], bytes(row["data"])

    for part, *_ in ranges:
        low, high, held = None, None, 0
        for number, size in sorted(map(tuple, placed.where(F.col("part") == part).select("frame_no", "size").collect())):
            if low is not None and held + size > look_ahead:
                yield from fetched(low, high)
                low, held = None, 0
            low, high, held = number if low is None else low, number, held + size
        if low is not None:
            yield from fetched(low, high)


def pixels(frames: DataFrame, kind: str | None = None, elem: str | None = None) -> DataFrame:
    """Whole frames to (frame_no, y, x, v), or (frame_no, y, x, r, g, b) for rgb.

    Kind and sample type are those of all frames; where they aren't given they
    are looked up on one frame, which runs the query that far.
    """
    if kind is None:
        first = whole(frames).select("kind", "elem").limit(1).collect()
        kind, elem = (first[0]["kind"], first[0]["elem"]) if first else ("raw", "u8")
    rgb, real = kind == "rgb", elem == "f32"
    values = [("r", "int"), ("g", "int"), ("b", "int")] if rgb else [("v", "double" if real else "int")]
    schema = "frame_no long, y int, x int, " + ", ".join(f"{n} {t}" for n, t in values)

    given, works = _works(frames)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, _ in _worked_batches(batches, works):
            if row.get("error") is not None:
                continue
            array = array_of(row)
            h, w = array.shape[:2]
            columns = [pa.array(np.full(h * w, row["frame_no"], np.int64)), pa.array(np.repeat(np.arange(h, dtype=np.int32), w)), pa.array(np.tile(np.arange(w, dtype=np.int32), h))]
            parts = [array[..., c] for c in range(3)] if rgb else [array]
            columns += [pa.array(p.ravel().astype(np.float64 if real else np.int32)) for p in parts]
            yield pa.RecordBatch.from_arrays(columns, ["frame_no", "y", "x", *[n for n, _ in values]])

    return given.mapInArrow(run, schema)

"""The transforms on whole packed frames, in numpy: one pass over each frame, no shuffle.

For frames of real size this is the form that the graph layer uses; the pixel
form in ``bayerloom.operators`` defines the results.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import BITS, DEPTHS, array_of, batch_of, made, map_frames, packed, rows_of, whole, worked
from .functions import tables
from .functions.packing import unpack12
from .operators.dual import pair_halves
from .operators.lut import Cube
from .operators.rownoise import BLACK, DARK_COLUMNS, RowNoiseModel, pair_lag


def bit_depth(frames: DataFrame, to: int = 8) -> DataFrame:
    def work(row: dict) -> list[dict]:
        have = BITS[row["elem"]]
        if have == to:
            return [row]
        array = array_of(row)
        if to == 16 and have == 12:
            return [made(row, array, elem="u16")]
        if to != 8:
            raise ValueError(f"samples of {have} bits can't become {to} bits")
        return [made(row, array >> (have - 8), elem="u8")]

    return map_frames(frames, work)


def fp32_to_u16(frames: DataFrame, multiplier: float = 1.0) -> DataFrame:
    def work(row: dict) -> list[dict]:
        scaled = array_of(row).astype(np.float64) * multiplier
        rounded = np.sign(scaled) * np.floor(np.abs(scaled) + 0.5)
        return [made(row, np.clip(np.nan_to_num(rounded), 0, 65535), elem="u16")]

    return map_frames(frames, work)


def debayer(frames: DataFrame, border: str = "flat") -> DataFrame:
    """border: see operators.debayer."""
    if border not in ("flat", "clamp"):
        raise ValueError("border must be flat or clamp")

    def work(row: dict) -> list[dict]:
        array = array_of(row).astype(np.int32)
        h, w = array.shape
        if border == "clamp":
            around = np.pad(array, 1, mode="reflect")

            def at(down: int, across: int) -> np.ndarray:
                return around[1 + down : 1 + down + h, 1 + across : 1 + across + w]
        else:
            flat = np.concatenate([np.zeros(w + 1, np.int32), array.ravel(), np.zeros(w + 1, np.int32)])

            def at(down: int, across: int) -> np.ndarray:
                k = w + 1 + down * w + across
                return flat[k : k + h * w].reshape(h, w)

        red_col = ((np.arange(w) + (not row["red_in_first_col"])) % 2 == 0)[None, :]
        red_row = ((np.arange(h) + (not row["red_in_first_row"])) % 2 == 0)[:, None]
        across, upright = (at(0, -1) + at(0, 1)) // 2, (at(-1, 0) + at(1, 0)) // 2
        cross, corners = (at(0, -1) + at(0, 1) + at(-1, 0) + at(1, 0)) // 4, (at(-1, -1) + at(-1, 1) + at(1, -1) + at(1, 1)) // 4
        red, blue = red_col & red_row, ~red_col & ~red_row
        r = np.where(red, array, np.where(blue, corners, np.where(red_row, across, upright)))
        b = np.where(blue, array, np.where(red, corners, np.where(red_row, upright, across)))
        return [made(row, np.stack([r, np.where(red | blue, cross, array), b], axis=2), kind="rgb", elem="u8")]

    return map_frames(frames, work)


def debayer_half(frames: DataFrame) -> DataFrame:
    def work(row: dict) -> list[dict]:
        array = array_of(row)
        c, r = int(not row["red_in_first_col"]), int(not row["red_in_first_row"])
        green = array[r::2, 1 - c :: 2] // 2 + array[1 - r :: 2, c::2] // 2
        return [made(row, np.stack([array[r::2, c::2], green, array[1 - r :: 2, 1 - c :: 2]], axis=2), kind="rgb", elem="u8")]

    return map_frames(frames, work)


PLANE_BYTES = 1 << 30


def darkframe_subtract(frames: DataFrame, dark: np.ndarray) -> DataFrame:
    """dark: one float plane, broadcast; its size is a frame's, at most PLANE_BYTES."""
    if dark.nbytes > PLANE_BYTES:
        raise ValueError(f"a plane of {dark.nbytes} bytes is too large to be sent to every executor")
    shipped = frames.sparkSession.sparkContext.broadcast(dark)

    def work(row: dict) -> list[dict]:
        level = array_of(row) + 128.0 - np.round(shipped.value, 6)
        return [made(row, np.clip(np.sign(level) * np.floor(np.abs(level) + 0.5), 0, 4095).astype(np.uint16))]

    return map_frames(frames, work)


ROWS_AT_ONCE = 64


def row_noise(frames: DataFrame, model: RowNoiseModel, strip_dark_columns: bool = False) -> DataFrame:
    """All rows of a parity are predicted together, then corrected ROWS_AT_ONCE at a time."""
    halves = [(half.offset, np.array(half.green, np.float64).reshape(-1, 2), [(pair_lag(i), np.array(pair, np.float64)) for i, pair in enumerate(half.dark)]) for half in (model.even, model.odd)]

    def work(row: dict) -> list[dict]:
        v = array_of(row)
        h, w = v.shape
        edge = model.uncorrectable
        parity = int(row["red_in_first_col"] == row["red_in_first_row"])
        green = np.empty((h, (w + 1) // 2), np.float32 if v.dtype.kind == "f" else np.int32)
        width = min(len(range(parity, w, 2)), len(range(1 - parity, w, 2)))
        green = green[:, :width]
        for k in range(2):
            green[k::2] = v[k::2, (k + parity) % 2 :: 2][:, :width]
        medians = [np.partition(green[: h - lag] - green[lag:], width // 2, axis=1)[:, width // 2].astype(np.float64) for lag in range(1, model.lags + 1)]
        dark = np.hstack([v[:, :DARK_COLUMNS], v[:, w - DARK_COLUMNS :]]).astype(np.float64) - BLACK
        out = v.copy()
        for k, (offset, weights, pairs) in enumerate(halves):
            y = np.arange(edge, h - edge)
            y = y[y % 2 == k]
            off = np.full(len(y), float(offset))
            for lag, (before, after) in enumerate(weights.tolist(), 1):
                off += medians[lag - 1][y] * after - medians[lag - 1][y - lag] * before
            for lag, pair in pairs:
                first = y - y % 2 + 2 * lag
                off += dark[first] @ pair[0] + dark[first + 1] @ pair[1]
            for at in range(0, len(y), ROWS_AT_ONCE):
                rows = y[at : at + ROWS_AT_ONCE]
                out[rows] = np.clip(np.floor(np.round(v[rows].astype(np.float64) - off[at : at + ROWS_AT_ONCE, None], 6)), 0, 65535)
        return [made(row, out[:, DARK_COLUMNS : w - DARK_COLUMNS] if strip_dark_columns else out)]

    return map_frames(frames, work)


def histogram(frames: DataFrame) -> DataFrame:
    """Each frame as one row of 4096 counts."""

    def work(row: dict) -> list[dict]:
        return [made(row, np.bincount(array_of(row).ravel(), minlength=4096)[None, :4096], elem="u32")]

    return map_frames(frames, work)


BROADCAST_WINDOWS = 1_000_000  # frame numbers of 16 bytes


def _in_windows(frames: DataFrame, n: int) -> DataFrame:
    """frames with their window of n successive frames; those of an unfinished last one are left out.

    Where numbers have no gaps the window follows from the number. Otherwise
    the numbers alone are put in order, and what comes of it is broadcast while
    it is small; only beyond BROADCAST_WINDOWS frames is it joined by a shuffle.
    """
    from .operators.averaging import count_windows

    seen = frames.agg(F.count("*").alias("n"), F.count_distinct("frame_no").alias("numbers"), F.min("frame_no").alias("low"), F.max("frame_no").alias("high")).first()
    if seen["n"] and seen["n"] == seen["numbers"] == seen["high"] - seen["low"] + 1:
        full = seen["low"] + seen["n"] // n * n
        return frames.where(F.col("frame_no") < full).withColumn("window", F.expr(f"(frame_no - {seen['low']}) div {n}").cast("long"))
    windows = count_windows(frames, n)
    return frames.join(F.broadcast(windows) if seen["n"] <= BROADCAST_WINDOWS else windows, "frame_no")


BAND_SAMPLES = 1 << 16  # an even number, so that a band of packed 12-bit samples is whole bytes
HELD_BYTES = 256 << 20
_SHAPE = ("elem", "width", "height", "red_in_first_col", "red_in_first_row", "fps")
_SHAPE_TYPES = "elem string, width int, height int, red_in_first_col boolean, red_in_first_row boolean, fps double"


class Moments:
    """Count and by sample sum and sum of squares, exact for whole samples; mean and squared deviations for floats."""

    def __init__(self, elem: str, most: int, size: int, squares: bool):
        """most: how many frames there may be; sums have the least width that holds as many."""
        self.real, self.n = elem == "f32", 0
        self.a = np.zeros(size, self.type_of(elem, most, 1))
        self.b = np.zeros(size, self.type_of(elem, most, 2)) if squares else None

    @staticmethod
    def type_of(elem: str, most: int, power: int) -> str:
        largest = most * ((1 << BITS[elem]) - 1) ** power
        return "<f8" if elem == "f32" or largest >= 1 << 64 else "<u4" if largest < 1 << 32 else "<u8"

    def add(self, samples: np.ndarray) -> None:
        self.n += 1
        if self.real:
            off = samples - self.a
            self.a += off / self.n
            if self.b is not None:
                self.b += off * (samples - self.a)
            return
        self.a += samples
        if self.b is not None:
            wide = samples.astype(self.b.dtype)
            self.b += wide * wide

    def merge(self, n: int, a: np.ndarray, b: np.ndarray | None) -> None:
        if self.real:
            off, total = a - self.a, self.n + n
            self.a += off * (n / total)
            if self.b is not None:
                self.b += b + off * off * (self.n * n / total)
        else:
            self.a += a
            if self.b is not None:
                self.b += b
        self.n += n

    def results(self) -> tuple[np.ndarray, np.ndarray | None]:
        """Mean and population variance."""
        if self.real:
            return self.a, None if self.b is None else self.b / self.n
        mean = self.a / self.n
        return mean, None if self.b is None else np.maximum(self.b / self.n - mean * mean, 0)


def _band_rows(batches, n: int, std: bool, size: int, schema: pa.Schema):
    """(window, band, n, a, b, ...) for the frames of a task: moments, or, of few frames, their own samples (n = 0)."""
    held: dict[int, tuple[dict, list, list]] = {}  # the first frame, frames' bytes, Moments of all frames once those would be larger
    size_of = {}

    def kept_bytes(window: int) -> int:
        _, raw, sums = held[window]
        return sum(len(r) for r in raw) + sum(m.a.nbytes + (m.b.nbytes if std else 0) for m in sums)

    def given(window: int):
        first, raw, sums = held.pop(window)
        samples = size_of.pop(window)
        shape = {c: first[c] for c in _SHAPE}
        for band, at in enumerate(range(0, samples, size)):
            stop = min(samples, at + size)
            rows = [{"n": m.n, "a": m.a[at:stop].tobytes(), "b": m.b[at:stop].tobytes() if std else None} for m in sums]
            rows += [{"n": 0, "a": r[at * BITS[first["elem"]] // 8 : -(-stop * BITS[first["elem"]] // 8)], "b": None} for r in raw]
            yield pa.RecordBatch.from_pylist([{"window": window, "band": band, **shape, **row} for row in rows], schema=schema)

    for batch in batches:
        for row in rows_of(batch):
            window = row["window"]
            if window not in held:
                held[window] = (row | {"data": None}, [], [])
                size_of[window] = array_of(row).size
            first, raw, sums = held[window]
            if any(first[c] != row[c] for c in ("elem", "width", "height")):
                raise ValueError(f"frame {row['frame_no']} isn't of the size of the others of its window")
            if sums:
                sums[0].add(array_of(row).ravel())
            else:
                raw.append(bytes(row["data"]))
                moments = size_of[window] * sum(np.dtype(Moments.type_of(row["elem"], n, p)).itemsize for p in ((1, 2) if std else (1,)))
                if sum(map(len, raw)) > moments:
                    sums.append(Moments(row["elem"], n, size_of[window], std))
                    for data in raw:
                        sums[0].add(array_of(row | {"data": data}).ravel())
                    raw.clear()
            while len(held) > 1 and sum(map(kept_bytes, held)) > HELD_BYTES:
                yield from given(next(iter(held)))
    for window in list(held):
        yield from given(window)


def _merged_bands(batches, n: int, std: bool, size: int, schema: pa.Schema):
    """One row of mean and variance for each run of rows of one window and band; rows come in that order."""
    key, first, moments = None, None, None

    def given():
        if moments.n != n:
            raise ValueError(f"window {key[0]} has {moments.n} frames, not {n}")
        mean, variance = moments.results()
        return pa.RecordBatch.from_pylist([{"frame_no": key[0], "band": key[1], "kind": "raw", **first, "elem": "f32", "mean": packed(mean, "f32"), "var": packed(variance, "f32") if std else None}], schema=schema)

    for batch in batches:
        for k in range(batch.num_rows):
            row = {name: column[k] for name, column in zip(batch.schema.names, batch.columns, strict=True)}
            own = row["window"].as_py(), row["band"].as_py()
            elem, count, data = row["elem"].as_py(), row["n"].as_py(), row["a"].as_buffer()
            if own != key:
                if key is not None:
                    yield given()
                key, first = own, {c: row[c].as_py() for c in _SHAPE}
                moments = Moments(elem, n, min(first["width"] * first["height"] - own[1] * size, size), std)
            if any(first[c] != row[c].as_py() for c in ("elem", "width", "height")):
                raise ValueError(f"the frames of window {own[0]} aren't of one size")
            if count:
                moments.merge(count, np.frombuffer(data, moments.a.dtype), np.frombuffer(row["b"].as_buffer(), moments.b.dtype) if std else None)
            else:
                flat = np.frombuffer(data, np.uint8)
                moments.add((unpack12(flat) if elem == "p12" else flat.view({"u8": "u1", "u16": "<u2", "f32": "<f4"}[elem]))[: len(moments.a)])
    if key is not None:
        yield given()


def _joined_bands(batches):
    """Whole planes from their bands, which come in order."""
    first, parts = None, []

    def given():
        return batch_of(first | {"data": b"".join(parts)}, pa.schema([f for f in batch.schema if f.name != "band"]))

    for batch in batches:
        for row in rows_of(batch):
            if first is not None and row["frame_no"] != first["frame_no"]:
                yield given()
                first, parts = None, []
            data = bytes(row.pop("data"))
            row.pop("band")
            first = first or row
            parts.append(data)
    if first is not None:
        yield given()


def average_bands(frames: DataFrame, n: int, std: bool = True, band_samples: int = BAND_SAMPLES) -> DataFrame:
    """(frame_no, band, kind, ..., mean, var): float planes of windows of n successive frames, band_samples (an even number) samples a row.

    Each task sums its share of a window and sends it by bands, as its frames'
    own samples where those are fewer bytes. Rows of a band meet in order in one
    task, which merges them one by one: it holds one band, however many frames
    or tasks there are.
    """
    placed = _in_windows(whole(frames), n)
    partial = pa.schema([("window", pa.int64()), ("band", pa.int32()), ("elem", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("red_in_first_col", pa.bool_()), ("red_in_first_row", pa.bool_()), ("fps", pa.float64()), ("n", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])
    merged = pa.schema([("frame_no", pa.int64()), ("band", pa.int32()), ("kind", pa.string()), *[partial.field(c) for c in _SHAPE], ("mean", pa.binary()), ("var", pa.binary())])
    sums = placed.mapInArrow(lambda batches: _band_rows(batches, n, std, band_samples, partial), f"window long, band int, {_SHAPE_TYPES}, n long, a binary, b binary")
    met = sums.repartition("window", "band").sortWithinPartitions("window", "band")
    return met.mapInArrow(lambda batches: _merged_bands(batches, n, std, band_samples, merged), f"frame_no long, band int, kind string, {_SHAPE_TYPES}, mean binary, var binary")


def average(frames: DataFrame, n: int, std: bool = True, band_samples: int = BAND_SAMPLES) -> tuple[DataFrame, DataFrame | None]:
    """Mean and, with std, variance frames of windows of n successive frames; what is put together once are whole planes."""
    bands = average_bands(frames, n, std, band_samples)

    def planes(column: str) -> DataFrame:
        parts = bands.select("frame_no", "band", "kind", *_SHAPE, F.col(column).alias("data"))
        return parts.repartition("frame_no").sortWithinPartitions("frame_no", "band").mapInArrow(_joined_bands, f"frame_no long, kind string, {_SHAPE_TYPES}, data binary")

    return planes("mean"), planes("var") if std else None


def color_voodoo(frames: DataFrame, pedestal: int = 8, s_gamma: float = 1.0, v_gamma: float = 1.0) -> DataFrame:
    """Large frames are looked up: what a channel becomes depends on the pixel's largest and least channel and its own value."""

    def graded(hi: np.ndarray, lo: np.ndarray, c: np.ndarray) -> np.ndarray:
        hi, lo, c = (np.clip((x - float(pedestal)) / (256.0 - pedestal), 0, 1) for x in (hi, lo, c))
        with np.errstate(divide="ignore", invalid="ignore"):
            sat, t = np.where(hi > 0, (hi - lo) / hi, 0), np.where(hi > lo, (hi - c) / (hi - lo), 0)
        level = hi**v_gamma * (1 - sat**s_gamma * t) * 256
        return np.clip(np.floor(np.round(level, 6)), 0, 255)

    def work(row: dict) -> list[dict]:
        array = array_of(row)
        if array.dtype != np.uint8 or array.size < 3 * tables.DIRECT:
            return [made(row, graded(array.max(axis=2, keepdims=True), array.min(axis=2, keepdims=True), array))]
        byte = np.arange(256)
        with np.errstate(all="ignore"):  # cells whose own value isn't between least and largest are never looked up
            table = tables.shared_table(("voodoo", pedestal, s_gamma, v_gamma), lambda: tables.ByteTable(lambda hi: graded(np.full((1, 1), hi), np.minimum(byte, hi)[:, None], byte[None, :]), 1))

        def looked_up(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> np.ndarray:
            hi, lo = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
            return np.stack([table(hi, lo, c) for c in (r, g, b)], axis=1)

        return [made(row, tables.in_strips(array.reshape(-1, 3), looked_up).reshape(array.shape))]

    return map_frames(frames, work)


def _axis(cube: Cube, mode: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each byte the two samples of an axis that it lies between, and how far from the first."""
    n = cube.n
    u = np.arange(256) / 255.0
    u = u * n - 0.5 if mode == "reference" else u * (n - 1)
    low = np.floor(u).astype(np.int64)
    ends = [(low + k) % n if mode == "reference" else np.minimum(low + k, n - 1) for k in range(2)]
    return *ends, u - low


def apply_cube(frames: DataFrame, cube: Cube, mode: str = "reference") -> DataFrame:
    """Trilinear lookup. For large frames of bytes all colours of a red value are interpolated when it first occurs, an axis at a time."""

    def blended(pixels: np.ndarray) -> np.ndarray:
        n, (low, high, part) = cube.n, _axis(cube, mode)
        total = np.zeros(pixels.shape)
        for corner in range(8):
            at, weight = 0, 1.0
            for k in range(3):
                v = pixels[:, k]
                at = at + n**k * (high if corner >> k & 1 else low)[v]
                weight = weight * (part if corner >> k & 1 else 1 - part)[v]
            total += weight[:, None] * cube.entries[at]
        return np.floor(np.round(total, 6))

    def of_red(red: int) -> np.ndarray:
        low, high, part = _axis(cube, mode)
        grid = cube.entries.reshape(cube.n, cube.n, cube.n, 3)  # by blue, green, red
        plane = grid[:, :, low[red]] * (1 - part[red]) + grid[:, :, high[red]] * part[red]
        plane = plane[:, low] * (1 - part)[None, :, None] + plane[:, high] * part[None, :, None]
        return np.floor(np.round(plane[low] * (1 - part)[:, None, None] + plane[high] * part[:, None, None], 6))

    key = ("cube", mode, cube.n, cube.entries.tobytes())

    def work(row: dict) -> list[dict]:
        array = array_of(row)
        pixels = array.reshape(-1, 3)
        if len(pixels) < tables.DIRECT:
            return [made(row, blended(pixels).reshape(array.shape))]
        table = tables.shared_table(key, lambda: tables.ByteTable(of_red, 3))
        return [made(row, tables.in_strips(pixels, lambda r, g, b: table(r, b, g)).reshape(array.shape))]

    return map_frames(frames, work)


def split_rows(frames: DataFrame, flip: bool = False) -> DataFrame:
    """Every 12-bit frame as two half frames, tagged rgb: whole packed lines of one row parity each."""

    def work(row: dict) -> list[dict]:
        lines = np.frombuffer(row["data"], np.uint8).reshape(row["height"], -1)
        half = {"kind": "rgb", "elem": "u8", "width": row["width"] // 2, "height": row["height"] // 2, "fps": row["fps"] * 2}
        return [row | half | {"frame_no": row["frame_no"] * 2 + k, "data": lines[(k + flip) % 2 :: 2].tobytes()} for k in range(2)]

    return map_frames(frames, work, keeps_numbers=False)


BROADCAST_HALVES = 1_000_000  # numbers of 24 bytes


def join_rows(halves: DataFrame, red_in_first_col: bool = True, red_in_first_row: bool = False) -> DataFrame:
    """Half frames back to whole ones. Headers alone are paired; half frames are shuffled once, by the number of their frame.

    Which half goes where is broadcast up to BROADCAST_HALVES halves, and joined by a shuffle beyond.
    """
    halves = halves.where(F.col("error").isNull()) if "error" in halves.columns else halves
    head = F.hex(F.substring("data", 1, 3))

    def byte(k: int):
        return F.conv(F.substring(head, 2 * k + 1, 2), 16, 10).cast("int")

    headers = halves.select(F.col("frame_no").alias("half_no"), byte(0).alias("counter"), byte(1).alias("buffer"), byte(2).alias("marker"))
    pairs = pair_halves(headers)
    sides = pairs.select(F.col("frame_no").alias("__number"), F.posexplode(F.array("b", "a")).alias("__side", "frame_no"))
    few = sides.count() <= BROADCAST_HALVES
    placed = halves.join(F.broadcast(sides) if few else sides, "frame_no").repartition("__number").sortWithinPartitions("__number", "__side")
    fields = halves.schema

    def work(row: dict) -> list[dict]:
        b, a = (np.frombuffer(row[c], np.uint8).reshape(row["height"], -1) for c in ("data", "other"))
        new = {"kind": "raw", "elem": "p12", "width": row["width"] * 2, "height": row["height"] * 2, "red_in_first_col": red_in_first_col, "red_in_first_row": red_in_first_row, "fps": row["fps"] / 2}
        return [row | new | {"data": np.stack([b, a], axis=1).tobytes()}]

    def run(batches):
        before = None
        for batch in batches:
            schema = pa.schema([batch.schema.field(f.name) for f in fields])
            for row in rows_of(batch):
                if row["__side"] == 0:
                    before = row
                    continue
                for made_row in worked(before | {"frame_no": row["__number"], "other": row["data"]}, work):
                    yield batch_of(made_row, schema)

    return placed.select(*fields.names, "__number", "__side").mapInArrow(run, fields)


#: Error controls, and the names of sample types.
CONTROLS = ("abs", "rel", "psnr", "l2norm")
DATA_TYPES = {"float": "<f4", "f32": "<f4", "double": "<f8", "f64": "<f8", "int": "<i4", "i32": "<i4", "long": "<i8", "i64": "<i8"}


def _bound(control: str, tolerance: float, v: np.ndarray) -> float:
    """The largest error of a sample that keeps the control's promise, whatever the errors' distribution."""
    known = v[np.isfinite(v)] if v.dtype.kind == "f" else v
    span = float(known.max()) - float(known.min()) if known.size else 0.0
    if control == "abs":
        return tolerance
    if control == "rel":
        return tolerance * span
    if control == "psnr":
        return span * 10 ** (-tolerance / 20)
    return tolerance / max(v.size, 1) ** 0.5


def _steps(v: np.ndarray, bound: float) -> tuple[float, np.ndarray]:
    """Quantisation: the step, and each sample's multiple of it. Whole numbers have whole steps of 2 floor(bound) + 1."""
    if v.dtype.kind == "f":
        with np.errstate(all="ignore"):
            coded = np.round(v.astype(np.float64) / (2 * bound)) if bound > 0 else np.zeros(v.shape)
            coded = np.where(np.abs(coded) < 2.0**53, coded, 0)
        return 2 * bound, coded.astype(np.int64)
    half = int(min(bound, 1 << 40))
    return 2 * half + 1, (v.astype(np.int64) + half) // (2 * half + 1)


def _restored(coded: np.ndarray, step: float, dtype: np.dtype) -> np.ndarray:
    if dtype.kind == "f":
        with np.errstate(all="ignore"):
            return (coded * step).astype(dtype)
    low, high = np.iinfo(dtype).min, np.iinfo(dtype).max
    return np.clip(coded * int(step), low, high).astype(dtype)


def _shape(size: int, dims: list[int] | None, own: tuple[int, ...]) -> tuple[int, ...]:
    """Sizes of the data's dimensions, the fastest first as given; a last -1 takes what remains."""
    if not dims:
        return own
    if any(d < 1 and d != -1 for d in dims) or -1 in dims[:-1]:
        raise ValueError("dims must be positive, and only the last may be -1")
    rest = int(np.prod([d for d in dims if d > 0]))
    if size % rest or (dims[-1] != -1 and rest != size):
        raise ValueError(f"{size} samples don't fill dimensions {dims}")
    return tuple(d if d > 0 else size // rest for d in reversed(dims))


def _lagged(coded: np.ndarray, axis: int, lag: int) -> np.ndarray:
    """Each number less the one `lag` before it along an axis."""
    out = np.moveaxis(coded.copy(), axis, 0)
    out[lag:] -= np.moveaxis(coded, axis, 0)[:-lag]
    return np.moveaxis(out, 0, axis)


def _residues(coded: np.ndarray, axes: list[int], lag: int) -> np.ndarray:
    """What is left when each number is predicted from its neighbours: differences along one axis, and along several those of differences."""
    for axis in axes:
        coded = _lagged(coded, axis, lag)
    return coded


def _from_residues(residues: np.ndarray, axes: list[int], lag: int) -> np.ndarray:
    out = residues.copy()
    for axis in axes:
        view = np.moveaxis(out, axis, 0)
        for k in range(lag):
            view[k::lag] = np.cumsum(view[k::lag], axis=0)
    return out


SAMPLE_ROWS = 128


def _predictor(coded: np.ndarray) -> tuple[list[int], int]:
    """The axes and the lag whose residues are smallest on some rows in the middle: along the fastest axis or along all, to the next sample or to the next of its colour."""
    middle = max(0, (len(coded) - SAMPLE_ROWS) // 2)
    sample = coded[middle : middle + SAMPLE_ROWS]
    axes = list(range(coded.ndim))
    choices = [([coded.ndim - 1], lag) for lag in (1, 2)] + ([(axes, lag) for lag in (1, 2)] if coded.ndim > 1 else [])

    def cost(choice: tuple[list[int], int]) -> float:
        return float(np.log2(1 + np.abs(_residues(sample, *choice)).astype(np.float64)).sum())

    return min(choices, key=cost) if sample.size else choices[0]


def _coded_bytes(residues: np.ndarray) -> tuple[int, bytes]:
    """Bytes a residue, and the residues deflated: sign in the lowest bit, then by place of their bytes."""
    folded = (residues << 1 ^ residues >> 63).astype(np.uint64).ravel()
    most = int(folded.max(initial=0))
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
    planes = folded.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    return width, zlib.compress(np.ascontiguousarray(planes).tobytes(), 3)


def _decoded_residues(data: bytes, width: int, shape: list[int]) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(width, -1)
    folded = np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.uint64)
    return ((folded >> np.uint64(1)).view(np.int64) ^ -(folded & np.uint64(1)).view(np.int64)).reshape(shape)


def compress(frames: DataFrame, tolerance: float, error_control: str = "abs", data_type: str = "", dims: list[int] | None = None) -> DataFrame:
    """Error-bounded: samples are rounded to steps of twice the bound, predicted from their neighbours in all dimensions, and what remains is deflated.

    data_type: what the frame's bytes are taken as; its own samples if empty.
    Samples that the steps would miss by more than the bound (beside overflows
    and what isn't finite, those that rounding of floats puts over the edge) are
    stored as they are, so the bound holds for every sample.
    """
    if error_control not in CONTROLS:
        raise ValueError(f"error_control must be one of {', '.join(CONTROLS)}")
    if data_type and data_type not in DATA_TYPES:
        raise ValueError(f"data_type must be one of {', '.join(DATA_TYPES)}")

    def work(row: dict) -> list[dict]:
        if data_type:
            if len(row["data"]) % np.dtype(DATA_TYPES[data_type]).itemsize:
                raise ValueError(f"{len(row['data'])} bytes are no whole number of {data_type} samples")
            v = np.frombuffer(row["data"], DATA_TYPES[data_type])
        else:
            v = array_of(row)
        v = v.reshape(_shape(v.size, dims, v.shape))
        bound = _bound(error_control, tolerance, v)
        step, coded = _steps(v, bound)
        back = _restored(coded, step, v.dtype)
        with np.errstate(invalid="ignore"):
            if v.dtype.kind == "f":
                right = np.abs(back.astype(np.float64) - v) <= bound
            else:
                far = np.where(back > v, back.astype(np.int64) - v.astype(np.int64), v.astype(np.int64) - back.astype(np.int64)).view(np.uint64)
                right = far <= np.uint64(min(bound, 2.0**63))
        missed = np.flatnonzero(~right)
        axes, lag = _predictor(coded)
        width, body = _coded_bytes(_residues(coded, axes, lag))
        kept = zlib.compress(missed.astype("<i8").tobytes() + v.ravel()[missed].tobytes(), 3)
        head = json.dumps({"step": step, "dtype": v.dtype.str, "shape": v.shape, "elem": row["elem"], "missed": len(missed), "missed_bytes": len(kept), "axes": axes, "lag": lag, "width": width}).encode()
        return [row | {"elem": "ebc", "data": struct.pack("<I", len(head)) + head + kept + body}]

    return map_frames(frames, work)


def decompress(frames: DataFrame) -> DataFrame:
    def work(row: dict) -> list[dict]:
        raw = bytes(row["data"])
        (size,) = struct.unpack_from("<I", raw)
        head = json.loads(raw[4 : 4 + size])
        dtype, body, n = np.dtype(head["dtype"]), raw[4 + size :], head["missed"]
        kept = zlib.decompress(body[: head["missed_bytes"]])
        missed, own = np.frombuffer(kept, "<i8", n), np.frombuffer(kept, dtype, n, 8 * n)
        coded = _from_residues(_decoded_residues(body[head["missed_bytes"] :], head["width"], head["shape"]), head["axes"], head["lag"])
        v = _restored(coded, head["step"], dtype)
        if head["elem"] == "p12":
            v = np.minimum(v, 4095)
        v = v.ravel()
        v[missed] = own
        data = packed(v, head["elem"]) if head["elem"] == "p12" else v.tobytes()
        return [row | {"elem": head["elem"], "data": data}]

    return map_frames(frames, work)


def depth_of(bits: int) -> str:
    return DEPTHS[bits]

"""DNG sequences: uncompressed strips of one raw plane."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..frames import DEPTHS, SCHEMA
from .raw import numbered_files

_FORMATS = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d"}
#: Tag numbers of the format.
TAGS = {"width": 256, "height": 257, "bits": 258, "strips": 273, "strip_bytes": 279, "sub": 330, "photometric": 262, "cfa": 33422, "fps": 51044}
_CFA = 32803


def _directory(data: bytes, at: int, order: str) -> dict[int, tuple]:
    (n,) = struct.unpack_from(order + "H", data, at)
    tags = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        form = _FORMATS.get(kind)
        if form is None:
            continue
        size = struct.calcsize(order + form) * count
        place = at + 10 + 12 * k if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * k)[0]
        tags[tag] = struct.unpack_from(f"{order}{count * len(form)}{form[0]}", data, place)
    return tags


def parse_dng(data: bytes) -> dict:
    """Description and packed samples of the raw image in a DNG file."""
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    tags = _directory(data, struct.unpack_from(order + "I", data, 4)[0], order)
    for sub in () if tags.get(TAGS["photometric"], (0,))[0] == _CFA else tags.get(TAGS["sub"], ()):
        inner = _directory(data, sub, order)
        if inner.get(TAGS["photometric"], (0,))[0] == _CFA:
            tags = tags | inner
    pixels = b"".join(data[a : a + n] for a, n in zip(tags[TAGS["strips"]], tags[TAGS["strip_bytes"]], strict=True))
    bits = tags[TAGS["bits"]][0]
    if bits == 16 and order == ">":
        pixels = np.frombuffer(pixels, ">u2").astype("<u2").tobytes()
    pattern = tags.get(TAGS["cfa"], (0, 1, 1, 2))
    rate = tags.get(TAGS["fps"])
    return {
        "kind": "raw", "elem": DEPTHS[bits], "width": tags[TAGS["width"]][0], "height": tags[TAGS["height"]][0],
        "red_in_first_col": pattern[0] == 0 or pattern[2] == 0, "red_in_first_row": pattern[0] == 0 or pattern[1] == 0,
        "fps": rate[0] / rate[1] if rate and rate[1] else 24.0, "data": pixels,
    }


def read_dng(spark: SparkSession, pattern: str, loop: int = 1, keep_going: bool = False) -> DataFrame:
    """One frame per file, numbered in the order of paths. What isn't a raw DNG ends the query, or, with keep_going, is a frame with an error."""
    files, n = numbered_files(spark, pattern)
    if loop > 1:
        from ..operators.selecting import internal_loop

        files = internal_loop(files, loop, n)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                made = {"frame_no": row["frame_no"], "fps": 24.0}
                try:
                    made |= parse_dng(row["content"])
                except Exception as e:
                    if not keep_going:
                        raise
                    made["error"] = f"{row['path']}: {type(e).__name__}: {e}"
                schema = pa.schema([("frame_no", pa.int64()), ("kind", pa.string()), ("elem", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("red_in_first_col", pa.bool_()), ("red_in_first_row", pa.bool_()), ("fps", pa.float64()), ("data", pa.binary()), *([("error", pa.string())] if keep_going else [])])
                yield pa.RecordBatch.from_pylist([made], schema=schema)

    return files.select("frame_no", "path", "content").mapInArrow(run, SCHEMA + (", error string" if keep_going else ""))

"""One frame as a picture, in place of a window on a screen."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frames import BITS, array_of, chosen, whole


def png_bytes(image: np.ndarray) -> bytes:
    """An 8-bit grey (h x w) or RGB (h x w x 3) image as a PNG file."""

    def chunk(name: bytes, content: bytes) -> bytes:
        return struct.pack(">I", len(content)) + name + content + struct.pack(">I", zlib.crc32(name + content))

    h, w = image.shape[:2]
    lines = np.hstack([np.zeros((h, 1), np.uint8), image.reshape(h, -1)])  # each line starts with its filter, none
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if image.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def preview(frames: DataFrame, frame_no: int = 0, width: int = 0) -> bytes:
    """One frame as a PNG, at most `width` pixels wide (0: as it is), by nearest samples; deeper samples show their top 8 bits."""
    rows = chosen(whole(frames), frame_no, frame_no + 1).collect()  # a number is one frame's; without a limit the steps' task ends in order
    if not rows:
        raise KeyError(f"there is no frame {frame_no}")
    row = rows[0]
    image = array_of(row.asDict())
    if row["elem"] == "f32":
        span = float(image.max() - image.min()) or 1.0
        image = (image - image.min()) / span * 255
    elif BITS[row["elem"]] > 8:
        image = image >> (BITS[row["elem"]] - 8)
    if width and width < image.shape[1]:
        across = np.arange(width) * image.shape[1] // width
        down = np.arange(max(1, image.shape[0] * width // image.shape[1])) * image.shape[1] // width
        image = image[np.minimum(down, image.shape[0] - 1)][:, across]
    return png_bytes(image.astype(np.uint8))

"""Functions of 8-bit colours as tables, which a worker process makes once, by slices as colours come up."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

STRIP = 1 << 16  # pixels that are looked up at once
DIRECT = 1 << 16  # frames of fewer pixels are worked out directly: a table would cost more

_made: dict = {}


def shared_table(key: tuple, make: Callable[[], ByteTable]) -> ByteTable:
    """The table that this process keeps under key; the last one alone is kept."""
    if key not in _made:
        _made.clear()
        _made[key] = make()
    return _made[key]


class ByteTable:
    """Bytes, up to four of them, by three byte indices; a slice of the first index is made when it is first looked up."""

    def __init__(self, make_slice: Callable[[int], np.ndarray], channels: int):
        """make_slice: for a first index the bytes by the two others, 256 x 256 (x channels)."""
        self.make_slice, self.channels = make_slice, channels
        self.cells = np.zeros((256, 256 * 256), np.uint8 if channels == 1 else np.uint32)  # one read a pixel
        self.ready = np.zeros(256, bool)

    def __call__(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        for k in np.flatnonzero((np.bincount(a, minlength=256) > 0) & ~self.ready).tolist():
            made = self.make_slice(k).reshape(256 * 256, self.channels).astype(np.uint8)
            self.cells[k].view(np.uint8).reshape(256 * 256, -1)[:, : self.channels] = made
            self.ready[k] = True
        at = a.astype(np.int32)
        for axis in (b, c):
            at <<= 8
            at |= axis
        found = self.cells.ravel()[at]
        return found if self.channels == 1 else found.view(np.uint8).reshape(len(at), 4)[:, : self.channels]


def in_strips(pixels: np.ndarray, work: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """work over the three channels of (n, 3) bytes, STRIP pixels at a time."""
    out = np.empty_like(pixels)
    for at in range(0, len(pixels), STRIP):
        out[at : at + STRIP] = work(*np.ascontiguousarray(pixels[at : at + STRIP].T))
    return out

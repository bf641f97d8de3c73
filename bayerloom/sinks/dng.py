"""DNG files: one uncompressed strip, the tags of the format, and a colour profile.

A profile is a mapping of tag names to contents, as Python or as a YAML file of
the same names: numbers, lists of numbers, texts, or the names of illuminants
and embedding rules. Without one, files have a neutral profile.
"""

from __future__ import annotations

import struct
from fractions import Fraction
from pathlib import Path

import numpy as np
import yaml
from pyspark.sql import DataFrame

from ..frames import BITS, chosen, whole
from .placed import Written
from .raw import write_each

#: Tag number, type and content that every file has.
BASE = (
    (254, "I", (0,)), (50706, "B", (1, 4, 0, 0)), (305, "s", "bayerloom"), (277, "H", (1,)),
    (259, "H", (1,)), (266, "H", (1,)), (274, "H", (1,)), (296, "H", (1,)), (282, "II", (1, 1)), (283, "II", (1, 1)), (284, "H", (1,)), (262, "H", (32803,)), (33421, "H", (2, 2)),
)
#: A neutral profile, linear sRGB primaries under D65.
PROFILE = {"UniqueCameraModel": "raw", "ProfileName": "neutral", "ProfileEmbedPolicy": 0, "CalibrationIlluminant1": 21, "ColorMatrix1": (3.2406, -1.5372, -0.4986, -0.9689, 1.8758, 0.0415, 0.0557, -0.2040, 1.0570)}
#: Numbers and types of the tags that a profile may have.
_TAGS = {
    "Make": (271, "s"), "Model": (272, "s"), "Artist": (315, "s"), "Copyright": (33432, "s"), "UniqueCameraModel": (50708, "s"), "BlackLevel": (50714, "I"), "WhiteLevel": (50717, "I"),
    "ColorMatrix1": (50721, "ii"), "ColorMatrix2": (50722, "ii"), "CameraCalibration1": (50723, "ii"), "CameraCalibration2": (50724, "ii"), "AnalogBalance": (50727, "II"), "AsShotNeutral": (50728, "II"),
    "BaselineExposure": (50730, "ii"), "CalibrationIlluminant1": (50778, "H"), "CalibrationIlluminant2": (50779, "H"), "CameraCalibrationSignature": (50931, "s"), "ProfileCalibrationSignature": (50932, "s"),
    "ProfileName": (50936, "s"), "ProfileHueSatMapDims": (50937, "I"), "ProfileHueSatMapData1": (50938, "f"), "ProfileHueSatMapData2": (50939, "f"), "ProfileToneCurve": (50940, "f"), "ProfileEmbedPolicy": (50941, "I"),
    "ProfileCopyright": (50942, "s"), "ForwardMatrix1": (50964, "ii"), "ForwardMatrix2": (50965, "ii"), "ProfileLookTableDims": (50981, "I"), "ProfileLookTableData": (50982, "f"),
}
#: Contents that have names.
_NAMED = {
    "daylight": 1, "fluorescent": 2, "tungsten": 3, "flash": 4, "standardilluminanta": 17, "standardlighta": 17, "standardlightb": 18, "standardlightc": 19, "d55": 20, "d55illuminant": 20,
    "d65": 21, "d65illuminant": 21, "d75": 22, "d75illuminant": 22, "d50": 23, "d50illuminant": 23, "allow copying": 0, "embed if used": 1, "embed never": 2, "no restrictions": 3,
}
_KINDS = {"B": 1, "s": 2, "H": 3, "I": 4, "II": 5, "ii": 10, "f": 11}
#: The colour pattern by (red in first column, red in first row).
PATTERNS = {(True, True): (0, 1, 1, 2), (True, False): (1, 2, 0, 1), (False, True): (1, 0, 2, 1), (False, False): (2, 1, 1, 0)}


def _value(form: str, content) -> tuple[int, bytes]:
    if form == "s":
        raw = content.encode() + b"\0"
        return len(raw), raw
    raw = struct.pack(f"<{len(content)}{form[0]}", *content)
    return len(content) // len(form), raw


def read_profile(path: str) -> dict:
    """The profile in a YAML file."""
    spec = yaml.safe_load(Path(path).read_text())
    if not isinstance(spec, dict):
        raise ValueError(f"{path} holds no mapping of tags")
    for name in spec:
        _encoded(name, spec[name])
    return spec


def _encoded(name: str, content) -> tuple[int, str, object]:
    """Number, type and content of a profile's tag."""
    if name not in _TAGS:
        raise ValueError(f"there is no profile tag {name}; there are {', '.join(_TAGS)}")
    tag, form = _TAGS[name]
    if form == "s":
        return tag, form, str(content)
    values = content if isinstance(content, (list, tuple)) else [content]
    values = [_NAMED[v.lower()] if isinstance(v, str) and v.lower() in _NAMED else v for v in values]
    try:
        if form in ("ii", "II"):
            parts = [Fraction(str(v)).limit_denominator(1_000_000) for v in values]
            return tag, form, tuple(x for f in parts for x in (f.numerator, f.denominator))
        return tag, form, tuple(float(v) if form == "f" else int(v) for v in values)
    except (TypeError, ValueError):
        raise ValueError(f"{name} can't be {content!r}") from None


def dng_bytes(row: dict, profile: dict = PROFILE) -> bytes:
    """A frame as a DNG file. Packed 12-bit samples stay as they are; 16-bit ones are little endian."""
    entries = {tag: (form, content) for tag, form, content in BASE}
    for name, content in profile.items():
        tag, form, made = _encoded(name, content)
        entries[tag] = (form, made)
    data = row["data"]
    pattern = PATTERNS[row["red_in_first_col"], row["red_in_first_row"]]
    for tag, form, content in ((256, "I", (row["width"],)), (257, "I", (row["height"],)), (278, "I", (row["height"],)), (258, "H", (BITS[row["elem"]],)), (51044, "ii", (int(row["fps"] * 10000), 10000)), (33422, "B", pattern), (279, "I", (len(data),))):
        entries[tag] = (form, content)
    entries[273] = ("I", (0,))
    place = 8 + 2 + 12 * len(entries) + 4
    directory, rest, strip_at = [], b"", 0
    for k, tag in enumerate(sorted(entries)):
        form, content = entries[tag]
        count, raw = _value(form, content)
        if tag == 273:
            strip_at = 10 + 12 * k + 8
        if len(raw) > 4:
            directory.append(struct.pack("<HHII", tag, _KINDS[form], count, place + len(rest)))
            rest += raw + b"\0" * (len(raw) % 2)
        else:
            directory.append(struct.pack("<HHI", tag, _KINDS[form], count) + raw.ljust(4, b"\0"))
    head = bytearray(struct.pack("<2sHIH", b"II", 42, 8, len(entries)) + b"".join(directory) + b"\0\0\0\0" + rest)
    struct.pack_into("<I", head, strip_at, len(head))
    return bytes(head) + bytes(data)


def write_dng(frames: DataFrame, path: str, number_of_frames: int = 0, profile: dict = PROFILE, replace: bool = False) -> Written:
    from ..operators.selecting import number_of_frames as limited

    return write_each(limited(frames, number_of_frames), path, "dng", profile, replace)


def frame_as_dng(frames: DataFrame, number: int, profile: dict = PROFILE) -> bytes:
    """One frame on demand: it is chosen before all steps that keep numbers, and a blob reads that frame alone."""
    row = chosen(whole(frames), number, number + 1).first()
    if row is None:
        raise KeyError(f"there is no frame {number}")
    return dng_bytes(row.asDict(), profile)


class FrameServer:
    """Frames as named DNG files, each made when it is asked for: what a file server needs to show them."""

    def __init__(self, frames: DataFrame, profile: dict = PROFILE):
        self.frames, self.profile = whole(frames), profile

    def names(self):
        """The names of all files, in order, as they come from the executors."""
        for row in self.frames.select("frame_no").orderBy("frame_no").toLocalIterator():
            yield f"{row['frame_no']:06d}.dng"

    def read(self, name: str) -> bytes:
        stem, dot, suffix = name.rpartition(".")
        if suffix != "dng" or not stem.isdigit():
            raise KeyError(f"there is no file {name}")
        return frame_as_dng(self.frames, int(stem), self.profile)

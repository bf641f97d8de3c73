"""The nodes that pipelines are made of: their parameters, what they take and give, and what they do."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import kernels, operators, sinks, sources
from .frames import Interpretation, chosen, tolerant, whole
from .params import Parameter


@dataclass(frozen=True)
class Port:
    """The kind of frames on an edge: raw, rgb, ebc, list; elem may be open (None)."""

    kind: str
    elem: str | None = None

    def __str__(self) -> str:
        return self.kind + (f" of {self.elem}" if self.elem else "")


@dataclass(frozen=True)
class NodeType:
    name: str
    parameters: dict[str, Parameter]
    gives: Callable[[dict, Port | None], Port | None]
    run: Callable[[SparkSession, dict, Any], Any]
    source: bool = False
    sink: bool = False
    inputs: tuple[str, ...] = field(default=("input",))
    lazy: bool = False  # a sink whose report still reads its input


NODES: dict[str, NodeType] = {}


def register_node(name: str, parameters: dict[str, Parameter] | None = None, gives=lambda p, given: given, source: bool = False, sink: bool = False, lazy: bool = False):
    """Decorator: make a function (spark, parameters, input) a node type."""

    def add(f):
        NODES[name] = NodeType(name, parameters or {}, gives, f, source, sink, () if source else ("input",), lazy)
        return f

    return add


class PortError(TypeError):
    """A node gets frames of a kind that it doesn't take."""


def takes(*ports: Port, then: Port | Callable[[dict, Port], Port] | None = None):
    """A check of the input's port; then: the port given (the input's own if None)."""

    def gives(parameters: dict, given: Port | None) -> Port | None:
        if given is not None and not any(given.kind == p.kind and (p.elem is None or given.elem is None or given.elem == p.elem) for p in ports):
            raise PortError(f"takes {' or '.join(map(str, ports))}, but gets {given}")
        return then(parameters, given) if callable(then) else then or given

    return gives


INTERPRETATION = {
    "width": Parameter("int", low=1), "height": Parameter("int", low=1), "bit-depth": Parameter("int", 12, 8, 32, (8, 12, 16, 32)), "red-in-first-col": Parameter("bool", True),
    "red-in-first-row": Parameter("bool", True), "rgb": Parameter("bool", False), "fps": Parameter("float", 24.0, 0.0),
}
PRIORITY = {"priority": Parameter("int", 0, 0, 255)}
LIMIT = {"number-of-frames": Parameter("int", 0, 0)}


def interpretation(p: dict) -> Interpretation:
    return Interpretation(p["width"], p["height"], p["bit-depth"], p["red-in-first-col"], p["red-in-first-row"], p["rgb"], p["fps"])


def _own_port(p: dict, given: Port | None) -> Port:
    i = interpretation(p)
    return Port(i.kind, i.elem)


def _kept(frames: DataFrame, p: dict) -> DataFrame:
    """In pipelines a frame that can't be worked on is a gap, not the end."""
    return tolerant(frames).persist() if p.get("cache-frames") else tolerant(frames)


def _profile(p: dict) -> dict:
    return sinks.read_profile(p["dcp-yaml"]) if p["dcp-yaml"] else sinks.dng.PROFILE


@register_node("RawBlobReader", {"file": Parameter("str"), "cache-frames": Parameter("bool", False), **INTERPRETATION}, _own_port, source=True)
def _(spark, p, _input):
    return _kept(sources.read_blob(spark, p["file"], interpretation(p)), p)


@register_node("RawDirectoryReader", {"file-pattern": Parameter("str"), "cache-frames": Parameter("bool", False), "internal-loop": Parameter("int", 1, 1), **INTERPRETATION}, _own_port, source=True)
def _(spark, p, _input):
    return _kept(sources.read_directory(spark, p["file-pattern"], interpretation(p), p["internal-loop"], keep_going=True), p)


@register_node("CinemaDngReader", {"file-pattern": Parameter("str"), "cache-frames": Parameter("bool", False), "internal-loop": Parameter("int", 1, 1)}, lambda p, given: Port("raw"), source=True)
def _(spark, p, _input):
    return _kept(sources.read_dng(spark, p["file-pattern"], p["internal-loop"], keep_going=True), p)


@register_node("ZstdBlobReader", {"file": Parameter("str"), **INTERPRETATION}, _own_port, source=True)
def _(spark, p, _input):
    return tolerant(sources.read_zstd(spark, p["file"], interpretation(p)))


@register_node("TcpReader", {"address": Parameter("str"), **INTERPRETATION}, _own_port, source=True)
def _(spark, p, _input):
    return tolerant(sources.read_tcp(spark, p["address"], interpretation(p)))


def _depth_port(p: dict, given: Port) -> Port:
    return Port("raw", kernels.depth_of(p["to"]))


@register_node("BitDepthConverter", {"to": Parameter("int", 8, 8, 16, (8, 12, 16))}, takes(Port("raw"), then=_depth_port))
def _(spark, p, frames):
    return kernels.bit_depth(frames, p["to"])


@register_node("GpuBitDepthConverter", {}, takes(Port("raw", "p12"), then=Port("raw", "u8")))
def _(spark, p, frames):
    return kernels.bit_depth(frames, 8)


@register_node("Fp32ToUInt16", {"multiplier": Parameter("float", 1.0)}, takes(Port("raw", "f32"), then=Port("raw", "u16")))
def _(spark, p, frames):
    return kernels.fp32_to_u16(frames, p["multiplier"])


@register_node("Debayer", {"border": Parameter("str", "flat", choices=("flat", "clamp"))}, takes(Port("raw", "u8"), then=Port("rgb", "u8")))
def _(spark, p, frames):
    return kernels.debayer(frames, p["border"])


@register_node("DebayerResolutionLoss", {}, takes(Port("raw", "u8"), then=Port("rgb", "u8")))
def _(spark, p, frames):
    return kernels.debayer_half(frames)


@register_node("DarkframeSubtract", {"darkframe": Parameter("str"), "width": Parameter("int", low=1), "height": Parameter("int", low=1)}, takes(Port("raw", "p12")))
def _(spark, p, frames):
    plane = sources.read_blob(spark, p["darkframe"], Interpretation(p["width"], p["height"], 32))
    plane = chosen(plane, 0, 1).first()
    if plane is None:
        raise ValueError(f"{p['darkframe']} holds no plane of {p['width']} x {p['height']}")
    return kernels.darkframe_subtract(frames, np.frombuffer(plane["data"], "<f4").reshape(p["height"], p["width"]).astype(np.float64))


@register_node("RowNoiseRemoval", {"model": Parameter("str", "internal:good"), "strip-dark-columns": Parameter("bool", False)}, takes(Port("raw", "u16")))
def _(spark, p, frames):
    return kernels.row_noise(frames, operators.load_model(p["model"]), p["strip-dark-columns"])


@register_node("Histogram", {}, takes(Port("raw", "p12"), then=Port("raw", "u32")))
def _(spark, p, frames):
    return kernels.histogram(frames)


@register_node("Average", {"n": Parameter("int", low=1), "std": Parameter("bool", False)}, takes(Port("raw", "p12"), then=lambda p, given: Port("list", "f32") if p["std"] else Port("raw", "f32")))
def _(spark, p, frames):
    mean, variance = kernels.average(frames, p["n"], p["std"])
    return [mean, variance] if p["std"] else mean


@register_node("Split", {"element": Parameter("int", low=0)}, takes(Port("list"), then=lambda p, given: Port("raw", given.elem if given else None)))
def _(spark, p, ports):
    if p["element"] >= len(ports):
        raise IndexError(f"there are {len(ports)} outputs, none has number {p['element']}")
    return ports[p["element"]]


@register_node("ColorVoodoo", {"pedestal": Parameter("int", 8, 0, 255), "s_gamma": Parameter("float", 1.0, 0, 100), "v_gamma": Parameter("float", 1.0, 0, 100)}, takes(Port("rgb")))
def _(spark, p, frames):
    return kernels.color_voodoo(frames, p["pedestal"], p["s_gamma"], p["v_gamma"])


@register_node("Lut3d", {"file": Parameter("str"), "mode": Parameter("str", "reference", choices=("reference", "exact"))}, takes(Port("rgb")))
def _(spark, p, frames):
    with open(p["file"]) as file:
        return kernels.apply_cube(frames, operators.parse_cube(file.read()), p["mode"])


@register_node("DualFrameRawDecoder", {"debug": Parameter("bool", False), "red-in-first-col": Parameter("bool", True), "red-in-first-row": Parameter("bool", False)}, takes(Port("rgb"), then=Port("raw", "p12")))
def _(spark, p, frames):
    return kernels.join_rows(frames, p["red-in-first-col"], p["red-in-first-row"])


@register_node("ReverseDualFrameRawDecoder", {"flip": Parameter("bool", False)}, takes(Port("raw", "p12"), then=Port("rgb", "u8")))
def _(spark, p, frames):
    return kernels.split_rows(frames, p["flip"])


@register_node("SZ3Compress", {"tolerance": Parameter("float", low=0), "error_control": Parameter("str", "abs", choices=kernels.CONTROLS), "data_type": Parameter("str", "", choices=("", *kernels.DATA_TYPES)), "dims": Parameter("list", ())}, takes(Port("raw"), Port("rgb"), then=Port("ebc", "ebc")))
def _(spark, p, frames):
    return kernels.compress(frames, p["tolerance"], p["error_control"], p["data_type"], [int(d) for d in p["dims"]])


@register_node("Decompress", {}, takes(Port("ebc"), then=Port("raw")))
def _(spark, p, frames):
    return kernels.decompress(frames)


@register_node("Cache", {"size": Parameter("int", 1, 1)})
def _(spark, p, frames):
    return [f.persist() for f in frames] if isinstance(frames, list) else frames.persist()


_BYTES = takes(Port("raw"), Port("rgb"), Port("rgba"), Port("ebc"))


@register_node("RawBlobWriter", {"path": Parameter("str"), **LIMIT, **PRIORITY}, _BYTES, sink=True)
def _(spark, p, frames):
    return sinks.write_blob(frames, p["path"], p["number-of-frames"])


@register_node("RawDirectoryWriter", {"path": Parameter("str"), **LIMIT, **PRIORITY}, _BYTES, sink=True)
def _(spark, p, frames):
    return sinks.write_directory(frames, p["path"], p["number-of-frames"])


@register_node("CinemaDngWriter", {"path": Parameter("str"), "dcp-yaml": Parameter("str", ""), "exists-ok?": Parameter("bool", False), **LIMIT, **PRIORITY}, takes(Port("raw")), sink=True)
def _(spark, p, frames):
    return sinks.write_dng(frames, p["path"], p["number-of-frames"], _profile(p), p["exists-ok?"])


@register_node("CinemaDngFrameserver", {"dcp-yaml": Parameter("str", ""), **PRIORITY}, takes(Port("raw")), sink=True, lazy=True)
def _(spark, p, frames):
    """The files that a server would show; they are made when they are read."""
    return sinks.FrameServer(frames, _profile(p))


@register_node("Display", {"frame": Parameter("int", 0, 0), "width": Parameter("int", 0, 0), "path": Parameter("str", ""), **PRIORITY}, takes(Port("raw"), Port("rgb")), sink=True)
def _(spark, p, frames):
    """One frame as a PNG, in a file if a path is given."""
    picture = sinks.preview(frames, p["frame"], p["width"])
    if p["path"]:
        with open(p["path"], "wb") as file:
            file.write(picture)
    return picture


@register_node("FfmpegWriter", {"output": Parameter("str"), "input-options": Parameter("str", ""), **PRIORITY}, takes(Port("rgb")), sink=True)
def _(spark, p, frames):
    return sinks.write_encoder(frames, p["output"], p["input-options"])


@register_node("BenchmarkSink", {"rounds": Parameter("int", 10, 1), "unordered": Parameter("bool", False), **PRIORITY}, sink=True)
def _(spark, p, frames):
    return sinks.benchmark(frames, p["rounds"])


@register_node("Plot", PRIORITY, takes(Port("raw", "u32")), sink=True, lazy=True)
def _(spark, p, frames):
    """The data of the plot: the range of bins worth showing, of each frame."""
    from .frames import pixels
    from .operators import plot_trim

    counts = pixels(whole(frames), "raw", "u32").selectExpr("frame_no", "x as bin", "cast(v as long) as n").where("n > 0")
    return plot_trim(counts)

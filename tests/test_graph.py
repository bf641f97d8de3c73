"""Pipelines: parsing, checks before running, and runs."""

import numpy as np
import pytest

from bayerloom import frames as fr
from bayerloom import graph, sinks
from bayerloom.registry import NODES, PortError

CHAIN = "RawBlobReader --file {file} --width 20 --height 10 ! {rest}"


@pytest.fixture
def blob(spark, tmp_path):
    rng = np.random.default_rng(9)
    frames = spark.createDataFrame([(k, "raw", "p12", 20, 10, True, True, 24.0, bytearray(fr.packed(rng.integers(0, 4096, (10, 20)), "p12"))) for k in range(4)], fr.SCHEMA)
    sinks.write_blob(frames, str(tmp_path / "in.blob"))
    return str(tmp_path / "in.blob")


@pytest.mark.parametrize(
    "rest,error",
    [
        ("Debayer ! BenchmarkSink", PortError),
        ("GpuBitDepthConverter ! CinemaDngWriter --path x ! Cache", PortError),
        ("GpuBitDepthConverter ! GpuBitDepthConverter ! BenchmarkSink", PortError),
        ("Nowhere", ValueError),
        ("BitDepthConverter --to 99 ! BenchmarkSink", ValueError),
        ("BitDepthConverter --depth 8 ! BenchmarkSink", ValueError),
        ("Average ! BenchmarkSink", ValueError),
        ("Split --element 0 ! BenchmarkSink", PortError),
        (" ! BenchmarkSink", ValueError),
        ("Cache stray", ValueError),
    ],
)
def test_wrong_chains_are_refused_before_anything_runs(spark, rest, error):
    with pytest.raises(error):
        graph.run(spark, graph.parse_inline(CHAIN.format(file="/nowhere", rest=rest)))


def test_wrong_graphs(spark):
    with pytest.raises(ValueError, match="cycle"):
        graph.ordered(graph.parse_yaml("a:\n  type: Cache\n  input: <b\nb:\n  type: Cache\n  input: <a"))
    with pytest.raises(ValueError, match="isn't there"):
        graph.ordered(graph.parse_yaml("a:\n  type: Cache\n  input: <b"))
    with pytest.raises(ValueError, match="no sink"):
        graph.run(spark, graph.parse_inline("RawBlobReader --file x --width 2 --height 2"))
    with pytest.raises(ValueError, match="two nodes"):
        graph.ordered([graph.Node("a", "Cache"), graph.Node("a", "Cache")])
    with pytest.raises(KeyError, match="isn't set"):
        graph.parse_yaml("a: {type: '{{ b }}'}")
    with pytest.raises(ValueError, match="must lie"):
        graph.check(graph.parse_yaml("a: {type: RawBlobReader, file: x, width: 0, height: 2}"))


def test_whole_numbers_do_for_rates():
    (_, parameters), = graph.check(graph.parse_yaml("a: {type: RawBlobReader, file: x, width: 2, height: 2, fps: 24}"))
    assert parameters["fps"] == 24.0 and parameters["bit-depth"] == 12


def test_chain_to_a_file_and_back(spark, blob, tmp_path):
    report = graph.run(spark, graph.parse_inline(CHAIN.format(file=blob, rest=f"GpuBitDepthConverter ! Debayer ! ColorVoodoo ! RawBlobWriter --path {tmp_path}/out --number-of-frames 3")))
    assert list(report.values()) == [3]
    assert (tmp_path / "out").stat().st_size == 3 * 20 * 10 * 3


def test_dark_frame_story(spark, blob, tmp_path):
    text = "input: {type: RawBlobReader, file: '{{ file }}', width: 20, height: 10}\naverage: {type: Average, input: <input, n: 4}\nout: {type: RawBlobWriter, path: '{{ dark }}', number-of-frames: 1, input: <average}"
    dark = str(tmp_path / "dark")
    assert graph.run(spark, graph.parse_yaml(text, {"file": blob, "dark": dark}))["out"] == 1
    made = graph.build(spark, graph.parse_inline(CHAIN.format(file=blob, rest=f"DarkframeSubtract --darkframe {dark} --width 20 --height 10 ! Cache")))
    mean = fr.pixels(list(made.values())[-1]).agg({"v": "avg"}).first()[0]
    assert 64 < mean < 600


def test_every_node_of_one_input_runs(spark, blob, tmp_path):
    (tmp_path / "a.cube").write_text("LUT_3D_SIZE 2\n" + "\n".join("0.5 0.5 0.5" for _ in range(8)))
    text = f"""
in: {{type: RawBlobReader, file: {blob}, width: 20, height: 10, cache-frames: true}}
avg: {{type: Average, input: <in, n: 2, std: true}}
var: {{type: Split, input: <avg, element: 1}}
u16: {{type: Fp32ToUInt16, input: <var, multiplier: 0.01}}
clean: {{type: RowNoiseRemoval, input: <u16, strip-dark-columns: true}}
d8: {{type: BitDepthConverter, input: <in}}
half: {{type: DebayerResolutionLoss, input: <d8}}
lut: {{type: Lut3d, input: <half, file: {tmp_path}/a.cube}}
parts: {{type: ReverseDualFrameRawDecoder, input: <in}}
hist: {{type: Histogram, input: <in}}
small: {{type: SZ3Compress, input: <in, tolerance: 2}}
back: {{type: Decompress, input: <small}}
plot: {{type: Plot, input: <hist}}
dng: {{type: CinemaDngWriter, input: <clean, path: {tmp_path}/dng}}
bench: {{type: BenchmarkSink, input: <lut, rounds: 1}}
"""
    nodes = graph.parse_yaml(text)
    made = graph.build(spark, nodes)
    assert {n: made[n].count() for n in ("var", "clean", "lut", "parts", "hist", "back")} == {"var": 2, "clean": 2, "lut": 4, "parts": 8, "hist": 4, "back": 4}
    assert made["clean"].first()["width"] == 4
    reports = graph.run(spark, nodes)
    assert reports["dng"] == 2 and reports["plot"].count() == 4


def test_a_sink_that_fails_is_reported_after_the_others(spark, blob, tmp_path):
    (tmp_path / "full").mkdir()
    (tmp_path / "full" / "x").write_text("")
    text = f"in: {{type: RawBlobReader, file: {blob}, width: 20, height: 10}}\na: {{type: RawDirectoryWriter, input: <in, path: {tmp_path}/full}}\nb: {{type: RawDirectoryWriter, input: <in, path: {tmp_path}/free, priority: 3}}"
    with pytest.raises(FileExistsError):
        graph.run(spark, graph.parse_yaml(text))
    assert len(list((tmp_path / "free").iterdir())) == 4


def test_registry_is_complete():
    nodes = "RawBlobReader RawDirectoryReader CinemaDngReader ZstdBlobReader TcpReader BitDepthConverter GpuBitDepthConverter Fp32ToUInt16 Debayer DebayerResolutionLoss DarkframeSubtract RowNoiseRemoval Histogram Average ColorVoodoo Lut3d DualFrameRawDecoder ReverseDualFrameRawDecoder SZ3Compress Cache Split RawBlobWriter RawDirectoryWriter CinemaDngWriter FfmpegWriter BenchmarkSink Plot"
    assert set(nodes.split()) <= set(NODES)

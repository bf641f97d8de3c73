"""Frames with errors, exact error bounds, plans without shuffled pixels, and what users see of a run."""

import io
import os
import stat
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bayerloom import cli, graph, kernels, operators, sinks, sources
from bayerloom import frames as fr

W, H = 20, 10


def some_frames(spark, count=6, elem="p12"):
    rng = np.random.default_rng(3)
    return spark.createDataFrame([(k, "raw", elem, W, H, True, True, 24.0, bytearray(fr.packed(rng.integers(0, 4096, (H, W)), elem))) for k in range(count)], fr.SCHEMA)


def there_and_back(v, elem, tolerance, control, data_type="", dims=None):
    """One frame through the two steps, without Spark."""
    works = []

    class Frames:  # catches the work of each step
        pass

    def catch(frames, work):
        works.append(work)
        return frames

    kept = kernels.map_frames
    kernels.map_frames = catch
    try:
        kernels.compress(Frames(), tolerance, control, data_type, dims)
        kernels.decompress(Frames())
    finally:
        kernels.map_frames = kept
    row = {"frame_no": 0, "kind": "raw", "elem": elem, "width": v.shape[1], "height": v.shape[0], "data": fr.packed(v, elem)}
    (small,) = works[0](row)
    (back,) = works[1](small)
    assert back["elem"] == elem and len(back["data"]) == len(row["data"])
    return row["data"], back["data"]


@settings(max_examples=150, deadline=None)
@given(st.sampled_from(["u8", "p12", "u16", "f32", "u32"]), st.sampled_from(kernels.CONTROLS), st.floats(0, 300), st.integers(0, 2**32 - 1))
def test_bounds_hold_for_every_type_and_control(elem, control, tolerance, seed):
    rng = np.random.default_rng(seed)
    top = {"u8": 256, "p12": 4096, "u16": 65536, "u32": 1 << 32, "f32": 1000}[elem]
    v = rng.normal(0, 50, (6, 8)) if elem == "f32" else rng.integers(0, top, (6, 8))
    if elem == "f32":
        v[0, :3] = np.nan, np.inf, -np.inf
    before, after = there_and_back(v, elem, tolerance, control)
    a, b = (fr.array_of({"data": d, "elem": elem, "kind": "raw", "height": 6, "width": 8}).astype(np.float64) for d in (before, after))
    fine = np.isfinite(a)
    assert np.array_equal(a[~fine], b[~fine], equal_nan=True)
    a, b = a[fine], b[fine]
    error, span = np.abs(a - b), a.max() - a.min()
    if control == "abs":
        assert error.max() <= tolerance
    elif control == "rel":
        assert error.max() <= tolerance * span
    elif control == "l2norm":
        assert np.sqrt((error**2).sum()) <= tolerance * (1 + 1e-12)
    else:
        assert not error.any() or 20 * np.log10(span / np.sqrt((error**2).mean())) >= tolerance - 1e-9


def test_data_types_and_dimensions():
    rng = np.random.default_rng(1)
    for name, dtype in kernels.DATA_TYPES.items():
        samples = (rng.integers(-(2**31), 2**31 - 1, 24) if dtype[1] == "i" else rng.normal(0, 9, 24)).astype(dtype)
        v = np.frombuffer(samples.tobytes(), np.uint8).reshape(4, -1)
        for dims in (None, [24], [4, -1], [2, 3, 4]):
            before, after = there_and_back(v, "u8", 0.5, "abs", name, dims)
            a, b = (np.frombuffer(d, dtype).astype(np.float64) for d in (before, after))
            assert np.abs(a - b).max() <= 0.5
    edge = np.array([-(2**63), 2**63 - 1, 0, 1], "<i8")
    before, after = there_and_back(np.frombuffer(edge.tobytes(), np.uint8).reshape(4, -1), "u8", 3.9, "abs", "i64")
    assert all(abs(int(x) - int(y)) <= 3 for x, y in zip(edge, np.frombuffer(after, "<i8"), strict=True))
    for bad in ([5], [-1, 4], [0, 4]):
        with pytest.raises(ValueError):
            there_and_back(np.zeros((2, 8), np.uint8), "u8", 1.0, "abs", "f32", bad)
    with pytest.raises(ValueError):
        there_and_back(np.zeros((1, 7), np.uint8), "u8", 1.0, "abs", "f32")


def test_broken_frames_are_gaps(spark, tmp_path):
    folder = tmp_path / "raw"
    sinks.write_directory(some_frames(spark), str(folder))
    (folder / "000002.data").write_bytes(b"short")
    line = f"RawDirectoryReader --file-pattern {folder}/*.data --width {W} --height {H} ! BitDepthConverter ! Debayer"
    nodes = graph.parse_inline(line)
    out = graph.build(spark, nodes)[nodes[-1].name]
    assert [r["frame_no"] for r in fr.whole(out).orderBy("frame_no").collect()] == [0, 1, 3, 4, 5]
    ((number, error),) = fr.failures(out).collect()
    assert number == 2 and "shorter" in error
    assert list(graph.run(spark, graph.parse_inline(f"{line} ! RawDirectoryWriter --path {tmp_path}/out")).values()) == [5]
    assert not (tmp_path / "out" / "000002.data").exists()
    frames = fr.tolerant(some_frames(spark))

    def picky(row):
        if row["frame_no"] == 4:
            raise ValueError("not this one")
        return [row]

    assert [tuple(r) for r in fr.failures(kernels.bit_depth(fr.map_frames(frames, picky), 8)).collect()] == [(4, "ValueError: not this one")]
    with pytest.raises(Exception, match="not this one"):
        fr.map_frames(some_frames(spark), picky).collect()
    assert fr.failures(some_frames(spark)).count() == 0


def test_broken_dng_files_are_gaps(spark, tmp_path):
    sinks.write_dng(some_frames(spark, 3), str(tmp_path / "dng"))
    (tmp_path / "dng" / "000001.dng").write_bytes(b"no picture")
    frames = sources.read_dng(spark, f"{tmp_path}/dng/*.dng", keep_going=True)
    assert sorted(r["frame_no"] for r in fr.whole(frames).collect()) == [0, 2]
    assert [r["frame_no"] for r in fr.failures(frames).collect()] == [1]
    with pytest.raises(Exception):
        sources.read_dng(spark, f"{tmp_path}/dng/*.dng").collect()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_contents_are_never_shuffled(spark, tmp_path):
    sinks.write_directory(some_frames(spark), str(tmp_path / "raw"))
    read = sources.read_directory(spark, f"{tmp_path}/raw/*.data", fr.Interpretation(W, H, 12))
    assert "SortMergeJoin" not in plan(read) and "BroadcastHashJoin" in plan(read)
    mean, _ = kernels.average(some_frames(spark), 2)
    assert "Join" not in plan(mean)
    mean, _ = kernels.average(some_frames(spark).where("frame_no <> 2"), 2)
    assert "SortMergeJoin" not in plan(mean)
    assert sorted(r["frame_no"] for r in mean.collect()) == [0, 1]


def test_blobs_are_written_in_place(spark, tmp_path):
    frames = some_frames(spark)
    expected = b"".join(bytes(r["data"]) for r in frames.orderBy("frame_no").collect())
    for name, df, data in (("all", frames.repartition(3), expected), ("gap", frames.where("frame_no <> 2"), expected[:600] + expected[900:]), ("later", frames.where("frame_no > 1"), expected[600:])):
        path = tmp_path / name
        assert sinks.write_blob(df, str(path)) == len(data) // 300
        assert path.read_bytes() == data
    assert sinks.write_blob(frames.where("frame_no > 99"), str(tmp_path / "none")) == 0 and (tmp_path / "none").read_bytes() == b""


def test_profiles(spark, tmp_path):
    row = some_frames(spark, 1).first().asDict()
    assert sources.parse_dng(sinks.dng_bytes(row))["data"] == bytes(row["data"])
    (tmp_path / "own.yml").write_text("UniqueCameraModel: own camera\nProfileEmbedPolicy: allow copying\nCalibrationIlluminant1: StandardIlluminantA\nColorMatrix1: [1.5, -0.25, 0, 0, 1, 0, 0, 0, 1]\n")
    made = sinks.dng_bytes(row, sinks.read_profile(str(tmp_path / "own.yml")))
    assert b"own camera\0" in made and struct.pack("<ii", 3, 2) + struct.pack("<ii", -1, 4) in made
    assert sources.parse_dng(made)["data"] == bytes(row["data"])
    for bad in ("Nothing: 1", "ColorMatrix1: [red]", "- 1"):
        (tmp_path / "bad.yml").write_text(bad)
        with pytest.raises(ValueError):
            sinks.read_profile(str(tmp_path / "bad.yml"))
    folder = str(tmp_path / "dng")
    sinks.write_dng(some_frames(spark, 3), folder)
    assert sinks.write_dng(some_frames(spark, 2), folder, replace=True) == 2 and sorted(os.listdir(folder)) == ["000000.dng", "000001.dng"]


def test_frame_server_and_preview(spark):
    frames = some_frames(spark, 3)
    server = sinks.FrameServer(frames)
    assert list(server.names()) == ["000000.dng", "000001.dng", "000002.dng"]
    assert sources.parse_dng(server.read("000002.dng"))["data"] == bytes(frames.where("frame_no = 2").first()["data"])
    for name in ("000009.dng", "x.dng", "000001.png"):
        with pytest.raises(KeyError):
            server.read(name)
    picture = sinks.preview(frames, 1)
    at = picture.index(b"IDAT")
    (size,) = struct.unpack(">I", picture[at - 4 : at])
    lines = np.frombuffer(zlib.decompress(picture[at + 4 : at + 4 + size]), np.uint8).reshape(H, W + 1)
    assert np.array_equal(lines[:, 1:], fr.array_of(frames.where("frame_no = 1").first().asDict()) >> 4)
    assert struct.unpack(">II", sinks.preview(frames, 1, width=7)[16:24]) == (7, 3)
    with pytest.raises(KeyError):
        sinks.preview(frames, 8)


def test_encoder_gets_frames_in_order(spark, tmp_path):
    program = tmp_path / "encoder"
    program.write_text('#!/bin/sh\nfor last; do :; done\necho "$@" > "$last.args"\ncat > "$last"\n')
    program.chmod(program.stat().st_mode | stat.S_IXUSR)
    rgb = kernels.debayer(kernels.bit_depth(some_frames(spark), 8))
    assert sinks.write_encoder(rgb, str(tmp_path / "film"), "-nostdin", str(program)) == 6
    assert (tmp_path / "film").read_bytes() == b"".join(bytes(r["data"]) for r in rgb.orderBy("frame_no").collect())
    assert "20x10" in (tmp_path / "film.args").read_text()
    program.write_text("#!/bin/sh\ncat > /dev/null\nexit 3\n")
    with pytest.raises(RuntimeError, match="ended with 3"):
        sinks.write_encoder(rgb, str(tmp_path / "film"), "", str(program))


def test_rate_of_a_stream(spark):
    rate = sinks.benchmark(spark.readStream.format("rate").option("rowsPerSecond", 20).load())
    assert rate["frames"] > 0 and rate["fps"] > 0


def test_larger_models_are_there():
    for name in ("internal:good", "internal:only_dark"):
        model = operators.load_model(name)
        assert len(model.even.dark) == len(model.odd.dark) == 3 and all(len(row) == 16 for half in (model.even, model.odd) for pair in half.dark for row in pair)
    assert operators.load_model("internal:good").lags == 3 and operators.load_model("internal:only_dark").lags == 0


def test_usage_choices_and_progress(spark, capsys, tmp_path):
    assert cli.main(["from-cli", "SZ3Compress", "--help"]) == 0
    shown = capsys.readouterr().out
    assert "--tolerance" in shown and "must be given" in shown and "l2norm" in shown
    assert cli.main(["list"]) == 0 and "CinemaDngFrameserver: a sink" in capsys.readouterr().out
    for chain in ("BitDepthConverter --to 10", "SZ3Compress --tolerance 1 --error_control nearly"):
        with pytest.raises(ValueError, match="must be one of"):
            graph.check(graph.parse_inline(f"RawBlobReader --file x --width 2 --height 2 ! {chain}"))
    with pytest.raises(ValueError, match="must be one of"):
        graph.check(graph.parse_inline("RawBlobReader --file x --width 2 --height 2 --bit-depth 10"))
    sinks.write_blob(some_frames(spark), str(tmp_path / "in"))
    out = io.StringIO()
    with graph.Progress(spark, out) as progress:
        some_frames(spark).count()
        progress.show()
    assert out.getvalue().endswith("\n")
    nodes = graph.parse_inline(f"RawBlobReader --file {tmp_path}/in --width {W} --height {H} --cache-frames true ! Display --frame 2 --path {tmp_path}/shown.png")
    (picture,) = graph.run(spark, nodes, show_progress=True).values()
    assert (tmp_path / "shown.png").read_bytes() == picture

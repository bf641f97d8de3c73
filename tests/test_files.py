"""Readers and writers."""

import socket
import threading

import numpy as np
import pytest

from bayerloom import frames as fr
from bayerloom import operators, sinks, sources

W, H = 20, 10
INTERPRETATION = fr.Interpretation(W, H, 12)


@pytest.fixture
def frames(spark):
    rng = np.random.default_rng(8)
    return spark.createDataFrame([(k, "raw", "p12", W, H, True, True, 24.0, bytearray(fr.packed(rng.integers(0, 4096, (H, W)), "p12"))) for k in range(5)], fr.SCHEMA)


def contents(df):
    return {r["frame_no"]: bytes(r["data"]) for r in df.collect()}


def test_blob_leaves_out_an_unfinished_frame(spark, frames, tmp_path):
    path = str(tmp_path / "a.blob")
    assert sinks.write_blob(frames, path) == 5
    with open(path, "ab") as file:
        file.write(b"rest")
    assert contents(sources.read_blob(spark, path, INTERPRETATION)) == contents(frames)
    assert sinks.write_blob(frames, str(tmp_path / "two"), number_of_frames=2) == 2


def test_empty_blob(spark, tmp_path):
    (tmp_path / "none").write_bytes(b"")
    assert sources.read_blob(spark, str(tmp_path / "none"), INTERPRETATION).count() == 0


def test_zstd_stream(spark, frames, tmp_path):
    path = str(tmp_path / "a.zst")
    sinks.write_blob(frames, path, compression="zstd")
    assert contents(sources.read_zstd(spark, path, INTERPRETATION)) == contents(frames)


def test_directory(spark, frames, tmp_path):
    path = str(tmp_path / "raw")
    assert sinks.write_directory(frames, path) == 5
    assert contents(sources.read_directory(spark, f"{path}/*.data", INTERPRETATION)) == contents(frames)
    assert sorted(contents(sources.read_directory(spark, f"{path}/*.data", INTERPRETATION, loop=2))) == list(range(10))
    with pytest.raises(FileExistsError):
        sinks.write_directory(frames, path)
    with pytest.raises(Exception, match="shorter"):
        sources.read_directory(spark, f"{path}/*.data", fr.Interpretation(W, H + 2, 12)).collect()
    with pytest.raises(Exception):
        sources.read_directory(spark, f"{path}/*.none", INTERPRETATION).collect()


@pytest.mark.parametrize("phase", [(True, True), (True, False), (False, True), (False, False)])
def test_dng_keeps_everything(spark, frames, tmp_path, phase):
    row = frames.first().asDict() | {"red_in_first_col": phase[0], "red_in_first_row": phase[1], "fps": 23.976}
    back = sources.parse_dng(sinks.dng_bytes(row))
    assert (back["red_in_first_col"], back["red_in_first_row"]) == phase
    assert back["data"] == bytes(row["data"]) and back["fps"] == pytest.approx(23.976) and back["elem"] == "p12"


def test_one_frame_on_demand(frames):
    assert sources.parse_dng(sinks.frame_as_dng(frames, 3))["data"] == contents(frames)[3]
    with pytest.raises(KeyError):
        sinks.frame_as_dng(frames, 9)


def serve(payload):
    server = socket.create_server(("127.0.0.1", 0))

    def run():
        connection, _ = server.accept()
        connection.sendall(payload)
        connection.close()

    threading.Thread(target=run, daemon=True).start()
    return f"127.0.0.1:{server.getsockname()[1]}"


def test_tcp_in_batch_and_as_stream(spark, frames):
    expected = contents(frames)
    payload = b"".join(expected[k] for k in range(5)) + b"rest"
    assert contents(sources.read_tcp(spark, serve(payload), INTERPRETATION)) == expected
    query = sources.read_tcp(spark, serve(payload), INTERPRETATION, stream=True).writeStream.format("memory").queryName("tcp").start()
    query.processAllAvailable()
    query.stop()
    assert contents(spark.table("tcp")) == expected


def test_benchmark_reports_a_rate(frames):
    report = sinks.benchmark(frames, rounds=2)
    assert report["frames"] == 5 and report["fps"] > 0


def test_gaps_and_limits(spark, frames):
    assert operators.number_of_frames(frames, 2).count() == 2 and operators.number_of_frames(frames, 0).count() == 5
    assert [tuple(r) for r in operators.sequence_gaps(frames.where("frame_no not in (1, 2)")).collect()] == [(0, 2)]

"""Half frames: the pairing rule, its recovery, and its stream form."""

import numpy as np
import pytest

from bayerloom import frames as fr
from bayerloom import kernels, streaming
from bayerloom.operators.dual import PairState

W, H = 20, 10


def fed(numbers):
    state, pairs = PairState(), []
    for k in numbers:
        pair = state.feed((k, k % 256, (k // 2 + 1) % 4, 0xAA if k % 2 else 0x55))
        if pair:
            pairs.append((pair[2], pair[1]))
    return pairs


def test_pairs_without_loss():
    assert fed(range(16)) == [(k, k + 1) for k in range(0, 16, 2)]


@pytest.mark.parametrize("lost", [6, 7])
def test_one_slip_after_one_loss(lost):
    assert fed([k for k in range(16) if k != lost]) == [(0, 1), (2, 3), (4, 5), (8, 9), (10, 11), (12, 13), (14, 15)]


def test_late_start_slips_once():
    assert fed(range(1, 12))[:2] == [(2, 3), (4, 5)]


def halves(spark, count=8):
    rng = np.random.default_rng(6)
    rows = []
    for k in range(count):
        data = bytearray(rng.integers(0, 256, W // 2 * 3 * (H // 2), dtype=np.uint8).tobytes())
        data[:3] = bytes([k % 256, (k // 2 + 1) % 4, 0xAA if k % 2 else 0x55])
        rows.append((k, "rgb", "u8", W // 2, H // 2, True, True, 48.0, data))
    return spark.createDataFrame(rows, fr.SCHEMA)


def test_split_after_join_gives_the_halves_back(spark):
    given = halves(spark)
    back = kernels.split_rows(kernels.join_rows(given))
    assert {r["frame_no"]: bytes(r["data"]) for r in back.collect()} == {r["frame_no"]: bytes(r["data"]) for r in given.collect()}
    whole = kernels.join_rows(given).first()
    assert (whole["kind"], whole["elem"], whole["width"], whole["height"], whole["fps"]) == ("raw", "p12", W, H, 24.0)


def streamed(spark, frames, transform, tmp_path, schema):
    folder = str(tmp_path / "in")
    for low in (0, 3, 5):
        high = {0: 3, 3: 5, 5: 99}[low]
        frames.where(f"frame_no >= {low} and frame_no < {high}").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(folder)
    query = transform(stream).writeStream.format("memory").queryName("t" + tmp_path.name.replace("-", "_")).outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    return spark.table("t" + tmp_path.name.replace("-", "_")).collect()


def test_stream_of_halves_equals_batch(spark, tmp_path):
    given = halves(spark).where("frame_no <> 3").selectExpr("'cam' as stream", "frame_no", "height", "data")
    rows = streamed(spark, given, streaming.stream_pairs, tmp_path, given.schema)
    batch = kernels.join_rows(halves(spark).where("frame_no <> 3")).collect()
    assert {r["frame_no"]: bytes(r["data"]) for r in rows} == {r["frame_no"]: bytes(r["data"]) for r in batch}


def test_stream_average_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(7)
    frames = spark.createDataFrame([(k, "raw", "p12", W, H, True, True, 24.0, bytearray(fr.packed(rng.integers(0, 4096, (H, W)), "p12"))) for k in range(7)], fr.SCHEMA)
    given = frames.selectExpr("'cam' as stream", "frame_no", "data")
    rows = streamed(spark, given, lambda s: streaming.stream_average(s, 3), tmp_path, given.schema)
    batch = {r["frame_no"]: np.frombuffer(r["data"], "<f4") for r in kernels.average(frames, 3)[0].collect()}
    assert len(rows) == 2
    for r in rows:
        assert np.allclose(np.frombuffer(r["mean"], "<f4"), batch[r["frame_no"]])

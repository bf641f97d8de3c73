"""Packed-frame kernels against the pixel form, and properties of both."""

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from bayerloom import frames as fr
from bayerloom import kernels, operators
from bayerloom.functions import packing
from bayerloom.operators.rownoise import HalfModel, RowNoiseModel, pair_lag

W, H = 20, 10


def made(spark, elem="p12", seed=1, count=3, first_col=True, first_row=True):
    rng = np.random.default_rng(seed)
    high = {"u8": 256, "p12": 4096, "u16": 65536}[elem]
    rows = [(k, "raw", elem, W, H, first_col, first_row, 24.0, bytearray(fr.packed(rng.integers(0, high, (H, W)), elem))) for k in range(count)]
    return spark.createDataFrame(rows, fr.SCHEMA)


def made_rgb(spark, seed=2):
    rng = np.random.default_rng(seed)
    rows = [(k, "rgb", "u8", W, H, True, True, 24.0, bytearray(rng.integers(0, 256, (H, W, 3), dtype=np.uint8).tobytes())) for k in range(2)]
    return spark.createDataFrame(rows, fr.SCHEMA)


def same(a, b):
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*a.columns).collect()))


@given(st.lists(st.integers(0, 4095), max_size=60))
def test_unpack_after_pack_is_the_identity(samples):
    assert packing.unpack12(packing.pack12(np.array(samples, np.uint16)))[: len(samples)].tolist() == samples


@pytest.mark.parametrize("phase", [(True, True), (True, False), (False, True), (False, False)])
def test_debayer_forms_agree_in_every_phase(spark, phase):
    frames = made(spark, "u8", first_col=phase[0], first_row=phase[1])
    same(fr.pixels(kernels.debayer(frames)), operators.debayer(fr.pixels(frames), W, *phase))
    same(fr.pixels(kernels.debayer_half(frames)), operators.debayer_half(fr.pixels(frames), *phase))


def test_flat_debayer_is_flat(spark):
    frames = spark.createDataFrame([(0, "raw", "u8", 4, 4, True, True, 24.0, bytearray([80] * 16))], fr.SCHEMA)
    inner = fr.pixels(kernels.debayer(frames)).where("x in (1, 2) and y in (1, 2)").collect()
    assert {(r["r"], r["g"], r["b"]) for r in inner} == {(80, 80, 80)}


def test_depth(spark):
    frames = made(spark)
    same(fr.pixels(kernels.bit_depth(frames, 8)), operators.bit_depth(fr.pixels(frames), 12, 8))
    same(fr.pixels(kernels.bit_depth(frames, 16)), fr.pixels(frames))
    with pytest.raises(ValueError):
        operators.bit_depth(fr.pixels(frames), 8, 12)


@pytest.mark.parametrize("model", ["internal:mean", "internal:only_green", "random"])
@pytest.mark.parametrize("phase", [(True, True), (False, True)])
def test_row_noise_forms_agree(spark, model, phase):
    rng = np.random.default_rng(3)
    if model == "random":
        chosen = RowNoiseModel(*[HalfModel(rng.normal(size=(2, 2)).tolist(), (rng.normal(size=(3, 2, 16)) / 20).tolist(), 0.5) for _ in range(2)])
    else:
        chosen = operators.load_model(model)
    frames = made(spark, "u16", first_col=phase[0], first_row=phase[1])
    for strip in (False, True):
        same(fr.pixels(kernels.row_noise(frames, chosen, strip)), operators.remove_row_noise(fr.pixels(frames), W, H, chosen, strip, *phase))


def test_dark_pairs_come_in_order():
    assert [pair_lag(i) for i in range(5)] == [0, -1, 1, -2, 2]


def test_trained_model_lowers_row_noise(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(12):
        noise = rng.normal(0, 6, H)[:, None]
        rows.append((k, "raw", "u16", W, H, True, True, 24.0, bytearray(fr.packed(np.clip(np.round(128 + noise + rng.normal(0, 0.5, (H, W))), 0, 65535), "u16"))))
    px = fr.pixels(spark.createDataFrame(rows, fr.SCHEMA))
    model = operators.train_model(px, W, H, lags=1, pairs=1)
    out = operators.remove_row_noise(px, W, H, model, strip_dark_columns=True).toPandas()
    before = px.where("x between 8 and 11 and y between 1 and 8").toPandas().groupby(["frame_no", "y"])["v"].mean().std()
    after = out[out["y"].between(1, 8)].groupby(["frame_no", "y"])["v"].mean().std()
    assert after < before / 3


def test_model_files_with_tags_are_read_as_plain_data(tmp_path):
    path = tmp_path / "model.yml"
    path.write_text("!!python/object:__main__.A\nweights_even: !!python/object:__main__.B\n  green_diff_weights:\n  - - 1.5\n    - 2\n  offset: 3\nweights_odd:\n  dark_col_row_weights:\n")
    model = operators.load_model(str(path))
    assert model.even.green == [[1.5, 2]] and model.even.offset == 3 and model.odd.dark == [] and model.uncorrectable == 1


def test_average_forms_agree_and_skip_gaps(spark):
    frames = made(spark, count=7).where("frame_no <> 2")
    mean, variance = kernels.average(frames, 3)
    p = operators.average(fr.pixels(frames), 3, std=True)
    b = {(r["frame_no"], r["y"], r["x"]): r["v"] for r in fr.pixels(mean).collect()}
    s = {(r["frame_no"], r["y"], r["x"]): r["v"] for r in fr.pixels(variance).collect()}
    rows = p.collect()
    assert len(rows) == len(b) == 2 * W * H
    for r in rows:
        key = r["frame_no"], r["y"], r["x"]
        assert b[key] == pytest.approx(r["v"], rel=1e-6) and s[key] == pytest.approx(r["var"], rel=1e-5, abs=0.5)


def test_average_of_one_is_the_frame(spark):
    px = fr.pixels(made(spark))
    out = operators.average(px, 1, std=True, dense=True)
    assert out.where("var <> 0").isEmpty()
    same(px, out.withColumn("v", out["v"].cast("int")).drop("var"))


def test_histogram_counts_every_pixel(spark):
    frames = made(spark)
    counts = {r["frame_no"]: r["n"] for r in operators.histogram(fr.pixels(frames)).groupBy("frame_no").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()}
    assert set(counts.values()) == {W * H}
    b = fr.pixels(kernels.histogram(frames)).where("v > 0").selectExpr("frame_no", "x as bin", "cast(v as long) as n")
    same(b, operators.histogram(fr.pixels(frames)))


def test_dark_frame_is_added_to_the_pedestal_and_clamped(spark):
    frames = made(spark)
    px = fr.pixels(frames)
    plane = np.random.default_rng(5).uniform(0, 4000, (H, W))
    dark = spark.createDataFrame([(y, x, float(plane[y, x])) for y in range(H) for x in range(W)], "y int, x int, dark double")
    same(fr.pixels(kernels.darkframe_subtract(frames, plane)), operators.darkframe_subtract(px, dark, W * H))
    same(operators.darkframe_subtract(px, dark), operators.darkframe_subtract(px, dark, W * H))


def test_colour_forms_agree(spark):
    frames = made_rgb(spark)
    same(fr.pixels(kernels.color_voodoo(frames, 16, 1.3, 0.7)), operators.color_voodoo(fr.pixels(frames), 16, 1.3, 0.7))
    with pytest.raises(ValueError):
        operators.color_voodoo(fr.pixels(frames), pedestal=300)


def test_cubes(spark):
    from bayerloom.plans.fixtures import cube_text

    frames = made_rgb(spark)
    cube = operators.parse_cube(cube_text())
    for mode in ("reference", "exact"):
        same(fr.pixels(kernels.apply_cube(frames, cube, mode)), operators.apply_cube(fr.pixels(frames), cube, mode))
    for bad in ("LUT_3D_SIZE 2\n0 0 0", "", "LUT_3D_SIZE 1\n-1 0 0"):
        with pytest.raises(ValueError):
            operators.parse_cube(bad)


@pytest.mark.parametrize("control,tolerance", [("abs", 3.0), ("rel", 0.01), ("psnr", 40.0), ("l2norm", 200.0), ("abs", 0.0)])
def test_compression_keeps_its_bound(spark, control, tolerance):
    frames = made(spark, "u16")
    back = kernels.decompress(kernels.compress(frames, tolerance, control))
    for a, b in zip(frames.orderBy("frame_no").collect(), back.orderBy("frame_no").collect(), strict=True):
        v, w = (fr.array_of(r.asDict()).astype(float) for r in (a, b))
        error = np.abs(v - w)
        span = v.max() - v.min()
        assert {"abs": error.max() <= tolerance, "rel": error.max() <= tolerance * span, "l2norm": np.sqrt((error**2).sum()) <= tolerance + W * H, "psnr": 20 * np.log10(span / max(np.sqrt((error**2).mean()), 1e-9)) >= tolerance - 0.5}[control]
    with pytest.raises(ValueError):
        kernels.compress(frames, 1.0, "nearly")


def test_outputs_are_split(spark):
    out = operators.average(fr.pixels(made(spark)), 3, std=True)
    with pytest.raises(IndexError):
        operators.split(out, ["v", "var"], 2)

"""What keeps plans whole at real sizes: ranges, bands, pushed filters, composed states, committed files, tables of colours."""

import os
import random
import zlib

import numpy as np
import pytest

from bayerloom import frames as fr
from bayerloom import kernels, numbering, operators, sinks, sources
from bayerloom.operators import dual
from bayerloom.plans.fixtures import cube_text
from bayerloom.sinks import placed
from bayerloom.sources.raw import NumberFilter, seek_table

W, H = 20, 10
INTERPRETATION = fr.Interpretation(W, H, 12)


def some_frames(spark, count=12, elem="p12", seed=1, parts=3):
    rng = np.random.default_rng(seed)
    high = {"u8": 256, "p12": 4096, "u16": 65536}.get(elem)
    data = [rng.integers(0, high, (H, W)) if high else rng.normal(1000, 3, (H, W)) for _ in range(count)]
    rows = [(k, "raw", elem, W, H, True, True, 24.0, bytearray(fr.packed(v, elem))) for k, v in enumerate(data)]
    return spark.createDataFrame(rows, fr.SCHEMA).repartition(parts)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def contents(df):
    return {r["frame_no"]: bytes(r["data"]) for r in df.collect()}


# --- numbers ----------------------------------------------------------------


@pytest.mark.parametrize("range_rows", [7, 1 << 20])
def test_numbers_previous_values_and_places_over_ranges(spark, range_rows):
    rng = random.Random(1)
    values = rng.sample(range(-500, 500), 200)
    rows = spark.createDataFrame([(v, abs(v) % 9) for v in values], "k long, size long").repartition(5)
    numbers, n = numbering.numbered(rows, "k", "number", range_rows)
    assert n == 200 and [(r["k"], r["number"]) for r in numbers.orderBy("number").collect()] == [(v, i) for i, v in enumerate(sorted(values))]
    before = numbering.with_previous(rows, "k", "before", range_rows)
    assert [(r["k"], r["before"]) for r in before.orderBy("k").collect()] == list(zip(sorted(values), [None, *sorted(values)], strict=False))
    places, n, total = numbering.placed_sizes(rows, "k", "size", range_rows)
    place = 0
    for r in places.orderBy("number").collect():
        assert (r["place"], r["k"]) == (place, sorted(values)[r["number"]])
        place += r["size"]
    assert total == place
    empty = rows.where("false")
    assert numbering.numbered(empty, "k", "number", range_rows)[0].collect() == [] and numbering.with_previous(empty, "k", "before").collect() == []


def test_texts_are_numbered_too(spark):
    names = [f"{k % 7}/{k:03d}" for k in range(100)]
    numbers, _ = numbering.numbered(spark.createDataFrame([(n,) for n in names], "path string"), "path", "frame_no", 11)
    assert [r["path"] for r in numbers.orderBy("frame_no").collect()] == sorted(names)


def test_no_window_spans_all_frames(spark):
    frames = some_frames(spark).where("frame_no <> 5")
    for df in (operators.count_windows(frames, 3), operators.sequence_gaps(frames)):
        assert "Window" not in (plan := df._jdf.queryExecution().optimizedPlan().toString()) or "[part#" in plan


# --- averages by bands ------------------------------------------------------


@pytest.mark.parametrize("elem", ["u8", "p12", "u16", "f32"])
@pytest.mark.parametrize("band, parts", [(64, 5), (1 << 16, 1)])
def test_bands_average_as_all_frames_do(spark, elem, band, parts):
    """Many frames a task (sums), few (their own samples), and both in one window."""
    frames = some_frames(spark, 24, elem, parts=parts)
    mean, variance = kernels.average(frames, 12, band_samples=band)
    data = {k: fr.array_of(r.asDict()).astype(np.float64) for k, r in ((r["frame_no"], r) for r in frames.collect())}
    for got, expected in ((mean, np.mean), (variance, np.var)):
        rows = {r["frame_no"]: fr.array_of(r.asDict()) for r in got.collect()}
        assert sorted(rows) == [0, 1]
        for k, plane in rows.items():
            assert plane.shape == (H, W)
            assert np.allclose(plane, expected([data[j] for j in range(12 * k, 12 * k + 12)], axis=0), rtol=1e-6, atol=1e-4)
    bands = kernels.average_bands(frames, 12, band_samples=band)
    assert bands.count() == 2 * -(-W * H // band)
    assert max(len(r["mean"]) for r in bands.collect()) <= 4 * band


def test_a_task_sends_what_is_smaller(spark):
    import pyarrow as pa

    size = len(fr.packed(np.zeros((H, W)), "p12"))
    row = {"kind": "raw", "elem": "p12", "width": W, "height": H, "red_in_first_col": True, "red_in_first_row": True, "fps": 24.0, "data": bytes(size), "window": 0}
    schema = pa.schema([("window", pa.int64()), ("band", pa.int32()), ("elem", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("red_in_first_col", pa.bool_()), ("red_in_first_row", pa.bool_()), ("fps", pa.float64()), ("n", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])
    for count, expected in ((2, [0, 0]), (40, [40])):
        batch = pa.RecordBatch.from_pylist([row | {"frame_no": k} for k in range(count)])
        sent = [r for out in kernels._band_rows([batch], 100, True, 1 << 16, schema) for r in out.to_pylist()]
        assert [r["n"] for r in sent] == expected
        assert sum(len(r["a"]) + len(r["b"] or b"") for r in sent) <= count * size


def test_frames_of_other_sizes_are_an_error(spark):
    odd = spark.createDataFrame([(1, "raw", "u8", 2, 2, True, True, 24.0, bytearray(4))], fr.SCHEMA)
    with pytest.raises(Exception, match="size"):
        kernels.average(some_frames(spark, 1, "u8").unionByName(odd), 2)[0].collect()


# --- pushed filters ---------------------------------------------------------


def test_a_blob_reads_what_filters_leave(spark, tmp_path):
    path = str(tmp_path / "b")
    frames = some_frames(spark, 50)
    sinks.write_blob(frames, path)
    given, size = contents(frames), INTERPRETATION.frame_bytes
    assert contents(sources.read_blob(spark, path, INTERPRETATION, push_filters=True)) == given
    raw = spark.read.format("raw_blob").option("filters", "true").option("path", path).option("frame_bytes", size).option("span_bytes", 4 * size).load()
    for condition, parts, numbers in (
        ("frame_no >= 0", 13, range(50)), ("frame_no = 7", 1, [7]), ("frame_no < 5", 2, range(5)), ("frame_no > 40 and frame_no <= 44", 1, range(41, 45)), ("frame_no in (3, 4, 30)", 2, [3, 4, 30]),
        ("frame_no in (3, 4, 30) and frame_no < 10", 1, [3, 4]), ("frame_no = 99", 1, []), ("frame_no = 1 and frame_no = 2", 0, []), ("frame_no % 10 = 0", 13, range(0, 50, 10)), ("null = frame_no", 0, []),
    ):
        chosen = raw.where(condition)
        assert contents(chosen) == {k: given[k] for k in numbers}, condition
        assert chosen.rdd.getNumPartitions() == parts, condition


def test_filters_go_before_steps_that_keep_numbers(spark, tmp_path):
    path = str(tmp_path / "b")
    sinks.write_blob(some_frames(spark, 20), path)
    size = INTERPRETATION.frame_bytes
    with open(path, "rb") as file:
        data = file.read()
    read = fr.tolerant(sources.read_blob(spark, path, INTERPRETATION))
    seen = spark.sparkContext.accumulator(0)

    def counted(row):
        seen.add(1)
        return [row]

    steps = kernels.bit_depth(fr.map_frames(read, counted), 8)
    one = fr.chosen(steps, 4, 5).collect()
    assert [r["frame_no"] for r in one] == [4] and seen.value == 1
    assert bytes(one[0]["data"]) == (fr.array_of({"data": data[4 * size : 5 * size], "elem": "p12", "kind": "raw", "width": W, "height": H}) >> 4).astype(np.uint8).tobytes()
    assert operators.number_of_frames(steps, 3).count() == 3 and seen.value == 4
    sinks.preview(steps, 2)
    assert seen.value == 5
    # a step that renumbers, and frames that are cached, are filtered where they are
    assert fr.chosen(kernels.split_rows(read), 0, 3).count() == 3
    assert contents(fr.chosen(read.persist(), 0, 2)) == {k: data[k * size : (k + 1) * size] for k in range(2)}
    read.unpersist()
    # several choices in one query
    both = fr.chosen(steps, 3, 4).unionByName(fr.chosen(steps, 10)).unionByName(steps)
    assert sorted(r["frame_no"] for r in both.collect()) == sorted([3, *range(10, 20), *range(20)])


def test_spans_are_those_numbers():
    f = NumberFilter()
    assert f.spans(10, 4) == [(0, 4), (4, 8), (8, 10)]
    f.only, f.low = {1, 2, 3, 5, 9, 12, -4}, 2
    assert f.spans(10, 2) == [(2, 4), (5, 6), (9, 10)]


# --- half frames ------------------------------------------------------------


def headers_with_losses(seed, count=400):
    rng = random.Random(seed)
    out = []
    for k in range(count):
        if rng.random() < 0.08:
            continue
        marker = 0xAA if k % 2 else 0x55
        if rng.random() < 0.03:
            marker = rng.choice((0xAA, 0x55, 0))
        out.append((k, k % 256 if rng.random() > 0.03 else rng.randrange(256), (k // 2 + 1) % 4 if rng.random() > 0.03 else rng.randrange(256), marker))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_composed_states_pair_as_one_pass_does(spark, seed):
    headers = headers_with_losses(seed)
    state = dual.PairState()
    expected = [pair for h in headers if (pair := state.feed(h))]
    rows = spark.createDataFrame(headers, "half_no long, counter int, buffer int, marker int").repartition(5)
    for range_rows in (23, 1 << 20):
        assert sorted(tuple(r) for r in operators.pair_halves(rows, range_rows).collect()) == expected


@pytest.mark.parametrize("seed", range(6))
def test_state_maps_compose(seed):
    headers = headers_with_losses(seed + 10)
    rng = random.Random(seed)
    for _ in range(20):
        at = rng.randrange(1, len(headers) - 1)
        found = dual.state_map(headers[at:], headers[at - 1])
        for code in range(dual.STATES):
            state = dual.PairState.of(code, headers[at - 1])
            for header in headers[at:]:
                state.feed(header)
            assert found[code] == (state.code, state.number)


def test_halves_are_shuffled_once_and_no_task_orders_all(spark, monkeypatch):
    rows = []
    for k in range(16):
        data = bytearray(random.Random(k).randbytes(W // 2 * 3 * (H // 2)))
        data[:3] = bytes([k, (k // 2 + 1) % 4, 0xAA if k % 2 else 0x55])
        rows.append((k, "rgb", "u8", W // 2, H // 2, True, True, 48.0, data))
    halves = spark.createDataFrame(rows, fr.SCHEMA)
    expected = contents(kernels.join_rows(halves))
    plan = kernels.join_rows(halves)._jdf.queryExecution().executedPlan().toString()
    assert [line for line in plan.splitlines() if "Exchange hashpartitioning(__number" in line] and "SinglePartition" not in plan
    monkeypatch.setattr(kernels, "BROADCAST_HALVES", 0)
    assert contents(kernels.join_rows(halves)) == expected and len(expected) == 8
    lost = fr.tolerant(halves).selectExpr("*").withColumn("error", halves["frame_no"].cast("string").substr(1, 0))
    assert kernels.join_rows(lost.where("false")).count() == 0
    assert kernels.join_rows(fr.tolerant(halves)).columns == [*fr.COLUMNS, "error"]


# --- committed files --------------------------------------------------------


def failing(frames):
    def work(row):
        if row["frame_no"] == 9:
            raise ValueError("broken")
        return [row]

    return fr.map_frames(frames, work)


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    frames = failing(some_frames(spark))
    for write, name in ((sinks.write_blob, "blob"), (sinks.write_directory, "raw"), (sinks.write_dng, "dng"), (lambda f, p: sinks.write_blob(f, p, compression="zstd"), "zst")):
        folder = tmp_path / name
        with pytest.raises(Exception, match="broken"):
            write(frames, str(folder / "out"))
        assert not folder.exists() or os.listdir(folder) == []


def test_gaps_are_written_in_place_and_reported(spark, tmp_path):
    frames = some_frames(spark)
    given = contents(frames)
    kept = [k for k in range(12) if k != 9]
    for compression, read in ((None, sources.read_blob), ("zstd", sources.read_zstd)):
        path = str(tmp_path / f"gaps.{compression}")
        written = sinks.write_blob(failing(fr.tolerant(frames)), path, compression=compression)
        assert (written, written.skipped) == (11, 1)
        assert contents(read(spark, path, INTERPRETATION)) == {k: given[n] for k, n in enumerate(kept)}
    at_end = fr.tolerant(frames).where("frame_no <= 9")
    assert (n := sinks.write_blob(failing(at_end), str(tmp_path / "end"))) == 9 and n.skipped == 1
    folder = sinks.write_directory(failing(fr.tolerant(frames)), str(tmp_path / "raw"))
    assert (folder, folder.skipped) == (11, 1) and sorted(os.listdir(tmp_path / "raw")) == [f"{k:06d}.data" for k in kept]
    assert [p.name for p in tmp_path.iterdir() if "part" in p.name or "report" in p.name] == []


def test_frames_of_several_sizes_come_in_order(spark, tmp_path):
    rows = [(k * 3, "raw", "ebc", 4, 4, True, True, 24.0, bytearray([k] * (k % 5))) for k in range(30)]
    sinks.write_blob(spark.createDataFrame(rows, fr.SCHEMA).repartition(4), str(tmp_path / "mixed"))
    assert (tmp_path / "mixed").read_bytes() == b"".join(bytes(r[8]) for r in rows)
    assert sinks.write_blob(spark.createDataFrame([], fr.SCHEMA), str(tmp_path / "none"), compression="zstd") == 0


def test_earlier_frames_go_when_the_new_ones_are_there(spark, tmp_path):
    folder, frames = tmp_path / "dng", some_frames(spark)
    sinks.write_dng(frames, str(folder))
    with pytest.raises(FileExistsError):
        sinks.write_dng(frames, str(folder))
    with pytest.raises(Exception, match="broken"):
        sinks.write_dng(failing(frames), str(folder), replace=True)
    assert len(os.listdir(folder)) == 12
    assert sinks.write_dng(frames.where("frame_no < 3"), str(folder), replace=True) == 3 and len(os.listdir(folder)) == 3
    (folder / "notes").write_text("mine")
    with pytest.raises(FileExistsError):
        sinks.write_dng(frames, str(folder), replace=True)


def test_an_attempt_that_is_repeated_writes_the_same(tmp_path):
    import pyarrow as pa

    writer = placed._PlacedWriter({"path": str(tmp_path / "a"), "part": str(tmp_path / "a.part"), "report": str(tmp_path / "r")})
    batch = pa.RecordBatch.from_pydict({"place": [3, 0], "data": [b"def", b"abc"]})
    done = [writer.write(iter([batch])) for _ in range(2)]
    writer.commit(done[:1])
    assert (tmp_path / "a").read_bytes() == b"abcdef" and (tmp_path / "r").read_text() == "[2, 0]"
    writer.write(iter([batch]))
    writer.abort([])
    assert (tmp_path / "a").read_bytes() == b"abcdef" and not (tmp_path / "a.part").exists()


# --- seekable files ---------------------------------------------------------


def test_compressed_parts_are_read_side_by_side(spark, tmp_path):
    import zstandard

    path, frames = str(tmp_path / "a.zst"), some_frames(spark, 30)
    assert sinks.write_blob(frames, path, compression="zstd") == 30
    given, size = contents(frames), INTERPRETATION.frame_bytes
    assert len(seek_table(path)) == 30
    with open(path, "rb") as file:  # any reader of the format takes it
        assert zstandard.ZstdDecompressor().stream_reader(file, read_across_frames=True).read() == b"".join(given[k] for k in range(30))
    assert contents(sources.read_zstd(spark, path, INTERPRETATION, push_filters=True)) == given
    raw = spark.read.format("zstd_blob").option("filters", "true").option("path", path).option("frame_bytes", size).option("span_bytes", 4 * size).load()
    assert contents(raw) == given and raw.rdd.getNumPartitions() == 8
    assert contents(raw.where("frame_no in (5, 6, 20)")) == {k: given[k] for k in (5, 6, 20)} and raw.where("frame_no = 5").rdd.getNumPartitions() == 1
    # frames that don't begin where compressed ones do
    odd = spark.read.format("zstd_blob").option("path", path).option("frame_bytes", 77).option("span_bytes", 500).load()
    every = b"".join(given[k] for k in range(30))
    assert contents(odd) == {k: every[77 * k : 77 * k + 77] for k in range(len(every) // 77)}


def test_a_stream_without_a_table_is_read_from_its_beginning(spark, tmp_path):
    import zstandard

    frames = some_frames(spark, 9)
    given = contents(frames)
    (tmp_path / "s").write_bytes(zstandard.ZstdCompressor().compress(b"".join(given[k] for k in range(9)) + b"rest"))
    read = sources.read_zstd(spark, str(tmp_path / "s"), INTERPRETATION)
    assert seek_table(str(tmp_path / "s")) is None and contents(read) == given
    assert contents(read.where("frame_no in (2, 5)")) == {k: given[k] for k in (2, 5)}


# --- ordered pull -----------------------------------------------------------


def test_frames_are_pulled_in_order_a_few_at_a_time(spark):
    frames = some_frames(spark, 15, parts=4)
    given = contents(frames)
    for look_ahead in (1, 1000, 1 << 20):
        assert list(fr.pull_ordered(frames.where("frame_no <> 6"), look_ahead)) == [(k, given[k]) for k in range(15) if k != 6]
    assert list(fr.pull_ordered(frames.where("false"))) == []


# --- colours and compression ------------------------------------------------


@pytest.mark.parametrize("step", ["reference", "exact", "voodoo"])
def test_tables_equal_direct_work(spark, step):
    rng = np.random.default_rng(3)
    image = np.concatenate([rng.integers(0, 256, (200, 400, 3)), np.repeat(rng.integers(0, 256, (200, 400, 1)), 3, axis=2)]).astype(np.uint8)
    given = spark.createDataFrame([(0, "rgb", "u8", 400, 400, True, True, 24.0, bytearray(image.tobytes()))], fr.SCHEMA)
    rows = spark.createDataFrame([(k, "rgb", "u8", 400, 20, True, True, 24.0, bytearray(image[20 * k : 20 * k + 20].tobytes())) for k in range(20)], fr.SCHEMA)
    cube = operators.parse_cube(cube_text(9))
    work = (lambda f: kernels.color_voodoo(f, 20, 1.3, 0.6)) if step == "voodoo" else lambda f: kernels.apply_cube(f, cube, step)
    assert bytes(work(given).first()["data"]) == b"".join(contents(work(rows))[k] for k in range(20))


def test_prediction_in_two_dimensions_is_smaller(spark):
    y, x = np.mgrid[:100, :120]
    image = np.clip(2000 + 700 * np.sin(x / 20) + 600 * np.cos(y / 15) + np.random.default_rng(4).normal(0, 2, (100, 120)), 0, 4095).astype(np.uint16) * (1 + (x + y) % 2).astype(np.uint16)
    frames = spark.createDataFrame([(0, "raw", "u16", 120, 100, True, True, 24.0, bytearray(image.astype("<u2").tobytes()))], fr.SCHEMA)
    out = kernels.compress(frames, 2.0)
    along_one_axis = len(zlib.compress(np.diff((image.astype(np.int64) + 2) // 5, axis=-1, prepend=0).astype("<i8").tobytes(), 3))
    assert len(out.first()["data"]) < 0.6 * along_one_axis
    assert np.abs(fr.array_of(kernels.decompress(out).first().asDict()).astype(int) - image).max() <= 2


@pytest.mark.parametrize("shape", [(1,), (9,), (4, 7), (3, 5, 2), (0,)])
def test_residues_go_back(shape):
    coded = np.random.default_rng(5).integers(-(1 << 60), 1 << 60, shape)
    for lag in (1, 2):
        for axes in ([len(shape) - 1], list(range(len(shape)))):
            with np.errstate(over="ignore"):
                width, body = kernels._coded_bytes(kernels._residues(coded, axes, lag))
                assert (kernels._from_residues(kernels._decoded_residues(body, width, shape), axes, lag) == coded).all()




# --- streams that are started again -----------------------------------------


def in_two_runs(spark, frames, cuts, transform, tmp_path):
    """What a stream gives over two runs with one checkpoint, the second with the frames from `cuts` on."""
    folder = f"{tmp_path}/in"
    low, high = cuts
    for part in (f"frame_no < {low}", f"frame_no >= {low} and frame_no < {high}", f"frame_no >= {high}"):
        frames.where(part).coalesce(1).write.mode("append").parquet(folder)
        given = spark.readStream.schema(frames.schema).parquet(folder)
        transform(given).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{tmp_path}/out")


def test_an_average_goes_on_in_the_middle_of_a_window(spark, tmp_path):
    from bayerloom import streaming

    frames = some_frames(spark, 11)
    made = in_two_runs(spark, frames.selectExpr("'a' as stream", "frame_no", "data"), (2, 6), lambda s: streaming.stream_average(s, 4), tmp_path)
    mean, variance = kernels.average(frames, 4)
    assert {r["frame_no"]: (bytes(r["mean"]), bytes(r["var"])) for r in made.collect()} == {k: (v, contents(variance)[k]) for k, v in contents(mean).items()}


def test_pairing_goes_on_with_a_held_half(spark, tmp_path):
    from bayerloom import streaming

    rows = []
    for k in range(18):
        data = bytearray(random.Random(k).randbytes(W // 2 * 3 * (H // 2)))
        data[:3] = bytes([k, (k // 2 + 1) % 4, 0xAA if k % 2 else 0x55])
        rows.append((k, "rgb", "u8", W // 2, H // 2, True, True, 48.0, data))
    halves = spark.createDataFrame(rows, fr.SCHEMA).where("frame_no <> 8")
    made = in_two_runs(spark, halves.selectExpr("'a' as stream", "frame_no", "height", "data"), (5, 10), streaming.stream_pairs, tmp_path)
    assert contents(made) == contents(kernels.join_rows(halves))


def in_one_batch(spark, frames, transform, tmp_path):
    """What a stream gives of one batch that comes in many small tables, in no order."""
    frames.repartition(5).write.parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        given = spark.readStream.schema(frames.schema).parquet(f"{tmp_path}/in")
        transform(given).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    return spark.read.parquet(f"{tmp_path}/out")


def test_an_average_takes_a_large_batch_in_order(spark, tmp_path):
    from bayerloom import streaming

    frames = some_frames(spark, 41)
    made = in_one_batch(spark, frames.selectExpr("'a' as stream", "frame_no", "data"), lambda s: streaming.stream_average(s, 4), tmp_path)
    mean, variance = kernels.average(frames, 4)
    assert {r["frame_no"]: (bytes(r["mean"]), bytes(r["var"])) for r in made.collect()} == {k: (v, contents(variance)[k]) for k, v in contents(mean).items()}


def test_pairing_takes_a_large_batch_in_order(spark, tmp_path):
    from bayerloom import streaming

    rows = []
    for k in range(40):
        data = bytearray(random.Random(k).randbytes(W // 2 * 3 * (H // 2)))
        data[:3] = bytes([k, (k // 2 + 1) % 4, 0xAA if k % 2 else 0x55])
        rows.append((k, "rgb", "u8", W // 2, H // 2, True, True, 48.0, data))
    halves = spark.createDataFrame(rows, fr.SCHEMA).where("frame_no <> 8")
    made = in_one_batch(spark, halves.selectExpr("'a' as stream", "frame_no", "height", "data"), streaming.stream_pairs, tmp_path)
    assert contents(made) == contents(kernels.join_rows(halves))


@pytest.mark.parametrize("held", [1, 64 << 20])
def test_order_is_the_same_in_memory_and_in_a_file(monkeypatch, held):
    import pandas as pd

    from bayerloom.streaming import stateful

    monkeypatch.setattr(stateful, "HELD_BYTES", held)
    numbers = random.Random(3).sample(range(50), 50)
    tables = [pd.DataFrame({"frame_no": part, "data": [bytes([k] * (k + 1)) for k in part]}) for part in (numbers[:20], numbers[20:23], numbers[23:])]
    assert [(r["frame_no"], r["data"]) for r in stateful._in_order(iter(tables))] == [(k, bytes([k] * (k + 1))) for k in range(50)]


def test_a_replay_sends_no_frames_through_the_driver(spark):
    from bayerloom import sources

    frames = some_frames(spark, 12).persist()
    frames.count()
    query = sources.replay(spark, frames, 12, frames_per_second=50).writeStream.format("memory").queryName("replayed").start()
    try:
        while spark.table("replayed").count() < 24 and not query.awaitTermination(0.5):
            pass
        plan = query._jsq.explainInternal(False)
    finally:
        query.stop()
        frames.unpersist()
    assert "ShuffledHashJoin" in plan and "Broadcast" not in plan
    given = contents(frames)
    rows = spark.table("replayed").where("frame_no < 24").collect()
    assert sorted(r["frame_no"] for r in rows) == list(range(24)) and all(bytes(r["data"]) == given[r["frame_no"] % 12] for r in rows)


def test_dense_histograms_hold_no_zeros(spark):
    px = spark.createDataFrame([(0, 0, 0, 5), (0, 0, 1, 5), (0, 0, 2, 4095), (1, 0, 0, 0), (2, 0, 0, 4096), (2, 0, 1, -1), (3, 0, 0, None), (4, 0, 0, None), (4, 0, 1, 7)], "frame_no long, y int, x int, v int")
    dense = operators.histogram(px, dense=True)
    rows = dense.collect()
    assert sorted((r["frame_no"], r["bin"]) for r in rows) == [(f, b) for f in range(5) for b in range(4096)]
    assert {(r["frame_no"], r["bin"]): r["n"] for r in rows if r["n"]} == {(0, 5): 2, (0, 4095): 1, (1, 0): 1, (4, 7): 1}
    lines = plan(dense).splitlines()
    generated = next(k for k, line in enumerate(lines) if "Generate" in line)
    assert not any(step in line for line in lines[:generated] for step in ("Exchange", "HashAggregate", "Sort"))  # nothing after the zeros are made


def test_successive_steps_share_a_python_worker(spark):
    frames = some_frames(spark, 6)
    depth = kernels.bit_depth(frames, 8)
    stepwise = fr.pixels(kernels.debayer(spark.createDataFrame(depth.collect(), depth.schema)), "rgb", "u8")
    fused = fr.pixels(kernels.debayer(depth), "rgb", "u8")
    assert plan(fused).count("MapInArrow") == 1
    assert sorted(map(tuple, fused.collect())) == sorted(map(tuple, stepwise.collect()))
    broken = fr.tolerant(frames).withColumn("data", fr.F.when(fr.F.col("frame_no") == 2, fr.F.substring("data", 1, 5)).otherwise(fr.F.col("data")))
    steps = kernels.debayer(kernels.bit_depth(broken, 8))
    assert [r["frame_no"] for r in fr.failures(steps).collect()] == [2]
    assert plan(fr.pixels(steps, "rgb", "u8")).count("MapInArrow") == 1
    assert {r["frame_no"] for r in fr.pixels(steps, "rgb", "u8").select("frame_no").distinct().collect()} == {0, 1, 3, 4, 5}
    depth.persist()
    try:
        cached = plan(fr.pixels(kernels.debayer(depth), "rgb", "u8"))
        assert "InMemoryTableScan" in cached
    finally:
        depth.unpersist()


def test_a_graph_has_one_python_worker_a_task(spark, tmp_path):
    from bayerloom import graph

    sinks.write_directory(some_frames(spark, 4), f"{tmp_path}/in")
    text = f"input: {{type: RawDirectoryReader, file-pattern: '{tmp_path}/in/*.data', width: {W}, height: {H}}}\ndepth: {{type: GpuBitDepthConverter, input: <input}}\nrgb: {{type: Debayer, input: <depth}}"
    rgb = graph.build(spark, graph.parse_yaml(text))["rgb"]
    assert plan(fr.pixels(rgb, "rgb")).count("MapInArrow") == 1 and rgb.count() == 4


# --- borders ----------------------------------------------------------------


@pytest.mark.parametrize("phase", [(True, True), (True, False), (False, True), (False, False)])
def test_clamped_borders_agree_in_every_phase(spark, phase):
    frames = some_frames(spark, 2, "u8").drop("red_in_first_col", "red_in_first_row").selectExpr("*", f"{phase[0]} as red_in_first_col", f"{phase[1]} as red_in_first_row").select(*fr.COLUMNS)
    a = fr.pixels(kernels.debayer(frames, "clamp"))
    b = operators.debayer(fr.pixels(frames), W, *phase, border="clamp", height=H)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*a.columns).collect()))
    with pytest.raises(ValueError):
        operators.debayer(fr.pixels(frames), W, border="clamp")
    flat = spark.createDataFrame([(0, "raw", "u8", 4, 4, *phase, 24.0, bytearray([80] * 16))], fr.SCHEMA)
    assert {tuple(r)[3:] for r in fr.pixels(kernels.debayer(flat, "clamp")).collect()} == {(80, 80, 80)}, "no dark edge"

"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

times into the noop sink; its figure is the mean, `std` has the sample
deviations. `frames` has the rates of packed-frame steps on large frames, by
the same protocol.
"""

from __future__ import annotations

import json
import os
import tempfile

import numpy as np
from pyspark.sql import SparkSession

from bayerloom import frames as fr
from bayerloom import kernels, operators, plans, sinks, sources
from bayerloom.plans import fixtures

QUERIES = ("debayer", "debayer_half", "debayer_frames", "darkframe_subtract", "histogram", "average_var", "rownoise_mean_model", "rownoise_only_green", "color_voodoo", "lut3d_reference", "dual_decode")
WIDE = ("wide_histogram", "wide_debayer")


def timed(make, rounds: int = 10) -> tuple[float, float]:
    report = sinks.benchmark(make(), rounds, count=0)
    return round(report["mean"], 3), round(report["std"], 3)


def noisy(spark: SparkSession, count: int, width: int, height: int, elem: str):
    """Frames of random samples, made on the executors and cached."""

    def make(row: dict) -> list[dict]:
        data = np.random.default_rng(row["frame_no"]).integers(0, 256, width * height * fr.BITS[elem] // 8, dtype=np.uint8)
        return [row | {"data": data.tobytes()}]

    empty = spark.range(0, count, 1, min(count, spark.sparkContext.defaultParallelism)).selectExpr("id as frame_no", "cast('' as binary) as data")
    frames = fr.map_frames(fr.raw_frames(empty, width, height, elem), make).persist()
    frames.count()
    return frames


def large_frames(spark: SparkSession, rounds: int = 10) -> dict:
    """Frames and pixels a second of 4096 x 3072 frames of 12 bits."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    out = {}

    def rate(name: str, df, count: int, size: int) -> None:
        report = sinks.benchmark(df, rounds, count)
        out[name] = {"fps": round(report["fps"], 2), "mpixel_per_s": round(report["fps"] * size / 1e6, 1), "std": round(report["std"], 3)}

    count, size = 16, 4096 * 3072
    frames = noisy(spark, count, 4096, 3072, "p12")
    rate("depth", kernels.bit_depth(frames, 8), count, size)
    rate("depth_half_debayer", kernels.debayer_half(kernels.bit_depth(frames, 8)), count, size)
    rate("histogram", kernels.histogram(frames), count, size)
    rate("average", kernels.average(frames, 8, std=False)[0], count, size)
    with tempfile.TemporaryDirectory() as folder:
        sinks.write_blob(frames, f"{folder}/blob")
        rate("read_depth", kernels.bit_depth(sources.read_blob(spark, f"{folder}/blob", fr.Interpretation(4096, 3072)), 8), count, size)
    rate("row_noise", kernels.row_noise(kernels.bit_depth(frames, 16), operators.load_model("internal:good")), count, size)
    frames.unpersist()
    rgb = kernels.debayer(kernels.bit_depth(noisy(spark, count, 4096, 3072, "p12"), 8)).persist()
    rgb.count()
    rate("lut3d", kernels.apply_cube(rgb, operators.parse_cube(fixtures.cube_text(17))), count, size)
    rate("color_voodoo", kernels.color_voodoo(rgb, 8, 0.8, 1.2), count, size)
    rgb.unpersist()
    return out


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    runs = {name: timed(lambda name=name: plans.QUERIES[name](spark, sf_dir)) for name in QUERIES}
    runs["wide_histogram"] = timed(lambda: operators.histogram(fixtures.wide(spark, sf_dir)))
    runs["wide_debayer"] = timed(lambda: operators.debayer(operators.bit_depth(fixtures.wide(spark, sf_dir), 12, 8), 64))
    frames = large_frames(spark)
    seconds, std = ({name: run[k] for name, run in runs.items()} for k in range(2))
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "std": std, "sf": sf_dir.rsplit("sf", 1)[-1], "frames": frames}))


if __name__ == "__main__":
    main()

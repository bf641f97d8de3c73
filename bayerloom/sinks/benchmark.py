"""Timing by full pulls into nothing, and the data of a histogram plot."""

from __future__ import annotations

import statistics
import time

from pyspark.sql import DataFrame

from ..frames import whole


def benchmark(frames: DataFrame, rounds: int = 10, count: int | None = None) -> dict:
    """One warm-up and `rounds` timed full pulls: mean, sample deviation, and frames a second. Of a stream, its rate."""
    frames = whole(frames)
    if frames.isStreaming:
        return stream_rate(frames)
    seconds = []
    for k in range(rounds + 1):
        began = time.perf_counter()
        frames.write.format("noop").mode("overwrite").save()
        if k:
            seconds.append(time.perf_counter() - began)
    count = frames.count() if count is None else count
    mean = statistics.fmean(seconds)
    return {"frames": count, "mean": mean, "std": statistics.stdev(seconds) if rounds > 1 else 0.0, "fps": count / mean}


def stream_rate(frames: DataFrame, seconds: float = 5.0) -> dict:
    """Run a stream into nothing for some seconds, or to its end; frames a second, in all and of each batch."""
    began = time.perf_counter()
    query = frames.writeStream.format("noop").start()
    try:
        query.awaitTermination(seconds)
        spent = time.perf_counter() - began
        batches = [p for p in query.recentProgress if p["numInputRows"]]
    finally:
        query.stop()
    count = sum(p["numInputRows"] for p in batches)
    return {"frames": count, "seconds": spent, "fps": count / spent, "batch_fps": [p["processedRowsPerSecond"] for p in batches]}


def plot_range(counts: DataFrame) -> DataFrame:
    from ..operators.histogram import plot_trim

    return plot_trim(counts)

"""Pairing of half frames and averaging of frames over streams, with typed state.

Frames of one stream arrive in order of number between batches; within a batch
they are put in order here, as Spark deals them to tasks in any. Streams are told
apart by `stream`. State holds what the rule needs, as columns: a held half frame
and its marks, or moments of an unfinished window.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..frames import packed
from ..functions.packing import unpack12
from ..kernels import Moments
from ..operators.dual import PairState

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _per_stream(frames: DataFrame, processor: StatefulProcessor, schema: str) -> DataFrame:
    """Sets the session's state store to the one that typed state needs, for queries started from now on."""
    frames.sparkSession.conf.set(_STORE, _ROCKS)
    return frames.groupBy("stream").transformWithStateInPandas(processor, schema, "append", "none")


#: What a task holds of one stream's batch in memory, and of what it gives; more waits in a file of the task's.
HELD_BYTES, GIVEN_BYTES = 64 << 20, 16 << 20


def _in_order(tables: Iterator[pd.DataFrame]) -> Iterator[dict]:
    """The frames of all tables in order of number: a table is some of a batch's frames, in no order."""
    with tempfile.SpooledTemporaryFile(HELD_BYTES) as held:
        places, end = [], 0
        for table in tables:
            for row in table.to_dict("records"):
                data = row.pop("data")
                places.append((row["frame_no"], end, len(data), row))
                end += held.write(data)
        for _, place, size, row in sorted(places, key=lambda p: p[:2]):
            held.seek(place)
            yield row | {"data": held.read(size)}


def _in_tables(rows: Iterator[dict]) -> Iterator[pd.DataFrame]:
    """Rows as tables of about GIVEN_BYTES."""
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += sum(len(v) for v in row.values() if isinstance(v, bytes))
        if size >= GIVEN_BYTES:
            yield pd.DataFrame(out)
            out, size = [], 0
    if out:
        yield pd.DataFrame(out)


class _Pairs(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pairing = handle.getValueState("pairing", "number long, read_buffer int, fresh boolean")
        self.held = handle.getValueState("held", "frame_no long, counter int, buffer int, marker int, data binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield from _in_tables(self._pairs(key[0], rows))

    def _pairs(self, stream: str, rows: Iterator[pd.DataFrame]) -> Iterator[dict]:
        state, kept = PairState(), {}
        if self.pairing.exists():
            state.number, state.read_buffer, state.fresh = self.pairing.get()
        if self.held.exists():
            *header, data = self.held.get()
            state.held, kept = tuple(header), {header[0]: bytes(data)}
        for row in _in_order(rows):
            data = row["data"]
            kept[row["frame_no"]] = data
            pair = state.feed((row["frame_no"], data[0], data[1], data[2]))
            if pair:
                number, a, b = pair
                lines = np.stack([np.frombuffer(kept[k], np.uint8).reshape(row["height"], -1) for k in (b, a)], axis=1)
                yield {"stream": stream, "frame_no": number, "half_no": min(a, b), "data": lines.tobytes()}
            kept = {state.held[0]: kept[state.held[0]]} if state.held else {}
        self.pairing.update((int(state.number), int(state.read_buffer), bool(state.fresh)))
        if state.held:
            self.held.update((*map(int, state.held), kept[state.held[0]]))
        else:
            self.held.clear()

    def close(self) -> None:
        pass


def stream_pairs(halves: DataFrame) -> DataFrame:
    """(stream, frame_no, half_no, data): whole packed frames, and the first half of each, from half frames (stream, frame_no, height, data)."""
    return _per_stream(halves.select("stream", "frame_no", "height", "data"), _Pairs(), "stream string, frame_no long, half_no long, data binary")


class _Averages(StatefulProcessor):
    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.window = handle.getValueState("window", "number long, n long")
        self.moments = handle.getValueState("moments", "sums binary, squares binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield from _in_tables(self._averages(key[0], rows))

    def _averages(self, stream: str, rows: Iterator[pd.DataFrame]) -> Iterator[dict]:
        number, moments = 0, None
        if self.window.exists():
            number, count = self.window.get()
            if count:
                sums, squares = self.moments.get()
                moments = Moments("p12", self.n, 0, True)
                moments.n, moments.a, moments.b = count, np.frombuffer(sums, moments.a.dtype).copy(), np.frombuffer(squares, moments.b.dtype).copy()
        for row in _in_order(rows):
            v = unpack12(np.frombuffer(row["data"], np.uint8))
            moments = moments or Moments("p12", self.n, len(v), True)
            moments.add(v)
            if moments.n == self.n:
                mean, variance = moments.results()
                yield {"stream": stream, "frame_no": number, "mean": packed(mean, "f32"), "var": packed(variance, "f32")}
                number, moments = number + 1, None
        self.window.update((int(number), int(moments.n if moments else 0)))
        if moments:
            self.moments.update((moments.a.tobytes(), moments.b.tobytes()))
        else:
            self.moments.clear()

    def close(self) -> None:
        pass


def stream_average(frames: DataFrame, n: int) -> DataFrame:
    """(stream, frame_no, mean, var): float planes of every n successive 12-bit frames (stream, frame_no, data)."""
    return _per_stream(frames.select("stream", "frame_no", "data"), _Averages(n), "stream string, frame_no long, mean binary, var binary")

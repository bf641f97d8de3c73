"""Frames from a TCP connection, in batch and as a stream, and a replay in place of a camera."""

from __future__ import annotations

import socket
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, SimpleDataSourceStreamReader

from ..frames import Interpretation, described


def _frame(connection: socket.socket, size: int) -> bytes | None:
    data = bytearray()
    while len(data) < size:
        more = connection.recv(size - len(data))
        if not more:
            return None
        data += more
    return bytes(data)


class _TcpReader(DataSourceReader):
    """All frames until the sender closes."""

    def __init__(self, address: str, size: int):
        self.address, self.size = address, size

    def read(self, partition) -> Iterator[tuple]:
        host, port = self.address.rsplit(":", 1)
        with socket.create_connection((host, int(port))) as connection:
            number = 0
            while (data := _frame(connection, self.size)) is not None:
                yield number, data
                number += 1


class _TcpStream(SimpleDataSourceStreamReader):
    """A batch is what has come within `patience` seconds; frames are kept until they are committed, so that a batch can be read again."""

    def __init__(self, address: str, size: int, patience: float):
        self.address, self.patience, self.connection = address, patience, None
        self.size, self.held, self.ended, self.part = size, {}, False, bytearray()

    def initialOffset(self) -> dict:
        return {"frame": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if self.connection is None and not self.ended:  # only the reader that reads connects
            host, port = self.address.rsplit(":", 1)
            self.connection = socket.create_connection((host, int(port)))
            self.connection.settimeout(self.patience)
        at = start["frame"]
        while at in self.held:
            at += 1
        while not self.ended and len(self.held) < 64:
            try:
                more = self.connection.recv(self.size - len(self.part))
            except TimeoutError:
                break
            if not more:
                self.ended = True
                break
            self.part += more
            if len(self.part) == self.size:
                self.held[at], self.part = bytes(self.part), bytearray()
                at += 1
        return iter([(k, self.held[k]) for k in range(start["frame"], at)]), {"frame": at}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([(k, self.held[k]) for k in range(start["frame"], end["frame"])])

    def commit(self, end: dict) -> None:
        for k in [k for k in self.held if k < end["frame"]]:
            del self.held[k]


class TcpSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raw_tcp"

    def schema(self) -> str:
        return "frame_no long, data binary"

    def reader(self, schema) -> DataSourceReader:
        return _TcpReader(self.options["address"], int(self.options["frame_bytes"]))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _TcpStream(self.options["address"], int(self.options["frame_bytes"]), float(self.options.get("patience", 0.5)))


def read_tcp(spark: SparkSession, address: str, interpretation: Interpretation, stream: bool = False) -> DataFrame:
    spark.dataSource.register(TcpSource)
    reader = (spark.readStream if stream else spark.read).format("raw_tcp").option("address", address).option("frame_bytes", interpretation.frame_bytes)
    return described(reader.load(), interpretation)


def replay(spark: SparkSession, frames: DataFrame, count: int, frames_per_second: int = 10) -> DataFrame:
    """A stream that shows the `count` frames again and again, in place of a camera.

    A batch's numbers are shuffled to where frames are, and looked up there by
    hash: frames aren't broadcast, so none passes through the driver. Each batch
    goes through all frames; keep them cached.
    """
    ticks = spark.readStream.format("rate").option("rowsPerSecond", frames_per_second).load()
    numbers = ticks.select(F.col("value").alias("shown"), (F.col("value") % count).alias("frame_no"))
    return numbers.hint("shuffle_hash").join(frames, "frame_no").withColumn("frame_no", F.col("shown")).drop("shown")

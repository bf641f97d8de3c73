"""Helpers that the text operators share: staging, Arrow slicing, word hashing."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

SHINGLE_WORDS = 5
CHUNK_BYTES = 1 << 20

_own_folder: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only in local mode, where the session names none (tests)."""
    global _own_folder
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="bayerloom-")
    return _own_folder


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.staged_at = path
    return made


def discard(*tables: DataFrame | None) -> None:
    """Remove staged tables that no later result reads."""
    for df in tables:
        path = getattr(df, "staged_at", None)
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            jvm.org.apache.hadoop.fs.Path(path).getFileSystem(conf).delete(jvm.org.apache.hadoop.fs.Path(path), True)


def slices(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch whose texts hold about `limit` bytes; a longer text comes alone."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths, dtype=np.int64)
    start, done = 0, 0
    while start < len(lengths):
        stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield batch.slice(start, stop - start)
        done, start = int(ends[stop - 1]), stop


_kept: dict = {}


def kept(key: bytes, make: Callable[[], object]) -> object:
    """What this worker process keeps under key from task to task, made if it isn't there; one thing at a time."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def let_go() -> None:
    """Drop what this process keeps: workers outlive stages, and others need the memory."""
    _kept.clear()


def map_slices(
    df: DataFrame, column: str, work: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str, limit: int = CHUNK_BYTES, keeps: bool = False
) -> DataFrame:
    """Run work()(slice) over the rows of df; work() is called once in each task, and only one that `keeps` finds what was kept."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            let_go()
        step = work()
        for batch in batches:
            for part in slices(batch, column, limit):
                yield step(part)

    return df.mapInArrow(run, schema)


# --- word hashing -----------------------------------------------------------

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D
_SHINGLE_BASE = 0x2545F4914F6CDD1D


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer, vectorised."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


#: Bytes by class: 0 between words, 1 in words, 2 (only where marks count) punctuation.
_words_only = np.zeros(256, dtype=np.uint8)
_words_only[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = 1
_with_marks = np.where(_words_only == 1, 1, np.where((np.arange(256) > 32) & (np.arange(256) < 127), 2, 0)).astype(np.uint8)
with np.errstate(over="ignore"):
    _byte_value = mix64(np.arange(1, 257, dtype=np.uint64) * _GOLDEN)
_powers = {"up": np.ones(0, np.uint64), "down": np.ones(0, np.uint64)}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = max(n, CHUNK_BYTES + 4096)
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[key] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")


def words_of(text: str | None) -> list[str]:
    """The words behind word_hashes: lower case, runs of ASCII letters and digits and of non-ASCII characters."""
    return WORD.findall(text.lower()) if text else []


def word_hashes(texts: pa.Array, marks: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, in order, and where each text's words begin (n + 1 offsets).

    With marks, case counts and runs of punctuation are words too.
    """
    return word_hashes_and_places(texts, marks)[:2]


def word_hashes_and_places(texts: pa.Array, marks: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and offsets of words as word_hashes has them, the bytes of all texts, and where in them words start and end.

    Works on the bytes of the whole array at once: a polynomial hash of each
    run of word bytes from one prefix sum.
    """
    lowered = pc.fill_null(texts.cast(pa.large_string()), "")
    lowered = lowered if marks else pc.utf8_lower(lowered)
    _, offsets, data = lowered.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[lowered.offset : lowered.offset + len(lowered) + 1]
    if data is None or len(lowered) == 0 or bounds[-1] == bounds[0]:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), np.zeros(len(lowered) + 1, np.int64), np.zeros(1, np.uint8), none, none
    raw = np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    kind = (_with_marks if marks else _words_only)[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[bounds] = True
    edge[1:-1] |= kind[1:] != kind[:-1]
    first, last = (kind > 0) & edge[:-1], (kind > 0) & edge[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _power_tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_byte_value[raw] * up[: len(raw)], out=sums[1:])
        hashes = mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, bounds).astype(np.int64), raw, starts, ends


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of `width` consecutive word hashes (windows over text ends included)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(n, np.uint64)
        factor = 1
        for k in range(width):
            total += hashes[k : k + n] * np.uint64(factor)
            factor = factor * _SHINGLE_BASE % (1 << 64)
        return mix64(total)


def shingles_by_text(hashes: np.ndarray, offsets: np.ndarray, width: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """For each text its shingle hashes, with repeats; a text of fewer words than `width` has one shingle of all its words."""
    every = window_hashes(hashes, width)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= width:
            yield every[a : b - width + 1]
        elif b > a:
            yield window_hashes(hashes[a:b], b - a)
        else:
            yield hashes[:0]

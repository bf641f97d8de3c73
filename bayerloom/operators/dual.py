"""Half frames: splitting whole frames by row parity, and pairing halves again."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..numbering import RANGE_ROWS, in_ranges

#: The markers in the third byte of half frames.
MARK_A, MARK_B = 0xAA, 0x55


def split_rows(px: DataFrame, flip: bool = False) -> DataFrame:
    """Frame k div 2 gives frame k with the rows of parity (k + flip) % 2."""
    number = (F.col("frame_no") * 2 + F.pmod(F.col("y") + F.lit(int(flip)), F.lit(2))).cast("long")
    return px.select(number.alias("frame_no"), F.expr("cast(y div 2 as int)").alias("y"), "x", "v")


@dataclass
class PairState:
    """What the decoder remembers between half frames."""

    number: int = 0
    read_buffer: int = 0
    held: tuple | None = None
    fresh: bool = True

    def feed(self, half: tuple) -> tuple | None:
        """half: (key, counter, read buffer byte, marker). Gives (frame number, key of A, key of B) when a pair is right."""
        if self.held is None:
            self.held, self.fresh = half, True
            return None
        older, newer, slipped = self.held, half, not self.fresh
        first = newer if newer[3] == MARK_B else older
        buffers = older[2] & 3, newer[2] & 3
        step = abs(older[1] - newer[1])
        right = buffers[0] == buffers[1] and step in (1, 255) and (first[2] & 3 != self.read_buffer or slipped)
        number, self.number, self.read_buffer = self.number, self.number + 1, first[2] & 3
        if not right:
            self.held, self.fresh = newer, False
            return None
        self.held = None
        a, b = (first, older if first is newer else newer) if first[3] == MARK_A else (older if first is newer else newer, first)
        return number, a[0], b[0]


    @property
    def code(self) -> int:
        """What the state holds beside the number and the half frame itself, which can only be the one before: 0 to STATES - 1."""
        return self.read_buffer + 4 * (0 if self.held is None else 1 if self.fresh else 2)

    @classmethod
    def of(cls, code: int, before: tuple | None, number: int = 0) -> PairState:
        """The state of a code, where `before` is the half frame that came last."""
        return cls(number, code % 4, before if code >= 4 else None, code < 8)


STATES = 12
_HEADER = ["half_no", "counter", "buffer", "marker"]


def state_map(headers: list[tuple], before: tuple | None) -> list[tuple[int, int]]:
    """For each state that these headers may find, the state that they leave and how many frame numbers they use.

    States that have become equal go on as one, so this costs little more than
    going through the headers once.
    """
    tracks = [(PairState.of(code, before), [(code, 0)]) for code in range(STATES if before else 4)]
    for header in headers:
        by_code: dict[int, tuple[PairState, list]] = {}
        for state, members in tracks:
            state.feed(header)
            kept, others = by_code.setdefault(state.code, (state, []))
            others += [(code, used + state.number - kept.number) for code, used in members]
        tracks = list(by_code.values())
    out = [(0, 0)] * STATES
    for state, members in tracks:
        for code, used in members:
            out[code] = state.code, used + state.number
    return out


def pair_halves(headers: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(frame_no, a, b) of all right pairs, from headers (half_no, counter, buffer, marker).

    The rule depends on all that came before, but what it remembers is one of
    STATES states. So headers, three bytes a half frame, are put in ranges; each
    range gives the map of the states that it may find to those that it leaves,
    the maps are composed in order, and then the ranges are paired side by side,
    each from the state that it finds. A slipped pair leaves a gap in frame_no.
    """
    spark = headers.sparkSession
    placed, ranges = in_ranges(headers.select(*_HEADER), "half_no", range_rows)

    def ordered(table: pd.DataFrame) -> list[tuple]:
        return list(table.sort_values("at")[_HEADER].itertuples(index=False, name=None))

    finds = {ranges[0][0]: PairState()} if ranges else {}
    if len(ranges) > 1:
        last = {r[0]: tuple(r[1]) for r in placed.groupBy("part").agg(F.max_by(F.struct(*_HEADER), "at")).collect()}
        before = {part: last[ranges[k - 1][0]] if k else None for k, (part, *_) in enumerate(ranges)}

        def mapped(table: pd.DataFrame) -> pd.DataFrame:
            part = int(table["part"].iloc[0])
            found = state_map(ordered(table), before[part])
            return pd.DataFrame([(part, code, leaves, used) for code, (leaves, used) in enumerate(found)], columns=["part", "finds", "leaves", "used"])

        maps = {(r["part"], r["finds"]): (r["leaves"], r["used"]) for r in placed.groupBy("part").applyInPandas(mapped, "part long, finds int, leaves int, used long").collect()}
        code, number = PairState().code, 0
        for part, *_ in ranges:
            finds[part] = PairState.of(code, before[part], number)
            code, used = maps[part, code]
            number += used

    def paired(table: pd.DataFrame) -> pd.DataFrame:
        state = finds[int(table["part"].iloc[0])]
        pairs = [p for header in ordered(table) if (p := state.feed(header))]
        return pd.DataFrame(pairs, columns=["frame_no", "a", "b"]).astype("int64")

    if not ranges:
        return spark.createDataFrame([], "frame_no long, a long, b long")
    return placed.groupBy("part").applyInPandas(paired, "frame_no long, a long, b long")


def decode_pairs(halves: DataFrame) -> DataFrame:
    """Whole 12-bit frames (frame_no, y, x, v) from halves in pixel form (half_no, y, x, v), headers in their first pixels."""
    head = halves.where("y = 0 and x < 2").groupBy("half_no").agg(F.max(F.expr("case when x = 0 then v end")).alias("p"), F.max(F.expr("case when x = 1 then v end")).alias("q"))
    headers = head.select("half_no", F.expr("cast(p div 16 as int)").alias("counter"), F.expr("cast((p % 16) * 16 + q div 256 as int)").alias("buffer"), F.expr("cast(q % 256 as int)").alias("marker"))
    pairs = pair_halves(headers)
    sides = pairs.select("frame_no", F.explode(F.array(F.struct(F.col("b").alias("half_no"), F.lit(0).alias("row")), F.struct(F.col("a").alias("half_no"), F.lit(1).alias("row")))).alias("s"))
    sides = sides.select("frame_no", "s.half_no", "s.row")
    return halves.join(sides, "half_no").select("frame_no", (F.col("y") * 2 + F.col("row")).cast("int").alias("y"), "x", "v")

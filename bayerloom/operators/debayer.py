"""Debayering 8-bit mosaics, at full and at half size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def debayer(px: DataFrame, width: int, red_in_first_col: bool = True, red_in_first_row: bool = True, border: str = "flat", height: int = 0) -> DataFrame:
    """(frame_no, y, x, r, g, b) by the means of neighbours in the flat sample order.

    Neighbours lie at flat distances of 1, width and width +- 1: at the left
    and right borders they are in the row before or after; outside the frame
    they are 0. One window with eight offsets: one exchange and one sort.

    border: `flat` is that; with `clamp`, for which the height must be given, a
    neighbour outside the frame is the nearest sample of its colour inside it,
    the one on the other side.
    """
    if border not in ("flat", "clamp") or (border == "clamp" and (width < 2 or height < 2)):
        raise ValueError("border must be flat, or clamp with a height; both sides at least 2")
    order = Window.partitionBy("frame_no").orderBy("y", "x")

    def at(k: int) -> Column:
        return F.lag("v", -k, 0).over(order) if k < 0 else F.lead("v", k, 0).over(order) if k else F.col("v")

    def before(k: int) -> Column:
        return F.lag("v", k, 0).over(order)

    w = width
    seen = px.select("frame_no", "y", "x", "v", before(1).alias("left"), at(1).alias("right"), before(w).alias("up"), at(w).alias("down"), before(w + 1).alias("ul"), before(w - 1).alias("ur"), at(w - 1).alias("dl"), at(w + 1).alias("dr"))
    if border == "clamp":
        at_left, at_right, at_top, at_bottom = F.col("x") == 0, F.col("x") == width - 1, F.col("y") == 0, F.col("y") == height - 1

        def inside(vertical: str, horizontal: str) -> Column:
            """The neighbour on a corner, or the one of the four that is inside."""
            over = at_top if vertical == "u" else at_bottom
            beside, other = (at_left, "r") if horizontal == "l" else (at_right, "l")
            flipped = "d" if vertical == "u" else "u"
            return F.when(over & beside, F.col(flipped + other)).when(over, F.col(flipped + horizontal)).when(beside, F.col(vertical + other)).otherwise(F.col(vertical + horizontal)).alias(vertical + horizontal)

        sides = [F.when(outside, F.col(b)).otherwise(F.col(a)).alias(a) for outside, a, b in ((at_left, "left", "right"), (at_right, "right", "left"), (at_top, "up", "down"), (at_bottom, "down", "up"))]
        seen = seen.select("frame_no", "y", "x", "v", *sides, *[inside(a, b) for a in "ud" for b in "lr"])
    red_col = (F.col("x") + F.lit(int(not red_in_first_col))) % 2 == 0
    red_row = (F.col("y") + F.lit(int(not red_in_first_row))) % 2 == 0
    across, upright = F.expr("(left + right) div 2"), F.expr("(up + down) div 2")
    cross, corners = F.expr("(left + right + up + down) div 4"), F.expr("(ul + ur + dl + dr) div 4")
    v = F.col("v")

    def site(red: Column, blue: Column, green_in_red_row: Column, green_in_blue_row: Column, name: str) -> Column:
        return F.when(red_col & red_row, red).when(~red_col & ~red_row, blue).when(red_row, green_in_red_row).otherwise(green_in_blue_row).cast("int").alias(name)

    return seen.select("frame_no", "y", "x", site(v, corners, across, upright, "r"), site(cross, cross, v, v, "g"), site(corners, v, upright, across, "b"))


def debayer_half(px: DataFrame, red_in_first_col: bool = True, red_in_first_row: bool = True) -> DataFrame:
    """Half-size (frame_no, y, x, r, g, b): of each 2 x 2 cell red, blue, and half of either green."""
    red_col, red_row = int(not red_in_first_col), int(not red_in_first_row)
    red = (F.col("x") % 2 == red_col) & (F.col("y") % 2 == red_row)
    blue = (F.col("x") % 2 != red_col) & (F.col("y") % 2 != red_row)
    cells = px.groupBy("frame_no", F.expr("cast(y div 2 as int)").alias("cy"), F.expr("cast(x div 2 as int)").alias("cx")).agg(
        F.max(F.when(red, F.col("v"))).alias("r"), F.sum(F.when(~red & ~blue, F.expr("v div 2"))).cast("int").alias("g"), F.max(F.when(blue, F.col("v"))).alias("b")
    )
    return cells.select("frame_no", F.col("cy").alias("y"), F.col("cx").alias("x"), "r", "g", "b")

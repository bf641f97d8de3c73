"""3D lookup tables from .cube files."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 65


@dataclass
class Cube:
    """n^3 entries of three bytes, red fastest."""

    n: int
    entries: np.ndarray


def parse_cube(text: str) -> Cube:
    """Only lines that start with a digit are entries; values become bytes by truncation."""
    n, rows = 0, []
    for line in text.splitlines():
        if line.startswith("LUT_3D_SIZE"):
            n = int(line.split(" ")[1])
        elif line[:1].isdigit():
            rows.append([float(x) for x in line.split(" ")[:3]])
    if n < 1 or len(rows) != n**3:
        raise ValueError(f"a cube of size {n} needs {n**3} entries, not {len(rows)}")
    return Cube(n, np.clip(np.floor(np.array(rows) * 255 + 1e-9), 0, 255).astype(np.int64))


def apply_cube(rgb: DataFrame, cube: Cube, mode: str = "reference") -> DataFrame:
    """Trilinear lookup by one broadcast equi-join with rows that hold all eight corners of a cell.

    `reference`: samples lie at cell centres and the grid repeats, so both ends
    blend with the opposite face. `exact`: ends map to ends, clamped.
    """
    if mode not in ("reference", "exact") or cube.n > MOST:
        raise ValueError(f"mode must be reference or exact, and the size at most {MOST}")
    n, spark = cube.n, rgb.sparkSession
    at = np.arange(n**3)
    first = [at % n, at // n % n, at // n**2]
    rows = [at.tolist()]
    for corner in range(8):
        high = [(f + (corner >> k & 1)) % n if mode == "reference" else np.minimum(f + (corner >> k & 1), n - 1) for k, f in enumerate(first)]
        value = cube.entries[high[0] + n * high[1] + n * n * high[2]]
        rows += [value[:, c].tolist() for c in range(3)]
    names = ["cell"] + [f"c{corner}_{c}" for corner in range(8) for c in "rgb"]
    cells = spark.createDataFrame(list(zip(*rows, strict=True)), ", ".join(f"{x} int" for x in names))

    def coordinate(c: str) -> Column:
        u = F.col(c) / F.lit(255.0)
        return (u * n - 0.5 if mode == "reference" else u * (n - 1)).alias(f"u_{c}")

    placed = rgb.select("frame_no", "y", "x", *[coordinate(c) for c in "rgb"])
    placed = placed.select("frame_no", "y", "x", *[F.floor(f"u_{c}").cast("int").alias(f"i_{c}") for c in "rgb"], *[(F.col(f"u_{c}") - F.floor(f"u_{c}")).alias(f"f_{c}") for c in "rgb"])
    wrapped = [F.pmod(F.col(f"i_{c}"), F.lit(n)) if mode == "reference" else F.least(F.col(f"i_{c}"), F.lit(n - 1)) for c in "rgb"]
    placed = placed.withColumn("cell", wrapped[0] + wrapped[1] * n + wrapped[2] * n * n)

    def blended(c: str) -> Column:
        total = F.lit(0.0)
        for corner in range(8):
            weight = F.lit(1.0)
            for k, axis in enumerate("rgb"):
                weight = weight * (F.col(f"f_{axis}") if corner >> k & 1 else 1 - F.col(f"f_{axis}"))
            total = total + weight * F.col(f"c{corner}_{c}")
        return F.floor(F.round(total, 6)).cast("int").alias(c)

    return placed.join(F.broadcast(cells), "cell").select("frame_no", "y", "x", *[blended(c) for c in "rgb"])

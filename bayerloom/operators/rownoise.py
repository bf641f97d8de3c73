"""Row-noise removal by linear models of green differences and dark columns."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DARK_COLUMNS = 8
BLACK = 128


@dataclass
class HalfModel:
    """Weights for even or for odd rows."""

    green: list[list[float]] = field(default_factory=list)  # lag x 2
    dark: list[list[list[float]]] = field(default_factory=list)  # row pair x 2 x 16
    offset: float = 0.0


@dataclass
class RowNoiseModel:
    even: HalfModel
    odd: HalfModel

    @property
    def lags(self) -> int:
        return len(self.even.green)

    @property
    def uncorrectable(self) -> int:
        """Rows at the top and bottom that stay as they are."""
        return max(self.lags, 2 * (len(self.even.dark) // 2))


#: The hand-made model, and the one of green differences only. The two of dark columns are in models.yml.
MODELS = {
    "internal:mean": RowNoiseModel(HalfModel(dark=[[[0.0375] * 16, [0.0] * 16]]), HalfModel(dark=[[[0.0] * 16, [0.0375] * 16]])),
    "internal:only_green": RowNoiseModel(
        HalfModel([[-0.17836376680291102, -0.4105501952617383], [0.43629936409448755, 0.4204623906920429], [0.19277238810231043, -0.16900017632955364]], offset=-0.0010874289591121151),
        HalfModel([[0.4879804645339848, 0.43341050056294045], [-0.17254326519042207, -0.18052946235127315], [0.4236788587840668, 0.23795484501101222]], offset=-0.002760103438085751),
    ),
}


class _Plain(yaml.SafeLoader):
    """Reads tagged mappings as plain ones and runs nothing."""


_Plain.add_multi_constructor("tag:yaml.org,2002:python/object", lambda loader, suffix, node: loader.construct_mapping(node, deep=True))


_LARGER = ("internal:good", "internal:only_dark")


def load_model(model: str) -> RowNoiseModel:
    """A bundled model by name, or a YAML file with weights_even and weights_odd."""
    if model in MODELS:
        return MODELS[model]
    if model in _LARGER:
        spec = yaml.safe_load(Path(__file__).with_name("models.yml").read_text())[model.removeprefix("internal:")]
    elif model.startswith("internal:"):
        raise ValueError(f"{model} isn't bundled; there are {', '.join((*MODELS, *_LARGER))}, or give the path of a model file")
    else:
        spec = yaml.load(Path(model).read_text(), Loader=_Plain)
    halves = [HalfModel(h.get("green_diff_weights") or [], h.get("dark_col_row_weights") or [], float(h.get("offset") or 0)) for h in (spec["weights_even"], spec["weights_odd"])]
    return RowNoiseModel(*halves)


def pair_lag(i: int) -> int:
    """0, -1, 1, -2, 2, ...: which pair of rows the i-th dark weights are for."""
    return i // 2 if i % 2 == 0 else -(i // 2 + 1)


def _green(px: DataFrame, red_in_first_col: bool, red_in_first_row: bool) -> DataFrame:
    parity = int(red_in_first_col == red_in_first_row)
    return px.where((F.col("x") + F.col("y") + F.lit(parity)) % 2 == 0).select("frame_no", "y", F.expr("cast(x div 2 as int)").alias("k"), F.col("v").alias("g"))


def green_medians(px: DataFrame, lags: int, red_in_first_col: bool = True, red_in_first_row: bool = True) -> DataFrame:
    """(frame_no, lag, y, d): upper median over a row of green(y) - green(y + lag).

    One self join over green pixels, each row copied once per lag; groups are
    half a row long.
    """
    green = _green(px, red_in_first_col, red_in_first_row)
    later = green.select("frame_no", F.explode(F.sequence(F.lit(1), F.lit(lags))).alias("lag"), "y", "k", F.col("g").alias("h")).withColumn("y", F.col("y") - F.col("lag"))
    diffs = green.join(later, ["frame_no", "y", "k"]).withColumn("d", F.col("g") - F.col("h"))
    values = F.sort_array(F.collect_list("d"))
    return diffs.groupBy("frame_no", "lag", "y").agg(F.element_at(values, F.expr("cast(count(1) div 2 as int) + 1")).alias("d"))


def _pick(weights: list[float], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(w)) for w in weights]), index + 1)


def _offsets(px: DataFrame, model: RowNoiseModel, width: int, red_in_first_col: bool, red_in_first_row: bool) -> DataFrame:
    """(frame_no, y, off) without the constant part."""
    parts = None
    if model.lags:
        medians = green_medians(px, model.lags, red_in_first_col, red_in_first_row)
        sides = F.explode(F.array(F.lit(0), F.lit(1))).alias("side")
        seen = medians.select("frame_no", "lag", "y", "d", sides).select("frame_no", "lag", "d", "side", (F.col("y") + F.when(F.col("side") == 0, F.col("lag")).otherwise(0)).alias("y"))
        flat = [[w for lag in half.green for w in (-lag[0], lag[1])] for half in (model.even, model.odd)]
        weight = _pick(flat[0] + flat[1], F.pmod(F.col("y"), F.lit(2)) * (2 * model.lags) + (F.col("lag") - 1) * 2 + F.col("side"))
        parts = seen.select("frame_no", F.col("y").cast("int").alias("y"), (F.col("d") * weight).alias("part"))
    if model.even.dark:
        m = len(model.even.dark)
        dark = px.where((F.col("x") < DARK_COLUMNS) | (F.col("x") >= width - DARK_COLUMNS))
        column = F.when(F.col("x") < DARK_COLUMNS, F.col("x")).otherwise(F.col("x") - (width - 2 * DARK_COLUMNS))
        flat = [w for half in (model.even, model.odd) for pair in half.dark for row in pair for w in row]
        goes = F.explode(F.array(*[F.struct(F.lit(p).alias("parity"), F.lit(i).alias("i"), F.lit(pair_lag(i)).alias("at")) for p in range(2) for i in range(m)])).alias("to")
        sent = dark.select("frame_no", "y", column.alias("c"), "v", goes)
        weight = _pick(flat, ((F.col("to.parity") * m + F.col("to.i")) * 2 + F.col("y") % 2) * 16 + F.col("c"))
        target = ((F.expr("y div 2") - F.col("to.at")) * 2 + F.col("to.parity")).cast("int")
        own = sent.select("frame_no", target.alias("y"), ((F.col("v") - BLACK) * weight).alias("part"))
        parts = own if parts is None else parts.unionByName(own)
    return parts.groupBy("frame_no", "y").agg(F.sum("part").alias("off"))


def remove_row_noise(
    px: DataFrame, width: int, height: int, model: RowNoiseModel, strip_dark_columns: bool = False, red_in_first_col: bool = True, red_in_first_row: bool = True
) -> DataFrame:
    """16-bit pixels less their row's estimated noise, truncated and saturated; top and bottom rows stay."""
    edge = model.uncorrectable
    offsets = _offsets(px, model, width, red_in_first_col, red_in_first_row)
    constant = F.when(F.col("y") % 2 == 0, F.lit(model.even.offset)).otherwise(F.lit(model.odd.offset))
    inner = (F.col("y") >= edge) & (F.col("y") < height - edge)
    level = F.floor(F.round(F.col("v") - F.coalesce("off", F.lit(0.0)) - constant, 6))
    out = px.join(offsets, ["frame_no", "y"], "left").select(
        "frame_no", "y", "x", F.when(inner, F.least(F.greatest(level, F.lit(0)), F.lit(65535))).otherwise(F.col("v")).cast("int").alias("v")
    )
    if not strip_dark_columns:
        return out
    return out.where((F.col("x") >= DARK_COLUMNS) & (F.col("x") < width - DARK_COLUMNS)).withColumn("x", (F.col("x") - DARK_COLUMNS).cast("int"))


def _training_rows(px: DataFrame, width: int, height: int, lags: int, pairs: int, red_in_first_col: bool, red_in_first_row: bool) -> tuple[DataFrame, list[str]]:
    """Features and target of each row that a model can correct, and the features' names."""
    edge = max(lags, 2 * (pairs // 2), 0)
    means = px.where((F.col("x") >= DARK_COLUMNS) & (F.col("x") < width - DARK_COLUMNS)).groupBy("frame_no", "y").agg((F.avg("v") - BLACK).alias("target"))
    level = means.groupBy("frame_no").agg(F.avg("target").alias("level"))
    rows = means.join(level, "frame_no").withColumn("target", F.col("target") - F.col("level")).where((F.col("y") >= edge) & (F.col("y") < height - edge)).select("frame_no", "y", "target")
    names: list[str] = []
    if lags:
        medians = green_medians(px, lags, red_in_first_col, red_in_first_row)
        for side in range(2):
            for lag in range(1, lags + 1):
                name = f"g{lag}_{side}"
                value = medians.where(F.col("lag") == lag).select("frame_no", (F.col("y") + (lag if side == 0 else 0)).cast("int").alias("y"), (F.col("d") * (-1 if side == 0 else 1)).cast("double").alias(name))
                rows, names = rows.join(value, ["frame_no", "y"]), [*names, name]
    if pairs:
        dark = px.where((F.col("x") < DARK_COLUMNS) | (F.col("x") >= width - DARK_COLUMNS))
        column = F.when(F.col("x") < DARK_COLUMNS, F.col("x")).otherwise(F.col("x") - (width - 2 * DARK_COLUMNS))
        wide = dark.groupBy("frame_no", F.expr("y div 2").alias("pair")).agg(*[F.sum(F.when((F.col("y") % 2 == h) & (column == c), F.col("v") - BLACK).otherwise(0)).cast("double").alias(f"d{h}_{c}") for h in range(2) for c in range(16)])
        for i in range(pairs):
            own = [F.col(f"d{h}_{c}").alias(f"d{i}_{h}_{c}") for h in range(2) for c in range(16)]
            rows = rows.withColumn("pair", F.expr("y div 2")).join(wide.select("frame_no", (F.col("pair") - pair_lag(i)).alias("pair"), *own), ["frame_no", "pair"]).drop("pair")
            names += [f"d{i}_{h}_{c}" for h in range(2) for c in range(16)]
    return rows.withColumn("one", F.lit(1.0)), [*names, "one", "target"]


def training_sums(px: DataFrame, width: int, height: int, lags: int = 3, pairs: int = 0, red_in_first_col: bool = True, red_in_first_row: bool = True) -> tuple[DataFrame, list[str]]:
    """(parity, i, j, total): sums of products of any two columns of the training rows, i <= j, and the columns' names.

    Each task multiplies its rows out as matrices; sums of them are all that is shuffled.
    """
    rows, every = _training_rows(px, width, height, lags, pairs, red_in_first_col, red_in_first_row)
    i, j = np.triu_indices(len(every))

    def run(batches):
        import pyarrow as pa

        total = np.zeros((2, len(every), len(every)))
        for batch in batches:
            values = np.stack([batch.column(c).to_numpy() for c in every], axis=1)
            odd = batch.column("y").to_numpy() % 2
            for parity in range(2):
                own = values[odd == parity]
                total[parity] += own.T @ own
        for parity in range(2):
            yield pa.RecordBatch.from_pydict({"parity": np.full(len(i), parity, np.int32), "i": i.astype(np.int32), "j": j.astype(np.int32), "total": total[parity][i, j]})

    parts = rows.select("y", *every).mapInArrow(run, "parity int, i int, j int, total double")
    return parts.groupBy("parity", "i", "j").agg(F.sum("total").alias("total")), every


def train_model(px: DataFrame, width: int, height: int, lags: int = 3, pairs: int = 0, red_in_first_col: bool = True, red_in_first_row: bool = True) -> RowNoiseModel:
    """Least squares of row means on green medians and dark columns, for even and odd rows.

    Features are one narrow row per frame row; only their Gram matrices, of
    fixed size, reach the driver.
    """
    sums, every = training_sums(px, width, height, lags, pairs, red_in_first_col, red_in_first_row)
    grams = np.zeros((2, len(every), len(every)))
    for parity, i, j, total in sums.collect():
        grams[parity, i, j] = grams[parity, j, i] = total
    halves = []
    for gram in grams:
        w = np.linalg.lstsq(gram[:-1, :-1], gram[:-1, -1], rcond=1e-12)[0].tolist()
        green = [[w[lag], w[lags + lag]] for lag in range(lags)]
        dark = [[w[2 * lags + i * 32 + h * 16 : 2 * lags + i * 32 + h * 16 + 16] for h in range(2)] for i in range(pairs)]
        halves.append(HalfModel(green, dark, w[-1]))
    return RowNoiseModel(*halves)

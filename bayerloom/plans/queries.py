"""One query for each operator over the fixture frames, and SQL with the same rows."""

from __future__ import annotations

import os
import socket
import struct
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import frames as fr
from .. import graph, kernels, operators, registry, sinks, sources, streaming
from ..functions import packing
from ..staging import scratch_folder
from .fixtures import HEIGHT, P8, PX, WIDTH, cube_text, half_frames, px

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_AT = "partition by frame_no order by y, x"
_DEBAYER = P8 + f""", seen as (
  select *, lag(v, 1, 0) over w as le, lead(v, 1, 0) over w as ri, lag(v, 20, 0) over w as up, lead(v, 20, 0) over w as dn,
         lag(v, 21, 0) over w as ul, lag(v, 19, 0) over w as ur, lead(v, 19, 0) over w as dl, lead(v, 21, 0) over w as dr
  from p8 window w as ({_AT})),
rgb as (
  select frame_no, y, x,
    cast(case when x % 2 = 0 and y % 2 = 0 then v when x % 2 = 1 and y % 2 = 1 then (ul + ur + dl + dr) // 4 when y % 2 = 0 then (le + ri) // 2 else (up + dn) // 2 end as integer) as r,
    cast(case when (x + y) % 2 = 0 then (le + ri + up + dn) // 4 else v end as integer) as g,
    cast(case when x % 2 = 0 and y % 2 = 0 then (ul + ur + dl + dr) // 4 when x % 2 = 1 and y % 2 = 1 then v when y % 2 = 0 then (up + dn) // 2 else (le + ri) // 2 end as integer) as b
  from seen)"""


def p8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operators.bit_depth(px(spark, sf_dir), 12, 8)


def rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operators.debayer(p8(spark, sf_dir), WIDTH)


@query(f"with {PX} select * from px")
def fixture_px(spark, sf_dir):
    return px(spark, sf_dir)


@query(f"with {PX} select * from px")
def unpack12(spark, sf_dir):
    return packing.to_pixels(packing.to_frames(px(spark, sf_dir)), WIDTH)


@query(f"with {PX} select frame_no, count(*) as n, cast(sum(v) as bigint) as total, cast(300 as integer) as bytes from px group by frame_no")
def pack12_roundtrip(spark, sf_dir):
    packed = packing.to_frames(px(spark, sf_dir))
    return packed.select("frame_no", F.length("data").alias("bytes"), packing.samples12(F.col("data")).alias("s")).select(
        "frame_no", F.size("s").cast("long").alias("n"), F.aggregate("s", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"), "bytes"
    )


@query(f"with {P8} select frame_no, y, x, cast(v as integer) as v from p8")
def bitdepth_12_8(spark, sf_dir):
    return p8(spark, sf_dir)


@query(f"with {PX} select * from px")
def bitdepth_12_16(spark, sf_dir):
    return operators.bit_depth(px(spark, sf_dir), 12, 16)


@query(f"with {P8} select frame_no, y, x, cast(v as integer) as v from p8")
def gpu_bitdepth_frames(spark, sf_dir):
    packed = fr.raw_frames(packing.to_frames(px(spark, sf_dir)), WIDTH, HEIGHT, "p12")
    return fr.pixels(kernels.bit_depth(packed, 8))


@query(f"with {PX}, a as (select frame_no // 5 as frame_no, y, x, avg(v) as m, count(*) as n from px group by all) select frame_no, y, x, cast(least(greatest(round(m * 12.5), 0), 65535) as integer) as v from a where n = 5")
def fp32_to_u16(spark, sf_dir):
    return operators.fp32_to_u16(operators.average(px(spark, sf_dir), 5, dense=True), 12.5)


@query(f"with {_DEBAYER} select * from rgb")
def debayer(spark, sf_dir):
    return rgb(spark, sf_dir)


def _clamped_sql() -> str:
    """Neighbours by coordinates; one outside is the one on the other side."""
    near = {name: (dy, dx) for name, dy, dx in (("le", 0, -1), ("ri", 0, 1), ("up", -1, 0), ("dn", 1, 0), ("ul", -1, -1), ("ur", -1, 1), ("dl", 1, -1), ("dr", 1, 1))}
    joins = " ".join(f"join p8 {n} on {n}.frame_no = p.frame_no and {n}.y = {HEIGHT - 1} - abs({HEIGHT - 1} - abs(p.y + {dy})) and {n}.x = {WIDTH - 1} - abs({WIDTH - 1} - abs(p.x + {dx}))" for n, (dy, dx) in near.items())
    seen = f"seen as (select p.*, {', '.join(f'{n}.v as {n}' for n in near)} from p8 p {joins})"
    return f"with {P8}, {seen}, {_DEBAYER[_DEBAYER.index('rgb as ('):]} select * from rgb"


@query(_clamped_sql())
def debayer_clamped(spark, sf_dir):
    return operators.debayer(p8(spark, sf_dir), WIDTH, border="clamp", height=HEIGHT)


@query(_clamped_sql())
def debayer_clamped_frames(spark, sf_dir):
    return fr.pixels(kernels.debayer(kernels.bit_depth(_packed(spark, sf_dir), 8), "clamp"), "rgb")


@query(f"with {_DEBAYER} select * from rgb")
def debayer_frames(spark, sf_dir):
    packed = fr.raw_frames(packing.to_frames(px(spark, sf_dir)), WIDTH, HEIGHT, "p12")
    return fr.pixels(kernels.debayer(kernels.bit_depth(packed, 8)))


@query(
    f"with {P8} select frame_no, y // 2 as y, x // 2 as x, cast(max(case when x % 2 = 0 and y % 2 = 0 then v end) as integer) as r, "
    "cast(sum(case when (x + y) % 2 = 1 then v // 2 end) as integer) as g, cast(max(case when x % 2 = 1 and y % 2 = 1 then v end) as integer) as b from p8 group by frame_no, y // 2, x // 2"
)
def debayer_half(spark, sf_dir):
    return operators.debayer_half(p8(spark, sf_dir))


@query(f"with {PX}, dark as (select y, x, round(avg(v), 6) as d from px group by y, x) select frame_no, y, x, cast(least(greatest(round(v + 128 - d), 0), 4095) as integer) as v from px join dark using (y, x)")
def darkframe_subtract(spark, sf_dir):
    frames = px(spark, sf_dir)
    dark = frames.groupBy("y", "x").agg(F.avg("v").alias("dark"))
    return operators.darkframe_subtract(frames, dark, WIDTH * HEIGHT)


@query(f"with {PX} select frame_no, v as bin, count(*) as n from px group by frame_no, v")
def histogram(spark, sf_dir):
    return operators.histogram(px(spark, sf_dir))


@query(f"with {PX}, f as (select distinct frame_no from px), c as (select frame_no, v, count(*) as n from px group by all) select f.frame_no, cast(r.bin as integer) as bin, coalesce(c.n, 0) as n from f cross join range(4096) r(bin) left join c on c.frame_no = f.frame_no and c.v = r.bin")
def histogram_dense(spark, sf_dir):
    return operators.histogram(px(spark, sf_dir), dense=True)


@query(f"with {PX}, c as (select frame_no, v // 256 as bin, count(*) as n from px group by all), p as (select *, max(n) over (partition by frame_no) as peak from c) select frame_no, min(bin) as first_bin, max(bin) as last_bin, max(peak) as peak from p where n >= peak // 2000 group by frame_no")
def plot_trim(spark, sf_dir):
    coarse = px(spark, sf_dir).withColumn("v", F.expr("cast(v div 256 as int)"))
    return operators.plot_trim(operators.histogram(coarse))


_AVERAGE = PX + ", a as (select frame_no // 5 as frame_no, y, x, round(avg(v), 4) as m, round(var_pop(v), 4) as s, count(*) as n from px group by all)"


@query(f"with {_AVERAGE} select frame_no, y, x, m as v from a where n = 5")
def average_mean(spark, sf_dir):
    return operators.average(px(spark, sf_dir), 5, dense=True).withColumn("v", F.round("v", 4))


@query(f"with {_AVERAGE} select frame_no, y, x, m as v, s as var from a where n = 5")
def average_var(spark, sf_dir):
    out = operators.average(px(spark, sf_dir), 5, std=True, dense=True)
    return out.withColumns({"v": F.round("v", 4), "var": F.round("var", 4)})


@query(f"with {PX}, g as (select *, (dense_rank() over (order by frame_no) - 1) // 5 as w from px where frame_no % 7 <> 3), a as (select w, y, x, round(avg(v), 4) as v, count(*) as n from g group by all) select w as frame_no, y, x, v from a where n = 5")
def average_with_gaps(spark, sf_dir):
    frames = px(spark, sf_dir).where("frame_no % 7 <> 3")
    return operators.average(frames, 5).withColumn("v", F.round("v", 4))


@query(f"with {_AVERAGE} select frame_no, y, x, s as v from a where n = 5")
def split_var(spark, sf_dir):
    out = operators.split(operators.average(px(spark, sf_dir), 5, std=True, dense=True), ["v", "var"], 1)
    return out.withColumn("v", F.round("v", 4))


_IN_FIVES = PX + ", a as (select frame_no // 5 as frame_no, y, x, avg(v) as m, var_pop(v) as s, count(*) as n from px group by all)"


@query(f"with {_IN_FIVES} select frame_no, y, x, round(cast(m as float), 3) as mean, round(cast(s as float), 1) as var from a where n = 5")
def average_frames(spark, sf_dir):
    """Mean and variance planes of packed frames, put together again."""
    mean, variance = kernels.average(_packed(spark, sf_dir), 5)
    planes = [fr.pixels(p, "raw", "f32").withColumnRenamed("v", name) for p, name in ((mean, "mean"), (variance, "var"))]
    joined = planes[0].join(planes[1], ["frame_no", "y", "x"])
    return joined.withColumns({"mean": F.round(F.col("mean").cast("float"), 3), "var": F.round(F.col("var").cast("float"), 1)})


@query(f"with {PX}, a as (select y, x, round(avg(v), 3) as v from px group by all) select cast(0 as bigint) as frame_no, * from a")
def average_all_frames(spark, sf_dir):
    """All frames as one window, as a dark frame is made of a whole recording."""
    frames = _packed(spark, sf_dir)
    mean, _ = kernels.average(frames, frames.count(), std=False)
    return fr.pixels(mean, "raw", "f32").withColumn("v", F.round("v", 3))


_MEDIANS = PX + """, green as (select frame_no, y, x // 2 as k, v as g from px where (x + y + 1) % 2 = 0),
med as (select a.frame_no, l.lag, a.y, list_sort(list(a.g - b.g))[count(*) // 2 + 1] as d
        from green a cross join (values (1), (2), (3)) l(lag) join green b on a.frame_no = b.frame_no and a.k = b.k and b.y = a.y + l.lag group by all)"""


@query(f"with {_MEDIANS} select frame_no, lag, y, d from med")
def rownoise_green_median(spark, sf_dir):
    return operators.green_medians(px(spark, sf_dir), 3)


_MEAN_MODEL = PX + ", noise as (select frame_no, y, sum(v - 128) * 0.0375 as off from px where x < 8 or x >= 12 group by all)"
_CORRECTED = "cast(least(greatest(floor(round(v - off, 6)), 0), 65535) as integer)"


@query(f"with {_MEAN_MODEL} select frame_no, y, x, {_CORRECTED} as v from px join noise using (frame_no, y)")
def rownoise_mean_model(spark, sf_dir):
    return operators.remove_row_noise(px(spark, sf_dir), WIDTH, HEIGHT, operators.MODELS["internal:mean"])


@query(f"with {_MEAN_MODEL} select frame_no, y, cast(x - 8 as integer) as x, {_CORRECTED} as v from px join noise using (frame_no, y) where x between 8 and 11")
def rownoise_strip(spark, sf_dir):
    return operators.remove_row_noise(px(spark, sf_dir), WIDTH, HEIGHT, operators.MODELS["internal:mean"], strip_dark_columns=True)


def _green_sql() -> str:
    model = operators.MODELS["internal:only_green"]
    rows = ", ".join(f"({p}, {lag + 1}, {half.green[lag][0]!r}::double, {half.green[lag][1]!r}::double)" for p, half in enumerate((model.even, model.odd)) for lag in range(3))
    return f"""with {_MEDIANS}, w(parity, lag, w0, w1) as (values {rows}),
off as (select m.frame_no, r.y, sum(case when m.y = r.y - m.lag then -m.d * w0 else 0 end + case when m.y = r.y then m.d * w1 else 0 end) as off
        from range(3, 7) r(y) join w on w.parity = r.y % 2 join med m on m.lag = w.lag and m.y in (r.y, r.y - m.lag) group by all)
select frame_no, y, x, cast(case when off is null then v else least(greatest(floor(round(v - off - case when y % 2 = 0 then {model.even.offset!r} else {model.odd.offset!r} end, 6)), 0), 65535) end as integer) as v
from px left join off using (frame_no, y)"""


@query(_green_sql())
def rownoise_only_green(spark, sf_dir):
    return operators.remove_row_noise(px(spark, sf_dir), WIDTH, HEIGHT, operators.MODELS["internal:only_green"])


@query(
    f"with {_DEBAYER}, c as (select frame_no, y, x, least(greatest((r - 8) / 248.0::double, 0), 1) as r, least(greatest((g - 8) / 248.0::double, 0), 1) as g, least(greatest((b - 8) / 248.0::double, 0), 1) as b from rgb), "
    "h as (select *, greatest(r, g, b) as hi, greatest(r, g, b) - least(r, g, b) as span from c), "
    "s as (select *, case when hi > 0 then span / hi else 0 end as sat from h) select frame_no, y, x, "
    + ", ".join(f"cast(least(greatest(floor(round(pow(hi, 1.2::double) * (1 - pow(sat, 0.8::double) * (case when span > 0 then (hi - {c}) / span else 0 end)) * 256, 6)), 0), 255) as integer) as {c}" for c in "rgb")
    + " from s"
)
def color_voodoo(spark, sf_dir):
    return operators.color_voodoo(rgb(spark, sf_dir), 8, 0.8, 1.2)


def _lut_sql(exact: bool) -> str:
    wrap = (lambda i: f"least({i}, 4)") if exact else (lambda i: f"(({i} + 5) % 5)")
    place = (lambda c: f"{c} / 255.0::double * 4") if exact else (lambda c: f"{c} / 255.0::double * 5 - 0.5")
    corners = [(i, j, k) for k in range(2) for j in range(2) for i in range(2)]

    def channel(axis: str) -> str:
        terms = []
        for bits in corners:
            weight = " * ".join(f"f{c}" if b else f"(1 - f{c})" for c, b in zip("rgb", bits, strict=True))
            low = wrap(f"i{axis} + {bits['rgb'.index(axis)]}")
            terms.append(f"{weight} * floor({low} / 4.0::double * 255 + 1e-9)")
        return f"cast(floor(round({' + '.join(terms)}, 6)) as integer)"

    return (
        f"with {_DEBAYER}, u as (select frame_no, y, x, " + ", ".join(f"{place(c)} as u{c}" for c in "rgb") + " from rgb), f as (select *, "
        + ", ".join(f"cast(floor(u{c}) as integer) as i{c}, u{c} - floor(u{c}) as f{c}" for c in "rgb") + f" from u) select frame_no, y, x, {channel('g')} as r, {channel('b')} as g, {channel('r')} as b from f"
    )


@query(_lut_sql(False))
def lut3d_reference(spark, sf_dir):
    return operators.apply_cube(rgb(spark, sf_dir), operators.parse_cube(cube_text()), "reference")


@query(_lut_sql(True))
def lut3d_exact(spark, sf_dir):
    return operators.apply_cube(rgb(spark, sf_dir), operators.parse_cube(cube_text()), "exact")


@query(f"with {PX} select frame_no * 2 + y % 2 as frame_no, cast(y // 2 as integer) as y, x, v from px")
def reverse_dual_even(spark, sf_dir):
    return operators.split_rows(px(spark, sf_dir))


@query(f"with {PX} select frame_no * 2 + (y + 1) % 2 as frame_no, cast(y // 2 as integer) as y, x, v from px")
def reverse_dual_flip(spark, sf_dir):
    return operators.split_rows(px(spark, sf_dir), flip=True)


def _packed_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.debayer(kernels.bit_depth(_packed(spark, sf_dir), 8))


@query(ORACLE_SQL["color_voodoo"])
def color_voodoo_frames(spark, sf_dir):
    return fr.pixels(kernels.color_voodoo(_packed_rgb(spark, sf_dir), 8, 0.8, 1.2), "rgb")


@query(ORACLE_SQL["lut3d_reference"])
def lut3d_frames(spark, sf_dir):
    return fr.pixels(kernels.apply_cube(_packed_rgb(spark, sf_dir), operators.parse_cube(cube_text()), "reference"), "rgb")


_HEADED = "cast(case when y < 2 and x = 0 then (frame_no * 2 + y) % 256 * 16 when y < 2 and x = 1 then (frame_no + 1) % 4 * 256 + case when y = 1 then 170 else 85 end else v end as integer) as v"


@query(f"with {PX} select frame_no, y, x, {_HEADED} from px")
def dual_decode(spark, sf_dir):
    return operators.decode_pairs(half_frames(spark, sf_dir))


@query(f"with {PX}, g as (select frame_no, y, x, {_HEADED} from px) select frame_no, y, x, v from g where frame_no < 3 union all select frame_no, y, x, v from g where frame_no > 3")
def dual_decode_slipped(spark, sf_dir):
    """Half frame 7 is missing; the pair that it breaks is a gap, and later pairs keep their numbers."""
    return operators.decode_pairs(half_frames(spark, sf_dir).where("half_no <> 7"))


def _packed_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    halves = packing.to_frames(half_frames(spark, sf_dir).withColumnRenamed("half_no", "frame_no"))
    return fr.described(halves, fr.Interpretation(WIDTH // 2, HEIGHT // 2, rgb=True, fps=48.0))


@query(f"with {PX} select frame_no, y, x, {_HEADED} from px")
def dual_decode_frames(spark, sf_dir):
    return fr.pixels(kernels.join_rows(_packed_halves(spark, sf_dir)), "raw", "p12")


@query(f"with {PX}, g as (select frame_no, y, x, {_HEADED} from px) select frame_no, y, x, v from g where frame_no < 3 union all select frame_no, y, x, v from g where frame_no > 3")
def dual_decode_slipped_frames(spark, sf_dir):
    return fr.pixels(kernels.join_rows(_packed_halves(spark, sf_dir).where("frame_no <> 7")), "raw", "p12")


@query(f"with {PX} select * from px where frame_no < 3")
def number_of_frames(spark, sf_dir):
    return operators.number_of_frames(px(spark, sf_dir), 3)


@query(f"with {PX}, n as (select count(distinct frame_no) as n from px) select frame_no + k * n as frame_no, y, x, v from px, n, range(3) r(k)")
def internal_loop(spark, sf_dir):
    frames = px(spark, sf_dir)
    return operators.internal_loop(frames, 3, frames.select("frame_no").distinct().count())


@query(f"with {_DEBAYER} select frame_no, y, x, b as r, g, r as b from rgb")
def bgr_swap(spark, sf_dir):
    return operators.swap_red_blue(rgb(spark, sf_dir))


@query(f"with {PX}, f as (select distinct frame_no from px where frame_no % 7 <> 3), l as (select lag(frame_no) over (order by frame_no) as after_frame, frame_no from f) select after_frame, frame_no - after_frame - 1 as missing from l where frame_no - after_frame > 1")
def seq_gap(spark, sf_dir):
    return operators.sequence_gaps(px(spark, sf_dir).where("frame_no % 7 <> 3"))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.raw_frames(packing.to_frames(px(spark, sf_dir)), WIDTH, HEIGHT, "p12")


@query(f"with {PX} select * from px")
def blob_write_read(spark, sf_dir):
    path = f"{scratch_folder(spark)}/frames.blob"
    sinks.write_blob(_packed(spark, sf_dir), path)
    return fr.pixels(sources.read_blob(spark, path, fr.Interpretation(WIDTH, HEIGHT, 12)))


@query(f"with {P8} select frame_no, y, x, cast(v as integer) as v from p8 where frame_no < (select count(distinct frame_no) // 2 from px)")
def blob_first_frames(spark, sf_dir):
    """The first half of a blob's frames, through a step: the rest isn't read."""
    path, frames = f"{scratch_folder(spark)}/first.blob", _packed(spark, sf_dir)
    n = sinks.write_blob(frames, path)
    read = kernels.bit_depth(sources.read_blob(spark, path, fr.Interpretation(WIDTH, HEIGHT, 12)), 8)
    return fr.pixels(operators.number_of_frames(read, n // 2), "raw", "u8")


@query(f"with {PX} select frame_no, y, x, v from px where frame_no = (select max(frame_no) // 2 from px)")
def blob_one_frame(spark, sf_dir):
    """The frame in the middle of a blob, without those around it."""
    path, frames = f"{scratch_folder(spark)}/one.blob", _packed(spark, sf_dir)
    n = sinks.write_blob(frames, path)
    read = sources.read_blob(spark, path, fr.Interpretation(WIDTH, HEIGHT, 12), push_filters=True)
    return fr.pixels(read.where(F.col("frame_no") == (n - 1) // 2), "raw", "p12")


@query(f"with {PX} select * from px")
def dir_write_read(spark, sf_dir):
    path = f"{scratch_folder(spark)}/raw"
    sinks.write_directory(_packed(spark, sf_dir), path)
    return fr.pixels(sources.read_directory(spark, f"{path}/*.data", fr.Interpretation(WIDTH, HEIGHT, 12)))


@query(f"with {PX} select * from px")
def dng_write_read(spark, sf_dir):
    path = f"{scratch_folder(spark)}/dng"
    sinks.write_dng(_packed(spark, sf_dir), path)
    return fr.pixels(sources.read_dng(spark, f"{path}/*.dng"))


@query(f"with {PX} select * from px")
def zstd_read(spark, sf_dir):
    path = f"{scratch_folder(spark)}/frames.zst"
    sinks.write_blob(_packed(spark, sf_dir), path, compression="zstd")
    return fr.pixels(sources.read_zstd(spark, path, fr.Interpretation(WIDTH, HEIGHT, 12)))


def _ebc_sql(half: str) -> str:
    """Whole samples in steps of 2 half + 1, half being the whole part of what one sample may be off."""
    return f"""with {PX}, f as (select frame_no, max(v) - min(v) as span, count(*) as n from px group by frame_no),
h as (select frame_no, cast(floor({half}) as bigint) as half from f)
select frame_no, y, x, cast(least((v + half) // (2 * half + 1) * (2 * half + 1), 65535) as integer) as v from px join h using (frame_no)"""


def _ebc(spark, sf_dir, tolerance: float, control: str) -> DataFrame:
    return fr.pixels(kernels.decompress(kernels.compress(kernels.bit_depth(_packed(spark, sf_dir), 16), tolerance, control)), "raw", "u16")


@query(_ebc_sql("4.7::double"))
def ebc_roundtrip(spark, sf_dir):
    return _ebc(spark, sf_dir, 4.7, "abs")


@query(_ebc_sql("0.01::double * span"))
def ebc_relative(spark, sf_dir):
    return _ebc(spark, sf_dir, 0.01, "rel")


@query(_ebc_sql("span * pow(10::double, -45.0::double / 20)"))
def ebc_psnr(spark, sf_dir):
    return _ebc(spark, sf_dir, 45.0, "psnr")


@query(_ebc_sql("100.0::double / sqrt(n)"))
def ebc_l2norm(spark, sf_dir):
    return _ebc(spark, sf_dir, 100.0, "l2norm")


@query(f"with {P8} select frame_no, y, x, cast(v as integer) as v from p8 union all select frame_no, y, x, cast(v as integer) as v from p8")
def cache_fanout(spark, sf_dir):
    shared = kernels.bit_depth(_packed(spark, sf_dir), 8).persist()
    return fr.pixels(shared).unionByName(fr.pixels(shared))


_GRAPH = """
input:
  type: RawDirectoryReader
  file-pattern: {{ folder }}/*.data
  width: 20
  height: 10
depth:
  type: GpuBitDepthConverter
  input: <input
rgb:
  type: Debayer
  input: <depth
bench:
  type: BenchmarkSink
  input: <rgb
  rounds: 1
"""


@query(f"with {_DEBAYER} select * from rgb")
def graph_yaml(spark, sf_dir):
    path = f"{scratch_folder(spark)}/graph"
    sinks.write_directory(_packed(spark, sf_dir), path)
    nodes = graph.parse_yaml(_GRAPH, {"folder": path})
    graph.run(spark, nodes)
    return fr.pixels(graph.build(spark, nodes)["rgb"], "rgb")


@query(f"with {_DEBAYER} select * from rgb")
def graph_inline(spark, sf_dir):
    path = f"{scratch_folder(spark)}/inline"
    sinks.write_directory(_packed(spark, sf_dir), path)
    line = f"RawDirectoryReader --file-pattern {path}/*.data --width 20 --height 10 ! BitDepthConverter ! Debayer ! RawBlobWriter --path {path}.rgb"
    graph.run(spark, graph.parse_inline(line))
    return fr.pixels(sources.read_blob(spark, f"{path}.rgb", fr.Interpretation(WIDTH, HEIGHT, rgb=True)), "rgb")


@query(f"with {PX} select frame_no, y, x, cast(v // 16 as integer) as v from px where frame_no % 7 <> 3")
def frame_gaps(spark, sf_dir):
    """Files cut short are gaps in what a pipeline gives; the other frames keep their numbers."""
    path = f"{scratch_folder(spark)}/broken"
    cut = F.when(F.col("frame_no") % 7 == 3, F.substring("data", 1, 100)).otherwise(F.col("data"))
    sinks.write_directory(_packed(spark, sf_dir).withColumn("data", cut), path)
    nodes = graph.parse_inline(f"RawDirectoryReader --file-pattern {path}/*.data --width {WIDTH} --height {HEIGHT} ! BitDepthConverter")
    return fr.pixels(graph.build(spark, nodes)[nodes[-1].name], "raw", "u8")


@query(f"with {PX} select distinct frame_no, 'the file is shorter than a frame' as error from px where frame_no % 7 = 3")
def frame_errors(spark, sf_dir):
    path = f"{scratch_folder(spark)}/errors"
    cut = F.when(F.col("frame_no") % 7 == 3, F.substring("data", 1, 100)).otherwise(F.col("data"))
    sinks.write_directory(_packed(spark, sf_dir).withColumn("data", cut), path)
    frames = sources.read_directory(spark, f"{path}/*.data", fr.Interpretation(WIDTH, HEIGHT, 12), keep_going=True)
    return fr.failures(kernels.bit_depth(frames, 8)).select("frame_no", F.substring_index("error", ":", 1).alias("error"))


@query(f"with {PX} select * from px")
def tcp_read(spark, sf_dir):
    """Frames of a sender on the driver, to the end of the connection; kept, and the sender closed."""
    frames, folder = _packed(spark, sf_dir), scratch_folder(spark)
    host = spark.conf.get("spark.driver.host", "127.0.0.1")
    with socket.create_server((host, 0)) as server:

        def serve() -> None:
            while True:
                try:
                    connection, _ = server.accept()
                except OSError:  # closed
                    return
                with connection:
                    for _, data in fr.pull_ordered(frames):
                        connection.sendall(data)

        threading.Thread(target=serve, daemon=True).start()
        sources.read_tcp(spark, f"{host}:{server.getsockname()[1]}", fr.Interpretation(WIDTH, HEIGHT, 12)).write.parquet(folder)
    return fr.pixels(spark.read.schema(fr.SCHEMA).parquet(folder), "raw", "p12")


@query(f"with {_DEBAYER} select * from rgb")
def encoder_pipe(spark, sf_dir):
    """Frames pulled in order into an encoder's standard input; this one keeps them as they come."""
    folder = scratch_folder(spark)
    os.makedirs(folder)
    with open(f"{folder}/encoder", "w") as file:
        file.write('#!/bin/sh\nfor last in "$@"; do :; done\ncat > "$last"\n')
    os.chmod(f"{folder}/encoder", 0o755)
    sinks.write_encoder(_packed_rgb(spark, sf_dir), f"{folder}/film", program=f"{folder}/encoder")
    return fr.pixels(sources.read_blob(spark, f"{folder}/film", fr.Interpretation(WIDTH, HEIGHT, rgb=True)), "rgb")


SEGMENT = 200  # frames of a recording that make a stream; buffers go round by 4 and windows by 5, so none is cut


def _in_streams(frames: DataFrame, given: int, n: int) -> DataFrame:
    """Frames with `stream`, the number of its first frame: streams end after `given` frames and at gaps, and begin at multiples of n, but for the rest of a group of n after a gap."""
    cut = Window.partitionBy(F.expr(f"frame_no div {given}")).orderBy("frame_no")
    begins = F.when(F.coalesce(F.lag("frame_no").over(cut) + 1 < F.col("frame_no"), F.lit(True)), F.col("frame_no"))
    runs = frames.withColumn("begins", begins).withColumn("run", F.last("begins", ignorenulls=True).over(cut))
    group = F.expr(f"(run + {n - 1}) div {n} * {n}")
    return runs.withColumn("stream", F.when(F.col("frame_no") < group, F.col("run")).otherwise(group).cast("string")).drop("begins", "run")


def _streamed(spark, frames: DataFrame, step, name: str, given: int, n: int) -> DataFrame:
    """What a step that makes one frame of n makes of frames that come as streams of at most `given`; numbered through."""
    folder = scratch_folder(spark)
    _in_streams(frames, given, n).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{folder}/in").schema).parquet(f"{folder}/in")
    out = step(stream).writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    out.awaitTermination()
    return spark.read.parquet(f"{folder}/{name}").withColumn("frame_no", F.expr(f"cast(stream as long) div {n}") + F.col("frame_no"))


@query(f"with {PX}, h as (select frame_no, y, x, {_HEADED} from px) select * from h")
def stream_dual_decode(spark, sf_dir):
    """Frames have the number of their half frames, so that one which the rule passes over moves no other."""
    halves = half_frames(spark, sf_dir).withColumnRenamed("half_no", "frame_no")
    packed = packing.to_frames(halves).select("frame_no", F.lit(HEIGHT // 2).alias("height"), "data")
    made = _streamed(spark, packed, streaming.stream_pairs, "pairs", 2 * SEGMENT, 2)
    return fr.pixels(fr.raw_frames(made.select(F.expr("half_no div 2").alias("frame_no"), "data"), WIDTH, HEIGHT, "p12"), "raw", "p12")


@query(f"with {PX} select frame_no // 5 as frame_no, y, x, round(avg(v), 2) as v from px group by all having count(*) = 5")
def stream_average(spark, sf_dir):
    made = _streamed(spark, packing.to_frames(px(spark, sf_dir)), lambda frames: streaming.stream_average(frames, 5), "mean", SEGMENT, 5)
    planes = fr.raw_frames(made.select("frame_no", F.col("mean").alias("data")), WIDTH, HEIGHT, "f32")
    return fr.pixels(planes, "raw", "f32").withColumn("v", F.round("v", 2))


@query(f"with {PX}, n as (select count(distinct frame_no) as n from px) select frame_no + k * n as frame_no, y, x, v from px, n, range(2) r(k)")
def replay_rounds(spark, sf_dir):
    """The first two rounds of an endless replay of all frames: each number is shown once.

    Of many frames the pace is higher, so that a round takes some five seconds and there are few batches.
    """
    frames = _packed(spark, sf_dir).persist()
    n, folder = frames.count(), scratch_folder(spark)
    shown = sources.replay(spark, frames, n, frames_per_second=max(200, n // 5)).writeStream.format("parquet").option("path", f"{folder}/shown").option("checkpointLocation", f"{folder}/state").start()
    try:
        while not shown.awaitTermination(1):  # raises what ends it
            if os.path.isdir(f"{folder}/shown/_spark_metadata") and spark.read.schema(fr.SCHEMA).parquet(f"{folder}/shown").where(F.col("frame_no") < 2 * n).count() >= 2 * n:
                break
    finally:
        shown.stop()
        frames.unpersist()
    return fr.pixels(spark.read.schema(fr.SCHEMA).parquet(f"{folder}/shown").where(F.col("frame_no") < 2 * n), "raw", "p12")


@query(f"with {PX} select frame_no, y, x, cast(4095 - v as integer) as v from px")
def own_node(spark, sf_dir):
    """A node type of the user's own in a pipeline."""

    @registry.register_node("PlansNegative", {"top": registry.Parameter("int", 4095, 0, 4095)}, registry.takes(registry.Port("raw", "p12")))
    def _(spark, p, frames):
        return fr.map_frames(frames, lambda row: [fr.made(row, p["top"] - fr.array_of(row))])

    path = f"{scratch_folder(spark)}/own.blob"
    sinks.write_blob(_packed(spark, sf_dir), path)
    nodes = graph.parse_inline(f"RawBlobReader --file {path} --width {WIDTH} --height {HEIGHT} ! PlansNegative")
    try:
        return fr.pixels(graph.build(spark, nodes)[nodes[-1].name], "raw", "p12")
    finally:
        del registry.NODES["PlansNegative"]  # as if it had never been there


def _dark_sql(model: operators.RowNoiseModel) -> str:
    """Row noise by dark columns and green differences, spelled out."""
    dark = ", ".join(
        f"({p}, {operators.pair_lag(i)}, {h}, {c}, {w!r}::double)" for p, half in enumerate((model.even, model.odd)) for i, pair in enumerate(half.dark) for h, row in enumerate(pair) for c, w in enumerate(row)
    )
    green = ", ".join(f"({p}, {k + 1}, {g[0]!r}::double, {g[1]!r}::double)" for p, half in enumerate((model.even, model.odd)) for k, g in enumerate(half.green)) or "(0, 99, 0::double, 0::double)"
    edge = model.uncorrectable
    return f"""with {_MEDIANS}, dw(parity, pair, half, c, w) as (values {dark}), gw(parity, lag, w0, w1) as (values {green}),
d as (select frame_no, y, case when x < 8 then x else x - {WIDTH - 16} end as c, v - 128 as v from px where x < 8 or x >= {WIDTH - 8}),
parts as (
  select d.frame_no, r.y, sum(d.v * w) as part from range({edge}, {HEIGHT - edge}) r(y) join dw on dw.parity = r.y % 2 join d on d.c = dw.c and d.y = r.y - r.y % 2 + 2 * dw.pair + dw.half group by all
  union all
  select m.frame_no, r.y, sum(case when m.y = r.y - m.lag then -m.d * w0 else 0 end + case when m.y = r.y then m.d * w1 else 0 end) from range({edge}, {HEIGHT - edge}) r(y) join gw on gw.parity = r.y % 2
  join med m on m.lag = gw.lag and m.y in (r.y, r.y - m.lag) group by all),
off as (select frame_no, y, sum(part) as off from parts group by all)
select frame_no, y, x, cast(case when off is null then v else least(greatest(floor(round(v - off - case when y % 2 = 0 then {model.even.offset!r} else {model.odd.offset!r} end, 6)), 0), 65535) end as integer) as v
from px left join off using (frame_no, y)"""


@query(_dark_sql(operators.load_model("internal:good")))
def rownoise_good(spark, sf_dir):
    return operators.remove_row_noise(px(spark, sf_dir), WIDTH, HEIGHT, operators.load_model("internal:good"))


@query(_dark_sql(operators.load_model("internal:only_dark")))
def rownoise_only_dark(spark, sf_dir):
    return operators.remove_row_noise(px(spark, sf_dir), WIDTH, HEIGHT, operators.load_model("internal:only_dark"))


@query(_dark_sql(operators.load_model("internal:good")))
def rownoise_default_frames(spark, sf_dir):
    return fr.pixels(kernels.row_noise(kernels.bit_depth(_packed(spark, sf_dir), 16), operators.load_model("internal:good")), "raw", "u16")


@query(f"with {PX}, m as (select frame_no, y, avg(v) - 128 as t from px where x between 8 and 11 group by all), r as (select *, t - avg(t) over (partition by frame_no) as target from m) select cast(y % 2 as integer) as parity, round(avg(target), 6) as offset_weight from r group by all")
def rownoise_trained_offsets(spark, sf_dir):
    """A model of constants alone is the mean residual of even and of odd rows."""
    model = operators.train_model(px(spark, sf_dir), WIDTH, HEIGHT, lags=0, pairs=0)
    return spark.createDataFrame([(0, round(model.even.offset, 6)), (1, round(model.odd.offset, 6))], "parity int, offset_weight double")


_TRAINING = f"""with {_MEDIANS}, m as (select frame_no, y, avg(v) - 128 as t from px where x between 8 and {WIDTH - 9} group by all),
features as (
  select frame_no, y, 'target' as name, t - avg(t) over (partition by frame_no) as value from m
  union all select frame_no, y, 'one', 1 from m
  union all select frame_no, y, 'g' || lag || '_1', d from med
  union all select frame_no, y + lag, 'g' || lag || '_0', -d from med
  union all
  select px.frame_no, r.y, 'd' || i || '_' || (px.y % 2) || '_' || case when x < 8 then x else x - {WIDTH - 16} end, v - 128
  from range({HEIGHT}) r(y) join (values (0, 0), (1, -1), (2, 1)) p(i, away) on true join px on px.y // 2 = r.y // 2 + p.away where x < 8 or x >= {WIDTH - 8}),
inner_rows as (select * from features where y between 3 and {HEIGHT - 4})
select cast(a.y % 2 as integer) as parity, a.name as a, b.name as b, cast(round(sum(a.value * b.value) * 1600) as bigint) as total
from inner_rows a join inner_rows b on a.frame_no = b.frame_no and a.y = b.y and a.name <= b.name group by all"""


@query(_TRAINING)
def rownoise_training_sums(spark, sf_dir):
    """The normal equations that a model of three lags and three pairs of dark rows is trained by; times 1600 they are whole."""
    sums, names = operators.training_sums(px(spark, sf_dir), WIDTH, HEIGHT, lags=3, pairs=3)
    named = spark.createDataFrame(list(enumerate(names)), "i int, a string")
    both = sums.join(F.broadcast(named), "i").join(F.broadcast(named.toDF("j", "b")), "j")
    return both.select("parity", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.round(F.col("total") * 1600).cast("long").alias("total"))


@query(f"with {PX}, n as (select count(distinct frame_no) as n from px) select n as frames, true as timed, cast(200 as bigint) as preview_pixels from n")
def benchmark_and_preview(spark, sf_dir):
    frames = _packed(spark, sf_dir)
    report = sinks.benchmark(frames, rounds=1)
    width, height = struct.unpack(">II", sinks.preview(frames, 3)[16:24])
    return spark.createDataFrame([(report["frames"], report["fps"] > 0, width * height)], "frames long, timed boolean, preview_pixels long")


@query(f"with {PX} select frame_no, y, x, v from px where frame_no = 4")
def dng_served(spark, sf_dir):
    """A file of the frame server, with a profile of the user's own, read again."""
    folder = scratch_folder(spark)
    os.makedirs(f"{folder}/served")
    with open(f"{folder}/profile.yml", "w") as file:
        file.write("UniqueCameraModel: own\nCalibrationIlluminant1: D65\nColorMatrix1: [1, 0, 0, 0, 1, 0, 0, 0, 1]\n")
    server = sinks.FrameServer(_packed(spark, sf_dir), sinks.read_profile(f"{folder}/profile.yml"))
    with open(f"{folder}/served/000004.dng", "wb") as file:
        file.write(server.read("000004.dng"))
    return fr.pixels(sources.read_dng(spark, f"{folder}/served/*.dng").withColumn("frame_no", F.lit(4).cast("long")), "raw", "p12")

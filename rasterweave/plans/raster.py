"""The registered raster queries, each with the SQL it is held against where SQL can express it."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as fx
from .. import functions as pt
from .. import operators as op
from ..fixtures import CHIPS, GRAY, MULTI
from ..operators import edges, keypoints, neighborhood, segmentation, stats
from ..operators.filters import gaussian_kernel
from ..operators.morphology import offsets
from ..operators.neighborhood import in_strips, own_rows
from ..operators.segmentation import nearest
from ..operators.texture import ANGLES
from ..sources import raster as src
from ..storage import scratch
from . import sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def r6(c: Column | str) -> Column:
    """Rounded to 6 places, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def yx(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select("y", "x", *[c.alias(n) for n, c in columns.items()])


def mask(spark: SparkSession, d: str) -> DataFrame:
    return op.binary(fx.scene_gray(spark, d), 150)


MASK = "fg as materialized (select y, x, v >= 150 as fg from g)"

# Sources and sinks -----------------------------------------------------------------------------------------------


def _scene_files(spark: SparkSession, d: str) -> DataFrame:
    long = fx.scene_long(spark, d).withColumn("image_id", F.lit("scene")).withColumn("v", F.col("v").cast("double"))
    files = src.to_tiff(long, "uint8", affine=(10.0, 0.0, 500000.0, 0.0, -10.0, 4600000.0), epsg=32630, description="band")
    return files.select(F.concat_ws("/", "image_id", "band").alias("path"), "content")


@query("s1_read_raster_round_trip", f"with {MULTI} select 'scene/' || band as image_id, 1 as band, y, x, v::double as v from ml")
def _(spark, d):
    return src.decoded(_scene_files(spark, d))


@query("s4_describe", f"with {MULTI} select 'scene/' || band as image_id, 64 as width, 64 as height, 1 as count, 'uint8' as dtype, 32630 as epsg, 10.0::double as pixel, 500640.0::double as right_edge from ml group by band")
def _(spark, d):
    m = src.described(_scene_files(spark, d))
    return m.select("image_id", "width", "height", "count", F.col("dtypes")[0].alias("dtype"), "epsg", F.col("res")[0].alias("pixel"), F.col("bounds")[2].alias("right_edge"))


@query("s2_read_band", f"with {MULTI} select y, x, v::double as v from ml where band = 4")
def _(spark, d):
    return src.decoded(_scene_files(spark, d).where("path like '%4'"), [1]).select("y", "x", "v")


@query("s7_to_gray", f"with {MULTI} select y, x, ((swir * 19595 + green * 38470 + red * 7471 + 32768) >> 16)::int as v from m")
def _(spark, d):
    return src.to_gray(fx.scene_long(spark, d)).select("y", "x", "v")


@query("s10_features", f"with {MULTI} select y, x, red as b3, nir as b4 from m")
def _(spark, d):
    return src.features(fx.scene_long(spark, d), [3, 4]).select("y", "x", "b3", "b4")


@query("s9_to_binary", sql.gray(select="select y, x, case when v >= 127 then 255 else 0 end as v from g"))
def _(spark, d):
    return yx(op.binary(fx.scene_gray(spark, d)), v=pt.to_unit("fg"))


@query("k1_png", sql.gray(select="select 1 as band, y, x, v::double as v from g"))
def _(spark, d):
    """Written as a file and read again."""
    at = scratch(spark, "png")
    src.write_scenes(src.to_png(fx.scene_gray(spark, d)), at, ".png")
    return src.read_images(spark, at).select("band", "y", "x", "v")


@query("s5_extracted_bands", f"with {MULTI}, s as (select band, quantile_cont(v, 0.02) as lo, quantile_cont(v, 0.98) as hi from ml group by band) select band, y, x, v::double as v, trunc(least(1, greatest(0, (v - lo) / (hi - lo + 1e-9))) * 255)::double as preview from ml join s using (band)")
def _(spark, d):
    """A file and a preview a band, written and read again."""
    at = scratch(spark, "bands")
    px = fx.scene_long(spark, d).withColumn("image_id", F.lit("scene")).withColumn("v", F.col("v").cast("double"))
    src.extract_bands(px, at, "uint8")
    number = F.regexp_extract("image_id", r"band_(\d+)\.", 1).cast("int").alias("band")
    files = src.read_raster(spark, at).select(number, "y", "x", "v")
    return files.join(src.read_images(spark, f"{at}/*/*.png").select(number, "y", "x", F.col("v").alias("preview")), ["band", "y", "x"])


@query("k5_panels", f"with {GRAY}, s as (select quantile_cont(v, 0.02) as lo, quantile_cont(v, 0.98) as hi, min(v) as a, max(v) as b from g) select p as panel, count(*) as n, round(sum(v), 3) as total from (select 'linear' as p, least(1, greatest(0, (v - a) / (b - a + 1e-9))) as v from g, s union all select 'percentile', least(1, greatest(0, (v - lo) / (hi - lo + 1e-9))) from g, s) group by p")
def _(spark, d):
    g = fx.scene_gray(spark, d)
    both = op.linear_stretch(g).select(F.lit("linear").alias("panel"), "v").union(op.percentile_stretch(g).select(F.lit("percentile"), "v"))
    return both.groupBy("panel").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 3).alias("total"))


# Point operators -------------------------------------------------------------------------------------------------


@query("p1_percentile_stretch", sql.gray("s as (select quantile_cont(v, 0.02) as lo, quantile_cont(v, 0.98) as hi from g)", select="select y, x, round(least(1, greatest(0, (v - lo) / (hi - lo + 1e-9))), 6) as v from g, s"))
def _(spark, d):
    return yx(op.percentile_stretch(fx.scene_gray(spark, d)), v=r6("v"))


@query("p2_linear_stretch", sql.gray("s as (select min(v) as lo, max(v) as hi from g)", select="select y, x, round(least(1, greatest(0, (v - lo) / (hi - lo + 1e-9))), 6) as v from g, s"))
def _(spark, d):
    return yx(op.linear_stretch(fx.scene_gray(spark, d)), v=r6("v"))


@query("p3_reflectance", sql.gray(select="select y, x, round(least(1, greatest(0, v * 50 / 10000.0::double)), 6) as v from g"))
def _(spark, d):
    return yx(fx.scene_gray(spark, d), v=r6(pt.reflectance(F.col("v") * 50)))


@query("p4_gamma", sql.gray(select="select y, x, round(least(1, greatest(0, pow(v / 255.0::double, 0.5))), 6) as bright, round(least(1, greatest(0, pow(v / 255.0::double, 2.0))), 6) as dark from g"))
def _(spark, d):
    u = F.col("v") / 255.0
    return yx(fx.scene_gray(spark, d), bright=r6(pt.adjust_gamma(u, 0.5)), dark=r6(pt.adjust_gamma(u, 2.0)))


@query("p5_brightness_contrast", sql.gray(select="select y, x, round(least(1, greatest(0, 1.5::double * (v / 255.0::double) + 0.1::double)), 6) as v from g"))
def _(spark, d):
    return yx(fx.scene_gray(spark, d), v=r6(pt.adjust_brightness_contrast(F.col("v") / 255.0, 1.5, 0.1)))


@query("p6_rgb_composite", f"with {MULTI}, s as (select band, quantile_cont(v, 0.02) as lo, quantile_cont(v, 0.98) as hi from ml group by band), t as (select ml.band, y, x, round(least(1, greatest(0, (v - lo) / (hi - lo + 1e-9))), 6) as v from ml join s on s.band = ml.band) select y, x, max(case when band = 3 then v end) as r, max(case when band = 2 then v end) as g, max(case when band = 1 then v end) as b from t group by y, x")
def _(spark, d):
    s = op.percentile_stretch(fx.scene_long(spark, d).where("band <= 3"), keys=("image_id", "band"))
    w = src.features(s, [3, 2, 1])
    return yx(w, r=r6("b3"), g=r6("b2"), b=r6("b1"))


def _nd(a: str, b: str) -> str:
    return f"case when {a} + {b} = 0 then 0 else round(least(1, greatest(-1, ({a} - {b}) / ({a} + {b})::double)), 6) + 0.0 end"


@query("p7_ndvi", f"with {MULTI} select y, x, {_nd('nir', 'red')} as ndvi from m")
def _(spark, d):
    return yx(fx.scene_multi(spark, d), ndvi=r6(pt.ndvi("nir", "red")))


@query("p8_indices", f"with {MULTI} select y, x, {_nd('nir', 'red')} as ndvi, {_nd('green', 'nir')} as ndwi, {_nd('swir', 'nir')} as ndbi from m")
def _(spark, d):
    return yx(fx.scene_multi(spark, d), ndvi=r6(pt.ndvi("nir", "red")), ndwi=r6(pt.ndwi("green", "nir")), ndbi=r6(pt.ndbi("swir", "nir")))


@query("p9_ndvi_null", f"with {MULTI} select y, x, case when nir + red - 300 = 0 then null else round((nir - (red - 300)) / (nir + red - 300)::double, 6) + 0.0 end as ndvi from m")
def _(spark, d):
    return yx(fx.scene_multi(spark, d), ndvi=r6(pt.ndvi("nir", F.col("red") - 300, zero="null")))


@query("p10_index_image", f"with {MULTI} select y, x, trunc((least(1, greatest(-1, case when nir + red = 0 then 0 else (nir - red) / (nir + red)::double end)) + 1.0) / 2.0 * 255.0)::int as v from m")
def _(spark, d):
    return yx(fx.scene_multi(spark, d), v=pt.index_byte(pt.ndvi("nir", "red")))


def _ramp_sql(k: int) -> str:
    out = f"when u <= 0 then {pt.RAMP[0][1][k]}.0::double"
    for (x0, c0), (x1, c1) in zip(pt.RAMP, pt.RAMP[1:]):
        out += f" when u <= {x1}::double then (u - {x0}::double) / {x1 - x0}::double * {c1[k] - c0[k]}.0::double + {c0[k]}.0::double"
    return f"trunc(case {out} else {pt.RAMP[-1][1][k]}.0::double end)::int"


@query("p11_vegetation_ramp", sql.gray("t as (select y, x, v / 255.0::double as u from g)", select=f"select y, x, {_ramp_sql(0)} as r, {_ramp_sql(1)} as g, {_ramp_sql(2)} as b from t"))
def _(spark, d):
    got = fx.scene_gray(spark, d).withColumn("c", pt.ramp(F.col("v") / 255.0))
    return got.select("y", "x", "c.r", "c.g", "c.b")


@query("k1_shaded", sql.gray("t as (select y, x, least(1, greatest(0, (v - 50) / 150.0::double)) as u from g)", select=f"select y, x, {_ramp_sql(0)} as r, {_ramp_sql(1)} as g, {_ramp_sql(2)} as b from t"))
def _(spark, d):
    return src.shaded(fx.scene_gray(spark, d), 50, 200, pt.RAMP).select("y", "x", "r", "g", "b")


@query("p12_quantise", sql.gray(select="select y, x, greatest(0, least(7, v * 8 // 256))::int as v from g"))
def _(spark, d):
    return yx(fx.scene_gray(spark, d), v=pt.quantise("v", 8))


@query("p14_nodata_mask", f"with {MULTI} select band, count(*) as n, count(nullif(v, 7)) as n_valid, round(avg(nullif(v, 7)), 6) as mean from ml group by band")
def _(spark, d):
    got = fx.scene_long(spark, d).withColumn("v", pt.valid("v", 7))
    return got.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("n_valid"), r6(F.avg("v")).alias("mean"))


@query("p17_per_channel", f"with {MULTI}, o as (select a.band, a.y, a.x, sum(b.v) as s from (select band, y, x, ({sql.mirror('y + dy', '63')})::int as ty, ({sql.mirror('x + dx', '63')})::int as tx from ml, range(-1, 2) p(dy), range(-1, 2) q(dx)) a join ml b on b.band = a.band and b.y = a.ty and b.x = a.tx group by 1, 2, 3) select band, y, x, round(s / 9.0::double, 6) as v from o")
def _(spark, d):
    got = op.mean_blur(fx.scene_long(spark, d), 3, keys=("image_id", "band"))
    return got.select("band", "y", "x", r6("v").alias("v"))


# Predicates ------------------------------------------------------------------------------------------------------


@query("f1_manual_threshold", sql.gray(select="select y, x, v >= 127 as fg, not v >= 127 as inverted, v > 127 as strict from g"))
def _(spark, d):
    return yx(fx.scene_gray(spark, d), fg=pt.threshold("v"), inverted=pt.threshold("v", invert=True), strict=pt.threshold("v", strict=True))


OTSU = """h as (select t.v, coalesce(n, 0) as n from range(256) t(v) left join (select v, count(*) as n from g group by v) c on c.v = t.v),
r as (select v, n, sum(n) over (order by v) as n0, sum(n * v) over (order by v) as s0, sum(n) over () as na, sum(n * v) over () as sa from h),
sc as (select v, case when n0 * (na - n0) > 0 then pow(sa::double * n0 - s0::double * na, 2) / (n0 * (na - n0)) else 0 end as s from r),
ot as (select v::int as t from sc order by s desc, v limit 1)"""


@query("f3_otsu_threshold", sql.gray(OTSU, select="select y, x, v > t as fg from g, ot"))
def _(spark, d):
    return op.otsu_threshold(fx.scene_gray(spark, d)).select("y", "x", "fg")


@query("f8_interior", sql.gray(select="select count(*) as n, min(y) as y0, min(x) as x0, max(x) as x1 from g where y between 3 and (select max(y) - 3 from g) and x between 3 and 60"))
def _(spark, d):
    g = fx.scene_gray(spark, d)
    return neighborhood.interior(g, 3).agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("y0"), F.min("x").alias("x0"), F.max("x").alias("x1"))


# Joins and aggregates --------------------------------------------------------------------------------------------


@query("j1_band_alignment", f"with {MULTI} select a.y, a.x, a.v - b.v as difference from ml a join ml b on a.y = b.y and a.x = b.x where a.band = 4 and b.band = 3")
def _(spark, d):
    return yx(neighborhood.aligned(fx.scene_long(spark, d), [4, 3]), difference=F.col("b4") - F.col("b3"))


CENTRES = [[40.0, 60.0, 80.0], [120.0, 130.0, 140.0], [200.0, 90.0, 30.0], [220.0, 210.0, 200.0]]


def _nearest_sql() -> str:
    d = [f"pow(red - {a}, 2) + pow(nir - {b}, 2) + pow(green - {c}, 2)" for a, b, c in CENTRES]
    least = f"least({', '.join(d)})"
    return "case " + " ".join(f"when {x} = {least} then {i}" for i, x in enumerate(d)) + " end"


@query("j4_nearest_centroid", f"with {MULTI} select y, x, ({_nearest_sql()})::int as label from m")
def _(spark, d):
    return yx(fx.scene_multi(spark, d), label=nearest(["red", "nir", "green"], CENTRES))


@query("a1_scene_summary", f"with {MULTI} select min(v) as min, max(v) as max, round(avg(v), 6) as mean from ml")
def _(spark, d):
    return op.summary(fx.scene_long(spark, d)).withColumn("mean", r6("mean"))


@query("a2_band_stats", f"with {MULTI} select band, count(*) as n, min(v) as min, max(v) as max, round(avg(v), 6) as mean, round(stddev_pop(v), 6) as std, round(quantile_cont(v, 0.02), 6) as p2, round(quantile_cont(v, 0.98), 6) as p98 from ml group by band")
def _(spark, d):
    got = op.band_stats(fx.scene_long(spark, d))
    return got.select("band", "n", "min", "max", *[r6(c).alias(c) for c in ("mean", "std", "p2", "p98")])


@query("a3_histogram100", sql.gray("s as (select min(v)::double as lo, max(v)::double as hi from g)", "c as (select least(floor((v - lo) * 100.0::double / (hi - lo)), 99)::int as bin, count(*) as n from g, s group by 1)", select="select t.bin::int as bin, coalesce(n, 0) as n from range(100) t(bin) left join c on c.bin = t.bin"))
def _(spark, d):
    return op.histogram(fx.scene_gray(spark, d)).select("bin", "n")


@query("a4_histogram256", sql.gray(select="select t.v::int as v, coalesce(n, 0) as n from range(256) t(v) left join (select v, count(*) as n from g group by v) c on c.v = t.v"))
def _(spark, d):
    return op.counts256(fx.scene_gray(spark, d)).select("v", "n")


@query("a5_cumulative", sql.gray(OTSU, select="select v::int as v, n0::bigint as n0, s0::bigint as s0 from r"))
def _(spark, d):
    return stats.running(op.counts256(fx.scene_gray(spark, d))).select("v", "n0", "s0")


@query("a6_otsu", sql.gray(OTSU, select="select t from ot"))
def _(spark, d):
    return op.otsu(fx.scene_gray(spark, d)).select("t")


@query("a6_otsu_of_chips", f"with {CHIPS}, h as (select image_id, t.v, (select count(*) from c where c.image_id = i.image_id and c.v = t.v) as n from (select distinct image_id from c) i, range(256) t(v)), r as (select image_id, v, sum(n) over w as n0, sum(n * v) over w as s0, sum(n) over (partition by image_id) as na, sum(n * v) over (partition by image_id) as sa from h window w as (partition by image_id order by v)), sc as (select image_id, v, case when n0 * (na - n0) > 0 then pow(sa::double * n0 - s0::double * na, 2) / (n0 * (na - n0)) else 0 end as s from r) select image_id, (list(v order by s desc, v))[1]::int as t from sc group by image_id")
def _(spark, d):
    return op.otsu(fx.chips(spark, d)).select("image_id", "t")


@query("a7_equalise", sql.gray(
    "s as (select min(v)::double as lo, max(v)::double as hi from g)",
    "c as (select least(floor((v - lo) * 256.0::double / (hi - lo)), 255)::int as bin, count(*) as n from g, s group by 1)",
    "f as (select t.bin::int as bin, sum(coalesce(n, 0)) over (order by t.bin) / sum(coalesce(n, 0)) over ()::double as c from range(256) t(bin) left join c on c.bin = t.bin)",
    "p as (select y, x, (v - lo) / ((hi - lo) / 256) - 0.5 as pos from g, s)", "q as (select y, x, pos, greatest(0, least(254, floor(pos)))::int as k from p)",
    select="select y, x, round(a.c + (b.c - a.c) * greatest(0, least(1, pos - k)), 6) as v from q join f a on a.bin = k join f b on b.bin = k + 1"))
def _(spark, d):
    return yx(op.equalised(fx.scene_gray(spark, d)), v=r6("v"))


def _clahe_sql() -> str:
    """Shares of each tile and bin, and of each pixel's four nearest tiles by a join on tile and bin."""
    corners = ", ".join(f"({dy}, {dx})" for dy in (0, 1) for dx in (0, 1))
    return sql.gray(
        "s as (select quantile_cont(v, 0.02) as lo, quantile_cont(v, 0.98) as hi from g)", "dm as (select ceil((max(y) + 1) / 8.0::double)::int as th, max(y) as my from g)",
        "u as (select y, x, least(1, greatest(0, (v - lo) / (hi - lo + 1e-9))) as v from g, s)",
        "b as materialized (select y, x, least(255, floor(v * 256))::int as bin, y // th as ty, x // 8 as tx, (y + 0.5::double) / th - 0.5::double as fy, (x + 0.5::double) / 8 - 0.5::double as fx from u, dm)",
        "h as (select t.ty, t.tx, i.bin::int as bin, coalesce(n, 0) as n from (select distinct ty, tx from b) t cross join range(256) i(bin) left join (select ty, tx, bin, count(*) as n from b group by all) c on c.ty = t.ty and c.tx = t.tx and c.bin = i.bin)",
        "a as (select *, sum(n) over w as total, least(n::double, greatest(1.0::double, 0.03::double * sum(n) over w)) as kept from h window w as (partition by ty, tx))",
        "l as materialized (select ty, tx, bin, (sum(kept) over (partition by ty, tx order by bin) + sum(n - kept) over (partition by ty, tx) / 256 * (bin + 1)) / total as share from a)",
        f"k as (select y, x, bin, greatest(0, least(my // th, floor(fy)::int + dy)) as ty, greatest(0, least(7, floor(fx)::int + dx)) as tx, case when dy = 1 then fy - floor(fy) else 1 - (fy - floor(fy)) end * case when dx = 1 then fx - floor(fx) else 1 - (fx - floor(fx)) end as w from b cross join dm cross join (values {corners}) o(dy, dx))",
        select="select y, x, round(least(1, sum(w * share)) + 1e-9::double, 6) as v from k join l using (ty, tx, bin) group by y, x",
    )


@query("a8_clahe", _clahe_sql())
def _(spark, d):
    return yx(op.clahe(op.percentile_stretch(fx.scene_gray(spark, d))), v=r6(F.col("v") + 1e-9))  # shares of a power of two lie between two roundings


@query("a9_peak", f"with {CHIPS} select image_id, max(v) as peak from c group by image_id")
def _(spark, d):
    return stats.peak(fx.chips(spark, d)).select("image_id", "peak")


def _pairs(angle: int) -> str:
    dy, dx = ANGLES[angle]
    return f"""q as (select y, x, greatest(0, least(7, v * 8 // 256))::int as l from g), pr as (select a.l as i, b.l as j from q a join q b on b.y = a.y + ({dy}) and b.x = a.x + ({dx})),
sy as (select i, j from pr union all select j, i from pr), p as (select i, j, count(*) / (sum(count(*)) over ())::double as p from sy group by i, j)"""


@query("a12_glcm", sql.gray(_pairs(45), select="select i, j, round(p, 9) as p from p"))
def _(spark, d):
    return op.glcm(fx.scene_gray(spark, d), angle=45).select("i", "j", F.round("p", 9).alias("p"))


@query("a19_glcm_features", sql.gray(_pairs(0), "mo as (select sum(p * i) as mi, sum(p * j) as mj from p)", select="select round(sum(p * (i - j) * (i - j)), 6) as contrast, round(sum(p * abs(i - j)), 6) as dissimilarity, round(sum(p / (1 + (i - j) * (i - j))), 6) as homogeneity, round(sqrt(sum(p * p)), 6) as energy, round(-sum(p * log2(p)), 6) as entropy, round(sum(p * (i - mi) * (j - mj)) / sqrt(sum(p * pow(i - mi, 2)) * sum(p * pow(j - mj, 2))), 6) as correlation from p, mo"))
def _(spark, d):
    return op.glcm_features(fx.scene_gray(spark, d)).select(*[r6(n).alias(n) for n in op.FEATURES])


@query("a20_index_summary", f"with {MULTI}, n as (select (nir - red) / nullif(nir + red, 0)::double as v from m) select round(min(v), 6) as min, round(max(v), 6) as max, round(avg(v), 6) as mean from n")
def _(spark, d):
    got = stats.masked_summary(pt.ndvi("nir", "red", zero="null"), fx.scene_multi(spark, d))
    return got.select(*[r6(c).alias(c) for c in got.columns])


# Neighbourhoods --------------------------------------------------------------------------------------------------

BOX3 = [[1.0] * 3] * 3


@query("n4_mean_blur", sql.gray(sql.correlated("o", "g", BOX3), select="select y, x, round(v / 9.0::double, 6) as v, (v::bigint // 9)::int as byte from o"))
def _(spark, d):
    got = op.mean_blur(fx.scene_gray(spark, d), 3)
    return yx(got, v=r6("v"), byte=F.expr("cast(round(v * 9) as bigint) div 9").cast("int"))


@query("n5_gaussian_blur", sql.gray(sql.correlated("o", "g", gaussian_kernel(5, 1.0)), select="select y, x, round(v, 6) as v from o"))
def _(spark, d):
    return yx(op.gaussian_blur(fx.scene_gray(spark, d)), v=r6("v"))


@query("n6_median", sql.gray(sql.around("o", "g", sql.kernel(BOX3)), select="select y, x, (list_sort(list(v)))[5]::int as v from o group by y, x"))
def _(spark, d):
    return op.apply_filter(fx.scene_gray(spark, d), " Median ").select("y", "x", "v")


def _edge_sql(k, t: float) -> str:
    return sql.gray(sql.gradients(*k), "pk as (select max(m) as p from gr)", select=f"select y, x, round(m / p * 255, 6) as v, trunc(round(m / p * 255, 6))::int as byte, case when round(m / p * 255, 6) >= {t} then 255 else 0 end as edge, round(degrees(atan2(gy, gx)), 6) + 0.0 as direction from gr, pk")


def _edge(df: DataFrame, t: float) -> DataFrame:
    return yx(df, v=r6("v"), byte=F.round("v", 6).cast("int"), edge=F.when(F.round("v", 6) >= t, 255).otherwise(0), direction=r6("direction"))


@query("n7_sobel", _edge_sql(edges.SOBEL, 100.5))
def _(spark, d):
    return _edge(op.sobel(fx.scene_gray(spark, d)), 100.5)


@query("n8_prewitt", _edge_sql(edges.PREWITT, 90.5))
def _(spark, d):
    return _edge(op.prewitt(fx.scene_gray(spark, d)), 90.5)


def _laplace_sql(c: int) -> str:
    return sql.gray(sql.correlated("o", "g", edges.LAPLACE[c]), "pk as (select max(abs(v)) as p from o)", select="select y, x, round(abs(v) / p * 255, 6) as v from o, pk")


@query("n9_laplacian8", _laplace_sql(8))
def _(spark, d):
    return yx(op.laplacian(fx.scene_gray(spark, d)), v=r6("v"))


@query("n9_laplacian4", _laplace_sql(4))
def _(spark, d):
    return yx(op.laplacian(fx.scene_gray(spark, d), 4), v=r6("v"))


@query("n10_laplacian_of_gaussian", sql.gray(sql.correlated("b", "g", gaussian_kernel(5, 1.0)), sql.correlated("o", "b", edges.LAPLACE[8]), "pk as (select max(abs(v)) as p from o)", select="select y, x, round(abs(v) / p * 255, 6) as v from o, pk"))
def _(spark, d):
    return yx(op.laplacian_of_gaussian(fx.scene_gray(spark, d)), v=r6("v"))


@query("n11_zero_crossings", sql.gray(sql.correlated("b", "g", gaussian_kernel(5, 1.0)), sql.correlated("o", "b", edges.LAPLACE[8]), sql.around("z", "o", [(0, -1), (0, 1), (-1, 0), (1, 0), (-1, -1), (1, 1), (-1, 1), (1, -1)]), "w as (select y, x, " + ", ".join(f"max(case when k = {i} then v end) as z{i}" for i in range(8)) + " from z group by y, x)", select="select y, x, case when z0 * z1 < 0 or z2 * z3 < 0 or z4 * z5 < 0 or z6 * z7 < 0 then 255 else 0 end as v from w"))
def _(spark, d):
    return yx(op.laplacian_of_gaussian(fx.scene_gray(spark, d), zero_crossing=True), v=F.col("byte"))


@query("n13_gradient_magnitude", sql.gray(sql.gradients(*edges.SOBEL), select="select y, x, round(m, 6) as v from gr"))
def _(spark, d):
    return yx(op.sobel_magnitude(fx.scene_gray(spark, d)), v=r6("v"))


def _canny_sql(low: float, high: float) -> str:
    nb = sql.around("z", "gr", [(0, 1), (0, -1), (-1, 1), (1, -1), (-1, 0), (1, 0), (-1, -1), (1, 1)], "m", sql.OUTSIDE, "0")
    cols = ", ".join(f"max(case when k = {i} then v end) as z{i}" for i in range(8))
    return f"""{sql.correlated('b', 'g', gaussian_kernel(5, 1.0))},
{sql.gradients(*edges.SOBEL, source='b')},
{nb}, w as (select y, x, {cols} from z group by y, x),
an as (select y, x, m, ((degrees(atan2(gy, gx)) % 180) + 180) % 180 as a from gr),
th as (select y, x, case when m >= case when a < 22.5 or a >= 157.5 then greatest(z0, z1) when a < 67.5 then greatest(z2, z3) when a < 112.5 then greatest(z4, z5) else greatest(z6, z7) end then m else 0 end as m from an join w using (y, x)),
ts as (select y, x, th.m / p * 255 as t from th, (select max(m) as p from gr) pk),
st as (select y, x, t, t >= {high} as strong, t >= {low} and t < {high} as weak from ts)"""


@query("f5_double_threshold", sql.gray(_canny_sql(60.25, 120.25), select="select y, x, round(t, 5) as t, strong, weak from st"))
def _(spark, d):
    got = edges.canny_stages(fx.scene_gray(spark, d), 60.25, 120.25)
    return yx(got, t=F.round("thin", 5), strong=F.col("strong"), weak=F.col("weak"))


@query("i2_canny", sql.gray(_canny_sql(60.25, 120.25), "rc as (select y, x from st where strong union select s.y, s.x from rc join st s on s.weak and s.y between rc.y - 1 and rc.y + 1 and s.x between rc.x - 1 and rc.x + 1)", select="select st.y, st.x, rc.y is not null as edge from st left join rc on rc.y = st.y and rc.x = st.x", recursive=True))
def _(spark, d):
    return op.canny(fx.scene_gray(spark, d), 60.25, 120.25).select("y", "x", "edge")


def _morph(name: str, plan: list[tuple[str, list]], run: Callable[[DataFrame], DataFrame]) -> None:
    tables, last = [MASK], "fg"
    for i, (kind, element) in enumerate(plan):
        tables.append(sql.morph(f"s{i}", last, offsets(element), kind))
        last = f"s{i}"

    @query(name, sql.gray(*tables, select=f"select y, x, fg from {last}"))
    def _(spark, d):
        return run(mask(spark, d)).select("y", "x", "fg")


SQ, DISK, CROSS = op.square(3), op.disk(2), op.cross(3)
_morph("n15_erode", [("erode", CROSS)], lambda m: op.erode(m, CROSS))
_morph("n16_dilate", [("dilate", DISK)], lambda m: op.dilate(m, DISK))
_morph("n16_dilate_twice", [("dilate", SQ)] * 2, lambda m: op.dilate(m, iterations=2))
_morph("n17_opening", [("erode", CROSS), ("dilate", CROSS)], lambda m: op.opening(m, CROSS))
_morph("n18_closing", [("dilate", SQ), ("erode", SQ)], lambda m: op.closing(m))


@query("n22_texture_map", sql.gray(
    "q as (select y, x, greatest(0, least(7, v * 8 // 256))::int as l from g)", "dm as (select max(y) as my, max(x) as mx from q)",
    f"pd as (select py::int as y, px::int as x, l from (select unnest(range(-2, my + 3)) as py, my, mx from dm) a cross join (select unnest(range(-2, 66)) as px) b join q on q.y = ({sql.mirror('py', 'my')}) and q.x = ({sql.mirror('px', 'mx')}))",
    "pr as (select a.y, a.x, pow(a.l - b.l, 2) as s from pd a join pd b on b.y = a.y and b.x = a.x + 1)",
    select="select q.y, q.x, round(sum(s) / 20.0::double, 6) as v from q join pr on pr.y between q.y - 2 and q.y + 2 and pr.x between q.x - 2 and q.x + 1 group by q.y, q.x"))
def _(spark, d):
    return yx(op.texture_map(fx.scene_gray(spark, d), window=5), v=r6("v"))


@query("n22_texture_entropy", sql.gray(
    "q as (select y, x, greatest(0, least(7, v * 8 // 256))::int as l from g)", "dm as (select max(y) as my, max(x) as mx from q)",
    f"pd as (select py::int as y, px::int as x, l from (select unnest(range(-2, my + 3)) as py, my, mx from dm) a cross join (select unnest(range(-2, 66)) as px) b join q on q.y = ({sql.mirror('py', 'my')}) and q.x = ({sql.mirror('px', 'mx')}))",
    "pr as (select a.y, a.x, a.l as i, b.l as j from pd a join pd b on b.y = a.y - 1 and b.x = a.x)",
    "wn as (select q.y, q.x, i, j from q join pr on pr.y between q.y - 1 and q.y + 2 and pr.x between q.x - 2 and q.x + 2)",
    "ct as (select y, x, i, j, count(*) / 40.0::double as p from (select y, x, i, j from wn union all select y, x, j, i from wn) group by y, x, i, j)",
    select="select y, x, round(-sum(p * log2(p)), 6) + 0.0::double as v from ct group by y, x"))
def _(spark, d):
    return yx(op.texture_map(fx.scene_gray(spark, d), "entropy", window=5, angle=90), v=r6("v"))


# Sets of pixels --------------------------------------------------------------------------------------------------

_SETS = {"intersection": "a and b", "union": "a or b", "difference": "a and not b", "complement": "not a"}


@query("set_operations", sql.gray(select="select kind, count(*) filter (fg) as n from (" + " union all ".join(f"select '{k}' as kind, {e} as fg from (select v >= 150 as a, v % 2 = 0 as b from g)" for k, e in _SETS.items()) + ") group by kind"))
def _(spark, d):
    g = fx.scene_gray(spark, d)
    a, b = op.binary(g, 150), g.withColumn("fg", F.col("v") % 2 == 0)
    parts = [op.combined(a, b, k).groupBy(F.lit(k).alias("kind")).agg(F.count_if("fg").alias("n")) for k in _SETS]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


# Components, clean-up, segmentation ------------------------------------------------------------------------------


@query("i3_label", sql.gray(MASK, sql.COMPONENTS, select="select fg.y, fg.x, coalesce(label, 0)::int as label from fg left join lab using (y, x)", recursive=True))
def _(spark, d):
    return op.labelled(mask(spark, d)).select("y", "x", F.col("label").cast("int").alias("label"))


@query("a10_component_sizes", sql.gray(MASK, sql.COMPONENTS, select="select size, count(distinct label) as n from lab group by size", recursive=True))
def _(spark, d):
    got = op.labelled(mask(spark, d)).where("label > 0").select("label", "size").distinct()
    return got.groupBy("size").agg(F.count(F.lit(1)).alias("n"))


@query("i4_remove_small", sql.gray(MASK, sql.COMPONENTS, select="select fg.y, fg.x, coalesce(size >= 8, false) as fg from fg left join lab using (y, x)", recursive=True))
def _(spark, d):
    return op.remove_small(mask(spark, d), 8).select("y", "x", "fg")


@query("i5_clean_mask", sql.gray("f0 as (select y, x, v >= 130 as fg from g)", sql.morph("s0", "f0", offsets(CROSS), "erode"), sql.morph("s1", "s0", offsets(CROSS), "dilate"), sql.morph("s2", "s1", offsets(CROSS), "dilate"), sql.morph("s3", "s2", offsets(CROSS), "erode"), "fg as (select * from s3)", sql.COMPONENTS, select="select fg.y, fg.x, coalesce(size >= 20, false) as fg from fg left join lab using (y, x)", recursive=True))
def _(spark, d):
    return op.clean_mask(op.binary(fx.scene_gray(spark, d), 130), CROSS, min_size=20).select("y", "x", "fg")


@query("i6_distance", sql.gray(MASK, select="select a.y, a.x, round(min(greatest(abs(a.y - b.y), abs(a.x - b.x)) + (sqrt(2::double) - 1) * least(abs(a.y - b.y), abs(a.x - b.x))), 6) as distance from fg a join fg b on not b.fg and b.y between a.y - 12 and a.y + 12 where a.fg group by a.y, a.x"))
def _(spark, d):
    return yx(op.distance_transform(mask(spark, d)).where("fg"), distance=r6("distance"))


@query("i7_markers", sql.gray(
    OTSU, "f0 as materialized (select y, x, v > t as fg from g, ot)", *[sql.morph(f"s{i}", f"s{i - 1}" if i else "f0", offsets(SQ), "dilate") for i in range(3)],
    "ds as materialized (select a.y, a.x, min(greatest(abs(a.y - b.y), abs(a.x - b.x)) + (sqrt(2::double) - 1) * least(abs(a.y - b.y), abs(a.x - b.x))) as d from f0 a join f0 b on not b.fg and b.y between a.y - 12 and a.y + 12 group by a.y, a.x)",
    "fg as materialized (select y, x, round(d, 9) >= round(p * 0.5::double, 9) and p > 0 as fg from ds, (select max(d) as p from ds))", sql.COMPONENTS,
    select="select s2.y, s2.x, case when s2.fg and not fg.fg then 0 else coalesce(label, 0) + 1 end::int as marker from s2 join fg using (y, x) left join lab using (y, x)", recursive=True))
def _(spark, d):
    return op.generate_markers(fx.scene_gray(spark, d)).select("y", "x", "marker")


@query("i9_watershed")
def _(spark, d):
    return op.watershed(fx.scene_gray(spark, d)).select("y", "x", "label")


def _palette_sql(n: int = 10_000) -> str:
    colours = segmentation.palette(range(1, n + 1))
    return "pal as (select * from (values " + ", ".join(f"({k}, {r}, {g}, {b})" for k, (r, g, b) in sorted(colours.items()) if k > 0) + ") t(label, r, g, b))"


@query("p15_colourised", sql.gray(MASK, sql.COMPONENTS, _palette_sql(), select="select g.y, g.x, " + ", ".join(f"coalesce({c}, 0)::int as {c}" for c in "rgb") + " from g left join lab using (y, x) left join pal using (label)", recursive=True))
def _(spark, d):
    small = fx.scene_gray(spark, d)
    return op.colourised(op.labelled(op.binary(small, 150))).select("y", "x", "r", "g", "b")


def _lloyd_sql(rounds: int) -> str:
    tables = ["c0 as (select * from (values " + ", ".join(f"({i}, {a}::double, {b}::double, {c}::double)" for i, (a, b, c) in enumerate(CENTRES)) + ") t(i, a, b, c))"]
    for r in range(1, rounds + 1):
        tables.append(f"l{r} as (select y, x, red, nir, green, (list(i order by pow(red - a, 2) + pow(nir - b, 2) + pow(green - c, 2), i))[1] as i from m, c{r - 1} group by y, x, red, nir, green)")
        tables.append(f"c{r} as (select o.i, coalesce(avg(red), any_value(o.a)) as a, coalesce(avg(nir), any_value(o.b)) as b, coalesce(avg(green), any_value(o.c)) as c from c{r - 1} o left join l{r} on l{r}.i = o.i group by o.i)")
    return f"with {MULTI}, {', '.join(tables)} select y, x, l{rounds}.i::int as label, trunc(a)::int as m0, trunc(b)::int as m1, trunc(c)::int as m2 from l{rounds} join c{rounds} on c{rounds}.i = l{rounds}.i"


@query("i11_kmeans", _lloyd_sql(3))
def _(spark, d):
    got, _ = op.kmeans(fx.scene_multi(spark, d), ["red", "nir", "green"], 4, max_iter=3, tol=0.0, centroids=CENTRES)
    return got.select("y", "x", "label", "m0", "m1", "m2")


# Keypoints -------------------------------------------------------------------------------------------------------

_HARRIS = ",\n".join([
    sql.gradients(*edges.SOBEL), "tn as (select y, x, gx * gx as xx, gy * gy as yy, gx * gy as xy from gr)",
    *[sql.correlated(f"t{c}", "tn", gaussian_kernel(3, 1.0), c) for c in ("xx", "yy", "xy")],
    "hr as (select y, x, a.v * b.v - c.v * c.v - 0.04::double * (a.v + b.v) * (a.v + b.v) as r from txx a join tyy b using (y, x) join txy c using (y, x))",
    sql.around("hn", "hr", [(dy, dx) for dy in range(-2, 3) for dx in range(-2, 3)], "r", sql.OUTSIDE),
    "hm as (select y, x, max(v) as top from hn group by y, x)",
])


@query("d1_harris", sql.gray(_HARRIS, select="select y, x from hr join hm using (y, x) where r >= top - abs(top) * 1e-9 and r > 0.01::double * (select max(r) from hr)"))
def _(spark, d):
    return op.harris_corners(fx.scene_gray(spark, d)).select("y", "x")


_FAST = ",\n".join([
    sql.around("fc", "g", [tuple(o) for o in keypoints.CIRCLE], "v", sql.OUTSIDE),
    "fb as (select fc.y, fc.x, sum(case when fc.v >= g.v + 20 then (1 << k) else 0 end)::bigint as b, sum(case when fc.v <= g.v - 20 then (1 << k) else 0 end)::bigint as d, sum(abs(fc.v - g.v)) as s, count(fc.v) as n from fc join g using (y, x) group by fc.y, fc.x)",
    "fd as (select y, x, s, n, b | (b << 16) as b, d | (d << 16) as d from fb)",
    "fs as (select y, x, case when n = 16 and (" + " or ".join(f"(({c} >> {i}) & 511) = 511" for c in "bd" for i in range(16)) + ") then s else 0 end as s from fd)",
    sql.around("fn", "fs", [(dy, dx) for dy in range(-2, 3) for dx in range(-2, 3)], "s", sql.OUTSIDE),
    "fm as (select y, x, max(v) as top from fn group by y, x)",
    "fk as (select y, x, s from fs join fm using (y, x) where s = top and s > 0)",
])


@query("d2_fast", sql.gray(_FAST, select="select y, x, s::double as score from fk"))
def _(spark, d):
    return op.fast_corners(fx.scene_gray(spark, d)).select("y", "x", "score")


@query("t3_first_keypoints", sql.gray(_FAST, select="select y, x, row_number() over (order by y, x)::int as number from fk qualify row_number() over (order by y, x) <= 10"))
def _(spark, d):
    return op.in_raster_order(op.fast_corners(fx.scene_gray(spark, d)), 10).select("y", "x", "number")


@query("d3_orientation", sql.gray(_FAST, select="select fk.y, fk.x, round(atan2(sum((g.y - fk.y) * g.v)::double, sum((g.x - fk.x) * g.v)::double), 6) as theta from fk join g on g.y between fk.y - 3 and fk.y + 3 and g.x between fk.x - 3 and fk.x + 3 where fk.x between 7 and 56 and fk.y between 7 and (select max(y) - 7 from g) group by fk.y, fk.x"))
def _(spark, d):
    return yx(op.orb_keypoints(fx.scene_gray(spark, d), n_bits=8), theta=r6("theta"))


_PATTERN = ", ".join(f"({i}, {side}, {p[2 * side]!r}::double, {p[2 * side + 1]!r}::double)" for i, p in enumerate(keypoints.brief_pattern()) for side in (0, 1))
_ORB = ",\n".join([
    _FAST, "dm as (select max(y) as my, max(x) as mx from g)",
    "th as (select fk.y, fk.x, atan2(sum((g.y - fk.y) * g.v)::double, sum((g.x - fk.x) * g.v)::double) as t from fk join g on g.y between fk.y - 3 and fk.y + 3 and g.x between fk.x - 3 and fk.x + 3 where fk.x between 7 and 56 and fk.y between 7 and (select my - 7 from dm) group by fk.y, fk.x)",
    f"pt as (select * from (values {_PATTERN}) t(bit, side, py, px))",
    "ak as (select y as ky, x as kx, bit, side, greatest(0, least(my, round_even(y + (py * cos(t) - px * sin(t)), 0)::int)) as y, greatest(0, least(mx, round_even(x + (py * sin(t) + px * cos(t)), 0)::int)) as x from th cross join pt cross join dm)",
    "pq as (select ky, kx, bit, max(v) filter (side = 0) as p, max(v) filter (side = 1) as q from ak join g using (y, x) group by ky, kx, bit)",
])


@query("d5_orb", sql.gray(_ORB, select="select ky as y, kx as x, string_agg(case when p < q then '1' else '0' end, '' order by bit) as bits from pq group by ky, kx"))
def _(spark, d):
    return yx(op.orb_keypoints(fx.scene_gray(spark, d)), bits=F.array_join("bits", ""))


_RING = sorted({(round(3 * math.sin(a)), round(3 * math.cos(a))) for a in np.linspace(0, 2 * np.pi, 25).tolist()})


@query("d6_drawn", sql.gray(_FAST, f"mk as (select distinct fk.y + dy as y, fk.x + dx as x from fk cross join (values {', '.join(map(str, _RING))}) t(dy, dx))", select="select g.y, g.x, " + ", ".join(f"case when mk.y is null then g.v else {c} end::int as {n}" for n, c in (("r", 255), ("g", 0), ("b", 0))) + " from g left join mk on mk.y = g.y and mk.x = g.x"))
def _(spark, d):
    g = fx.scene_gray(spark, d)
    return op.drawn(g, op.fast_corners(g)).select("y", "x", "r", "g", "b")


@query("d6_rays", sql.gray(
    _ORB.split("pt as (")[0].rstrip(",\n "), "tp as (select y, x, trunc(6 * cos(t))::int as dx, trunc(6 * sin(t))::int as dy from th)",
    "ry as (select y + floor(dy * i / greatest(1, abs(dy), abs(dx))::double + 0.5)::int as y, x + floor(dx * i / greatest(1, abs(dy), abs(dx))::double + 0.5)::int as x from tp cross join range(7) r(i) where i <= greatest(abs(dy), abs(dx)))",
    f"mk as (select th.y + dy as y, th.x + dx as x from th cross join (values {', '.join(map(str, _RING))}) t(dy, dx) union select y, x from ry)",
    select="select g.y, g.x, " + ", ".join(f"case when mk.y is null then g.v else {c} end::int as {n}" for n, c in (("r", 255), ("g", 0), ("b", 0))) + " from g left join mk on mk.y = g.y and mk.x = g.x"))
def _(spark, d):
    g = fx.scene_gray(spark, d)
    return op.drawn(g, op.orb_keypoints(g, n_bits=8)).select("y", "x", "r", "g", "b")


# Single steps of the operators above -------------------------------------------------------------------------------


@query("k3_to_byte", sql.gray(select="select y, x, trunc(least(255.0::double, greatest(0.0::double, v * 1.5::double - 60.25::double)))::int as v from g"))
def _(spark, d):
    return yx(fx.scene_gray(spark, d), v=pt.to_byte(F.col("v") * 1.5 - 60.25))


@query("f7_valid_pixels", f"with {MULTI} select count(*) as n, count(case when nir + red <> 0 then 1 end) as n_valid from m")
def _(spark, d):
    got = fx.scene_multi(spark, d).select(pt.ndvi("nir", "red", zero="null").alias("v"))
    return got.agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("n_valid"))


@query("p13_normalise", sql.gray(select="select y, x, round(v / (select max(v) from g)::double * 255, 6) as v from g"))
def _(spark, d):
    return yx(edges.normalised(fx.scene_gray(spark, d), "v"), v=r6("v"))


@query("p16_repaint", f"with {MULTI}, l as (select y, x, red, ({_nearest_sql()})::int as i from m), c as (select i, trunc(avg(red))::int as red from l group by i) select y, x, c.red as v from l join c on c.i = l.i")
def _(spark, d):
    m = fx.scene_multi(spark, d).withColumn("label", nearest(["red", "nir", "green"], CENTRES))
    return segmentation.repainted(m, ["red"]).select("y", "x", F.col("red").alias("v"))


@query("a11_cluster_means", f"with {MULTI} select ({_nearest_sql()})::int as label, count(*) as n, round(avg(red), 6) as red, round(avg(nir), 6) as nir, round(avg(green), 6) as green from m group by 1")
def _(spark, d):
    m = fx.scene_multi(spark, d).withColumn("label", nearest(["red", "nir", "green"], CENTRES))
    means = segmentation.cluster_means(m, ["red", "nir", "green"])
    return means.select("label", "n", *[r6(c).alias(c) for c in ("red", "nir", "green")])


@query("a21_distinct_labels", sql.gray(MASK, sql.COMPONENTS, select="select distinct label::int as label from lab", recursive=True))
def _(spark, d):
    return op.labelled(mask(spark, d)).where("label > 0").select(F.col("label").cast("int").alias("label")).distinct()


@query("n21_local_maxima", sql.gray(sql.around("n", "g", [(dy, dx) for dy in range(-2, 3) for dx in range(-2, 3)], "v", sql.OUTSIDE), select="select g.y, g.x from g join n using (y, x) group by g.y, g.x, g.v having g.v = max(n.v) and g.v > 200"))
def _(spark, d):
    got = keypoints.local_maxima(in_strips(fx.scene_gray(spark, d), 2), "v", 5)
    return own_rows(got).where("top and v > 200").select("y", "x")


@query("i1_hysteresis", sql.gray("st as (select y, x, v >= 190 as strong, v >= 150 and v < 190 as weak from g)", "rc as (select y, x from st where strong union select s.y, s.x from rc join st s on s.weak and s.y between rc.y - 1 and rc.y + 1 and s.x between rc.x - 1 and rc.x + 1)", select="select st.y, st.x, rc.y is not null as edge from st left join rc on rc.y = st.y and rc.x = st.x", recursive=True))
def _(spark, d):
    g = fx.scene_gray(spark, d).withColumns({"strong": F.col("v") >= 190, "weak": (F.col("v") >= 150) & (F.col("v") < 190)})
    return edges.hysteresis(g).select("y", "x", "edge")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary of the three indices over the multi-band scene."""
    m = fx.scene_multi(spark, sf_dir)
    long = m.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), e.alias("v")) for n, e in (("ndvi", pt.ndvi("nir", "red")), ("ndwi", pt.ndwi("green", "nir")), ("ndbi", pt.ndbi("swir", "nir")))])).alias("i")).select("i.*")
    got = long.groupBy("name").agg(F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"))
    return got.select("name", *[r6(c).alias(c) for c in ("min", "max", "mean")])


QUERIES["flagship_indices"] = flagship
ORACLES["flagship_indices"] = f"with {MULTI}, i as (" + " union all ".join(f"select '{n}' as name, case when {a} + {b} = 0 then 0 else ({a} - {b}) / ({a} + {b})::double end as v from m" for n, a, b in (("ndvi", "nir", "red"), ("ndwi", "green", "nir"), ("ndbi", "swir", "nir"))) + ") select name, round(min(v), 6) as min, round(max(v), 6) as max, round(avg(v), 6) as mean from i group by name"

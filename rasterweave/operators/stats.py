"""Aggregates, histograms, stretches, equalisation and thresholds.

Statistics of an image are one row, or 256, from a pre-aggregated group; they are joined back by the image's keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.point import clip
from .neighborhood import KEYS


def summary(df: DataFrame, keys: Sequence[str] = (), column: str = "v") -> DataFrame:
    """min, max and mean of the pixels that are there."""
    return df.groupBy(*keys).agg(F.min(column).alias("min"), F.max(column).alias("max"), F.avg(column).alias("mean"))


def peak(df: DataFrame, keys: Sequence[str] = KEYS, column: str = "v", out: str = "peak") -> DataFrame:
    """The greatest value of each image."""
    return df.groupBy(*keys).agg(F.max(column).alias(out))


def band_stats(df: DataFrame, keys: Sequence[str] = ("image_id", "band"), column: str = "v") -> DataFrame:
    """n, min, max, mean, population std, and exact linearly interpolated p2 and p98 of each band."""
    p = F.percentile(column, F.array(F.lit(0.02), F.lit(0.98)))
    got = df.groupBy(*keys).agg(F.count(column).alias("n"), F.min(column).alias("min"), F.max(column).alias("max"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"), p.alias("p"))
    return got.select(*keys, "n", "min", "max", "mean", "std", F.col("p")[0].alias("p2"), F.col("p")[1].alias("p98"))


def percentile_stretch(df: DataFrame, low: float = 2, high: float = 98, keys: Sequence[str] = KEYS, column: str = "v", out: str = "v") -> DataFrame:
    """df with out = clip((v - p_low) / (p_high - p_low + 1e-9), 0, 1)."""
    p = F.percentile(column, F.array(F.lit(low / 100), F.lit(high / 100)))
    got = df.join(df.groupBy(*keys).agg(p.alias("__p")), list(keys))
    scaled = (F.col(column) - F.col("__p")[0]) / (F.col("__p")[1] - F.col("__p")[0] + F.lit(1e-9))
    return got.withColumn(out, clip(scaled, 0.0, 1.0)).drop("__p")


def linear_stretch(df: DataFrame, keys: Sequence[str] = KEYS, column: str = "v", out: str = "v") -> DataFrame:
    got = df.join(df.groupBy(*keys).agg(F.min(column).alias("__lo"), F.max(column).alias("__hi")), list(keys))
    return got.withColumn(out, clip((F.col(column) - F.col("__lo")) / (F.col("__hi") - F.col("__lo") + F.lit(1e-9)), 0.0, 1.0)).drop("__lo", "__hi")


def histogram(df: DataFrame, bins: int = 100, keys: Sequence[str] = KEYS, column: str = "v") -> DataFrame:
    """keys, bin (from 0), n: equal widths from the least to the greatest value, the last bin closed; empty bins are given."""
    ends = df.groupBy(*keys).agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    # A single value gets the width 1 around it, as histograms of constants do.
    lo, width = F.when(F.col("hi") > F.col("lo"), F.col("lo")).otherwise(F.col("lo") - 0.5), F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0)
    ends = ends.select(*keys, lo.alias("lo"), width.alias("width"))
    at = F.least(F.floor((F.col(column) - F.col("lo")) * F.lit(float(bins)) / F.col("width")), F.lit(bins - 1)).cast("int")
    n = df.where(F.col(column).isNotNull()).join(ends, list(keys)).groupBy(*keys, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = ends.where("lo is not null").select(*keys, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.join(n, [*keys, "bin"], "left").select(*keys, "bin", F.coalesce("n", F.lit(0)).alias("n"))


def counts256(df: DataFrame, keys: Sequence[str] = KEYS, column: str = "v") -> DataFrame:
    """keys, v (0..255), n of a byte image; absent values are given with 0."""
    n = df.groupBy(*keys, F.col(column).cast("int").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    every = n.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(255))).alias("v"))
    return every.join(n, [*keys, "v"], "left").select(*keys, "v", F.coalesce("n", F.lit(0)).alias("n"))


def running(h: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """A 256-row histogram with n0, s0 (running count and sum of values) and n_all, s_all."""
    w = Window.partitionBy(*keys)
    up = w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    return h.select("*", F.sum("n").over(up).alias("n0"), F.sum(F.col("n") * F.col("v")).over(up).alias("s0"), F.sum("n").over(w).alias("n_all"), F.sum(F.col("n") * F.col("v")).over(w).alias("s_all"))


def otsu(df: DataFrame, keys: Sequence[str] = KEYS, column: str = "v") -> DataFrame:
    """keys, t: the first threshold with the greatest variance between v <= t and v > t, compared in whole numbers
    up to one division; 0 for a constant image."""
    r = running(counts256(df, keys, column), keys)
    d = F.col("s_all").cast("double") * F.col("n0") - F.col("s0").cast("double") * F.col("n_all")
    below = F.col("n0") * (F.col("n_all") - F.col("n0"))
    score = F.when(below > 0, d * d / F.when(below > 0, below)).otherwise(0.0)
    return r.groupBy(*keys).agg(F.max_by("v", F.struct(score, -F.col("v"))).alias("t"))


def otsu_threshold(df: DataFrame, invert: bool = False, keys: Sequence[str] = KEYS) -> DataFrame:
    """df with fg: v > t (or its complement)."""
    got = df.join(otsu(df, keys), list(keys))
    m = F.col("v") > F.col("t")
    return got.withColumn("fg", ~m if invert else m).drop("t")


def equalised(df: DataFrame, bins: int = 256, keys: Sequence[str] = KEYS, column: str = "v", out: str = "v") -> DataFrame:
    """df with the cumulative share of the histogram, interpolated linearly between bin centres; a missing pixel stays so."""
    ends = df.groupBy(*keys).agg(F.min(column).cast("double").alias("__lo"), F.max(column).cast("double").alias("__hi"))
    h = histogram(df, bins, keys, column)
    w = Window.partitionBy(*keys)
    cdf = h.select(*keys, "bin", (F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(w)).alias("c"))
    cdf = cdf.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("bin", "c"))), lambda s: s["c"]).alias("__cdf"))
    got = df.join(ends, list(keys)).join(cdf, list(keys), "left")
    width = F.when(F.col("__hi") > F.col("__lo"), F.col("__hi") - F.col("__lo")).otherwise(1.0) / bins
    at = (F.col(column) - F.col("__lo")) / width - 0.5
    k = F.greatest(F.lit(0), F.least(F.lit(bins - 2), F.floor(at))).cast("int")
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), at - k))
    low, high = F.element_at("__cdf", k + 1), F.element_at("__cdf", k + 2)
    return got.withColumn(out, F.when(F.col(column).isNotNull(), low + (high - low) * part)).drop("__lo", "__hi", "__cdf")


def clahe(df: DataFrame, clip_limit: float = 0.03, bins: int = 256, tiles: int = 8, keys: Sequence[str] = KEYS, column: str = "v", out: str = "v") -> DataFrame:
    """Contrast-limited adaptive equalisation of values in 0..1 (Zuiderveld 1994).

    Each of tiles x tiles tiles has a histogram cut at max(1, clip_limit * pixels), the excess dealt evenly; a pixel
    blends the cumulative shares of the four nearest tile centres. Pixels between the same four centres are a cell; a
    table of a row a cell and bin holds the four shares, so a pixel meets it by one equi-join. A missing pixel stays so."""
    size = df.groupBy(*keys).agg((F.max("y") + 1).alias("__H"), (F.max("x") + 1).alias("__W"))
    size = size.withColumns({"__th": F.ceil(F.col("__H") / tiles), "__tw": F.ceil(F.col("__W") / tiles)})
    size = size.withColumns({"__ly": F.expr("(__H - 1) div __th"), "__lx": F.expr("(__W - 1) div __tw")}).drop("__H", "__W")
    fy, fx = (F.col("y") + 0.5) / F.col("__th") - 0.5, (F.col("x") + 0.5) / F.col("__tw") - 0.5
    got = df.join(size, list(keys)).withColumn("__bin", F.when(F.col(column).isNotNull(), F.least(F.lit(bins - 1), F.floor(F.col(column) * bins))).cast("int"))
    h = got.where("__bin is not null").groupBy(*keys, F.expr("y div __th").alias("__ty"), F.expr("x div __tw").alias("__tx"), "__bin").agg(F.count(F.lit(1)).alias("n"))
    tile = Window.partitionBy(*keys, "__ty", "__tx")
    every = h.select(*keys, "__ty", "__tx").distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("__bin"))
    h = every.join(h, [*keys, "__ty", "__tx", "__bin"], "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("all", F.sum("n").over(tile))
    kept = F.least(F.col("n").cast("double"), F.greatest(F.lit(1.0), F.lit(clip_limit) * F.col("all")))
    h = h.withColumn("kept", kept).withColumn("extra", F.sum(F.col("n") - F.col("kept")).over(tile) / bins)
    up = F.sum("kept").over(tile.orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0))
    shares = h.select(*keys, "__ty", "__tx", "__bin", ((up + F.col("extra") * (F.col("__bin") + 1)) / F.col("all")).alias("share"))
    span = lambda last: F.explode(F.sequence(F.lit(-1).cast("long"), F.col(last)))
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(i // 2).alias("dy"), F.lit(i % 2).alias("dx")) for i in range(4)]))
    cells = size.select(*keys, "__ly", "__lx", span("__ly").alias("__cy")).select("*", span("__lx").alias("__cx")).select("*", corner.alias("c"))
    inside = lambda c, last: F.greatest(F.lit(0), F.least(F.col(last), c))
    cells = cells.select(*keys, "__cy", "__cx", "c.i", inside(F.col("__cy") + F.col("c.dy"), "__ly").alias("__ty"), inside(F.col("__cx") + F.col("c.dx"), "__lx").alias("__tx"))
    four = cells.join(shares, [*keys, "__ty", "__tx"]).groupBy(*keys, "__cy", "__cx", "__bin").agg(*[F.coalesce(F.max(F.when(F.col("i") == i, F.col("share"))), F.lit(0.0)).alias(f"__s{i}") for i in range(4)])
    got = got.withColumns({"__cy": F.floor(fy), "__cx": F.floor(fx), "__wy": fy - F.floor(fy), "__wx": fx - F.floor(fx)}).join(four, [*keys, "__cy", "__cx", "__bin"], "left")
    wy, wx = F.col("__wy"), F.col("__wx")
    total = F.col("__s0") * (1 - wy) * (1 - wx) + F.col("__s1") * (1 - wy) * wx + F.col("__s2") * wy * (1 - wx) + F.col("__s3") * wy * wx
    return got.withColumn(out, F.when(F.col("__bin").isNotNull(), F.least(F.lit(1.0), total))).select(*[c for c in df.columns if c != out], out)


def masked_summary(index: Column, df: DataFrame) -> DataFrame:
    """min, max and mean of an index over the pixels where it is defined."""
    return summary(df.select(index.alias("v")).where("v is not null"))

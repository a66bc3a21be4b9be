"""Corners, orientations and binary descriptors."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import checkpointed
from .edges import gradients
from .filters import gaussian_weights
from .neighborhood import KEYS, box, image_size, in_strips, neighbours, own_rows, separable, windowed

#: The circle of radius 3 as (row, column) steps, clockwise from the top.
CIRCLE = [(-3, 0), (-3, 1), (-2, 2), (-1, 3), (0, 3), (1, 3), (2, 2), (3, 1), (3, 0), (3, -1), (2, -2), (1, -3), (0, -3), (-1, -3), (-2, -2), (-3, -1)]


def local_maxima(df: DataFrame, column: str, size: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """df (in strips) with `top`: the column equals the greatest value of the window around it."""
    got = windowed(df, F.max, size // 2, column, "__top", keys)
    return got.withColumn("top", F.col(column) == F.col("__top")).drop("__top")


def harris_response(df: DataFrame, k: float = 0.04, sigma: float = 1.0, nms_size: int = 5, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, y, x, response, top."""
    size = max(3, int(sigma * 3) | 1)
    w = gaussian_weights(size, sigma)
    got = in_strips(df.select(*keys, "y", "x", "v"), 1 + size // 2 + nms_size // 2, keys)
    got = gradients(got, keys=keys).withColumns({"xx": F.col("gx") * F.col("gx"), "yy": F.col("gy") * F.col("gy"), "xy": F.col("gx") * F.col("gy")})
    for c in ("xx", "yy", "xy"):
        got = separable(got, w, c, f"s{c}", keys)
    trace = F.col("sxx") + F.col("syy")
    got = got.withColumn("response", F.col("sxx") * F.col("syy") - F.col("sxy") * F.col("sxy") - F.lit(k) * trace * trace)
    return own_rows(local_maxima(got, "response", nms_size, keys)).select(*keys, "y", "x", "response", "top")


def harris_corners(df: DataFrame, k: float = 0.04, threshold_ratio: float = 0.01, sigma: float = 1.0, nms_size: int = 5, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, y, x, response of the local maxima above a share of the image's peak; none where that is not above 0."""
    got = checkpointed(harris_response(df, k, sigma, nms_size, keys))
    peak = got.groupBy(*keys).agg(F.max("response").alias("__peak"))
    got = got.where("top").join(peak, list(keys))
    return got.where((F.col("__peak") > 0) & (F.col("response") > F.col("__peak") * F.lit(threshold_ratio))).drop("top", "__peak")


def has_run(bits: Column, n: int) -> Column:
    """n neighbouring bits of a 16-bit circle are set."""
    twice = bits.bitwiseOR(F.shiftleft(bits, 16))
    part = (1 << n) - 1
    return reduce(lambda a, b: a | b, [F.shiftright(twice, i).bitwiseAND(F.lit(part)) == part for i in range(16)])


def fast_score(df: DataFrame, threshold: float = 20, n: int = 9, keys: Sequence[str] = KEYS) -> DataFrame:
    """df (in strips) with score: the sum of differences to the circle at corners, else 0; 0 within 3 pixels of the border."""
    if not 1 <= n <= 16:
        raise ValueError("n lies in 1..16")
    size = image_size(df, keys)
    got = neighbours(df, CIRCLE, "v", "__c", keys, pad=None)
    p = [F.col(f"__c{i}") for i in range(16)]
    bits = lambda test: reduce(lambda a, b: a + b, [F.when(test(c), F.lit(1 << i)).otherwise(0) for i, c in enumerate(p)]).cast("long")
    got = got.withColumns({"__b": bits(lambda c: c >= F.col("v") + threshold), "__d": bits(lambda c: c <= F.col("v") - threshold), "__a": reduce(lambda a, b: a + b, [F.abs(c - F.col("v")) for c in p])})
    got = got.join(size, list(keys))
    inside = F.expr("y >= 3 and x >= 3 and y < __H - 3 and x < __W - 3")
    score = F.when(inside & (has_run(F.col("__b"), n) | has_run(F.col("__d"), n)), F.col("__a").cast("double")).otherwise(0.0)
    return got.withColumn("score", score).drop(*[f"__c{i}" for i in range(16)], "__b", "__d", "__a", "__H", "__W")


def fast_corners(df: DataFrame, threshold: float = 20, n: int = 9, nms_size: int = 5, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, y, x, score of the corners left after non-maximum suppression."""
    got = fast_score(in_strips(df.select(*keys, "y", "x", "v"), 3 + nms_size // 2, keys), threshold, n, keys)
    # The joined sizes may have dealt rows out anew; the strips are a column, so windows find them again.
    return own_rows(local_maxima(got, "score", nms_size, keys)).where("top and score > 0").select(*keys, "y", "x", "score")


def in_raster_order(points: DataFrame, limit: int | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Points with their number in raster order from 1, at most `limit` of an image (the first ones, not the best)."""
    got = points.withColumn("number", F.row_number().over(Window.partitionBy(*keys).orderBy("y", "x")))
    return got if limit is None else got.where(F.col("number") <= limit)


def brief_pattern(n_bits: int = 256, patch: int = 15, seed: int = 7) -> list[tuple[float, float, float, float]]:
    """Fixed pairs of points (rows and columns relative to a keypoint)."""
    rng = np.random.default_rng(seed)
    draw = lambda: np.clip(rng.normal(0, patch / 5.0, (n_bits, 2)), (-patch) // 2, patch // 2)
    p, q = draw(), draw()
    return [(*map(float, a), *map(float, b)) for a, b in zip(p, q, strict=True)]


def orientations(df: DataFrame, points: DataFrame, radius: int = 3, keys: Sequence[str] = KEYS) -> DataFrame:
    """points with theta: the angle of the intensity centroid of the patch around each; 0 where it leaves the image."""
    around = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in box(radius)])).alias("o")
    cells = points.select(*keys, F.col("y").alias("__y"), F.col("x").alias("__x"), around).select("*", (F.col("__y") + F.col("o.dy")).alias("y"), (F.col("__x") + F.col("o.dx")).alias("x"))
    got = cells.join(df.select(*keys, "y", "x", "v"), [*keys, "y", "x"]).groupBy(*keys, F.col("__y").alias("y"), F.col("__x").alias("x"))
    m = got.agg(F.sum(F.col("o.dy") * F.col("v")).alias("m01"), F.sum(F.col("o.dx") * F.col("v")).alias("m10"), F.count("v").alias("n"))
    theta = F.when(F.col("n") == (2 * radius + 1) ** 2, F.atan2(F.col("m01").cast("double"), F.col("m10").cast("double"))).otherwise(0.0)
    return points.join(m.select(*keys, "y", "x", theta.alias("theta")), [*keys, "y", "x"])


def orb_keypoints(df: DataFrame, threshold: float = 20, n_bits: int = 256, patch: int = 15, max_keypoints: int | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, y, x, theta, bits (array of 0 and 1) of FAST corners at least patch // 2 from the border.

    Each keypoint asks for 2 n_bits pixels, which meet the image by one equi-join on their position."""
    half = patch // 2
    points = fast_corners(df, threshold, keys=keys).join(image_size(df, keys), list(keys))
    points = points.where(F.expr(f"y >= {half} and x >= {half} and y < __H - {half} and x < __W - {half}"))
    points = in_raster_order(points, max_keypoints, keys)
    points = orientations(df, points, min(3, half), keys)
    pattern = df.sparkSession.createDataFrame([(i, side, *p[2 * side : 2 * side + 2]) for i, p in enumerate(brief_pattern(n_bits, patch)) for side in (0, 1)], "bit int, side int, py double, px double")
    asked = points.join(F.broadcast(pattern))  # a fixed table of 2 * n_bits rows
    cos, sin = F.cos("theta"), F.sin("theta")
    ry, rx = F.col("py") * cos - F.col("px") * sin, F.col("py") * sin + F.col("px") * cos
    at = lambda c, most: F.greatest(F.lit(0), F.least(F.col(most) - 1, F.rint(c).cast("int")))
    asked = asked.select(*keys, F.col("y").alias("ky"), F.col("x").alias("kx"), "theta", "bit", "side", at(F.col("y") + ry, "__H").alias("y"), at(F.col("x") + rx, "__W").alias("x"))
    got = asked.join(df.select(*keys, "y", "x", "v"), [*keys, "y", "x"])
    pair = got.groupBy(*keys, "ky", "kx", "theta", "bit").agg(F.max(F.when(F.col("side") == 0, F.col("v"))).alias("p"), F.max(F.when(F.col("side") == 1, F.col("v"))).alias("q"))
    bits = F.transform(F.sort_array(F.collect_list(F.struct("bit", (F.col("p") < F.col("q")).cast("int").alias("on")))), lambda s: s["on"])
    return pair.groupBy(*keys, F.col("ky").alias("y"), F.col("kx").alias("x"), "theta").agg(bits.alias("bits"))


def drawn(df: DataFrame, points: DataFrame, radius: int = 3, colour: tuple[int, int, int] = (255, 0, 0), keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, y, x, r, g, b: the gray image with a circle around each point, and a ray of two radii along theta where the
    points have one."""
    ring = sorted({(round(radius * float(np.sin(a))), round(radius * float(np.cos(a)))) for a in np.linspace(0, 2 * np.pi, 8 * radius + 1)})
    cells = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ring])).alias("o")
    marks = points.select(*keys, "y", "x", cells).select(*keys, (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"))
    if "theta" in points.columns:
        ends = points.select(*keys, "y", "x", (2 * radius * F.cos("theta")).cast("int").alias("dx"), (2 * radius * F.sin("theta")).cast("int").alias("dy"))
        steps = F.greatest(F.abs("dx"), F.abs("dy"))
        along = lambda at, d: (F.col(at) + F.floor(F.col(d) * F.col("i") / F.greatest(F.lit(1), steps) + 0.5)).cast("int").alias(at)
        marks = marks.union(ends.select("*", F.explode(F.sequence(F.lit(0), steps)).alias("i")).select(*keys, along("y", "dy"), along("x", "dx")))
    marks = marks.distinct().withColumn("__on", F.lit(True))
    got = df.select(*keys, "y", "x", "v").join(marks, [*keys, "y", "x"], "left")
    return got.select(*keys, "y", "x", *[F.when(F.col("__on"), c).otherwise(F.col("v").cast("int")).alias(n) for n, c in zip("rgb", colour, strict=True)])

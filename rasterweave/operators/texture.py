"""Gray-level co-occurrence: pairs at one offset, as a sparse (i, j, p) table, and features of it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.point import quantise, to_byte, valid
from .neighborhood import KEYS, in_strips

#: Fixed values: (row, column) steps by angle.
ANGLES = {0: (0, 1), 45: (-1, 1), 90: (-1, 0), 135: (-1, -1)}


def _offset(distance: int, angle: int) -> tuple[int, int]:
    if angle not in ANGLES:
        raise ValueError(f"angle is one of {sorted(ANGLES)}")
    if distance < 1:
        raise ValueError("distance is at least 1")
    return ANGLES[angle][0] * distance, ANGLES[angle][1] * distance


def glcm(df: DataFrame, distance: int = 1, angle: int = 0, levels: int = 8, symmetric: bool = True, normed: bool = True, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, i, j, p of the level pairs that occur (p: share, or count if not normed); no padding, and no pairs of
    missing pixels.

    A pixel meets its partner by one equi-join on the shifted position; pairs are counted before the counts are
    dealt out, so an image is at most levels * levels rows a task."""
    dy, dx = _offset(distance, angle)
    q = df.select(*keys, "y", "x", quantise("v", levels).alias("i")).where("i is not null")
    there = q.select(*keys, (F.col("y") - dy).alias("y"), (F.col("x") - dx).alias("x"), F.col("i").alias("j"))
    n = q.join(there, [*keys, "y", "x"]).groupBy(*keys, "i", "j").agg(F.count(F.lit(1)).alias("p"))
    if symmetric:
        both = n.select(*keys, F.explode(F.array(F.struct("i", "j", "p"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "p"))).alias("e")).select(*keys, "e.*")
        n = both.groupBy(*keys, "i", "j").agg(F.sum("p").alias("p"))
    return n.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy(*keys))) if normed else n


def _deviation(m: str, other: str) -> Column:
    return F.sum(F.col("p") * F.col(m) * F.col(other)) - F.sum(F.col("p") * F.col(m)) * F.sum(F.col("p") * F.col(other))


def _correlation() -> Column:
    si, sj = F.sqrt(F.greatest(F.lit(0.0), _deviation("i", "i"))), F.sqrt(F.greatest(F.lit(0.0), _deviation("j", "j")))
    return F.when(si * sj > 1e-12, _deviation("i", "j") / F.when(si * sj > 1e-12, si * sj)).otherwise(1.0)


#: Aggregates over a normed table, by name.
FEATURES: dict[str, Callable[[], Column]] = {
    "contrast": lambda: F.sum(F.expr("p * (i - j) * (i - j)")),
    "dissimilarity": lambda: F.sum(F.expr("p * abs(i - j)")),
    "homogeneity": lambda: F.sum(F.expr("p / (1 + (i - j) * (i - j))")),
    "energy": lambda: F.sqrt(F.sum(F.expr("p * p"))),
    "entropy": lambda: -F.sum(F.when(F.col("p") > 0, F.col("p") * F.log2("p"))),
    "correlation": _correlation,
}


def glcm_features(df: DataFrame, distance: int = 1, angle: int = 0, levels: int = 8, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys and the six features, in one aggregation."""
    return glcm(df, distance, angle, levels, keys=keys).groupBy(*keys).agg(*[f().alias(n) for n, f in FEATURES.items()])


def window_features(q: np.ndarray, window: int, levels: int, offset: tuple[int, int], feature: str) -> np.ndarray:
    """The feature of the symmetric normed table of every window of a padded level image, one pair of levels at a time.

    Pixels of level -1 are missing and form no pairs; a window without pairs is NaN."""
    dy, dx = offset
    h, w = q.shape
    a = q[max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)]
    b = q[max(0, dy) : h - max(0, -dy), max(0, dx) : w - max(0, -dx)]
    wy, wx = window - abs(dy), window - abs(dx)
    if wy < 1 or wx < 1:
        raise ValueError("the distance does not fit into the window")

    def boxes(x: np.ndarray) -> np.ndarray:
        c = np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
        return c[wy:, wx:] - c[:-wy, wx:] - c[wy:, :-wx] + c[:-wy, :-wx]

    n = 2.0 * boxes(((a >= 0) & (b >= 0)).astype(np.int64))
    total = np.where(n > 0, n, np.nan)
    out = np.where(n > 0, 0.0, np.nan)
    m1, m2, mij = out.copy(), out.copy(), out.copy()
    present = np.unique(q[q >= 0])
    for i in present:
        for j in present:
            p = (boxes(((a == i) & (b == j)).astype(np.int64)) + boxes(((a == j) & (b == i)).astype(np.int64))) / total
            if feature == "contrast":
                out += p * (i - j) ** 2
            elif feature == "dissimilarity":
                out += p * abs(i - j)
            elif feature == "homogeneity":
                out += p / (1.0 + (i - j) ** 2)
            elif feature == "energy":
                out += p * p
            elif feature == "entropy":
                out -= p * np.log2(np.where(p > 0, p, 1.0))
            else:
                m1 += p * i
                m2 += p * i * i
                mij += p * i * j
    if feature == "energy":
        return np.sqrt(out)
    if feature == "correlation":
        var = np.maximum(m2 - m1 * m1, 0.0)
        return np.where(var > 1e-12, (mij - m1 * m1) / np.where(var > 1e-12, var, 1.0), np.where(n > 0, 1.0, np.nan))
    return out


def texture_map(df: DataFrame, feature: str = "contrast", window: int = 15, levels: int = 8, distance: int = 1, angle: int = 0, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, y, x, v (the feature of the window around each pixel, reflecting border) and byte (scaled by the image's
    greatest value, clipped). Strips with their halo are NumPy arrays in grouped functions; no task holds an image."""
    if feature not in FEATURES:
        raise ValueError(f"feature is one of {sorted(FEATURES)}")
    if window < 3 or window % 2 == 0:
        raise ValueError("window is odd and at least 3")
    offset, r = _offset(distance, angle), window // 2
    size = df.groupBy(*keys).agg(F.max("y").alias("__last"))
    cut = in_strips(df.select(*keys, "y", "x", quantise("v", levels).alias("q")), r, keys).join(size, list(keys))
    schema = df.select(*keys, "y", "x", F.lit(None).cast("double").alias("v")).schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y0, y1 = int(pdf["y"].min()), int(pdf["y"].max())
        q = np.full((y1 - y0 + 1, int(pdf["x"].max()) + 1), -1, np.int64)
        q[pdf["y"] - y0, pdf["x"]] = pdf["q"].fillna(-1)
        own = pdf.loc[pdf["__own"], "y"]
        first, last = int(own.min()), int(own.max())
        above, below = max(0, r - (first - y0)), max(0, r - (y1 - last))
        q = np.pad(q, ((above, below), (r, r)), mode="reflect")
        q = q[first - r - (y0 - above) : last + r + 1 - (y0 - above)]
        v = window_features(q, window, levels, offset, feature)
        ys, xs = np.mgrid[first : last + 1, 0 : v.shape[1]]
        out = pd.DataFrame({k: [pdf[k].iloc[0]] * v.size for k in keys})
        return out.assign(y=ys.ravel().astype("int32"), x=xs.ravel().astype("int32"), v=v.ravel())

    got = cut.groupBy(*keys, "__s").applyInPandas(lambda pdf: run(pdf) if pdf["__own"].any() else pd.DataFrame(columns=schema.names), schema)
    got = got.withColumn("v", valid("v"))
    peak = got.groupBy(*keys).agg(F.max("v").alias("__peak"))
    byte = F.when(F.col("__peak") > 0, F.col("v") / F.when(F.col("__peak") > 0, F.col("__peak")) * 255.0).otherwise(F.col("v"))
    return got.join(peak, list(keys)).withColumn("byte", to_byte(byte)).drop("__peak")

"""Neighbourhoods of pixels.

An image's rows are cut into strips of STRIP rows, and the few rows within reach of a strip's edge are dealt to both
strips. All windows of a chain of operators then run inside strips, over one shuffle by (image, strip): the vertical
and the horizontal window only sort anew. No task holds more than a strip, however tall an image is.

Pads: "reflect" (the edge is not repeated), or a constant. A pixel outside the image is told from a NULL inside.
A pixel without a value is a row with a NULL. A pixel without a row, or with several, would shift its neighbours:
shifted() compares coordinates and fails with a message; windowed() goes by coordinates and takes what is there.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STRIP = 256
KEYS = ("image_id",)


def kernel_size(k: int) -> int:
    """k as it is, if it is an odd positive int."""
    if isinstance(k, bool) or not isinstance(k, int):
        raise TypeError("a kernel size is an int")
    if k < 1 or k % 2 == 0:
        raise ValueError("a kernel size is odd and positive")
    return k


def in_strips(df: DataFrame, reach: int, keys: Sequence[str] = KEYS, size: int | None = None) -> DataFrame:
    """df with `__s`, each row in its strip and in those whose edge it is within `reach` of."""
    size = max(size or STRIP, 2 * reach + 1)
    own = F.expr(f"y div {size}").cast("int")
    near = F.array_distinct(F.array(own, F.expr(f"(y - {reach}) div {size}").cast("int"), F.expr(f"(y + {reach}) div {size}").cast("int")))
    return df.withColumn("__s", F.explode(F.filter(near, lambda s: s >= 0))).repartition(*keys, "__s").withColumn("__own", own == F.col("__s"))


def own_rows(df: DataFrame) -> DataFrame:
    return df.where("__own").drop("__s", "__own")


def shifted(column: Column | str, k: int, axis: str, keys: Sequence[str] = KEYS, pad: str | float | bool | None = "reflect") -> Column:
    """The value k pixels further on the axis "y" (down) or "x" (right)."""
    across = "x" if axis == "y" else "y"
    w = Window.partitionBy(*keys, "__s", across).orderBy(axis)
    own = F.struct((F.col(column) if isinstance(column, str) else column).alias("v"), F.col(axis).alias("c"))
    if k == 0:
        return own["v"]


    def at(j: int) -> Column:
        if not j:
            return own
        there = F.lead(own, j).over(w) if j > 0 else F.lag(own, -j).over(w)
        gap = F.raise_error(F.concat_ws(" ", F.lit("pixels are missing or repeated near y, x ="), "y", "x"))
        return F.when(there["c"] != F.col(axis) + j, gap).otherwise(there)

    if pad == "reflect":
        # i pixels before the edge, a step of k is turned back to a step of 2 i - k.
        side, n = (1, k) if k > 0 else (-1, -k)
        turned = [F.when(at(side * i).isNotNull(), at(side * (2 * i - n))) for i in range(n - 1, -1, -1)]
        return F.coalesce(at(k), *turned, own)["v"]
    return F.when(at(k).isNull(), F.lit(pad)).otherwise(at(k)["v"])


def neighbours(df: DataFrame, offsets: Sequence[tuple[int, int]], column: str = "v", out: str = "n", keys: Sequence[str] = KEYS, pad: str | float | bool | None = "reflect") -> DataFrame:
    """df (in strips) with columns out0, out1, ...: the value at (y + dy, x + dx) of each offset."""
    rows = sorted({dy for dy, _ in offsets})
    df = df.withColumns({f"__v{i}": shifted(column, dy, "y", keys, pad) for i, dy in enumerate(rows)})
    at = {dy: f"__v{i}" for i, dy in enumerate(rows)}
    df = df.withColumns({f"{out}{i}": shifted(at[dy], dx, "x", keys, pad) for i, (dy, dx) in enumerate(offsets)})
    return df.drop(*at.values())


def box(radius: int) -> list[tuple[int, int]]:
    return [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1)]


def weighted(names: Sequence[str], weights: Sequence[float]) -> Column:
    """The sum of w times column, over the weights that are not 0."""
    terms = [F.col(n).cast("double") * F.lit(float(w)) for n, w in zip(names, weights, strict=True) if w]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def correlate(df: DataFrame, kernel: Sequence[Sequence[float]], column: str = "v", out: str = "v", keys: Sequence[str] = KEYS, pad: str | float = "reflect") -> DataFrame:
    """df (in strips) with `out`, the cross-correlation with a square kernel (not flipped)."""
    r = len(kernel) // 2
    cells = [(dy, dx, kernel[dy + r][dx + r]) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if kernel[dy + r][dx + r]]
    df = neighbours(df, [(dy, dx) for dy, dx, _ in cells], column, "__k", keys, pad)
    names = [f"__k{i}" for i in range(len(cells))]
    return df.withColumn(out, weighted(names, [w for *_, w in cells])).drop(*names)


def separable(df: DataFrame, weights: Sequence[float], column: str = "v", out: str = "v", keys: Sequence[str] = KEYS, pad: str | float = "reflect") -> DataFrame:
    """df (in strips) with `out`, the correlation with the outer product of `weights` with itself: two passes of one axis."""
    r = len(weights) // 2
    for axis, source in (("y", column), ("x", "__p")):
        df = df.withColumns({f"__k{i}": shifted(source, i - r, axis, keys, pad) for i in range(len(weights))})
        names = [f"__k{i}" for i in range(len(weights))]
        df = df.withColumn("__p" if axis == "y" else out, weighted(names, weights)).drop(*names)
    return df.drop("__p")


def windowed(df: DataFrame, aggregate: Callable[[Column | str], Column], radius: int, column: str = "v", out: str = "v", keys: Sequence[str] = KEYS) -> DataFrame:
    """df (in strips) with `out`: an aggregate over the box, of the pixels inside the image only."""
    for axis, source, to in (("y", column, "__p"), ("x", "__p", out)):
        w = Window.partitionBy(*keys, "__s", "x" if axis == "y" else "y").orderBy(axis).rangeBetween(-radius, radius)
        df = df.withColumn(to, aggregate(source).over(w))
    return df.drop("__p")


def image_size(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return df.groupBy(*keys).agg((F.max("y") + 1).alias("__H"), (F.max("x") + 1).alias("__W"))


def interior(df: DataFrame, margin: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """The pixels at least `margin` from the border."""
    inside = df.join(image_size(df, keys), list(keys)).where(F.expr(f"y >= {margin} and x >= {margin} and y < __H - {margin} and x < __W - {margin}"))
    return inside.drop("__H", "__W")


def aligned(df: DataFrame, bands: Sequence[int], keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, y, x, b1, b2, ...): the pixels that all the bands have, side by side, from (keys, band, y, x, v)."""
    out = None
    for b in bands:
        one = df.where(F.col("band") == b).select(*keys, "y", "x", F.col("v").alias(f"b{b}"))
        out = one if out is None else out.join(one, [*keys, "y", "x"])
    return out

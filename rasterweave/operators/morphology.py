"""Binary morphology: a pixel outside the image is background, structuring elements are not mirrored."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import remove_small
from .neighborhood import KEYS, in_strips, neighbours, own_rows

Element = list[list[bool]]


def square(size: int = 3) -> Element:
    if size < 1 or size % 2 == 0:
        raise ValueError("size is odd and positive")
    return [[True] * size for _ in range(size)]


def disk(radius: int = 1) -> Element:
    if radius < 1:
        raise ValueError("radius is at least 1")
    around = range(-radius, radius + 1)
    return [[x * x + y * y <= radius * radius for x in around] for y in around]


def cross(size: int = 3) -> Element:
    if size < 1 or size % 2 == 0:
        raise ValueError("size is odd and positive")
    return [[y == size // 2 or x == size // 2 for x in range(size)] for y in range(size)]


def offsets(element: Element) -> list[tuple[int, int]]:
    ay, ax = len(element) // 2, len(element[0]) // 2
    return [(y - ay, x - ax) for y, row in enumerate(element) for x, on in enumerate(row) if on]


def binary(df: DataFrame, threshold: float = 127) -> DataFrame:
    """df with fg: v >= threshold."""
    return df.withColumn("fg", F.coalesce(F.col("v") >= threshold, F.lit(False)))


def steps(df: DataFrame, plan: Sequence[tuple[str, Element]], keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, y, x, fg after a chain of ("erode" or "dilate", element) steps, all inside one set of strips."""
    reach = sum(max(max(abs(dy), abs(dx)) for dy, dx in offsets(e)) for _, e in plan)
    got = in_strips(df.select(*keys, "y", "x", "fg"), max(reach, 1), keys)
    for op, element in plan:
        cells = offsets(element)
        names = [f"__m{i}" for i in range(len(cells))]
        got = neighbours(got, cells, "fg", "__m", keys, pad=False)
        join = (lambda a, b: a & b) if op == "erode" else (lambda a, b: a | b)
        got = got.withColumn("fg", reduce(join, [F.col(n) for n in names])).drop(*names)
    return own_rows(got)


def _times(iterations: int) -> int:
    if iterations < 1:
        raise ValueError("iterations must be positive")
    return iterations


def erode(df: DataFrame, element: Element | None = None, iterations: int = 1, keys: Sequence[str] = KEYS) -> DataFrame:
    return steps(df, [("erode", element or square())] * _times(iterations), keys)


def dilate(df: DataFrame, element: Element | None = None, iterations: int = 1, keys: Sequence[str] = KEYS) -> DataFrame:
    return steps(df, [("dilate", element or square())] * _times(iterations), keys)


def opening(df: DataFrame, element: Element | None = None, iterations: int = 1, keys: Sequence[str] = KEYS) -> DataFrame:
    n, e = _times(iterations), element or square()
    return steps(df, [("erode", e)] * n + [("dilate", e)] * n, keys)


def closing(df: DataFrame, element: Element | None = None, iterations: int = 1, keys: Sequence[str] = KEYS) -> DataFrame:
    n, e = _times(iterations), element or square()
    return steps(df, [("dilate", e)] * n + [("erode", e)] * n, keys)


def clean_mask(df: DataFrame, element: Element | None = None, iterations: int = 1, remove_speckle: bool = True, fill_holes: bool = True, min_size: int = 0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Opening, closing, and removal of components of under min_size pixels."""
    e, plan = element or square(), []
    if remove_speckle:
        plan += [("erode", e)] * iterations + [("dilate", e)] * iterations
    if fill_holes:
        plan += [("dilate", e)] * iterations + [("erode", e)] * iterations
    got = steps(df, plan, keys) if plan else df.select(*keys, "y", "x", "fg")
    return remove_small(got, min_size, keys) if min_size > 0 else got


MASKS = {"intersection": lambda a, b: a & b, "union": lambda a, b: a | b, "difference": lambda a, b: a & ~b, "complement": lambda a, b: ~a}


def combined(a: DataFrame, b: DataFrame, op: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Two masks of the same images by a set operation of MASKS (complement: of the first)."""
    own = a.select(*keys, "y", "x", F.col("fg").alias("__a")).join(b.select(*keys, "y", "x", F.col("fg").alias("__b")), [*keys, "y", "x"])
    return own.select(*keys, "y", "x", MASKS[op](F.col("__a"), F.col("__b")).alias("fg"))

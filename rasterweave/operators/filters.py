"""Smoothing filters (stride 1, same size, reflecting border); results are DOUBLE before quantisation."""

from __future__ import annotations

from collections.abc import Callable
from math import exp

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .neighborhood import KEYS, box, in_strips, kernel_size, neighbours, own_rows, separable


def gaussian_weights(k: int, sigma: float) -> list[float]:
    """One axis of the normalised kernel; the square kernel is its outer product with itself."""
    if sigma <= 0:
        raise ValueError("sigma must be positive")
    w = [exp(-((i - k // 2) ** 2) / (2.0 * sigma**2)) for i in range(k)]
    return [x / sum(w) for x in w]


def gaussian_kernel(k: int, sigma: float) -> list[list[float]]:
    w = gaussian_weights(k, sigma)
    return [[a * b for b in w] for a in w]


def mean_blur(df: DataFrame, size: int = 3, keys=KEYS) -> DataFrame:
    k = kernel_size(size)
    got = separable(in_strips(df, k // 2, keys), [1.0] * k, keys=keys)
    return own_rows(got).withColumn("v", F.col("v") / float(k * k))


def gaussian_blur(df: DataFrame, size: int = 5, sigma: float = 1.0, keys=KEYS) -> DataFrame:
    k = kernel_size(size)
    return own_rows(separable(in_strips(df, k // 2, keys), gaussian_weights(k, sigma), keys=keys))


def median_filter(df: DataFrame, size: int = 3, keys=KEYS) -> DataFrame:
    """The middle one of the window's pixels that are there (the lower of two); NULL if none is."""
    k = kernel_size(size)
    n = k * k
    got = neighbours(in_strips(df, k // 2, keys), box(k // 2), "v", "__n", keys)
    names = [f"__n{i}" for i in range(n)]
    there = F.array_compact(F.array(*names))
    return own_rows(got.withColumn("v", F.get(F.sort_array(there), F.floor((F.size(there) - 1) / 2).cast("int"))).drop(*names))


FILTERS: dict[str, Callable[..., DataFrame]] = {"mean": mean_blur, "box": mean_blur, "gaussian": gaussian_blur, "median": median_filter}


def apply_filter(df: DataFrame, method: str, **options) -> DataFrame:
    """The filter of a registered name, whatever its case and surrounding space."""
    name = method.lower().strip()
    if name not in FILTERS:
        raise ValueError(f"no filter {method!r}; there are {', '.join(sorted(FILTERS))}")
    return FILTERS[name](df, **options)

"""Point operators as Column expressions; a missing pixel is NULL and stays NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Default band numbers of a scene, counted from 1.
BAND_MAP = {"blue": 1, "green": 2, "red": 3, "nir": 4}
#: The vegetation ramp, stop: (red, green, blue).
RAMP = [(0.0, (120, 80, 40)), (0.5, (230, 220, 120)), (0.75, (120, 190, 90)), (1.0, (20, 110, 40))]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c: Column | str, low: float, high: float) -> Column:
    c = col(c)
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def to_byte(c: Column | str) -> Column:
    """0..255 by clipping and truncation."""
    return clip(col(c).cast("double"), 0.0, 255.0).cast("int")


def to_unit(mask: Column | str) -> Column:
    """A mask as 0 and 255."""
    return F.when(col(mask), 255).when(~col(mask), 0)


def luma(r: Column | str, g: Column | str, b: Column | str) -> Column:
    """ITU-R 601 gray of integer channels, in 16-bit fixed point."""
    return F.shiftright(col(r) * 19595 + col(g) * 38470 + col(b) * 7471 + 32768, 16)


def valid(c: Column | str, nodata: float | None = None) -> Column:
    """NaN and the nodata value as NULL."""
    c = col(c).cast("double")
    got = F.when(~F.isnan(c), c)
    return got if nodata is None else F.when(got != F.lit(float(nodata)), got)


def reflectance(c: Column | str, scale: float = 10000.0) -> Column:
    """Fixed-range scaling to 0..1."""
    return clip(col(c) / F.lit(scale), 0.0, 1.0)


def adjust_gamma(c: Column | str, gamma: float) -> Column:
    return clip(F.pow(col(c), F.lit(float(gamma))), 0.0, 1.0)


def adjust_brightness_contrast(c: Column | str, contrast: float = 1.0, brightness: float = 0.0) -> Column:
    return clip(col(c) * F.lit(float(contrast)) + F.lit(float(brightness)), 0.0, 1.0)


def normalized_difference(a: Column | str, b: Column | str, zero: str = "zero") -> Column:
    """(a - b) / (a + b). zero="zero": 0 where the sum is 0, clipped to -1..1; zero="null": NULL there, not clipped."""
    if zero not in ("zero", "null"):
        raise ValueError("zero is 'zero' or 'null'")
    a, b = col(a).cast("double"), col(b).cast("double")
    ratio = F.when(a + b != 0, (a - b) / F.when(a + b != 0, a + b))
    return ratio if zero == "null" else F.when(a + b == 0, F.lit(0.0)).otherwise(clip(ratio, -1.0, 1.0))


def ndvi(nir: Column | str, red: Column | str, zero: str = "zero") -> Column:
    return normalized_difference(nir, red, zero)


def ndwi(green: Column | str, nir: Column | str, zero: str = "zero") -> Column:
    return normalized_difference(green, nir, zero)


def ndbi(swir: Column | str, nir: Column | str, zero: str = "zero") -> Column:
    return normalized_difference(swir, nir, zero)


def index_byte(index: Column | str) -> Column:
    """An index in -1..1 as gray 0..255, truncated."""
    return ((clip(index, -1.0, 1.0) + 1.0) / 2.0 * 255.0).cast("int")


def index_image(index: Column | str, colormap: str | None = None) -> Column:
    """An index in -1..1 as gray 0..255 (None) or by the vegetation ramp as struct r, g, b ("veg")."""
    if colormap not in (None, "veg"):
        raise ValueError("colormap is None or 'veg'")
    return index_byte(index) if colormap is None else ramp((clip(index, -1.0, 1.0) + 1.0) / 2.0)


def ramp(unit: Column | str, stops: list[tuple[float, tuple[int, int, int]]] = RAMP) -> Column:
    """A value in 0..1 as struct r, g, b: piecewise linear between stops, truncated."""
    u = col(unit)

    def channel(k: int) -> Column:
        out = F.when(u <= stops[0][0], F.lit(float(stops[0][1][k])))
        for (x0, c0), (x1, c1) in zip(stops, stops[1:]):
            out = out.when(u <= x1, (u - x0) / (x1 - x0) * float(c1[k] - c0[k]) + float(c0[k]))
        return out.otherwise(F.when(u.isNotNull(), F.lit(float(stops[-1][1][k])))).cast("int")

    return F.struct(channel(0).alias("r"), channel(1).alias("g"), channel(2).alias("b"))


def quantise(c: Column | str, levels: int) -> Column:
    """Gray 0..255 as a level 0..levels - 1."""
    if levels < 1:
        raise ValueError("levels must be positive")
    return clip(F.floor(col(c) * levels / 256), 0, levels - 1).cast("int")


def threshold(c: Column | str, t: float = 127, invert: bool = False, strict: bool = False, check: bool = True) -> Column:
    """v >= t (strict: v > t); invert gives the complement."""
    if check and not 0 <= t <= 255:
        raise ValueError("a threshold lies in 0..255")
    m = col(c) > t if strict else col(c) >= t
    return ~m if invert else m

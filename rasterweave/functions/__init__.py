"""Column builders for point operators."""

from .point import (  # noqa: F401
    BAND_MAP,
    RAMP,
    adjust_brightness_contrast,
    adjust_gamma,
    clip,
    index_byte,
    index_image,
    luma,
    ndbi,
    ndvi,
    ndwi,
    normalized_difference,
    quantise,
    ramp,
    reflectance,
    threshold,
    to_byte,
    to_unit,
    valid,
)

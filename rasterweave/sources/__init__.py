"""Scenes in and out."""

from .raster import as_band, describe, extract_bands, features, read_band, read_images, read_raster, shaded, to_gray, to_png, to_tiff, with_profile, write_bands, write_scenes  # noqa: F401

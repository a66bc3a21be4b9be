"""Image operators on pixel tables (image_id, y, x, v)."""

from .components import labelled, remove_small  # noqa: F401
from .edges import canny, laplacian, laplacian_of_gaussian, prewitt, sobel, sobel_magnitude  # noqa: F401
from .filters import FILTERS, apply_filter, gaussian_blur, mean_blur, median_filter  # noqa: F401
from .keypoints import drawn, fast_corners, harris_corners, in_raster_order, orb_keypoints  # noqa: F401
from .morphology import binary, clean_mask, closing, combined, cross, dilate, disk, erode, opening, square  # noqa: F401
from .segmentation import colourised, distance_transform, generate_markers, kmeans, watershed  # noqa: F401
from .stats import band_stats, clahe, counts256, equalised, histogram, linear_stretch, otsu, otsu_threshold, percentile_stretch, summary  # noqa: F401
from .texture import FEATURES, glcm, glcm_features, texture_map  # noqa: F401

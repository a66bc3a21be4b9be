"""Reading scenes into pixel rows, and writing them back."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.point import clip, luma, ramp, to_byte, valid
from ..operators.stats import linear_stretch, percentile_stretch
from . import tiff

PIXELS = "image_id string, band int, y int, x int, v double"
META = (
    "image_id string, driver string, width int, height int, count int, dtypes array<string>, nodata double, crs string, epsg int, "
    "res array<double>, bounds array<double>, affine array<double>, descriptions array<string>"
)
#: Pixels leave the decoder in blocks of about so many rows of the table.
BLOCK = 500_000


def _files(spark: SparkSession, path: str) -> DataFrame:
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not any(c in path for c in "*?[{") and not fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs):
        raise FileNotFoundError(path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(F.lower("path").rlike(r"\.tiff?$")).select("path", "content")


def read_raster(spark: SparkSession, path: str, bands: Sequence[int] | None = None, mask_nodata: bool = False) -> DataFrame:
    """(image_id, band, y, x, v) of the scenes under a path."""
    return decoded(_files(spark, path), bands, mask_nodata)


def decoded(files: DataFrame, bands: Sequence[int] | None = None, mask_nodata: bool = False) -> DataFrame:
    """(image_id, band, y, x, v) of TIFF files as rows (path, content): a file in one task, decoded band by band where the
    file holds bands apart, else at once."""
    wanted = list(bands) if bands else None
    if wanted and any(isinstance(b, bool) or not isinstance(b, int) or b < 1 for b in wanted):
        raise ValueError("bands are ints from 1")

    def pixels(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                info = tiff.header(content)
                chosen = wanted or list(range(1, info["count"] + 1))
                whole = None if info["apart"] else tiff.decode(content, chosen)[0]
                for i, b in enumerate(chosen):
                    plane = (tiff.decode(content, [b])[0][0] if whole is None else whole[i]).astype(float)
                    if mask_nodata and info["nodata"] is not None:
                        plane[plane == info["nodata"]] = np.nan
                    h, w = plane.shape
                    step = max(1, BLOCK // max(1, w))
                    for y0 in range(0, h, step):
                        part = plane[y0 : y0 + step]
                        ys, xs = np.mgrid[y0 : y0 + len(part), 0:w]
                        yield pd.DataFrame({"image_id": path, "band": np.int32(b), "y": ys.ravel().astype("int32"), "x": xs.ravel().astype("int32"), "v": part.ravel()})

    got = files.mapInPandas(pixels, PIXELS)
    return got.withColumn("v", valid("v"))


def read_band(spark: SparkSession, path: str, band: int = 1) -> DataFrame:
    return read_raster(spark, path, [band])


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, band, y, x, v) of PNG, JPEG, GIF and BMP files under a path, by Spark's image source: a gray image has
    one band, a colour image red, green and blue, and a fourth band where it has alpha. A file that is no image is an error."""
    images = spark.read.format("image").option("recursiveFileLookup", "true").load(path).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")

    def pixels(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for origin, h, w, n, data in pdf.itertuples(index=False):
                if n < 1:
                    raise ValueError(f"no image: {origin}")
                planes = np.frombuffer(data, np.uint8).reshape(h, w, n)
                planes = planes[:, :, [2, 1, 0, 3][:n]] if n > 1 else planes
                step = max(1, BLOCK // max(1, w))
                for b in range(n):
                    for y0 in range(0, h, step):
                        part = planes[y0 : y0 + step, :, b]
                        ys, xs = np.mgrid[y0 : y0 + len(part), 0:w]
                        yield pd.DataFrame({"image_id": origin, "band": np.int32(b + 1), "y": ys.ravel().astype("int32"), "x": xs.ravel().astype("int32"), "v": part.ravel().astype(float)})

    return images.mapInPandas(pixels, PIXELS)


def as_band(df: DataFrame, column: str = "v") -> DataFrame:
    """(image_id, y, x, v DOUBLE) of a table that holds one band; a table with a band column, or without the columns of a
    pixel, is an error."""
    missing = {"image_id", "y", "x", column} - set(df.columns)
    if missing or "band" in df.columns:
        raise ValueError(f"a band has a value a position: {sorted(missing) or 'the table has several bands'}")
    return df.select("image_id", "y", "x", F.col(column).cast("double").alias("v"))


def describe(spark: SparkSession, path: str) -> DataFrame:
    """One row a scene, from its header."""
    return described(_files(spark, path))


def described(files: DataFrame) -> DataFrame:
    names = [c.split()[0] for c in META.split(", ")]

    def heads(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                info = tiff.header(content)
                rows.append([path, *[list(info[n]) if isinstance(info[n], tuple) else info[n] for n in names[1:]]])
            out = pd.DataFrame(rows, columns=names)
            out["epsg"] = out["epsg"].astype("Int32")
            yield out

    return files.mapInPandas(heads, META)


def to_gray(df: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Gray (keys, y, x, v INT): a single band as it is, three bands by luma."""
    n = F.count(F.lit(1))
    band = lambda b: F.max(F.when(F.col("band") == b, F.col("v"))).cast("int")
    got = df.groupBy(*keys, "y", "x").agg(n.alias("__n"), band(1).alias("__1"), band(2).alias("__2"), band(3).alias("__3"))
    return got.select(*keys, "y", "x", F.when(F.col("__n") >= 3, luma("__1", "__2", "__3")).otherwise(F.col("__1")).alias("v"))


def features(df: DataFrame, bands: Sequence[int], keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """keys, y, x and b1, b2, ...: bands side by side, aligned by position."""
    return df.groupBy(*keys, "y", "x").agg(*[F.max(F.when(F.col("band") == b, F.col("v"))).alias(f"b{b}") for b in bands])


def write_bands(df: DataFrame, path: str) -> None:
    """Pixels as Parquet, a folder an image and band."""
    df.write.partitionBy("image_id", "band").parquet(path)


def to_tiff(df: DataFrame, dtype: str = "float32", nodata: float | None = None, affine: Sequence[float] | None = None, epsg: int | None = None, description: str | None = None) -> DataFrame:
    """image_id, band, content: every band as a georeferenced single-band file's bytes."""
    kind = np.dtype(dtype)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.full((int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1), np.nan if nodata is None else nodata)
        a[pdf["y"], pdf["x"]] = pdf["v"] if nodata is None else pdf["v"].fillna(nodata)
        if kind.kind in "iu":
            a = np.clip(np.nan_to_num(a), np.iinfo(kind).min, np.iinfo(kind).max)
        content = tiff.encode(a.astype(kind), tuple(affine) if affine else None, epsg, nodata, [description] if description else None)
        return pd.DataFrame({"image_id": [pdf["image_id"].iloc[0]], "band": [int(pdf["band"].iloc[0])], "content": [content]})

    return df.groupBy("image_id", "band").applyInPandas(run, df.select("image_id", "band", F.lit(b"").alias("content")).schema)


def with_profile(files: DataFrame, meta: DataFrame, dtype: str | None = None, nodata: float | None = None) -> DataFrame:
    """Files (image_id, band, content) with the position, reference system, nodata value and (None) type that `meta`, as
    `describe` gives it, states of their scene. A row a file on both sides; pixels don't move."""
    both = files.join(meta.select("image_id", "affine", "epsg", F.col("nodata").alias("__nodata"), F.col("dtypes")[0].alias("__dtype")), "image_id")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for content, affine, epsg, blank, kind in zip(pdf["content"], pdf["affine"], pdf["epsg"], pdf["__nodata"], pdf["__dtype"], strict=True):
                a, info = tiff.decode(bytes(content))
                blank = nodata if nodata is not None else None if pd.isna(blank) else float(blank)
                to = np.dtype(dtype or kind)
                if to.kind in "iu":
                    a = np.clip(np.nan_to_num(a, nan=blank or 0), np.iinfo(to).min, np.iinfo(to).max)
                out.append(tiff.encode(a.astype(to), None if affine is None else tuple(map(float, affine)), None if pd.isna(epsg) else int(epsg), blank, info["descriptions"]))
            yield pdf[["image_id", "band"]].assign(content=out)

    return both.mapInPandas(run, files.select("image_id", "band", "content").schema)


def extract_bands(df: DataFrame, uri: str, dtype: str = "float32", meta: DataFrame | None = None) -> list[str]:
    """Writes each band of each scene as `<scene>/band_NN.tif` and, stretched between its 2 % and 98 % quantiles, as gray
    `<scene>/band_NN.png`; gives the paths. With `meta` the files carry their scene's profile."""
    # Missing pixels stay NaN until the scene's nodata value is known.
    files = to_tiff(df, dtype) if meta is None else with_profile(to_tiff(df, "float64"), meta, dtype)
    by_band = ["image_id", "band"]
    gray = percentile_stretch(df, keys=by_band).withColumn("v", to_byte(F.col("v") * 255))
    # A pair of names, scene and band, is the id of a file; the scene becomes its folder.
    name = F.concat(F.regexp_replace(F.element_at(F.split("image_id", "/"), -1), r"[^\w.-]+", "_"), F.lit("/band_"), F.lpad(F.col("band").cast("string"), 2, "0"))
    tifs = write_scenes(files.select(name.alias("image_id"), "content"), uri, ".tif", folders=True)
    return tifs + write_scenes(to_png(gray.select(name.alias("image_id"), "y", "x", F.coalesce("v", F.lit(0)).alias("v"))), uri, ".png", folders=True)


def shaded(df: DataFrame, low: float | None = None, high: float | None = None, stops: list | None = None) -> DataFrame:
    """image_id, y, x and v in 0..255, or r, g, b by the stops of a ramp: values between low and high (None: the image's
    least and greatest) over the whole range. A missing pixel is black."""
    if low is None or high is None:
        got = linear_stretch(df, ("image_id",))
    else:
        got = df.withColumn("v", clip((F.col("v") - F.lit(float(low))) / F.lit(float(high - low)), 0.0, 1.0))
    if stops is None:
        return got.select("image_id", "y", "x", F.coalesce(to_byte(F.col("v") * 255), F.lit(0)).alias("v"))
    c = ramp("v", stops)
    return got.select("image_id", "y", "x", *[F.coalesce(c[n], F.lit(0)).alias(n) for n in "rgb"])


def to_png(df: DataFrame) -> DataFrame:
    """image_id, content: a gray (y, x, v in 0..255) or colour (y, x, r, g, b) image as PNG bytes."""
    colour = "r" in df.columns

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shape = (int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1) + ((3,) if colour else ())
        a = np.zeros(shape, np.uint8)
        a[pdf["y"], pdf["x"]] = pdf[["r", "g", "b"]].to_numpy() if colour else pdf["v"]
        return pd.DataFrame({"image_id": [pdf["image_id"].iloc[0]], "content": [tiff.png(a)]})

    return df.groupBy("image_id").applyInPandas(run, df.select("image_id", F.lit(b"").alias("content")).schema)


def write_scenes(files: DataFrame, uri: str, suffix: str = ".tif", folders: bool = False) -> list[str]:
    """Writes rows (image_id, content) as files under a folder that all executors reach; gives their paths.

    A file is written under a name of the attempt and moved into place, so a task that runs again replaces it. Names are
    the ids, with what no file name should hold replaced; with `folders` what stands before the last slash of an id is a folder."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, folder = fs.FileSystem.from_uri(uri)
        store.create_dir(folder, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        for pdf in it:
            names = [re.sub(r"[^\w.-]+", "_", str(i).rsplit("/", 1)[-1]).removesuffix(suffix) + suffix for i in pdf["image_id"]]
            paths = []
            for i, name, content in zip(pdf["image_id"], names, pdf["content"], strict=True):
                into = f"{folder}/{re.sub(r'[^\w.-]+', '_', str(i).rsplit('/', 1)[0])}" if folders and "/" in str(i) else folder
                store.create_dir(into, recursive=True)
                with store.open_output_stream(f"{into}/.{attempt}-{name}", compression=None) as out:
                    out.write(bytes(content))
                store.move(f"{into}/.{attempt}-{name}", f"{into}/{name}")
                paths.append(f"{into}/{name}")
            yield pd.DataFrame({"path": paths})

    return sorted(r["path"] for r in files.select("image_id", "content").mapInPandas(run, "path string").collect())

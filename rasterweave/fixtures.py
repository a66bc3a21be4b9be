"""Rasters derived from plain tables, the same in Spark and in SQL: (image_id, y, x, v) and a multi-band scene."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.posexplode("embedding").alias("x", "e"))
    return e.select("vec_id", "x", F.expr("cast(greatest(0, least(255, floor((cast(e as double) + 0.5D) * 255))) as int)").alias("v"))


def scene_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One gray image: a row per vector, a column per dimension."""
    return _pixels(spark, sf_dir).select(F.lit(0).cast("long").alias("image_id"), F.col("vec_id").cast("int").alias("y"), "x", "v")


def chips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One 8 x 8 image per vector."""
    p = _pixels(spark, sf_dir)
    return p.select(F.col("vec_id").alias("image_id"), F.expr("x div 8").cast("int").alias("y"), F.expr("x % 8").alias("x"), "v")


def scene_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense 64 x 64 scene with integer bands red, nir, green and swir (wide layout)."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    cells = li.groupBy(F.expr("cast(l_orderkey % 64 as int)").alias("y"), F.expr("cast(l_partkey % 64 as int)").alias("x")).agg(
        F.expr("sum(cast(l_quantity as bigint)) % 256").alias("red"),
        F.expr("sum(cast(round(l_discount * 100) as bigint)) % 256").alias("nir"),
        F.expr("sum(cast(round(l_tax * 100) as bigint)) % 256").alias("green"),
        F.expr("sum(l_linenumber) % 256").alias("swir"),
    )
    grid = spark.range(64 * 64).select(F.expr("cast(id div 64 as int)").alias("y"), F.expr("cast(id % 64 as int)").alias("x"))
    bands = [F.coalesce(b, F.lit(0)).cast("int").alias(b) for b in ("red", "nir", "green", "swir")]
    return grid.join(cells, ["y", "x"], "left").select(F.lit(0).cast("long").alias("image_id"), "y", "x", *bands)


def scene_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The multi-band scene as (image_id, band, y, x, v), bands 1 blue, 2 green, 3 red, 4 near infrared (blue is swir here)."""
    m = scene_multi(spark, sf_dir)
    return m.select("image_id", F.expr("stack(4, 1, swir, 2, green, 3, red, 4, nir) as (band, v)"), "y", "x").select("image_id", "band", "y", "x", "v")


#: SQL for the same rasters, as common table expressions.
GRAY = """px as (select vec_id, unnest(range(64))::int as x, unnest(embedding) as e from embeddings),
g as materialized (select vec_id::int as y, x, greatest(0, least(255, floor((e::double + 0.5) * 255)))::int as v from px)"""
CHIPS = """px as (select vec_id, unnest(range(64))::int as i, unnest(embedding) as e from embeddings),
c as (select vec_id as image_id, (i // 8)::int as y, (i % 8)::int as x, greatest(0, least(255, floor((e::double + 0.5) * 255)))::int as v from px)"""
MULTI = """cells as (select (l_orderkey % 64)::int as y, (l_partkey % 64)::int as x, sum(l_quantity::bigint) % 256 as red, sum(round(l_discount * 100)::bigint) % 256 as nir,
  sum(round(l_tax * 100)::bigint) % 256 as green, sum(l_linenumber) % 256 as swir from lineitem group by 1, 2),
grid as (select (i // 64)::int as y, (i % 64)::int as x from range(4096) t(i)),
m as materialized (select y, x, coalesce(red, 0)::int as red, coalesce(nir, 0)::int as nir, coalesce(green, 0)::int as green, coalesce(swir, 0)::int as swir from grid left join cells using (y, x)),
ml as materialized (select 1 as band, y, x, swir as v from m union all select 2, y, x, green from m union all select 3, y, x, red from m union all select 4, y, x, nir from m)"""

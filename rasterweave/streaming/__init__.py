"""Stateless point operators over a stream of new scenes: the Column functions are the same as in batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession


def pixel_stream(spark: SparkSession, path: str, schema: str = "image_id string, band int, y int, x int, v double", **options: str) -> DataFrame:
    """Pixel tables as they arrive in a folder of Parquet files."""
    return spark.readStream.schema(schema).options(**options).parquet(path)


def applied(stream: DataFrame, column: Column, out: str = "v") -> DataFrame:
    return stream.withColumn(out, column)


def each_scene(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], target: str, checkpoint: str):
    """Runs any batch operator on every micro-batch and appends its rows to a Parquet table."""
    run = lambda batch, _: operator(batch).write.mode("append").parquet(target)
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

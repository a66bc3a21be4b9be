"""The package on the executors, for sessions whose workers don't have it on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hands the package's source to Spark once an application; Spark's own file server takes it to the executors."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    at = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="rasterweave-")), "rasterweave.zip")
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
        for p in sorted(root.parent.glob("corpus_pipeline.py")):
            z.write(p, p.name)
    context.addPyFile(at)
    _shipped.add(context.applicationId)

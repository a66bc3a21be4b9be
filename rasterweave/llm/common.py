"""What the operators of this subpackage share: reading, checkpointing, and joins with a checked small side."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

#: A side of at most so many bytes, and ROW_BYTES for each row, is broadcast; a larger one is joined by a shuffle.
BROADCAST_BYTES, ROW_BYTES = 48_000_000, 64

CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_folders: list[str] = []


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col(quoted(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. A local folder is made only where none is set and all runs on this machine."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(at or tempfile.mkdtemp(prefix="rw-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the shared checkpoint folder, so a lost executor costs nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def dropped(df: DataFrame) -> None:
    """Removes the files of a checkpointed table that nothing reads any more."""
    plan = df._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() == "LogicalRDD" and (at := plan.rdd().getCheckpointFile()).isDefined():
        remove(df.sparkSession, at.get())


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Inside, each step's shuffle files go when the step is done, not when the driver happens to collect its garbage; for
    chains of checkpointed() steps. Many small steps else fill the disk with files of a block each."""
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEAN)
        else:
            spark.conf.set(CLEAN, before)


def scratch(spark: SparkSession) -> str:
    """A new folder's name in the shared folder."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept as Parquet in the shared folder, of which later steps read the columns that
    they need. swept() removes it."""
    at = scratch(df.sparkSession)
    _folders.append(at)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def swept(spark: SparkSession) -> None:
    """Removes what kept() has written so far; for when the results that read it are written themselves."""
    while _folders:
        remove(spark, _folders.pop())


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def same(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]]) -> Column:
    """Null-safe equality of the key pairs."""
    return reduce(lambda a, b: a & b, [left[a].eqNullSafe(right[b]) for a, b in keys])


def n_bytes(df: DataFrame) -> int:
    """About what the rows of df take in a broadcast: ROW_BYTES each, and their texts and lists."""

    def size(c: Column, kind: DataType) -> Column | None:
        if isinstance(kind, (StringType, BinaryType)):
            return F.octet_length(c)
        if isinstance(kind, ArrayType):
            inner = size(F.lit(None).cast(kind.elementType), kind.elementType)
            return F.size(c) * 16 if inner is None else F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(size(x, kind.elementType), F.lit(0)) + 16)
        if isinstance(kind, StructType):
            parts = [x for f in kind.fields if (x := size(c[f.name], f.dataType)) is not None]
            return reduce(lambda a, b: a + b, [F.coalesce(x, F.lit(0)) for x in parts]) if parts else None
        return None

    parts = [x for f in df.schema.fields if (x := size(col(f.name), f.dataType)) is not None]
    each = reduce(lambda a, b: a + b, [F.coalesce(x, F.lit(0)).cast("long") for x in parts], F.lit(ROW_BYTES).cast("long"))
    return df.agg(F.sum(each)).first()[0] or 0


def joined(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], how: str = "left", limit: int = BROADCAST_BYTES, size: int | None = None) -> DataFrame:
    """left joined to a right side with one row a key, null-safe; the right side's keys are dropped.

    The right side's bytes are summed first (pass a checkpointed one, or its size): up to `limit` it is broadcast and
    `left` does not move. Beyond that both sides are dealt out by key; a key of `left` that is hot is split over tasks
    by the adaptive skew join, against the one row of the right side, which is not repeated for other keys.
    """
    small = (n_bytes(right) if size is None else size) <= limit
    ours = [k for _, k in keys]
    right = right.select(*[col(c).alias(f"__r_{c}") if c in ours else col(c) for c in right.columns])
    pairs = [(a, f"__r_{b}") for a, b in keys]
    right = F.broadcast(right) if small else right.hint("merge")
    return left.join(right, same(left, right, pairs), how).drop(*[b for _, b in pairs])

"""From raw documents to packed training batches.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is what the next stage reads. All but the last
return the columns of documents: quality rules drop what they reject, near-duplicates (a similarity of 0.8 or more
in five-word shingles) keep one document of a group, decontamination drops contaminated documents, secret scans replace
live-looking credentials in the text (and count n_chars anew), and packing returns one row a segment with its batch.

Defined results: null and empty texts fail the quality rules; null ids, languages and sources are values like any other;
of repeated rows, and of copies of one id, one stays; among ties the smallest id stays; an empty table, or one that a
stage leaves nothing of, gives an empty result with the same columns; extra columns, whatever their names, pass through
to packing, which returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rasterweave.llm import decontaminate, packing, quality, secrets, simhash
from rasterweave.llm.common import remove, scratch, swept
from rasterweave.shipping import ship

def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    swept(spark)  # the stage before is written
    return simhash.deduplicated(docs, size=simhash.WIDE_SHINGLE, distance=simhash.WIDE_DISTANCE, wide=True)


STAGES = [
    ("quality rules", lambda spark, docs, sf_dir: quality.keep(docs)),
    ("near-duplicates", _near_duplicates),
    ("benchmark decontamination", lambda spark, docs, sf_dir: decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))),
    ("secret scans", lambda spark, docs, sf_dir: secrets.redacted(docs)),
    ("packing", lambda spark, docs, sf_dir: packing.pack(docs)),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents. Each result is a Parquet table in the shared checkpoint folder, so a lost executor
    or a later stage never goes back further than that; it is removed once the next one is written."""
    ship(spark)
    at = scratch(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
        if before:
            remove(spark, before)
        before = f"{at}/{k}"
    swept(spark)
    return STAGES[-1][1](spark, docs, sf_dir)

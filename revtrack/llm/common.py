"""What several operators share: word patterns, hash-based splits, worker caches, batch sizes."""

from __future__ import annotations

import sys
import types

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage

__all__ = ["WORD", "configure_batches", "crc_remainder", "rows_of", "stage", "word_count", "worker_cache"]

# A word: what stands between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

# Rows of whole texts in one Arrow batch; a batch also ends at the byte limit.
BATCH_ROWS = 1_000
BATCH_BYTES = 16 << 20
# Rows that the parquet reader unpacks at a time: with Spark's 4,096, whole texts take arrays of many MB each.
READ_ROWS = 512


def configure_batches(spark: SparkSession) -> SparkSession:
    """Bound what one Python worker and one reader hold at a time, and drop shuffle files as soon as their statement is done.

    Results that are used again are stored tables (see `stage`), so nothing reads those files later.
    """
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))
    return spark


def rows_of(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def crc_remainder(id_col: Column, divisor: int) -> Column:
    """crc32 of the id's text modulo `divisor`; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % divisor


def word_count(text: Column) -> Column:
    """Number of words of a text as long; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def worker_cache(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, across its tasks, until a task asks for one of another name.

    Workers outlive queries and stages: what the one before has loaded, such as a tokenizer, is not held beside what is loaded next.
    """
    home = sys.modules.setdefault("_llm_worker_cache", types.ModuleType("_llm_worker_cache"))
    for other in [k for k in vars(home) if not k.startswith("__") and k != name]:
        delattr(home, other)
    return vars(home).setdefault(name, {})

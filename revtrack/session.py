"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Hot join keys are split at run time; partial aggregation covers the group-bys.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # What goes to a Python worker at once is bounded by size; bodies of pages may be long.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}

# For the session builder: recording the call site of every column operation makes large plans slow to build.
BUILDER_CONF = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every plan here relies on. Sizing stays with the cluster."""
    for key, value in _RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only for an unconfigured local session."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="revtrack-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_SCOPE = threading.local()


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete staged tables."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove what is staged inside when the block has ended well; after a failure it stays for a look."""
    outer, _SCOPE.paths = getattr(_SCOPE, "paths", None), []
    try:
        yield
        remove(spark, _SCOPE.paths)
    finally:
        _SCOPE.paths = outer


@contextmanager
def step(spark: SparkSession, past: list[str]) -> Iterator[None]:
    """A step of a chain whose results are written before the next one starts: removes what the step before has staged
    (`past`) and notes there what this one stages, which its result may still read."""
    remove(spark, past)
    past.clear()
    outer, _SCOPE.paths = getattr(_SCOPE, "paths", None), past
    try:
        yield
    finally:
        _SCOPE.paths = outer


def stage(df: DataFrame, keep: bool = False) -> DataFrame:
    """Write `df` to the shared folder and read it back; `keep` lets it outlive a `scratch` or `step` block.

    A parquet table rather than `checkpoint()`: it survives lost executors the same way, but the
    reader can prune columns and AQE knows its size.
    """
    return stage_at(df, keep)[0]


def stage_at(df: DataFrame, keep: bool = False) -> tuple[DataFrame, str]:
    """As `stage`, with the table's path, for `remove`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/revtrack/{uuid.uuid4().hex}"
    if not keep and getattr(_SCOPE, "paths", None) is not None:
        _SCOPE.paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path

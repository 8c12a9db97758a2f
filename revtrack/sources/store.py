"""The store: append-only parquet datasets, one directory per batch and writer, visible once committed.

A batch writes only what it adds, into directories named after it and its writer. It becomes visible by its commit, one
small file that is created last and only if no other writer has taken the number since: then the batch was planned
on a store that is no longer the latest, `CommitConflict` is raised, and it is planned again (`replanned`). A commit may name
the run it stems from (a stream and its micro-batch), by which a repeated run is recognised, and holds the
last id of each table. Changes of a document's item type are rows of their own and merged in on reading.

What a batch is matched by (titles, urls, types, version days) is also kept in narrow tables in directories by the hash of the key,
so a batch reads the directories that its own keys fall into, not the whole store.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import wraps
from datetime import datetime

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.quality import add_missing_columns
from ..schemas import ADDED_COLUMNS, STORE

_TITLE_KEY = T.StructField("norm_title", T.StringType())
_TYPE_CHANGES = T.StructType(
    [
        T.StructField("guideline_id", T.LongType()),
        T.StructField("item_type", T.StringType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)
_PAGE_ERRORS = T.StructType(
    [
        T.StructField("config_id", T.LongType()),
        T.StructField("crawl_id", T.StringType()),
        T.StructField("agency_code", T.StringType()),
        T.StructField("page_num", T.IntegerType()),
        T.StructField("url", T.StringType()),
        T.StructField("fetched_at", T.TimestampType()),
        T.StructField("error", T.StringType()),
    ]
)
_TITLES = T.StructType([T.StructField("agency_id", T.LongType()), T.StructField("norm_title", T.StringType()), T.StructField("id", T.LongType())])
_URLS = T.StructType([T.StructField("agency_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("id", T.LongType())])
_KINDS = T.StructType([T.StructField("guideline_id", T.LongType()), T.StructField("item_type", T.StringType())])
_DAYS = T.StructType([T.StructField("guideline_id", T.LongType()), T.StructField("published_date", T.DateType())])
# Datasets beside the tables: changes merged in on reading, pages that no config owns, and the narrow tables.
_OWN = {"guideline_types": _TYPE_CHANGES, "page_errors": _PAGE_ERRORS, "key_titles": _TITLES, "key_urls": _URLS, "key_types": _KINDS, "key_days": _DAYS}
# What directories go by. The number of directories is fixed for a store's life.
BUCKETS = 64
_BUCKETED = {"guideline_types": ["guideline_id"], "key_titles": ["agency_id", "norm_title"], "key_urls": ["agency_id", "url"], "key_types": ["guideline_id"], "key_days": ["guideline_id"]}
_COMMIT = "batch long, by string, committed_at string, source string, source_batch long, last_ids map<string,bigint>"
_RUNS = "source string, source_batch long"
ATTEMPTS = 5


class CommitConflict(RuntimeError):
    """Another writer has committed since this batch was planned."""


def replanned(fn: Callable) -> Callable:
    """Let `fn(store, ...)` plan and write its batch again when another writer was first."""

    @wraps(fn)
    def run(store: Store, *args, **named):
        for attempt in range(1, ATTEMPTS + 1):
            try:
                return fn(store, *args, **named)
            except CommitConflict:
                if attempt == ATTEMPTS:
                    raise

    return run


def bucket_of(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


@dataclass
class Stored:
    """What a batch is matched against: the stored rows that its keys may meet, as of one commit."""

    by_title: Callable[[DataFrame], DataFrame]  # rows with agency_id, norm_title -> agency_id, norm_title, id
    by_url: Callable[[DataFrame], DataFrame]  # rows with agency_id, url -> agency_id, url, id
    days: Callable[[DataFrame], DataFrame]  # rows with guideline_id -> guideline_id, published_date
    types: Callable[[DataFrame], DataFrame]  # rows with guideline_id -> guideline_id, stored_type


# Who wrote a batch: the name of a stream or job and its own running number.
Run = tuple[str, int]


def read_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A store table kept as plain parquet, with its fixed schema; files of older layouts are completed."""
    stored = spark.read.schema(STORE[name]).parquet(path)
    return add_missing_columns(stored, STORE[name], ADDED_COLUMNS.get(name, {}))


class Store:
    """Tables under one root. Documents carry their title key, so a batch need not recompute it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._known: tuple[list[str], list] = ([], [])
        self._begin()

    def _begin(self) -> None:
        self._by, self._written = f"w{uuid.uuid4().hex}", {}

    # ---- commits

    def _commits(self) -> list:
        """One row per batch; read again only when there is a new one."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/_commits")
        files = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = sorted(f.getPath().getName() for f in files.listStatus(where)) if files.exists(where) else []
        names = [n for n in names if n.endswith(".json")]
        if names != self._known[0]:
            rows = self.spark.read.schema(_COMMIT).json([f"{self.root}/_commits/{n}" for n in names]).collect()
            self._known = (names, sorted(rows, key=lambda r: r.batch))
        return self._known[1]

    def last_batch(self) -> int:
        """The last committed batch, -1 for an empty store."""
        return max((r.batch for r in self._commits()), default=-1)

    def holds(self, run: Run) -> bool:
        if any((r.source, r.source_batch) == tuple(run) for r in self._commits()):
            return True
        return not self._old_runs().where((F.col("source") == run[0]) & (F.col("source_batch") == run[1])).isEmpty()

    def _old_runs(self) -> DataFrame:
        return self._read(f"{self.root}/_runs", _RUNS)

    def last_id(self, name: str, last: int | None = None) -> int:
        """The largest id of a table as of batch `last`, from the commits."""
        return max((r.last_ids.get(name, 0) for r in self._commits() if last is None or r.batch <= last), default=0)

    def commit(self, batch: int, at: datetime, run: Run | None = None) -> None:
        """Make the batch visible, or raise `CommitConflict` when there is a batch of that number already."""
        ids = {}
        for name, (path, schema) in self._written.items():
            if name in STORE and "id" in schema.names:
                ids[name] = self.spark.read.schema(schema).parquet(path).agg(F.max("id")).first()[0] or 0
        source, number = run or (None, None)
        row = {"batch": batch, "by": self._by, "committed_at": at.isoformat(), "source": source, "source_batch": number, "last_ids": ids}
        by = self._by
        self._begin()
        self._create(f"{self.root}/_commits/{batch:012d}.json", f".{batch}-{by}", json.dumps(row))

    def _create(self, path: str, draft: str, text: str) -> None:
        """Create a file with its whole content, only if there is none; files appear by a rename that never replaces."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        fs = jvm.org.apache.hadoop.fs
        files = fs.Path(path).getFileSystem(conf)
        goal = files.makeQualified(fs.Path(path))
        temporary = fs.Path(goal.getParent(), draft)
        out = files.create(temporary, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        how = self.spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0)
        try:
            fs.FileContext.getFileContext(goal.toUri(), conf).rename(temporary, goal, how)
        except Py4JJavaError as exc:
            files.delete(temporary, False)
            if "FileAlreadyExists" in exc.java_exception.getClass().getName():
                raise CommitConflict(path) from None
            raise

    # ---- reading

    def _schema(self, name: str) -> T.StructType:
        if name in _OWN:
            return _OWN[name]
        schema = STORE[name]
        return T.StructType([*schema.fields, _TITLE_KEY]) if name == "guidelines" else schema

    def _read(self, path: str, schema: T.StructType | str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _batches(self, name: str, last: int) -> DataFrame:
        """Rows of the batches up to `last`, with their batch and, where there are any, buckets; the filters prune directories."""
        places = [T.StructField("batch", T.LongType()), T.StructField("by", T.StringType())]
        if name in _BUCKETED:
            places.append(T.StructField("bucket", T.IntegerType()))
        writers = [r.by for r in self._commits() if r.batch <= last]
        rows = self._read(f"{self.root}/{name}", T.StructType([*self._schema(name).fields, *places]))
        return rows.where((F.col("batch") <= last) & F.col("by").isin(writers)).drop("by")

    def _now(self, last: int | None) -> int:
        return self.last_batch() if last is None else last

    def read(self, name: str, last: int | None = None) -> DataFrame:
        """A table as of batch `last`, by default the last committed one."""
        last = self._now(last)
        rows = add_missing_columns(self._batches(name, last).drop("batch", "bucket"), self._schema(name), ADDED_COLUMNS.get(name, {}))
        if name != "guidelines":
            return rows
        latest = F.max_by(F.struct("item_type", "updated_at"), "batch").alias("_change")
        changes = self._batches("guideline_types", last).groupBy(F.col("guideline_id").alias("id")).agg(latest)
        return (
            rows.join(changes, "id", "left")
            .withColumn("item_type", F.coalesce("_change.item_type", "item_type"))
            .withColumn("updated_at", F.coalesce("_change.updated_at", "updated_at"))
            .select(*rows.columns)
        )

    def stored(self, last: int | None = None) -> Stored:
        """The narrow tables as of batch `last`, each read in the directories that the keys asked for fall into."""
        last = self._now(last)

        def met(name: str, keys: DataFrame) -> DataFrame:
            # At most BUCKETS numbers.
            asked = [r[0] for r in keys.select(bucket_of(_BUCKETED[name])).distinct().collect()]
            return self._batches(name, last).where(F.col("bucket").isin(asked)).drop("bucket")

        def types(keys: DataFrame) -> DataFrame:
            first = met("key_types", keys).withColumn("batch", F.lit(-1).cast("bigint"))
            rows = first.unionByName(met("guideline_types", keys).select(*first.columns))
            return rows.groupBy("guideline_id").agg(F.max_by("item_type", "batch").alias("stored_type"))

        return Stored(
            lambda keys: met("key_titles", keys).drop("batch"), lambda keys: met("key_urls", keys).drop("batch"), lambda keys: met("key_days", keys).drop("batch"), types
        )

    # ---- writing

    def write(self, name: str, rows: DataFrame, batch: int) -> DataFrame:
        """Write a batch's rows of one table, invisible until `commit`; returns them as written."""
        rows = add_missing_columns(rows, self._schema(name), {})
        path = f"{self.root}/{name}/batch={batch}/by={self._by}"
        if name in _BUCKETED:
            keyed = rows.withColumn("bucket", bucket_of(_BUCKETED[name])).repartition("bucket")
            keyed.write.mode("overwrite").partitionBy("bucket").parquet(path)
        else:
            rows.write.mode("overwrite").parquet(path)
        self._written[name] = (path, rows.schema)
        written = self.spark.read.schema(rows.schema).parquet(path)
        if name == "guidelines":
            self.write("key_titles", written.select("agency_id", "norm_title", "id"), batch)
            self.write("key_urls", written.where(F.coalesce("source_url", F.lit("")) != "").select("agency_id", F.col("source_url").alias("url"), "id"), batch)
            self.write("key_types", written.select(F.col("id").alias("guideline_id"), "item_type"), batch)
        if name == "guideline_versions":
            self.write("key_days", written.select("guideline_id", "published_date"), batch)
        return written

    def compact(self, root: str, at: datetime) -> Store:
        """The current state as batch 0 of a new store at `root`, which still knows every run this one holds.

        Leftovers of batches that were never committed stay behind.
        """
        target = Store(self.spark, root)
        for name in (*STORE, "page_errors"):
            target.write(name, self.read(name), 0)
        own = self.spark.createDataFrame([(r.source, r.source_batch) for r in self._commits() if r.source is not None], _RUNS)
        self._old_runs().union(own).distinct().write.mode("overwrite").parquet(f"{target.root}/_runs")
        target.commit(0, at)
        return target

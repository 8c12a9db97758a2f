"""First, latest and top rows of a key.

`row_number() <= n` right above its window lets Spark drop rows beyond n per key before the shuffle, so a
key that holds a large part of the input sends n rows per task, not the whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], n: int) -> DataFrame:
    by = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(by)).where(F.col("_rank") <= n).drop("_rank")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    return top_per_key(df, keys, order, 1)


def latest_run_per_config(runs: DataFrame) -> DataFrame:
    """Latest run of each config; of runs that started together the first by id stays."""
    return first_per_key(runs.where(F.col("config_id").isNotNull()), ["config_id"], [F.desc("started_at"), F.asc("id")])


def latest_run_per_agency(runs: DataFrame) -> DataFrame:
    return first_per_key(runs, ["agency_id"], [F.desc("started_at"), F.desc("id")])


def first_per_url(items: DataFrame, scope: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """First item of each url; items without a url are all kept."""
    apart = F.when(F.coalesce(F.col("url"), F.lit("")) == "", F.struct(*[F.col(c) for c in order if isinstance(c, str)]))
    return first_per_key(items.withColumn("_apart", apart), [*scope, "url", "_apart"], order).drop("_apart")

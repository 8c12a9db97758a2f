"""Table contracts (V1-V4): each check yields rows only where the contract is broken."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import DOMAINS, FOREIGN_KEYS, MAX_LENGTHS, STORE, UNIQUE_KEYS


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str = "id") -> DataFrame:
    """Foreign key values without a parent, and how many rows carry each.

    The key is counted first, so a value that most rows share crosses the network once per task.
    """
    used = child.where(F.col(fk).isNotNull()).groupBy(fk).agg(F.count("*").alias("n"))
    return used.join(parent.select(F.col(pk).alias(fk)), fk, "left_anti")


def outside_domain(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    return df.where(~F.col(column).isin(*allowed)).groupBy(column).agg(F.count("*").alias("n"))


def column_faults(df: DataFrame, required: Sequence[str], lengths: Mapping[str, int]) -> DataFrame:
    """Rows per fault in one pass: `column, fault, n` for nulls and overlong texts."""
    counts = [F.count_if(F.col(c).isNull()).alias(f"null:{c}") for c in required]
    counts += [F.count_if(F.length(c) > n).alias(f"long:{c}") for c, n in lengths.items()]
    totals = df.agg(*counts)
    faults = F.array(
        *[
            F.struct(F.lit(name.split(":", 1)[1]).alias("column"), F.lit("null" if name.startswith("null") else "too long").alias("fault"), F.col(f"`{name}`").alias("n"))
            for name in totals.columns
        ]
    )
    return totals.select(F.explode(faults).alias("f")).select("f.*").where("n > 0")


def check_store(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Every contract of the given store tables: `table_name, contract, detail, n`."""
    out = []

    def add(table: str, contract: str, rows: DataFrame, detail) -> None:
        out.append(rows.select(F.lit(table).alias("table_name"), F.lit(contract).alias("contract"), detail.alias("detail"), F.col("n").cast("bigint").alias("n")))

    for name, df in tables.items():
        for key in UNIQUE_KEYS.get(name, ()):
            add(name, "unique " + ",".join(key), duplicate_keys(df, key), F.concat_ws(",", *[F.col(c).cast("string") for c in key]))
        for column, allowed in DOMAINS.get(name, {}).items():
            add(name, "domain " + column, outside_domain(df, column, allowed), F.col(column))
        required = [f.name for f in STORE[name].fields if not f.nullable]
        add(name, "columns", column_faults(df, required, MAX_LENGTHS.get(name, {})), F.concat_ws(" ", "column", "fault"))
    for child, fk, parent in FOREIGN_KEYS:
        if child in tables and parent in tables:
            add(child, "foreign key " + fk, orphans(tables[child], fk, tables[parent]), F.col(fk).cast("string"))
    return reduce(DataFrame.unionByName, out)


def add_missing_columns(df: DataFrame, schema: T.StructType, defaults: Mapping[str, str]) -> DataFrame:
    """Rows of an older layout in the current one; added columns take their default."""
    cols = []
    for field in schema.fields:
        value = F.col(field.name) if field.name in df.columns else F.lit(None).cast(field.dataType)
        if field.name in defaults:
            value = F.coalesce(value, F.lit(defaults[field.name]))
        cols.append(value.alias(field.name))
    return df.select(*cols)

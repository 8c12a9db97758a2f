"""Manifest export."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.text import iso_timestamp
from ..operators.lookups import with_agency

_KEEP_NULLS = {"ignoreNullFields": "false"}


def _url(path: str):
    return F.concat(F.lit(f"/{path}?agency_code="), F.col("agency_code"))


def manifest_bases(bases: DataFrame, agencies: DataFrame) -> DataFrame:
    return with_agency(bases, agencies).select(
        "id", "title", "basis_type", "agency_code", "agency_name", "parent_law_name", _url("legal-bases").alias("url")
    )


def manifest_guidelines(guidelines: DataFrame, agencies: DataFrame) -> DataFrame:
    """`latest_published_date` is always null in this schema version."""
    return with_agency(guidelines, agencies).select(
        "id", "title", "category", "agency_code", "agency_name", F.lit(None).cast("date").alias("latest_published_date"),
        _url("guidelines").alias("url"),
    )


def manifest_header(bases: DataFrame, guidelines: DataFrame, generated_at: datetime) -> DataFrame:
    """One row: version, time, lifetime and the two counts."""
    counted = bases.select(F.lit(1).alias("b"), F.lit(0).alias("g")).unionByName(guidelines.select(F.lit(0).alias("b"), F.lit(1).alias("g")))
    total = F.lit(0).cast("bigint")
    return (
        counted.agg(F.coalesce(F.sum("b"), total).alias("legal_bases"), F.coalesce(F.sum("g"), total).alias("guidelines"))
        .select(
            F.lit(fv.MANIFEST_SCHEMA_VERSION).alias("schema_version"),
            iso_timestamp(F.lit(generated_at)).alias("generated_at"),
            F.lit(fv.MANIFEST_TTL_HOURS).alias("ttl_hours"),
            "legal_bases",
            "guidelines",
        )
    )


def manifest_document(bases: DataFrame, guidelines: DataFrame, agencies: DataFrame, generated_at: datetime) -> DataFrame:
    """The single JSON document as ordered lines `(section, id, line)`.

    Read in order the lines are one valid document, so it can be written by many tasks and never has to
    exist as one value.
    """

    def lines(df: DataFrame, section: int) -> DataFrame:
        glue = F.when(F.col("id") == df.agg(F.min("id")).scalar(), "").otherwise(",")
        return df.select(
            F.lit(section).alias("section"), "id", F.concat(glue, F.to_json(F.struct(*df.columns), _KEEP_NULLS)).alias("line")
        )

    spark = bases.sparkSession
    head = F.concat(
        F.lit(f'{{"schema_version":"{fv.MANIFEST_SCHEMA_VERSION}","generated_at":"'),
        iso_timestamp(F.lit(generated_at)),
        F.lit(f'","ttl_hours":{fv.MANIFEST_TTL_HOURS},"legal_bases":['),
    )
    frame = spark.range(3).select(
        F.element_at(F.array(F.lit(0), F.lit(2), F.lit(4)), F.col("id").cast("int") + 1).alias("section"),
        F.lit(None).cast("bigint").alias("id"),
        F.when(F.col("id") == 0, head).when(F.col("id") == 1, F.lit('],"guidelines":[')).otherwise(F.lit("]}")).alias("line"),
    )
    rows = lines(manifest_bases(bases, agencies), 1).unionByName(lines(manifest_guidelines(guidelines, agencies), 3))
    return rows.unionByName(frame).orderBy("section", "id")


def write_manifest(bases: DataFrame, guidelines: DataFrame, agencies: DataFrame, generated_at: datetime, path: str) -> DataFrame:
    """Write header, the two row sets as JSON lines, and the one document; returns the header."""
    header = manifest_header(bases, guidelines, generated_at)
    header.write.mode("overwrite").json(f"{path}/header")
    options = {"ignoreNullFields": "false"}
    manifest_bases(bases, agencies).write.mode("overwrite").options(**options).json(f"{path}/legal_bases")
    manifest_guidelines(guidelines, agencies).write.mode("overwrite").options(**options).json(f"{path}/guidelines")
    manifest_document(bases, guidelines, agencies, generated_at).select("line").write.mode("overwrite").text(f"{path}/document")
    return header

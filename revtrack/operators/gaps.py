"""Gaps between mandates and documents, and amended legal bases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_title
from .lookups import last_owner
from .revisions import version_totals


def missing_mandates(mandates: DataFrame, guidelines: DataFrame) -> DataFrame:
    """Mandates no document refers to."""
    served = guidelines.where(F.col("mandate_id").isNotNull()).select(F.col("mandate_id").alias("id")).distinct()
    return mandates.join(served, "id", "left_anti")


def gaps(mandates: DataFrame, bases: DataFrame, guidelines: DataFrame, versions: DataFrame) -> DataFrame:
    """One row per mandate and document: missing, outdated (with the days between), or resolved.

    A basis counts as amended on its promulgation date; unknown dates never make a row outdated.
    """
    amended = bases.select(F.col("id").alias("legal_basis_id"), F.col("promulgation_date").alias("basis_last_amended"))
    last = version_totals(versions).select("guideline_id", F.col("latest_published_date").alias("guideline_last_updated"))
    served = (
        guidelines.where(F.col("mandate_id").isNotNull())
        .select("mandate_id", F.col("id").alias("guideline_id"))
        .join(last, "guideline_id", "left")
    )
    asked = mandates.select(F.col("id").alias("mandate_id"), "legal_basis_id").join(amended, "legal_basis_id", "left")
    late = F.datediff("basis_last_amended", "guideline_last_updated")
    met = asked.join(served, "mandate_id").select(
        "mandate_id", "guideline_id", F.when(late > 0, "outdated").otherwise("resolved").alias("status"),
        "basis_last_amended", "guideline_last_updated", F.when(late > 0, late).alias("days_gap"),
    )
    missing = missing_mandates(asked.withColumnRenamed("mandate_id", "id"), guidelines).select(
        F.col("id").alias("mandate_id"), F.lit("missing").alias("status"), "basis_last_amended"
    )
    return met.unionByName(missing, allowMissingColumns=True)


def amended_bases(bases: DataFrame, rules: DataFrame) -> DataFrame:
    """Stored bases with a law id, the newest promulgation found for it and whether that is later."""
    newest = (
        rules.where(F.coalesce("law_api_id", F.lit("")) != "")
        .groupBy("law_api_id")
        .agg(F.max("promulgation_date").alias("latest_promulgation_date"))
    )
    return (
        bases.where(F.col("law_api_id").isNotNull())
        .select("id", "law_api_id", "promulgation_date")
        .join(newest, "law_api_id", "left")
        .withColumn("amended", F.coalesce(F.col("latest_promulgation_date") > F.col("promulgation_date"), F.lit(False)))
    )


def amendment_tally(amended: DataFrame) -> DataFrame:
    return amended.agg(F.count("*").alias("checked"), F.count_if("amended").alias("updates_found"))


def match_mandates(mandates: DataFrame, bases: DataFrame, guidelines: DataFrame) -> DataFrame:
    """Mandates with the document of their agency that bears the expected title, by title key.

    As in the merge, the largest id stands for documents that share a key, so a mandate matches at
    most one document and a key many documents share does not multiply rows.
    """
    agency = bases.select(F.col("id").alias("legal_basis_id"), "agency_id")
    wanted = (
        mandates.where(F.col("expected_guideline_title").isNotNull())
        .join(agency, "legal_basis_id")
        .select(
            F.col("id").alias("mandate_id"), "agency_id",
            normalize_title(F.col("expected_guideline_title")).alias("norm_title"),
        )
    )
    titled = last_owner(guidelines.withColumn("norm_title", normalize_title(F.col("title"))), ["agency_id", "norm_title"])
    return wanted.join(titled, ["agency_id", "norm_title"])

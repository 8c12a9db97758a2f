"""Reports over the store (Q1-Q11, Q14-Q16).

Each report is one declarative plan over store tables given as DataFrames. `as_of` is always an argument,
so a report over the same tables always gives the same rows.
"""

from __future__ import annotations

import re
from datetime import date, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.text import iso_date
from ..operators.lookups import with_count
from ..operators.pick import latest_run_per_agency, latest_run_per_config, top_per_key
from ..operators.revisions import change_type, edition_days, version_totals
from ..session import stage


def _agencies(agencies: DataFrame) -> DataFrame:
    return agencies.select(F.col("id").alias("agency_id"), F.col("code").alias("agency_code"), F.col("short_name").alias("agency_name"))


def _search(q: str) -> Column:
    # `%` and `_` are wildcards; a backslash that escapes neither stands for nothing, as in lookups.
    pattern = "%" + re.sub(r"\\(?![%_\\])", "", q.strip()) + "%"
    return F.col("title").ilike(pattern) | F.col("agency_name").ilike(pattern)


def _with_children(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Left join to child rows as an inner join plus the parents without any.

    Spark can split a parent with very many children in an inner join, not on the right of an outer one.
    """
    childless = parents.join(children.select(key).distinct(), key, "left_anti")
    return parents.join(children, key).unionByName(childless, allowMissingColumns=True)


def one_row(*aggregates: DataFrame) -> DataFrame:
    """Global aggregates side by side: their rows stacked, and the one value of each column kept."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), aggregates)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


# ---- documents --------------------------------------------------------------------------------


def list_guidelines(
    guidelines: DataFrame,
    agencies: DataFrame,
    versions: DataFrame,
    agency_code: str | None = None,
    category: str | None = None,
    item_type: str | None = None,
    q: str | None = None,
    sort_by: str = "title",
) -> DataFrame:
    """Documents with latest date and version count (Q1)."""
    out = guidelines.join(_agencies(agencies), "agency_id")
    if agency_code:
        out = out.where(F.col("agency_code") == agency_code.upper())
    if category:
        out = out.where(F.col("category") == category)
    if item_type:
        out = out.where(F.col("item_type") == item_type)
    if q:
        out = out.where(_search(q))
    if agency_code or category or item_type or q:
        # Only the history of the documents asked for is added up.
        versions = versions.join(out.select(F.col("id").alias("guideline_id")), "guideline_id", "left_semi")
    totals = version_totals(versions).withColumnRenamed("guideline_id", "id")
    out = (
        out.join(totals, "id", "left")
        .withColumn("version_count", F.coalesce("version_count", F.lit(0).cast("bigint")))
        .select(*guidelines.columns, "latest_published_date", "version_count")
    )
    order = {"latest_date": [F.desc_nulls_last("latest_published_date")], "version_count": [F.desc("version_count")]}
    return out.orderBy(*order.get(sort_by, []), "title", "id")


def guideline_detail(guidelines: DataFrame, versions: DataFrame, guideline_id: int | None = None) -> DataFrame:
    """A document with its versions, newest first, one row per version (Q2).

    A document without versions keeps one row. Without an id the report covers every document.
    """
    if guideline_id is not None:
        guidelines = guidelines.where(F.col("id") == guideline_id)
        versions = versions.where(F.col("guideline_id") == guideline_id)
    totals = version_totals(versions).withColumnRenamed("guideline_id", "id")
    history = versions.select(
        F.col("guideline_id").alias("id"), F.col("id").alias("version_id"), "version_label", "published_date",
        F.col("pdf_url").alias("version_pdf_url"), "page_count", "change_summary", "significance",
    )
    documents = guidelines.join(totals, "id", "left").withColumn("version_count", F.coalesce("version_count", F.lit(0).cast("bigint")))
    out = documents.select(*guidelines.columns, "version_count", "latest_published_date")
    return _with_children(out, history, "id").orderBy("id", F.desc("published_date"), F.desc("version_id"))


def recent_changes(
    versions: DataFrame,
    guidelines: DataFrame,
    agencies: DataFrame,
    as_of: date,
    days: int = 30,
    agency_code: str | None = None,
    item_type: str | None = "guideline",
    limit: int | None = 50,
) -> DataFrame:
    """New documents and meaningful revisions of the last `days` days (Q3).

    The page of `limit` versions is taken before re-postings are dropped, so fewer rows may come back.
    The page is staged: it is small, and histories are then read for its documents only. Without a
    limit every version in the window is judged against the full history.
    """
    documents = guidelines.select(F.col("id").alias("guideline_id"), "agency_id", "title", "category", "item_type")
    if item_type:
        documents = documents.where(F.col("item_type") == item_type)
    owners = _agencies(agencies)
    if agency_code:
        owners = owners.where(F.col("agency_code") == agency_code.upper())
    recent = (
        versions.where(F.col("published_date") >= F.date_sub(F.lit(as_of), days))
        .select("id", "guideline_id", "version_label", "published_date", "detected_at")
        .join(documents, "guideline_id")
        .join(owners, "agency_id")
    )
    history = versions
    if limit is not None:
        recent = stage(recent.orderBy(F.desc("published_date"), F.desc("id")).limit(limit))
        history = versions.join(recent.select("guideline_id").distinct(), "guideline_id", "left_semi")
    out = (
        recent.join(edition_days(history), ["guideline_id", "published_date"])
        .withColumn("change_type", change_type())
        .where(F.col("change_type").isNotNull())
        .select(
            "guideline_id", "title", "agency_code", "agency_name", "category", "change_type", "version_label", "published_date",
            "previous_published_date", "previous_version_label", "detected_at", "version_count", "id",
        )
    )
    return out.orderBy(F.desc("published_date"), F.desc("id")).drop("id")


def recently_updated(versions: DataFrame, as_of: date, days: int = fv.RECENT_DAYS) -> DataFrame:
    """How many documents have a version published in the last `days` days (Q16)."""
    return versions.where(F.col("published_date") >= F.date_sub(F.lit(as_of), days)).agg(
        F.countDistinct("guideline_id").alias("recently_updated_count")
    )


# ---- legal bases ------------------------------------------------------------------------------


def list_legal_bases(
    bases: DataFrame,
    mandates: DataFrame,
    agencies: DataFrame | None = None,
    agency_code: str | None = None,
    basis_type: str | None = None,
) -> DataFrame:
    """Legal bases with their number of mandates (Q4)."""
    if agency_code:
        wanted = agencies.where(F.col("code") == agency_code.upper()).select(F.col("id").alias("agency_id"))
        bases = bases.join(wanted, "agency_id", "left_semi")
    if basis_type:
        bases = bases.where(F.col("basis_type") == basis_type)
    if agency_code or basis_type:
        mandates = mandates.join(bases.select(F.col("id").alias("legal_basis_id")), "legal_basis_id", "left_semi")
    counts = mandates.groupBy(F.col("legal_basis_id").alias("id")).agg(F.count("*").alias("mandate_count"))
    return with_count(bases, counts, "id", "mandate_count").select(*bases.columns, "mandate_count").orderBy("title", "id")


def list_mandates(mandates: DataFrame, guidelines: DataFrame, basis_id: int | None = None) -> DataFrame:
    """Mandates of a basis, or all of them, with their number of documents (Q5)."""
    if basis_id is not None:
        mandates = mandates.where(F.col("legal_basis_id") == basis_id)
        guidelines = guidelines.join(mandates.select(F.col("id").alias("mandate_id")), "mandate_id", "left_semi")
    counts = (
        guidelines.where(F.col("mandate_id").isNotNull())
        .groupBy(F.col("mandate_id").alias("id"))
        .agg(F.count("*").alias("guideline_count"))
    )
    return with_count(mandates, counts, "id", "guideline_count").select(*mandates.columns, "guideline_count")


# ---- agencies and runs ------------------------------------------------------------------------


def list_agencies(agencies: DataFrame, configs: DataFrame) -> DataFrame:
    """Agencies with their configs, one row per config, agencies without configs once (Q6)."""
    own = configs.select(
        F.col("agency_id").alias("id"), F.col("id").alias("config_id"), "label", "source_type", "schedule", "url", "is_active", "item_type"
    )
    return _with_children(agencies, own, "id").orderBy("code", "config_id")


def recent_runs(agencies: DataFrame, runs: DataFrame, code: str | None = None, n: int = 10) -> DataFrame:
    """The `n` latest runs of an agency, or of each (Q6)."""
    if code is not None:
        agencies = agencies.where(F.col("code") == code.upper())
        runs = runs.join(agencies.select(F.col("id").alias("agency_id")), "agency_id", "left_semi")
    latest = top_per_key(runs, ["agency_id"], [F.desc("started_at"), F.desc("id")], n)
    return latest.join(_agencies(agencies), "agency_id").orderBy("agency_code", F.desc("started_at"), F.desc("id"))


def crawl_status(agencies: DataFrame, runs: DataFrame) -> DataFrame:
    """Latest run of every agency, nulls where it never ran (Q7)."""
    latest = latest_run_per_agency(runs).select(
        "agency_id", F.col("started_at").alias("last_run_at"), F.col("status").alias("last_status"), F.col("items_new").alias("last_items_new")
    )
    return _agencies(agencies).join(latest, "agency_id", "left").drop("agency_id").orderBy("agency_code")


def active_latest_runs(configs: DataFrame, runs: DataFrame) -> DataFrame:
    """Latest run of each active config, under the config's agency."""
    active = configs.where("is_active").select(F.col("id").alias("config_id"), F.col("agency_id").alias("owner_id"))
    latest = latest_run_per_config(runs).select("config_id", "started_at", "status", "items_found", "error_message")
    return latest.join(active, "config_id").withColumnRenamed("owner_id", "agency_id")


def run_totals(latest: DataFrame) -> DataFrame:
    """Per agency over its latest runs: last start, items found, successes, failures (A10)."""
    return latest.groupBy("agency_id").agg(
        F.max("started_at").alias("max_run_at"),
        F.sum(F.coalesce("items_found", F.lit(0))).alias("total_found"),
        F.count_if(F.col("status") == "success").alias("succeeded"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )


def failure_samples(latest: DataFrame, n: int = 2, chars: int = 40) -> DataFrame:
    """The first `n` failure messages per agency by config, cut and joined."""
    message = F.left(F.coalesce(F.nullif("error_message", F.lit("")), F.lit("unknown")), F.lit(chars))
    failed = latest.where(F.col("status") == "failed").select("agency_id", "config_id", message.alias("message"))
    first = top_per_key(failed, ["agency_id"], ["config_id"], n)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("config_id", "message"))), lambda x: x["message"])
    return first.groupBy("agency_id").agg(F.array_join(listed, ", ").alias("samples"))


def crawl_health(agencies: DataFrame, configs: DataFrame, runs: DataFrame, as_of: datetime) -> DataFrame:
    """Agencies whose collection needs attention, one row each (Q8).

    The latest runs - one row per config - are staged, so the run log is read once for both uses.
    """
    latest = stage(active_latest_runs(configs, runs))
    stale = F.col("max_run_at") < F.lit(as_of) - F.expr(f"INTERVAL {fv.STALE_DAYS} DAYS")
    issue = (
        F.when(F.col("max_run_at").isNull(), "never_crawled")
        .when(F.col("succeeded") == 0, "all_failed")
        .when(F.col("total_found") == 0, "zero_keyword_match")
        .when(stale, "stale")
    )
    detail = F.when(
        F.col("issue") == "all_failed", F.concat(F.lit(fv.HEALTH_DETAIL["all_failed"]), F.coalesce("samples", F.lit("")))
    )
    for name in ("never_crawled", "zero_keyword_match", "stale"):
        detail = detail.when(F.col("issue") == name, fv.HEALTH_DETAIL[name])
    return (
        _agencies(agencies)
        .join(run_totals(latest), "agency_id", "left")
        .join(failure_samples(latest), "agency_id", "left")
        .withColumn("issue", issue)
        .where(F.col("issue").isNotNull())
        .select(
            "agency_code", "agency_name", "issue", detail.alias("detail"), F.col("max_run_at").alias("latest_run_at"),
            F.when(F.col("issue") == "stale", F.col("total_found")).otherwise(F.lit(0).cast("bigint")).alias("items_collected"),
        )
        .orderBy("agency_code")
    )


def last_global_crawl(configs: DataFrame, runs: DataFrame) -> DataFrame:
    """Start of the last run of any active config."""
    active = configs.where("is_active").select(F.col("id").alias("config_id"))
    return runs.join(active, "config_id", "left_semi").agg(F.max("started_at").alias("last_global_crawl_at"))


def agency_summary(agencies: DataFrame, configs: DataFrame, bases: DataFrame, guidelines: DataFrame, runs: DataFrame) -> DataFrame:
    """Targets, bases, documents and last run per agency (Q9)."""

    def per_agency(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(F.col("agency_id").alias("id")).agg(F.count("*").alias(name))

    latest = latest_run_per_agency(runs).select(
        F.col("agency_id").alias("id"), F.col("started_at").alias("last_crawl_at"), F.col("status").alias("last_crawl_status"),
        F.col("items_new").alias("last_crawl_items"),
    )
    out = with_count(agencies, per_agency(configs, "crawl_target_count"), "id", "crawl_target_count")
    out = with_count(out, per_agency(bases, "legal_basis_count"), "id", "legal_basis_count")
    out = with_count(out, per_agency(guidelines, "guideline_count"), "id", "guideline_count")
    return (
        out.join(latest, "id", "left")
        .select(
            "code", "short_name", "name", "homepage_url", "crawl_target_count", "legal_basis_count", "guideline_count",
            "last_crawl_at", "last_crawl_status", "last_crawl_items",
        )
        .orderBy("code")
    )


# ---- dashboard --------------------------------------------------------------------------------


def dashboard_totals(
    agencies: DataFrame, bases: DataFrame, guidelines: DataFrame, versions: DataFrame, configs: DataFrame, runs: DataFrame, as_of: date
) -> DataFrame:
    """The dashboard's counters as one row (Q10); every table is read once."""
    one = agencies.agg(F.count("*").alias("agency_count"))
    base = bases.agg(
        F.count("*").alias("legal_basis_count"),
        *[F.count_if(F.col("basis_type") == t).alias(f"{t}_count") for t in fv.LEGAL_BASIS_TYPES.values()],
    )
    docs = guidelines.agg(
        F.count_if(F.col("item_type") == "guideline").alias("guideline_count"),
        F.count_if(F.col("item_type") == "announcement").alias("announcement_count"),
    )
    return (
        one_row(one, base, docs, recently_updated(versions, as_of), last_global_crawl(configs, runs))
        .withColumn("gap_missing", F.lit(0).cast("bigint"))
        .withColumn("gap_outdated", F.lit(0).cast("bigint"))
    )


def category_stats(guidelines: DataFrame) -> DataFrame:
    return guidelines.groupBy("category").agg(F.count("*").alias("n"))


def category_map(guidelines: DataFrame) -> DataFrame:
    """The distribution as one map; categories are a closed list."""
    pairs = F.collect_list(F.struct("category", "n"))
    return category_stats(guidelines).agg(F.map_from_entries(pairs).alias("category_stats"))


def latest_bases(bases: DataFrame, agencies: DataFrame, n: int = 10) -> DataFrame:
    """The `n` bases stored last (Q11).

    Bases without an agency do not count.
    """
    return (
        bases.join(_agencies(agencies), "agency_id")
        .orderBy(F.desc("created_at"), F.desc("id"))
        .limit(n)
        .select("id", "title", "basis_type", "agency_name", iso_date(F.col("promulgation_date")).alias("promulgation_date"), "created_at")
    )


def latest_versions(versions: DataFrame, guidelines: DataFrame, agencies: DataFrame, n: int = 10) -> DataFrame:
    """The `n` versions detected last (Q11); those without a document or agency do not count."""
    documents = guidelines.select(F.col("id").alias("guideline_id"), "agency_id", "title")
    return (
        versions.select("id", "guideline_id", "version_label", "published_date", "pdf_url", "detected_at")
        .join(documents, "guideline_id")
        .join(_agencies(agencies), "agency_id")
        .orderBy(F.desc("detected_at"), F.desc("id"))
        .limit(n)
        .select("id", "guideline_id", "title", "agency_name", "version_label", "published_date", "pdf_url", "detected_at")
    )


# ---- run results ------------------------------------------------------------------------------


def run_items(items: DataFrame) -> DataFrame:
    """Items of a run with the size of their attachment list (Q14)."""
    return items.select(
        "config_id", "seq", "title", "url", iso_date(F.col("published_date")).alias("published_date"),
        F.size("attachment_urls").alias("attachment_count"),
    )


def run_result(runs: DataFrame, configs: DataFrame, agencies: DataFrame) -> DataFrame:
    """One row per config of a run: success, counts, error (Q14, Q15)."""
    label = configs.select(F.col("id").alias("config_id"), "label")
    return (
        runs.join(label, "config_id")
        .join(_agencies(agencies), "agency_id")
        .select(
            "agency_code", F.col("label").alias("config_label"), F.col("error_message").isNull().alias("success"),
            F.col("items_found").alias("items_count"), "items_new", F.col("error_message").alias("error"),
        )
    )


def run_summary(result: DataFrame) -> DataFrame:
    """Totals of a run (Q15)."""
    return result.agg(F.count("*").alias("configs_run"), F.sum("items_count").cast("bigint").alias("total_items"))


def scheduled_configs(configs: DataFrame, agencies: DataFrame, schedule: str | None = None, agency_code: str | None = None) -> DataFrame:
    """Active configs of a schedule or of an agency."""
    out = configs.where("is_active").join(_agencies(agencies), "agency_id")
    if schedule:
        out = out.where(F.col("schedule") == schedule)
    if agency_code:
        out = out.where(F.col("agency_code") == agency_code.upper())
    return out

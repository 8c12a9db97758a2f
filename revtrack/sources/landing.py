"""Landed pages and their routing to an extractor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.elements import is_selector
from ..operators.quality import add_missing_columns
from ..schemas import RAW_PAGES
from .board import board_page
from .detail import detail_page
from .feed import feed_page
from .items import PAGE_TYPE, page
from .lawsearch import law_page
from .publications import publications_page
from .registry import detail_profiles, page_profiles

SELECTORS = ("list_selector", "title_selector", "link_selector", "date_selector")
ROUTES = ("publications", "detail", "rss", "bbs_list", "law_api")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RAW_PAGES).parquet(path)


def stream_pages(spark: SparkSession, path: str, max_files: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """Landed pages as a stream; a micro-batch takes at most `max_files` files, or files of `max_bytes` together, at least one."""
    reader = spark.readStream.schema(RAW_PAGES)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    elif max_bytes:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    return reader.parquet(path)


def routed_configs(configs: DataFrame, agencies: DataFrame, detail: DataFrame, publications: DataFrame) -> DataFrame:
    """Active configs with their agency, profiles and `route`; an unknown source type has no route.

    A profile is found by agency code and exact url and goes before the config's source type. Both
    profile tables are rows of a registry, so they stay far below the broadcast threshold.
    """
    detail_p = detail.select("agency_code", F.col("list_url").alias("url"), F.struct("*").alias("detail"))
    pubs_p = publications.select("agency_code", "url", F.struct("*").alias("publication"))
    route = (
        F.when(F.col("publication").isNotNull(), "publications")
        .when(F.col("detail").isNotNull(), "detail")
        .when(F.col("source_type").isin("rss", "bbs_list", "law_api"), F.col("source_type"))
    )
    own = agencies.select(F.col("id").alias("agency_id"), F.col("code").alias("agency_code"), F.col("name").alias("agency_name"))
    return (
        configs.where("is_active")
        .withColumnRenamed("id", "config_id")
        .join(own, "agency_id")
        .dropDuplicates(["config_id"])
        .join(pubs_p.dropDuplicates(["agency_code", "url"]), ["agency_code", "url"], "left")
        .join(detail_p.dropDuplicates(["agency_code", "url"]), ["agency_code", "url"], "left")
        .withColumn("route", route)
    )


def extract_pages(
    pages: DataFrame,
    configs: DataFrame,
    agencies: DataFrame,
    detail: DataFrame | None = None,
    publications: DataFrame | None = None,
) -> DataFrame:
    """One row per landed page: what it holds (`items`, `seen`) or why it failed (`error`).

    The landing table is read once; every route is a branch of one expression, so a body is parsed only
    by its own extractor. A selector of a config that cannot be read (see `elements.SELECTOR`) is an error, not the usual
    layout. Pages of an unknown config or agency come back with an error and no agency.
    """
    spark = pages.sparkSession
    # A landing without crawl ids has one crawl of a config per day.
    landed = add_missing_columns(pages, RAW_PAGES, {}).withColumn("crawl_id", F.coalesce("crawl_id", F.date_format("fetched_at", "yyyy-MM-dd")))
    detail = detail_profiles(spark) if detail is None else detail
    publications = page_profiles(spark) if publications is None else publications
    known = (
        routed_configs(configs, agencies, detail, publications)
        .withColumn("unread", F.coalesce(*(F.when(~is_selector(F.col(s)), F.col(s)) for s in SELECTORS)))
        .select(
            "config_id", "agency_id", "agency_name", "label", "item_type", "source_type", "route", "detail", "publication",
            "max_pages", *SELECTORS, "unread",
            F.coalesce("keyword_filter", F.array().cast("array<string>")).alias("keywords"),
        )
    )
    names = F.create_map(
        *[x for code, terms in fv.LAW_SEARCH_TERMS.items() for x in (F.lit(code), F.array(*[F.lit(t) for t in terms]))]
    )
    own = F.coalesce(F.try_element_at(names, F.col("agency_code")), F.array().cast("array<string>"))
    c, ok = F.col, F.col("http_status") == 200
    http_error = F.concat(F.lit("HTTP "), c("http_status").cast("string"))

    def failed(message: Column) -> Column:
        return page(F.lit(None).cast(PAGE_TYPE)["items"], F.lit(0), message)

    body = F.coalesce(c("body"), F.lit(""))
    # Bodies of other routes stay out of the Python workers.
    listed = (c("route") == "bbs_list") & ok & c("unread").isNull()
    found = (
        F.when(c("agency_id").isNull(), failed(F.concat(F.lit("no active config for "), c("agency_code"))))
        .when((c("route") == "bbs_list") & c("unread").isNotNull(), failed(F.concat(F.lit("Unknown selector: "), c("unread"))))
        .when(listed, board_page(F.when(listed, body), c("url"), c("keywords"), *(c(s) for s in SELECTORS)))
        .when((c("route") == "bbs_list") & (c("page_num") == 1), failed(F.concat(F.lit("Page 1 fetch failed: "), http_error)))
        .when(c("route") == "bbs_list", failed(F.lit(None)))
        .when((c("route") == "detail") & ok, detail_page(body, c("page_num"), c("keywords"), c("detail")))
        .when(c("route") == "detail", failed(F.lit(None)))
        .when(c("route") == "law_api", law_page(body, c("http_status"), own, F.when(c("page_num") > 0, F.try_element_at(own, c("page_num")))))
        .when(c("route").isNull(), failed(F.concat(F.lit("Unsupported source type: "), F.coalesce(c("source_type"), F.lit("none")))))
        .when(~ok, failed(http_error))
        .when(c("route") == "publications", publications_page(body, c("url"), c("keywords"), c("publication")))
        .when(c("route") == "rss", feed_page(body, c("keywords")))
    )
    return (
        landed.join(known, "config_id", "left")
        .withColumn("found", found.cast(PAGE_TYPE))
        .select(
            "config_id", "agency_id", "agency_code", "agency_name", "label", "item_type", "route", "page_num", "max_pages",
            "url", "http_status", "fetched_at", "crawl_id", "found.*",
        )
    )

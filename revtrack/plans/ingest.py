"""One ingest batch: landed pages -> posts -> merge -> runs."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.merge import TITLE, Merge, decide, with_ids
from ..operators.pick import first_per_key, top_per_key
from ..operators.scoring import Scorer, accept_items
from ..session import scratch, stage
from ..sources.board import followed
from ..sources.landing import extract_pages
from ..sources.store import Run, Store, replanned

LAW_ITEM_LIMIT = 50
# One visit of a config's source: it has its own frontier, failure, limit, clock and run.
CRAWL = ["config_id", "crawl_id"]
# Posts arrive crawl by crawl, within a crawl by page and position.
ARRIVAL = ("crawl_start", "config_id", "crawl_id", "seq")


@dataclass
class Batch:
    pages: DataFrame  # one row per page: items, seen, error
    items: DataFrame  # one row per post, in order of arrival within its crawl
    errors: DataFrame  # config_id, crawl_id, error: crawls that failed


def posts_of(pages: DataFrame, law_limit: int = LAW_ITEM_LIMIT) -> Batch:
    """Posts of extracted pages (see `extract_pages`): listings cut at their frontier, copies removed.

    A crawl with an error yields no posts; other crawls, also of the same config, are not affected.
    """
    pages = stage(pages)
    errors = (
        pages.where(F.col("error").isNotNull()).groupBy(*CRAWL).agg(F.min_by("error", "page_num").alias("error"))
    )
    clock = pages.groupBy(*CRAWL).agg(F.min("fetched_at").alias("crawl_start"), F.max("fetched_at").cast("date").alias("crawl_day"))
    listed = pages.where((F.col("route") == "bbs_list") & (F.col("page_num") <= F.col("max_pages")))
    read = followed(listed.withColumn("matched", F.size("items")), CRAWL).drop("matched")
    rest = pages.where(F.col("route") != "bbs_list")
    rows = (
        read.unionByName(rest)
        .join(errors.select(*CRAWL), CRAWL, "left_anti")
        .join(clock, CRAWL)
        .select(
            *CRAWL, "crawl_start", "crawl_day", "agency_id", "agency_code", "agency_name", "label", "item_type", "route", "page_num",
            F.posexplode("items").alias("pos", "item"),
        )
        .select("*", "item.*")
        .drop("item")
        .withColumn("seq", F.shiftleft(F.col("page_num").cast("bigint"), 32) + F.col("pos"))
    )
    # What makes two posts of a crawl the same: the url on boards, the serial in law searches.
    same = F.when((F.col("route") == "bbs_list") & (F.col("url") != ""), F.col("url")).when(
        (F.col("route") == "law_api") & (F.col("serial") != ""), F.col("serial")
    )
    once = (
        first_per_key(
            rows.withColumn("_same", same).withColumn("_apart", F.when(F.col("_same").isNull(), F.col("seq"))),
            [*CRAWL, "_same", "_apart"],
            ["seq"],
        )
        .drop("_same", "_apart", "serial", "pos")
    )
    law = F.col("route") == "law_api"
    items = once.where(~law).unionByName(top_per_key(once.where(law), CRAWL, ["seq"], law_limit))
    return Batch(pages, items, errors)


def run_rows(batch: Batch, tallies: DataFrame, as_of: datetime) -> DataFrame:
    """One run per crawl of the batch: status, times, items found and items that were new."""
    runs = (
        batch.pages.where(F.col("agency_id").isNotNull())
        .groupBy(*CRAWL, "agency_id")
        .agg(F.min("fetched_at").alias("started_at"), F.max("fetched_at").alias("finished_at"))
    )
    counts = tallies.select(*CRAWL, F.col("found").cast("int").alias("items_found"), (F.col("new") + F.col("updated")).cast("int").alias("items_new"))
    return (
        runs.join(counts, CRAWL, "left")
        .join(batch.errors, CRAWL, "left")
        .select(
            "agency_id",
            "config_id",
            F.when(F.col("error").isNull(), "success").otherwise("failed").alias("status"),
            "started_at",
            F.coalesce("finished_at", F.lit(as_of)).alias("finished_at"),
            F.coalesce("items_found", F.lit(0)).alias("items_found"),
            F.coalesce("items_new", F.lit(0)).alias("items_new"),
            F.col("error").alias("error_message"),
        )
    )


def scan_tally(pages: DataFrame) -> DataFrame:
    """Per detail scan: pages scanned, posts that exist, posts that match."""
    return (
        pages.where(F.col("route") == "detail")
        .groupBy(*CRAWL)
        .agg(F.count("*").alias("scanned"), F.sum("seen").alias("existing"), F.sum(F.size("items")).alias("matched"))
    )


def _write_merge(store: Store, merge: Merge, as_of: datetime, batch: int, last: int) -> None:
    stamp = F.lit(as_of)
    new = merge.new_titles.select(
        "agency_id", "title", "category", "item_type", F.col("url").alias("source_url"), "pdf_url", "norm_title",
        stamp.alias("created_at"), stamp.alias("updated_at"),
    )
    written = store.write("guidelines", with_ids(new, store.last_id("guidelines", last)), batch)
    versions = merge.editions.join(written.select(*TITLE, F.col("id").alias("new_id")), TITLE, "left").select(
        F.coalesce("guideline_id", "new_id").alias("guideline_id"), "version_label", F.col("pub_date").alias("published_date"), "pdf_url",
        stamp.alias("detected_at"),
    )
    store.write("guideline_versions", with_ids(versions, store.last_id("guideline_versions", last)), batch)
    types = stage(merge.types)
    changed = (
        store.stored(last).types(types).join(types, "guideline_id")
        .where(F.col("stored_type") != F.col("item_type"))
        .select("guideline_id", "item_type", stamp.alias("updated_at"))
    )
    store.write("guideline_types", changed, batch)


@replanned
def ingest(
    store: Store,
    pages: DataFrame,
    as_of: datetime,
    run: Run | None = None,
    scorer: Scorer | None = None,
    detail: DataFrame | None = None,
    publications: DataFrame | None = None,
    law_limit: int = LAW_ITEM_LIMIT,
    bodies: DataFrame | None = None,
) -> DataFrame | None:
    """Merge one batch of landed pages into the store; returns the tallies per crawl.

    A batch may hold several crawls of a config. Undated posts take the day of their own crawl; pages of unknown
    configs or agencies are stored as `page_errors`.

    `bodies` (url, body) are pages of single posts, which the scorer then sees the beginning of.

    `run` names the stream or job and its running number; a run the store already holds is left alone,
    so a replay after a crash changes nothing. When another writer commits meanwhile, the batch is planned again.
    """
    if run is not None and store.holds(run):
        return None
    with scratch(pages.sparkSession):
        last = store.last_batch()
        batch = last + 1
        configs, agencies = store.read("crawl_configs", last), store.read("agencies", last)
        found = posts_of(extract_pages(pages, configs, agencies, detail, publications), law_limit)
        judged = stage(accept_items(found.items, scorer, bodies=bodies).withColumn("published_date", F.coalesce("published_date", "crawl_day")))
        merge = decide(judged, store.stored(last), None, as_of, ARRIVAL, CRAWL)
        tallies = stage(merge.tallies, keep=True)
        _write_merge(store, merge, as_of, batch, last)
        store.write("crawl_runs", with_ids(run_rows(found, tallies, as_of), store.last_id("crawl_runs", last)), batch)
        unknown = found.pages.where(F.col("agency_id").isNull() & F.col("error").isNotNull())
        store.write("page_errors", unknown.select("config_id", "crawl_id", "agency_code", "page_num", "url", "fetched_at", "error"), batch)
        store.commit(batch, as_of, run)
    return tallies

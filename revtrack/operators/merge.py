"""Revision upsert (D6): accepted posts against the stored documents and their dated versions.

In order of arrival a post is *skipped* when its url is known, *skipped* when its title key already has a
version of that day, and otherwise becomes a version - of a stored document, or of a new one. A row is
thus taken exactly when its url and its (title, day) are both still free, which makes the accepted rows
the matching a greedy pass would pick. The first row of every (title, day) is taken if it is also the
first row of its url. That settles everything unless the same url came with different titles or days; rows
that then conflict in turn are passed through in order, agency by agency.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.rules import categorize
from ..functions.text import normalize_title, pdf_url, version_label
from ..session import stage
from ..sources.store import Stored

URL = ["agency_id", "url"]
TITLE = ["agency_id", "norm_title"]
EDITION = [*TITLE, "pub_date"]


@dataclass
class Merge:
    """What one batch changes, keyed by agency and title key; nothing is written yet."""

    editions: DataFrame  # accepted posts: agency_id, norm_title, guideline_id (null: new), pub_date, ...
    new_titles: DataFrame  # one row per new document
    types: DataFrame  # last item type that touched a stored document: guideline_id, item_type
    tallies: DataFrame  # per config: found, new, updated, skipped, filtered, scored


def decide(
    items: DataFrame,
    guidelines: DataFrame | Stored,
    versions: DataFrame | None,
    as_of: datetime,
    order: Sequence[str] = ("config_id", "seq"),
    unit: Sequence[str] = ("config_id",),
) -> Merge:
    """Classify `items` (see `accept_items`) into new documents, new versions and skipped posts.

    `items`: agency_id, config_id, title, url, published_date, attachment_urls, item_type, accepted, scored
    and the `order` columns, which must be unique. `guidelines` may carry `norm_title` already; instead of
    both tables a store's `stored()` may be given, with `versions` null. Tallies are per agency and `unit`.
    """
    copies = stage(_copies(items, as_of, order, unit))
    known = stage(_against_store(copies, guidelines if versions is None else _whole(guidelines, versions)))
    fresh = known.where(F.col("url_owner").isNull() & ~F.col("day_taken"))
    taken = _settle(fresh)

    editions = taken.select(*TITLE, "url", "pub_date", "guideline_id", "ord", "first.*")
    firsts = (
        taken.where(F.col("guideline_id").isNull())
        .groupBy(*TITLE)
        .agg(F.min_by(F.struct("url", "first"), "ord").alias("r"), F.min("ord").alias("ord"))
        .select(*TITLE, "ord", F.col("r.url").alias("url"), "r.first.*")
    )
    types = _last_types(known, taken)
    new_types = types.where(F.col("guideline_id").isNull()).select(*TITLE, F.col("item_type").alias("final_type"))
    new_titles = (
        firsts.join(new_types, TITLE, "left")
        .withColumn("item_type", F.coalesce("final_type", "item_type"))
        .withColumn("category", categorize(F.col("title")))
        .drop("final_type")
    )
    stored_types = types.where(F.col("guideline_id").isNotNull()).select("guideline_id", "item_type")
    return Merge(editions, new_titles, stored_types, _tallies(items, editions, firsts, ["agency_id", *unit]))


def _copies(items: DataFrame, as_of: datetime, order: Sequence[str], unit: Sequence[str]) -> DataFrame:
    """Accepted posts with equal url, title key and day as one row: its first post and its last type."""
    ord_ = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    posts = items.where("accepted").select(
        "agency_id",
        F.coalesce("url", F.lit("")).alias("url"),
        normalize_title(F.col("title")).alias("norm_title"),
        F.coalesce("published_date", F.lit(as_of).cast("date")).alias("pub_date"),
        ord_.alias("ord"),
        F.struct(
            *unit, "title", version_label(F.col("title")).alias("version_label"),
            pdf_url(F.col("attachment_urls")).alias("pdf_url"), "item_type",
        ).alias("first"),
    )
    return posts.groupBy("agency_id", "url", "norm_title", "pub_date").agg(
        F.min_by("first", "ord").alias("first"),
        F.min("ord").alias("ord"),
        F.max_by("first.item_type", "ord").alias("last_type"),
        F.max("ord").alias("last_ord"),
    )


def _whole(guidelines: DataFrame, versions: DataFrame) -> Stored:
    """Whole tables as what a batch is matched against."""
    if "norm_title" not in guidelines.columns:
        guidelines = guidelines.withColumn("norm_title", normalize_title(F.col("title")))
    urls = guidelines.where(F.coalesce("source_url", F.lit("")) != "").select("agency_id", F.col("source_url").alias("url"), "id")
    return Stored(
        lambda keys: guidelines.select(*TITLE, "id"), lambda keys: urls, lambda keys: versions.select("guideline_id", "published_date"),
        lambda keys: guidelines.select(F.col("id").alias("guideline_id"), F.col("item_type").alias("stored_type")),
    )


def _against_store(copies: DataFrame, stored: Stored) -> DataFrame:
    """Add `url_owner`, `guideline_id` and `day_taken` from the stored rows the batch can touch."""
    urls, titles = (copies.select(*key).distinct() for key in (URL, TITLE))
    by_url = stored.by_url(urls).join(urls, URL, "left_semi").groupBy(*URL).agg(F.max("id").alias("url_owner"))
    by_title = stage(stored.by_title(titles).join(titles, TITLE, "left_semi").groupBy(*TITLE).agg(F.max("id").alias("guideline_id")))
    placed = copies.join(by_url, URL, "left").join(by_title, TITLE, "left")
    days = (
        stored.days(by_title.select("guideline_id")).select("guideline_id", F.col("published_date").alias("pub_date"))
        .join(by_title.select("guideline_id"), "guideline_id", "left_semi")
        .distinct()
        .withColumn("taken", F.lit(True))
    )
    # Posts of new documents have no owner; a key of their own keeps them from meeting at one null.
    own = F.coalesce("guideline_id", -1 - F.pmod(F.xxhash64(*TITLE), F.lit(1 << 40)))
    return placed.withColumn("_owner", own).join(days.withColumnRenamed("guideline_id", "_owner"), ["_owner", "pub_date"], "left").select(
        *copies.columns, "url_owner", "guideline_id", F.coalesce("taken", F.lit(False)).alias("day_taken")
    )


# Rows of an agency that conflict in turn and are settled in one task; their keys are some 200 bytes each.
CHAINED = 500_000


def _settle(fresh: DataFrame) -> DataFrame:
    """The rows a pass in order would accept: each url and each (title, day) used once.

    A first round takes the first row of each (title, day) that is also the first of its url. What it leaves open are chains
    of rows that conflict in turn; these lie within an agency, so the keys of an agency's open rows are passed through in
    order, at any length of the chains. Agencies with more open rows than a task should hold go on round by round.
    """
    taken, left = _round(fresh)
    if left is None:
        return taken
    left = stage(left)
    many = left.groupBy("agency_id").count().where(F.col("count") > CHAINED).select("agency_id")
    few = left.join(many, "agency_id", "left_anti")
    keys = few.select(*EDITION, "url", "ord")

    def in_order(part: pa.Table) -> pa.Table:
        flat = part.select(["ord"]).flatten()
        order = pc.sort_indices(flat, [(c, "ascending") for c in flat.column_names], null_placement="at_start")
        rows = part.drop_columns("ord").take(order)
        urls, editions, kept = set(), set(), []
        for k, (url, *edition) in enumerate(zip(*(rows[c].to_pylist() for c in ("url", "norm_title", "pub_date")))):
            if url not in urls and tuple(edition) not in editions:
                urls.add(url)
                editions.add(tuple(edition))
                kept.append(k)
        return rows.take(pa.array(kept, pa.int64()))

    passed = keys.groupBy("agency_id").applyInArrow(in_order, T.StructType([keys.schema[c] for c in (*EDITION, "url")]))
    out = taken.unionByName(stage(few.join(passed, [*EDITION, "url"], "left_semi").select(*taken.columns)))
    left = None if many.isEmpty() else stage(left.join(many, "agency_id", "left_semi"))
    while left is not None:
        won, left = _round(left)
        out, left = out.unionByName(won), None if left is None else stage(left)
    return out


def _round(fresh: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows that are the first of their (title, day) and of their url, and those that do not meet them, if there can be any."""
    heads = (
        fresh.groupBy(*EDITION)
        .agg(F.min_by(F.struct("url", "guideline_id", "first"), "ord").alias("r"), F.min("ord").alias("ord"))
        .select(*EDITION, "ord", "r.*")
    )
    first_of_url = fresh.groupBy(*URL).agg(F.min("ord").alias("url_ord"))
    judged = stage(heads.join(first_of_url, URL).withColumn("wins", F.col("ord") == F.col("url_ord")).drop("url_ord"))
    wins = judged.where("wins").drop("wins")
    if judged.where(~F.col("wins")).isEmpty():
        return wins, None
    return wins, fresh.join(wins.select(*EDITION), EDITION, "left_anti").join(wins.select(*URL), URL, "left_anti")


def _last_types(known: DataFrame, taken: DataFrame) -> DataFrame:
    """Item type of the last post that reached each document, by url or as a version."""
    by_stored_url = known.where(F.col("url_owner").isNotNull()).select(
        F.lit(None).cast("bigint").alias("agency_id"), F.lit(None).cast("string").alias("norm_title"),
        F.col("url_owner").alias("guideline_id"), "last_type", "last_ord",
    )
    last_of_url = (
        known.where(F.col("url_owner").isNull())
        .groupBy(*URL)
        .agg(F.max_by("last_type", "last_ord").alias("last_type"), F.max("last_ord").alias("last_ord"))
    )
    stored = F.col("guideline_id").isNotNull()
    own = taken.join(last_of_url, URL).select(
        F.when(~stored, F.col("agency_id")).alias("agency_id"), F.when(~stored, F.col("norm_title")).alias("norm_title"),
        "guideline_id", "last_type", "last_ord",
    )
    return (
        by_stored_url.unionByName(own)
        .groupBy("guideline_id", "agency_id", "norm_title")
        .agg(F.max_by("last_type", "last_ord").alias("item_type"))
    )


def _tallies(items: DataFrame, editions: DataFrame, firsts: DataFrame, unit: list[str]) -> DataFrame:
    seen = items.groupBy(*unit).agg(
        F.count("*").alias("found"),
        F.count_if(~F.col("accepted")).alias("filtered"),
        F.count_if("scored").alias("llm_classified"),
    )
    kept = editions.groupBy(*unit).agg(F.count("*").alias("kept"))
    new = firsts.groupBy(*unit).agg(F.count("*").alias("new"))
    zero = F.lit(0).cast("bigint")
    return (
        seen.join(kept, unit, "left")
        .join(new, unit, "left")
        .withColumn("new", F.coalesce("new", zero))
        .withColumn("kept", F.coalesce("kept", zero))
        .select(
            *unit, "found", "new", (F.col("kept") - F.col("new")).alias("updated"),
            (F.col("found") - F.col("filtered") - F.col("kept")).alias("skipped"), "filtered", "llm_classified",
        )
    )


def with_ids(rows: DataFrame, last_id: int, name: str = "id") -> DataFrame:
    """Number `rows` densely from `last_id + 1` without bringing them to one task.

    Each row's place is stored with it, so both reads see the same, however the files are cut into tasks; only one
    count per partition is summed up. Write the result before using it twice.
    """
    placed = stage(rows.withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33)).withColumn("_pos", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("_part")
        .agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    # One row per partition: bounded by the task count, whatever the data size.
    numbered = placed.join(F.broadcast(starts), "_part")
    return numbered.withColumn(name, F.lit(last_id) + 1 + F.col("_start") + F.col("_pos")).drop("_at", "_part", "_pos", "_start")

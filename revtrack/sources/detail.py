"""Detail pages found by counting up a sequence id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions.dates import iso_day
from ..functions.rules import detail_keyword_match
from ..functions.text import extract, let, strip
from ..functions.urls import fill, url_discriminator
from .items import has_text, item, page


def detail_page(body: Column, seq_id: Column, keywords: Column, profile: Column) -> Column:
    """The post of a detail page, if the page exists, has a title and passes the keywords."""
    exists = ~F.contains(body, profile["error_marker"])
    region = F.when(exists, H.title_region(body, profile["title_section_marker"]))
    title = strip(extract(region, profile["title_regex"]))
    files = F.transform(
        H.listed_files(body, profile["file_regex"], profile["file_has_name"]),
        lambda f: fill(profile["file_download_template"], "file_id", f),
    )
    post = item(
        title,
        fill(profile["url_template"], "id", seq_id.cast("string")),
        iso_day(extract(body, profile["date_regex"])),
        F.when(profile["file_download_template"].isNotNull(), files),
    )

    def kept(posts: Column) -> Column:
        return page(F.filter(posts, lambda p: detail_keyword_match(p["title"], keywords)), F.size(posts))

    return let(F.filter(F.array(post), lambda p: has_text(p["title"])), kept)


def last_ids(profiles: DataFrame, guidelines: DataFrame) -> DataFrame:
    """Highest sequence id stored per profile, never below its baseline.

    `profiles` carries `agency_id`; ids are read from the agency's urls that hold the profile's
    discriminating parameter.
    """
    wanted = profiles.withColumn("_part", url_discriminator(F.col("url_template")))
    urls = guidelines.where(F.coalesce(F.col("source_url"), F.lit("")) != "").select("agency_id", "source_url")
    quoted = F.concat(F.lit(r"\Q"), F.col("id_param_name"), F.lit(r"\E=(\d+)"))
    found = F.nullif(F.call_function("regexp_extract", F.col("source_url"), quoted, F.lit(1)), F.lit(""))
    seen = (
        urls.join(wanted, "agency_id")
        .where(F.contains(F.col("source_url"), F.col("_part")))
        .groupBy("agency_id", "list_url")
        .agg(F.max(found.try_cast("bigint")).alias("_max"))
    )
    return (
        profiles.join(seen, ["agency_id", "list_url"], "left")
        .withColumn("last_id", F.greatest(F.col("baseline_id"), F.coalesce(F.col("_max"), F.col("baseline_id"))))
        .drop("_max")
    )


def worklist(profiles_with_last_id: DataFrame) -> DataFrame:
    """The next ids to fetch per profile, with their urls."""
    ids = F.sequence(F.col("last_id") + 1, F.col("last_id") + F.col("scan_window"))
    return profiles_with_last_id.select(
        "agency_code", "list_url", "url_template", F.explode(ids).alias("seq_id")
    ).select("agency_code", "list_url", "seq_id", fill(F.col("url_template"), "id", F.col("seq_id").cast("string")).alias("url"))

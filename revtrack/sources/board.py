"""Board listing pages (S5) and how far a listing is followed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions.elements import listing_rows
from ..functions.rules import board_keyword_match
from ..functions.text import let
from ..functions.urls import post_url, resolve_url
from .items import has_text, item, page


def board_page(
    body: Column,
    page_url: Column,
    keywords: Column,
    rows: Column | None = None,
    title: Column | None = None,
    link: Column | None = None,
    date: Column | None = None,
) -> Column:
    """Posts of a listing page. The last four are a site's selectors; null means the usual layout. `seen` counts rows."""
    null = F.lit(None).cast("string")
    rows, title, link, date = (null if c is None else c for c in (rows, title, link, date))

    def post(row: Column) -> Column:
        return item(
            H.title_text(row["title"]),
            post_url(page_url, H.attribute(row["link"], "href"), H.attribute(row["link"], "onclick")),
            H.row_date(row["field"], row["cells"]),
            F.transform(row["files"], lambda href: resolve_url(page_url, href)),
        )

    def kept(posts: Column) -> Column:
        wanted = F.filter(posts, lambda p: has_text(p["title"]) & board_keyword_match(p["title"], keywords))
        return page(wanted, F.size(posts))

    return let(F.transform(listing_rows(body, rows, title, date, link), post), kept)


def frontier(pages: DataFrame, unit: Sequence[str] = ("config_id",)) -> DataFrame:
    """Per crawl the first page that failed or matched nothing; pages from there on do not count.

    Wants `unit` (what names one visit of a listing), `page_num, http_status, matched`; listings read to their end are absent.
    """
    stop = F.when((F.col("http_status") != 200) | (F.col("matched") == 0), F.col("page_num"))
    return (
        pages.groupBy(*unit).agg(F.min(stop).alias("stop_page")).where(F.col("stop_page").isNotNull())
    )


def followed(pages: DataFrame, unit: Sequence[str] = ("config_id",)) -> DataFrame:
    """The pages of each listing that come before its frontier."""
    return (
        pages.join(frontier(pages, unit), list(unit), "left")
        .where(F.col("stop_page").isNull() | (F.col("page_num") < F.col("stop_page")))
        .drop("stop_page")
    )

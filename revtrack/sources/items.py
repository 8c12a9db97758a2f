"""Shape of one extracted post and of one page's outcome."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ITEM_TYPE = (
    "struct<title:string,url:string,published_date:date,category:string,attachment_urls:array<string>,serial:string>"
)
PAGE_TYPE = f"struct<items:array<{ITEM_TYPE}>,seen:int,error:string>"


def item(
    title: Column,
    url: Column,
    published_date: Column,
    attachment_urls: Column | None = None,
    category: Column | None = None,
    serial: Column | None = None,
) -> Column:
    null = F.lit(None).cast("string")
    urls = F.array().cast("array<string>") if attachment_urls is None else attachment_urls
    return F.struct(
        title.alias("title"),
        url.alias("url"),
        published_date.alias("published_date"),
        (null if category is None else category).alias("category"),
        F.coalesce(urls, F.array().cast("array<string>")).alias("attachment_urls"),
        (null if serial is None else serial).alias("serial"),
    )


def page(items: Column, seen: Column | None = None, error: Column | None = None) -> Column:
    """`items` kept of a page, how many posts it showed, and what went wrong."""
    none = F.array().cast(f"array<{ITEM_TYPE}>")
    return F.struct(
        F.coalesce(items.cast(f"array<{ITEM_TYPE}>"), none).alias("items"),
        F.coalesce(F.size(items) if seen is None else seen, F.lit(0)).cast("int").alias("seen"),
        (F.lit(None).cast("string") if error is None else error.cast("string")).alias("error"),
    )


def has_text(value: Column) -> Column:
    return F.coalesce(F.length(value) > 0, F.lit(False))

"""Version history: previous edition, counts, meaningful revisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import fixed_values as fv
from ..functions.text import label_changed


def edition_days(versions: DataFrame) -> DataFrame:
    """One row per document and day with the day before it, that day's label and the version count.

    Versions of a day collapse before the shuffle, so a window never holds more rows than a document
    has publication days, however many versions it has. Of versions of one day the largest id names
    the label.
    """
    days = versions.groupBy("guideline_id", "published_date").agg(
        F.count("*").alias("_n"), F.max_by("version_label", "id").alias("_label")
    )
    own = Window.partitionBy("guideline_id")
    by_day = own.orderBy("published_date")
    return days.select(
        "guideline_id",
        "published_date",
        F.lag("published_date").over(by_day).alias("previous_published_date"),
        F.lag("_label").over(by_day).alias("previous_version_label"),
        F.sum("_n").over(own).alias("version_count"),
    )


def with_previous(versions: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Each version with its predecessor by date and its document's version count.

    `history` holds all versions of the documents in question; by default `versions` itself.
    """
    return versions.join(edition_days(versions if history is None else history), ["guideline_id", "published_date"])


def change_type(gap_days: int = fv.MIN_REVISION_GAP_DAYS) -> Column:
    """`new` for an only version, `updated` for a meaningful revision, null for a re-posting."""
    previous = F.col("previous_published_date")
    meaningful = previous.isNotNull() & (
        (F.datediff("published_date", previous) >= gap_days)
        | label_changed(F.col("previous_version_label"), F.col("version_label"))
    )
    return F.when(F.col("version_count") == 1, "new").when(meaningful, "updated")


def version_totals(versions: DataFrame) -> DataFrame:
    """Latest date and number of versions per document."""
    return versions.groupBy("guideline_id").agg(
        F.max("published_date").alias("latest_published_date"), F.count("*").alias("version_count")
    )


def latest_version(versions: DataFrame) -> DataFrame:
    """The version with the latest date per document, the largest id among equals."""
    newest = F.max_by(F.struct("id", "version_label", "published_date", "pdf_url"), F.struct("published_date", "id"))
    return versions.groupBy("guideline_id").agg(newest.alias("latest")).select("guideline_id", "latest.*")


def count_within_window(versions: DataFrame) -> DataFrame:
    """Versions per document among the given rows only, as one row per document."""
    return versions.groupBy("guideline_id").agg(F.count("*").alias("ver_count"))

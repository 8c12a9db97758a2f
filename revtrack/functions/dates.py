"""Date parsers; whatever is not a calendar date becomes null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, strip

_DELIMITED = r"(\d{4})[.\-/](\d{1,2})[.\-/](\d{1,2})"

_MAIL_DATE = (
    r"^(?:[A-Za-z]{3,9},?\s+)?(\d{1,2})\s+([A-Za-z]{3})[A-Za-z]*\s+(\d{4})(?:\s+(\d{1,2}:\d{2})(:\d{2})?)?(?:\s*([A-Za-z]{1,5}|[+-]\d{2}:?\d{2}))?$"
)
_ISO_DATE = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}.*)?$"

# --- fixed values: zone names of internet message dates ----------------------------------------
_ZONE_OFFSETS = {
    "UTC": "+0000", "GMT": "+0000", "UT": "+0000", "Z": "+0000",
    "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500",
    "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700",
}


def _year_one_on(day: Column) -> Column:
    return let(day, lambda d: F.when(d >= F.lit("0001-01-01").cast("date"), d))


def _delimited(text: Column) -> Column:
    """Only what looks like a date reaches the parser: refusing a text costs it an exception."""
    return let(F.regexp_extract(text, _DELIMITED, 0), lambda d: F.when(d != "", _year_one_on(F.try_to_date(F.translate(d, "./", "--"), "y-M-d"))))


def date_from_text(text: Column) -> Column:
    """Eight digits, or the first `Y-m-d` / `Y.m.d` / `Y/m/d` anywhere in the text."""
    return let(strip(text), lambda t: F.when(t.rlike(r"^\d{8}$"), compact_date(t)).otherwise(_delimited(t)))


def compact_date(text: Column) -> Column:
    """`yyyyMMdd` in the first eight characters; shorter texts are null."""
    head = F.substring(text, 1, 8)
    return _year_one_on(F.when(head.rlike(r"^\d{8}$"), F.try_to_date(head, "yyyyMMdd")))


def iso_day(text: Column) -> Column:
    """Strict `yyyy-mm-dd`."""
    return F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), _delimited(text))


def feed_date(published: Column, updated: Column) -> Column:
    """Calendar day in UTC of a feed entry; `published` wins over `updated`."""
    fallback = F.coalesce(F.nullif(published, F.lit("")), updated)
    head = F.substring(fallback, 1, 10)
    return F.coalesce(
        _feed_timestamp(published),
        _feed_timestamp(updated),
        F.when(head.rlike(r"^\d{4}([-./])\d{1,2}\1\d{1,2}$"), _delimited(head)),
    )


def _feed_timestamp(text: Column) -> Column:
    return let(strip(text), _stamped_day)


def _stamped_day(text: Column) -> Column:
    """Day in UTC of a mail date or an ISO timestamp; only texts of the right shape reach a parser."""
    return F.to_date(
        F.when(text.rlike(_MAIL_DATE), let(text, _mail_timestamp)).when(text.rlike(_ISO_DATE), F.try_to_timestamp(text))
    )


def _mail_timestamp(text: Column) -> Column:
    def part(i: int, default: str) -> Column:
        return F.coalesce(F.nullif(F.regexp_extract(text, _MAIL_DATE, i), F.lit("")), F.lit(default))

    offsets = F.create_map(*[F.lit(x) for pair in _ZONE_OFFSETS.items() for x in pair])
    zone = F.regexp_replace(part(6, "+0000"), ":", "")
    offset = F.when(zone.rlike(r"^[+-]"), zone).otherwise(F.coalesce(F.try_element_at(offsets, F.upper(zone)), F.lit("+0000")))
    stamp = F.concat(part(1, ""), F.lit(" "), F.initcap(part(2, "")), F.lit(" "), part(3, ""), F.lit(" "), F.lpad(part(4, "00:00"), 5, "0"), part(5, ":00"), F.lit(" "), offset)
    return F.try_to_timestamp(stamp, F.lit("d MMM yyyy HH:mm:ss Z"))

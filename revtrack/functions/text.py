"""Title and text column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fv

EXACT = "(?dU)"
IGNORE_CASE = "(?diU)"
# Python counts the four ASCII separators as whitespace, Java does not.
SPACE = r"[\s\x1c-\x1f]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` evaluated once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def extract(text: Column, pattern: str | Column, group: int = 1) -> Column:
    """`regexp_extract` that also takes the pattern from a column."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    return F.call_function("regexp_extract", text, pattern, F.lit(group))


def first_group(text: Column, pattern: str | Column, group: int = 1) -> Column:
    """The captured group, or null when the pattern does not match or captures nothing."""
    return F.nullif(extract(text, pattern, group), F.lit(""))


def strip(text: Column) -> Column:
    edge = f"(?U){SPACE}"
    return let(
        text,
        lambda t: F.when(
            F.left(t, F.lit(1)).rlike(edge) | F.right(t, F.lit(1)).rlike(edge), F.regexp_replace(t, f"(?U)^{SPACE}+|{SPACE}+$", "")
        ).otherwise(t),
    )


def collapse(text: Column) -> Column:
    """Trim and turn every run of whitespace into one blank."""
    return F.trim(
        let(text, lambda t: F.when(t.rlike(r"(?U)  |[^\S ]|[\x1c-\x1f]"), F.regexp_replace(t, f"(?U){SPACE}+", " ")).otherwise(t))
    )


# What a title must end in for a suffix pattern to have a chance; one character decides.
_ENDS_PAREN = r"[)\]]"
_ENDS_NUMBER = r"(?U)[\d\s\x1c-\x1f판본전nN]"
_ENDS_NOISE = r"(?U)[내포고지시림간정\s\x1c-\x1f]"


def _drop(text: Column, likely: Callable[[Column], Column], pattern: str) -> Column:
    """Take `pattern` out of the text, looking closely only where a cheap test says it may match."""
    return let(text, lambda t: F.when(likely(t), F.regexp_replace(t, pattern, "")).otherwise(t))


def _ends_in(chars: str) -> Callable[[Column], Column]:
    return lambda t: F.right(t, F.lit(1)).rlike(chars)


def _has_year(t: Column) -> Column:
    return F.contains(t, F.lit("20"))


def normalize_title(title: Column) -> Column:
    """Matching key of a re-edition: bracket suffix, year, number and noise word taken off in turn."""
    out = strip(title)
    out = _drop(out, _ends_in(_ENDS_PAREN), EXACT + fv.PAREN_SUFFIX)
    out = _drop(out, _has_year, IGNORE_CASE + fv.YEAR_SUFFIX)
    out = _drop(out, _ends_in(_ENDS_NUMBER), IGNORE_CASE + fv.NUMBER_SUFFIX)
    out = _drop(out, _ends_in(_ENDS_NOISE), EXACT + fv.NOISE_SUFFIX)
    return collapse(out)


def version_label(title: Column) -> Column:
    """`YYYY년` from a bracketed or trailing year, else `v<n>` from a trailing number, else null."""
    dated = F.when(
        _has_year(title),
        F.concat(
            F.coalesce(first_group(title, EXACT + fv.PAREN_YEAR), first_group(title, IGNORE_CASE + fv.YEAR_SUFFIX)), F.lit("년")
        ),
    )
    numbered = F.when(_ends_in(_ENDS_NUMBER)(title), first_group(title, IGNORE_CASE + fv.NUMBER_SUFFIX))
    return F.coalesce(dated, F.concat(F.lit("v"), numbered))


def pdf_url(urls: Column) -> Column:
    """First url that mentions pdf, else the first url, else null."""
    with_pdf = F.filter(urls, lambda u: F.contains(F.lower(u), F.lit("pdf")))
    return F.coalesce(F.try_element_at(with_pdf, F.lit(1)), F.try_element_at(urls, F.lit(1)))


def clean_title_attribute(attr: Column) -> Column:
    cleaned = F.regexp_replace(attr, fv.NEW_POST_MARK, "")
    return strip(F.regexp_replace(cleaned, "(?d)" + fv.ATTACHMENT_MARK, ""))


def breaks_to_blanks(text: Column) -> Column:
    return collapse(F.regexp_replace(text, r"(?U)</?br\s*/?>", " "))


def label_changed(previous: Column, current: Column) -> Column:
    return F.coalesce(previous, F.lit("")) != F.coalesce(current, F.lit(""))


def iso_date(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def iso_timestamp(ts: Column) -> Column:
    """ISO 8601 with the fraction only where there is one, in the session time zone (UTC)."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(
        whole, F.when(micros == "000000", F.lit("")).otherwise(F.concat(F.lit("."), micros)), F.lit("+00:00")
    )


def compact_list(csv: Column) -> Column:
    """Comma list as stored by older configs; null or empty means no keywords."""
    empty = F.array().cast("array<string>")
    return F.when(csv.isNull() | (csv == ""), empty).otherwise(F.split(csv, ","))

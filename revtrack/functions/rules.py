"""Ordered title rules and keyword predicates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fv
from .text import EXACT, IGNORE_CASE


def alternatives(patterns: Sequence[str], ignore_case: bool = False) -> str:
    return (IGNORE_CASE if ignore_case else EXACT) + "|".join(patterns)


def classify_title(
    title: Column,
    excluded: Sequence[str] = fv.EXCLUDED_TITLE,
    strong: Sequence[str] = fv.STRONG_TITLE,
) -> Column:
    """False: excluded context, true: strong name of a guideline, null: borderline."""
    return F.when(title.rlike(alternatives(excluded)), F.lit(False)).when(
        title.rlike(alternatives(strong)), F.lit(True)
    )


def is_guideline_title(title: Column) -> Column:
    return F.coalesce(classify_title(title), F.lit(False))


def classify_item_type(title: Column, announcement: Sequence[str] = fv.ANNOUNCEMENT_TITLE) -> Column:
    return F.when(title.rlike(alternatives(announcement)), F.lit("announcement")).otherwise(F.lit("guideline"))


def categorize(
    title: Column,
    agency_code: Column | None = None,
    rules: Sequence[tuple[str, bool, Sequence[str]]] = fv.CATEGORY_RULES,
    by_agency: Mapping[str, str] = fv.CATEGORY_BY_AGENCY,
    default: str = fv.DEFAULT_CATEGORY,
) -> Column:
    """Category of the first matching rule, else the agency's usual one, else the default."""
    out = None
    for category, ignore_case, patterns in rules:
        matched = title.rlike(alternatives(patterns, ignore_case))
        out = F.when(matched, category) if out is None else out.when(matched, category)
    if agency_code is not None:
        for code, category in by_agency.items():
            out = out.when(agency_code == code, category)
    return out.otherwise(F.lit(default))


def rules_frame(spark, rules=fv.CATEGORY_RULES):
    """The rules as rows `(priority, category, ignore_case, pattern)`."""
    rows = [(i, category, ic, "|".join(patterns)) for i, (category, ic, patterns) in enumerate(rules, 1)]
    return spark.createDataFrame(rows, "priority int, category string, ignore_case boolean, pattern string")


def _any_contained(text: Column, keywords: Column) -> Column:
    return F.exists(keywords, lambda k: F.contains(text, k))


def board_keyword_match(title: Column, keywords: Column) -> Column:
    """Lower-cased title against the keywords as written; no keywords lets everything pass."""
    return (F.size(keywords) == 0) | _any_contained(F.lower(title), keywords)


def detail_keyword_match(title: Column, keywords: Column) -> Column:
    """Case-sensitive; no keywords lets nothing pass."""
    return _any_contained(title, keywords)


def publication_keyword_match(title: Column, keywords: Column) -> Column:
    """Case-sensitive; no keywords lets everything pass."""
    return (F.size(keywords) == 0) | _any_contained(title, keywords)


def relevant_law_title(title: Column, own_names: Column, keywords: Sequence[str] = fv.LAW_RELEVANCE_KEYWORDS) -> Column:
    """Any relevance keyword left once the agency's own names are taken out of the title."""
    rest = F.aggregate(own_names, title, lambda t, name: F.replace(t, name, F.lit("")))
    return _any_contained(rest, F.array(*[F.lit(k) for k in keywords]))


def _lookup(values: Mapping[str, str], key: Column, default: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.try_element_at(table, key), default)


def rule_type(raw: Column) -> Column:
    """Known spellings mapped, unknown kept, missing is the default type."""
    raw = F.coalesce(raw, F.lit(fv.LAW_DEFAULT_RULE_TYPE))
    return _lookup(fv.LAW_RULE_TYPES, raw, raw)


def basis_type(kind: Column) -> Column:
    return _lookup(fv.LEGAL_BASIS_TYPES, kind, F.lit(fv.DEFAULT_LEGAL_BASIS_TYPE))

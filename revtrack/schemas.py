"""Explicit schemas, enum domains and table contracts of the store."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _D, _TS, _B = (
    T.StringType(), T.LongType(), T.IntegerType(), T.DateType(), T.TimestampType(), T.BooleanType(),
)


def _table(*cols) -> T.StructType:
    """`(name, type)` is required, `(name, type, True)` optional."""
    return T.StructType([T.StructField(c[0], c[1], len(c) > 2 and c[2]) for c in cols])


_STAMPS = (("created_at", _TS), ("updated_at", _TS))

AGENCIES = _table(
    ("id", _L), ("code", _S), ("name", _S), ("short_name", _S), ("homepage_url", _S),
    ("description", _S, True), *_STAMPS,
)
CRAWL_CONFIGS = _table(
    ("id", _L), ("agency_id", _L), ("label", _S), ("source_type", _S), ("schedule", _S), ("url", _S),
    ("list_selector", _S, True), ("title_selector", _S, True), ("date_selector", _S, True),
    ("link_selector", _S, True), ("pagination_param", _S, True), ("max_pages", _I),
    ("keyword_filter", T.ArrayType(_S)), ("is_active", _B), ("item_type", _S), *_STAMPS,
)
CRAWL_RUNS = _table(
    ("id", _L), ("agency_id", _L), ("config_id", _L, True), ("status", _S), ("started_at", _TS),
    ("finished_at", _TS, True), ("items_found", _I), ("items_new", _I), ("error_message", _S, True),
)
LEGAL_BASES = _table(
    ("id", _L), ("agency_id", _L), ("basis_type", _S), ("title", _S), ("law_api_id", _S, True),
    ("promulgation_date", _D, True), ("enforcement_date", _D, True), ("parent_law_name", _S, True),
    ("category", _S), ("source_url", _S, True), *_STAMPS,
)
MANDATES = _table(
    ("id", _L), ("legal_basis_id", _L), ("article_ref", _S, True), ("description", _S),
    ("expected_guideline_title", _S, True), *_STAMPS,
)
GUIDELINES = _table(
    ("id", _L), ("agency_id", _L), ("mandate_id", _L, True), ("title", _S), ("category", _S),
    ("item_type", _S), ("description", _S, True), ("source_url", _S, True), ("pdf_url", _S, True), *_STAMPS,
)
GUIDELINE_VERSIONS = _table(
    ("id", _L), ("guideline_id", _L), ("version_label", _S, True), ("published_date", _D),
    ("pdf_url", _S, True), ("page_count", _I, True), ("change_summary", _S, True),
    ("significance", _S, True), ("detected_at", _TS),
)
GAP_ANALYSIS = _table(
    ("id", _L), ("mandate_id", _L), ("guideline_id", _L, True), ("status", _S),
    ("basis_last_amended", _D, True), ("guideline_last_updated", _D, True), ("days_gap", _I, True),
    ("note", _S, True), *_STAMPS,
)

RAW_PAGES = _table(
    ("config_id", _L), ("agency_code", _S), ("page_num", _I), ("url", _S), ("http_status", _I),
    ("body", _S, True), ("fetched_at", _TS), ("crawl_id", _S, True),
)
ITEMS = _table(
    ("run_id", _S), ("config_id", _L), ("agency_id", _L), ("seq", _L), ("title", _S), ("url", _S),
    ("published_date", _D, True), ("category", _S, True), ("attachment_urls", T.ArrayType(_S)),
)
ADMIN_RULES = _table(
    ("title", _S), ("rule_type", _S), ("agency_name", _S), ("promulgation_date", _D, True),
    ("enforcement_date", _D, True), ("law_api_id", _S), ("source_url", _S),
)

STORE = {
    "agencies": AGENCIES, "crawl_configs": CRAWL_CONFIGS, "crawl_runs": CRAWL_RUNS,
    "legal_bases": LEGAL_BASES, "mandates": MANDATES, "guidelines": GUIDELINES,
    "guideline_versions": GUIDELINE_VERSIONS, "gap_analysis": GAP_ANALYSIS,
}

# Columns that later schema versions added, with the value older files stand for.
ADDED_COLUMNS = {"guidelines": {"item_type": "guideline"}, "crawl_configs": {"item_type": "guideline"}}

DOMAINS = {
    "crawl_configs": {
        "schedule": ("daily", "weekly", "monthly", "quarterly"),
        "source_type": ("rss", "bbs_list", "law_api"),
        "item_type": ("guideline", "announcement"),
    },
    "crawl_runs": {"status": ("running", "success", "partial", "failed")},
    "legal_bases": {
        "basis_type": ("gosi", "hunryeong", "yegyu", "gojung"),
        "category": ("info_security", "privacy", "software", "data", "cloud", "ai", "e_gov", "finance", "other"),
    },
    "guidelines": {
        "category": ("info_security", "privacy", "software", "data", "cloud", "ai", "e_gov", "finance", "other"),
        "item_type": ("guideline", "announcement"),
    },
    "gap_analysis": {"status": ("missing", "outdated", "resolved")},
}

UNIQUE_KEYS = {**{name: [("id",)] for name in STORE}, "agencies": [("id",), ("code",)]}

FOREIGN_KEYS = (
    ("crawl_configs", "agency_id", "agencies"),
    ("crawl_runs", "agency_id", "agencies"),
    ("crawl_runs", "config_id", "crawl_configs"),
    ("legal_bases", "agency_id", "agencies"),
    ("mandates", "legal_basis_id", "legal_bases"),
    ("guidelines", "agency_id", "agencies"),
    ("guidelines", "mandate_id", "mandates"),
    ("guideline_versions", "guideline_id", "guidelines"),
    ("gap_analysis", "mandate_id", "mandates"),
    ("gap_analysis", "guideline_id", "guidelines"),
)

MAX_LENGTHS = {
    "agencies": {"code": 20, "name": 100, "short_name": 50, "homepage_url": 500},
    "crawl_configs": {
        "label": 100, "url": 1000, "list_selector": 500, "title_selector": 500, "date_selector": 500,
        "link_selector": 500, "pagination_param": 50, "item_type": 20,
    },
    "legal_bases": {"title": 500, "law_api_id": 50, "parent_law_name": 200, "source_url": 1000},
    "mandates": {"article_ref": 50, "expected_guideline_title": 500},
    "guidelines": {"title": 500, "source_url": 1000, "pdf_url": 1000},
    "guideline_versions": {"version_label": 50, "pdf_url": 1000},
}

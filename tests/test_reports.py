"""Report scenarios, contracts and gaps on small hand-made stores."""

from datetime import date, datetime

from pyspark.sql import functions as F

from revtrack.operators import gaps, quality
from revtrack.plans import reports
from revtrack.sources.manifest import manifest_guidelines

AS_OF = date(2026, 5, 1)


def _tables(spark):
    agencies = spark.createDataFrame([(1, "KISA", "키사", "Kisa"), (2, "FSC", "금융위원회", "금융위")], "id long, code string, name string, short_name string").withColumn("homepage_url", F.lit("h"))
    guidelines = spark.createDataFrame(
        [(g, 1 if g < 5 else 2, f"title {g}", "ai" if g % 2 else "cloud", "guideline" if g < 6 else "announcement") for g in range(1, 8)],
        "id long, agency_id long, title string, category string, item_type string",
    )
    rows = [
        (1, 1, "v1", date(2026, 4, 20)),
        (2, 2, "v1", date(2025, 1, 1)), (3, 2, "v2", date(2026, 4, 20)),
        (4, 3, None, date(2026, 4, 18)), (5, 3, None, date(2026, 4, 20)),
        (6, 4, "v1", date(2026, 4, 18)), (7, 4, "v2", date(2026, 4, 20)),
        (8, 5, "v1", date(2025, 1, 1)), (9, 5, "v2", date(2025, 6, 1)),
        (10, 6, "v1", date(2026, 4, 30)),
    ]
    versions = spark.createDataFrame(rows, "id long, guideline_id long, version_label string, published_date date").withColumn(
        "detected_at", F.lit(datetime(2026, 5, 1))
    ).withColumn("pdf_url", F.lit(None).cast("string"))
    return agencies, guidelines, versions


def test_recent_changes_scenario(spark):
    agencies, guidelines, versions = _tables(spark)
    want = [
        (4, "updated", "v2", date(2026, 4, 18), "v1", 2),
        (2, "updated", "v2", date(2025, 1, 1), "v1", 2),
        (1, "new", "v1", None, None, 1),
    ]
    for limit in (50, None):
        rows = reports.recent_changes(versions, guidelines, agencies, AS_OF, limit=limit).collect()
        got = [(r.guideline_id, r.change_type, r.version_label, r.previous_published_date, r.previous_version_label, r.version_count) for r in rows]
        assert got == want
    everything = reports.recent_changes(versions, guidelines, agencies, AS_OF, item_type=None).collect()
    assert [r.guideline_id for r in everything] == [6, 4, 2, 1]
    assert reports.recent_changes(versions, guidelines, agencies, AS_OF, agency_code="fsc").count() == 0
    # The page is cut before re-postings are dropped.
    assert [r.guideline_id for r in reports.recent_changes(versions, guidelines, agencies, AS_OF, limit=2).collect()] == [4]


def test_many_versions_of_one_document(spark):
    """One document holds a third of all versions: they collapse to its days before any window."""
    agencies, guidelines, _ = _tables(spark)
    versions = spark.range(30000).select(
        "id", F.when(F.col("id") % 3 == 0, 1).otherwise(1000 + F.col("id")).alias("guideline_id"),
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("version_label"),
        F.date_add(F.lit(date(2026, 4, 1)), (F.col("id") % 20).cast("int")).alias("published_date"), F.lit(AS_OF).cast("timestamp").alias("detected_at"),
    )
    from revtrack.operators.revisions import edition_days

    days = edition_days(versions)
    one = days.where("guideline_id = 1").orderBy("published_date").collect()
    assert len(one) == 20 and {r.version_count for r in one} == {10000}
    assert [r.previous_published_date for r in one] == [None, *[r.published_date for r in one[:-1]]]
    assert reports.recent_changes(versions, guidelines, agencies, AS_OF, limit=None).count() == 9500


def test_guideline_list_orders(spark):
    agencies, guidelines, versions = _tables(spark)
    by_date = reports.list_guidelines(guidelines, agencies, versions, sort_by="latest_date").collect()
    assert [r.id for r in by_date] == [6, 1, 2, 3, 4, 5, 7] and by_date[-1].version_count == 0
    by_count = reports.list_guidelines(guidelines, agencies, versions, sort_by="version_count").collect()
    assert [r.id for r in by_count] == [2, 3, 4, 5, 1, 6, 7]
    assert [r.id for r in reports.list_guidelines(guidelines, agencies, versions, sort_by="zzz").collect()] == [1, 2, 3, 4, 5, 6, 7]
    assert [r.id for r in reports.list_guidelines(guidelines, agencies, versions, q=" 금융 ").collect()] == [5, 6, 7]
    assert [r.id for r in reports.list_guidelines(guidelines, agencies, versions, q="TITLE _", agency_code="kisa", category="cloud").collect()] == [2, 4]


def test_guideline_detail(spark):
    _, guidelines, versions = _tables(spark)
    versions = versions.selectExpr("*", "cast(null as int) page_count", "cast(null as string) change_summary", "cast(null as string) significance")
    rows = reports.guideline_detail(guidelines, versions, 2).collect()
    assert [(r.version_id, r.version_count, r.latest_published_date) for r in rows] == [(3, 2, date(2026, 4, 20)), (2, 2, date(2026, 4, 20))]
    assert [r.version_id for r in reports.guideline_detail(guidelines, versions, 7).collect()] == [None]
    assert reports.guideline_detail(guidelines, versions, 99).count() == 0


def test_health_outcomes(spark):
    now = datetime(2026, 5, 1)
    agencies = spark.createDataFrame([(i, f"A{i}", f"a{i}") for i in range(1, 7)], "id long, code string, short_name string")
    configs = spark.createDataFrame([(i * 10 + k, i, k < 3) for i in range(1, 7) for k in range(4)], "id long, agency_id long, is_active boolean")
    old, new = datetime(2026, 4, 1), datetime(2026, 4, 30)
    runs = [
        (1, 1, 13, "success", new, 9, None),  # only an inactive config ran
        (2, 2, 20, "failed", new, 0, "x" * 50), (3, 2, 21, "failed", new, 0, None), (4, 2, 22, "failed", new, 0, "third"), (5, 2, 20, "success", old, 5, None),
        (6, 3, 30, "success", new, 0, None), (7, 3, 31, "failed", new, None, "e"),
        (8, 4, 40, "success", old, 4, None),
        (9, 5, 50, "success", new, 1, None), (10, 5, None, "failed", new, 0, None),
        (11, 6, 60, "running", new, 3, None),
    ]
    df = spark.createDataFrame(runs, "id long, agency_id long, config_id long, status string, started_at timestamp, items_found int, error_message string").withColumn("items_new", F.lit(0))
    got = {r.agency_code: (r.issue, r.detail, r.latest_run_at, r.items_collected) for r in reports.crawl_health(agencies, configs, df, now).collect()}
    assert got == {
        "A1": ("never_crawled", "크롤 이력 없음", None, 0),
        "A2": ("all_failed", "크롤 실패: " + "x" * 40 + ", unknown", new, 0),
        "A3": ("zero_keyword_match", "대상 키워드 매칭 게시물 없음 (게시판 접근은 정상)", new, 0),
        "A4": ("stale", "최근 2주+ 미실행", old, 4),
        "A6": ("all_failed", "크롤 실패: ", new, 0),
    }
    assert reports.last_global_crawl(configs, df).first()[0] == new
    status = {r.agency_code: (r.last_status, r.last_run_at) for r in reports.crawl_status(agencies, df).collect()}
    assert status["A5"] == ("failed", new) and status["A1"] == ("success", new)


def test_gaps(spark):
    mandates = spark.createDataFrame([(1, 1, "보안 지침 (2024년판)"), (2, 1, None), (3, 2, "x"), (4, 3, None)], "id long, legal_basis_id long, expected_guideline_title string")
    bases = spark.createDataFrame([(1, 1, date(2026, 1, 10)), (2, 1, date(2020, 1, 1)), (3, 1, None)], "id long, agency_id long, promulgation_date date")
    guidelines = spark.createDataFrame([(10, 1, 1, "보안 지침 2023"), (11, 1, 1, "보안 지침"), (12, 3, 1, "y"), (13, 4, 2, "보안 지침")], "id long, mandate_id long, agency_id long, title string")
    versions = spark.createDataFrame([(10, date(2026, 1, 1)), (10, date(2025, 1, 1)), (12, date(2021, 1, 1)), (13, date(2020, 1, 1))], "guideline_id long, published_date date")
    got = sorted((r.mandate_id, r.guideline_id, r.status, r.days_gap) for r in gaps.gaps(mandates, bases, guidelines, versions).collect())
    assert got == [(1, 10, "outdated", 9), (1, 11, "resolved", None), (2, None, "missing", None), (3, 12, "resolved", None), (4, 13, "resolved", None)]
    assert [r.id for r in gaps.missing_mandates(mandates, guidelines).collect()] == [2]
    assert [(r.mandate_id, r.guideline_id) for r in gaps.match_mandates(mandates, bases, guidelines).collect()] == [(1, 11)]


def test_contracts(spark):
    agencies = spark.createDataFrame([(1, "A", "n"), (2, "A", None)], "id long, code string, name string").selectExpr(
        "*", "repeat('x', 51) short_name", "'h' homepage_url", "cast(null as string) description", "timestamp'2026-01-01' created_at", "timestamp'2026-01-01' updated_at")
    runs = spark.createDataFrame([(1, 1, "done"), (2, 9, "failed")], "id long, agency_id long, status string").selectExpr(
        "*", "cast(null as bigint) config_id", "timestamp'2026-01-01' started_at", "cast(null as timestamp) finished_at", "0 items_found", "0 items_new", "cast(null as string) error_message")
    got = sorted(tuple(r) for r in quality.check_store({"agencies": agencies, "crawl_runs": runs}).collect())
    assert got == [
        ("agencies", "columns", "name null", 1), ("agencies", "columns", "short_name too long", 2), ("agencies", "unique code", "A", 2),
        ("crawl_runs", "domain status", "done", 1), ("crawl_runs", "foreign key agency_id", "9", 1),
    ]


def test_category_map(spark):
    _, guidelines, _ = _tables(spark)
    assert reports.category_map(guidelines).first()[0] == {"ai": 4, "cloud": 3}


def test_manifest_keeps_unknown_agencies(spark):
    _, guidelines, _ = _tables(spark)
    agencies = spark.createDataFrame([(1, "KISA", "키사")], "id long, code string, short_name string")
    urls = {r.id: r.url for r in manifest_guidelines(guidelines, agencies).collect()}
    assert urls[1] == "/guidelines?agency_code=KISA" and urls[7] == "/guidelines?agency_code=?"

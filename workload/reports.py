"""Report queries (Q*, J*, A*, W*, O*, P*)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revtrack.operators import gaps, lookups, pick, quality, revisions
from revtrack.plans import reports
from revtrack.sources import manifest

from .roles import DAY, NOW, Tables, with_roles

_TS = "%Y-%m-%d %H:%M:%S.%f"


def _ts(df: DataFrame, *names: str) -> DataFrame:
    for n in names:
        df = df.withColumn(n, F.date_format(F.col(n).cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return df


def _sql_ts(name: str) -> str:
    return f"strftime({name}, '{_TS}') AS {name.split('.')[-1]}"


_HISTORY = """h AS (SELECT v.*, count(*) OVER (PARTITION BY guideline_id) AS version_count,
  max(published_date) OVER w AS previous_published_date,
  arg_max(version_label, {'d': published_date, 'i': id}) OVER w AS previous_version_label
  FROM versions v WINDOW w AS (PARTITION BY guideline_id ORDER BY published_date
    RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING))"""
_CHANGE = """CASE WHEN version_count = 1 THEN 'new' WHEN previous_published_date IS NOT NULL AND
  (published_date - previous_published_date >= 7 OR coalesce(previous_version_label, '') <> coalesce(version_label, '')) THEN 'updated' END"""


def _recent_sql(limit: str, kind: str) -> str:
    return with_roles("agencies", "guidelines", "versions", body=f""", {_HISTORY},
r AS (SELECT h.id, h.guideline_id, g.title, a.code AS agency_code, a.short_name AS agency_name, g.category, {_CHANGE} AS change_type, h.version_label,
  h.published_date, h.previous_published_date, h.previous_version_label, {_sql_ts('h.detected_at')}, h.version_count
  FROM h JOIN guidelines g ON g.id = h.guideline_id JOIN agencies a ON a.id = g.agency_id
  WHERE h.published_date >= DATE '2001-08-01' - 365 {kind} ORDER BY h.published_date DESC, h.id DESC {limit})
SELECT * EXCLUDE (id) FROM r WHERE change_type IS NOT NULL""")


def recent_changes(spark, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return _ts(reports.recent_changes(t.versions, t.guidelines, t.agencies, DAY, days=365, limit=200), "detected_at")


def recent_changes_all(spark, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return _ts(reports.recent_changes(t.versions, t.guidelines, t.agencies, DAY, days=365, item_type=None, limit=None), "detected_at")


def _q(fn):
    return lambda spark, sf_dir: fn(Tables(spark, sf_dir))


_TOTALS = "v AS (SELECT guideline_id, max(published_date) AS latest_published_date, count(*) AS version_count FROM versions GROUP BY 1)"
_LATEST_RUN = """latest AS (SELECT r.config_id, c.agency_id, r.started_at, r.status, r.items_found, r.error_message
  FROM (SELECT *, row_number() OVER (PARTITION BY config_id ORDER BY started_at DESC, id) AS rn FROM runs) r
  JOIN configs c ON c.id = r.config_id WHERE rn = 1 AND c.is_active)"""

QUERIES = {
    "q3_recent_changes": (recent_changes, _recent_sql("LIMIT 200", "AND g.item_type = 'guideline'")),
    "q3_recent_changes_unlimited": (recent_changes_all, _recent_sql("", "")),
    "q1_guideline_list": (
        _q(lambda t: reports.list_guidelines(t.guidelines, t.agencies, t.versions, sort_by="latest_date")),
        with_roles("agencies", "guidelines", "versions", body=f""", {_TOTALS}
SELECT g.*, latest_published_date, coalesce(version_count, 0) AS version_count FROM guidelines g JOIN agencies a ON a.id = g.agency_id LEFT JOIN v ON v.guideline_id = g.id"""),
    ),
    "q1_guideline_search": (
        _q(lambda t: reports.list_guidelines(t.guidelines, t.agencies, t.versions, category="BUILDING", item_type="guideline", q=" nation_1% ", sort_by="version_count")),
        with_roles("agencies", "guidelines", "versions", body=f""", {_TOTALS}
SELECT g.*, latest_published_date, coalesce(version_count, 0) AS version_count FROM guidelines g JOIN agencies a ON a.id = g.agency_id LEFT JOIN v ON v.guideline_id = g.id
WHERE category = 'BUILDING' AND item_type = 'guideline' AND (title ILIKE '%nation_1%%' OR a.short_name ILIKE '%nation_1%%')"""),
    ),
    "q1_guidelines_of_agency": (
        _q(lambda t: reports.list_guidelines(t.guidelines, t.agencies, t.versions, agency_code="nation_7")),
        with_roles("agencies", "guidelines", "versions", body=f""", {_TOTALS}
SELECT g.*, latest_published_date, coalesce(version_count, 0) AS version_count FROM guidelines g JOIN agencies a ON a.id = g.agency_id LEFT JOIN v ON v.guideline_id = g.id WHERE a.code = 'NATION_7'"""),
    ),
    "q2_guideline_detail": (
        _q(lambda t: reports.guideline_detail(t.guidelines, t.versions.selectExpr("*", "cast(null as int) page_count", "cast(null as string) change_summary", "cast(null as string) significance")).drop("page_count", "change_summary", "significance", "version_pdf_url")),
        with_roles("guidelines", "versions", body=f""", {_TOTALS}
SELECT g.*, coalesce(version_count, 0) AS version_count, latest_published_date, x.id AS version_id, x.version_label, x.published_date
FROM guidelines g LEFT JOIN v ON v.guideline_id = g.id LEFT JOIN versions x ON x.guideline_id = g.id"""),
    ),
    "q2_one_guideline": (
        _q(lambda t: reports.guideline_detail(t.guidelines, t.versions.selectExpr("*", "cast(null as int) page_count", "cast(null as string) change_summary", "cast(null as string) significance"), 7).drop("page_count", "change_summary", "significance", "version_pdf_url")),
        with_roles("guidelines", "versions", body=f""", {_TOTALS}
SELECT g.*, coalesce(version_count, 0) AS version_count, latest_published_date, x.id AS version_id, x.version_label, x.published_date
FROM guidelines g LEFT JOIN v ON v.guideline_id = g.id LEFT JOIN versions x ON x.guideline_id = g.id WHERE g.id = 7"""),
    ),
    "q4_legal_bases": (
        _q(lambda t: reports.list_legal_bases(t.bases, t.mandates)),
        with_roles("bases", "mandates", body="SELECT b.*, count(m.id) AS mandate_count FROM bases b LEFT JOIN mandates m ON m.legal_basis_id = b.id GROUP BY ALL"),
    ),
    "q4_legal_bases_of_documents": (
        _q(lambda t: reports.list_legal_bases(t.raw("documents").select(F.col("doc_id").alias("id"), F.col("source").alias("title")), t.raw("labels").select(F.col("doc_id").alias("legal_basis_id")))),
        "SELECT d.doc_id AS id, source AS title, count(l.doc_id) AS mandate_count FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.doc_id, source",
    ),
    "q4_legal_bases_by_agency_and_type": (
        _q(lambda t: reports.list_legal_bases(t.bases, t.mandates, t.agencies, agency_code="nation_4", basis_type="gosi")),
        with_roles("agencies", "bases", "mandates", body="SELECT b.*, count(m.id) AS mandate_count FROM bases b JOIN agencies a ON a.id = b.agency_id LEFT JOIN mandates m ON m.legal_basis_id = b.id WHERE a.code = 'NATION_4' AND basis_type = 'gosi' GROUP BY ALL"),
    ),
    "q5_mandates": (
        _q(lambda t: reports.list_mandates(t.gap_mandates, t.gap_guidelines)),
        with_roles("gap_mandates", "gap_guidelines", body="SELECT m.*, count(g.id) AS guideline_count FROM gap_mandates m LEFT JOIN gap_guidelines g ON g.mandate_id = m.id GROUP BY ALL"),
    ),
    "q5_mandates_of_basis": (
        _q(lambda t: reports.list_mandates(t.gap_mandates, t.gap_guidelines, 3)),
        with_roles("gap_mandates", "gap_guidelines", body="SELECT m.*, count(g.id) AS guideline_count FROM gap_mandates m LEFT JOIN gap_guidelines g ON g.mandate_id = m.id WHERE legal_basis_id = 3 GROUP BY ALL"),
    ),
    "q6_recent_runs_of_agency": (
        _q(lambda t: _ts(reports.recent_runs(t.run_agencies.withColumn("code", F.upper("code")), t.runs, "customer#000000007"), "started_at")),
        with_roles("run_agencies", "runs", body=f"""SELECT r.* REPLACE (strftime(started_at, '{_TS}') AS started_at), upper(a.code) AS agency_code, a.short_name AS agency_name FROM runs r
JOIN run_agencies a ON a.id = r.agency_id WHERE upper(a.code) = 'CUSTOMER#000000007' QUALIFY row_number() OVER (PARTITION BY r.agency_id ORDER BY r.started_at DESC, r.id DESC) <= 10"""),
    ),
    "q6_agencies_with_configs": (
        _q(lambda t: reports.list_agencies(t.run_agencies, t.configs.withColumn("source_type", F.lit("rss")).withColumn("url", F.lit("u")).withColumn("item_type", F.lit("guideline"))).select("id", "code", "short_name", "config_id", "label", "schedule", "is_active")),
        with_roles("run_agencies", "configs", body="SELECT a.id, code, short_name, c.id AS config_id, label, schedule, is_active FROM run_agencies a LEFT JOIN configs c ON c.agency_id = a.id"),
    ),
    "q6_recent_runs_w6": (
        _q(lambda t: _ts(reports.recent_runs(t.run_agencies, t.runs), "started_at")),
        with_roles("run_agencies", "runs", body=f"""SELECT r.* REPLACE (strftime(started_at, '{_TS}') AS started_at), a.code AS agency_code, a.short_name AS agency_name FROM runs r
JOIN run_agencies a ON a.id = r.agency_id QUALIFY row_number() OVER (PARTITION BY r.agency_id ORDER BY r.started_at DESC, r.id DESC) <= 10"""),
    ),
    "q7_crawl_status": (
        _q(lambda t: _ts(reports.crawl_status(t.run_agencies, t.runs), "last_run_at")),
        with_roles("run_agencies", "runs", body=f""", l AS (SELECT agency_id, max_by(runs, {{'t': started_at, 'i': id}}) AS r FROM runs GROUP BY 1)
SELECT code AS agency_code, short_name AS agency_name, strftime(r.started_at, '{_TS}') AS last_run_at, r.status AS last_status, r.items_new AS last_items_new
FROM run_agencies a LEFT JOIN l ON l.agency_id = a.id"""),
    ),
    "q8_crawl_health": (
        _q(lambda t: _ts(reports.crawl_health(t.run_agencies, t.configs, t.runs, NOW), "latest_run_at")),
        with_roles("run_agencies", "runs", "configs", body=f""", {_LATEST_RUN},
t AS (SELECT agency_id, max(started_at) AS m, sum(coalesce(items_found, 0)) AS f, count_if(status = 'success') AS ok FROM latest GROUP BY 1),
s AS (SELECT agency_id, string_agg(msg, ', ' ORDER BY config_id) AS samples FROM (SELECT agency_id, config_id, left(coalesce(nullif(error_message, ''), 'unknown'), 40) AS msg,
  row_number() OVER (PARTITION BY agency_id ORDER BY config_id) AS rn FROM latest WHERE status = 'failed') WHERE rn <= 2 GROUP BY 1),
i AS (SELECT code, short_name, m, f, samples, CASE WHEN m IS NULL THEN 'never_crawled' WHEN ok = 0 THEN 'all_failed' WHEN f = 0 THEN 'zero_keyword_match'
  WHEN m < TIMESTAMP '2024-02-13' - INTERVAL 14 DAYS THEN 'stale' END AS issue FROM run_agencies a LEFT JOIN t ON t.agency_id = a.id LEFT JOIN s ON s.agency_id = a.id)
SELECT code AS agency_code, short_name AS agency_name, issue, CASE issue WHEN 'never_crawled' THEN '크롤 이력 없음' WHEN 'all_failed' THEN '크롤 실패: ' || coalesce(samples, '')
  WHEN 'zero_keyword_match' THEN '대상 키워드 매칭 게시물 없음 (게시판 접근은 정상)' ELSE '최근 2주+ 미실행' END AS detail, strftime(m, '{_TS}') AS latest_run_at,
  CAST(CASE WHEN issue = 'stale' THEN f ELSE 0 END AS BIGINT) AS items_collected FROM i WHERE issue IS NOT NULL"""),
    ),
    "q9_agency_summary": (
        _q(lambda t: _ts(reports.agency_summary(
            t.agencies, t.configs, t.bases, t.guidelines, t.runs), "last_crawl_at")),
        with_roles("agencies", "configs", "bases", "guidelines", "runs", body=f""", l AS (SELECT agency_id, max_by(runs, {{'t': started_at, 'i': id}}) AS r FROM runs GROUP BY 1)
SELECT code, short_name, name, homepage_url, (SELECT count(*) FROM configs c WHERE c.agency_id = a.id) AS crawl_target_count, (SELECT count(*) FROM bases b WHERE b.agency_id = a.id) AS legal_basis_count,
 (SELECT count(*) FROM guidelines g WHERE g.agency_id = a.id) AS guideline_count, strftime(r.started_at, '{_TS}') AS last_crawl_at, r.status AS last_crawl_status, r.items_new AS last_crawl_items
FROM agencies a LEFT JOIN l ON l.agency_id = a.id"""),
    ),
    "q10_dashboard_totals": (
        _q(lambda t: _ts(reports.dashboard_totals(t.agencies, t.bases, t.guidelines, t.versions, t.configs, t.runs, DAY), "last_global_crawl_at")),
        with_roles("agencies", "bases", "guidelines", "versions", "configs", "runs", body=f"""SELECT (SELECT count(*) FROM agencies) AS agency_count, (SELECT count(*) FROM bases) AS legal_basis_count,
 (SELECT count(*) FROM bases WHERE basis_type = 'gosi') AS gosi_count, (SELECT count(*) FROM bases WHERE basis_type = 'hunryeong') AS hunryeong_count, (SELECT count(*) FROM bases WHERE basis_type = 'yegyu') AS yegyu_count,
 (SELECT count(*) FROM guidelines WHERE item_type = 'guideline') AS guideline_count, (SELECT count(*) FROM guidelines WHERE item_type = 'announcement') AS announcement_count,
 (SELECT count(DISTINCT guideline_id) FROM versions WHERE published_date >= DATE '2001-08-01' - 30) AS recently_updated_count,
 (SELECT strftime(max(started_at), '{_TS}') FROM runs JOIN configs c ON c.id = runs.config_id WHERE is_active) AS last_global_crawl_at, CAST(0 AS BIGINT) AS gap_missing, CAST(0 AS BIGINT) AS gap_outdated"""),
    ),
    "q10_category_stats": (
        _q(lambda t: reports.category_stats(t.guidelines)),
        with_roles("guidelines", body="SELECT category, count(*) AS n FROM guidelines GROUP BY 1"),
    ),
    "q11_latest_bases": (
        _q(lambda t: reports.latest_bases(t.bases, t.agencies)),
        with_roles("agencies", "bases", body="SELECT b.id, title, basis_type, short_name AS agency_name, strftime(promulgation_date, '%Y-%m-%d') AS promulgation_date, created_at FROM bases b JOIN agencies a ON a.id = b.agency_id ORDER BY b.created_at DESC, b.id DESC LIMIT 10"),
    ),
    "q11_latest_versions": (
        _q(lambda t: _ts(reports.latest_versions(t.versions, t.guidelines, t.agencies), "detected_at").drop("pdf_url")),
        with_roles("agencies", "guidelines", "versions", body=f"SELECT v.id, guideline_id, g.title, short_name AS agency_name, version_label, published_date, {_sql_ts('detected_at')} FROM versions v JOIN guidelines g ON g.id = v.guideline_id JOIN agencies a ON a.id = g.agency_id ORDER BY v.detected_at DESC, v.id DESC LIMIT 10"),
    ),
    "q12_manifest_bases": (
        _q(lambda t: manifest.manifest_bases(t.bases, t.agencies)),
        with_roles("agencies", "bases", body="SELECT b.id, title, basis_type, coalesce(code, '?') AS agency_code, coalesce(short_name, '?') AS agency_name, parent_law_name, '/legal-bases?agency_code=' || coalesce(code, '?') AS url FROM bases b LEFT JOIN agencies a ON a.id = b.agency_id"),
    ),
    "q13_manifest_guidelines": (
        _q(lambda t: manifest.manifest_guidelines(t.guidelines, t.agencies)),
        with_roles("agencies", "guidelines", body="SELECT g.id, title, category, coalesce(code, '?') AS agency_code, coalesce(short_name, '?') AS agency_name, CAST(NULL AS DATE) AS latest_published_date, '/guidelines?agency_code=' || coalesce(code, '?') AS url FROM guidelines g LEFT JOIN agencies a ON a.id = g.agency_id"),
    ),
    "s14_manifest_header": (
        _q(lambda t: manifest.manifest_header(t.bases, t.guidelines, NOW)),
        with_roles("bases", "guidelines", body="SELECT '1.0.0' AS schema_version, '2024-02-13T00:00:00+00:00' AS generated_at, 48 AS ttl_hours, (SELECT count(*) FROM bases) AS legal_bases, (SELECT count(*) FROM guidelines) AS guidelines"),
    ),
    "s14_manifest_document": (
        _q(lambda t: manifest.manifest_document(t.bases, t.guidelines, t.agencies, NOW)),
        with_roles("agencies", "bases", "guidelines", body="""SELECT 1 AS section, b.id, CASE WHEN b.id = (SELECT min(id) FROM bases) THEN '' ELSE ',' END || '{"id":' || b.id || ',"title":"' || title || '","basis_type":"' || basis_type || '","agency_code":"' || coalesce(code, '?') || '","agency_name":"' || coalesce(short_name, '?') || '","parent_law_name":null,"url":"/legal-bases?agency_code=' || coalesce(code, '?') || '"}' AS line FROM bases b LEFT JOIN agencies a ON a.id = b.agency_id
UNION ALL SELECT 3, g.id, CASE WHEN g.id = (SELECT min(id) FROM guidelines) THEN '' ELSE ',' END || '{"id":' || g.id || ',"title":"' || title || '","category":"' || category || '","agency_code":"' || coalesce(code, '?') || '","agency_name":"' || coalesce(short_name, '?') || '","latest_published_date":null,"url":"/guidelines?agency_code=' || coalesce(code, '?') || '"}' FROM guidelines g LEFT JOIN agencies a ON a.id = g.agency_id
UNION ALL SELECT 0, NULL, '{"schema_version":"1.0.0","generated_at":"2024-02-13T00:00:00+00:00","ttl_hours":48,"legal_bases":[' UNION ALL SELECT 2, NULL, '],"guidelines":[' UNION ALL SELECT 4, NULL, ']}'"""),
    ),
    "q14_run_result": (
        _q(lambda t: reports.run_result(t.runs, t.configs, t.run_agencies)),
        with_roles("run_agencies", "runs", "configs", body="SELECT a.code AS agency_code, c.label AS config_label, error_message IS NULL AS success, items_found AS items_count, items_new, error_message AS error FROM runs r JOIN configs c ON c.id = r.config_id JOIN run_agencies a ON a.id = r.agency_id"),
    ),
    "q14_run_items_a17": (
        _q(lambda t: reports.run_items(t.posts.withColumn("attachment_urls", F.split("topic", " ")))),
        with_roles("posts", body="SELECT config_id, seq, title, url, strftime(published_date, '%Y-%m-%d') AS published_date, CAST(len(string_split(topic, ' ')) AS INTEGER) AS attachment_count FROM posts"),
    ),
    "q15_run_summary": (
        _q(lambda t: reports.run_summary(reports.run_result(t.runs, t.configs, t.run_agencies))),
        with_roles("runs", body="SELECT count(*) AS configs_run, CAST(sum(items_found) AS BIGINT) AS total_items FROM runs"),
    ),
    "q16_recently_updated": (
        _q(lambda t: reports.recently_updated(t.versions, DAY, 365)),
        with_roles("versions", body="SELECT count(DISTINCT guideline_id) AS recently_updated_count FROM versions WHERE published_date >= DATE '2001-08-01' - 365"),
    ),
    "p8_scheduled_configs": (
        _q(lambda t: reports.scheduled_configs(t.configs, t.run_agencies, schedule="daily")),
        with_roles("run_agencies", "configs", body="SELECT a.id AS agency_id, c.id, is_active, schedule, label, code AS agency_code, short_name AS agency_name FROM configs c JOIN run_agencies a ON a.id = c.agency_id WHERE is_active AND schedule = 'daily'"),
    ),
    "a10_run_totals": (
        _q(lambda t: _ts(reports.run_totals(reports.active_latest_runs(t.configs, t.runs)), "max_run_at")),
        with_roles("runs", "configs", body=f", {_LATEST_RUN} SELECT agency_id, strftime(max(started_at), '{_TS}') AS max_run_at, CAST(sum(coalesce(items_found, 0)) AS BIGINT) AS total_found, count_if(status = 'success')::BIGINT AS succeeded, count_if(status = 'failed')::BIGINT AS failed FROM latest GROUP BY 1"),
    ),
    "w1_window_counts": (
        _q(lambda t: revisions.count_within_window(t.versions.where(F.col("published_date") >= F.date_sub(F.lit(DAY), 365)))),
        with_roles("versions", body="SELECT DISTINCT guideline_id, count(*) OVER (PARTITION BY guideline_id) AS ver_count FROM versions WHERE published_date >= DATE '2001-08-01' - 365"),
    ),
    "w2_previous_version": (
        _q(lambda t: revisions.with_previous(t.versions).select("id", "guideline_id", "published_date", "previous_published_date", "previous_version_label", "version_count")),
        with_roles("versions", body=f", {_HISTORY} SELECT id, guideline_id, published_date, previous_published_date, previous_version_label, version_count FROM h"),
    ),
    "a8_latest_version": (
        _q(lambda t: revisions.latest_version(t.versions).drop("pdf_url")),
        with_roles("versions", body="SELECT guideline_id, id, version_label, published_date FROM versions QUALIFY row_number() OVER (PARTITION BY guideline_id ORDER BY published_date DESC, id DESC) = 1"),
    ),
    "w3_latest_run_per_config": (
        _q(lambda t: _ts(pick.latest_run_per_config(t.runs), "started_at")),
        with_roles("runs", body=f"SELECT * REPLACE (strftime(started_at, '{_TS}') AS started_at) FROM runs QUALIFY row_number() OVER (PARTITION BY config_id ORDER BY started_at DESC, id) = 1"),
    ),
    "j7_default_lookup": (
        _q(lambda t: lookups.with_agency(t.configs.select("id", "agency_id"), t.agencies)),
        with_roles("agencies", "configs", body="SELECT c.id, c.agency_id, coalesce(code, '?') AS agency_code, coalesce(short_name, '?') AS agency_name FROM configs c LEFT JOIN agencies a ON a.id = c.agency_id"),
    ),
    "j8_counts_per_agency": (
        _q(lambda t: lookups.with_count(t.run_agencies.select("id"), t.runs.groupBy(F.col("agency_id").alias("id")).agg(F.count("*").alias("n")), "id", "n")),
        with_roles("run_agencies", "runs", body="SELECT a.id, count(r.id) AS n FROM run_agencies a LEFT JOIN runs r ON r.agency_id = a.id GROUP BY 1"),
    ),
    "g1_missing_mandates": (
        _q(lambda t: gaps.missing_mandates(t.gap_mandates, t.gap_guidelines)),
        with_roles("gap_mandates", "gap_guidelines", body="SELECT * FROM gap_mandates m WHERE NOT EXISTS (SELECT 1 FROM gap_guidelines g WHERE g.mandate_id = m.id)"),
    ),
    "g2_gaps": (
        _q(lambda t: gaps.gaps(t.gap_mandates, t.gap_bases, t.gap_guidelines, t.gap_versions.withColumn("id", F.lit(0)))),
        with_roles("gap_mandates", "gap_bases", "gap_guidelines", "gap_versions", body=""", l AS (SELECT guideline_id, max(published_date) AS d FROM gap_versions GROUP BY 1)
SELECT m.id AS mandate_id, g.id AS guideline_id, CASE WHEN g.id IS NULL THEN 'missing' WHEN promulgation_date > d THEN 'outdated' ELSE 'resolved' END AS status,
 promulgation_date AS basis_last_amended, d AS guideline_last_updated, CASE WHEN promulgation_date > d THEN CAST(promulgation_date - d AS INTEGER) END AS days_gap
FROM gap_mandates m LEFT JOIN gap_bases b ON b.id = m.legal_basis_id LEFT JOIN gap_guidelines g ON g.mandate_id = m.id LEFT JOIN l ON l.guideline_id = g.id"""),
    ),
    "g3_amended_bases": (
        _q(lambda t: gaps.amended_bases(t.bases, _law_rows(t))),
        with_roles("bases", body="""SELECT b.id, b.law_api_id, b.promulgation_date, n.d AS latest_promulgation_date, coalesce(n.d > b.promulgation_date, false) AS amended FROM bases b
LEFT JOIN (SELECT 'L' || l_partkey AS k, max(CAST(l_shipdate AS DATE)) AS d FROM lineitem GROUP BY 1) n ON n.k = b.law_api_id WHERE b.law_api_id IS NOT NULL"""),
    ),
    "a16_amendment_tally": (
        _q(lambda t: gaps.amendment_tally(gaps.amended_bases(t.bases, _law_rows(t)))),
        with_roles("bases", body="""SELECT count(*) AS checked, CAST(count_if(n.d > b.promulgation_date) AS BIGINT) AS updates_found FROM bases b
LEFT JOIN (SELECT 'L' || l_partkey AS k, max(CAST(l_shipdate AS DATE)) AS d FROM lineitem GROUP BY 1) n ON n.k = b.law_api_id WHERE b.law_api_id IS NOT NULL"""),
    ),
    "g4_match_mandates": (
        _q(lambda t: gaps.match_mandates(t.gap_mandates, t.gap_bases, t.guidelines)),
        with_roles("gap_mandates", "gap_bases", "guidelines", body=""", n AS (SELECT agency_id, regexp_replace(title, '[\\s_\\-]?v?(\\d+)$', '') AS k, max(id) AS guideline_id FROM guidelines GROUP BY 1, 2)
SELECT m.id AS mandate_id, b.agency_id, n.k AS norm_title, n.guideline_id FROM gap_mandates m JOIN gap_bases b ON b.id = m.legal_basis_id
JOIN n ON n.agency_id = b.agency_id AND n.k = regexp_replace(regexp_replace(expected_guideline_title, '\\s*\\(2024년판\\)$', ''), '[\\s_\\-]?v?(\\d+)$', '')"""),
    ),
    "v1_duplicate_keys": (
        _q(lambda t: quality.duplicate_keys(t.raw("lineitem"), ["l_orderkey", "l_linenumber"])),
        "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    ),
    "v2_orphans": (
        _q(lambda t: quality.orphans(t.raw("orders"), "o_custkey", t.raw("events"), "user_id")),
        "SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events) GROUP BY 1",
    ),
    "v3_outside_domain": (
        _q(lambda t: quality.outside_domain(t.raw("events"), "event_type", ["view", "click", "purchase"])),
        "SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN ('view', 'click', 'purchase') GROUP BY 1",
    ),
    "v4_column_faults": (
        _q(lambda t: quality.column_faults(t.raw("documents"), ["doc_id", "text"], {"text": 2000, "source": 4})),
        "SELECT * FROM (SELECT 'text' AS \"column\", 'too long' AS fault, count(*) AS n FROM documents WHERE length(text) > 2000 UNION ALL SELECT 'source', 'too long', count(*) FROM documents WHERE length(source) > 4) WHERE n > 0",
    ),
    "v_store_contracts": (
        _q(lambda t: quality.check_store({
            "agencies": t.agencies.where("true").selectExpr("id", "code", "name", "concat(short_name, repeat('x', cast(id as int) * 3)) short_name", "homepage_url", "cast(null as string) description", "timestamp'2024-01-01' created_at", "timestamp'2024-01-01' updated_at"),
            "crawl_runs": t.runs.selectExpr("id", "agency_id", "config_id", "status", "started_at", "started_at finished_at", "items_found", "items_new", "error_message"),
        })),
        with_roles("agencies", "runs", body="""SELECT 'agencies' AS table_name, 'columns' AS contract, 'short_name too long' AS detail, count(*) AS n FROM agencies WHERE length(short_name) + id * 3 > 50
UNION ALL SELECT 'crawl_runs', 'foreign key agency_id', CAST(agency_id AS STRING), count(*) FROM runs WHERE agency_id NOT IN (SELECT id FROM agencies) GROUP BY agency_id"""),
    ),
}


def _law_rows(t: Tables) -> DataFrame:
    return t.raw("lineitem").select(
        F.concat(F.lit("L"), F.col("l_partkey").cast("string")).alias("law_api_id"), F.col("l_shipdate").cast("date").alias("promulgation_date")
    )

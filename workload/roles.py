"""How the test tables stand in for store tables: a DataFrame and a SQL view per role.

Every role takes its whole table; values a table lacks are derived from its columns.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


DAY = date(2001, 8, 1)
NOW = datetime(2024, 2, 13)
BASE = "https://posts.example"


# Rows of a task that makes bodies and parses them: with more rows there are more tasks, not longer ones.
DEALT_ROWS = 100_000


def dealt(rows: DataFrame) -> DataFrame:
    """Rows of a table dealt out over all cores, or more tasks, before bodies are made from them and parsed."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // DEALT_ROWS)))


class Tables:
    """Lazy access to one scale factor's tables, in the roles the library knows."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def view(self, name: str, sql: str) -> DataFrame:
        """A role written in SQL both engines read alike, over the raw tables."""
        tables = {t: self.raw(t) for t in ROLE_TABLES[name]}
        if name == "posts":
            tables["orders"] = dealt(tables["orders"])
        return self.spark.sql(sql, **tables)

    def __getattr__(self, name: str) -> DataFrame:
        if name in ROLES:
            return self.view(name, ROLES[name])
        raise AttributeError(name)


_TOPIC = """CASE o_orderpriority WHEN '1-URGENT' THEN '개인정보 보호' WHEN '2-HIGH' THEN '클라우드 보안'
  WHEN '3-MEDIUM' THEN '인공지능 윤리' WHEN '4-NOT SPECIFIED' THEN '전자정부' ELSE '금융 보험' END"""
_KIND = "CASE o_orderstatus WHEN 'F' THEN '가이드라인' WHEN 'O' THEN '안내서' ELSE '업무보고' END"
_SUFFIX = """CASE CAST(floor(o_totalprice) AS BIGINT) % 7 WHEN 0 THEN '(2024년판)' WHEN 1 THEN ' 2025' WHEN 2 THEN ' v2.0'
  WHEN 3 THEN ' 전부개정' WHEN 4 THEN ' 세미나 안내' WHEN 5 THEN ' 발표' ELSE '' END"""

# Plain SQL that Spark and DuckDB read the same way. `{table}` is a test table.
ROLES = {
    "agencies": """SELECT CAST(n_nationkey AS BIGINT) AS id, upper(n_name) AS code, concat(n_name, ' agency') AS name,
      n_name AS short_name, concat('https://', lower(n_name)) AS homepage_url FROM {nation}""",
    "guidelines": """SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS agency_id, c_name AS title, c_mktsegment AS category,
      CASE WHEN c_acctbal < 0 THEN 'announcement' ELSE 'guideline' END AS item_type FROM {customer}""",
    "versions": """SELECT o_orderkey AS id, o_custkey AS guideline_id, o_orderstatus AS version_label,
      CAST(o_orderdate AS DATE) AS published_date, CAST(NULL AS STRING) AS pdf_url, o_orderdate AS detected_at FROM {orders}""",
    "bases": """SELECT p_partkey AS id, CAST(p_size % 25 AS BIGINT) AS agency_id, concat(p_name, ' ', p_brand) AS title,
      CASE p_type WHEN 'ECONOMY' THEN 'gosi' WHEN 'SMALL' THEN 'gosi' WHEN 'MEDIUM' THEN 'hunryeong' WHEN 'LARGE' THEN 'yegyu' ELSE 'gojung' END AS basis_type,
      CASE WHEN p_type = 'PROMO' THEN NULL ELSE concat('L', CAST(p_partkey AS STRING)) END AS law_api_id,
      CAST('1997-01-01' AS DATE) + CAST(p_size AS INTEGER) * 30 AS promulgation_date,
      CAST(NULL AS STRING) AS parent_law_name,
      CAST('1997-01-01' AS DATE) + CAST(p_size AS INTEGER) * 30 AS created_at FROM {part}""",
    "mandates": "SELECT l_orderkey AS id, l_partkey AS legal_basis_id FROM {lineitem}",
    "gap_bases": """SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS agency_id,
      CAST('1997-01-01' AS DATE) + CAST(floor(abs(c_acctbal)) AS INTEGER) % 2400 AS promulgation_date FROM {customer}""",
    "gap_mandates": "SELECT o_orderkey AS id, o_custkey AS legal_basis_id, concat(c_name, ' (2024년판)') AS expected_guideline_title FROM {orders} JOIN {customer} ON o_custkey = c_custkey",
    "gap_guidelines": """SELECT DISTINCT l_orderkey * 8 + l_linenumber AS id, l_orderkey AS mandate_id FROM {lineitem}""",
    "gap_versions": """SELECT l_orderkey * 8 + l_linenumber AS guideline_id, CAST(l_shipdate AS DATE) AS published_date FROM {lineitem}""",
    "run_agencies": "SELECT c_custkey AS id, c_name AS code, concat(c_name, '/', c_mktsegment) AS short_name FROM {customer}",
    "runs": """SELECT event_id AS id, user_id AS agency_id, user_id * 3 + event_id % 3 AS config_id,
      CASE event_type WHEN 'purchase' THEN 'success' WHEN 'view' THEN 'success' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'partial' ELSE 'running' END AS status,
      ts AS started_at, CASE WHEN value < 10 THEN 0 ELSE CAST(floor(value) AS INTEGER) END AS items_found,
      CAST(floor(value) AS INTEGER) AS items_new, CASE WHEN event_type = 'error' AND value >= 1 THEN concat('failed at ', props, ' after a long wait for the remote board') END AS error_message FROM {events}""",
    "configs": """SELECT DISTINCT user_id * 3 + event_id % 3 AS id, user_id AS agency_id, event_id % 3 <> 2 AS is_active,
      CASE event_id % 3 WHEN 0 THEN 'daily' ELSE 'weekly' END AS schedule, concat('board ', CAST(event_id % 3 AS STRING)) AS label FROM {events}""",
    "posts": f"""SELECT CAST(c_nationkey AS BIGINT) AS agency_id, CAST(c_nationkey AS BIGINT) AS config_id, o_orderkey AS seq,
      concat({_TOPIC}, ' ', c_mktsegment, ' ', {_KIND}, {_SUFFIX}) AS title,
      concat({_TOPIC}, ' ', c_mktsegment, ' ', {_KIND}) AS topic,
      concat('{BASE}/', {_TOPIC}, '/', c_mktsegment, '/', o_orderstatus, '/', CASE CAST(floor(o_totalprice) AS BIGINT) % 7 WHEN 4 THEN 'seminar' WHEN 5 THEN 'notice' ELSE 'doc' END,
        '/', CAST(CAST(o_orderdate AS DATE) AS STRING), '/', CAST(CAST(floor(o_totalprice) AS BIGINT) % 3 AS STRING)) AS url,
      CAST(o_orderdate AS DATE) AS published_date,
      CASE WHEN c_nationkey % 5 = 0 THEN 'announcement' ELSE 'guideline' END AS item_type FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey""",
}
ROLE_TABLES = {name: [t for t in ("nation", "customer", "orders", "part", "lineitem", "events") if "{" + t + "}" in sql] for name, sql in ROLES.items()}


def with_roles(*names: str, body: str) -> str:
    """A statement over roles for DuckDB."""
    views = []
    for name in names:
        text = ROLES[name].format(**{t: t for t in ROLE_TABLES[name]})
        views.append(f"{name} AS ({text})")
    return "WITH " + ",\n".join(views) + "\n" + body


def lines(t: Tables) -> DataFrame:
    """Every line of every document as a titled post."""
    return (
        dealt(t.raw("documents"))
        .select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("line_no", "title"))
        .withColumn("agency_id", F.regexp_extract("source", r"(\d+)", 1).cast("bigint"))
    )


LINES = """lines AS (SELECT doc_id, source, lang, CAST(regexp_extract(source, '(\\d+)', 1) AS BIGINT) AS agency_id,
  CAST(u.i AS INTEGER) AS line_no, u.l AS title
  FROM documents, LATERAL (SELECT unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i) u)"""

"""Merge, scoring, insert-if-absent and streaming queries."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revtrack.operators import lookups, scoring
from revtrack.operators.merge import Merge, decide
from revtrack.operators.seeding import seed_documents
from revtrack.session import shared_dir, stage
from revtrack.schemas import RAW_PAGES
from revtrack.sources import registry
from revtrack.sources.store import Store
from revtrack.streaming.incremental import ingest_stream

from .extraction import _TEXT as _PAGE_TEXT
from .roles import LINES, Tables, lines, with_roles
from .titles import _q, sql_category, sql_class, sql_label, sql_norm

AS_OF = datetime(2001, 8, 1)
# Landed pages per micro-batch of the stream.
BATCH_BYTES = 1 << 30
_EMPTY = "array<string>"


def _stored(t: Tables) -> DataFrame:
    """Documents taken as stored: one per agency and plain guideline title, under the first of its urls."""
    return (
        t.posts.where("topic LIKE '%가이드라인' AND title NOT LIKE '%안내' AND title NOT LIKE '%발표'")
        .groupBy("agency_id", "topic")
        .agg(F.min("seq").alias("id"), F.min("url").alias("source_url"), F.min("published_date").alias("published_date"))
        .withColumnRenamed("topic", "title")
    )


_STORED = """stored AS (SELECT agency_id, topic AS title, min(seq) AS id, min(url) AS source_url, min(published_date) AS published_date FROM posts
  WHERE topic LIKE '%가이드라인' AND title NOT LIKE '%안내' AND title NOT LIKE '%발표' GROUP BY 1, 2)"""


def _merge(t: Tables) -> Merge:
    stored = stage(_stored(t))
    versions = stored.select(F.col("id").alias("guideline_id"), "published_date")
    items = scoring.accept_items(t.posts.withColumn("attachment_urls", F.array(F.concat("url", F.lit(".hwp")), F.concat("url", F.lit(".pdf")))))
    return decide(stage(items), stored, versions, AS_OF)


# With equal urls only on equal (title, day), the accepted rows are the first of each (title, day)
# among those whose url and day are not stored.
_DECIDED = f""", {_STORED},
judged AS (SELECT *, {sql_norm('title')} AS norm_title, coalesce(item_type = 'announcement' OR {sql_class('title')}, false) AS accepted FROM posts),
cand AS (SELECT j.*, su.id AS url_owner, st.id AS guideline_id, coalesce(st.published_date = j.published_date, false) AS day_taken FROM judged j
  LEFT JOIN stored su ON su.agency_id = j.agency_id AND su.source_url = j.url LEFT JOIN stored st ON st.agency_id = j.agency_id AND st.title = j.norm_title WHERE accepted),
won AS (SELECT * FROM cand WHERE url_owner IS NULL AND NOT day_taken QUALIFY row_number() OVER (PARTITION BY agency_id, norm_title, published_date ORDER BY seq) = 1),
firsts AS (SELECT * FROM won WHERE guideline_id IS NULL QUALIFY row_number() OVER (PARTITION BY agency_id, norm_title ORDER BY seq) = 1)"""


def _scorer(questions):
    return questions.str.contains("전자정부").map({True: "YES", False: "no"})


def _line_scorer(questions):
    return questions.str.contains("tion").map({True: " yes, it is", False: "NO"})


# Two of three pages name a file in front of their text.
_WITH_FILE = "CASE WHEN page_id % 3 = 0 THEN html ELSE replace(html, '<article>', '<article> file_' || page_id || CASE WHEN page_id % 3 = 1 THEN '.pdf ' ELSE '.docx ' END) END"


def _page_posts(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Pages as posts, two of three of them borderline by their title, and what is behind their urls."""
    pages = t.raw("pages")
    title = F.when(F.col("page_id") % 3 == 0, F.lit("보안 가이드라인")).otherwise(F.concat(F.lit("업무보고 "), F.col("page_id").cast("string")))
    posts = pages.select("page_id", title.alias("title"), "url", F.lit("guideline").alias("item_type"), F.lit("board").alias("label"), F.lit("agency").alias("agency_name"))
    return posts, pages.select("url", F.expr(_WITH_FILE).alias("body"))


def _asked_pages(t: Tables) -> DataFrame:
    posts, bodies = _page_posts(t)
    return scoring.accept_items(posts, _body_scorer, bodies=bodies).select("page_id", "accepted", "scored")


def _reasons(t: Tables) -> DataFrame:
    posts, bodies = _page_posts(t)
    return scoring.score_borderline(scoring.with_snippets(posts, bodies), _body_scorer, "_snippet").select("page_id", "is_guideline", "confidence", "reason")


def _body_scorer(questions):
    body = questions.str.extract(r"본문 첫 500자: ([\s\S]*?)(?:\n첨부파일|\n\n|\Z)")[0].fillna("")
    return body.str.contains("tion").map({True: "yes", False: "no"})


def _candidates(t: Tables) -> DataFrame:
    return t.spark.sql(f"SELECT {_CANDIDATE} FROM {{customer}}", customer=t.raw("customer"))


_CANDIDATE = """c_custkey AS k, CAST(c_nationkey AS BIGINT) AS agency_id, CASE WHEN c_acctbal < 0 THEN lower(concat(c_mktsegment, ' 안내서'))
  WHEN c_acctbal < 3000 THEN concat(c_mktsegment, '_가이드라인(2024') WHEN c_acctbal < 6000 THEN concat(c_mktsegment, ' 없는 문서') ELSE concat('보호%', c_mktsegment) END AS title"""
_RULE = """CAST(o_custkey % 25 AS BIGINT) AS agency_id, o_orderkey AS seq, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE concat('L', CAST(o_custkey * 2 AS STRING)) END AS law_api_id,
  CASE WHEN o_orderstatus = 'P' THEN concat('red widget Brand#', CAST(o_custkey % 30 AS STRING)) ELSE o_orderpriority END AS title"""


def _rules(t: Tables) -> DataFrame:
    return t.spark.sql(f"SELECT {_RULE} FROM {{orders}}", orders=t.raw("orders"))


def streamed(spark, sf_dir: str, backlog: bool = False) -> Store:
    """Every page lands as a detail page of one of 25 agencies and is merged by the stream.

    Two crawls land, one after the other, each with the whole table: the stream is called after each, so the second meets
    what the first has stored. With `backlog` it is called once, after both.
    """
    t = Tables(spark, sf_dir)
    root = f"{shared_dir(spark)}/revtrack/{uuid.uuid4().hex}"
    store = Store(spark, f"{root}/store")
    stamp = F.lit(AS_OF).cast("timestamp")
    agencies = t.agencies.withColumn("created_at", stamp).withColumn("updated_at", stamp)
    configs = agencies.select(
        "id", F.col("id").alias("agency_id"), F.lit("pages").alias("label"), F.lit("bbs_list").alias("source_type"), F.lit("daily").alias("schedule"),
        F.lit("list").alias("url"), F.lit(3).alias("max_pages"), F.array(F.lit("e")).alias("keyword_filter"), F.lit(True).alias("is_active"),
        F.lit("announcement").alias("item_type"), "created_at", "updated_at",
    )
    store.write("agencies", agencies, 0)
    store.write("crawl_configs", configs, 0)
    store.commit(0, AS_OF)
    page = t.raw("pages").select(
        (F.col("page_id") % 25).alias("config_id"), F.concat(F.lit("NATION_"), (F.col("page_id") % 25).cast("string")).alias("agency_code"),
        F.col("page_id").cast("int").alias("page_num"), "url", F.lit(200).alias("http_status"), F.col("html").alias("body"), stamp.alias("fetched_at"),
    )
    # The second crawl is a day later; undated posts are versions of their own crawl's day.
    crawls = [page.withColumn("crawl_id", F.lit(f"crawl {n}")).withColumn("fetched_at", F.col("fetched_at") + F.make_interval(days=F.lit(n))) for n in range(2)]
    # One profile per agency; the agencies are a closed list of 25.
    profiles = registry.detail_profiles(spark, [
        {"agency_code": f"NATION_{n}", "list_url": "list", "id_param_name": "id", "url_template": "https://x.example/{id}", "error_marker": "never seen in a page",
         "title_section_marker": "<article>", "title_regex": "<h1>([^<]+)</h1>"} for n in range(25)
    ])
    for n, crawl in enumerate(crawls, 1):
        crawl.select(*RAW_PAGES.fieldNames()).write.mode("append").parquet(f"{root}/landing")
        if n == len(crawls) or not backlog:
            # The number of micro-batches follows the size of what has landed, not its files.
            query = ingest_stream(spark, f"{root}/landing", store.root, f"{root}/checkpoint", detail=profiles, max_bytes=None if backlog else BATCH_BYTES)
            query.awaitTermination()
    return store


def stream_ingest(spark, sf_dir: str, backlog: bool = False) -> DataFrame:
    """Versions per document after both crawls."""
    store = streamed(spark, sf_dir, backlog)
    guidelines = store.read("guidelines").select(F.col("id").alias("guideline_id"), "agency_id", "norm_title", "item_type")
    return (
        store.read("guideline_versions").join(guidelines, "guideline_id")
        .groupBy("agency_id", "norm_title", "item_type").agg(F.count("*").alias("versions"), F.max("published_date").alias("published_date"))
    )


# Of several pages with one title the first is stored; a second is a new url with a day that is taken, so the next day's crawl adds it.
_STREAMED = f"""WITH p AS (SELECT page_id % 25 AS agency_id, trim(regexp_extract(substring(html, strpos(html, '<article>') + 9, 2000), '<h1>([^<]+)</h1>', 1)) AS title FROM pages)
SELECT agency_id, {sql_norm('title')} AS norm_title, 'announcement' AS item_type, least(2, count(*)) AS versions, DATE '2001-08-01' + CAST(least(2, count(*)) - 1 AS INTEGER) AS published_date FROM p WHERE title <> '' AND contains(title, 'e') GROUP BY ALL"""


def run_rows(spark, sf_dir: str) -> DataFrame:
    """The run of each crawl: its status and what it found and stored."""
    runs = streamed(spark, sf_dir, backlog=True).read("crawl_runs")
    return runs.select("agency_id", "config_id", "status", F.col("started_at").cast("date").alias("day"), "items_found", "items_new", "error_message")


# The first crawl stores each title once, the second what the first had no day for.
_RUN_ROWS = f"""WITH p AS (SELECT page_id % 25 AS agency_id, trim(regexp_extract(substring(html, strpos(html, '<article>') + 9, 2000), '<h1>([^<]+)</h1>', 1)) AS title FROM pages),
g AS (SELECT agency_id, {sql_norm('title')} AS norm_title, count(*) AS n FROM p WHERE title <> '' AND contains(title, 'e') GROUP BY ALL),
a AS (SELECT agency_id, sum(n) AS found, count(*) AS titles, count_if(n > 1) AS more FROM g GROUP BY 1)
SELECT i.agency_id, i.agency_id AS config_id, 'success' AS status, DATE '2001-08-01' + d AS day, CAST(coalesce(found, 0) AS INTEGER) AS items_found,
 CAST(coalesce(CASE WHEN d = 0 THEN titles ELSE more END, 0) AS INTEGER) AS items_new, CAST(NULL AS VARCHAR) AS error_message FROM (SELECT DISTINCT agency_id FROM p) i LEFT JOIN a USING (agency_id), (VALUES (0), (1)) v(d)"""


def seeded_versions(spark, sf_dir: str) -> DataFrame:
    """Curated documents made from customers, most of them several times and all without url, stored with their versions."""
    t = Tables(spark, sf_dir)
    store = Store(spark, f"{shared_dir(spark)}/revtrack/{uuid.uuid4().hex}/store")
    documents = t.raw("customer").selectExpr(
        "CAST(c_nationkey AS BIGINT) AS agency_id", "concat('curated ', c_mktsegment, CAST(c_custkey % 7 AS STRING)) AS title", "CAST(NULL AS STRING) AS source_url",
        "'ai' AS category", "'v1' AS version_label", "DATE '2001-08-01' AS published_date", "CAST(NULL AS STRING) AS change_summary",
    )
    seed_documents(store, documents, AS_OF, alike=False)
    owners = store.read("guidelines").select(F.col("id").alias("guideline_id"), "agency_id", "title", "source_url")
    versions = store.read("guideline_versions").groupBy("guideline_id").agg(F.count("*").alias("versions"))
    return owners.join(versions, "guideline_id").drop("guideline_id")


QUERIES = {
    "d6_tallies_a14": (
        _q(lambda t: _merge(t).tallies),
        with_roles("posts", body=f"""{_DECIDED} SELECT j.agency_id, j.config_id, count(*) AS found,
 (SELECT count(*) FROM firsts f WHERE f.config_id = j.config_id) AS new, (SELECT count(*) FROM won w WHERE w.config_id = j.config_id) - (SELECT count(*) FROM firsts f WHERE f.config_id = j.config_id) AS updated,
 CAST(count_if(accepted) AS BIGINT) - (SELECT count(*) FROM won w WHERE w.config_id = j.config_id) AS skipped, CAST(count_if(NOT accepted) AS BIGINT) AS filtered, CAST(0 AS BIGINT) AS llm_classified FROM judged j GROUP BY 1, 2"""),
    ),
    "d6_editions": (
        _q(lambda t: _merge(t).editions.select("agency_id", "norm_title", "guideline_id", "pub_date", "title", "version_label", "url", "pdf_url")),
        with_roles("posts", body=f"{_DECIDED} SELECT agency_id, norm_title, guideline_id, published_date AS pub_date, title, {sql_label('title')} AS version_label, url, url || '.pdf' AS pdf_url FROM won"),
    ),
    "d6_new_documents": (
        _q(lambda t: _merge(t).new_titles.select("agency_id", "norm_title", "title", "url", "category", "item_type")),
        with_roles("posts", body=f"{_DECIDED} SELECT agency_id, norm_title, title, url, {sql_category('title')} AS category, item_type FROM firsts"),
    ),
    "d6_touched_types": (
        _q(lambda t: _merge(t).types),
        with_roles("posts", body=f"""{_DECIDED} SELECT guideline_id, max(item_type) AS item_type FROM (SELECT url_owner AS guideline_id, item_type FROM cand WHERE url_owner IS NOT NULL
 UNION ALL SELECT guideline_id, item_type FROM won WHERE guideline_id IS NOT NULL) GROUP BY 1"""),
    ),
    "x1_score_lines": (
        _q(lambda t: scoring.score_borderline(lines(t).select("doc_id", "line_no", "title", F.col("source").alias("label"), F.col("lang").alias("agency_name")), _line_scorer)
           .select("doc_id", "line_no", "is_guideline", "confidence", "reason")),
        f"WITH {LINES} SELECT doc_id, line_no, contains(title, 'tion') AS is_guideline, 'llm' AS confidence, CASE WHEN contains(title, 'tion') THEN 'LLM=YES, IT IS | 본문추출실패' ELSE 'LLM=NO | 본문추출실패' END AS reason FROM lines",
    ),
    "x1_with_bodies": (
        _q(_asked_pages),
        f"""WITH own AS (SELECT url, min(left({_PAGE_TEXT}, 500)) AS s FROM (SELECT url, {_WITH_FILE} AS html FROM pages) GROUP BY 1),
SELECT page_id, page_id % 3 = 0 OR contains(s, 'tion') AS accepted, page_id % 3 <> 0 AS scored FROM pages JOIN own USING (url)""",
    ),
    "x1_reasons_f20": (
        _q(_reasons),
        f"""WITH own AS (SELECT url, min(left({_PAGE_TEXT}, 500)) AS s FROM (SELECT url, {_WITH_FILE} AS html FROM pages) GROUP BY 1)
SELECT page_id, contains(s, 'tion') AS is_guideline, 'llm' AS confidence, 'LLM=' || CASE WHEN contains(s, 'tion') THEN 'YES' ELSE 'NO' END
 || CASE WHEN regexp_matches(s, 'file_[0-9]+[.]') THEN ' | 첨부=' || regexp_extract(s, 'file_[0-9]+([.][a-z]+)', 1) ELSE '' END AS reason FROM pages JOIN own USING (url)""",
    ),
    "x1_accept_posts": (
        _q(lambda t: scoring.accept_items(t.posts.withColumn("label", F.lit("b")).withColumn("agency_name", F.lit("a")), _scorer).select("seq", "accepted", "scored")),
        with_roles("posts", body=f"""SELECT seq, CASE WHEN item_type = 'announcement' THEN true WHEN {sql_class('title')} IS NOT NULL THEN {sql_class('title')} ELSE contains(title, '전자정부') END AS accepted,
 item_type <> 'announcement' AND {sql_class('title')} IS NULL AS scored FROM posts"""),
    ),
    "j15_titled_alike": (
        _q(lambda t: lookups.titled_alike(_candidates(t), t.posts, "k")),
        with_roles("posts", body=f", c AS (SELECT {_CANDIDATE} FROM customer), p AS (SELECT DISTINCT agency_id, title FROM posts) SELECT DISTINCT k FROM c JOIN p ON p.agency_id = c.agency_id AND p.title ILIKE '%' || substring(c.title, 1, 30) || '%'"),
    ),
    "j15_tally_a19": (
        _q(lambda t: lookups.load_tally(lookups.mark_titled_alike(_candidates(t), t.posts, "k"))),
        with_roles("posts", body=f""", c AS (SELECT {_CANDIDATE} FROM customer), p AS (SELECT DISTINCT agency_id, title FROM posts),
h AS (SELECT DISTINCT k FROM c JOIN p ON p.agency_id = c.agency_id AND p.title ILIKE '%' || substring(c.title, 1, 30) || '%')
SELECT count(*) AS searched, count(*) - (SELECT count(*) FROM h) AS created, (SELECT count(*) FROM h) AS skipped FROM c"""),
    ),
    "j14_absent_titles_d9": (
        _q(lambda t: lookups.absent(t.posts.select("agency_id", F.col("topic").alias("title")).distinct(), _stored(t), ["agency_id", "title"])),
        with_roles("posts", body=f", {_STORED} SELECT DISTINCT agency_id, topic AS title FROM posts p WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.agency_id = p.agency_id AND s.title = p.topic)"),
    ),
    "j13_existing_codes_d7": (
        _q(lambda t: lookups.mark_existing(t.run_agencies.select("id", "code"), t.runs.select(F.concat(F.lit("Customer#"), F.lpad(F.col("agency_id").cast("string"), 9, "0")).alias("code")), ["code"])),
        with_roles("run_agencies", "runs", body="SELECT id, code, id IN (SELECT agency_id FROM runs) AS exists FROM run_agencies"),
    ),
    "j12_legal_bases_d8": (
        _q(lambda t: lookups.mark_legal_bases(_rules(t), t.bases)),
        with_roles("bases", body=f""", r AS (SELECT {_RULE} FROM orders) SELECT r.*, (law_api_id IS NOT NULL AND EXISTS (SELECT 1 FROM bases b WHERE b.law_api_id = r.law_api_id))
 OR (law_api_id IS NULL AND EXISTS (SELECT 1 FROM bases b WHERE b.law_api_id IS NULL AND b.agency_id = r.agency_id AND b.title = r.title))
 OR row_number() OVER (PARTITION BY law_api_id, CASE WHEN law_api_id IS NULL THEN agency_id END, CASE WHEN law_api_id IS NULL THEN title END ORDER BY agency_id, seq) > 1 AS exists FROM r"""),
    ),
    "j10_url_index": (
        _q(lambda t: lookups.last_owner(t.posts.withColumnRenamed("seq", "id"), ["agency_id", "url"])),
        with_roles("posts", body="SELECT agency_id, url, max(seq) AS guideline_id FROM posts GROUP BY 1, 2"),
    ),
    "t1_stream_ingest": (stream_ingest, _STREAMED),
    "t1_backlog": (lambda spark, sf_dir: stream_ingest(spark, sf_dir, backlog=True), _STREAMED),
    "t5_run_rows": (run_rows, _RUN_ROWS),
    "d9_seeded_versions": (
        seeded_versions,
        """WITH d AS (SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS agency_id, 'curated ' || c_mktsegment || (c_custkey % 7) AS title FROM customer)
SELECT agency_id, title, CAST(1 AS BIGINT) AS versions, CAST(NULL AS VARCHAR) AS source_url FROM d""",
    ),
}

"""Title, date and keyword queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revtrack import fixed_values as fv
from revtrack.functions import dates, html, question, rules, text

from .roles import LINES, Tables, lines, with_roles


def _q(fn):
    return lambda spark, sf_dir: fn(Tables(spark, sf_dir))


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_norm(x: str) -> str:
    out = f"trim({x})"
    for pattern, flags in ((fv.PAREN_SUFFIX, ""), (fv.YEAR_SUFFIX, "i"), (fv.NUMBER_SUFFIX, "i"), (fv.NOISE_SUFFIX, "")):
        out = f"regexp_replace({out}, {sql_text(pattern)}, '', '{flags or 'c'}')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


def sql_label(x: str) -> str:
    def year(p: str, flags: str) -> str:
        return f"nullif(regexp_extract({x}, {sql_text(p)}, 1, '{flags}'), '') || '년'"

    number = f"'v' || nullif(regexp_extract({x}, {sql_text(fv.NUMBER_SUFFIX)}, 1, 'i'), '')"
    return f"coalesce({year(fv.PAREN_YEAR, 'c')}, {year(fv.YEAR_SUFFIX, 'i')}, {number})"


def sql_any(x: str, patterns, flags: str = "c") -> str:
    # DuckDB's engine has no lookahead; as tests the two patterns that use one equal their stems.
    plain = "|".join(patterns).replace("가이드(?!라인)", "가이드").replace("지침(?!서)", "지침")
    return f"regexp_matches({x}, {sql_text(plain)}, '{flags}')"


def sql_class(x: str) -> str:
    return f"CASE WHEN {sql_any(x, fv.EXCLUDED_TITLE)} THEN false WHEN {sql_any(x, fv.STRONG_TITLE)} THEN true END"


def sql_category(x: str) -> str:
    whens = " ".join(f"WHEN {sql_any(x, p, 'i' if ic else 'c')} THEN '{c}'" for c, ic, p in fv.CATEGORY_RULES)
    return f"CASE {whens} ELSE 'other' END"


# Rules over the languages of the documents, in order.
_DOC_RULES = (("tion", False, ("tion", "ción")), ("ment", True, ("ment", "keit")), ("ing", False, ("ing\\s", "ung\\s")))
_KEYWORDS = ("the", "Ea", "que")

_D = "CAST(CAST(o_orderdate AS DATE) AS STRING)"
_MONTHS = "CASE month(CAST(o_orderdate AS DATE)) " + " ".join(
    f"WHEN {i} THEN '{m}'" for i, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(), 1)
) + " END"
_DAY_TEXT = f"""CASE WHEN o_orderpriority = '5-LOW' THEN '2026-13-45' WHEN o_orderstatus = 'F' THEN replace({_D}, '-', '')
  WHEN o_orderstatus = 'O' THEN concat('posted ', replace({_D}, '-', '.'), ' by staff') ELSE concat(' ', replace({_D}, '-', '/'), ' 10:00') END"""
_FEED_TEXT = f"""CASE o_orderstatus WHEN 'F' THEN concat('Mon, ', CAST(day(CAST(o_orderdate AS DATE)) AS STRING), ' ', {_MONTHS}, ' ',
  CAST(year(CAST(o_orderdate AS DATE)) AS STRING), ' 08:30:00 +0900') WHEN 'O' THEN concat({_D}, 'T12:00:00Z') ELSE concat(replace({_D}, '-', '.'), ' noon') END"""
_LIMIT_TEXT = f"CASE o_orderstatus WHEN 'F' THEN replace({_D}, '-', '') WHEN 'O' THEN substring(replace({_D}, '-', ''), 1, 6) ELSE concat(replace({_D}, '-', ''), '120000') END"


def _orders_text(t: Tables, expr: str) -> DataFrame:
    return t.spark.sql(f"SELECT o_orderkey, {expr} AS x FROM {{orders}}", orders=t.raw("orders"))


_RULE_KIND = "CASE p_type WHEN 'LARGE' THEN '훈령' WHEN 'ECONOMY' THEN '예규' WHEN 'SMALL' THEN '고시' WHEN 'MEDIUM' THEN '규칙' ELSE p_type END"


def _file_text(t: Tables) -> DataFrame:
    """Names of files with endings that are known, written large, unknown, or cut short by the pattern."""
    ending = F.element_at(F.array(*(F.lit(e) for e in (".pdf", ".XLSX", ".txt", ".hwpx", " pdf"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return t.raw("part").select("p_partkey", F.concat("p_name", ending, F.lit(" and "), "p_brand", F.when(F.col("p_size") > 25, ".DOCX").otherwise(".png"), F.lit(", "), "p_type", F.lit(".pptx")).alias("x"))


QUERIES = {
    "f1_normalize_title": (
        _q(lambda t: t.posts.select("seq", text.normalize_title(F.col("title")).alias("norm_title"))),
        with_roles("posts", body=f"SELECT seq, {sql_norm('title')} AS norm_title FROM posts"),
    ),
    "f1_normalize_lines": (
        _q(lambda t: lines(t).select("doc_id", "line_no", text.normalize_title(F.col("title")).alias("norm_title"))),
        f"WITH {LINES} SELECT doc_id, line_no, {sql_norm('title')} AS norm_title FROM lines",
    ),
    "f2_version_label": (
        _q(lambda t: t.posts.select("seq", text.version_label(F.col("title")).alias("version_label"))),
        with_roles("posts", body=f"SELECT seq, {sql_label('title')} AS version_label FROM posts"),
    ),
    "f3_pdf_url": (
        _q(lambda t: t.posts.select("seq", text.pdf_url(F.split(F.concat("url", F.lit(" "), "title", F.lit(".PDF")), " ")).alias("pdf_url"))),
        with_roles("posts", body="SELECT seq, coalesce(list_filter(string_split(url || ' ' || title || '.PDF', ' '), lambda u: contains(lower(u), 'pdf'))[1], url) AS pdf_url FROM posts"),
    ),
    "f4_classify_title": (
        _q(lambda t: t.posts.select("seq", rules.classify_title(F.col("title")).alias("is_guideline"), rules.is_guideline_title(F.col("title")).alias("sure"))),
        with_roles("posts", body=f"SELECT seq, {sql_class('title')} AS is_guideline, coalesce({sql_class('title')}, false) AS sure FROM posts"),
    ),
    "f5_item_type": (
        _q(lambda t: t.posts.select("seq", rules.classify_item_type(F.col("title")).alias("item_type"))),
        with_roles("posts", body=f"SELECT seq, CASE WHEN {sql_any('title', fv.ANNOUNCEMENT_TITLE)} THEN 'announcement' ELSE 'guideline' END AS item_type FROM posts"),
    ),
    "f6_category": (
        _q(lambda t: t.posts.select("seq", rules.categorize(F.col("title")).alias("category"))),
        with_roles("posts", body=f"SELECT seq, {sql_category('title')} AS category FROM posts"),
    ),
    "f6_category_of_lines_x3": (
        _q(lambda t: lines(t).groupBy("agency_id", rules.categorize(F.col("title"), F.col("source"), _DOC_RULES, {"src3": "third", "src7": "seventh"}).alias("category")).agg(F.count("*").alias("n"))),
        f"""WITH {LINES} SELECT agency_id, CASE WHEN {sql_any('title', _DOC_RULES[0][2])} THEN 'tion' WHEN {sql_any('title', _DOC_RULES[1][2], 'i')} THEN 'ment'
WHEN {sql_any('title', _DOC_RULES[2][2])} THEN 'ing' WHEN source = 'src3' THEN 'third' WHEN source = 'src7' THEN 'seventh' ELSE 'other' END AS category, count(*) AS n FROM lines GROUP BY 1, 2""",
    ),
    "f7_date_from_text": (
        _q(lambda t: _orders_text(t, _DAY_TEXT).select("o_orderkey", dates.date_from_text(F.col("x")).alias("day"))),
        "SELECT o_orderkey, CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(o_orderdate AS DATE) END AS day FROM orders",
    ),
    "f8_feed_date": (
        _q(lambda t: _orders_text(t, _FEED_TEXT).select("o_orderkey", dates.feed_date(F.col("x"), F.lit(None).cast("string")).alias("day"))),
        "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN CAST(o_orderdate AS DATE) - 1 ELSE CAST(o_orderdate AS DATE) END AS day FROM orders",
    ),
    "f9_compact_date": (
        _q(lambda t: _orders_text(t, _LIMIT_TEXT).select("o_orderkey", dates.compact_date(F.col("x")).alias("day"))),
        "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN CAST(o_orderdate AS DATE) END AS day FROM orders",
    ),
    "f18_mentioned_extensions": (
        _q(lambda t: _file_text(t).select("p_partkey", F.array_join(html.mentioned_extensions(F.col("x")), ",").alias("extensions"))),
        "SELECT p_partkey, concat_ws(',', CASE p_partkey % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.XLSX' WHEN 3 THEN '.hwp' END, CASE WHEN p_size > 25 THEN '.DOCX' END, '.pptx') AS extensions FROM part",
    ),
    "f20_question": (
        _q(lambda t: lines(t).select("doc_id", "line_no", F.md5(question.question(F.col("title"), F.col("source"), F.col("lang"), F.lit(""))).alias("question"))),
        f"WITH {LINES} SELECT doc_id, line_no, md5("
        + sql_text(fv.BORDERLINE_QUESTION).replace("{title}", "' || title || '").replace("{board_label}", "' || source || '").replace("{agency_name}", "' || lang || '").replace("{body_section}", fv.NO_BODY_PART)
        + ") AS question FROM lines",
    ),
    "f21_answers": (
        _q(lambda t: lines(t).groupBy("agency_id").agg(F.count_if(question.answer_is_yes(F.concat(F.lit(" y"), "title"))).alias("n"), F.max(question.answer_reason(F.col("source"), F.lit("a.pdf"))).alias("reason"))),
        f"WITH {LINES} SELECT agency_id, CAST(count_if(starts_with(upper('y' || title), 'YES')) AS BIGINT) AS n, max('LLM=' || upper(source) || ' | 첨부=.pdf') AS reason FROM lines GROUP BY 1",
    ),
    "f24_label_changed": (
        _q(lambda t: t.versions.groupBy("guideline_id").agg(F.count_if(text.label_changed(F.nullif("version_label", F.lit("O")), F.lit("F"))).alias("changed"))),
        with_roles("versions", body="SELECT guideline_id, CAST(count_if(version_label <> 'F') AS BIGINT) AS changed FROM versions GROUP BY 1"),
    ),
    "f25_iso_format": (
        _q(lambda t: t.runs.select("id", text.iso_date(F.col("started_at")).alias("day"), text.iso_timestamp(F.col("started_at").cast("timestamp")).alias("at"))),
        with_roles("runs", body="SELECT id, strftime(started_at, '%Y-%m-%d') AS day, strftime(started_at, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS at FROM runs"),
    ),
    "p9_p11_keyword_filters": (
        _q(lambda t: lines(t).withColumn("k", F.array(*[F.lit(k) for k in _KEYWORDS])).groupBy("source").agg(
            F.count_if(rules.board_keyword_match(F.col("title"), F.col("k"))).alias("board"),
            F.count_if(rules.detail_keyword_match(F.col("title"), F.col("k"))).alias("detail"),
            F.count_if(rules.publication_keyword_match(F.col("title"), F.col("k"))).alias("publication"),
            F.count_if(rules.board_keyword_match(F.col("title"), F.array().cast("array<string>"))).alias("board_all"),
            F.count_if(rules.detail_keyword_match(F.col("title"), F.array().cast("array<string>"))).alias("detail_none"),
        )),
        f"""WITH {LINES} SELECT source, CAST(count_if(contains(lower(title), 'the') OR contains(lower(title), 'que')) AS BIGINT) AS board,
CAST(count_if(contains(title, 'the') OR contains(title, 'Ea') OR contains(title, 'que')) AS BIGINT) AS detail, CAST(count_if(contains(title, 'the') OR contains(title, 'Ea') OR contains(title, 'que')) AS BIGINT) AS publication,
count(*) AS board_all, CAST(0 AS BIGINT) AS detail_none FROM lines GROUP BY 1""",
    ),
    "p12_relevance": (
        _q(lambda t: lines(t).groupBy("source").agg(F.count_if(rules.relevant_law_title(F.col("title"), F.array(F.lit("theat"), F.lit("them")), ("thea", "emque"))).alias("n"))),
        f"WITH {LINES} SELECT source, CAST(count_if(contains(replace(replace(title, 'theat', ''), 'them', ''), 'thea') OR contains(replace(replace(title, 'theat', ''), 'them', ''), 'emque')) AS BIGINT) AS n FROM lines GROUP BY 1",
    ),
    "f22_rule_types": (
        _q(lambda t: t.raw("part").select("p_partkey", rules.rule_type(F.expr(_RULE_KIND)).alias("rule_type"), rules.basis_type(F.when(F.col("p_type") == "LARGE", "예규").otherwise(F.col("p_type"))).alias("basis_type"))),
        f"SELECT p_partkey, CASE WHEN p_type IN ('SMALL', 'MEDIUM') THEN '고시' ELSE {_RULE_KIND} END AS rule_type, CASE WHEN p_type = 'LARGE' THEN 'yegyu' ELSE 'gosi' END AS basis_type FROM part",
    ),
}

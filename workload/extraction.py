"""Extraction queries over pages and over bodies made from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revtrack import fixed_values as fv
from revtrack.functions import html, urls
from revtrack.operators.pick import first_per_url
from revtrack.session import stage
from revtrack.sources import detail, lawsearch, registry
from revtrack.sources.board import board_page, followed, frontier
from revtrack.sources.feed import feed_page
from revtrack.sources.publications import publications_page

from .roles import Tables, dealt
from .titles import _q

_NONE = "array<string>"


def _pages(t: Tables) -> DataFrame:
    return dealt(t.raw("pages"))


def _no_keywords():
    return F.array().cast(_NONE)


# ---- pages ------------------------------------------------------------------------------------

_CLEAN = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?s)<style>.*?</style>', '', 'g'), '(?s)<script>.*?</script>', '', 'g'), '(?s)<nav>.*?</nav>', '', 'g'), '(?s)<footer>.*?</footer>', '', 'g')"
_UNESCAPED = "replace(replace(replace(replace({}, '&quot;', '\"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&')"
_TEXT = "trim(regexp_replace(" + _UNESCAPED.format(f"regexp_replace(regexp_extract({_CLEAN}, '(?s)<article>.*?</article>'), '<[^>]*>', ' ', 'g')") + ", '\\s+', ' ', 'g'))"


def _links(t: Tables) -> DataFrame:
    """The navigation of every page read as a listing."""
    pages = _pages(t)
    page = board_page(F.col("html"), F.col("url"), _no_keywords(), F.lit("nav li"))
    host = F.regexp_extract("url", r"^(https?://[^/?#]*)", 1)
    return pages.select("page_id", host.alias("host"), F.posexplode(page["items"]).alias("pos", "item")).select("page_id", "host", "pos", "item.title", "item.url")


_LINKS = """links AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS host, CAST(u.i AS INTEGER) AS pos, regexp_extract(u.l, '>([^<]*)</a>', 1) AS title,
  regexp_extract(url, '^(https?://[^/?#]*)', 1) || regexp_extract(u.l, 'href="([^"]*)"', 1) AS url FROM pages, LATERAL (SELECT unnest(x) AS l, generate_subscripts(x, 1) - 1 AS i
  FROM (SELECT regexp_extract_all(regexp_extract(html, '(?s)<nav>.*?</nav>'), '<li>.*?</li>') AS x)) u)"""


def _listing(t: Tables) -> DataFrame:
    """Pages of a host as one listing that matches links with a keyword."""
    page = board_page(F.col("html"), F.col("url"), F.array(F.lit("the"), F.lit("la")), F.lit("nav li"))
    return _pages(t).select(
        F.regexp_extract("url", r"^(https?://[^/?#]*)", 1).alias("config_id"), F.col("page_id").alias("page_num"),
        F.lit(200).alias("http_status"), F.size(page["items"]).alias("matched"),
    )


_LISTING = f"""{_LINKS}, listing AS (SELECT regexp_extract(p.url, '^(https?://[^/?#]*)', 1) AS config_id, p.page_id AS page_num, 200 AS http_status,
  CAST(count_if(contains(lower(title), 'the') OR contains(lower(title), 'la')) AS INTEGER) AS matched FROM pages p LEFT JOIN links USING (page_id) GROUP BY ALL),
stops AS (SELECT config_id, min(page_num) AS stop_page FROM listing WHERE matched = 0 GROUP BY 1)"""

# ---- bodies made from tables ------------------------------------------------------------------


def _orders_body(t: Tables, expr: str) -> DataFrame:
    return dealt(t.raw("orders")).selectExpr("*", f"{expr} AS body")


# One body per layout: nested rows, end tags left out, a container in a container, rows that are no children, a script link.
_DAY = "CAST(CAST(o_orderdate AS DATE) AS STRING)"
_LAYOUTS = f"""CASE o_orderkey % 6
  WHEN 0 THEN concat('<table class="board_list"><thead><tr><th><a href="h">head</a></th></tr></thead><tbody><tr><td>1</td><td><a href="v?no=', o_orderkey, '" title="', o_orderpriority, ' post(새 글)">x</a><table><tr><td><a href="f/', o_custkey, '.PDF">file</a></td></tr></table></td><td> ', {_DAY}, ' </td></tr></tbody></table>')
  WHEN 1 THEN concat('<table class="wide bbsList"><tbody><tr><td>1<td><a href="v?no=', o_orderkey, '">', o_orderpriority, ' <b>post</b></a><td>', {_DAY}, '<tr><td>no link<td>', {_DAY}, '</table>')
  WHEN 2 THEN concat('<div class="board_list"><ul><li><a href="v?no=', o_orderkey, '">', o_orderpriority, '</a><ul><li><a href="f/', o_custkey, '.PDF">file</a></li></ul></li><li><a href="w">last</a></li></ul></div><ul><li><a href="m">menu</a></li></ul>')
  WHEN 3 THEN concat('<ul class="bbs_list"><li><div class="bbs_list"><a href="v?no=', o_orderkey, '">', o_orderpriority, '</a></div><li><a href="w">last</a></ul><table><tbody><tr><td><a href="t">table</a></td></tr></tbody></table>')
  WHEN 4 THEN concat('<div class="board-list-wrap"><ul><li><div class="subject"><a href="v?no=', o_orderkey, '">', o_orderpriority, '</a></div><ul><li><a href="f/', o_custkey, '.pdf">file</a></li></ul></li><li><!-- <a href="c">c</a> --><a href="w">last</a></li></ul></div>')
  ELSE concat('<TABLE><tr><td><a href="t">no body</a></td></tr><TBODY><tr><td><a href="#view" onclick="doBbsFView(', chr(39), '1', chr(39), ',', chr(39), o_orderkey, chr(39), ')">', o_orderpriority, '</a></td><td>', {_DAY}, '</td></tr></TBODY></TABLE>') END"""
# (remainder, position, title, url, date, pdf) of the posts in them; K is the order, C the customer.
_LAID_OUT = """SELECT * FROM (VALUES (0, 0, 'P post', 'http://h/v?no=K', true, 'http://h/f/C.PDF'), (0, 1, 'file', 'http://h/f/C.PDF', false, 'http://h/f/C.PDF'), (1, 0, 'Ppost', 'http://h/v?no=K', true, ''),
  (2, 0, 'P', 'http://h/v?no=K', false, 'http://h/f/C.PDF'), (2, 1, 'file', 'http://h/f/C.PDF', false, 'http://h/f/C.PDF'), (2, 2, 'last', 'http://h/w', false, ''), (3, 0, 'P', 'http://h/v?no=K', false, ''),
  (3, 1, 'last', 'http://h/w', false, ''), (4, 0, 'P', 'http://h/v?no=K', false, 'http://h/f/C.pdf'), (4, 1, 'last', 'http://h/w', false, ''), (5, 0, 'P', 'http://h/site/nia_kor/ex/bbs/View.do?cbIdx=1&bcIdx=K', true, '')) v(layout, pos, title, url, dated, pdf)"""
_SECTIONS = f"""concat('<div id="main"><section class="entry hot"><h3 class="t x"><a href="v/', o_orderkey, '" rel="bookmark nofollow">', o_orderpriority, '</a></h3><a href="o">other</a><time class="d">at ', {_DAY}, '</time>',
  '</section><section class="entry"><h3><span><a href="w/', o_custkey, '">second</a></span></h3></section></div><div><section class="entry"><h3><a href="z">outside</a></h3></section></div>')"""
# Row, title, date and link selectors by order.
_CHOSEN = """element_at(array(named_struct('rows', '#main > section.entry', 'title', 'h3 > a', 'date', 'time.d', 'link', 'a[href^="o"]'), named_struct('rows', ' div#main   section.hot', 'title', '.t.x a[rel~=bookmark]', 'date', 'section>.d', 'link', ''),
  named_struct('rows', 'section:first-child', 'title', '*.t', 'date', CAST(NULL AS STRING), 'link', 'a[href$=none]')), CAST(o_orderkey % 3 + 1 AS INT))"""

_FEED = """concat('<rss version="2.0"><channel><title>c</title><item><title> order ', CAST(o_orderkey AS STRING), ' &amp; ', o_orderpriority, ' </title><link>http://h/', CAST(o_custkey AS STRING),
  '</link><pubDate>', CAST(CAST(o_orderdate AS DATE) AS STRING), '</pubDate><category>', o_orderstatus, '</category><enclosure url="http://h/', CAST(o_orderkey AS STRING), '.pdf"/></item>
  <item><title>no link</title></item>', CASE WHEN o_orderstatus = 'P' THEN '</chan' ELSE '</channel></rss>' END)"""
# Cut off before the first entry is whole: nothing can be read.
_UNREADABLE = f"CASE WHEN o_orderstatus = 'P' THEN '<rss><channel><item><title>order' ELSE {_FEED} END"
# Stray signs, names that XML does not know, CDATA, codes out of range, a cut tail, and Atom.
_MALFORMED = """concat(CASE WHEN o_orderstatus = 'P' THEN '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>' ELSE '<rss version="2.0"><channel><item><title>' END,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'R & D ' WHEN '2-HIGH' THEN '<![CDATA[R & <D> ]]>' WHEN '5-LOW' THEN 'R&sect;D&#1114112;&#38;lt; ' ELSE 'R&amp;D &lt;x&gt; ' END, CAST(o_orderkey AS STRING), '</title>',
  CASE WHEN o_orderstatus = 'P' THEN concat('<link href="http://h/?a=1&b=', CAST(o_custkey AS STRING), '"/></entry>') ELSE concat('<link>http://h/?a=1&b=', CAST(o_custkey AS STRING), '</link></item>') END,
  CASE WHEN o_orderstatus = 'P' THEN '</feed>' WHEN o_orderstatus = 'F' THEN '<item><title>cut' ELSE '</channel></rss>' END)"""
_REFERENCES = "concat('&sect;', CAST(o_custkey AS STRING), CASE o_orderstatus WHEN 'P' THEN '&#x110000;' WHEN 'F' THEN '&#55357;&#0;' ELSE '&#38;lt;&nosuch;' END, '&rarr;&#44032; & &amp;amp;')"
_DETAIL = """concat('<p>head</p>', CASE o_orderstatus WHEN 'P' THEN '오류가 발생' WHEN 'O' THEN '<div class="titleBox"><h3> ' ELSE '<h3>early</h3><div class="titleBox"><h3>' END, o_orderpriority,
  ' 가이드</h3><span class="date">', CAST(CAST(o_orderdate AS DATE) AS STRING), '</span></div><a fileNo="', CAST(o_custkey AS STRING), '" filePage="board">a.PDF</a><a fileNo="7" filePage="board">b.png</a>')"""
_PUBS = """concat('<img class="border-gray01" src="x">head', '<img class="border-gray01" alt="', o_orderpriority, '<br/>guide"> <a href="/common/download.do?seq=A', CAST(o_orderkey AS STRING),
  '">x</a> 등록일자: ', CAST(CAST(o_orderdate AS DATE) AS STRING), '<img class="border-gray01" alt="copy"> <a href="/common/download.do?seq=A', CAST(o_orderkey AS STRING), '">x</a><img class="border-gray01" alt="second ',
  o_orderstatus, '"><a href="/common/download.do?seq=B', CAST(o_custkey AS STRING), '">x</a><img class="border-gray01" alt="no link">')"""
_LAW_RULE = """concat('{{"행정규칙명":"', {title}, '","행정규칙일련번호":"', {serial}, '","행정규칙종류":"', CASE WHEN p_type = 'LARGE' THEN '규칙' ELSE '예규' END, '","발령일자":"2001', lpad(CAST(p_size % 12 + 1 AS STRING), 2, '0'), '09"}}')"""
_LAW_TITLE = "concat(CASE p_type WHEN 'SMALL' THEN '암호 ' WHEN 'PROMO' THEN '데이터 ' WHEN 'ECONOMY' THEN '개인정보보호위원회 ' ELSE '정보보호 ' END, p_name)"
_LAW_SERIAL = "CASE WHEN p_type = 'PROMO' THEN '' ELSE concat(p_brand, p_name) END"
_LAW = (
    "CASE WHEN p_type = 'LARGE' THEN concat('{\"AdmRulSearch\":{\"admrul\":', " + _LAW_RULE.format(title=_LAW_TITLE, serial=_LAW_SERIAL).replace("{{", "{").replace("}}", "}") + ", '}}') "
    "ELSE concat('{\"AdmRulSearch\":{\"admrul\":[', " + _LAW_RULE.format(title=_LAW_TITLE, serial=_LAW_SERIAL).replace("{{", "{").replace("}}", "}") + ", ',', "
    + _LAW_RULE.format(title="concat('보안 ', p_brand)", serial="concat('S', CAST(p_partkey AS STRING))").replace("{{", "{").replace("}}", "}") + ", ']}}') END"
)
# Two agencies of the registry; the whole table is their searches' answers, page by page.
_LAW_AGENCY = "CASE WHEN p_size <= 25 THEN 'PIPC' ELSE 'FSC' END"


def _feed(t: Tables, field: str, body: str = _FEED) -> DataFrame:
    """Items, or the error, of every feed; exploding the parse itself keeps Spark from evaluating it again in a filter."""
    page = feed_page(F.col("body"), _no_keywords())
    rows = page["items"] if field == "items" else F.array_compact(F.array(page["error"]))
    return _orders_body(t, body).select("o_orderkey", F.explode(rows).alias("i"))


def _laid_out(t: Tables) -> DataFrame:
    """Posts of bodies in all six layouts, with dates and attachments."""
    page = board_page(F.col("body"), F.lit("http://h/l"), _no_keywords())
    rows = _orders_body(t, _LAYOUTS).select("o_orderkey", F.posexplode(page["items"]).alias("pos", "i"))
    return rows.select("o_orderkey", "pos", "i.title", "i.url", "i.published_date", F.array_join("i.attachment_urls", " ").alias("files"))


def _chosen(t: Tables) -> DataFrame:
    """Posts by selectors that are a column of the table."""
    by = F.expr(_CHOSEN)
    page = board_page(F.col("body"), F.lit("http://h/l"), _no_keywords(), by["rows"], by["title"], by["link"], by["date"])
    rows = _orders_body(t, _SECTIONS).select("o_orderkey", page.alias("p")).select("o_orderkey", "p.seen", F.posexplode("p.items").alias("pos", "i"))
    return rows.select("o_orderkey", "seen", "pos", "i.title", "i.url", "i.published_date")


def _whole_pages(t: Tables) -> DataFrame:
    """Every child of a page's body as a row: its heading, else its first link."""
    page = board_page(F.col("html"), F.col("url"), _no_keywords(), F.lit("body > *"), F.lit("h1"))
    rows = _pages(t).select("page_id", page.alias("p")).select("page_id", "p.seen", F.posexplode("p.items").alias("pos", "i"))
    return rows.select("page_id", "seen", "pos", "i.title", "i.url", "i.published_date")


def _detail_profile() -> F:
    fields = {
        "error_marker": "오류가 발생", "title_section_marker": "titleBox", "title_regex": r"<h3>([^<]+)</h3>", "date_regex": r'class="date"[^>]*>(\d{4}-\d{2}-\d{2})',
        "file_regex": registry.DETAIL_PROFILES[0]["file_regex"], "file_download_template": "http://d/{file_id}", "url_template": "http://v/{id}",
    }
    return F.struct(*[F.lit(v).alias(k) for k, v in fields.items()], F.lit(True).alias("file_has_name"))


def _publication_profile() -> F:
    fields = {k: v for k, v in registry.PAGE_PROFILES[0].items() if k != "config_label"}
    return F.struct(*[F.lit(v).alias(k) for k, v in fields.items()])


def _law_pages(t: Tables) -> DataFrame:
    return dealt(t.raw("part")).selectExpr(f"{_LAW_AGENCY} AS agency_code", "CAST(p_partkey AS INTEGER) AS page_num", "200 AS http_status", f"{_LAW} AS body")


def _law_rows(t: Tables) -> DataFrame:
    names = F.when(F.col("agency_code") == "PIPC", F.array(F.lit("개인정보보호위원회"))).otherwise(F.array(F.lit("금융위원회")))
    return (
        _law_pages(t).select("agency_code", "page_num", F.posexplode(lawsearch.relevant_rules(F.col("body"), names, F.element_at(names, 1))).alias("pos", "r"))
        .select("agency_code", "page_num", "pos", "r.*")
    )


_LAW_SQL = f"""raw AS (SELECT {_LAW_AGENCY} AS agency_code, CAST(p_partkey AS INTEGER) AS page_num, *, {_LAW_TITLE} AS t1, {_LAW_SERIAL} AS s1 FROM part),
found AS (SELECT agency_code, page_num, 0 AS p, t1 AS title, s1 AS serial, p_type, p_size FROM raw UNION ALL SELECT agency_code, page_num, 1, '보안 ' || p_brand, 'S' || p_partkey, p_type, p_size FROM raw WHERE p_type <> 'LARGE'),
kept AS (SELECT agency_code, page_num, CAST(row_number() OVER (PARTITION BY agency_code, page_num ORDER BY p) - 1 AS INTEGER) AS pos, title, CASE WHEN p_type = 'LARGE' THEN '고시' ELSE '예규' END AS rule_type,
  CASE agency_code WHEN 'PIPC' THEN '개인정보보호위원회' ELSE '금융위원회' END AS agency_name, make_date(2001, p_size % 12 + 1, 9) AS promulgation_date, CAST(NULL AS DATE) AS enforcement_date,
  serial AS law_api_id, 'https://www.law.go.kr/행정규칙/' || title AS source_url FROM found
  WHERE regexp_matches(replace(title, CASE agency_code WHEN 'PIPC' THEN '개인정보보호위원회' ELSE '금융위원회' END, ''), '{'|'.join(fv.LAW_RELEVANCE_KEYWORDS)}'))"""


def _scan_profiles(t: Tables) -> DataFrame:
    """A scan profile per user of the events; the id parameter is read from their properties."""
    users = t.raw("events").select("user_id").distinct()
    return users.select(
        F.col("user_id").alias("agency_id"), F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("agency_code"),
        F.concat(F.lit("list"), F.col("user_id").cast("string")).alias("list_url"), F.lit("k").alias("id_param_name"),
        F.concat(F.lit("http://h/d?menuNo="), (F.col("user_id") % 3).cast("string"), F.lit("&k={id}")).alias("url_template"),
        F.lit(90).cast("bigint").alias("baseline_id"), F.lit(20).cast("bigint").alias("scan_window"),
    )


def _last_ids(t: Tables) -> DataFrame:
    stored = t.raw("events").select(
        F.col("user_id").alias("agency_id"),
        F.concat(F.lit("http://h/d?menuNo="), (F.col("event_id") % 3).cast("string"), F.lit("&k="), F.get_json_object("props", "$.k")).alias("source_url"),
    )
    return detail.last_ids(_scan_profiles(t), stored)


_LAST_IDS = """last AS (SELECT user_id AS agency_id, greatest(90, coalesce(max(CAST(json_extract(props, '$.k') AS BIGINT)) FILTER (event_id % 3 = user_id % 3), 90)) AS last_id FROM events GROUP BY 1)"""


QUERIES = {
    "f19_page_text": (
        _q(lambda t: _pages(t).select("page_id", F.md5(html.page_text(F.col("html"))).alias("text"), html.snippet(F.col("html")).alias("snippet"))),
        f"SELECT page_id, md5({_TEXT}) AS text, left({_TEXT}, 500) AS snippet FROM pages",
    ),
    "s5_listing_links_f30_f35": (
        _q(_links),
        f"WITH {_LINKS} SELECT page_id, host, pos, title, url FROM links",
    ),
    "s5_layouts_f12_f35": (
        _q(_laid_out),
        f"""SELECT o_orderkey, pos, replace(title, 'P', o_orderpriority) AS title, replace(replace(url, 'K', o_orderkey::VARCHAR), 'C', o_custkey::VARCHAR) AS url,
 CASE WHEN dated THEN CAST(o_orderdate AS DATE) END AS published_date, replace(pdf, 'C', o_custkey::VARCHAR) AS files FROM orders JOIN ({_LAID_OUT}) ON layout = o_orderkey % 6""",
    ),
    "s5_whole_pages": (
        _q(_whole_pages),
        f"""WITH {_LINKS} SELECT page_id, 4 AS seen, 0 AS pos, title, url, CAST(NULL AS DATE) AS published_date FROM links WHERE pos = 0
 UNION ALL SELECT page_id, 4, 1, trim(regexp_replace({_UNESCAPED.format("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")}, '\\s+', ' ', 'g')), '', NULL FROM pages""",
    ),
    "x2_selectors": (
        _q(_chosen),
        """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 2 END AS seen, pos, CASE WHEN pos = 0 THEN o_orderpriority WHEN o_orderkey % 3 = 0 THEN 'second' ELSE 'outside' END AS title,
 CASE WHEN o_orderkey % 3 = 0 AND pos = 0 THEN 'http://h/o' WHEN pos = 0 AND o_orderkey % 3 = 1 THEN 'http://h/v/' || o_orderkey WHEN pos = 0 THEN '' WHEN o_orderkey % 3 = 0 THEN 'http://h/w/' || o_custkey ELSE 'http://h/z' END AS url,
 CASE WHEN pos = 0 AND o_orderkey % 3 < 2 THEN CAST(o_orderdate AS DATE) END AS published_date FROM orders, (VALUES (0), (1)) v(pos) WHERE pos = 0 OR o_orderkey % 3 <> 1""",
    ),
    "d1_first_per_url": (
        _q(lambda t: first_per_url(_links(t), ["host"], ["page_id", "pos"])),
        f"WITH {_LINKS} SELECT page_id, host, pos, title, url FROM links QUALIFY row_number() OVER (PARTITION BY host, url ORDER BY page_id, pos) = 1",
    ),
    "w5_frontier": (
        _q(lambda t: frontier(_listing(t))),
        f"WITH {_LISTING} SELECT * FROM stops",
    ),
    "w5_followed_pages": (
        _q(lambda t: followed(stage(_listing(t)))),
        f"WITH {_LISTING} SELECT l.* FROM listing l LEFT JOIN stops USING (config_id) WHERE stop_page IS NULL OR page_num < stop_page",
    ),
    "f31_split_blocks": (
        _q(lambda t: _pages(t).select("page_id", F.posexplode(html.split_blocks(F.col("html"), F.lit("(?=<p>)"))).alias("pos", "block")).select("page_id", "pos", F.md5("block").alias("block"))),
        "SELECT page_id, CAST(u.i AS INTEGER) AS pos, md5('<p>' || u.b) AS block FROM pages, LATERAL (SELECT unnest(x) AS b, generate_subscripts(x, 1) - 1 AS i FROM (SELECT string_split(html, '<p>')[2:] AS x)) u",
    ),
    "f11_resolve_url": (
        _q(lambda t: _pages(t).select("page_id", urls.resolve_url(F.col("url"), F.lit("../x/./y?z=1")).alias("relative"), urls.resolve_url(F.col("url"), F.lit("?q")).alias("query"), urls.resolve_url(F.col("url"), F.lit("//o/p")).alias("scheme"))),
        """SELECT page_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) || regexp_replace(regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '[^/]*$', ''), '[^/]*/$', '') || 'x/y?z=1' AS relative,
 regexp_replace(url, '[?#].*$', '') || '?q' AS query, regexp_extract(url, '^(https?)', 1) || '://o/p' AS scheme FROM pages""",
    ),
    "f10_page_url": (
        _q(lambda t: _pages(t).select("page_id", urls.page_url(F.col("url"), F.lit("p"), F.col("page_id")).alias("url"))),
        "SELECT page_id, url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'p=' || page_id AS url FROM pages",
    ),
    "s3_feed_items": (
        _q(lambda t: _feed(t, "items").select("o_orderkey", "i.title", "i.url", "i.published_date", "i.category", F.element_at("i.attachment_urls", 1).alias("pdf"))),
        "SELECT o_orderkey, 'order ' || o_orderkey || ' & ' || o_orderpriority AS title, 'http://h/' || o_custkey AS url, CAST(o_orderdate AS DATE) AS published_date, o_orderstatus AS category, 'http://h/' || o_orderkey || '.pdf' AS pdf FROM orders",
    ),
    "s3_malformed_feeds": (
        _q(lambda t: _feed(t, "items", _MALFORMED).select("o_orderkey", "i.title", "i.url")),
        """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'R & D ' WHEN '2-HIGH' THEN 'R & <D> ' WHEN '5-LOW' THEN 'R§D�&lt; ' ELSE 'R&D <x> ' END || o_orderkey AS title,
 'http://h/?a=1&b=' || o_custkey AS url FROM orders""",
    ),
    "f19_references": (
        _q(lambda t: _orders_body(t, _REFERENCES).select("o_orderkey", html.unescape(F.col("body")).alias("text"))),
        """SELECT o_orderkey, '§' || o_custkey || CASE o_orderstatus WHEN 'P' THEN '�' WHEN 'F' THEN '��' ELSE '&lt;&nosuch;' END || '→가 & &amp;' AS text FROM orders""",
    ),
    "s4_feed_errors": (
        _q(lambda t: _feed(t, "error", _UNREADABLE).withColumnRenamed("i", "error")),
        "SELECT o_orderkey, 'feed could not be parsed' AS error FROM orders WHERE o_orderstatus = 'P'",
    ),
    "s6_detail_pages_f17_f36": (
        _q(lambda t: _orders_body(t, _DETAIL).select("o_orderkey", detail.detail_page(F.col("body"), F.col("o_orderkey"), F.array(F.lit("HIGH"), F.lit("LOW")), _detail_profile()).alias("p"))
           .select("o_orderkey", F.col("p.seen"), F.explode_outer("p.items").alias("i")).select("o_orderkey", "seen", "i.title", "i.url", "i.published_date", F.array_join("i.attachment_urls", " ").alias("files"))),
        """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END AS seen, CASE WHEN ok THEN o_orderpriority || ' 가이드' END AS title, CASE WHEN ok THEN 'http://v/' || o_orderkey END AS url,
 CASE WHEN ok THEN CAST(o_orderdate AS DATE) END AS published_date, CASE WHEN ok THEN 'http://d/' || o_custkey END AS files FROM (SELECT *, o_orderstatus <> 'P' AND regexp_matches(o_orderpriority, 'HIGH|LOW') AS ok FROM orders)""",
    ),
    "s7_publications_d2": (
        _q(lambda t: _orders_body(t, _PUBS).select("o_orderkey", F.explode(publications_page(F.col("body"), F.lit("http://p"), _no_keywords(), _publication_profile())["items"]).alias("i")).select("o_orderkey", "i.title", "i.url", "i.published_date", "i.serial")),
        """SELECT o_orderkey, o_orderpriority || ' guide' AS title, 'https://www.nis.go.kr:4016/common/download.do?seq=A' || o_orderkey AS url, CAST(o_orderdate AS DATE) AS published_date, 'A' || o_orderkey AS serial FROM orders
 UNION ALL SELECT o_orderkey, 'second ' || o_orderstatus, 'https://www.nis.go.kr:4016/common/download.do?seq=B' || o_custkey, NULL, 'B' || o_custkey FROM orders""",
    ),
    "s8_law_rules_p12": (
        _q(_law_rows),
        f"WITH {_LAW_SQL} SELECT * FROM kept",
    ),
    "d3_distinct_rules": (
        _q(lambda t: lawsearch.distinct_rules(_law_rows(t), ["agency_code"], "law_api_id")),
        f"WITH {_LAW_SQL} SELECT * FROM kept QUALIFY law_api_id = '' OR row_number() OVER (PARTITION BY agency_code, law_api_id ORDER BY page_num, pos) = 1",
    ),
    "o7_first_rules": (
        _q(lambda t: lawsearch.top_per_key(lawsearch.distinct_rules(_law_rows(t), ["agency_code"], "law_api_id"), ["agency_code"], ["page_num", "pos"], 30)),
        f"WITH {_LAW_SQL}, once AS (SELECT * FROM kept QUALIFY law_api_id = '' OR row_number() OVER (PARTITION BY agency_code, law_api_id ORDER BY page_num, pos) = 1) SELECT * FROM once QUALIFY row_number() OVER (PARTITION BY agency_code ORDER BY page_num, pos) <= 30",
    ),
    "a13_last_ids": (
        _q(lambda t: _last_ids(t).select("agency_id", "last_id")),
        f"WITH {_LAST_IDS} SELECT * FROM last",
    ),
    "t2_worklist": (
        _q(lambda t: detail.worklist(_last_ids(t)).select("agency_code", "seq_id", "url")),
        f"WITH {_LAST_IDS} SELECT 'U' || agency_id AS agency_code, s.i AS seq_id, 'http://h/d?menuNo=' || (agency_id % 3) || '&k=' || s.i AS url FROM last, LATERAL (SELECT unnest(generate_series(last_id + 1, last_id + 20)) AS i) s",
    ),
}

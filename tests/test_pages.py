"""Urls, page text and page structure."""

import itertools
from datetime import date
from urllib.parse import urljoin

from pyspark.sql import functions as F

from revtrack.functions import elements as structure
from revtrack.functions import html, urls
from revtrack.sources.board import board_page, followed
from revtrack.sources.detail import last_ids, worklist
from revtrack.sources.landing import extract_pages, routed_configs
from revtrack.sources import registry
from revtrack.sources.lawsearch import admin_rules
from revtrack.sources.feed import feed_page

BASES = ["http://h.kr/a/b/c?q=1#f", "https://h.kr", "http://h.kr/a/b/", "http://h.kr:81/x", "http://h.kr/a//b/c"]
HREFS = ["", "d", "d/e", "./d", "../d", "../../../d", "/r/s", "/r/../s", "?n=1", "#z", "//o.kr/p", "http://o.kr/p?x", "mailto:a@b", "d?x=/../y", "d/.", "..", "a//b", "d;p"]


def test_resolve_url_is_the_standard_join(evaluate):
    pairs = list(itertools.product(BASES, HREFS))
    got = evaluate(urls.resolve_url, pairs, "b string, h string")
    wrong = [(p, g, urljoin(*p)) for p, g in zip(pairs, got) if g != urljoin(*p)]
    assert not wrong


def test_page_url(evaluate):
    rows = [("http://h/l?b=1", "p", 2), ("http://h/l", "p", 2), ("http://h/l", None, 2)]
    assert evaluate(urls.page_url, rows, "b string, p string, n int") == ["http://h/l?b=1&p=2", "http://h/l?p=2", "http://h/l"]


def test_post_url(evaluate):
    rows = [
        ("http://h.kr/l/m", "#view", "doBbsFView('12','34','x')"), ("http://h.kr/l/m", "#", "fn_inqire_notice('5','B_1')"),
        ("http://h.kr/l/m", "#LINK", "other()"), ("http://h.kr/l/m", None, None), ("http://h.kr/l/m", "v?n=1", None),
    ]
    assert evaluate(urls.post_url, rows, "p string, h string, o string") == [
        "http://h.kr/site/nia_kor/ex/bbs/View.do?cbIdx=12&bcIdx=34",
        "http://h.kr/main/cop/bbs/selectBoardArticle.do?bbsId=B_1&nttId=5", "", "", "http://h.kr/l/v?n=1",
    ]


def test_law_url(evaluate):
    rows = [("/d?x=1", "t"), ("http://a/b", "t"), ("", "제목"), (None, "제목")]
    assert evaluate(urls.law_url, rows, "l string, t string") == [
        "https://www.law.go.kr/d?x=1", "http://a/b", "https://www.law.go.kr/행정규칙/제목", "https://www.law.go.kr/행정규칙/제목",
    ]


def test_references_are_read_once_and_bounded(evaluate):
    values = ["&#1114112;&#x110000;&#55357;&#0;", "&#38;lt; &amp;lt;", "a&sect;b&rarr;c&euro;", "&#xAC00;&#128512;", "&nosuch; & &;&&amp;"]
    assert evaluate(html.unescape, values) == ["\ufffd" * 4, "&lt; &lt;", "a§b→c€", "가😀", "&nosuch; & &;&&"]


def test_unescape(evaluate):
    values = ["a &amp;lt; b", "&#44032;&#xAC01;&#128512;", "&lt;p&gt; &#x; &# &unknown;", "R&D"]
    assert evaluate(html.unescape, values) == ["a &lt; b", "가각😀", "<p> &#x; &# &unknown;", "R&D"]


def test_snippet_takes_the_container_and_drops_the_rest(evaluate):
    page = (
        "<html><head><title>t</title><style>p{}</style></head><body><nav>메뉴</nav><div class='gnb'><div>a</div>b</div>"
        "<div id='x' class='big board_view'>본문 <div>안<div>쪽</div></div> 끝<script>var a='</div>'</script></div>밖</body></html>"
    )
    assert evaluate(html.snippet, [page]) == ["본문 안 쪽 끝"]
    assert evaluate(html.snippet, ["<p>하나 <!-- x --> 둘</p>", "<body><main>m</main><article>a</article></body>", ""]) == ["하나 둘", "a", ""]
    assert evaluate(html.snippet, ["<main>" + "가" * 600 + "</main>"]) == ["가" * 500]
    assert evaluate(html.page_text, ["<main>" + "가" * 600 + "</main>"]) == ["가" * 600]


TABLE = """<table class="board_list"><thead><tr><th>제목</th></tr></thead><tbody>
<tr><td>1</td><td class="title"><a href="/v/../w?no=1&amp;p=2" title="보안 안내서(새 글)-첨부파일 있음">보안..</a></td>
<td> 2026.04.15 </td><td><a href="f/x.PDF">첨부</a><a href="f/y.hwp">y</a></td></tr>
<tr><td>2</td><td><a href="#view" onclick="doBbsFView('12','34','x')"> 점검표 <b>두</b>
 번째</a></td><td>2026-04-14</td></tr>
<tr><td>3</td><td>링크 없음</td></tr>
<tr><td>4</td><td><a href="v?no=4" title="x"></a></td></tr></tbody></table>"""
LIST = """<div class="board-list-wrap"><ul><li><div class="subject"><a href="?no=1">지침 하나</a></div></li>
<li><div class="subject"><a href="d/2">둘</a></div></li></ul></div><ul><li><a href="z">메뉴</a></li></ul>"""


def _board(spark, body, keywords=(), **patterns):
    df = spark.createDataFrame([(body, list(keywords))], "b string, k array<string>").repartition(2)
    cols = {k: F.lit(v) for k, v in patterns.items()}
    page = df.select(board_page(F.col("b"), F.lit("http://h.kr/l/m"), F.col("k"), **cols).alias("p")).first().p
    return page


def test_board_table(spark):
    page = _board(spark, TABLE)
    assert [(i.title, i.url, i.published_date, i.attachment_urls) for i in page["items"]] == [
        ("보안 안내서", "http://h.kr/w?no=1&p=2", date(2026, 4, 15), ["http://h.kr/l/f/x.PDF"]),
        ("점검표두번째", "http://h.kr/site/nia_kor/ex/bbs/View.do?cbIdx=12&bcIdx=34", date(2026, 4, 14), []),
    ]
    assert page.seen == 4 and page.error is None


def test_board_list_layout_and_keywords(spark):
    assert [(i.title, i.url) for i in _board(spark, LIST)["items"]] == [("지침 하나", "http://h.kr/l/m?no=1"), ("둘", "http://h.kr/l/d/2")]
    assert [i.title for i in _board(spark, LIST, ["지침"])["items"]] == ["지침 하나"]
    assert _board(spark, "<p>nothing</p>")["items"] == []


def test_board_profile_patterns(spark):
    body = "<ul class='board_type01'><li><a href='#view' onclick=\"doBbsFView('1','2')\" title='발간물'>x</a><span class='src'>2026.04.13조회수 235</span></li></ul><li>x</li>"
    page = _board(spark, body, rows=".board_type01 li", title="a", date="span.src")
    assert [(i.title, i.published_date) for i in page["items"]] == [("발간물", date(2026, 4, 13))]


NESTED = """<ul class='board'><li class=row><a href='1'>Post one</a><ul><li><a href='f/1.pdf'>attach</a></li></ul> tail <a href='f/2.PDF'>b</a></li>
<li class=row><a href='2'>Post two</a></li></ul>"""


def test_nested_rows_keep_their_tail(spark):
    by = lambda rows, **more: [(i.title, i.url, i.attachment_urls) for i in _board(spark, NESTED, rows=rows, **more)["items"]]
    one = ("Post one", "http://h.kr/l/1", ["http://h.kr/l/f/1.pdf", "http://h.kr/l/f/2.PDF"])
    inner = ("attach", "http://h.kr/l/f/1.pdf", ["http://h.kr/l/f/1.pdf"])
    two = ("Post two", "http://h.kr/l/2", [])
    assert by("ul.board > li") == by("li.row") == [one, two]
    assert by(".board li") == [one, inner, two]
    assert by("li li") == [inner]
    assert by("li.row", title="li ul a") == [("attach", one[1].replace("/1", "/f/1.pdf"), one[2]), two]
    same = _board(spark, "<div class='l'><div class='l'><p class=r><a href=1>in</a></div><p class=r><a href=2>after</a></div><p class=r><a href=3>out</a>", rows=".l > p.r")
    assert [i.title for i in same["items"]] == ["in", "after"]


def test_tables_without_end_tags_and_within_cells(spark):
    body = """<table class=board_list><tbody><tr><td>1<td><a href=1>a</a><table><tbody><tr><td>2020-01-02</table><td>2021.03.04<tr><td><a href=2>b</a><td> 2022/5/6 x</tbody></table>"""
    assert [(i.title, str(i.published_date)) for i in _board(spark, body, rows="table.board_list > tbody > tr")["items"]] == [("a", "2020-01-02"), ("b", "2022-05-06")]
    assert [i.title for i in _board(spark, "<table class=board_list><tr><td><a href=1>no body</a></table>")["items"]] == []
    odd = "</li></div><!-- <li><a href=0>c</a> --><script>'<li><a href=1>s</a>'</script><ul><li a='>'><a href='2' title='x > y'>t</a><li><br/><a\nHREF=3 / >u"
    assert [(i.title, i.url) for i in _board(spark, odd, rows="li")["items"]] == [("x > y", "http://h.kr/l/2"), ("u", "http://h.kr/l/3")]


def test_a_title_within_its_link(spark):
    body = "<a href='/out'><div class=r><h4>head</h4><i>2020-01-01</i></div></a><div class=r><a href=in><h4>two</h4></a><a class=go href=go>go</a></div>"
    assert [(i.title, i.url) for i in _board(spark, body, rows=".r", title="h4")["items"]] == [("head", "http://h.kr/out"), ("two", "http://h.kr/l/in")]
    assert [(i.url, i.published_date) for i in _board(spark, body, rows=".r", title="h4", link="a.go", date="i")["items"]] == [("http://h.kr/out", date(2020, 1, 1)), ("http://h.kr/l/go", None)]


def test_selectors_of_the_registry_and_new_ones(evaluate):
    page = """<table class=board_list><tbody><tr id=r1><td><a class='text-table-ellipsis x' href='?boardSeq=1'>a</a></td></tr></tbody></table><div class=board-list-wrap><ul><li id=l1><p class=subject><a id=s1>x</a></p>
<ol><li id=l2></li></ol></li></ul></div><div class='board_type01 w'><ul><li id=l3><span class=src>d</span></li></ul></div><div class=com_list_box><ul><li id=l4><b class=title><a id=t1></a></b></li></ul></div>
<div class=data_list_area><ul class=list><li><i class=text id=d1></i></li><li><i class=text id=d2></i></li></ul></div>"""
    want = {
        "table tbody tr": ["r1"], "tbody tr": ["r1"], ".board-list-wrap > ul > li": ["l1"], ".board_type01 li": ["l3"], ".com_list_box > ul > li": ["l4"], ".subject a": ["s1"], ".title a": ["t1"],
        "span.src": [None], "a.text-table-ellipsis": [None], "a[href*='boardSeq']": [None], ".data_list_area .list li:first-child .text": ["d1"], "a": [None, "s1", "t1"],
        "div li[id]": ["l1", "l2", "l3", "l4"], "#l1 > ol>li": ["l2"], "*[id^=d][class$='xt']": ["d1", "d2"], "i.text:first-child": ["d1", "d2"], "ul ul li": [], "div[class~=w] ul": [None],
    }
    known = {s for _, _, _, _, _, _, _, _, by, _ in registry.TARGETS for s in by if s}
    assert known <= set(want)
    found = structure.elements(page)
    assert {s: [e.get("id") for e in structure.selected(found, s)] for s in want} == want
    assert evaluate(structure.is_selector, [*want, "", None]) == [True] * (len(want) + 2)
    assert evaluate(structure.is_selector, ["a:hover", "a, b", "a + b", "a >", "> a", "a[b", "a..b", "a::before"]) == [False] * 8


def test_frontier(spark):
    rows = [(1, 1, 200, 2), (1, 2, 200, 0), (1, 3, 200, 5), (2, 1, 500, 0), (3, 1, 200, 1), (3, 2, 200, 1), (4, 1, 200, 1), (4, 2, 404, 0), (4, 3, 200, 1)]
    pages = spark.createDataFrame(rows, "config_id long, page_num int, http_status int, matched int")
    kept = sorted((r.config_id, r.page_num) for r in followed(pages).collect())
    assert kept == [(1, 1), (3, 1), (3, 2), (4, 1)]


RSS = """<?xml version="1.0"?><rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>c</title>
<item><title> 보안 가이드라인 &amp; 해설 </title><link>http://h/1</link><pubDate>Wed, 15 Apr 2026 08:30:00 +0900</pubDate><category>정책</category>
<enclosure url="http://h/a.PDF"/><enclosure url="http://h/a.hwp"/></item>
<item><title>행사 안내</title><link>http://h/2</link><dc:date>2026-04-10T00:00:00Z</dc:date></item>
<item><title>링크 없음</title></item>
<item><title>지침</title><guid>http://h/4</guid></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>f</title><entry><title>지침 개정</title>
<link rel="self" href="http://h/self"/><link href="http://h/9"/><link rel="enclosure" href="http://h/z.pdf"/>
<updated>2026-04-15T01:00:00Z</updated><category term="보안"/></entry></feed>"""


def test_broken_feeds_keep_their_entries(spark):
    head, tail = '<rss version="2.0"><channel><title>c</title>', "</channel></rss>"
    one = lambda title, n=1: f"<item><title>{title}</title><link>http://h/{n}?a=1&b=2</link></item>"
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>가 &nbsp;나 & 다</title><link href="http://h/9"/></entry><entry><title>cut'
    bodies = [
        head + one("A & B") + one("C", 2) + tail, head + one("A&nbsp;B &sect; &#167; &#0;") + tail, head + one("끝") + "<item><title>cut",
        head + one("<![CDATA[A & B <b>]]> & &lt;C&gt;") + tail, atom, head + "<item><title>", head + one("&#60;i&#62; &#38;amp;") + tail,
    ]
    df = spark.createDataFrame(list(enumerate(bodies)), "i int, b string").repartition(2)
    none = F.array().cast("array<string>")
    got = [([x.title for x in r.p["items"] or []], r.p.error) for r in df.select("i", feed_page(F.col("b"), none).alias("p")).orderBy("i").collect()]
    assert got == [
        (["A & B", "C"], None), (["A\xa0B § § \ufffd"], None), (["끝"], None), (["A & B <b> & <C>"], None), (["가 \xa0나 & 다"], None),
        ([], "feed could not be parsed"), (["<i> &amp;"], None),
    ]


def test_feeds(spark):
    df = spark.createDataFrame([(0, RSS, []), (1, ATOM, []), (2, RSS, ["가이드라인"]), (3, "<rss><channel><item>", []), (4, "<rss><channel/></rss>", [])], "i int, b string, k array<string>")
    got = [r.p for r in df.repartition(2).select("i", feed_page(F.col("b"), F.col("k")).alias("p")).orderBy("i").collect()]
    assert [(i.title, i.url, i.published_date, i.category, i.attachment_urls) for i in got[0]["items"]] == [
        ("보안 가이드라인 & 해설", "http://h/1", date(2026, 4, 14), "정책", ["http://h/a.PDF"]),
        ("행사 안내", "http://h/2", date(2026, 4, 10), None, []),
        ("지침", "http://h/4", None, None, []),
    ]
    assert [(i.title, i.url, i.published_date, i.category, i.attachment_urls) for i in got[1]["items"]] == [
        ("지침 개정", "http://h/9", date(2026, 4, 15), "보안", ["http://h/z.pdf"]),
    ]
    assert [i.title for i in got[2]["items"]] == ["보안 가이드라인 & 해설"]
    assert got[3].error and not got[3]["items"]
    assert got[4].error is None and not got[4]["items"]


def _law(*rules):
    import json

    return json.dumps({"AdmRulSearch": {"totalCnt": str(len(rules)), "admrul": rules[0] if len(rules) == 1 else list(rules)}}, ensure_ascii=False)


def _rule(title, serial, kind="고시", day="20260415", link=""):
    return {"행정규칙명": title, "행정규칙일련번호": serial, "행정규칙종류": kind, "발령일자": day, "시행일자": "20260501", "행정규칙상세링크": link, "소관부처명": " 부처 "}


def test_admin_rules(spark):
    many = _law(_rule("개인정보 처리 고시", "1"), _rule("개인정보 처리 고시 사본", "1"), _rule("회의 규칙", "2"), _rule("암호 예규", "", "예규", "bad", "/x?y"), _rule("암호 훈령", "", "훈령"))
    pages = spark.createDataFrame(
        [("PIPC", 1, 200, many), ("MSIT", 1, 200, _law(_rule("데이터 기준", "7"))), ("FSC", 1, 200, '{"result":"사용자 정보 검증에 실패하였습니다."}'),
         ("NIA", 1, 200, '{"AdmRulSearch":{"totalCnt":"0"}}'), ("ZZZ", 1, 200, many), ("KCC", 1, 503, ""), ("MOIS", 1, 200, "not json")],
        "agency_code string, page_num int, http_status int, body string",
    ).repartition(3)
    got = sorted((r.agency_code, r.pos, r.title, r.rule_type, r.promulgation_date, r.law_api_id, r.source_url) for r in admin_rules(pages).collect())
    assert got == [
        ("MSIT", 0, "데이터 기준", "고시", date(2026, 4, 15), "7", "https://www.law.go.kr/행정규칙/데이터 기준"),
        ("PIPC", 0, "개인정보 처리 고시", "고시", date(2026, 4, 15), "1", "https://www.law.go.kr/행정규칙/개인정보 처리 고시"),
        ("PIPC", 2, "암호 예규", "예규", None, "", "https://www.law.go.kr/x?y"),
        ("PIPC", 3, "암호 훈령", "훈령", date(2026, 4, 15), "", "https://www.law.go.kr/행정규칙/암호 훈령"),
    ]
    assert admin_rules(pages, 1).count() == 2


def test_registry(spark):
    publishers = registry.publishers(spark)
    assert publishers.count() == 11
    targets = registry.targets(spark)
    assert targets.count() == 28 and targets.where("label is null").select("code").first().code == "TTA"
    counts = {r.schedule: r["count"] for r in targets.where("label is not null").groupBy("schedule").count().collect()}
    assert counts == {"daily": 5, "weekly": 18, "monthly": 4}
    assert targets.where("item_type = 'announcement'").count() == 10
    assert registry.publisher(spark, "KISA").first().short_name == "KISA"
    assert registry.first_profile(registry.detail_profiles(spark), "FSI").first().baseline_id == 11900
    assert registry.keyword_lists(spark).groupBy("kind").count().count() == 2


def test_last_ids_and_worklist(spark):
    profiles = registry.detail_profiles(spark).withColumn("agency_id", F.lit(10).cast("bigint"))
    stored = spark.createDataFrame(
        [(10, "https://www.fsec.or.kr/bbs/detail?menuNo=222&bbsNo=11950"), (10, "https://www.fsec.or.kr/bbs/detail?menuNo=69&bbsNo=100"),
         (10, None), (11, "https://x?menuNo=222&bbsNo=99999")],
        "agency_id long, source_url string",
    )
    last = last_ids(profiles, stored)
    assert {r.list_url[-3:]: r.last_id for r in last.collect()} == {"222": 11950, "=69": 11500}
    work = worklist(last)
    assert work.count() == 300
    assert work.where("seq_id = 11951 and list_url like '%222'").first().url == "https://www.fsec.or.kr/bbs/detail?menuNo=222&bbsNo=11951"


def test_time_of_a_listing_follows_its_rows():
    """Eight times the rows take some eight times as long, not 64 times."""
    import time

    how = [structure.compiled(x) for x in ("tr", "td > a", "td", "td a")]

    def seconds(n: int) -> float:
        html = "<table>" + "<tr><td><a href='v.pdf'>x</a><td>2024-01-01" * n + "</table>"
        began = time.perf_counter()
        assert len(list(structure._pieces(html, [], *how))) == n
        return time.perf_counter() - began

    seconds(100)
    assert seconds(12_000) < 24 * min(seconds(1_500) for _ in range(3))


def test_rows_are_dealt_out_to_tasks_of_bounded_size(spark, monkeypatch):
    from workload import roles

    assert roles.dealt(spark.range(40)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(roles, "DEALT_ROWS", 2)
    sizes = roles.dealt(spark.range(40)).rdd.glom().map(len).collect()
    assert len(sizes) == 20 and sum(sizes) == 40


def test_dates_and_paths_beside_the_short_cuts(evaluate):
    from revtrack.functions.dates import date_from_text
    from revtrack.functions.urls import resolve_url

    days = [str(d) if d else None for d in evaluate(date_from_text, ["at 2024.1/02.", "2024-13-01", "no day", "", None, "20240102", "x 1-2-3 2024/12/31"])]
    assert days == ["2024-01-02", None, None, None, None, "2024-01-02", "2024-12-31"]
    got = evaluate(lambda h: resolve_url(F.lit("http://h/a/b"), h), ["c", "./c", "../c/.", "/x//y", "..", "c/.d/..e", None])
    assert got == ["http://h/a/c", "http://h/a/c", "http://h/c/", "http://h/x//y", "http://h/", "http://h/a/c/.d/..e", None]
    tags = evaluate(lambda t: html.attribute(t, "title"), ['<a TITLE="x &amp; y">', "<a x=title>", '<a href="/title">', "<a title=z>", None])
    assert tags == ["x & y", None, None, "z", None]

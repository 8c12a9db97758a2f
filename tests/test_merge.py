"""Revision upsert against a plain sequential replay, and the joins around it."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from revtrack.functions.rules import categorize
from revtrack.operators import merge as merging
from revtrack.operators.lookups import (
    absent, load_tally, mark_existing, mark_legal_bases, mark_titled_alike, titled_alike, with_agency, with_count,
)
from revtrack.operators.merge import decide, with_ids
from revtrack.operators.pick import first_per_url, latest_run_per_config, top_per_key
from revtrack.operators.scoring import accept_items, score_borderline, with_snippets
from revtrack.session import stage

AS_OF = datetime(2026, 5, 1, 9)
ITEMS = (
    "agency_id long, config_id long, seq long, title string, url string, published_date date, "
    "attachment_urls array<string>, item_type string, accepted boolean, scored boolean"
)
GUIDELINES = "id long, agency_id long, title string, source_url string, item_type string"
VERSIONS = "id long, guideline_id long, published_date date"


def replay(items, guidelines, versions):
    """One agency, one post after the other. Titles here carry no suffix: the title is its own key."""
    by_url = {}
    by_title = {}
    types = {}
    for g in sorted(guidelines):
        gid, _, title, url, kind = g
        if url:
            by_url[url] = gid
        by_title[title] = (gid, {d for _, g2, d in versions if g2 == gid})
        types[gid] = kind
    new, editions = [], []
    tally = dict(new=0, updated=0, skipped=0, filtered=0)
    for it in sorted(items, key=lambda i: (i[1], i[2])):
        _, _, _, title, url, day, _, kind, ok, _ = it
        day = day or AS_OF.date()
        if not ok:
            tally["filtered"] += 1
        elif url in by_url:
            types[by_url[url]] = kind
            tally["skipped"] += 1
        elif title in by_title:
            gid, days = by_title[title]
            if day in days:
                tally["skipped"] += 1
                continue
            editions.append((title, day, url))
            types[gid] = kind
            by_url[url] = gid
            days.add(day)
            tally["updated"] += 1
        else:
            gid = "new:" + title
            new.append((title, url))
            editions.append((title, day, url))
            types[gid] = kind
            by_url[url] = gid
            by_title[title] = (gid, {day})
            tally["new"] += 1
    return sorted(new), sorted(editions), types, tally


def test_random_batches_equal_the_replay(spark):
    rng = random.Random(7)
    days = [date(2026, 1, d) for d in (1, 2, 3)] + [None]
    items, stored, versions = [], [], []
    for agency in range(1, 241):
        titles = [f"t{x} 가이드" for x in "abcd"[: rng.randint(1, 4)]]
        urls = ["", *[f"u{i}" for i in range(rng.randint(1, 5))]]
        for _ in range(rng.randint(0, 3)):
            gid = len(stored) + 1
            stored.append((gid, agency, rng.choice(titles), rng.choice([None, *urls]), "guideline"))
            for day in rng.sample(days[:3], rng.randint(0, 2)):
                versions.append((len(versions) + 1, gid, day))
        for n in range(rng.randint(1, 9)):
            items.append(
                (agency, rng.randint(1, 2), n, rng.choice(titles), rng.choice(urls), rng.choice(days), [],
                 rng.choice(["guideline", "announcement"]), rng.random() > 0.1, False)
            )
    df = spark.createDataFrame(items, ITEMS).repartition(5)
    merge = decide(df, spark.createDataFrame(stored, GUIDELINES), spark.createDataFrame(versions, VERSIONS), AS_OF)

    new, editions, tallies, types = {}, {}, {}, {}
    for r in merge.new_titles.collect():
        new.setdefault(r.agency_id, []).append((r.title, r.url))
        types[(r.agency_id, "new:" + r.title)] = r.item_type
    for r in merge.editions.collect():
        editions.setdefault(r.agency_id, []).append((r.norm_title, r.pub_date, r.url))
    owner = {g[0]: g[1] for g in stored}
    for r in merge.types.collect():
        types[(owner[r.guideline_id], r.guideline_id)] = r.item_type
    for r in merge.tallies.collect():
        t = tallies.setdefault(r.agency_id, dict(new=0, updated=0, skipped=0, filtered=0))
        for k in t:
            t[k] += r[k]
    for agency in {i[0] for i in items}:
        mine = [g for g in stored if g[1] == agency]
        want = replay([i for i in items if i[0] == agency], mine, versions)
        assert sorted(new.get(agency, [])) == want[0], agency
        assert sorted(editions.get(agency, [])) == want[1], agency
        assert tallies[agency] == want[3], agency
        for gid, kind in want[2].items():
            stored_kind = next((g[4] for g in mine if g[0] == gid), None)
            assert types.get((agency, gid), stored_kind) == kind, (agency, gid)


def _chain(spark, n, agency=1):
    """Posts of which each shares its url with the one before or its day with the one after."""
    day = lambda k: date(2000, 1, 1) + timedelta(days=k)
    posts = [(agency, 1, k, "T 가이드", f"u{k // 2}", day((k + 1) // 2), [], "guideline", True, False) for k in range(n)]
    return spark.createDataFrame(posts, ITEMS).repartition(3), spark.createDataFrame([], GUIDELINES), spark.createDataFrame([], VERSIONS)


@pytest.mark.parametrize("bound", [500_000, 20])
def test_chains_of_any_length_take_the_same_writes(spark, monkeypatch, bound):
    writes = []
    monkeypatch.setattr(merging, "CHAINED", bound)
    monkeypatch.setattr(merging, "stage", lambda df: writes.append(1) or stage(df))
    for n in (5, 40) if bound == 20 else (5, 2_000):
        writes.clear()
        items, stored, versions = _chain(spark, n)
        got = sorted((r.pub_date, r.url) for r in merging.decide(items, stored, versions, AS_OF).editions.collect())
        urls, days, want = set(), set(), []
        for r in sorted(items.collect(), key=lambda r: r.seq):
            if r.url not in urls and r.published_date not in days:
                urls.add(r.url), days.add(r.published_date), want.append((r.published_date, r.url))
        assert got == sorted(want) and len(want) > n // 3
        assert bound == 20 or len(writes) == 6


def test_one_agency_scenario_and_its_repeat(spark):
    posts = [
        (1, "A 가이드 2025", "u1", date(2026, 1, 1)), (2, "A 가이드 v2.0", "u2", date(2026, 2, 1)),
        (3, "A 가이드 (재게시)", "u3", date(2026, 2, 1)), (4, "B 안내서", "u4", None), (5, "B 안내서", "u4", None),
        (6, "세미나 안내", "u5", date(2026, 3, 1)), (7, "업무보고", "u6", date(2026, 3, 1)),
    ]
    rows = [(1, 1, n, t, u, d, ["x.hwp", "y.pdf"], "guideline") for n, t, u, d in posts]
    items = accept_items(spark.createDataFrame(rows, ITEMS.split(", accepted")[0]))
    stored = spark.createDataFrame([(1, 1, "A 가이드", "u1", "guideline")], GUIDELINES)
    versions = spark.createDataFrame([(1, 1, date(2025, 1, 1))], VERSIONS)
    merge = decide(items, stored, versions, AS_OF)
    t = merge.tallies.first()
    assert (t.found, t.new, t.updated, t.skipped, t.filtered) == (7, 1, 1, 3, 2)
    got = sorted((r.norm_title, r.guideline_id, r.version_label, r.pub_date, r.pdf_url) for r in merge.editions.collect())
    assert got == [("A 가이드", 1, "v2.0", date(2026, 2, 1), "y.pdf"), ("B 안내서", None, None, date(2026, 5, 1), "y.pdf")]

    guidelines = stored.unionByName(
        merge.new_titles.select(F.lit(2).cast("bigint").alias("id"), "agency_id", "title", F.col("url").alias("source_url"), "item_type")
    )
    more = merge.editions.select(F.lit(9).cast("bigint").alias("id"), F.coalesce("guideline_id", F.lit(2)).alias("guideline_id"), F.col("pub_date").alias("published_date"))
    again = decide(items, stage(guidelines), stage(versions.unionByName(more)), AS_OF).tallies.first()
    assert (again.new, again.updated, again.skipped, again.filtered) == (0, 0, 5, 2)


def test_scorer_sees_borderline_posts_only(spark):
    rows = [(1, 1, n, t, f"u{n}", None, [], kind) for n, (t, kind) in enumerate(
        [("보안 안내서", "guideline"), ("업무보고", "guideline"), ("로드맵", "guideline"), ("세미나 안내", "guideline"), ("행사", "announcement"), ("고장", "guideline")])]
    items = spark.createDataFrame(rows, ITEMS.split(", accepted")[0]).withColumn("label", F.lit("게시판")).withColumn("agency_name", F.lit("기관"))

    def scorer(questions):
        if questions.str.contains("고장").any():
            raise RuntimeError("down")
        return questions.str.contains("제목: 로드맵").map({True: "YES", False: "NO"})

    got = {r.title: (r.accepted, r.scored) for r in accept_items(items, scorer).collect()}
    assert got == {
        "보안 안내서": (True, False), "업무보고": (False, True), "로드맵": (True, True), "세미나 안내": (False, False),
        "행사": (True, False), "고장": (False, True),
    }
    assert {r.title for r in accept_items(items).where("accepted").collect()} == {"보안 안내서", "행사"}


def test_the_scorer_sees_the_post_s_own_page_and_python_its_question_only(spark):
    rows = [(1, 1, n, t, f"u{n}", None, [], "guideline") for n, t in enumerate(["업무보고", "로드맵", "보안 안내서", "계획", "업무 하나"])]
    items = spark.createDataFrame(rows, ITEMS.split(", accepted")[0]).withColumn("label", F.lit("게시판")).withColumn("agency_name", F.lit("기관"))
    bodies = spark.createDataFrame(
        [("u0", "<main>표준 문서 첨부 계획.hwp</main>", 1), ("u1", "<main>소식</main>", 1), ("u2", "<main>표준</main>", 1), ("u4", "<main>표준</main>", 1), ("u4", "<main>새 소식</main>", 2), ("", "<main>표준</main>", 1)],
        "url string, body string, fetched_at long",
    )
    scorer = lambda q: q.str.contains("본문 첫 500자: 표준").map({True: "yes", False: "no"})
    got = {r.title: (r.accepted, r.scored) for r in accept_items(items, scorer, bodies=bodies).collect()}
    assert got == {"업무보고": (True, True), "로드맵": (False, True), "보안 안내서": (True, False), "계획": (False, True), "업무 하나": (False, True)}
    shown = with_snippets(items, bodies)
    told = {r.title: r.reason for r in score_borderline(shown, scorer, "_snippet").collect()}
    assert told["업무보고"] == "LLM=YES | 첨부=.hwp" and told["계획"] == "LLM=NO | 본문추출실패"
    plan = score_borderline(shown, scorer, "_snippet")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "MapInPandas" not in plan


def test_ids_are_dense_and_unique(spark):
    rows = with_ids(spark.range(1000).withColumnRenamed("id", "v").repartition(7), 41).collect()
    assert sorted(r.id for r in rows) == list(range(42, 1042))


def test_first_per_url_keeps_rows_without_url(spark):
    df = spark.createDataFrame([(1, "a", 0), (1, "a", 1), (1, "", 2), (1, "", 3), (2, "a", 4), (1, None, 5)], "c int, url string, seq int")
    assert sorted(r.seq for r in first_per_url(df, ["c"], ["seq"]).collect()) == [0, 2, 3, 4, 5]
    assert "WindowGroupLimit" in first_per_url(df, ["c"], ["seq"])._jdf.queryExecution().toString()


def test_latest_run_keeps_the_first_of_equals(spark):
    t = [datetime(2026, 1, d) for d in (1, 2)]
    runs = spark.createDataFrame([(1, 5, t[0]), (2, 5, t[1]), (3, 5, t[1]), (4, None, t[1])], "id long, config_id long, started_at timestamp")
    assert [r.id for r in latest_run_per_config(runs).collect()] == [2]
    assert sorted(r.id for r in top_per_key(runs, ["config_id"], [F.desc("started_at"), "id"], 2).collect()) == [2, 3, 4]


def test_default_lookups(spark):
    agencies = spark.createDataFrame([(1, "A", "a")], "id long, code string, short_name string")
    df = spark.createDataFrame([(1, 1), (2, 9)], "id long, agency_id long")
    assert sorted((r.id, r.agency_code, r.agency_name) for r in with_agency(df, agencies).collect()) == [(1, "A", "a"), (2, "?", "?")]
    counts = spark.createDataFrame([(1, 3)], "id long, n long")
    assert sorted((r.id, r.n) for r in with_count(df, counts, "id", "n").collect()) == [(1, 3), (2, 0)]


def test_insert_if_absent(spark):
    new = spark.createDataFrame([("A",), ("B",)], "code string")
    old = spark.createDataFrame([("A",), ("A",)], "code string")
    assert [r.code for r in absent(new, old, ["code"]).collect()] == ["B"]
    t = load_tally(mark_existing(new, old, ["code"])).first()
    assert (t.searched, t.created, t.skipped) == (2, 1, 1)


def test_titled_alike_equals_ilike(spark):
    stored = [(1, "Guide to the 100% secure_cloud platform, second edition"), (1, "x"), (2, "가이드라인 모음"), (3, "back\\slash"), (4, "")]
    asked = [
        (1, 1, "SECURE_CLOUD"), (2, 1, "secure cloud"), (3, 1, "100%cloud"), (4, 2, "가이드"), (5, 2, "Guide"), (6, 1, "s_cure"), (7, 3, "k\\s"),
        (8, 1, "Guide to the 100% secure_cloud platform, third edition"), (9, 1, "Guide to the 100% secure_cloxd"), (10, 1, "%"), (11, 4, "%%"), (12, 5, "%"), (13, 2, "모음 "),
    ]
    s = spark.createDataFrame(stored, "agency_id long, title string")
    a = spark.createDataFrame(asked, "k long, agency_id long, title string")
    want = {
        r.k for r in a.alias("a").join(s.alias("s"), "agency_id")
        .where("lower(s.title) like concat('%', regexp_replace(lower(substring(a.title,1,30)), '\\\\\\\\(?![%_\\\\\\\\])', ''), '%')").select("k").collect()
    }
    assert {r.k for r in titled_alike(a, s, "k").collect()} == want
    assert {1, 3, 4, 6, 8, 10, 11} <= want and not {5, 12, 13} & want
    assert load_tally(mark_titled_alike(a, s, "k")).first().skipped == len(want)


def test_legal_bases_by_id_else_title(spark):
    stored = spark.createDataFrame([(1, "7", "a"), (1, None, "b")], "agency_id long, law_api_id string, title string")
    rules = spark.createDataFrame(
        [(2, 0, "7", "z"), (1, 1, None, "b"), (2, 2, None, "b"), (1, 3, "8", "c"), (2, 4, "8", "c"), (1, 5, "9", "b"), (1, 6, "", "d"), (1, 7, None, "d")],
        "agency_id long, seq long, law_api_id string, title string",
    )
    got = {r.seq: r.exists for r in mark_legal_bases(rules, stored).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 4: True, 5: False, 6: False, 7: True}


def test_category_of_a_new_document_ignores_the_agency(spark):
    assert spark.range(1).select(categorize(F.lit("업무보고")).alias("c")).first().c == "other"

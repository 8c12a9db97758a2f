"""Landed pages to store: all routes, failures, replay, stream against batch, seeding, manifest."""

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from revtrack.operators.quality import check_store
from revtrack.operators.seeding import seed_agencies, seed_documents, seed_legal_bases
from revtrack.plans.ingest import ingest, posts_of, scan_tally
from revtrack.plans.reports import crawl_health, run_result, run_summary
from revtrack.sources import curated, registry
from revtrack.sources.landing import extract_pages, read_pages, routed_configs
from revtrack.sources.manifest import manifest_document, write_manifest
from revtrack.sources.store import Store, read_table
from revtrack.schemas import RAW_PAGES, STORE
from revtrack.streaming.incremental import ingest_stream

from test_pages import RSS, _law, _rule

DAY = datetime(2026, 5, 1, 6)
KISA = "https://www.kisa.or.kr/2060204"


def _rows(*posts):
    return "<table><tbody>" + "".join(f"<tr><td><a href='{u}'>{t}</a></td><td>{d}</td></tr>" for t, u, d in posts) + "</tbody></table>"


PAGE1 = _rows(("보안 안내서 2025", "v?n=1", "2026-04-01"), ("보안 안내서 2024", "v?n=2", "2025-04-01"), ("업무보고", "v?n=3", "2026-04-01"))
PAGE2 = _rows(("보안 안내서 2025", "v?n=1", "2026-04-01"), ("점검표", "v?n=4", ""), ("세미나 안내", "v?n=5", ""))
DETAIL = '<div class="titleBox"><h3> 보안 해설서 </h3><span class="date">2026-04-20</span></div><a fileNo="77" filePage="board">a.pdf</a><a fileNo="78" filePage="board">a.png</a>'
PUBS = (
    '<img class="border-gray01" src="x" alt="사이버<br>가이드라인"><a href="/common/download.do?seq=AB12">d</a>등록일자 <b>2026-03-01</b>'
    '<img class="border-gray01" src="x" alt="사이버 가이드라인"><a href="/common/download.do?seq=AB12">d</a>'
    '<img class="border-gray01" src="x" alt="화보"><a href="/common/download.do?seq=CD34">d</a>'
)


@pytest.fixture(scope="module")
def seeded(spark, tmp_path_factory):
    store = Store(spark, str(tmp_path_factory.mktemp("store")))
    tally = seed_agencies(store, registry.publishers(spark), DAY).first()
    assert (tally.searched, tally.created, tally.skipped) == (11, 11, 0)
    assert seed_agencies(store, registry.publishers(spark), DAY).first().created == 0
    return store


def _pages(spark, store):
    ids = {(r.code, r.url): r.id for r in store.read("crawl_configs").join(store.read("agencies").select(F.col("id").alias("agency_id"), "code"), "agency_id").collect()}

    def cid(code, url):
        return ids[(code, url)]

    rss, law = "https://www.fsc.go.kr/about/fsc_bbs_rss/?fid=0111", "https://www.law.go.kr"
    fsi, nis = "https://www.fsec.or.kr/bbs/list?menuNo=222", "https://www.nis.go.kr:4016/AF/1_7_7_1.do"
    rows = [
        (cid("KISA", KISA), "KISA", 1, KISA, 200, PAGE1), (cid("KISA", KISA), "KISA", 2, KISA + "?page=2", 200, PAGE2),
        (cid("KISA", KISA), "KISA", 3, KISA + "?page=3", 200, "<p>끝</p>"), (cid("KISA", KISA), "KISA", 4, KISA, 200, _rows(("매뉴얼", "v?n=9", ""))),
        (cid("KISA", "https://www.kisa.or.kr/2060205"), "KISA", 1, "x", 503, None),
        (cid("FSC", rss), "FSC", 1, rss, 200, RSS), (cid("MOIS", "https://www.mois.go.kr/gpms/view/jsp/rss/rss.jsp?ctxCd=1012"), "MOIS", 1, "x", 200, "<rss><chan"),
        (cid("FSI", fsi), "FSI", 11901, "x", 200, DETAIL), (cid("FSI", fsi), "FSI", 11902, "x", 404, None),
        (cid("FSI", fsi), "FSI", 11903, "x", 200, "요청하신 페이지에서 오류가 발생"), (cid("FSI", fsi), "FSI", 11904, "x", 200, DETAIL.replace("해설서", "그림책")),
        (cid("NIS", nis), "NIS", 1, nis, 200, PUBS),
        (cid("MSIT", law), "MSIT", 1, law, 200, _law(_rule("데이터 관리 지침", "7"), _rule("데이터 관리 지침 안", "7"))),
        (cid("KCC", law), "KCC", 1, law, 200, '{"result":"사용자 정보 검증에 실패하였습니다."}'),
        (999, "XXX", 1, "x", 200, "x"),
    ]
    return spark.createDataFrame([(*r, DAY, None) for r in rows], RAW_PAGES)


def test_routes(spark, seeded):
    routed = routed_configs(seeded.read("crawl_configs"), seeded.read("agencies"), registry.detail_profiles(spark), registry.page_profiles(spark))
    counts = {r.route: r["count"] for r in routed.groupBy("route").count().collect()}
    assert counts == {"publications": 2, "detail": 2, "rss": 2, "law_api": 2, "bbs_list": 19}
    odd = seeded.read("crawl_configs").withColumn("source_type", F.lit("ftp")).where("url like '%2060204'")
    row = extract_pages(spark.createDataFrame([(r.id, "KISA", 1, "x", 200, "x", DAY, "c") for r in odd.collect()], RAW_PAGES), odd, seeded.read("agencies")).first()
    assert row.error == "Unsupported source type: ftp"


def test_posts_of_every_route(spark, seeded):
    pages = extract_pages(_pages(spark, seeded), seeded.read("crawl_configs"), seeded.read("agencies"))
    batch = posts_of(pages)
    got = sorted((r.agency_code, r.title, r.url, r.published_date, r.attachment_urls) for r in batch.items.collect())
    assert got == [
        ("FSC", "보안 가이드라인 & 해설", "http://h/1", date(2026, 4, 14), ["http://h/a.PDF"]),
        ("FSC", "지침", "http://h/4", None, []),
        ("FSC", "행사 안내", "http://h/2", date(2026, 4, 10), []),
        ("FSI", "보안 해설서", "https://www.fsec.or.kr/bbs/detail?menuNo=222&bbsNo=11901", date(2026, 4, 20), ["https://www.fsec.or.kr/bbs/downloadFile?fileNo=77&filePage=board"]),
        ("KISA", "보안 안내서 2024", "https://www.kisa.or.kr/v?n=2", date(2025, 4, 1), []),
        ("KISA", "보안 안내서 2025", "https://www.kisa.or.kr/v?n=1", date(2026, 4, 1), []),
        ("KISA", "세미나 안내", "https://www.kisa.or.kr/v?n=5", None, []),
        ("KISA", "업무보고", "https://www.kisa.or.kr/v?n=3", date(2026, 4, 1), []),
        ("KISA", "점검표", "https://www.kisa.or.kr/v?n=4", None, []),
        ("MSIT", "데이터 관리 지침", "https://www.law.go.kr/행정규칙/데이터 관리 지침", date(2026, 4, 15), []),
        ("NIS", "사이버 가이드라인", "https://www.nis.go.kr:4016/common/download.do?seq=AB12", date(2026, 3, 1), ["https://www.nis.go.kr:4016/common/download.do?seq=AB12"]),
    ]
    errors = sorted(r.error for r in batch.errors.collect())
    assert errors == ["Page 1 fetch failed: HTTP 503", "feed could not be parsed", "law search refused the request", "no active config for XXX"]
    scan = scan_tally(batch.pages).first()
    assert (scan.scanned, scan.existing, scan.matched) == (4, 2, 1)


def _state(store):
    docs = sorted((r.agency_id, r.title, r.item_type, r.category, r.source_url) for r in store.read("guidelines").collect())
    titles = {r.id: (r.agency_id, r.title) for r in store.read("guidelines").collect()}
    versions = sorted((titles[r.guideline_id], r.published_date, r.version_label or "") for r in store.read("guideline_versions").collect())
    return docs, versions


def test_ingest_replay_and_stream(spark, seeded, tmp_path):
    pages = _pages(spark, seeded)
    first = Store(spark, str(tmp_path / "a"))
    seed_agencies(first, registry.publishers(spark), DAY)
    tallies = ingest(first, pages, DAY, ("job", 1))
    total = tallies.agg(*[F.sum(c).alias(c) for c in ("found", "new", "updated", "skipped", "filtered")]).first()
    assert tuple(total) == (11, 7, 1, 0, 3)
    docs, versions = _state(first)
    assert len(docs) == 7 and len(versions) == 8
    assert ("보안 안내서 2025", date(2025, 4, 1), "2024년") in [(v[0][1], v[1], v[2]) for v in versions]

    assert ingest(first, pages, DAY, ("job", 1)) is None
    again = ingest(first, pages, DAY)
    assert again.agg(F.sum("new") + F.sum("updated")).first()[0] == 0
    assert _state(first) == (docs, versions)

    runs = first.read("crawl_runs")
    assert runs.count() == 2 * 8 and runs.select("id").distinct().count() == 16
    failed = {r.error_message for r in runs.where("status = 'failed'").collect()}
    assert failed == {"Page 1 fetch failed: HTTP 503", "feed could not be parsed", "law search refused the request"}
    result = run_result(runs, first.read("crawl_configs"), first.read("agencies"))
    assert run_summary(result).first().total_items == 22
    health = {r.agency_code: r.issue for r in crawl_health(first.read("agencies"), first.read("crawl_configs"), runs, DAY).collect()}
    assert health["KCC"] == "all_failed" and health["TTA"] == "never_crawled" and "KISA" not in health

    # The same pages in three files, one per micro-batch, give the same store.
    landing = str(tmp_path / "landing")
    for part in ("agency_code = 'KISA'", "agency_code in ('FSC','FSI')", "agency_code not in ('KISA','FSC','FSI')"):
        pages.where(part).coalesce(1).write.mode("append").parquet(landing)
    assert read_pages(spark, landing).count() == pages.count()
    second = Store(spark, str(tmp_path / "b"))
    seed_agencies(second, registry.publishers(spark), DAY)
    for _ in range(2):
        query = ingest_stream(spark, landing, second.root, str(tmp_path / "cp"), max_files=1)
        query.awaitTermination()
    assert second.last_batch() == 3

    def by_code(store):
        code = {r.id: r.code for r in store.read("agencies").collect()}
        d, v = _state(store)
        return sorted((code[x[0]], *x[1:]) for x in d), sorted(((code[x[0][0]], x[0][1]), *x[1:]) for x in v)

    assert by_code(second) == by_code(first)
    tables = {n: second.read(n) for n in ("agencies", "crawl_configs", "crawl_runs", "guidelines", "guideline_versions")}
    assert check_store({k: v.select(*STORE[k].fieldNames()) for k, v in tables.items()}).count() == 0

    compacted = second.compact(str(tmp_path / "c"), DAY)
    assert by_code(compacted) == by_code(first)
    # A repeated micro-batch stays recognised.
    assert all(compacted.holds(("landing", i)) for i in range(3)) and not compacted.holds(("landing", 3))
    assert ingest(compacted, pages, DAY, ("landing", 1)) is None
    assert {r.error for r in compacted.read("page_errors").collect()} == {"no active config for XXX"}


def test_type_of_a_stored_document_follows_the_last_source(spark, seeded, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    seed_agencies(store, registry.publishers(spark), DAY)
    pages = _pages(spark, store).where("agency_code = 'KISA'")
    ingest(store, pages, DAY)
    as_news = store.read("crawl_configs").withColumn("item_type", F.lit("announcement"))
    found = posts_of(extract_pages(pages, as_news, store.read("agencies")))
    assert {r.item_type for r in found.items.collect()} == {"announcement"}
    other = Store(spark, str(tmp_path / "o"))
    other.write("agencies", store.read("agencies"), 0)
    other.write("crawl_configs", as_news, 0)
    for name in ("guidelines", "guideline_versions"):
        other.write(name, store.read(name), 0)
    other.commit(0, DAY)
    later = datetime(2026, 5, 2, 6)
    ingest(other, pages, later)
    rows = other.read("guidelines").collect()
    kept = {r.title: (r.item_type, r.created_at, r.updated_at) for r in rows}
    assert kept["보안 안내서 2025"] == ("announcement", DAY, later)


def _staged(spark):
    import os

    from revtrack.session import shared_dir

    folder = os.path.join(shared_dir(spark).removeprefix("file://"), "revtrack")
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def test_a_batch_may_hold_several_crawls_of_a_config(spark, seeded, tmp_path):
    """A failed visit takes nothing from a later one, and every visit is a run of its own."""
    store = Store(spark, str(tmp_path / "s"))
    seed_agencies(store, registry.publishers(spark), DAY)
    config = store.read("crawl_configs").where(F.col("url") == KISA).first().id
    later = datetime(2026, 5, 2, 6)
    rows = [
        (config, "KISA", 1, KISA, 503, None, DAY, "one"),
        (config, "KISA", 1, KISA, 200, _rows(("보안 안내서 2025", "v?n=1", "2026-04-01"), ("점검표", "v?n=4", "")), later, "two"),
    ]
    for crawls in (("one", "two"), (None, None)):  # named, or told apart by their days
        store = Store(spark, str(tmp_path / f"s{crawls[0]}"))
        seed_agencies(store, registry.publishers(spark), DAY)
        pages = spark.createDataFrame([(*r[:7], c) for r, c in zip(rows, crawls)], RAW_PAGES)
        before = _staged(spark)
        ingest(store, pages, datetime(2026, 5, 9))
        assert len(_staged(spark) - before) == 1  # the tallies it returns
        assert {(r.title) for r in store.read("guidelines").collect()} == {"보안 안내서 2025", "점검표"}
        # The undated post has the day of its own crawl, not of the batch.
        assert {r.published_date for r in store.read("guideline_versions").collect()} == {date(2026, 4, 1), date(2026, 5, 2)}
        runs = [(r.status, r.items_found, r.items_new, r.error_message) for r in store.read("crawl_runs").orderBy("started_at").collect()]
        assert runs == [("failed", 0, 0, "Page 1 fetch failed: HTTP 503"), ("success", 2, 2, None)]


def test_equal_documents_of_one_load_are_stored_once(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    schema = "agency_id long, title string, source_url string, category string, version_label string, published_date date, change_summary string"
    rows = [(1, "같은 문서", "u", "ai", "v1", date(2026, 1, 1), None), (1, "같은 문서", "u", "ai", "v2", date(2026, 2, 1), None), (2, "url 없는 문서", None, "ai", "v1", date(2026, 1, 1), None)]
    for alike in (True, False):
        store = Store(spark, str(tmp_path / str(alike)))
        assert tuple(seed_documents(store, spark.createDataFrame(rows, schema).coalesce(1), DAY, alike).first()) == (3, 2, 1)
        owners = {r.guideline_id for r in store.read("guideline_versions").collect()}
        assert store.read("guidelines").count() == 2 and store.read("guideline_versions").count() == 2 and len(owners) == 2


def test_ids_do_not_depend_on_how_files_are_cut(spark):
    from revtrack.operators.merge import with_ids

    rows = with_ids(spark.range(1000).toDF("value").repartition(5), 10)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
        assert sorted(r.id for r in rows.collect()) == list(range(11, 1011))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_uncommitted_batches_stay_invisible(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.last_batch() == -1 and store.read("agencies").count() == 0
    row = spark.createDataFrame([(1, "A", "a", "a", "h", None, DAY, DAY)], STORE["agencies"])
    store.write("agencies", row, 0)
    assert store.read("agencies").count() == 0
    store.write("agencies", row, 0)
    store.commit(0, DAY)
    assert store.read("agencies").count() == 1


def test_curated_documents_and_legal_bases(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    seed_agencies(store, registry.publishers(spark), DAY)
    agencies = store.read("agencies")
    exam = curated.with_agency_id(curated.exam_documents(spark), agencies).drop("agency_code")
    manual = curated.with_agency_id(curated.manual_documents(spark), agencies).drop("agency_code")
    got = [tuple(seed_documents(store, exam, DAY, alike=True).first()), tuple(seed_documents(store, exam, DAY, alike=True).first())]
    assert got == [(11, 11, 0), (11, 0, 11)]
    got = [tuple(seed_documents(store, manual, DAY, alike=False).first()), tuple(seed_documents(store, manual, DAY, alike=False).first())]
    assert got == [(1, 1, 0), (1, 0, 1)]
    assert store.read("guideline_versions").where("version_label = 'v1.0 (2026.04)'").count() == 1
    rules = spark.createDataFrame(
        [("PIPC", "개인정보 고시", "고시", date(2026, 1, 1), None, "5", "u", 1, 0), ("PIPC", "암호 훈령", "훈령", None, None, "", "v", 1, 1)],
        "agency_code string, title string, rule_type string, promulgation_date date, enforcement_date date, law_api_id string, source_url string, page_num int, pos int",
    )
    assert tuple(seed_legal_bases(store, rules, DAY).first()) == (2, 2, 0)
    assert tuple(seed_legal_bases(store, rules, DAY).first()) == (2, 0, 2)
    assert {r.basis_type for r in store.read("legal_bases").collect()} == {"gosi", "hunryeong"}

    path = str(tmp_path / "manifest")
    header = write_manifest(store.read("legal_bases"), store.read("guidelines"), agencies, DAY, path).first()
    assert (header.legal_bases, header.guidelines, header.ttl_hours) == (2, 12, 48)
    lines = [r.line for r in manifest_document(store.read("legal_bases"), store.read("guidelines"), agencies, DAY).collect()]
    document = json.loads("\n".join(lines))
    assert document["generated_at"] == "2026-05-01T06:00:00+00:00"
    assert len(document["legal_bases"]) == 2 and len(document["guidelines"]) == 12
    assert document["guidelines"][0]["latest_published_date"] is None
    from pathlib import Path

    written = "".join(p.read_text() for p in sorted(Path(path, "document").glob("part-*")))
    assert json.loads(written) == document


def test_older_files_get_the_added_column(spark, tmp_path):
    old = spark.createDataFrame([(1, 1, None, "t", "ai", None, None, None, DAY, DAY)], "id long, agency_id long, mandate_id long, title string, category string, description string, source_url string, pdf_url string, created_at timestamp, updated_at timestamp")
    old.write.parquet(str(tmp_path / "g"))
    assert read_table(spark, "guidelines", str(tmp_path / "g")).first().item_type == "guideline"


def test_micro_batches_follow_the_size_of_the_landing(spark, tmp_path, monkeypatch):
    from revtrack.sources.landing import stream_pages
    from revtrack.streaming import incremental
    from workload import sync

    spark.createDataFrame([(n, f"N{n}") for n in range(25)], "n_nationkey long, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    for n in range(10):
        spark.createDataFrame([(n, f"http://h/{n}", "<article><h1>the page</h1>")], "page_id long, url string, html string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/pages.parquet")
    met = []
    monkeypatch.setattr(incremental, "ingest", lambda store, pages, *rest, **named: met.append(sorted((r.crawl_id, r.page_num) for r in pages.collect())))
    sync.streamed(spark, str(tmp_path))
    assert met == [[(f"crawl {k}", n) for n in range(10)] for k in range(2)]

    files = spark.read.parquet(f"{tmp_path}/pages.parquet").select(F.lit(1).cast("bigint").alias("config_id"))
    files.repartition(4).write.parquet(f"{tmp_path}/landing")
    for bytes_, n in ((1 << 30, 1), (1, 4)):
        batches = []
        stream = stream_pages(spark, f"{tmp_path}/landing", max_bytes=bytes_).writeStream.foreachBatch(lambda rows, i: batches.append(rows.count()))
        stream.option("checkpointLocation", f"{tmp_path}/cp{n}").trigger(availableNow=True).start().awaitTermination()
        assert len(batches) == n and sum(batches) == 10

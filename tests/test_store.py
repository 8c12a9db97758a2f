"""Commits of several writers, pruned reads, and replay after a crash."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from revtrack.operators.merge import decide
from revtrack.operators.seeding import seed_agencies
from revtrack.schemas import RAW_PAGES
from revtrack.sources import registry
from revtrack.sources.store import BUCKETS, CommitConflict, Store, replanned
from revtrack.streaming.incremental import ingest_stream

DAY = datetime(2026, 5, 1, 6)
AGENCY = "id long, code string, name string, short_name string, homepage_url string, created_at timestamp, updated_at timestamp"


def _agency(spark, n):
    return spark.createDataFrame([(n, f"A{n}", "a", "a", "h", DAY, DAY)], AGENCY)


def test_a_second_writer_fails_and_plans_again(spark, tmp_path):
    one, two = (Store(spark, str(tmp_path)) for _ in range(2))
    for store in (one, two):
        store.write("agencies", _agency(spark, 1 if store is one else 2), store.last_batch() + 1)
    two.commit(0, DAY)
    with pytest.raises(CommitConflict):
        one.commit(0, DAY, ("job", 1))
    assert [r.code for r in one.read("agencies").collect()] == ["A2"] and not one.holds(("job", 1))
    assert not [p.name for p in (tmp_path / "_commits").iterdir() if "w" in p.name and not p.name.endswith(".crc")]

    planned_on = []

    @replanned
    def add(store, n):
        last = store.last_batch()
        planned_on.append(last)
        store.write("agencies", _agency(spark, store.last_id("agencies", last) + 1), last + 1)
        if len(planned_on) == 1:
            other = Store(spark, store.root)
            other.write("agencies", _agency(spark, other.last_id("agencies") + 1), 1)
            other.commit(1, DAY)
        store.commit(last + 1, DAY, ("job", n))

    add(one, 1)
    assert planned_on == [0, 1] and one.last_batch() == 2 and one.holds(("job", 1))
    assert sorted(r.id for r in two.read("agencies").collect()) == [2, 3, 4] and two.last_id("agencies") == 4
    assert [r.id for r in two.read("agencies", 0).collect()] == [2] and two.last_id("agencies", 0) == 2


def _documents(spark, n):
    rows = [(i, i % 7, f"title {i}", "ai", "guideline", f"http://h/{i}" if i % 5 else None, f"title {i}", DAY, DAY) for i in range(1, n + 1)]
    return spark.createDataFrame(rows, "id long, agency_id long, title string, category string, item_type string, source_url string, norm_title string, created_at timestamp, updated_at timestamp")


def test_a_batch_reads_the_directories_of_its_own_keys(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    for batch, part in enumerate(("id <= 300", "id > 300")):
        docs = _documents(spark, 400).where(part)
        store.write("guidelines", docs, batch)
        versions = docs.select("id", F.col("id").alias("guideline_id"), F.lit(date(2026, 1, 1)).alias("published_date"), F.lit(DAY).alias("detected_at"))
        store.write("guideline_versions", versions, batch)
        store.commit(batch, DAY)
    assert store.last_id("guidelines") == 400 == store.last_id("guideline_versions")
    keys = spark.createDataFrame([(3, "title 3", "http://h/3"), (3, "title 301", "x"), (2, "none", "http://h/302")], "agency_id long, norm_title string, url string")
    stored = store.stored()
    for found, table in ((stored.by_title(keys), "key_titles"), (stored.by_url(keys), "key_urls"), (stored.days(keys.select(F.col("agency_id").alias("guideline_id"))), "key_days")):
        spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
        plan = found._jdf.queryExecution().executedPlan().toString()
        spark.conf.unset("spark.sql.maxMetadataStringLength")
        filters = plan.split("PartitionFilters: [")[1].split("]")[0]
        assert "bucket" in filters and "batch" in filters and "by" in filters
        read, whole = (df.select(F.input_file_name()).distinct().count() for df in (found, store._batches(table, 1)))
        assert 0 < read <= 6 < whole <= 2 * BUCKETS
    near = stored.by_title(keys).join(keys, ["agency_id", "norm_title"], "left_semi")
    assert sorted(r.id for r in near.collect()) == [3]
    assert {r.id for r in stored.by_url(keys).join(keys, ["agency_id", "url"], "left_semi").collect()} == {3}

    # Matching against the narrow tables is matching against the whole ones.
    rows = [(1 + n % 6, 1, n, f"title {n % 450}", f"http://h/{n % 430}" if n % 3 else "", date(2026, 1, 1 + n % 2), [], "announcement", True, False) for n in range(900)]
    items = spark.createDataFrame(rows, "agency_id long, config_id long, seq long, title string, url string, published_date date, attachment_urls array<string>, item_type string, accepted boolean, scored boolean")
    plain = decide(items, store.read("guidelines"), store.read("guideline_versions"), DAY)
    pruned = decide(items, store.stored(), None, DAY)
    for name in ("editions", "new_titles", "types", "tallies"):
        assert sorted(map(str, getattr(plain, name).collect())) == sorted(map(str, getattr(pruned, name).collect()))
    assert plain.types.count() > 50

    changes = spark.createDataFrame([(3, "announcement", DAY)], "guideline_id long, item_type string, updated_at timestamp")
    store.write("guideline_types", changes, 2)
    store.commit(2, DAY)
    asked = spark.createDataFrame([(3,), (4,)], "guideline_id long")
    assert {tuple(r) for r in store.stored().types(asked).join(asked, "guideline_id").collect()} == {(3, "announcement"), (4, "guideline")}
    again = store.compact(str(tmp_path / "c"), DAY)
    assert {tuple(r) for r in again.stored().types(asked).join(asked, "guideline_id").collect()} == {(3, "announcement"), (4, "guideline")}
    assert again.last_id("guidelines") == 400 and again.stored().by_url(keys).count() > 0


def test_replay_after_a_crash_between_write_and_commit(spark, tmp_path, monkeypatch):
    """The stream dies after a batch has written and before its commit, twice; restarted, the store is as if it never had."""
    publishers = registry.publishers(spark).where("code = 'KISA'")
    state = []
    for crashes in (0, 2):
        store = Store(spark, str(tmp_path / f"s{crashes}"))
        seed_agencies(store, publishers, DAY)
        config = store.read("crawl_configs").where("url like '%2060204'").first()
        body = "<table><tbody>" + "".join(f"<tr><td><a href='v?n={n}'>보안 안내서 {n}호</a></td><td>2026-04-0{n}</td></tr>" for n in range(1, 4)) + "</tbody></table>"
        for day in (1, 2):
            rows = [(config.id, "KISA", 1, config.url, 200, body.replace("v?n", f"v?d={day}&amp;n").replace("2026-04", f"2026-0{day + 3}"), datetime(2026, 5, day), f"c{day}")]
            spark.createDataFrame(rows, RAW_PAGES).write.mode("append").parquet(str(tmp_path / f"l{crashes}"))
        left, commit = [crashes], Store.commit

        def dying(self, batch, at, run=None):
            if run and left[0]:
                left[0] -= 1
                raise RuntimeError("lost")
            commit(self, batch, at, run)

        monkeypatch.setattr(Store, "commit", dying)
        for attempt in range(crashes + 1):
            query = ingest_stream(spark, str(tmp_path / f"l{crashes}"), store.root, str(tmp_path / f"cp{crashes}"), max_files=1)
            if attempt < crashes:
                with pytest.raises(Exception, match="lost"):
                    query.awaitTermination()
            else:
                query.awaitTermination()
        monkeypatch.setattr(Store, "commit", commit)
        names = ("guidelines", "guideline_versions", "crawl_runs")
        state.append([sorted(tuple(v for k, v in r.asDict().items() if not k.endswith("_at")) for r in store.read(n).collect()) for n in names])
        assert store.last_batch() == 2
    assert state[0] == state[1] and [len(x) for x in state[0]] == [3, 6, 2]

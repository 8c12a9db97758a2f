"""The stages one after the other, and the registered queries on odd tables."""

from collections import Counter

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from revtrack.llm.queries import QUERIES
from revtrack.session import stage

from .conftest import odd_rows, prose


def test_stages_keep_columns_and_take_effect(spark, table):
    rows = [(i, prose(i, 40 + i % 30), "en", f"s{i % 3}", 0) for i in range(60)]
    rows += [(100 + i, rows[0][1], "en", "s0", 0) for i in range(5)] + [(200, "too short", "en", "s0", 0)]
    docs, ids = table(rows), {}
    for name, step in corpus_pipeline.STAGES:
        out = stage(step(spark, docs, ""))
        if name != "packing":
            assert out.columns == docs.columns
        ids[name], docs = Counter(r.doc_id for r in out.collect()), out
    assert 200 not in ids["quality_rules"] and set(ids["quality_rules"]) == {r[0] for r in rows} - {200}
    assert set(ids["near_duplicates"]) == set(range(60)) and max(ids["near_duplicates"].values()) == 1
    assert set(ids["packing"]) == set(ids["source_mix"])


def test_stages_on_odd_rows(spark, odd, none):
    for docs in (odd, none):
        for name, step in corpus_pipeline.STAGES:
            out = stage(step(spark, docs, ""))
            assert name == "packing" or out.columns == docs.columns
            docs = out


@pytest.mark.parametrize("rows", [odd_rows(), []], ids=["odd", "empty"])
def test_queries_on_odd_tables(spark, tmp_path, rows, table):
    table(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(4, 1, 1), (8, 1, None)] if rows else [], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None, None), (2, "http://x.com/en/", "")] if rows else [], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    vectors = [(0, [1.0, 0.5]), (1, [0.5, 0.5]), (2, None), (None, [1.0, 1.0]), (20, [0.0, 2.0])]
    spark.createDataFrame(vectors if rows else [], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in QUERIES:
        n = entry.queries()[name](spark, str(tmp_path)).count()
        assert n == (0 if not rows else {"op10_urls": 2, "op12_neighbours": 4}.get(name, n))
        if rows and name not in ("op8_pack", "op10_urls", "op12_neighbours", "op13_divergence"):
            assert n == len(rows)

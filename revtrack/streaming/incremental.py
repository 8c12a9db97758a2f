"""Incremental ingest over a landing directory.

The state of the stream is the store itself: every micro-batch joins it. The store records which
micro-batch of which stream it holds, so a repeated one is skipped and a failed one starts over.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.scoring import Scorer
from ..plans.ingest import ingest
from ..session import configure
from ..sources.landing import read_pages, stream_pages
from ..sources.store import Store


def latest_fetch(pages: DataFrame) -> datetime | None:
    """The batch's own clock: when its last page was fetched; null for a batch without pages."""
    return pages.agg(F.max("fetched_at")).first()[0]


def ingest_stream(
    spark: SparkSession,
    landing: str,
    store_root: str,
    checkpoint: str,
    scorer: Scorer | None = None,
    name: str = "landing",
    max_files: int | None = None,
    clock: Callable[[DataFrame], datetime | None] = latest_fetch,
    detail: DataFrame | None = None,
    publications: DataFrame | None = None,
    bodies: str | None = None,
    max_bytes: int | None = None,
) -> StreamingQuery:
    """Read what has landed since the last call and merge it, then stop.

    A micro-batch takes `max_files` files, or files of `max_bytes` together, else all there is. Each has a fixed cost (about a
    hundred small jobs), so a landing of many files is better bounded by bytes.
    `name` tells streams that feed one store apart; keep it as long as the checkpoint. `bodies` is a folder of pages of single
    posts in the landing's layout; each batch sees what is there when it runs.
    """

    def merge(pages: DataFrame, batch_id: int) -> None:
        store = Store(configure(pages.sparkSession), store_root)
        as_of = clock(pages)
        if as_of is not None:
            posts = read_pages(pages.sparkSession, bodies).where("http_status = 200").select("url", "body", "fetched_at") if bodies else None
            ingest(store, pages, as_of, (name, batch_id), scorer, detail, publications, bodies=posts)

    return (
        stream_pages(spark, landing, max_files, max_bytes)
        .writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

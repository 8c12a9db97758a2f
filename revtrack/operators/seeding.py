"""Loading the registry, curated documents and legal bases into the store."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import fixed_values as fv
from ..functions.rules import basis_type
from ..functions.text import normalize_title
from ..session import stage
from ..sources.store import Store, replanned
from .lookups import load_tally, mark_existing, mark_legal_bases, mark_titled_alike
from .merge import with_ids


def _stamped(df: DataFrame, at: datetime) -> DataFrame:
    return df.withColumn("created_at", F.lit(at)).withColumn("updated_at", F.lit(at))


def _first_in_load(marked: DataFrame, keys: list[str]) -> DataFrame:
    """Mark every row but the first of equal keys as existing, as if each had been looked up after the one before."""
    first = Window.partitionBy(*keys).orderBy("_at")
    return marked.withColumn("exists", F.col("exists") | (F.row_number().over(first) > 1)).drop("_at")


@replanned
def seed_agencies(store: Store, publishers: DataFrame, at: datetime) -> DataFrame:
    """Store publishers whose code is new, with their targets as configs; returns the tally.

    Configs of a seeded publisher are of type guideline, whatever the registry says of the target.
    """
    batch = store.last_batch() + 1
    placed = stage(publishers.withColumn("_at", F.monotonically_increasing_id()))
    marked = stage(_first_in_load(mark_existing(placed, store.read("agencies"), ["code"]), ["code"]))
    new = marked.where(~F.col("exists"))
    agencies = store.write("agencies", with_ids(_stamped(new.drop("targets", "exists"), at), store.last_id("agencies")), batch)
    configs = (
        new.join(agencies.select("code", F.col("id").alias("agency_id")), "code")
        .select("agency_id", F.explode("targets").alias("t"))
        .select("agency_id", "t.*")
        .withColumn("item_type", F.lit("guideline"))
        .withColumn("is_active", F.lit(True))
    )
    store.write("crawl_configs", with_ids(_stamped(configs, at), store.last_id("crawl_configs")), batch)
    store.commit(batch, at)
    return load_tally(marked)


@replanned
def seed_documents(store: Store, documents: DataFrame, at: datetime, alike: bool) -> DataFrame:
    """Store curated documents with their first version unless already there; returns the tally.

    `alike` compares by the first 30 characters anywhere in a stored title, otherwise by equal title. Of rows of the
    load with an equal title (`alike`: equal first 30 characters) the first decides. A version belongs to its document by
    number, so documents may share a title or have no url.
    """
    batch = store.last_batch() + 1
    stored = store.read("guidelines")
    keyed = stage(documents.withColumn("_at", F.monotonically_increasing_id()))
    marked = mark_titled_alike(keyed, stored, "_at") if alike else mark_existing(keyed, stored, ["agency_id", "title"])
    head = F.lower(F.substring("title", 1, 30)) if alike else F.col("title")
    marked = stage(_first_in_load(marked.withColumn("_head", head), ["agency_id", "_head"]).drop("_head"))
    new = marked.where(~F.col("exists")).select(documents.columns)
    rows = _stamped(new.withColumn("item_type", F.lit("guideline")), at).withColumn("norm_title", normalize_title(F.col("title")))
    numbered = stage(with_ids(rows, store.last_id("guidelines")))
    store.write("guidelines", numbered, batch)
    versions = numbered.select(
        F.col("id").alias("guideline_id"), "version_label", "published_date", "change_summary", F.lit(at).alias("detected_at")
    )
    store.write("guideline_versions", with_ids(versions, store.last_id("guideline_versions")), batch)
    store.commit(batch, at)
    return load_tally(marked)


@replanned
def seed_legal_bases(store: Store, rules: DataFrame, at: datetime) -> DataFrame:
    """Store searched rules as legal bases unless already there; returns the tally.

    `rules`: the columns of the law search plus agency_code and an order within the agency.
    """
    batch = store.last_batch() + 1
    own = store.read("agencies").select(F.col("code").alias("agency_code"), F.col("id").alias("agency_id"))
    rows = rules.join(own, "agency_code").select(
        "agency_id", "title", basis_type(F.col("rule_type")).alias("basis_type"), F.nullif("law_api_id", F.lit("")).alias("law_api_id"),
        "promulgation_date", "enforcement_date", "source_url", F.lit(fv.DEFAULT_CATEGORY).alias("category"), "page_num", "pos",
    )
    marked = stage(mark_legal_bases(rows, store.read("legal_bases"), ("agency_id", "page_num", "pos")))
    new = marked.where(~F.col("exists")).drop("exists", "page_num", "pos")
    store.write("legal_bases", with_ids(_stamped(new, at), store.last_id("legal_bases")), batch)
    store.commit(batch, at)
    return load_tally(marked)



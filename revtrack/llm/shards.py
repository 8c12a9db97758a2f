"""Shards by fixed virtual slots.

Records are hashed into thousands of slots, bytes are summed per slot, and a versioned map says which shard owns which
slot. Rebalancing edits that map: it moves slots, never single records. Everything is DataFrame and SQL functions.

Cases: a null id hashes like any other value (all such records share a slot); a null text counts as no bytes; records
that tie in id stand in the order of checksum and size, equal records in any order; slots without records stay in the
map; an empty table gives an empty assignment. One record larger than a shard's share stays whole in its slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_dir, stage

SLOTS = 8_192
# Each slot is numbered in so many cells at once.
CELLS_PER_SLOT = 16
# The map travels to every task: its size is bounded by this.
MAX_SLOTS = 65_536


def cell_of(record_id: Column, slots: int = SLOTS) -> Column:
    """The cell of a record; its slot is the cell divided by CELLS_PER_SLOT."""
    return F.pmod(F.xxhash64(record_id), F.lit(slots * CELLS_PER_SLOT)).cast("int")


def initial_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 0: slots dealt round."""
    if not 0 < shards <= slots <= MAX_SLOTS:
        raise ValueError(f"need 0 < shards <= slots <= {MAX_SLOTS}")
    return spark.range(slots).select(
        F.lit(0).alias("version"), F.col("id").cast("int").alias("slot"), (F.col("id") % shards).cast("int").alias("shard")
    )


def _fold(owned: DataFrame, shards: int, step) -> DataFrame:
    """Run `step(loads, slot row) -> (moves?, from, to)` over the slots from large to small; the new map version.

    One row holds all slots (their number is a parameter), so this is a small aggregate whatever the data.
    """
    entry = F.struct(-F.col("bytes"), F.col("slot"), F.col("shard"), F.col("bytes")).alias("e")
    packed = owned.agg(F.array_sort(F.collect_list(entry)).alias("_slots"), F.max("version").alias("_version"))
    packed = packed.withColumn(
        "_loads",
        F.aggregate(
            "_slots", F.array_repeat(F.lit(0).cast("bigint"), shards),
            lambda loads, e: F.transform(loads, lambda v, i: v + F.when(i == e["shard"], e["bytes"]).otherwise(F.lit(0))),
        ),
    )
    start = F.struct(F.col("_loads").alias("loads"), F.expr("cast(array() as array<struct<slot: int, shard: int>>)").alias("edits"))

    def merge(state, e):
        loads = state["loads"]
        moves, to = step(loads, e)
        moved = F.transform(
            loads, lambda v, i: v + F.when(i == to, e["bytes"]).otherwise(F.lit(0)) - F.when(i == e["shard"], e["bytes"]).otherwise(F.lit(0))
        )
        edit = F.array(F.struct(e["slot"].alias("slot"), to.alias("shard")))
        return F.struct(
            F.when(moves, moved).otherwise(loads).alias("loads"), F.when(moves, F.concat(state["edits"], edit)).otherwise(state["edits"]).alias("edits")
        )

    folded = packed.select("_version", F.aggregate("_slots", start, merge).alias("_state"))
    edits = folded.select(F.explode("_state.edits").alias("_e")).select(F.col("_e.slot").alias("slot"), F.col("_e.shard").alias("_to"))
    return owned.join(edits, "slot", "left").select(
        (F.col("version") + 1).alias("version"), "slot", F.coalesce("_to", "shard").alias("shard")
    )


def _owned(slot_map: DataFrame, sizes: DataFrame) -> DataFrame:
    return slot_map.join(sizes.select("slot", "bytes"), "slot", "left").select("version", "slot", "shard", F.coalesce("bytes", F.lit(0)).alias("bytes"))


def rebalance(slot_map: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The next version: from large to small, a slot goes to the lightest shard if that is then lighter than its owner is now."""

    def step(loads, e):
        low = (F.array_position(loads, F.array_min(loads)) - 1).cast("int")
        return F.element_at(loads, low + 1) + e["bytes"] < F.element_at(loads, e["shard"] + 1), low

    return _fold(_owned(slot_map, sizes), shards, step)


def grow(slot_map: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The next version with one more shard, numbered `shards`: slots move into it only, from owners above the new mean."""

    def step(loads, e):
        total = F.aggregate(loads, F.lit(0).cast("bigint"), lambda a, v: a + v)
        share = total / (shards + 1)
        fits = F.element_at(loads, shards + 1) + e["bytes"] <= share
        return (e["bytes"] > 0) & fits & (F.element_at(loads, e["shard"] + 1) > share), F.lit(shards)

    return _fold(_owned(slot_map, sizes), shards + 1, step)


class MapStore:
    """The versions of one slot map, each a table of its own under a shared folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def write(self, slot_map: DataFrame, version: int) -> DataFrame:
        slot_map.coalesce(1).write.parquet(f"{self.root}/version={version}")
        return self.read(version)

    def read(self, version: int) -> DataFrame:
        return self.spark.read.schema("version int, slot int, shard int").parquet(f"{self.root}/version={version}")


def shard(
    rows: DataFrame, store: MapStore, *, shards: int = 8, slots: int = SLOTS, record_id: str = "doc_id", size: str = "size", order: tuple[str, ...] = (),
) -> DataFrame:
    """Add `virtual_slot, shard, slot`: `slot` numbers a shard's records from 0 without gaps.

    Reads `rows` twice, so they should be a narrow, stored table. Writes map versions 0 and 1 to `store`.
    """
    spark = rows.sparkSession
    placed = rows.withColumn("_cell", cell_of(F.col(record_id), slots))
    cells = stage(placed.groupBy("_cell").agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("n")).withColumn("slot", F.floor(F.col("_cell") / CELLS_PER_SLOT).cast("int")))
    sizes = cells.groupBy("slot").agg(F.sum("bytes").alias("bytes"))
    first = store.write(initial_map(spark, shards, slots), 0)
    current = store.write(rebalance(first, sizes, shards), 1)
    upto = Window.partitionBy("shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    # At most slots x CELLS_PER_SLOT rows.
    starts = cells.join(F.broadcast(current), "slot").select("_cell", F.col("slot").alias("virtual_slot"), "shard", (F.sum("n").over(upto) - F.col("n")).alias("_start"))
    within = Window.partitionBy("_cell").orderBy(record_id, *order)
    return (
        placed.join(starts, "_cell")
        .withColumn("slot", (F.col("_start") + F.row_number().over(within) - 1).cast("long"))
        .drop("_cell", "_start")
    )


def new_store(spark: SparkSession, name: str) -> MapStore:
    """A store in the cluster's shared folder."""
    import uuid

    return MapStore(spark, f"{shared_dir(spark)}/slot-maps/{name}-{uuid.uuid4().hex}")

"""The next row of a table in descending order of an id, without a global sort.

Ids are cut into ranges of about equal row counts; each range is sorted by one task, and the first row of a range is also
handed to the range before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_RANGE = 1_000
# The ranges' first ids go to every task: their number is bounded, beyond it ranges get longer.
SEGMENTS, MAX_RANGES = 256, 1 << 17


def _range_of(value: Column, bounds: list[int], least: int, parts: int) -> Column:
    """Number of an id's range, ascending; -1 for null. Quantiles bound segments, each is cut evenly into `parts`."""
    edges = F.array(*(F.lit(b).cast("bigint") for b in [least - 1, *bounds]))
    segment = F.size(F.filter(edges, lambda b: b < value)) - 1
    low, high = F.element_at(edges, segment + 1), F.element_at(edges, segment + 2)
    within = F.floor((value - low - 1).cast("double") / (high - low).cast("double") * parts)
    return F.when(value.isNotNull(), segment * parts + F.least(within, F.lit(parts - 1))).otherwise(F.lit(-1)).cast("long")


def with_next(rows: DataFrame, row_id: str, carried: list[str], ties: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with `_range`, `_rank` (from 1, descending id, nulls last, then `ties`) and `next_<c>` of `carried` columns.

    The last row's next is the first. Also returns `_range, _after`: the range whose first row follows a range's last.
    """
    told = rows.agg(F.count(F.lit(1)).alias("n"), F.min(row_id).alias("least"), F.percentile_approx(row_id, [i / SEGMENTS for i in range(1, SEGMENTS + 1)], 10_000).alias("q"), F.max(row_id).alias("most")).first()
    bounds = sorted({*(told.q or []), told.most} - {None}) or [0]
    parts = max(1, min(-(-told.n // (ROWS_PER_RANGE * len(bounds))), MAX_RANGES // SEGMENTS))
    least = told.least if told.least is not None else 0
    placed = rows.withColumn("_range", _range_of(F.col(row_id), bounds, least, parts))
    firsts = placed.groupBy("_range").agg(F.max(row_id).alias("_first"))
    ascending = Window.orderBy("_range")
    everything = ascending.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.select(
        "_range", "_first",
        F.coalesce(F.lead("_range").over(ascending), F.first("_range").over(everything)).alias("_before"),
        F.coalesce(F.lag("_range").over(ascending), F.last("_range").over(everything)).alias("_after"),
    )
    heads = firsts.select(F.col("_range").alias("_r"), "_first", "_before")
    here, before = F.struct(F.col("_range").alias("r"), F.lit(0).alias("guest")), F.struct(F.col("_before").alias("r"), F.lit(1).alias("guest"))
    # At most MAX_RANGES + 1 rows.
    joined = placed.join(F.broadcast(heads), (F.col("_range") == F.col("_r")) & F.col(row_id).eqNullSafe(F.col("_first")), "left")
    dealt = joined.withColumn("_at", F.explode(F.when(F.col("_r").isNotNull(), F.array(here, before)).otherwise(F.array(here))))
    dealt = dealt.select(*rows.columns, F.col("_at.r").alias("_range"), F.col("_at.guest").alias("_guest"))
    down = Window.partitionBy("_range").orderBy("_guest", F.col(row_id).desc_nulls_last(), *ties)
    ranked = dealt.select("*", F.row_number().over(down).alias("_rank"), *(F.lead(c).over(down).alias(f"next_{c}") for c in carried))
    return ranked.where(F.col("_guest") == 0).drop("_guest"), firsts.select("_range", "_after")

"""Mix sources to target weights: hash-random keys, distributed prefix sums, a cut at each source's exact budget.

Every source gets a share of the whole in proportion to its weight, at most `cap` times its own size; what is above
that is shared again among the others. Rows of a source are ordered by a hash-random key; whole epochs take every row,
the last epoch ends in the row at which the budget is used up (that row is taken in part).

Cases: a null text has size 0 and nothing is taken from it; rows of a null source form the last source; rows that tie in
key, id and size stand in the order of their texts' checksum, equal rows in any order (the result is the same); a source
without words has target 0; an empty table gives an empty result. Columns that are not named are not read; the mixed
documents keep all of theirs, whatever their names.
"""

from __future__ import annotations

from math import lcm

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, word_count

# Rows of one source whose prefix sum one task computes; the number of ranges follows from the source's row count.
ROWS_PER_RANGE = 8_192


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """Add `target` and `budget` (whole words) to one row per source (`source, source_size, n`).

    Sources are ranked by code point, null last, and take the weights in turn. The table has one row per source; its
    windows run over sources, never over documents.
    """
    unit = lcm(*weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int")).cast("long")
    ranked = sizes.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("_w", weight)
    # In order of size over weight, the sources that reach the cap come first.
    by_room = Window.orderBy(F.col("source_size") * (F.lit(unit) / F.col("_w")), "_rank")
    everywhere = Window.partitionBy()
    big = "decimal(38,0)"
    full = F.col("source_size") * cap
    flagged = (
        ranked.withColumn("_total", F.sum("source_size").over(everywhere))
        .withColumn("_before", F.sum(full).over(by_room.rowsBetween(Window.unboundedPreceding, 0)) - full)
        .withColumn("_rest", F.sum("_w").over(by_room.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_capped", full.cast(big) * F.col("_rest") <= (F.col("_total") - F.col("_before")).cast(big) * F.col("_w"))
    )
    open_ = F.col("_total") - F.coalesce(F.sum(F.when(F.col("_capped"), full)).over(everywhere), F.lit(0))
    weights_open = F.sum(F.when(~F.col("_capped"), F.col("_w"))).over(everywhere)
    shared = flagged.withColumn("_share", F.col("_w") * open_).withColumn("_open", weights_open)
    exact = F.col("_share").cast("double") / F.col("_open").cast("double")
    return shared.select(
        *sizes.columns,
        F.when(F.col("_capped"), full.cast("double")).otherwise(exact).alias("target"),
        F.when(F.col("_capped"), full).otherwise(F.expr("_share div _open")).alias("budget"),
    )


def mix(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (5, 2, 1), cap: int = 3,
    seed: str = "mix-1",
) -> DataFrame:
    """One row per document: `doc_id, source, size, source_size, target, budget, epochs, part, taken`.

    `taken` = `epochs` * `size` + `part`.
    """
    return _placed(docs, doc_id, text, source, weights, cap, seed).drop("_before", "_key", "_tag")


def _order(doc_id: str, text: str, seed: str) -> tuple[Column, Column, Column]:
    """What rows of a source are ordered by: the random key, the size, the text's checksum."""
    key = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"))
    return key, word_count(F.col(text)), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def _placed(docs: DataFrame, doc_id: str, text: str, source: str, weights: tuple[int, ...], cap: int, seed: str) -> DataFrame:
    key, size, tag = _order(doc_id, text, seed)
    rows = stage(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), key.alias("_key"), tag.alias("_tag")))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    plan = stage(targets(sizes, weights, cap))
    # The first 32 bits of the key, cut into equal ranges: a range partition of each source that needs no sample.
    ranges = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(ROWS_PER_RANGE)))
    at = F.conv(F.substring("_key", 1, 8), 16, 10).cast("long")
    placed = _join_source(rows, plan.select("source", ranges.alias("_ranges"))).withColumn("_range", F.shiftright(at * F.col("_ranges"), 32)).drop("_ranges")
    sums = placed.groupBy("source", "_range").agg(F.sum("size").alias("_sum"))
    upto = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    starts = _join_source(sums.withColumn("_start", F.sum("_sum").over(upto) - F.col("_sum")).drop("_sum"), plan.drop("n"))
    within = Window.partitionBy("source", "_range").orderBy("_key", "doc_id", "size", "_tag").rowsBetween(Window.unboundedPreceding, 0)
    other = starts.select(F.col("source").alias("_source"), F.col("_range").alias("_other"), "_start", "source_size", "target", "budget")
    joined = placed.join(other, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_range") == F.col("_other"))).drop("_source", "_other")
    before = F.col("_start") + F.sum("size").over(within) - F.col("size")
    return (
        joined.withColumn("_before", before)
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0)).cast("long"))
        .withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - F.col("epochs") * F.col("source_size") - F.col("_before"))).cast("long"))
        .withColumn("taken", F.col("epochs") * F.col("size") + F.col("part"))
        .drop("_start", "_range")
    )


def _join_source(left: DataFrame, per_source: DataFrame) -> DataFrame:
    """Join a table with one row per source; null is a source too."""
    right = per_source.withColumnRenamed("source", "_of")
    return left.join(right, F.col("source").eqNullSafe(F.col("_of"))).drop("_of")


def mixed_documents(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: str = "mix-1",
) -> DataFrame:
    """The mix itself, with the columns of `docs`: each row once per whole epoch, then the last one's first `part` words.

    The part keeps the white space between its words; `n_chars`, where there is one, follows the text. Only keys and sizes
    are moved to find where each source's last epoch ends; that one row per source is then held against the documents where
    they lie. Rows that equal the one at the end in id, size and checksum are the only ones that are numbered.
    """
    placed = _placed(docs, doc_id, text, source, weights, cap, seed)
    last = F.max(F.when(F.col("part") > 0, F.struct("_key", "size", "_tag", (-F.col("_before")).alias("b")))).alias("_end")
    ends = stage(placed.groupBy("source", "epochs", "budget", "source_size").agg(last))
    ends = ends.select(
        F.col("source").alias("_source"), F.col("epochs").alias("_epochs"), F.struct("_end._key", "_end.size", "_end._tag").alias("_end"),
        (F.col("budget") - F.col("epochs") * F.col("source_size") + F.col("_end.b")).alias("_left"),
    )
    key, size, tag = _order(doc_id, text, seed)
    row = F.struct(*docs.columns).alias("_row")
    held = docs.select(row, F.col(source).alias("_of"), F.struct(key.alias("_key"), size.alias("size"), tag.alias("_tag")).alias("_at"))
    held = held.join(ends, F.col("_of").eqNullSafe(F.col("_source")))
    before, at_end = F.col("_at") < F.col("_end"), F.col("_at") == F.col("_end")
    whole = held.where(~F.coalesce(at_end, F.lit(False))).withColumn("_part", F.when(before, F.col("_at.size")).otherwise(F.lit(0)).cast("long"))
    turn = F.row_number().over(Window.partitionBy("_source").orderBy(F.lit(1))) - 1
    cut = held.where(at_end).withColumn("_part", F.greatest(F.lit(0), F.least(F.col("_at.size"), F.col("_left") - turn * F.col("_at.size"))).cast("long"))
    copies = whole.unionByName(cut).withColumn("_copy", F.explode(F.expr("filter(sequence(0L, _epochs), i -> i < _epochs OR _part > 0)")))
    body = F.col(f"_row.{text}")
    pieces = F.split(F.ltrim(body, F.lit(" \t\n\x0b\f\r")), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    entire = (F.col("_copy") < F.col("_epochs")) | (F.col("_part") == F.col("_at.size"))
    kept = F.when(entire, body).otherwise(F.array_join(F.slice(pieces, F.lit(1), F.col("_part").cast("int")), ""))
    columns = {name: F.col(f"_row.{name}") for name in docs.columns} | {text: kept}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.length(kept).cast(docs.schema["n_chars"].dataType)
    return copies.select(*(column.alias(name) for name, column in columns.items()))

"""Join shapes: default lookups, insert-if-absent and containment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage


def with_agency(df: DataFrame, agencies: DataFrame) -> DataFrame:
    """Agency code and short name per row, `?` where the agency is unknown."""
    names = agencies.select(F.col("id").alias("agency_id"), F.col("code").alias("agency_code"), F.col("short_name").alias("agency_name"))
    return (
        df.join(names, "agency_id", "left")
        .withColumn("agency_code", F.coalesce("agency_code", F.lit("?")))
        .withColumn("agency_name", F.coalesce("agency_name", F.lit("?")))
    )


def with_count(df: DataFrame, counts: DataFrame, key: str, name: str) -> DataFrame:
    """Attach a per-key count, zero where there is none."""
    return df.join(counts.select(key, name), key, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("bigint")))


def mark_existing(candidates: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add `exists`: whether the keys are already stored."""
    stored = existing.select(*keys).distinct().withColumn("_hit", F.lit(True))
    return candidates.join(stored, list(keys), "left").withColumn("exists", F.coalesce("_hit", F.lit(False))).drop("_hit")


def absent(candidates: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    return candidates.join(existing.select(*keys).distinct(), list(keys), "left_anti")


def load_tally(marked: DataFrame) -> DataFrame:
    return marked.agg(
        F.count("*").alias("searched"), F.count_if(~F.col("exists")).alias("created"), F.count_if("exists").alias("skipped")
    )


def _lowered_pattern(needle: Column) -> Column:
    """`%needle%` with the wildcards of the needle kept and stray backslashes taken literally."""
    return F.concat(F.lit("%"), F.regexp_replace(F.lower(needle), r"\\(?![%_\\])", ""), F.lit("%"))


# Characters of the pieces that titles are found by.
GRAM = 3


def _grams(text: Column, size: int) -> Column:
    """All pieces of `size` characters; of size 0 the empty one."""
    if not size:
        return F.array(F.lit(""))
    n = F.length(text) - (size - 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(text, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def titled_alike(candidates: DataFrame, existing: DataFrame, key: str, chars: int = 30) -> DataFrame:
    """Keys of candidates whose first `chars` characters occur in a stored title of the same agency.

    Case does not count, and `%`, `_` in a candidate act as wildcards. A candidate is found by the rarest of the
    short pieces of its longest literal run: only pieces that a candidate asks for are kept of the stored titles, only titles with
    the rarest one meet it, and no agency is compared pair by pair. Shorter runs, down to none, are pieces themselves.
    """
    head = F.lower(F.substring("title", 1, chars))
    runs = F.split(head, r"[%_\\]")
    longest = F.aggregate(runs, F.lit(""), lambda best, run: F.when(F.length(run) > F.length(best), run).otherwise(best))
    needles = candidates.select(F.col(key).alias("_key"), "agency_id", longest.alias("part"), _lowered_pattern(F.substring("title", 1, chars)).alias("pattern"))
    # Candidates that ask the same thing are asked once.
    asked = stage(needles.select("agency_id", "part", "pattern").distinct().withColumn("size", F.least(F.length("part"), F.lit(GRAM))))
    sizes = sorted(r[0] for r in asked.where("size is not null").select("size").distinct().collect())  # GRAM + 1 at most
    if not sizes:
        return candidates.select(key).limit(0)
    own = F.coalesce(*(F.when(F.col("size") == k, _grams(F.col("part"), k)) for k in sizes))
    pieces = asked.select("agency_id", "part", "pattern", F.explode(F.array_distinct(own)).alias("gram"))
    titles = existing.select("agency_id", F.lower("title").alias("stored")).where("stored is not null").distinct()
    held = titles.select("agency_id", "stored", F.explode(F.array_distinct(F.concat(*(_grams(F.col("stored"), k) for k in sizes)))).alias("gram"))
    held = stage(held.join(pieces.select("agency_id", "gram").distinct(), ["agency_id", "gram"], "left_semi"))
    counts = held.groupBy("agency_id", "gram").agg(F.count("*").alias("n"))
    rarest = pieces.join(counts, ["agency_id", "gram"], "left").groupBy("agency_id", "part", "pattern").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("gram"))
    found = (
        held.join(rarest, ["agency_id", "gram"])
        .where(F.call_function("like", F.col("stored"), F.col("pattern")))
        .select("agency_id", "pattern")
        .distinct()
    )
    return needles.join(found, ["agency_id", "pattern"], "left_semi").select(F.col("_key").alias(key)).distinct()


def mark_titled_alike(candidates: DataFrame, existing: DataFrame, key: str, chars: int = 30) -> DataFrame:
    hits = titled_alike(candidates, existing, key, chars).withColumn("_hit", F.lit(True))
    return candidates.join(hits, key, "left").withColumn("exists", F.coalesce("_hit", F.lit(False))).drop("_hit")


def last_owner(guidelines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The document with the largest id per key: the index used for url and title probes."""
    return guidelines.groupBy(*keys).agg(F.max("id").alias("guideline_id"))


def mark_legal_bases(rules: DataFrame, stored: DataFrame, order: Sequence[str] = ("agency_id", "seq")) -> DataFrame:
    """Rules with `exists`: their law id is stored, or - without one - their agency and title are.

    Of rules that share an id or, without one, agency and title, all but the first in `order` exist too.
    """
    law_id = F.coalesce("law_api_id", F.lit(""))
    by_title = law_id == ""
    scope = [
        law_id.alias("_law"), F.when(by_title, F.col("agency_id")).alias("_agency"), F.when(by_title, F.col("title")).alias("_title"),
    ]
    names = ["_law", "_agency", "_title"]
    keyed = rules.select("*", *scope, F.struct(*order).alias("_ord"))
    firsts = keyed.groupBy(*names).agg(F.min("_ord").alias("_first"))
    known = stored.select(*scope).distinct().withColumn("_hit", F.lit(True))

    def same(right: str) -> Column:
        pairs = [F.col(f"l.{n}").eqNullSafe(F.col(f"{right}.{n}")) for n in names]
        return pairs[0] & pairs[1] & pairs[2]

    return (
        keyed.alias("l")
        .join(firsts.alias("f"), same("f"))
        .join(known.alias("k"), same("k"), "left")
        .select(*[F.col(f"l.{c}") for c in rules.columns], (F.col("_hit").isNotNull() | (F.col("l._ord") != F.col("f._first"))).alias("exists"))
    )

"""SimHash fingerprints and the search for those within a Hamming radius. DataFrame functions only.

Terms are words with their right neighbour; a term's 64-bit hash votes on every bit, with a weight that is larger for
longer words. Votes are added up in plain aggregates: two 32-bit counters share a long, so 32 sums hold all 64 bits.
The search keys every fingerprint by all choices of `blocks - radius` of its blocks: two fingerprints within the radius
agree in one of them. Pairs are found in the first table in which they agree, so each comes up once.

Cases: a text without words (null, empty, white space) has fingerprint 0; equal texts have equal fingerprints; a tie in
votes leaves the bit unset; very long texts are hashed whole (counters hold four billion votes); equal fingerprints are
searched once, with the number of their rows.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RADIUS, BLOCKS = 3, 6
_LOW = (1 << 32) + 1
_SPACE = " \t\n\x0b\f\r"


def fingerprints(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """`keys` and `fp` (long) for each distinct value of `keys`, which should name a row."""
    words = F.split(F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(_SPACE)), r"[\x20\x09-\x0D]+")
    listed = rows.select(*keys, words.alias("_w"))
    pairs = listed.select(*keys, F.explode(F.arrays_zip(F.col("_w").alias("a"), F.slice("_w", 2, F.size("_w")).alias("b"))).alias("_t"))
    a, b = F.col("_t.a"), F.col("_t.b")
    weight = F.when(a == "", 0).otherwise(1 + (F.octet_length(a) > 3).cast("int") + (F.coalesce(F.octet_length(b), F.lit(0)) > 3).cast("int"))
    terms = pairs.select(*keys, F.xxhash64(a, b).alias("_h"), weight.cast("long").alias("_v"))
    votes = [F.sum(F.shiftrightunsigned("_h", k).bitwiseAND(F.lit(_LOW)) * F.col("_v")).alias(f"_s{k}") for k in range(32)]
    counted = terms.groupBy(*keys).agg(F.sum("_v").alias("_all"), *votes)
    bits = F.lit(0).cast("long")
    for k in range(32):
        low, high = F.col(f"_s{k}").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(f"_s{k}", 32)
        for place, count in ((k, low), (k + 32, high)):
            one = (1 << place) - (1 << 64 if place == 63 else 0)
            bits = bits.bitwiseOR(F.when(2 * count > F.col("_all"), F.lit(one)).otherwise(F.lit(0)).cast("long"))
    return counted.select(*keys, bits.alias("fp"))


def as_text(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def _tables(radius: int, blocks: int) -> list[int]:
    """Bit masks, as signed longs, of all choices of `blocks - radius` blocks."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(blocks)]
    joined = [sum(c) for c in combinations(masks, blocks - radius)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in joined]


def near(queries: DataFrame, stored: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """`query, found, n` for every stored fingerprint within the radius of a query; `n`: its rows.

    `queries` has `fp`, `stored` has `fp`. Equal fingerprints are one on either side, so copies add no pairs.
    """
    if not 0 <= radius < blocks <= 64:
        raise ValueError("need 0 <= radius < blocks <= 64")
    masks = _tables(radius, blocks)
    keyed = lambda fp: F.explode(F.array(*(F.struct(F.lit(t).alias("t"), fp.bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks))))
    q = queries.select("fp").distinct().select(F.col("fp").alias("query"), keyed(F.col("fp")).alias("_k")).select("query", "_k.t", "_k.key")
    # Dealt out after the tables are made, so that whether to broadcast is decided by the rows there really are.
    q = q.repartition("t", "key")
    s = stored.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).select(F.col("fp").alias("found"), "n", keyed(F.col("fp")).alias("_k")).select("found", "n", F.col("_k.t").alias("_t"), F.col("_k.key").alias("_key"))
    apart = F.col("query").bitwiseXOR(F.col("found"))
    earlier = F.lit(True)
    for t, m in enumerate(masks[:-1]):
        earlier = earlier & ((F.col("t") <= t) | (apart.bitwiseAND(F.lit(m)) != 0))
    return q.join(s, (F.col("t") == F.col("_t")) & (F.col("key") == F.col("_key")) & (F.bit_count(apart) <= radius) & earlier).select("query", "found", "n")

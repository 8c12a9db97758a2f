"""Similarity join on word n-grams with several global token orders.

A set is a text's distinct 5-word shingles (64-bit hashes). Two sets whose Jaccard similarity is at least `percent` have a
number of tokens in common among the first `n - ceil(percent * n) + 1` of each, whatever global order the tokens are put in.
Three orders are used: by rarity (how often tokens occur in the corpus, counted over all texts in a table of fixed size, ties by
hash), and two by hashes alone. The first order yields candidates; of the other two every set has its first token. Every set
also has a compact row: a bitmap of all its tokens, at least four bits a token. Bits that only one of two sets has stand for
as many tokens or more that the other lacks. A candidate that lacks more than a link allows is dropped before any set is
moved, so no link is lost.

The result is each document's class: what is reachable over links. Tokens that very many sets share are not paired up. For
each token that set leads in which it comes first: few rarer tokens, which are what an edit brings in, stand before it, so a
leader is in the middle of its near copies. Every other set is compared with it; then, where a token still has several classes,
its sets are compared with the leader of those that have the same first token under the second or the third order. What is left is compared pair by pair: sets of one token and different classes whose sizes and positions of a common token fit and,
since Jaccard distance is a metric, whose distances to the leader differ by no more than the threshold.
No link between classes is lost, and a group of near copies costs as many comparisons as it has members.

Cases: a text without words (or null) has an empty set and is linked with nothing; a text with fewer words than a shingle is
one token; equal sets are one node, so copies are never compared; rows without an id take part, but name no class (a class
without any id has none); rows that share an id are nodes of their own. Texts of any length are read whole. Two different sets
count as equal if their 64-bit digests are (expected once in some billions of sets).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stage, worker_cache

WIDTH, PERCENT = 5, 75
ORDERS = 3
# Cells of the token count table that every task gets (a byte each), and rows that it travels in.
COUNT_BITS, CHUNKS = 24, 256
# Tokens that a task counts before it hands them on.
COUNTED = 1 << 20
# Bits of a set's bitmap: the least and the most, and how many for each token.
LEAST_BITS, MOST_BITS, BITS = 1 << 8, 1 << 22, 4
# Bits of the filter that picks the documents whose sets are wanted.
FILTER_BITS = 24

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def shingles(raw: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of a UTF-8 text's shingles; A-Z in lower case, words between ASCII white space."""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 1)], np.uint64)
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(own) - width + 1
    h = np.zeros(n, np.uint64)
    for i in range(width):
        h = _mix(h + own[i : i + n] * _ODD[i % len(_ODD)] + np.uint64(i + 1))
    return np.unique(h)


def set_id(tokens: np.ndarray) -> int:
    """A set's digest as a signed long."""
    return int(np.uint64(xxhash.xxh64_intdigest(tokens.tobytes(), 2)).view(np.int64))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def prefix(tokens: np.ndarray, counts: np.ndarray, order: int, percent: int = PERCENT) -> np.ndarray:
    """The first tokens of a set under one of the global orders, in that order."""
    k = prefix_length(len(tokens), percent)
    place = _mix(tokens + _ODD[order])
    if order == 1:
        rare = counts[(tokens >> np.uint64(64 - COUNT_BITS)).astype(np.int64)].astype(np.uint64)
        place = (rare << np.uint64(56)) | (place >> np.uint64(8))
    first = np.argpartition(place, k - 1)[:k]
    return tokens[first[np.argsort(place[first])]]


def compact(tokens: np.ndarray) -> tuple[list[int], bytes]:
    """A set's first token under each order after the first, and its size and bitmap; bits are a power of two."""
    heads = [int(tokens[np.argmin(_mix(tokens + _ODD[order]))].view(np.int64)) for order in range(2, ORDERS + 1)]
    size = min(max(LEAST_BITS, 1 << (BITS * len(tokens) - 1).bit_length()), MOST_BITS)
    bits = np.zeros(size, bool)
    bits[(tokens & np.uint64(size - 1)).astype(np.int64)] = True
    return heads, np.array([len(tokens)], "<u8").tobytes() + np.packbits(bits).tobytes()


def measure(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row per document (`doc_id, n, set, head2, head3, bits`), and token counts of each task in rows with a `chunk`."""
    kind = docs.schema[doc_id].dataType.simpleString()
    size = (1 << COUNT_BITS) // CHUNKS

    names = ["doc_id", "n", "set", "head2", "head3", "bits", "chunk", "counts"]

    def counted(held: list[np.ndarray], of: pa.DataType) -> pa.RecordBatch:
        at, n = np.unique(np.concatenate(held), return_counts=True)
        edges = np.searchsorted(at, np.arange(CHUNKS + 1) * size)
        parts = [(c, packed_counts(at[i:j] - c * size, n[i:j])) for c, (i, j) in enumerate(zip(edges[:-1], edges[1:])) if j > i]
        chunk, packed = pa.array([c for c, _ in parts], pa.int32()), pa.array([p for _, p in parts], pa.binary())
        no = [pa.nulls(len(parts), kind) for kind in (pa.int64(), pa.int64(), pa.int64(), pa.binary())]
        return pa.RecordBatch.from_arrays([pa.nulls(len(parts), of), pa.array([0] * len(parts), pa.int64()), *no, chunk, packed], names)

    # In Arrow: pandas makes floats of a batch's ids as soon as one is null, which rounds those above 2^53.
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Cells of tokens rather than a table with a place for each cell: a worker holds what it has read since, not 2^COUNT_BITS counts.
        worker_cache("sets")  # empty: gives back what another operator has left in the worker
        held, wait, of = [], 0, pa.null()
        for batch in batches:
            sets, of = [shingles(r) for r in batch["raw"].to_pylist()], batch["doc_id"].type
            told = [compact(s) if len(s) else ([None, None], None) for s in sets]
            columns = [
                batch["doc_id"], pa.array([len(s) for s in sets], pa.int64()), pa.array([set_id(s) if len(s) else None for s in sets], pa.int64()),
                *(pa.array([h[i] for h, _ in told], pa.int64()) for i in range(2)), pa.array([c for _, c in told], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())], names)
            for s in sets:
                held.append((s >> np.uint64(64 - COUNT_BITS)).astype(np.uint32))
                wait += len(s)
                if wait >= COUNTED:
                    yield counted(held, of)
                    held, wait = [], 0
        if wait:
            yield counted(held, of)

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("raw"))
    return rows.mapInArrow(run, f"doc_id {kind}, n long, set long, head2 long, head3 long, bits binary, chunk int, counts binary")


def packed_counts(at: np.ndarray, n: np.ndarray) -> bytes:
    """Counts `n` of the cells `at` of a chunk, which ascend: gaps between cells, then counts."""
    return zlib.compress(np.diff(at, prepend=0).astype("<u4").tobytes() + n.astype("<u4").tobytes(), 1)


def unpacked_counts(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    gaps, n = np.frombuffer(zlib.decompress(packed), "<u4").reshape(2, -1)
    return np.cumsum(gaps, dtype=np.int64), n


def count_table(measured: DataFrame) -> np.ndarray:
    """Rank of frequency (one byte, 8 to a doubling) for each cell; its size is fixed, 2^COUNT_BITS bytes."""
    size = (1 << COUNT_BITS) // CHUNKS

    def add(part: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(size, np.uint32)
        for packed in part["counts"]:
            at, n = unpacked_counts(packed)
            total[at] += n
        at = np.flatnonzero(total)
        return pd.DataFrame({"chunk": part["chunk"].iloc[:1], "counts": [packed_counts(at, total[at])]})

    parts = measured.where(F.col("chunk").isNotNull()).select("chunk", "counts")
    # Tasks are added up in two rounds, so that no round meets them all in one place.
    some = parts.withColumn("_some", F.pmod(F.crc32("counts"), F.lit(32))).groupBy("chunk", "_some").applyInPandas(add, "chunk int, counts binary")
    ranks = np.zeros(1 << COUNT_BITS, np.uint8)
    for row in some.groupBy("chunk").applyInPandas(add, "chunk int, counts binary").collect():
        at, n = unpacked_counts(row.counts)
        ranks[row.chunk * size + at] = np.minimum(np.log2(n) * 8, 255).astype(np.uint8)
    return ranks


def classes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """`doc_id, n_shingles, set, component_id, class` of every row; `class` is a digest that a class's rows share (null: empty set)."""
    spark = docs.sparkSession
    measured = stage(measure(docs, doc_id, text))
    nodes = measured.where(F.col("chunk").isNull()).select("doc_id", "n", "set")
    # One row per distinct set.
    known = measured.where(F.col("set").isNotNull()).groupBy("set").agg(
        F.min("doc_id").alias("least"), F.max("n").alias("n"), F.max("head2").alias("head2"), F.max("head3").alias("head3"), F.max("bits").alias("bits")
    )
    known = stage(known)
    table = spark.sparkContext.broadcast(count_table(measured))
    shared = stage(_shared_tokens(docs, doc_id, text, table, percent))
    table.unpersist()

    def compared(pairs: DataFrame, worth: bool = True) -> DataFrame:
        pairs = stage(_fitting(pairs, known, percent, worth))
        return _verified(pairs, stage(_wanted_sets(docs, doc_id, text, known, pairs)), percent)

    pairs = shared.where("set <> leader").groupBy(F.col("leader").alias("a"), F.col("set").alias("b")).agg(F.count(F.lit(1)).alias("met"))
    led = stage(compared(pairs))
    label = components(led.where("linked").select("a", "b"))
    open_ = _open(shared, label, known.select("set", "n", "head2", "head3"))
    label = _joined(label, compared(_met(open_)))
    label = _joined(label, compared(_rest(_open(open_.drop("label", "head2", "head3"), label), led, percent), worth=False))
    # From sets back to documents: one row per distinct set, then one per document.
    own = known.select("set", "least").join(label.withColumnRenamed("node", "set"), "set", "left").withColumn("class", F.coalesce("label", "set"))
    least = own.groupBy("class").agg(F.min("least").alias("component_id"))
    named = own.join(least, "class").select(F.col("set").alias("_set"), "class", "component_id")
    out = nodes.join(named, F.col("set") == F.col("_set"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), "set", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "class")


def representatives(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row of each class, with all columns of `docs`: the smallest id's (of equal ids, the smallest digest's); rows with an empty set all stay."""

    @F.pandas_udf("long")
    def digest(raws: pd.Series) -> pd.Series:
        worker_cache("sets")
        sets = map(shingles, raws)
        return pd.Series([set_id(s) if len(s) else None for s in sets], dtype="Int64")

    found = stage(classes(docs, doc_id=doc_id, text=text, percent=percent).where(F.col("class").isNotNull()).select("doc_id", "set", "class"))
    best = found.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "set")).alias("b"))
    best = best.select("class", F.col("b.doc_id").alias("_id"), F.col("b.set").alias("_best"))
    is_best = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("set") == F.col("_best"))
    told = found.join(best, "class").groupBy("set", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.min(is_best).alias("best"))
    # Rows that go, and rows of which equal ones stand several times. Only rows whose ids may be among theirs, by a filter of
    # fixed size, are looked at and moved.
    told = stage(told.where("not best or n > 1"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(doc_id).alias("_doc"), F.col(text).alias("_text"), _cell(doc_id).alias("_cell"))
    rows = rows.withColumn("k", F.bitmap_bucket_number("_cell")).join(F.broadcast(_marked(told)), "k", "left")  # 512 rows at most
    byte = F.expr("cast(conv(hex(substring(bits, cast(bitmap_bit_position(_cell) div 8 + 1 as int), 1)), 16, 10) as int)")
    rows = rows.withColumn("_listed", F.coalesce(F.expr("cast(pow(2, bitmap_bit_position(_cell) % 8) as int)").bitwiseAND(byte) > 0, F.lit(False)))
    keyed = rows.where("_listed").select("_row", "_doc", digest(F.coalesce(F.col("_text"), F.lit("")).cast("binary")).alias("_set"))
    gone, often = (told.where(c).select(F.col("set").alias("_s"), F.col("doc_id").alias("_d")) for c in ("not best", "best"))
    same = (F.col("_set") == F.col("_s")) & F.col("_doc").eqNullSafe(F.col("_d"))
    kept = keyed.join(gone.union(often), same, "left_anti").select("_row")
    turn = F.row_number().over(Window.partitionBy("_set", "_doc").orderBy(F.lit(1)))
    one = keyed.join(often, same, "left_semi").withColumn("_turn", turn).where("_turn = 1").select("_row")
    return rows.where("not _listed").select("_row").union(kept).union(one).select("_row.*")


def _shared_tokens(docs: DataFrame, doc_id: str, text: str, table, percent: int) -> DataFrame:
    """`token, set, pos, leader`: prefix tokens of the first order that at least two sets have, with their positions from 1; the
    set with the smallest position leads."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker_cache("sets")
        for batch in batches:
            tokens = {}
            for raw in batch["raw"]:
                own = shingles(raw)
                if len(own) and (key := set_id(own)) not in tokens:
                    tokens[key] = prefix(own, table.value, 1, percent)
            times = [len(t) for t in tokens.values()]
            found = np.concatenate(list(tokens.values())).view(np.int64) if tokens else np.zeros(0, np.int64)
            pos = np.concatenate([np.arange(1, n + 1, dtype=np.int32) for n in times]) if tokens else np.zeros(0, np.int32)
            yield pd.DataFrame({"token": found, "set": np.repeat(np.array(list(tokens), np.int64), times), "pos": pos})

    rows = docs.select(F.coalesce(F.col(text), F.lit("")).cast("binary").alias("raw")).mapInPandas(run, "token long, set long, pos int")
    each = Window.partitionBy("token")
    known = rows.withColumn("leader", F.min(F.struct("pos", "set")).over(each)["set"])
    known = known.withColumn("_least", F.min("set").over(each)).withColumn("_top", F.max("set").over(each))
    return known.where("_least <> _top").drop("_least", "_top")


def _cell(doc_id: str) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(1 << FILTER_BITS)) + 1  # the bitmap functions count from 1


def _marked(rows: DataFrame) -> DataFrame:
    """Bitmaps of the cells of `doc_id`: `k, bits` for each bucket of 32,768 cells."""
    marked = rows.select(_cell("doc_id").alias("c")).groupBy(F.bitmap_bucket_number("c").alias("k"))
    return marked.agg(F.bitmap_construct_agg(F.bitmap_bit_position("c")).alias("bits"))


def _filter(rows: DataFrame):
    """These bitmaps in one, of fixed size, for every task."""
    width = 4096  # bytes of one bitmap
    bits = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for row in _marked(rows).collect():  # 2^FILTER_BITS bits at most
        at = (row.k - 1) * width
        bits[at : at + width] = np.frombuffer(row.bits, np.uint8)
    return rows.sparkSession.sparkContext.broadcast(bits)


def _wanted_sets(docs: DataFrame, doc_id: str, text: str, known: DataFrame, pairs: DataFrame) -> DataFrame:
    """`set, tokens` of at least the sets in `pairs`; read from one document each, picked by a filter of fixed size.

    A set may come more than once (ids that are not unique) and others may be among them (chance hits of the filter): both
    go when the table is joined with pairs and links are made distinct.
    """
    wanted = pairs.select(F.col("a").alias("set")).union(pairs.select("b")).distinct()
    sent = _filter(known.select("set", F.col("least").alias("doc_id")).join(wanted, "set", "left_semi"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker_cache("sets")
        for batch in batches:
            c = batch["c"].to_numpy(np.int64) - 1
            hit = (sent.value[c >> 3] >> (c & 7).astype(np.uint8)) & 1
            found = {}
            for raw in batch["raw"][hit.astype(bool)]:
                own = shingles(raw)
                if len(own) and (key := set_id(own)) not in found:
                    found[key] = own.tobytes()
            yield pd.DataFrame({"set": list(found), "tokens": list(found.values())})

    rows = docs.select(_cell(doc_id).alias("c"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("raw"))
    return rows.mapInPandas(run, "set long, tokens binary")


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common values of two sorted arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """`a, b, linked, distance` of pairs of sets."""

    def compare_one(a: np.ndarray, b: np.ndarray) -> tuple[bool, float]:
        common = _overlap(a, b)
        union = len(a) + len(b) - common
        return 100 * common >= percent * union, 1 - common / union

    @F.pandas_udf("linked boolean, distance double")
    def compare(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        told = [compare_one(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(a, b)]
        return pd.DataFrame({"linked": [t[0] for t in told], "distance": [t[1] for t in told]})

    of = lambda side: sets.select(F.col("set").alias(side), F.col("tokens").alias(f"t{side}"))
    joined = pairs.join(of("b"), "b").join(of("a"), "a")
    return joined.select("a", "b", compare("ta", "tb").alias("v")).select("a", "b", "v.linked", "v.distance")


def _common_prefix_tokens(x: str, y: str, percent: int) -> Column:
    """How many prefix tokens two linked sets of sizes `x` and `y` (columns) have in common at least.

    Of a linked pair, all but a few tokens are common; those few cannot fill a prefix, and the common ones that come first
    are the same in both.
    """
    spare = lambda n: f"(1 - (({percent} * {n} + 99) div 100))"  # noqa: E731  prefix length minus size
    return F.expr(f"greatest(1, least({spare(x)}, {spare(y)}) + {_common_tokens(x, y, percent)})")


def _common_tokens(x: str, y: str, percent: int) -> str:
    """How many tokens two linked sets of sizes `x` and `y` have in common at least."""
    return f"(({percent} * ({x} + {y}) + {99 + percent}) div {100 + percent})"


@F.pandas_udf(T.LongType())
def _common_at_most(one: pd.Series, other: pd.Series) -> pd.Series:
    """How many tokens two sets can have in common at most by their sizes and bitmaps."""

    def of_pair(x: bytes, y: bytes) -> int:
        (a, b), (n, m) = (np.frombuffer(z, np.uint8, offset=8) for z in (x, y)), (int.from_bytes(z[:8], "little") for z in (x, y))
        # A longer bitmap is folded to the other's length, as fewer of a token's bits would have placed it.
        size = min(len(a), len(b))
        a, b = (np.bitwise_or.reduce(z.reshape(-1, size)) for z in (a, b))
        return min(n - int(np.bitwise_count(a & ~b).sum()), m - int(np.bitwise_count(b & ~a).sum()))

    return pd.Series([of_pair(x, y) for x, y in zip(one, other)], dtype="int64")


def _fitting(pairs: DataFrame, known: DataFrame, percent: int, worth: bool) -> DataFrame:
    """Pairs `a, b` whose sizes and bitmaps allow a link. Where that is `worth` it, only those that `met` at a good part of the
    prefix tokens a link takes under the first order."""
    for side in ("a", "b"):
        pairs = pairs.join(known.select(F.col("set").alias(side), F.col("n").alias(f"n{side}")), side)
    pairs = pairs.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    if worth:
        pairs = pairs.where(4 * F.col("met") >= _common_prefix_tokens("na", "nb", percent))
    for side in ("a", "b"):
        pairs = pairs.join(known.select(F.col("set").alias(side), F.col("bits").alias(f"bits{side}")), side)
    return pairs.where(_common_at_most("bitsa", "bitsb") >= F.expr(_common_tokens("na", "nb", percent))).select("a", "b")


def _joined(label: DataFrame, verified: DataFrame) -> DataFrame:
    """Classes with the links among verified pairs added."""
    links = stage(verified.where("linked").select("a", "b"))
    return components(label.select(F.col("node").alias("a"), F.col("label").alias("b")).union(links))


def _open(shared: DataFrame, label: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """Rows of `shared` with their `label`, and the columns of `sets`, of tokens whose sets are in more than one class so far;
    most tokens have one by now."""
    known = shared.join(label.select(F.col("node").alias("set"), "label"), "set", "left").withColumn("label", F.coalesce("label", "set"))
    several = known.groupBy("token").agg(F.min("label").alias("_least"), F.max("label").alias("_most")).where("_least <> _most")
    found = known.join(several.select("token"), "token", "left_semi").distinct()
    return stage(found if sets is None else found.join(sets, "set"))


def _met(open_: DataFrame) -> DataFrame:
    """Pairs `a, b` of each open token's sets with the leader of those that have the same first token under another order, and
    how many tokens they `met` at."""
    met = []
    for head in ("head2", "head3"):
        # One shuffle for each order; groups are the sets of one token that also have the first token under that order in common.
        least = F.min(F.struct("pos", "set", "label")).over(Window.partitionBy("token", head))
        both = open_.select("token", "set", "label", least.alias("one")).where(F.col("label") != F.col("one.label"))
        met.append(both.select("token", F.col("one.set").alias("a"), F.col("set").alias("b")))
    return met[0].union(met[1]).groupBy("a", "b").agg(F.count_distinct("token").alias("met"))


def _rest(open_: DataFrame, led: DataFrame, percent: int) -> DataFrame:
    """All pairs `a, b` that share a token, are in different classes so far, and may yet be linked.

    All that two sets have in common stands from their first common token on, so at that token what is left of the shorter
    remainder must be enough; a pair that passes at a later token only would have passed there.
    """
    far = led.select(F.col("a").alias("leader"), F.col("b").alias("set"), "distance").distinct()
    known = open_.join(far, ["leader", "set"], "left")
    known = known.withColumn("distance", F.when(F.col("set") == F.col("leader"), F.lit(0.0)).otherwise(F.col("distance")))
    known = stage(known.select("token", "set", "pos", "n", "distance", "label"))
    # Both sides are one table as it is, so it is shuffled once.
    one, other = known.alias("one"), known.alias("other")
    apart = F.abs(F.col("one.distance") - F.col("other.distance"))
    most = 1 + F.least(F.col("one.n") - F.col("one.pos"), F.col("other.n") - F.col("other.pos"))
    return one.join(other, F.col("one.token") == F.col("other.token")).where(
        (F.col("one.label") < F.col("other.label"))
        & ((100 + percent) * most >= percent * (F.col("one.n") + F.col("other.n")))
        & (100 * F.least("one.n", "other.n") >= percent * F.greatest("one.n", "other.n"))
        & F.coalesce(apart <= 1 - percent / 100 + 1e-9, F.lit(True))
    ).select(F.col("one.set").alias("a"), F.col("other.set").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """`node, label` of every node of `links` (`a, b`); the label is the component's smallest node.

    Each round a node takes the smallest label among its neighbours and itself, then the label of that label; rounds grow
    with the logarithm of a component's diameter for the most part. Every round is written, so lineage stays short.
    """
    edges = stage(links.where("a <> b").select("a", "b").union(links.where("a <> b").select("b", "a")).distinct())
    label = stage(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = edges.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("_near"))
        met = label.join(near, "node").select("node", "label", F.least("label", "_near").alias("_new"))
        jump = label.select(F.col("node").alias("_new"), F.col("label").alias("_far"))
        moved = stage(met.join(jump, "_new", "left").select("node", F.coalesce(F.least("_far", "_new"), "_new").alias("_to"), "label"))
        changed = moved.where("_to <> label").limit(1).count()
        label = moved.select("node", F.col("_to").alias("label"))
        if not changed:
            return label

"""How far the sources of a language differ in their use of terms: hash-consed segment trees over term ids.

Terms are counted per language and source; a language keeps those that enough of its documents hold. Its term ids are
dealt by hash into spans of some thousands, and each span is one task: there every group (language and source) has a segment tree of
its counts over the span, built level by level so that identical subtrees of any groups are one node. Two trees are
walked together from their roots; a pair of nodes that turns up again, in one pair of groups or in several with the same totals, is
priced once. Spans then add up.

A term's share is `1 + floor(10^9 * (count + 5) / (N + 5 V))`; all arithmetic is exact, in whole numbers of any size.

Cases: null text, language and source are empty strings; a group without kept terms has shares of its own and is compared
like others; a language with one source has no pairs; one without kept terms has pairs of value 0; repeated rows count as
often as they stand; very long texts are read whole; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

LEAST_DOCS = 30
TERMS = 50
SCALE, ADDED = 1_000_000_000, 5
# Terms of a span, on average, and pairs of groups that a task prices at a time.
SPAN = 4_096
PAIRS = 256
# Entries that a task counts before it hands them on.
COUNTED = 1 << 19
# Rows of a batch in which they go.
HANDED = 1 << 15

# ASCII letters to lower case, other ASCII to blanks; bytes of longer characters stay.
_LETTERS = bytes(b if b > 127 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256))
_SUM = "decimal(38,0)"
# (n + ADDED) * SCALE and N + ADDED * V up to these are below 2^63.
_SMALL, _LARGE = 9_000_000_000, 1 << 62


def told_counts(docs: DataFrame) -> DataFrame:
    """`lang, source, term, n, docs` as tasks hand them on, a term once or a few times each; each group also has rows with a null term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            for lang, source, raw in zip(*(batch[c].to_pylist() for c in ("lang", "source", "raw"))):
                n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                before, words = len(n), raw.translate(_LETTERS).split()
                # Both meet new terms in the same order, so their entries stand side by side.
                n.update(words)
                docs.update(dict.fromkeys(words).keys())
                size += len(n) - before
                if size >= COUNTED:
                    yield from _handed_on(held)
                    held, size = {}, 0
        yield from _handed_on(held)

    rows = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")), F.coalesce("text", F.lit("")).cast("binary").alias("raw"))
    return rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def _handed_on(held: dict) -> Iterator[pa.RecordBatch]:
    for (lang, source), (n, docs) in held.items():
        # Terms of a group as they were met, in batches of a size that goes well from process to process.
        columns = [pa.array([None, *n], pa.binary()).cast(pa.string()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *docs.values()], pa.int64())]
        groups = [pa.repeat(pa.scalar(x, pa.string()), len(n) + 1) for x in (lang, source)]
        whole = pa.RecordBatch.from_arrays([*groups, *columns], ["lang", "source", "term", "n", "docs"])
        for at in range(0, len(whole), HANDED):
            yield whole.slice(at, HANDED)


def kept_counts(docs: DataFrame, least_docs: int) -> DataFrame:
    """`lang, source, term, n, lang_n, first` of the terms that a language keeps: counts of the group and of the language, and
    whether this is the one row of the language's term that stands for it; each group also has a row with a null term.

    Dealt out by language and term once; a group's counts, the language's and what it keeps are all found there.
    """
    counts = told_counts(docs).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    each = Window.partitionBy("lang", "term")
    known = counts.withColumn("lang_docs", F.sum("docs").over(each)).withColumn("lang_n", F.sum("n").over(each))
    known = known.withColumn("first", F.col("source") == F.min("source").over(each))
    return known.where(F.col("term").isNull() | (F.col("lang_docs") >= least_docs)).select("lang", "source", "term", "n", "lang_n", "first")


def share(n: Column, total: Column, v: Column) -> Column:
    """The share of a count in `total`, with `v` kept terms; whole numbers, as long."""
    # Within 64 bits where that is enough.
    small = (n <= _SMALL) & (total <= _LARGE) & (v <= _SMALL)
    plain = F.call_function("div", (n.cast("long") + ADDED) * F.lit(SCALE), total.cast("long") + F.lit(ADDED) * v.cast("long"))
    over = (n.cast("decimal(27,0)") + ADDED) * F.lit(SCALE).cast("decimal(10,0)")
    under = total.cast("decimal(28,0)") + F.lit(ADDED) * v.cast("decimal(19,0)")
    return F.when(small, plain).otherwise(F.call_function("div", over, under).cast("long")) + 1


class Forest:
    """The trees of all groups over one span: `nodes[k]` are the children of the nodes of level k + 1, `roots` one per group."""

    def __init__(self, counts: np.ndarray):
        """`counts`: a row per group, a column per term; -1 pads the columns to a power of two."""
        self.leaves, ids = np.unique(counts, return_inverse=True)
        ids = ids.reshape(counts.shape)
        self.nodes = []
        while ids.shape[1] > 1:
            n = ids.max() + 1
            keys, ids = np.unique(ids[:, ::2] * n + ids[:, 1::2], return_inverse=True)
            ids = ids.reshape(counts.shape[0], -1)
            self.nodes.append(np.divmod(keys, n))
        self.roots = ids[:, 0]

    def distances(self, left: np.ndarray, right: np.ndarray, totals: list[int]) -> list[int]:
        """Sum of differences of shares for each pair of groups; `totals` is N + 5 V of each group."""
        kinds, kind = np.unique(np.array(totals, object), return_inverse=True)
        # A node pair is priced under the totals of both sides.
        priced, at = _distinct(kind[left], kind[right], self.roots[left], self.roots[right])
        walked = [at]
        for low, high in reversed(self.nodes):
            i, j, a, b = priced
            two = [np.concatenate([x, x]) for x in (i, j)]
            priced, at = _distinct(*two, np.concatenate([low[a], high[a]]), np.concatenate([low[b], high[b]]))
            walked.append(at)
        exact = object if len(self.leaves) and int(self.leaves[-1]) + ADDED >= (1 << 63) // SCALE else np.int64
        over = (self.leaves.astype(exact) + ADDED) * SCALE
        under = np.maximum(kinds, 1).astype(object if exact is object or max(totals) >= 1 << 63 else np.int64)
        shares = 1 + over[None, :] // under[:, None]
        i, j, a, b = priced
        value = np.where(self.leaves[a] < 0, 0, abs(shares[i, a] - shares[j, b]))
        for at in reversed(walked[1:]):
            half = len(at) // 2
            value = value[at[:half]] + value[at[half:]]
        return value[walked[0]].tolist()


def _distinct(i: np.ndarray, j: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    rows, at = np.unique(_joined(_joined(i, j)[0], _joined(a, b)[0])[0], return_index=True, return_inverse=True)[1:]
    return (i[rows], j[rows], a[rows], b[rows]), at


def _joined(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, int]:
    """One number for each pair of numbers; dense, so that joining again does not overflow."""
    keys, at = np.unique(x.astype(np.int64) * (int(y.max(initial=0)) + 1) + y, return_inverse=True)
    return at, len(keys)


def _priced(part: pa.Table) -> pa.Table:
    """All ordered pairs of the groups of a span, with the distance of their trees."""
    is_group = pc.is_null(part["term"])
    totals = {r["source"]: int(r["total"]) for r in part.select(["source", "total"]).filter(is_group).to_pylist()}
    sources = sorted(totals)
    cells = part.select(["source", "term", "n"]).filter(pc.invert(is_group))
    terms = cells["term"].combine_chunks().dictionary_encode()
    wide = 1 << max(0, len(terms.dictionary) - 1).bit_length()
    n = cells["n"].to_numpy()
    counts = np.zeros((len(sources), wide), object if n.max(initial=0) >= 1 << 62 else np.int64)
    counts[:, len(terms.dictionary) :] = -1
    counts[pc.index_in(cells["source"], pa.array(sources, pa.string())).to_numpy(), terms.indices.to_numpy()] = n
    forest, lists = Forest(counts), ([], [], [])
    left, right = np.triu_indices(len(sources), 1)
    for at in range(0, len(left), PAIRS):
        a, b = left[at : at + PAIRS], right[at : at + PAIRS]
        for i, j, value in zip(a.tolist(), b.tolist(), forest.distances(a, b, [totals[s] for s in sources])):
            for s, o in ((i, j), (j, i)):
                for column, x in zip(lists, (sources[s], sources[o], value)):
                    column.append(x)
    lang = part["lang"].slice(0, 1).to_pylist() * len(lists[0])
    return pa.table({"lang": pa.array(lang, pa.string()), "source": pa.array(lists[0], pa.string()), "item": pa.array(lists[1], pa.string()), "value": pa.array(lists[2], pa.int64())})


def audit(docs: DataFrame, *, least_docs: int = LEAST_DOCS, terms: int = TERMS, span: int = SPAN) -> DataFrame:
    """`lang, source, part, item, value, rank`: the other sources by distance, and the terms a source uses more than its language."""
    counts = stage(kept_counts(docs, least_docs))
    cells = counts.where("term is not null")
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count_if("first").alias("v"))
    langs = totals.groupBy("lang").agg(F.sum("v").alias("v"), F.sum("n").alias("lang_total"))
    groups = counts.where("term is null").select("lang", "source").join(totals.drop("v"), ["lang", "source"], "left").join(langs, "lang", "left")
    none = F.lit(0).cast(_SUM)
    groups = stage(groups.select("lang", "source", F.coalesce(F.col("n").cast(_SUM), none).alias("total"), F.coalesce("v", F.lit(0)).alias("v"), F.coalesce(F.col("lang_total").cast(_SUM), none).alias("lang_total")))

    spans = -(-max(1, groups.agg(F.max("v")).first()[0] or 0) // span)
    dealt = cells.select("lang", F.pmod(F.xxhash64("term"), F.lit(spans)).alias("span"), "source", "term", "n", F.lit(None).cast(_SUM).alias("total"))
    everywhere = groups.select("lang", F.explode(F.sequence(F.lit(0), F.lit(spans - 1)).cast("array<long>")).alias("span"), "source", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"), (F.col("total") + ADDED * F.col("v")).cast(_SUM).alias("total"))
    pairs = dealt.union(everywhere).groupBy("lang", "span").applyInArrow(_priced, "lang string, source string, item string, value long")
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    shares = cells.join(groups, ["lang", "source"]).where("n > 0")
    over = share(F.col("n"), F.col("total"), F.col("v")) - share(F.col("lang_n"), F.col("lang_total"), F.col("v"))
    used = shares.select("lang", "source", F.col("term").alias("item"), over.alias("value")).where("value > 0")
    down = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    columns = ("lang", "source", "part", "item", "value", "rank")
    most = used.withColumn("rank", F.row_number().over(down)).where(F.col("rank") <= terms).withColumn("part", F.lit("term"))
    return pairs.withColumn("rank", F.row_number().over(down)).withColumn("part", F.lit("pair")).select(*columns).union(most.select(*columns))

"""Nearest neighbours by inner product: multi-index hashing of learned binary codes, then exact scores.

Codes. Vectors get one more coordinate that makes them all equally long, so that the largest inner product is the smallest
angle. On a bounded sample rotations are learned that bring the coordinates close to the corners of a cube (iterative
quantisation, several starts); the signs of the rotated coordinates are a vector's code.

Radius. The neighbours of a bounded sample of rows are found exactly among all rows; the radius is the Hamming distance
within which the wanted share of them lies.

Index and search. Rows are dealt into blocks, and each block indexes the substrings of its codes: rows sorted by substring,
one list per value. If two codes differ in at most R bits, one of their substrings differs in at most its part of
R (the parts plus one add up to R + 1), so a query probes the values within that part and compares the whole codes of what
it finds: every code within the radius is found, none is missed. Values are enumerated where they are fewer than the
block's lists, else all lists are held against the query's substring. What lies within the radius gets its score from the
original vectors in double precision. A query that finds fewer than it wants asks again with a wider radius, at last all
codes, so each gets as many as there are.

Cases: vectors that are null, empty, zero, or hold null, NaN or infinity take no part, nor do those of another length than
the most common; rows with a null id take no part; of queries with equal ids one asks, and rows with the query's id are no
candidates of it; equal scores go by id; fewer rows than wanted are all returned; an empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

BITS, SUBSTRING = 256, 16
# Rows that rotations are learned from, and rows whose neighbours set the radius.
LEARNED, MEASURED = 16_384, 192
# Share of the measured neighbours that must lie within the radius.
WANTED = 0.97
# Rows and queries of a block; queries that are held against a block at a time.
ROWS, QUERIES, AT_ONCE = 131_072, 65_536, 128


class Coder:
    """Signs of learned rotations of the lengthened vectors."""

    def __init__(self, sample: np.ndarray, longest: float, bits: int = BITS, rounds: int = 20):
        self.longest = max(longest, 1e-300)
        x = self.lengthened(sample)
        # Principal directions of the sample, at most 64 of them.
        _, axes = np.linalg.eigh(x.T @ x)
        axes = axes[:, ::-1][:, :64]
        x, turns = x @ axes, []
        for start in range(-(-bits // axes.shape[1])):
            turn = np.linalg.qr(np.random.default_rng(start).standard_normal((axes.shape[1],) * 2))[0]
            for _ in range(rounds):
                u, _, v = np.linalg.svd(np.where(x @ turn >= 0, 1.0, -1.0).T @ x)
                turn = (u @ v).T
            turns.append(axes @ turn)
        self.turn = np.concatenate(turns, axis=1)[:, :bits]

    def lengthened(self, x: np.ndarray) -> np.ndarray:
        x = x / self.longest
        return np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1, keepdims=True)))], axis=1)

    def rows(self, x: np.ndarray) -> np.ndarray:
        return self._packed(self.lengthened(x))

    def queries(self, x: np.ndarray) -> np.ndarray:
        return self._packed(np.concatenate([x, np.zeros((len(x), 1))], axis=1))

    def _packed(self, x: np.ndarray) -> np.ndarray:
        return np.packbits(x @ self.turn >= 0, axis=1)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of codes, broadcast over all but the last axis."""
    wide = np.uint64 if a.shape[-1] % 8 == 0 else np.uint8
    a, b = (np.ascontiguousarray(x).view(wide) for x in (a, b))
    total = np.zeros(np.broadcast_shapes(a.shape[:-1], b.shape[:-1]), np.uint16)
    for k in range(a.shape[-1]):
        total += np.bitwise_count(a[..., k] ^ b[..., k])
    return total


def parts(radius: int, n: int) -> list[int]:
    """What each of `n` substrings may differ in: the parts plus one add up to `radius + 1`."""
    return [(radius + 1) // n + (k < (radius + 1) % n) - 1 for k in range(n)]


class SubstringIndex:
    """For each substring of the codes the values that occur, in order, and the rows that have each."""

    def __init__(self, codes: np.ndarray, width: int = SUBSTRING):
        self.codes, self.width = codes, width
        self.tables = []
        for values in self._substrings(codes):
            order = np.argsort(values, kind="stable")
            distinct, starts = np.unique(values[order], return_index=True)
            self.tables.append((distinct, np.append(starts, len(values)), order))

    def _substrings(self, codes: np.ndarray) -> list[np.ndarray]:
        step = self.width // 8
        kind = {1: np.uint8, 2: np.uint16}[step]
        return [np.ascontiguousarray(codes[:, k : k + step]).view(kind)[:, 0] for k in range(0, codes.shape[1], step)]

    def within(self, asked: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (query, row) of codes that differ in at most `radius` bits."""
        found = np.zeros((len(asked), len(self.codes)), bool)
        if radius >= self.codes.shape[1] * 8:
            found[:] = True
            return np.nonzero(found)
        for (values, starts, order), mine, part in zip(self.tables, self._substrings(asked), parts(radius, len(self.tables))):
            if part < 0 or found.all():
                continue
            if sum(comb(self.width, k) for k in range(part + 1)) < len(values):
                probes = mine[:, None] ^ _masks(self.width, part)[None, :]
                at = np.minimum(np.searchsorted(values, probes), len(values) - 1)
                query, probe = np.nonzero(values[at] == probes)
                listed = at[query, probe]
            else:
                query, listed = np.nonzero(np.bitwise_count(mine[:, None] ^ values[None, :]) <= part)
            n = starts[listed + 1] - starts[listed]
            place = np.repeat(starts[listed] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            found[np.repeat(query, n), order[place]] = True
        if found.mean() > 0.2:
            return np.nonzero(found & (differing(asked[:, None], self.codes[None]) <= radius))
        query, row = np.nonzero(found)
        near = differing(asked[query], self.codes[row]) <= radius
        return query[near], row[near]


_MASKS: dict[tuple[int, int], np.ndarray] = {}


def _masks(width: int, part: int) -> np.ndarray:
    """All values with at most `part` bits set."""
    if (width, part) not in _MASKS:
        every = np.arange(1 << width, dtype=np.uint8 if width == 8 else np.uint16)
        _MASKS[width, part] = every[np.bitwise_count(every) <= part]
    return _MASKS[width, part]


def _matrix(column: pa.Array | pa.ChunkedArray, n: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _bytes(column: pa.Array | pa.ChunkedArray, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(n, -1)


def _best(query: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the `k` best of each query, best first, ties by id."""
    order = np.lexsort((ids, -score, query))
    first = np.searchsorted(query[order], query[order])
    return order[np.arange(len(order)) - first < k]


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row, in double precision and always in the same order."""
    return (a.astype(np.float64) * b.astype(np.float64)).sum(axis=1)


def usable(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """`vec_id, vec, norm` of the rows that take part."""
    v = F.col("vec")
    # An element that is null, NaN or infinite makes the first or the second test fail.
    known = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    square = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    out = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vec")).where(v.isNotNull() & F.col("vec_id").isNotNull() & known)
    return out.withColumn("norm", F.sqrt(square)).where("norm > 0")


def _drawn(rows: DataFrame, n: int, most: int, seed: str) -> DataFrame:
    """About `most` of `n` rows by the hash of their id."""
    draw = F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 30))
    return rows.where(draw.cast("double") < F.lit(most * float(1 << 30) / max(n, 1))).limit(2 * most)


def search(
    rows: DataFrame, asks: Column, k: int, *, vec_id: str = "vec_id", vector: str = "embedding", wanted: float = WANTED, bits: int = BITS, width: int = SUBSTRING,
) -> DataFrame:
    """`query_id, rank, vec_id, score`: the `k` rows of largest inner product for each row that `asks` holds for.

    `asks` is a condition on the column `vec_id`.
    """
    spark = rows.sparkSession
    schema = "query_id long, vec_id long, score double"
    known = stage(usable(rows, vec_id, vector))
    lengths = known.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n"), F.max("norm").alias("longest"))
    told = lengths.orderBy(F.desc("n"), "d").first()
    if told is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    known, n = known.where(F.size("vec") == told.d), told.n
    sample = np.array([r.vec for r in _drawn(known, n, LEARNED, "learn").select("vec").collect()], np.float64).reshape(-1, told.d)
    coder = Coder(sample, told.longest, bits)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b["vec"], b.num_rows).astype(np.float64)
            codes = [pa.array([c.tobytes() for c in y], pa.binary()) for y in (coder.rows(x), coder.queries(x))]
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["vec"], *codes], ["vec_id", "vec", "code", "asked"])

    kind = known.schema["vec"].dataType.simpleString()
    index = stage(known.select("vec_id", "vec").mapInArrow(coded, f"vec_id long, vec {kind}, code binary, asked binary"))
    radius = _radius(index, n, k, wanted, bits)
    queries = index.where(asks).groupBy("vec_id").agg(F.min(F.struct("vec", "asked")).alias("q")).select("vec_id", "q.vec", F.col("q.asked").alias("code"))
    queries = stage(queries)
    n_queries = queries.count()

    def answered(asked: DataFrame, many: int, r: int) -> DataFrame:
        slots = int(spark.conf.get("spark.sql.shuffle.partitions"))
        row_blocks, query_blocks = max(-(-n // ROWS), min(slots, -(-n // 2_048))), -(-max(many, 1) // QUERIES)
        cell = F.pmod(F.xxhash64("vec_id"), F.lit(row_blocks)).alias("row_block")
        of_rows = index.select("vec_id", "vec", "code", cell, F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("query_block"))
        mine = F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int").alias("query_block")
        of_queries = asked.select("vec_id", "vec", "code", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1)).cast("array<long>")).alias("row_block"), mine)

        def met(left: pa.Table, right: pa.Table) -> pa.Table:
            columns = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
            if left.num_rows and right.num_rows:
                ids, x = left["vec_id"].to_numpy(), _matrix(left["vec"], left.num_rows)
                table = SubstringIndex(_bytes(left["code"], left.num_rows), width)
                q_ids, q_x, q_codes = right["vec_id"].to_numpy(), _matrix(right["vec"], right.num_rows), _bytes(right["code"], right.num_rows)
                for at in range(0, right.num_rows, AT_ONCE):
                    q, row = table.within(q_codes[at : at + AT_ONCE], r)
                    q, row = (y[q_ids[q + at] != ids[row]] for y in (q + at, row))
                    score = scores(q_x[q], x[row])
                    best = _best(q, score, ids[row], k)
                    for column, y in zip(columns, (q_ids[q[best]], ids[row[best]], score[best])):
                        column.append(y)
            return pa.table([np.concatenate(c) for c in columns], ["query_id", "vec_id", "score"])

        cells = of_rows.groupBy("row_block", "query_block").cogroup(of_queries.groupBy("row_block", "query_block")).applyInArrow(met, schema)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return cells.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    done, asked, many = None, queries, n_queries
    while True:
        found = stage(answered(asked, many, radius))
        if radius >= bits:
            return _put(done, found)
        full = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= min(k, n - 1))
        short = stage(asked.join(full, asked["vec_id"] == full["query_id"], "left_anti"))
        done = _put(done, found.join(short, found["query_id"] == short["vec_id"], "left_anti"))
        many = short.count()
        if not many:
            return done
        asked, radius = short, min(bits, radius + bits // 8)


def _put(done: DataFrame | None, more: DataFrame) -> DataFrame:
    more = more.select("query_id", "rank", "vec_id", "score")
    return more if done is None else done.union(more)


def _radius(index: DataFrame, n: int, k: int, wanted: float, bits: int) -> int:
    """The Hamming distance that holds the wanted share of the exact neighbours of a sample of rows."""
    some = _drawn(index, n, MEASURED, "measure").select("vec_id", "vec", "asked").collect()
    if not some:
        return bits
    q_ids, q_x = np.array([r.vec_id for r in some]), np.array([r.vec for r in some], np.float64)
    q_codes = np.frombuffer(b"".join(bytes(r.asked) for r in some), np.uint8).reshape(len(some), -1)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        for b in batches:
            ids, x, codes = b["vec_id"].to_numpy(), _matrix(b["vec"], b.num_rows).astype(np.float64), _bytes(b["code"], b.num_rows)
            score = np.where(q_ids[:, None] == ids[None, :], -np.inf, q_x @ x.T)
            top = np.argpartition(-score, min(k, len(ids)) - 1, axis=1)[:, : min(k, len(ids))]
            q, row = np.repeat(np.arange(len(q_ids)), top.shape[1]), top.ravel()
            new = (q, score[q, row], ids[row], differing(q_codes[q], codes[row]).astype(np.int64))
            held = [np.concatenate([x, y])for x, y in zip(held, new)]
            held = [y[_best(held[0], held[1], held[2], k)] for y in held]
        real = np.isfinite(held[1])
        yield pa.RecordBatch.from_arrays([pa.array(y[real]) for y in held], ["query", "score", "vec_id", "apart"])

    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    best = index.select("vec_id", "vec", "code").mapInArrow(nearest, "query long, score double, vec_id long, apart long").withColumn("rank", rank)
    # One row per distance.
    seen = best.where(F.col("rank") <= k).groupBy("apart").agg(F.count("*").alias("n")).orderBy("apart").collect()
    total, held = sum(r.n for r in seen), 0
    for r in seen:
        held += r.n
        if held >= wanted * total:
            return int(r.apart)
    return bits

"""URL filters over a sorted digest array.

A list of keys (host suffix + path prefix) is stored as three files: 64-bit xxhash digests in order, where each
stored string ends, and the strings. Every executor gets them once and its workers map them into memory; a batch of
urls is probed by vectorised binary search, and what is found is confirmed against the stored string, so equal digests
of different strings do no harm. Only pages of the files that are touched are in memory. `longest_keys_of` measures the list:
one that is too long to be copied to every executor is joined by digest and string instead, with the same result.

Cases: a url that is null or has no `://` has an empty host and path and fits no key; empty hosts fit nothing; repeated
keys are stored once; an empty list fits nothing; very long urls are cut nowhere. Other columns are not read. A page without
a body counts as one that is no junk.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_dir
from .common import stage, worker_cache

# The files are copied to every executor: a longer list is joined.
MAX_FILE_BYTES = 512 << 20
SEED = 42
PARTS = ("digests", "ends", "strings")
# A page is junk when more than one character in JUNK_RATIO is one of JUNK_SYMBOLS; a host with this share of junk pages is blocked.
JUNK_SYMBOLS, JUNK_RATIO, JUNK_PERCENT = "#*$%|", 50, 20


def host_of(url: Column) -> Column:
    return F.coalesce(_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _lower(column: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(column, upper, upper.lower())


def junk_hosts(pages: DataFrame) -> DataFrame:
    """The block list of a crawl, as `key`: hosts of `pages` (`host, html`) whose pages are junk in JUNK_PERCENT of all cases or more."""
    html = F.coalesce("html", F.lit(""))
    symbols = F.length(html) - F.length(F.translate(html, JUNK_SYMBOLS, ""))
    counts = pages.where("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count_if(JUNK_RATIO * symbols > F.length(html)).alias("junk"))
    return counts.where(100 * F.col("junk") >= JUNK_PERCENT * F.col("n")).select(F.col("host").alias("key"))


def longest_keys_of(rows: DataFrame, keys: DataFrame, path_lengths: Iterable[int], name: str) -> DataFrame:
    """Add the longest of `keys` that fits each row's `host, path` as column `name`: by a digest array, or by a join if the list is long."""
    kept = stage(keys.where(F.col("key").isNotNull()).select("key").distinct())
    size = kept.agg(F.sum(F.octet_length("key") + 16)).first()[0] or 0
    if size <= MAX_FILE_BYTES:
        return rows.withColumn(name, DigestArray(rows.sparkSession, kept, path_lengths).longest_match(F.col("host"), F.col("path")))
    return joined_keys(rows, kept, path_lengths, name)


def joined_keys(rows: DataFrame, keys: DataFrame, path_lengths: Iterable[int], name: str) -> DataFrame:
    """As the digest array finds them: each distinct host and path is asked for once, its possible keys meet the list by digest."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*(F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in sorted(set(path_lengths)))), lambda p: p.isNotNull())
    both = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    asked = rows.where("host <> ''").select("host", "path").distinct().select("host", "path", F.explode(F.array_distinct(both)).alias("key"))
    stored = keys.select(F.xxhash64("key").alias("_digest"), F.col("key").alias("_key"))
    found = (
        asked.join(stored, (F.xxhash64("key") == F.col("_digest")) & (F.col("key") == F.col("_key")))
        .groupBy(F.col("host").alias("_h"), F.col("path").alias("_p")).agg(F.max_by("key", F.length("key")).alias("_found"))
    )
    return rows.join(found, (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p")), "left").drop("_h", "_p").withColumnRenamed("_found", name)


def sorted_keys(keys: DataFrame) -> DataFrame:
    """`digest, key` of distinct keys in the order of the unsigned digest; made by Spark, whatever the length of the list."""
    digest = F.xxhash64(F.col("key"))  # the same as xxh64 of its UTF-8 bytes with seed 42
    # Digests with the top bit set are negative longs and come last.
    return keys.where(F.col("key").isNotNull()).select("key").distinct().withColumn("digest", digest).orderBy(F.col("digest") < 0, "digest", "key")


class DigestArray:
    """Writes the files to the shared folder and hands them to the executors."""

    def __init__(self, spark: SparkSession, keys: DataFrame, path_lengths: Iterable[int]):
        """`keys`: host suffix followed by path prefix; `path_lengths`: the lengths of those prefixes in characters."""
        self.spark = spark
        self.name = f"digests-{uuid.uuid4().hex}"
        self.lengths = sorted(set(path_lengths))
        self._write(sorted_keys(keys), f"{shared_dir(spark).rstrip('/')}/{self.name}")

    def _write(self, rows: DataFrame, path: str) -> None:
        """One pass over the ordered rows, a part at a time."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        places = [f"{path}.{part}" for part in PARTS]
        streams = []
        written = end = 0
        try:
            for place in places:
                where = jvm.org.apache.hadoop.fs.Path(place)
                streams.append(where.getFileSystem(conf).create(where, True))
            for chunk in _chunks(rows.toLocalIterator()):
                strings = [r.key.encode() for r in chunk]
                ends = end + np.cumsum([len(x) for x in strings])
                end = int(ends[-1])
                written += 16 * len(chunk) + sum(map(len, strings))
                if written > MAX_FILE_BYTES:
                    raise ValueError(f"a digest array of more than {MAX_FILE_BYTES} bytes; use `longest_keys_of`")
                for stream, data in zip(streams, (np.array([r.digest for r in chunk], "<i8").tobytes(), ends.astype("<u8").tobytes(), b"".join(strings))):
                    stream.write(bytearray(data))
        finally:
            for stream in streams:
                stream.close()
        for place in places:
            self.spark.sparkContext.addFile(place)

    def longest_match(self, host: Column, path: Column) -> Column:
        """The longest stored key that fits host and path, or null: the host or a domain above it, and a prefix of the path."""
        name, lengths = self.name, self.lengths

        @F.pandas_udf(T.StringType())
        def probe(hosts: pd.Series, paths: pd.Series) -> pd.Series:
            return pd.Series(longest_keys(_open([SparkFiles.get(f"{name}.{part}") for part in PARTS]), lengths, hosts.tolist(), paths.tolist()), dtype=object)

        return probe(host, path)


def _chunks(rows: Iterable, size: int = 65_536):
    part = []
    for row in rows:
        part.append(row)
        if len(part) == size:
            yield part
            part = []
    if part:
        yield part


def _open(paths: list[str]) -> list[np.ndarray]:
    """Digests, ends and string bytes, mapped once per worker."""
    cache = worker_cache("digest arrays")
    if paths[0] not in cache:
        kinds = ("<u8", "<u8", np.uint8)
        cache[paths[0]] = [np.memmap(p, k, "r") if os.path.getsize(p) else np.zeros(0, k) for p, k in zip(paths, kinds)]
    return cache[paths[0]]


def longest_keys(store, lengths: list[int], hosts: list[str], paths: list[str]) -> list[str | None]:
    """For each url the longest stored key among its host's suffixes joined with the path's prefixes of the stored lengths."""
    digests, ends, blob = store
    found: list[str | None] = [None] * len(hosts)
    owners, keys = [], []
    for i, (host, path) in enumerate(zip(hosts, paths)):
        if not host:
            continue
        prefixes = [path[:n] for n in lengths if n <= len(path)]
        at = 0
        while at >= 0:
            suffix = host[at:]
            for prefix in prefixes:
                owners.append(i)
                keys.append((suffix + prefix).encode())
            at = host.find(".", at)
            at = at + 1 if at >= 0 else -1
    if not keys or not len(digests):
        return found
    wanted = np.fromiter((xxhash.xxh64_intdigest(k, SEED) for k in keys), np.uint64, len(keys))
    at = np.searchsorted(digests, wanted)
    hits = np.flatnonzero(digests[np.minimum(at, len(digests) - 1)] == wanted)
    for k in hits.tolist():
        # Equal digests stand together; one of them has the string, or none has.
        j = int(at[k])
        while j < len(digests) and digests[j] == wanted[k]:
            stored = bytes(blob[int(ends[j - 1]) if j else 0 : int(ends[j])])
            if stored == keys[k]:
                text = stored.decode()
                i = owners[k]
                if found[i] is None or len(text) > len(found[i]):
                    found[i] = text
                break
            j += 1
    return found

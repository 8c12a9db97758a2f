"""Pack token sequences by Karmarkar-Karp multiway differencing.

Documents are tokenized once, where they lie, and cut into pieces of at most one window; only the pieces' sizes move.
Pieces are hashed into groups of bounded size. In each group a heap holds partial partitions; the two with the widest
spread are merged with opposing imbalances (the fullest window of one with the emptiest of the other) until one is left:
windows of nearly equal size. Where one exceeds the capacity, the number of windows rises and the group is solved anew.

Cases: a null or empty text is one piece that holds the end token only; equal documents are packed like others; an empty
table gives no pieces. Other columns are not read.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, worker_cache

CAPACITY = 4_096
# Documents are cut after so many tokens; a smaller piece gives no fuller windows.
PIECE = CAPACITY
# Pieces that one call solves, on average.
GROUP = 512
# Entries that a worker keeps of words and of strings between white space.
CACHED = 400_000

# The vocabulary's own way of taking text apart, for text in ASCII and Latin-1 letters: fixed values.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[a-zßà-öø-ÿ]+|[0-9]|[^\sa-z0-9ßà-öø-ÿ]+"
_PLAIN = r"[\x21-\x7eÀ-ÖØ-öø-ÿ]*"


class WordTokenizer:
    """Ids of texts under a word-wise BPE vocabulary, equal to encoding them whole.

    White space separates words, so each string between white space is encoded once and looked up afterwards; of plain
    strings, each word in them. Strings with other characters are left to the library as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.strings: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.split = re.compile(_SPLIT).findall
        self.plain = re.compile(_PLAIN).fullmatch
        # Bytes beyond ASCII as the vocabulary spells them: printable Latin-1 as itself, the rest moved up.
        odd = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
        self.spelled = {b: chr(256 + i) for i, b in enumerate(odd)}

    def _word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            spelled = word if word.isascii() else word.encode().decode("latin-1").translate(self.spelled)
            ids = np.array([t.id for t in self.model.tokenize(spelled)], "<u4").tobytes()
            if len(self.words) >= CACHED:
                self.words.clear()
            self.words[word] = ids
        return ids

    def _string(self, raw: bytes) -> bytes:
        text = raw.decode("utf-8", "replace")
        if self.plain(text) and "<|" not in text:
            ids = b"".join(map(self._word, self.split(text.lower())))
        else:
            ids = np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self.strings) >= CACHED:
            self.strings.clear()
        self.strings[raw] = ids
        return ids

    def ids(self, raw: bytes) -> bytes:
        """Little-endian 32-bit ids of a UTF-8 text."""
        get, new = self.strings.get, self._string
        return b"".join([get(s) or new(s) for s in raw.split()])


def tokenizer(path: str) -> WordTokenizer:
    cache = worker_cache("tokenizers")
    if path not in cache:
        cache[path] = WordTokenizer(path)
    return cache[path]


def pieces(docs: DataFrame, vocabulary: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = 2, piece: int = PIECE) -> DataFrame:
    """One row per piece: `doc_id, start, length, ids_crc32, doc_tokens`."""
    kind = docs.schema[doc_id].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    longs = ["start", "length", "ids_crc32", "doc_tokens"]

    # In Arrow: pandas makes floats of a batch's ids as soon as one is null, which rounds those above 2^53.
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(vocabulary)
        for batch in batches:
            rows = []
            for i, raw in enumerate(batch["raw"].to_pylist()):
                ids = encode.ids(raw) + end
                n = len(ids) // 4
                rows += [(i, at, min(piece, n - at), zlib.crc32(ids[4 * at : 4 * (at + piece)]), n) for at in range(0, n, piece)]
            own, *others = (pa.array([r[k] for r in rows], pa.int64()) for k in range(5))
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(own), *others], ["doc_id", *longs])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("raw"))
    return rows.mapInArrow(cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Indices of `sizes` in at most `k` windows, by multiway differencing."""
    heap = []
    for i, size in enumerate(sizes):
        # Spread is largest minus smallest window; windows that are still empty are not listed.
        heap.append((-(size if k > 1 else 0), i, [(size, [i])]))
    heapq.heapify(heap)
    made = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        shared = len(a) + len(b) - k
        if shared <= 0:
            merged = a + b
        else:
            # a's smallest windows meet b's smallest in opposite order; the rest of both stand alone.
            low, other = a[len(a) - shared :], b[len(b) - shared :]
            merged = a[: len(a) - shared] + b[: len(b) - shared] + [(x + y, p + q) for (x, p), (y, q) in zip(low, reversed(other))]
        merged.sort(key=lambda w: -w[0])
        spread = merged[0][0] - (merged[-1][0] if len(merged) == k else 0)
        heapq.heappush(heap, (-spread, made, merged))
        made += 1
    return [window for _, window in heap[0][2]] if heap else []


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of at most `capacity`; their number starts at the least possible and rises while one is exceeded."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        made = difference(sizes, k)
        over = sum(max(0, sum(sizes[i] for i in w) - capacity) for w in made)
        if not over:
            return made
        k += max(1, over // capacity)


def pack(cut: DataFrame, *, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Add `sequence_id` and `offset` to pieces. `cut` is written once and read back; only sizes are grouped."""
    rows = stage(cut)
    groups = -(-max(1, rows.count()) // group)
    kind = rows.schema["doc_id"].dataType.simpleString()

    order = [("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")]

    # In Arrow, as in `pieces`.
    def solve(key: tuple, part: pa.Table) -> pa.Table:
        part = part.drop_columns("_group").take(pc.sort_indices(part, order, null_placement="at_end"))
        sizes = part["length"].to_pylist()
        sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for w, members in enumerate(windows(sizes, capacity)):
            at = 0
            for i in members:
                sequence[i], offset[i] = (key[0].as_py() << 24) + w, at
                at += sizes[i]
        return part.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    dealt = rows.withColumn("_group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)))
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return dealt.groupBy("_group").applyInArrow(solve, schema)

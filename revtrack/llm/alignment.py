"""Align the tokens of two tokenizers on the bytes both spell, and count which tokens meet.

A is a byte-level BPE over a blank and the text, B a sentencepiece model over the text, which adds that blank itself. Where
a token of A and one of B end at the same byte, a group ends; each pair of tokens whose bytes overlap is a link.

Most groups are one token against one of the same bytes. For those an array maps each id of A to the id of B that spells
the same, so documents that hold such a pair are counted in one vector as long as the vocabulary, and looked up there
again. Only the other pairs are shuffled to be counted, and joined back to the documents that hold them.

Cases: a text that is null, empty, or that either tokenizer does not give back byte by byte (a text with U+2581, for
instance) has no tokens, so zeros and an empty digest; equal texts count once for each row; of ids that spell the same,
the one that is no single-byte fallback is the mapped one, and pairs with the other are counted as irregular; null and
repeated ids are rows like others; very long texts are encoded whole; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, worker_cache

# Blocks up to U+052F have had their letters for long, so any two regex engines split them alike.
_SETTLED = re.compile("[^\x00-ԯ]")


def _byte_of() -> dict[str, int]:
    """The characters a byte-level vocabulary spells bytes with: printable Latin-1 as itself, the rest moved up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(odd)}}


class Pair:
    """Both tokenizers, the bytes of each id, and the ids of B by those of A that spell the same."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path_a)
        self.whole.encode_special_tokens = True
        spell = _byte_of()
        with open(path_a, encoding="utf-8") as file:
            told = json.load(file)
        vocab = {i: bytes(spell[c] for c in piece) for piece, i in told["model"]["vocab"].items()}
        self.bytes_a = [vocab.get(i, b"") for i in range(1 + max(vocab))]
        self.fast = _ranked(told, self.bytes_a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        size = self.b.get_piece_size()
        self.bytes_b = [self._spelled(i) for i in range(size)]
        self.len_a, self.len_b = (np.array([len(x) for x in xs], np.int64) for xs in (self.bytes_a, self.bytes_b))
        by_bytes = {x: i for i, x in sorted(enumerate(self.bytes_b), key=lambda e: not self.b.is_byte(e[0]))}
        self.same = np.array([by_bytes.get(x, -1) if x else -1 for x in self.bytes_a], np.int64)
        # How an id is written, by what follows it: another one of its group, the other side, the next group.
        self.written = [b"%d%s" % (i, end) for end in (b",", b"|", b";") for i in range(max(len(self.bytes_a), size))]

    def _spelled(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def ids(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        led = [" " + t for t in texts]
        if self.fast is None:
            ours = [e.ids for e in self.whole.encode_batch(led, add_special_tokens=False)]
        else:
            ours = [
                self.whole.encode(t, add_special_tokens=False).ids if _SETTLED.search(t) else self.fast.encode_ordinary(t) for t in led
            ]
        return ours, self.b.encode(texts, num_threads=1)


def _ranked(told: dict, spelled: list[bytes]):
    """The same vocabulary for the faster library, where its way of splitting and merging is the usual one; else None."""
    import public_tokenizers
    import tiktoken

    how, model = told.get("pre_tokenizer") or {}, told["model"]
    usual = not told.get("normalizer") and how.get("type") == "ByteLevel" and how.get("use_regex") and not how.get("add_prefix_space")
    made = [m if isinstance(m, str) else "".join(m) for m in model["merges"]]
    order = [model["vocab"].get(m.replace(" ", "")) for m in made]
    if not usual or None in order or order != sorted(order) or model.get("ignore_merges"):
        return None
    ranks = {x: i for i, x in enumerate(spelled) if x}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _pair(paths: tuple[str, str]) -> Pair:
    cache = worker_cache("tokenizer pairs")
    if paths not in cache:
        cache[paths] = Pair(*paths)
    return cache[paths]


def aligned(pair: Pair, texts: list[str | None]) -> tuple[dict[str, np.ndarray], list[str]]:
    """Counts and digests of each text; of each text's distinct links `owner, a, b, times`, in one go for all texts."""
    ours, theirs = [[]] * len(texts), [[]] * len(texts)
    given = [i for i, t in enumerate(texts) if t]
    spell_a, spell_b = pair.bytes_a.__getitem__, pair.bytes_b.__getitem__
    for i, x, y in zip(given, *pair.ids([texts[i] for i in given])):
        want = b" " + texts[i].encode()
        if b"".join(map(spell_a, x)) == want == b"".join(map(spell_b, y)):
            ours[i], theirs[i] = x, y
    n_a, n_b = (np.array([len(x) for x in xs], np.int64) for xs in (ours, theirs))
    ids_a, ids_b = (np.fromiter(chain.from_iterable(xs), np.int64, int(n.sum())) for xs, n in ((ours, n_a), (theirs, n_b)))
    # Both sides spell the same bytes, so offsets counted through all texts agree at each text's end.
    ends_a, ends_b = np.cumsum(pair.len_a[ids_a]), np.cumsum(pair.len_b[ids_b])
    shut_a, shut_b = np.isin(ends_a, ends_b, assume_unique=True), np.isin(ends_b, ends_a, assume_unique=True)
    owner_a = np.repeat(np.arange(len(texts)), n_a)
    out = {"n_a": n_a, "n_b": n_b, "n_groups": np.bincount(owner_a[shut_a], minlength=len(texts))}
    # Between two neighbouring ends of either side one token of A meets one of B.
    ends = np.union1d(ends_a, ends_b)
    at_a, at_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    owner = owner_a[at_a]
    out["n_links"] = np.bincount(owner, minlength=len(texts))
    wide = len(pair.bytes_b)
    keys, times = np.unique((owner * len(pair.bytes_a) + ids_a[at_a]) * wide + ids_b[at_b], return_counts=True)
    rest, b = np.divmod(keys, wide)
    owner, a = np.divmod(rest, len(pair.bytes_a))
    out |= {"owner": owner, "a": a, "b": b, "times": times}
    # Written out: the tokens of A of a group, then those of B.
    v = len(pair.written) // 3
    code_a, code_b = ids_a + v * shut_a, ids_b + 2 * v * shut_b
    group_a, group_b = np.cumsum(shut_a) - shut_a, np.cumsum(shut_b) - shut_b
    placed = np.empty(len(code_a) + len(code_b), np.int64)
    placed[np.arange(len(code_a)) + np.searchsorted(group_b, group_a)] = code_a
    placed[np.arange(len(code_b)) + np.searchsorted(group_a, group_b, side="right")] = code_b
    digests, at, write = [], 0, pair.written.__getitem__
    for n in (n_a + n_b).tolist():
        digests.append(hashlib.sha256(b"".join(map(write, placed[at : at + n].tolist()))[:-1]).hexdigest() if n else "")
        at += n
    return out, digests


def _lists(owner: np.ndarray, n: int, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32()), values)


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def alignments(docs: DataFrame, path_a: str, path_b: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: `row, doc_id`, its counts and digest, `same` (its links of one spelling) and `odd` (the others)."""
    kind = docs.schema[doc_id].dataType.simpleString()
    same_of, odd_of = pa.struct([("a", pa.int32()), ("times", pa.int32())]), pa.struct([("a", pa.int32()), ("b", pa.int32()), ("times", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair((path_a, path_b))
        for batch in batches:
            n = batch.num_rows
            told, digests = aligned(pair, batch["text"].to_pylist())
            owner, *link = (told[k] for k in ("owner", "a", "b", "times"))
            same = pair.same[link[0]] == link[1]
            a, b, times = (pa.array(x.astype(np.int32)) for x in link)
            pick, rest = pa.array(same), pa.array(~same)
            columns = [batch["row"], batch["doc_id"], *(pa.array(told[k].astype(np.int64)) for k in _COUNTS), pa.array(digests, pa.string())]
            columns.append(_lists(owner[same], n, pa.StructArray.from_arrays([x.filter(pick) for x in (a, times)], fields=list(same_of))))
            columns.append(_lists(owner[~same], n, pa.StructArray.from_arrays([x.filter(rest) for x in (a, b, times)], fields=list(odd_of))))
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", *_COUNTS, "groups_sha256", "same", "odd"])

    # In Arrow: pandas makes floats of a batch's ids as soon as one is null.
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    counts = ", ".join(f"{c} long" for c in _COUNTS)
    return rows.mapInArrow(
        run,
        f"row long, doc_id {kind}, {counts}, groups_sha256 string, same array<struct<a:int,times:int>>, odd array<struct<a:int,b:int,times:int>>",
    )


def same_counts(rows: DataFrame, size: int) -> DataFrame:
    """`a, n`: documents that hold an id of A linked with the id of its own spelling, summed in one vector per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, np.int64)
        for batch in batches:
            held += np.bincount(batch["ids"].flatten().to_numpy(), minlength=size)
        a = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(held[a])], ["a", "n"])

    return rows.select(F.col("same.a").alias("ids")).mapInArrow(run, "a int, n long").groupBy("a").agg(F.sum("n").alias("n"))


def align(docs: DataFrame, path_a: str, path_b: str, **columns: str) -> tuple[DataFrame, DataFrame]:
    """Documents with `n_best, count_sum` beside their counts, and the table `a, b, n, best` of all irregular id pairs."""
    rows = stage(alignments(docs, path_a, path_b, **columns))
    size = len(_pair((path_a, path_b)).bytes_a)
    odd = rows.select("row", F.explode("odd").alias("l")).select("row", "l.*")
    pairs = stage(odd.groupBy("a", "b").agg(F.count("*").alias("n")))
    # Both tables below have a row for each id of the vocabulary at most.
    same, most = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for r in same_counts(rows, size).collect():
        same[r.a] = most[r.a] = r.n
    for r in pairs.groupBy("a").agg(F.max("n").alias("n")).collect():
        most[r.a] = max(most[r.a], r.n)
    best = same == most

    @F.pandas_udf("n_best long, count_sum long")
    def looked_up(ids, times):
        import pandas as pd

        n = [len(x) for x in ids]
        owner = np.repeat(np.arange(len(n)), n)
        a, t = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (ids, times))
        total = [np.zeros(len(n), np.int64) for _ in range(2)]
        np.add.at(total[0], owner, t * best[a])
        np.add.at(total[1], owner, t * same[a])
        return pd.DataFrame({"n_best": total[0], "count_sum": total[1]})

    top = docs.sparkSession.createDataFrame([(int(a), int(most[a])) for a in np.flatnonzero(most)], "a int, most long")
    pairs = pairs.join(F.broadcast(top), "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))
    # Pairs stand once each, so a frequent one meets only its own links; Spark broadcasts them while they are few.
    met = odd.join(pairs, ["a", "b"]).groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("times") * F.col("n")).alias("_sum")
    )
    seen = rows.withColumn("_same", looked_up(F.col("same.a"), F.col("same.times"))).drop("same", "odd")
    out = seen.join(met, "row", "left").withColumns({
        "n_best": F.col("_same.n_best") + F.coalesce("_best", F.lit(0)), "count_sum": F.col("_same.count_sum") + F.coalesce("_sum", F.lit(0)),
    })
    return out.drop("row", "_same", "_best", "_sum"), pairs

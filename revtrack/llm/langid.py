"""Language identification with error-correcting output codes.

Every language has a codeword. For each bit, a binary classifier over hashed byte n-grams says on which side a text
lies: the log-ratio of n-gram frequencies of the two groups of languages, averaged over the text. Decoding sums the
exponential losses of a language's bits, weighted by how well each bit's classifier does on that language; the smallest
sum wins. A text whose two best sums are close is flagged as ambiguous.

Cases: a null text or one without a letter is `und` with score 0, never ambiguous; with no learned language every text
is `und`, with one every other text is that language; equal sums go to the first language by code point; repeated rows
are learned as often as they occur; rows with a null language or id are not learned from. Texts are read whole.
"""

from __future__ import annotations

import itertools
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage, worker_cache

BITS = 14
# Rows of each language that are learned from, at most about; by the hash of their ids.
SAMPLE_PER_LANGUAGE = 3_000
MAX_LANGUAGES = 1_000
SMOOTHING = 0.5
# Two best losses nearer than this, as a share of the best: ambiguous.
AMBIGUOUS = 0.02
UNDETERMINED = "und"

_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_ONE, _TWO, _THREE = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)


def normalised(raw: bytes) -> bytes:
    """Lower-case words with one space around each; empty without a letter."""
    text = raw.decode("utf-8", "replace").lower()
    plain = text.encode().translate(_LETTERS).split()
    if not plain or (text.isascii() is False and not any(c.isalpha() for c in text)):
        return b""
    return b" " + b" ".join(plain) + b" "


def gram_counts(text: bytes) -> np.ndarray:
    """Counts of hashed 1- to 3-byte grams (2^BITS cells)."""
    b = np.frombuffer(text, np.uint8).astype(np.uint32) + np.uint32(1)
    shift = np.uint32(32 - BITS)
    two = b[:-1] * np.uint32(257) + b[1:]
    three = two[:-1] * np.uint32(257) + b[2:]
    cells = np.concatenate([b * _ONE >> shift, two * _TWO >> shift, three * _THREE >> shift])
    return np.bincount(cells, minlength=1 << BITS)


def codewords(k: int) -> np.ndarray:
    """`k` codewords of +1 and -1: every split of the languages for up to five, else the best of seeded random codes."""
    if k <= 5:
        bits = [(1, *b) for b in itertools.product((1, -1), repeat=k - 1) if -1 in b]
        return np.array(bits, np.float32).T.reshape(k, len(bits))
    length, draw = math.ceil(10 * math.log2(k)), np.random.default_rng(7)
    best, widest = None, -1
    for _ in range(50):
        code = draw.choice(np.array([1, -1], np.float32), (k, length))
        gaps = (length - code @ code.T) / 2
        np.fill_diagonal(gaps, length)
        if gaps.min() > widest and (np.abs(code.sum(0)) < k).all():
            best, widest = code, gaps.min()
    return best


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    code: np.ndarray | None = None  # language x bit
    weights: np.ndarray | None = None  # n-gram x bit
    scale: np.ndarray | None = None  # per bit
    trust: np.ndarray | None = None  # language x bit; rows add up to 1
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def margins(self, texts: list[bytes]) -> np.ndarray:
        """Mean log-ratio of each bit for normalised texts."""
        out = np.zeros((len(texts), self.weights.shape[1]), np.float32)
        for at in range(0, len(texts), 64):
            part = texts[at : at + 64]
            counts = np.stack([gram_counts(t).astype(np.float32) / (3 * len(t)) if t else np.zeros(1 << BITS, np.float32) for t in part])
            out[at : at + 64] = counts @ self.weights
        return out

    def losses(self, margins: np.ndarray) -> np.ndarray:
        y = np.clip(margins * self.scale, -4, 4)
        return np.stack([(np.exp(-y * self.code[k]) * self.trust[k]).sum(1) for k in range(len(self.languages))], 1)

    def predict(self, raws: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and ambiguity of UTF-8 texts (null: None)."""
        texts = [normalised(r) if r else b"" for r in raws]
        some = np.array([bool(t) for t in texts], bool)
        if not self.languages:
            some[:] = False
        if len(self.languages) < 2:
            only = self.languages[0] if self.languages else UNDETERMINED
            return [only if s else UNDETERMINED for s in some], some.astype(float), np.zeros(len(texts), bool)
        loss = self.losses(self.margins(texts))
        best = loss.argmin(1)
        ordered = np.sort(loss, 1)
        share = np.exp(-4 * (loss - ordered[:, :1]))
        score = np.where(some, 1 / share.sum(1), 0.0)
        ambiguous = some & (ordered[:, 1] - ordered[:, 0] < AMBIGUOUS * ordered[:, 0])
        return [self.languages[k] if s else UNDETERMINED for k, s in zip(best.tolist(), some.tolist())], score, ambiguous


def fit(rows: DataFrame, *, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Learn from `doc_id, text, lang`. What reaches the driver is n-gram counts and bit accuracies per language."""
    known = rows.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    counts = stage(counts)
    if counts.count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    # As a double: the product passes 2^63 from 2^23 rows of one language.
    draw = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 40))
    drawn = known.join(F.broadcast(counts), "lang").where(draw.cast("double") * F.col("n") < F.lit(per_language) * F.lit(1 << 40).cast("double"))
    chosen = stage(drawn.select("lang", F.col("text").cast("binary").alias("raw")))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, raw in zip(batch["lang"], batch["raw"]):
                if raw and (text := normalised(raw)):
                    # Each text counts the same, whatever its length.
                    own = gram_counts(text) / (3 * len(text))
                    sums[lang] = sums[lang] + own if lang in sums else own
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "at": at.astype(np.int32), "n": total[at]})

    # At most languages x 2^BITS rows.
    table = chosen.mapInPandas(count, "lang string, at int, n double").groupBy("lang", "at").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(table["lang"].unique(), key=lambda s: s.encode())
    if len(languages) < 2:
        return Model(languages)
    grams = np.zeros((len(languages), 1 << BITS))
    place = {lang: i for i, lang in enumerate(languages)}
    grams[table["lang"].map(place).to_numpy(), table["at"].to_numpy()] = table["n"].to_numpy()
    smooth = SMOOTHING / (1 << BITS)
    share = (grams / grams.sum(1, keepdims=True) + smooth) / (1 + SMOOTHING)
    code = codewords(len(languages))
    side = lambda sign: np.stack([share[code[:, j] == sign].mean(0) for j in range(code.shape[1])], 1)
    weights = (np.log(side(1)) - np.log(side(-1))).astype(np.float32)
    bare = Model(languages, code, weights, np.ones(code.shape[1], np.float32), np.full(code.shape, 1 / code.shape[1], np.float32))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        right, size, seen = np.zeros(code.shape), np.zeros(code.shape), np.zeros(code.shape)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                texts = [normalised(r) if r else b"" for r in part["raw"]]
                some = [i for i, (t, lang) in enumerate(zip(texts, part["lang"])) if t and lang in place]
                if some:
                    m = bare.margins([texts[i] for i in some])
                    of = np.array([place[part["lang"].iloc[i]] for i in some])
                    np.add.at(right, of, m * code[of] > 0)
                    np.add.at(size, of, np.abs(m))
                    np.add.at(seen, of, 1)
        k, j = np.nonzero(seen)
        yield pd.DataFrame({"k": k, "j": j, "right": right[k, j], "size": size[k, j], "seen": seen[k, j]})

    told = chosen.mapInPandas(judge, "k int, j int, right double, size double, seen double").groupBy("k", "j").agg(
        F.sum("right").alias("right"), F.sum("size").alias("size"), F.sum("seen").alias("seen")
    ).toPandas()
    right, size, seen = (np.zeros(code.shape) for _ in range(3))
    for name, into in (("right", right), ("size", size), ("seen", seen)):
        into[told["k"], told["j"]] = told[name]
    accuracy = (right + 1) / (seen + 2)
    trust = accuracy / accuracy.sum(1, keepdims=True)
    scale = seen.sum(0) / np.maximum(size.sum(0), 1e-9)
    return Model(languages, code, weights, scale.astype(np.float32), trust.astype(np.float32))


def identify(model: Model, text: Column) -> Column:
    """Struct `lang_pred, score, ambiguous` of a text."""

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def identified(raw: pd.Series) -> pd.DataFrame:
        worker_cache("languages")  # empty: gives back what another operator has left in the worker
        lang, score, ambiguous = model.predict(raw.tolist())
        return pd.DataFrame({"lang_pred": lang, "score": score, "ambiguous": ambiguous})

    return identified(text.cast("binary"))

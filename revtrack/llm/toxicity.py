"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, pairs of neighbours, and pairs with one or two words between.
The learner sees a bounded sample of labelled rows as a stream: per-coordinate learning rates, and L1 keeps all but
few weights at zero, so the model is a short list that goes to every task. Scores are those of the sample's share of
toxic rows (up to a third), so that a rare class is not lost to the prior.

Cases: a null or empty text has no features and gets the score of the intercept; repeated words count once; a document
labelled more than once is toxic if one label says so; null labels and labels without a document are not learned from;
without any label the score is 0.5 everywhere, an intercept of 0. Very long texts are read whole.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stage, worker_cache

BITS = 20
# Rows of each class that are learned from, at most; those with the smallest hashes of their ids.
SAMPLE_PER_CLASS = {0: 12_000, 1: 6_000}
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 0.0
# A toxic row weighs as much as so many others.
TOXIC_WEIGHT = 2.0

_SEPARATE = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_SALTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Document numbers and feature hashes of a batch of UTF-8 texts; a feature may come up again in a document."""
    words = [t.lower().translate(_SEPARATE).split() for t in texts]
    owner = np.repeat(np.arange(len(words), dtype=np.int32), [len(w) for w in words])
    own = np.fromiter((zlib.crc32(w) for part in words for w in part), np.uint64, len(owner))
    own = (own + np.uint64(1)) * _SALTS[0]
    shift = np.uint64(64 - BITS)
    owners, found = [owner], [(own >> shift).astype(np.int32)]
    for apart in (1, 2, 3):
        pair = (own[:-apart] ^ (own[apart:] >> np.uint64(17))) * _SALTS[apart] + own[apart:] * _SALTS[0]
        pair ^= pair >> np.uint64(29)
        together = owner[:-apart] == owner[apart:]
        owners.append(owner[:-apart][together])
        found.append(((pair * _SALTS[1]) >> shift).astype(np.int32)[together])
    return np.concatenate(owners), np.concatenate(found)


@dataclass
class Model:
    """Intercept and the weights that are not zero."""

    intercept: float = 0.0
    index: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def dense(self) -> np.ndarray:
        cache = worker_cache("toxicity")
        if self.name not in cache:
            cache.clear()
            cache[self.name] = np.zeros(1 << BITS, np.float32)
            cache[self.name][self.index] = self.weight
        return cache[self.name]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        owner, index = features(texts)
        weights = self.dense()
        hit = weights[index] != 0
        # Each feature of a document counts once.
        once = np.unique((owner[hit].astype(np.int64) << BITS) | index[hit])
        total = np.bincount(once >> BITS, weights[once & ((1 << BITS) - 1)], len(texts)) + self.intercept
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


class Ftrl:
    """FTRL-proximal with per-coordinate rates over binary features; the last coordinate is the intercept, free of L1."""

    def __init__(self):
        self.z = np.zeros((1 << BITS) + 1)
        self.n = np.zeros((1 << BITS) + 1)

    def weights(self, index: np.ndarray) -> np.ndarray:
        z = self.z[index]
        l1 = np.where(index == 1 << BITS, 0.0, L1)
        shrunk = np.sign(z) * np.maximum(np.abs(z) - l1, 0)
        return -shrunk / ((BETA + np.sqrt(self.n[index])) / ALPHA + L2)

    def learn(self, index: np.ndarray, label: int) -> None:
        w = self.weights(index)
        g = (1 / (1 + math.exp(-max(-30.0, min(30.0, w.sum())))) - label) * (TOXIC_WEIGHT if label else 1.0)
        n = self.n[index]
        self.z[index] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[index] = n + g * g


def sample(labels: DataFrame, per_class: dict[int, int] | None = None) -> DataFrame:
    """`doc_id, label` of about `per_class` rows of each label at most: ids whose hash is below the class's share."""
    per_class = per_class or SAMPLE_PER_CLASS
    once = labels.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    counts = once.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("label").isin(0, 1))
    # As a double: the product passes 2^63 from 2^23 rows of one label.
    draw = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 40))
    most = F.when(F.col("label") == 1, per_class[1]).otherwise(per_class[0])
    drawn = once.join(F.broadcast(counts), "label").where(draw.cast("double") * F.col("n") < most * F.lit(1 << 40).cast("double"))
    return drawn.select("doc_id", "label")


def fit(docs: DataFrame, labels: DataFrame, *, per_class: dict[int, int] | None = None) -> Model:
    """Learn from `docs` (`doc_id, text`) and `labels` (`doc_id, label`).

    The sample is bounded, so one task can read it as a stream; its memory does not depend on the length of the texts.
    """
    chosen = stage(sample(labels, per_class))
    if chosen.isEmpty():
        return Model()

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            owner, index = features(batch["raw"].tolist())
            once = np.unique((owner.astype(np.int64) << BITS) | index)
            cuts = np.searchsorted(once >> BITS, np.arange(1, len(batch)))
            parts = np.split((once & ((1 << BITS) - 1)).astype("<i4"), cuts)
            yield pd.DataFrame({"turn": batch["turn"], "label": batch["label"], "found": [p.tobytes() for p in parts]})

    # The sample has about 18,000 rows at most: small enough to go to every task.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(
        F.xxhash64("doc_id", F.lit("order")).alias("turn"), "label", F.coalesce("text", F.lit("")).cast("binary").alias("raw")
    )
    stream = stage(rows.mapInPandas(extract, "turn long, label int, found binary"))

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        learner = Ftrl()
        last = np.array([1 << BITS], np.int64)
        for batch in batches:
            for label, found in zip(batch["label"].tolist(), batch["found"]):
                learner.learn(np.concatenate([np.frombuffer(found, "<i4"), last]), label)
        every = np.arange((1 << BITS) + 1)
        w = learner.weights(every)
        keep = np.flatnonzero(w)
        yield pd.DataFrame({"at": keep, "w": w[keep]})

    epochs = stream.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(EPOCHS))))
    ordered = epochs.repartition(1).sortWithinPartitions("epoch", "turn", "label").drop("epoch", "turn")
    weights = ordered.mapInPandas(learn, "at long, w double").toPandas()  # at most 2^BITS + 1 rows
    at, w = weights["at"].to_numpy(), weights["w"].to_numpy()
    intercept = float(w[at == 1 << BITS].sum())
    short = at < 1 << BITS
    return Model(intercept, at[short].astype(np.int32), w[short].astype(np.float32))


def score(model: Model, text: Column) -> Column:
    """Probability that a text is toxic."""

    @F.pandas_udf(T.DoubleType())
    def scored(raw: pd.Series) -> pd.Series:
        return pd.Series(model.scores(raw.tolist()))

    return scored(F.coalesce(text, F.lit("")).cast("binary"))

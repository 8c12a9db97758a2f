"""Robust multivariate outliers: minimum covariance determinant estimates per language and source.

Every text gives a vector of transformed statistics. For each group (language and source) the estimate with the smallest
covariance determinant over a share COVERED of its rows is sought from several fixed starts (STARTS) by concentration
steps: distances under the present estimate, the nearest share of rows, their mean and covariance, again. A few steps are
taken from every start; the one with the least determinant is then followed until the determinant falls no further in any group.
Steps are Spark aggregates: rows are added up per group, start and distance bin, so a step moves a few hundred rows per
group and start whatever the group's size, and no group is ever gathered. A text is rejected when its robust Mahalanobis
distance is above the cutoff.

Cases: a null text has no words; rows with a null language or source form groups of their own; groups of fewer than
LEAST_GROUP rows are estimated together by language, and those still too few as one; if that too has fewer rows, its texts
get no distance and are not rejected; statistics that vary less than FLOOR in a group, or not at all, get the deviation FLOOR;
very long texts are read whole; repeated rows count as often as they occur; of equal determinants the first start's is taken;
an empty table gives an empty result; columns of other names are neither read nor changed by `keep`.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage, worker_cache

MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
SYMBOLS = b"#*$%&|<>"
WINDOW = 5

# Share of a group's rows that its estimate rests on; concentration steps from every start, and at most from the best one.
COVERED, FIRST_STEPS, STEPS = 0.75, 2, 10
# A determinant that falls by less than this in its logarithm has settled.
SETTLED = 1e-3
# Where concentration starts: around the medians, with the quartile ranges alone, or with the correlations of all rows,
# of rows drawn in by the hyperbolic tangent, or of their directions.
STARTS = ("quartiles", "all", "tanh", "directions")
# Share of covariances that is given up, so that statistics in step do not make an estimate singular.
LOOSE = 0.01
LEAST_GROUP = 50
# Distance bins: so many to a doubling of the squared distance.
BINS = 16
# A squared distance beyond this quantile of the chi-squared law is an outlier.
QUANTILE_NORMAL = 5.2  # standard normal quantile of 1 - 1e-7
# Least standard deviation of each statistic.
FLOOR = {"word_length": 0.12, "symbols": 0.045, "capitals": 0.08, "variety": 0.08, "length": 0.5, "dup_lines": 0.15, "repeats": 0.12}
NAMES = tuple(FLOOR)

_SPACE = b" \t\n\x0b\x0c\r"
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_lines long, n_repeat_words long, n_distinct long, n_capitals long, n_letters long"


def repeated_words(numbers: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in a window of so many words that the text has at least twice. `numbers` names words."""
    if len(numbers) <= window:
        return 0
    runs, width = numbers.astype(np.int64), 1
    # Number the runs of 1, 2, 4, ... words, then of `window`: a pair of two shorter runs is an exact name.
    while width < window:
        wider = min(2 * width, window)
        apart = wider - width
        pair = runs[: len(numbers) - wider + 1] * np.int64(len(numbers) + 1) + runs[apart : apart + len(numbers) - wider + 1]
        runs, width = np.unique(pair, return_inverse=True)[1], wider
    twice = np.bincount(runs)[runs] > 1
    edges = np.zeros(len(numbers) + 1, np.int64)
    edges[: len(twice)] += twice
    edges[window : window + len(twice)] -= twice
    return int((np.cumsum(edges)[:-1] > 0).sum())


def text_stats(raw: bytes) -> tuple[int, ...]:
    words = raw.split()  # bytes split at ASCII white space only
    ids: dict[bytes, int] = {}
    numbers = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    solid = raw.translate(None, _SPACE)
    continued = len(solid) - len(solid.translate(None, bytes(range(0x80, 0xC0))))
    lines = [line for line in raw.split(b"\n") if line.split(None, 1)]
    capitals = len(solid) - len(solid.translate(None, bytes(range(65, 91))))
    letters = capitals + len(solid) - len(solid.translate(None, bytes(range(97, 123)))) + len(solid) - len(solid.translate(None, bytes(range(0xC0, 256))))
    symbols = len(solid) - len(solid.translate(None, SYMBOLS))
    return len(words), len(solid) - continued, symbols, len(lines) - len(set(lines)), len(lines), repeated_words(numbers), len(ids), capitals, letters


def stats(text: Column) -> Column:
    """Struct STATS of a text."""

    @F.pandas_udf(STATS)
    def counted(raws: pd.Series) -> pd.DataFrame:
        worker_cache("statistics")  # empty: gives back what another operator has left in the worker
        return pd.DataFrame([text_stats(r) for r in raws], columns=[c.split()[0] for c in STATS.split(", ")])

    # A filter on the statistics would be moved below them with the function in it, and texts counted twice, in twice the workers.
    return counted.asNondeterministic()(F.coalesce(text, F.lit("")).cast("binary"))


def base_failed(s: Column) -> Column:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])


def vector(s: Column) -> Column:
    """Array of the transformed statistics, in the order of NAMES; null for a text without words."""
    share = lambda a, b: F.sqrt(s[a] / F.greatest(s[b], F.lit(1)))
    return F.when(
        s["n_words"] > 0,
        F.array(
            F.log(s["word_chars"] / s["n_words"]), share("n_symbols", "word_chars"), share("n_capitals", "n_letters"),
            F.log(s["n_distinct"] / s["n_words"]), F.log(s["n_words"].cast("double")), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"),
        ),
    )


def _chi2(p: float, z: float) -> float:
    """Chi-squared quantile for `p` degrees of freedom at the normal quantile `z` (Wilson and Hilferty)."""
    return p * (1 - 2 / (9 * p) + z * np.sqrt(2 / (9 * p))) ** 3


CUTOFF = float(_chi2(len(NAMES), QUANTILE_NORMAL))


def groups(measured: DataFrame) -> DataFrame:
    """`lang, source, group` for each language and source of rows with a vector: its own group or one it shares."""
    counts = measured.where(F.col("x").isNotNull()).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    small = F.col("n") < LEAST_GROUP
    by_lang = counts.where(small).groupBy("lang").agg(F.sum("n").alias("n_lang"))
    left, right = counts.alias("a"), by_lang.withColumnRenamed("lang", "_l")
    joined = left.join(right, F.col("lang").eqNullSafe(F.col("_l")), "left")
    whole = F.to_json(F.struct(F.lit(3).alias("level")))
    lang = F.to_json(F.struct(F.lit(2).alias("level"), "lang"))
    own = F.to_json(F.struct(F.lit(1).alias("level"), "lang", "source"))
    return joined.select("lang", "source", F.when(~small, own).when(F.col("n_lang") >= LEAST_GROUP, lang).otherwise(whole).alias("group"))


def _with_group(rows: DataFrame, named: DataFrame) -> DataFrame:
    other = named.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), "group")
    return rows.join(other, F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s")), "left").drop("_l", "_s")


def _distance(x: Column, mean: Column, precision: Column) -> Column:
    """Squared Mahalanobis distance from column arrays (`precision` row by row)."""
    p = len(NAMES)
    off = [x[i] - mean[i] for i in range(p)]
    total = F.lit(0.0)
    for i in range(p):
        for j in range(i, p):
            total = total + off[i] * off[j] * precision[i * p + j] * (1 if i == j else 2)
    return F.when(total < 0, F.lit(0.0)).otherwise(total)


MODEL = "group string, start int, n long, mean array<double>, precision array<double>, log_det double"


def floored(cov: np.ndarray) -> np.ndarray:
    """The covariance with every deviation at least FLOOR and slightly loosened covariances.

    Variance that is missing is added on the diagonal alone: a statistic that hardly varies is not made to go with another.
    """
    out = cov * (1 - LOOSE)
    np.fill_diagonal(out, np.maximum(np.diag(cov), np.square(list(FLOOR.values()))))
    return out


def _model(group: str, start: int, n: int, mean: np.ndarray, cov: np.ndarray) -> tuple:
    cov = floored(cov)
    return group, start, n, mean.tolist(), np.linalg.inv(cov).ravel().tolist(), float(np.linalg.slogdet(cov)[1])


def _models(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in MODEL.split(", ")])


def concentrated(distance_bins: pd.DataFrame, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of the nearest share COVERED of rows that are added up by `bin`: `k` rows, sums `s{i}`, products `s{i}_{j}`."""
    part = distance_bins.sort_values("bin")
    n = part["k"].to_numpy(float)
    wanted = max(1.0, COVERED * n.sum())
    # Whole bins from the nearest on; of the last one, the share that is still wanted.
    taken = np.clip((wanted - (np.cumsum(n) - n)) / n, 0, 1)
    k = (taken * n).sum()
    mean = np.array([(taken * part[f"s{i}"]).sum() for i in range(p)]) / k
    cov = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            cov[i, j] = cov[j, i] = (taken * part[f"s{i}_{j}"]).sum() / k - mean[i] * mean[j]
    # Rounding and shares of bins can leave a slightly negative variance.
    values, vectors = np.linalg.eigh(cov)
    return mean, (vectors * np.maximum(values, 0)) @ vectors.T


def _consistent(p: int) -> float:
    """What the covariance of the nearest share COVERED of normal data is too small by."""
    z = 0.6744897501960817  # normal quantile of COVERED = 0.75
    edge = _chi2(p, z)
    # Share of chi-squared with p + 2 degrees of freedom below `edge`.
    t = (edge / (p + 2)) ** (1 / 3)
    u = (t - (1 - 2 / (9 * (p + 2)))) / np.sqrt(2 / (9 * (p + 2)))
    return COVERED / (0.5 * (1 + math.erf(u / math.sqrt(2))))


def _products(values: list[Column], name: str) -> list[Column]:
    return [F.sum(values[i] * values[j]).alias(f"{name}{i}_{j}") for i in range(len(values)) for j in range(i, len(values))]


def _in_one(sums: DataFrame, names: list[str]) -> DataFrame:
    """The columns `names` as one array `sums`, for a Python worker: every column on its way there takes buffers for some
    thousands of rows, which Spark gives back late, and a group has a few hundred rows at most."""
    return sums.select(*(c for c in sums.columns if c not in names), F.array(*names).alias("sums"))


def _apart(part: pd.DataFrame, names: list[str]) -> pd.DataFrame:
    """The reverse of `_in_one`, in a worker."""
    return part.drop(columns="sums").join(pd.DataFrame(np.stack(part["sums"].to_numpy()), columns=names, index=part.index))


def starts(rows: DataFrame) -> DataFrame:
    """The estimates that concentration starts from, one of each of STARTS per group: the medians, and deviations from the quartile ranges."""
    p = len(NAMES)
    quartiles = [F.percentile_approx(F.col("x")[i], [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i in range(p)]
    known = stage(rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"), *quartiles).where(F.col("n") >= LEAST_GROUP))
    wide = lambda i: F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(FLOOR[NAMES[i]]))
    scaled = rows.join(known, "group").select("group", "n", *(f"q{i}" for i in range(p)), *(((F.col("x")[i] - F.col(f"q{i}")[1]) / wide(i)).alias(f"z{i}") for i in range(p)))
    z = [F.col(f"z{i}") for i in range(p)]
    length = F.greatest(F.sqrt(sum((v * v for v in z[1:]), z[0] * z[0])), F.lit(1e-9))
    kinds = _products(z, "a") + _products([F.tanh(v) for v in z], "b") + _products([v / length for v in z], "c")
    parts = [F.first(f"q{i}")[k].alias(f"q{i}_at{k}") for i in range(p) for k in range(3)]
    sums = scaled.groupBy("group").agg(F.first("n").alias("n"), *parts, *kinds)
    names = sums.columns[2:]

    def first(part: pd.DataFrame) -> pd.DataFrame:
        row, made = _apart(part, names).iloc[0], []
        q = np.array([[row[f"q{i}_at{k}"] for k in range(3)] for i in range(p)], float)
        sd = np.maximum((q[:, 2] - q[:, 0]) / 1.349, list(FLOOR.values()))
        for number, kind in enumerate(" abc"):
            correlation = np.eye(p)
            if kind != " ":
                cov = np.array([[row[f"{kind}{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)], float)
                size = np.sqrt(np.maximum(np.diag(cov), 1e-300))
                correlation = cov / np.outer(size, size)
                np.fill_diagonal(correlation, 1.0)
            made.append(_model(row["group"], number, int(row["n"]), q[:, 1], correlation * np.outer(sd, sd)))
        return _models(made)

    return _in_one(sums, names).groupBy("group").applyInPandas(first, MODEL)


def concentrate(rows: DataFrame, model: DataFrame) -> DataFrame:
    """One concentration step of every estimate."""
    p = len(NAMES)
    factor = _consistent(p)

    def one(part: pd.DataFrame) -> pd.DataFrame:
        mean, cov = concentrated(_apart(part, names), p)
        return _models([_model(part["group"].iloc[0], int(part["start"].iloc[0]), int(part["k"].sum()), mean, cov * factor)])

    x = [F.col("x")[i] for i in range(p)]
    sums = [F.sum(v).alias(f"s{i}") for i, v in enumerate(x)] + _products(x, "s")
    # Estimates are few: some per language and source.
    far = rows.join(model.drop("n", "log_det"), "group").withColumn("bin", F.floor(F.log2(_distance(F.col("x"), F.col("mean"), F.col("precision")) + 1e-6) * BINS))
    added = far.groupBy("group", "start", "bin").agg(F.count(F.lit(1)).alias("k"), *sums)
    names = added.columns[4:]
    return _in_one(added, names).groupBy("group", "start").applyInPandas(one, MODEL)


def fit(measured: DataFrame) -> DataFrame:
    """One estimate per group (MODEL) from stored rows `group, x`: of those found from all starts the one with the least
    determinant; groups that are too small are left out."""
    rows = measured.where(F.col("x").isNotNull() & F.col("group").isNotNull())
    model = stage(starts(rows))
    for _ in range(FIRST_STEPS):
        model = stage(concentrate(rows, model))
    best = F.min_by(F.struct(*model.columns), F.struct("log_det", "start"))
    model = stage(model.groupBy("group").agg(best.alias("_best")).select("_best.*"))
    for _ in range(STEPS - FIRST_STEPS):
        # A step made of whole bins can also end slightly higher: then the estimate before it stays.
        stepped = concentrate(rows, model).select("group", F.struct("start", "n", "mean", "precision", "log_det").alias("_new"))
        joined = model.join(stepped, "group").withColumn("_falls", F.col("_new.log_det") < F.col("log_det") - SETTLED)
        columns = (F.when(F.col("_falls"), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in model.columns[1:])
        after = stage(joined.select("group", *columns, "_falls"))
        model = after.drop("_falls")
        if after.where("_falls").isEmpty():
            break
    return model


def judge(measured: DataFrame, model: DataFrame) -> DataFrame:
    """Add `distance` (null without an estimate) and `kept` to rows with `group, x, base_failed`."""
    known = model.select(F.col("group").alias("_g"), "mean", "precision")
    far = measured.join(known, F.col("group") == F.col("_g"), "left").withColumn(
        "distance", F.when(F.col("x").isNotNull(), _distance(F.col("x"), F.col("mean"), F.col("precision")))
    )
    return far.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUTOFF, F.lit(True))).drop("_g", "mean", "precision")


def measure(docs: DataFrame, *columns) -> DataFrame:
    """`columns`, `lang, source`, the statistics as `s`, the vector `x` and `base_failed` of `docs` (`text, lang, source`)."""
    s = F.col("s")
    return docs.select(*columns, "lang", "source", stats(F.col("text")).alias("s")).withColumn("x", vector(s)).withColumn("base_failed", base_failed(s))


def estimates(measured: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups and their estimates from stored rows of `measure`; texts that fail the base rules are not estimated from."""
    sound = measured.where(~F.col("base_failed"))
    named = stage(groups(sound))
    return named, fit(stage(_with_group(sound.select("lang", "source", "x"), named).select("group", "x")))


def assess(docs: DataFrame, *columns) -> DataFrame:
    """Statistics, distance and verdict of every row."""
    measured = stage(measure(docs, *columns))
    named, model = estimates(measured)
    return judge(_with_group(measured, named), model)


def keep(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that are not rejected. Texts are measured twice rather than written beside their statistics."""
    named, model = estimates(stage(measure(docs)))
    judged = judge(_with_group(measure(docs, F.struct(*docs.columns).alias("_row")), named), model)
    return judged.where("kept").select("_row.*")

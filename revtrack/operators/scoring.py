"""Borderline posts go to a scorer the caller supplies (X1); the cheap rules run first."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import snippet as snippet_of
from ..functions.question import answer_is_yes, answer_reason, question
from ..functions.rules import classify_title
from ..session import stage

# A scorer takes a series of question texts and returns one answer text per question.
Scorer = Callable[[pd.Series], pd.Series]


def ask(questions: Column, scorer: Scorer) -> Column:
    """`answer` and `error` of each question, null for a null question; only the questions go to Python, one Arrow batch at a time.

    When a batch call raises, its questions are asked one by one, so only the failing ones are lost.
    """

    def one(text: str) -> tuple[str | None, str | None]:
        try:
            return scorer(pd.Series([text])).iloc[0], None
        except Exception as exc:  # noqa: BLE001 - any failure of the caller's code rejects the post
            return None, str(exc)

    def batches(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            put = part.dropna()
            try:
                answers = pd.Series(scorer(put.reset_index(drop=True))).to_list() if len(put) else []
                told = [(a, None) for a in answers]
            except Exception:  # noqa: BLE001
                told = [one(q) for q in put]
            rows = pd.DataFrame(told, index=put.index, columns=["answer", "error"], dtype=object)
            yield rows.reindex(part.index).astype(object).where(lambda x: x.notna(), None)

    batches.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    # A scorer may answer otherwise when asked again, and asking is dear: once, and nowhere else than here.
    return F.pandas_udf(batches, "answer string, error string").asNondeterministic()(questions)


def score_borderline(df: DataFrame, scorer: Scorer, snippet: str | None = None) -> DataFrame:
    """Verdict columns `is_guideline, confidence, reason` for posts with `title, label, agency_name`."""
    text = F.coalesce(F.col(snippet), F.lit("")) if snippet else F.lit("")
    asked = df.withColumn("_told", ask(question(F.col("title"), F.col("label"), F.col("agency_name"), text), scorer))
    failed = F.col("_told.error").isNotNull()
    return asked.select(
        *df.columns,
        F.when(failed, F.lit(False)).otherwise(answer_is_yes(F.col("_told.answer"))).alias("is_guideline"),
        F.when(failed, "llm_error").otherwise("llm").alias("confidence"),
        F.when(failed, F.col("_told.error")).otherwise(answer_reason(F.col("_told.answer"), text)).alias("reason"),
    )


def with_snippets(posts: DataFrame, bodies: DataFrame) -> DataFrame:
    """Add `_snippet`, the beginning of the page behind a post's url, null where no page is known.

    `bodies`: url, body (html) and, where there is one, fetched_at; of several pages of a url the last fetched counts, else the
    one with the least snippet. Only pages that a post asks for are read further than their url.
    """
    asked = bodies.where(F.col("url") != "").join(posts.select("url").distinct(), "url", "left_semi")
    texts = asked.withColumn("_snippet", snippet_of(F.coalesce("body", F.lit(""))))
    latest = F.max_by("_snippet", F.struct("fetched_at", "_snippet")) if "fetched_at" in bodies.columns else F.min("_snippet")
    return posts.join(texts.groupBy("url").agg(latest.alias("_snippet")), "url", "left")


def accept_items(items: DataFrame, scorer: Scorer | None = None, snippet: str | None = None, bodies: DataFrame | None = None) -> DataFrame:
    """Add `accepted` and `scored`: announcement sources pass, titles decide, the scorer takes the rest.

    Without a scorer a borderline title is rejected. The scorer sees the column `snippet`, or with `bodies` (see
    `with_snippets`) the beginning of the post's own page.
    """
    verdict = F.when(F.col("item_type") == "announcement", F.lit(True)).otherwise(classify_title(F.col("title")))
    judged = items.withColumn("accepted", verdict)
    if scorer is None:
        return judged.withColumn("accepted", F.coalesce("accepted", F.lit(False))).withColumn("scored", F.lit(False))
    judged = stage(judged)  # read twice
    sure = judged.where(F.col("accepted").isNotNull()).withColumn("scored", F.lit(False))
    open_ = judged.where(F.col("accepted").isNull()).drop("accepted")
    if bodies is not None:
        open_, snippet = with_snippets(open_, bodies), "_snippet"
    scored = score_borderline(open_, scorer, snippet).withColumn("accepted", F.col("is_guideline")).withColumn("scored", F.lit(True))
    return sure.unionByName(scored.select(*sure.columns))

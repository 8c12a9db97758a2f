"""Text of the borderline question and reading of its answer."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fv
from .html import mentioned_extensions
from .text import let, strip


def body_section(snippet: Column) -> Column:
    def parts(text: Column) -> Column:
        extensions = F.nullif(F.array_join(mentioned_extensions(text), ", "), F.lit(""))
        return F.concat_ws(
            "\n",
            F.when(text != "", F.concat(F.lit(fv.BODY_PART), text)),
            F.concat(F.lit(fv.ATTACHMENT_PART), extensions),
        )

    return F.coalesce(F.nullif(let(snippet, parts), F.lit("")), F.lit(fv.NO_BODY_PART))


def question(title: Column, board_label: Column, agency_name: Column, snippet: Column) -> Column:
    """The question put to the scorer about one post."""
    snippet = F.coalesce(snippet, F.lit(""))
    values = {
        "{title}": title, "{board_label}": board_label, "{agency_name}": agency_name,
        "{body_section}": body_section(snippet),
    }
    pieces = re.split(r"(\{\w+\})", fv.BORDERLINE_QUESTION)
    return F.concat(*[F.coalesce(values[p], F.lit("")) if p in values else F.lit(p) for p in pieces if p])


def answer_is_yes(answer: Column) -> Column:
    return F.coalesce(F.startswith(F.upper(strip(answer)), F.lit("YES")), F.lit(False))


def answer_reason(answer: Column, snippet: Column) -> Column:
    said = F.concat(F.lit(fv.REASON_ANSWER), F.upper(strip(answer)))

    def reason(text: Column) -> Column:
        extensions = F.nullif(F.array_join(mentioned_extensions(text), ","), F.lit(""))
        return F.concat_ws(
            " | ",
            said,
            F.concat(F.lit(fv.REASON_ATTACHMENTS), extensions),
            F.when(text == "", F.lit(fv.REASON_NO_BODY)),
        )

    return let(F.coalesce(snippet, F.lit("")), reason)

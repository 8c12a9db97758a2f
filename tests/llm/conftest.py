"""Documents with everything that may go wrong, and tables made from rows."""

import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators use for columns of their own.
CLASHING = ("size", "n", "kept", "group", "set", "label", "shard", "slot", "token", "taken", "class", "x", "fp", "score")


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    stems = ["ra", "to", "men", "li", "so", "dar", "ve", "ku", "pin", "ost"]
    return " ".join("".join(draw.choice(stems) for _ in range(draw.randint(1, 4))) for _ in range(n))


def odd_rows() -> list[tuple]:
    base = prose(1, 120)
    return [
        (1, None, "en", "a", None),
        (2, "", "en", "a", 0),
        (3, " \t\n ", None, "b", 4),
        (4, base, "en", "a", len(base)),
        (5, base, "en", None, len(base)),
        (5, base, "en", None, len(base)),  # a repeated row
        (None, prose(2, 40), "en", "b", 1),
        (7, prose(3, 30_000), "de", "b", 1),
        (8, base + " extra", "en", "c", 1),
        (9, "one two", "en", "c", 7),
        (10, "One\tTWO", "en", "c", 7),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd documents, with further columns whose names clash with those of operators."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(odd_rows(), COLUMNS).repartition(3)
    return docs.select("*", *(F.lit(f"{c}!").alias(c) for c in CLASHING))


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def table(spark):
    """Parquet-free table from rows of documents."""
    return lambda rows: spark.createDataFrame(rows, COLUMNS)

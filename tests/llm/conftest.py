"""Small tables with awkward rows, shared by the tests of the training-data operators."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_rows import documents


LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(40_000))


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in any column, empty, blank and very long texts, ties and repeated rows."""
    return documents(
        spark,
        [
            (1, "The cat sat on the mat and looked at the dog."),
            (2, "The cat  sat on\tthe mat and looked at the dog."),
            (2, "The cat  sat on\tthe mat and looked at the dog."),
            (None, "The cat sat on the mat and looked at the dog."),
            (4, None),
            (5, ""),
            (6, "  \n "),
            (7, "123 !!"),
            (8, LONG),
            (9, LONG + " end", None),
            (None, None, None),
            (10, "a"),
            (11, "a" * 200_000),
            (12, "card 4111 1111 1111 1111, mail ann@example.com, 10.0.0.1, +1 (743) 555-3824", "de"),
            (13, "😀 é́ Ünïcode 漢字 token='abcdefgh12345678'", "de"),
        ],
    )


@pytest.fixture(scope="session")
def nothing(spark):
    return documents(spark, [])


@pytest.fixture(scope="session")
def clashing(spark, awkward):
    """The awkward rows with extra columns named like the operators' own."""
    from pyspark.sql import functions as F

    names = "key row digest size hash label part lot sid n h band other_key other_digest fill start piece own".split()
    return awkward.select("*", *(F.lit(i).alias(n) for i, n in enumerate(names)))

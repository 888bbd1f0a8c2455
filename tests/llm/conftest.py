from __future__ import annotations

import pytest
from pyspark.sql import functions as F

WORDS = "the of and stone river light under morning table green window paper cloud yellow answer walking seven".split()


def prose(n: int, seed: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, a column that clashes."""
    base, other = prose(120, 1), prose(90, 2)
    near = base.split()
    near[60] = "changed"
    lines = "\n".join(prose(6, 100 + i) for i in range(8))
    rows = [
        (1, base, "en", "a", 7),
        (2, " ".join(near), "en", "a", 7),
        (3, base, "en", "b", None),
        (3, base, "en", "b", None),
        (4, None, None, None, None),
        (5, "", "en", "a", 1),
        (6, "   ", "en", "a", 1),
        (None, other, "en", None, 2),
        (8, "one two", "en", "a", 3),
        (9, lines, "en", "c", 3),
        (10, prose(5, 9) + "\n" + lines + "\nend", "en", "c", 3),
        (11, prose(30_000, 11), "en", "c", 3),
        (12, "a" * 5000, "xx", "c", 3),
        (13, prose(40, 13) + " " + other + " " + prose(30, 14), "en", "c", 3),
        (14, "\n\n\n\n", "en", "c", 3),
        (15, "é ñ 日本語 \u0000 \U0001f600 " * 30, "en", "c", 3),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, text_mark long")


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.filter(F.lit(False))

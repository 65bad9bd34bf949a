import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# columns that the operators would like to add, under other cases
EXTRA = ["score", "Lang_Pred", "shard", "SLOT", "n_lines", "copies", "matches", "spans", "licences", "key", "first"]


def long_text(n=60_000):
    return " ".join(f"wort{i * i % 977} und" for i in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows, and columns with clashing names."""
    rows = [(1, "The house and the garden of the old man.", "en", "src0", 40), (2, None, "en", "src0", None),
            (3, "", None, "src1", 0), (4, " \t\n ", "de", None, 4), (None, "Das Haus und der Garten.", "de", "src1", 24),
            (5, long_text(), "de", "src2", None), (6, "The house and the garden of the old man.", "en", "src0", 40),
            (1, "The house and the garden of the old man.", "en", "src0", 40), (7, "123 456 !!", "xx", "other", 10),
            (8, "𝒳 ñandú été", "es", "src3", None)]
    df = spark.createDataFrame(rows, DOCS)
    for name in EXTRA:
        df = df.selectExpr("*", f"cast(doc_id as string) as {name}")
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)

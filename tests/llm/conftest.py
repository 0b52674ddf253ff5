import pytest
from pyspark.sql import functions as F

#: Columns that the operators might use for themselves.
CLASHING = ("id", "words", "node", "label", "found", "doc", "content", "kept", "score", "row1", "bands", "key", "length", "part", "n")

LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(30_000))


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


@pytest.fixture(scope="session")
def awkward(spark):
    """Null ids, null, empty and very long texts, repeated rows, ties and columns with clashing names."""
    words = "The quick brown fox jumps over the lazy dog and runs away from it"
    rows = [
        (1, words),
        (1, words),
        (2, words),
        (2, "Something else entirely, written by another hand on another day"),
        (3, None),
        (4, ""),
        (4, ""),
        (5, "...\n\n  \t\n!!!"),
        (None, words + " again"),
        (None, None),
        (6, LONG),
        (7, "a\u00e9\U0001f642 \u6f22\u5b57 <|endoftext|> it's\r\n\u00a0x" + "\u0301"),
    ]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    return frame.withColumns({name: F.lit("taken") for name in CLASHING})


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.where("false")

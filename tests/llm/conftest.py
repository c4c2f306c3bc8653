from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: Null columns, empty and long texts, ties, repeated rows, white space only.
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "", 0),
    (3, " \t\n\x0b", None, "b", 4),
    (4, "one two three", "en", "a", 13),
    (4, "one two three", "en", "a", 13),
    (4, "another text under one id, long enough to hold a shared passage of fifty bytes and more", "en", "a", 87),
    (5, "long enough to hold a shared passage of fifty bytes and more, in another document here", "en", "b", 87),
    (None, "long enough to hold a shared passage of fifty bytes and more, but without an id at all", None, "b", 87),
    (6, "password = hunter2hunter2\nthe very same line of text\nthe very same line of text", "de", "c", 80),
    (7, "The Very Same Line of Text \nétude <|endoftext|> 123", "de", "c", 50),
    (8, "\tthe very same line of text\r\n" + "ab" * 40_000, "de", "c", 80_029),
    (9, "x " * 30_000, "fr", "c", 60_000),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd documents with further columns whose names clash with those the operators use."""
    rows = spark.createDataFrame(ODD, SCHEMA)
    return rows.selectExpr("*", "doc_id AS doc", "'x' AS check", "1 AS size", "2 AS label", "'k' AS kept", "3 AS ids")


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("false")

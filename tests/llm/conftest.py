from __future__ import annotations

import duckdb
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents():
    """(doc_id, text) of the smallest documents table."""
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id")
    return rows.fetchall()


@pytest.fixture(scope="session")
def ugly(spark):
    """Documents with nulls everywhere, empty and long texts, ties, repeats, odd columns."""
    long = " ".join(f"word{i % 977}x{i}" for i in range(60_000))
    rows = [
        (1, None, None, None, 0),
        (2, "", "en", None, 1),
        (3, " \n\t ", None, "s", 2),
        (4, "one", "en", "s", 3),
        (5, "one two three", "en", "s", 4),
        (6, "One TWO three", "en", "s", 5),
        (7, long, "en", "s", 6),
        (8, long + " tail", "en", "s", 7),
        (None, "a text without an id, long enough to have more than ten words in it", "en", "s", 8),
        (None, None, None, None, 9),
        (9, "the same row is here twice and it has quite a few words in it", "en", "s", 10),
        (9, "the same row is here twice and it has quite a few words in it", "en", "s", 10),
        (10, "ÀÉ ß ﬁ Σας  x y <|endoftext|> </w> \U0001f44d\U0001f3fd\x00\x1c", "fr", "s", 11),
        (11, "x" * 50_000, "de", "s", 12),
    ]
    names = ["doc_id", "text", "lang", "source", "n_words", "_row", "score", "_bytes"]
    return spark.createDataFrame(
        [(*row, "a", 0.5, b"z") for row in rows],
        "doc_id bigint, text string, lang string, source string, n_words int, _row string, "
        "score double, _bytes binary",
    ).toDF(*names)


@pytest.fixture(scope="session")
def empty(ugly):
    return ugly.limit(0)

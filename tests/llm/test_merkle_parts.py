"""The order of documents is the same for any number of parts, more than rows and far more than tasks included."""

import pytest

from bazaarlens.llm import merkle

ROWS = [(i * 7 % 61, f"text {i} " * (i % 5 + 1)) for i in range(61)] + [(7, "again"), (7, None), (None, "no id"), (None, None), (3, "")]


def result(spark, rows, parts):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, part string")
    return sorted(map(str, merkle.fingerprints(docs, parts).collect()))


@pytest.mark.parametrize("parts", [5, 300, 5000])
def test_parts(spark, parts):
    assert result(spark, ROWS, parts) == result(spark, ROWS, 1)


def test_few_rows(spark):
    for rows in ([], ROWS[:1], [(None, None)], [(1, "a"), (1, "a")], [(-5, "a"), (2 ** 62, "b")]):
        assert result(spark, rows, 5000) == result(spark, rows, 1) and len(result(spark, rows, 5000)) == len(rows)

"""Benchmark items without an id: their passages count like any other, as the query's SQL says."""

import duckdb
import pytest

import oracle_check
from bazaarlens.llm import decontaminate, queries

BENCH = [(1, "the cat sat on the mat"), (None, "a b c d e f g h i j k l m n"), (None, "seven of nine"), (2, None), (None, None)]
DOCS = [(1, "so the cat sat on the mat today"), (2, "x a b c d e f g h i j k l m n y"), (3, "seven of nine"),
        (4, "clean words only"), (5, "seven of nine, the cat sat on the mat"), (6, None)]


@pytest.mark.parametrize("block", [100, 2])
def test_against_the_sql(spark, block):
    con = duckdb.connect()
    for name, rows, key in (("benchmark", BENCH, "item_id"), ("documents", DOCS, "doc_id")):
        con.execute(f"CREATE TABLE {name} ({key} BIGINT, text VARCHAR)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    got = decontaminate.contamination(docs, bench, block=block)
    want = con.execute(queries.OP2)
    names = [c[0] for c in want.description]
    assert oracle_check.rows_of(got.columns, [tuple(r) for r in got.collect()]) == oracle_check.rows_of(names, want.fetchall())
    clean = decontaminate.drop_contaminated(docs, bench, block=block)
    assert {r["doc_id"] for r in clean.collect()} == {4, 6}

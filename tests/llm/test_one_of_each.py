"""Near duplicates are decided row by row: repeated ids with different texts, and rows without an id."""

from bazaarlens.llm import jaccard

BASE = [f"w{k}" for k in range(60)]


def near(k):
    return " ".join(BASE[:k] + ["other"] + BASE[k + 1:])


def test_repeated_and_missing_ids(spark):
    rows = [(1, near(0)), (2, near(59)), (2, "a text of its own that nothing else resembles"), (3, "p q r s t u v w"),
            (3, "p q r s t u v w"), (4, " ".join(f"v{k}" for k in range(60))),
            (4, " ".join(["new"] + [f"v{k}" for k in range(1, 60)])), (None, near(1)), (None, "lone row without an id"),
            (None, "lone row without an id"), (5, ""), (5, ""), (6, None), (None, ""), (None, "")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, once string")
    out = jaccard.keep_one_of_each(docs, size=5, percent=80)
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert out.columns == docs.columns
    four = [t for i, t in got if i == 4]
    assert len(four) == 1 and (4, four[0]) in rows
    assert sorted((x for x in got if x[0] != 4), key=str) == sorted(
        [rows[0], rows[2], rows[3], (None, "lone row without an id"), (5, ""), (6, None), (None, ""), (None, "")], key=str)

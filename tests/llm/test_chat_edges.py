"""Reply trees with repeated rows, and conversations at their edges."""

import hashlib

from bazaarlens.llm import chat

TREE = "conv string, node long, parent long, score double, role string, text string, leaf string, place string"


def test_repeated_rows_are_one_message(spark):
    rows = [("c", 1, None, 0.5, "user", "q", "x", "x"), ("c", 2, 1, 0.5, "assistant", "a", "x", "x")] * 2
    rows += [("c", 2, 1, 0.5, "assistant", "b", "y", "y"), (None, 1, None, 1.0, "user", "n", "", ""), ("c", None, 1, 1.0, "user", "n", "", ""),
             ("o", 1, 2, 1.0, "user", "circle", "", ""), ("o", 2, 1, 1.0, "user", "circle", "", "")]
    got = chat.format_trees(spark.createDataFrame(rows, TREE)).collect()
    assert [(r["conv"], r["leaf"]) for r in got] == [("c", 2)]
    turns = spark.createDataFrame(got).select(chat.read_turns("formatted").alias("t")).first()["t"]
    assert [(t["role"], t["text"]) for t in turns] == [("user", "q"), ("assistant", "a")]
    assert chat.format_trees(spark.createDataFrame([], TREE)).count() == 0


def test_conversations_at_their_edges(spark):
    schema = "conv_id long, turn long, role string, text string, place string, node string"
    rows = [(1, 0, "user", "u", "", ""), (1, 0, "user", "u", "", ""), (1, 1, None, None, "", ""), (None, 0, "assistant", "a", "", ""),
            (None, 5, "assistant", "b", "", "")] + [(2, k, "user", "x", "", "") for k in range(700)] + [(3, 0, "assistant", "é" * 300_000, "", "")]
    got = {r["conv_id"]: r for r in chat.conversation_digests(spark.createDataFrame(rows, schema)).collect()}
    told = lambda turns: hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert {i: r["n_turns"] for i, r in got.items()} == {1: 3, None: 2, 2: 700, 3: 1}
    assert got[1]["turns_sha256"] == told([("user", "u"), ("user", "u"), ("", "")])
    assert got[2]["turns_sha256"] == told([("user", "x")] * 700)
    assert got[None]["loss_chars"] == 2 and got[3]["loss_chars"] == 300_000
    assert chat.conversation_digests(spark.createDataFrame([], schema)).count() == 0

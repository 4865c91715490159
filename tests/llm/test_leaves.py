"""Leaves of fingerprints: bounded, and found again in repetitive, short and space-free texts."""

import pyarrow as pa
import pytest

from bazaarlens.llm import merkle

OTHER = "zq! 日 unlike other text " * 2000
TEXTS = ["word " * 30_000, "x" * 5000, "ab" * 4000, "one", "a b", "日本語の文章" * 300, "абв", "no-space-" * 200,
         "the cat sat on the mat", "the same line here\n" * 200]


def trees(texts):
    return list(merkle.trees(pa.array(texts, pa.large_string())))


@pytest.mark.parametrize("text", TEXTS, ids=lambda t: t[:8].strip())
def test_an_edited_third_leaves_the_rest(text):
    kept = text[: len(text) - len(text) // 3]
    a, b = trees([text, kept + OTHER[: len(text) // 3]])
    assert max(a.leaf_size + b.leaf_size) <= merkle.LEAF_MOST + 3
    assert sum(a.leaf_size) == len(text.encode()) and merkle.likeness(a, b) > 0.5
    start, end = merkle.edit_span(a, b)
    size = len(kept.encode())
    assert size - merkle.LEAF_MOST - 3 <= start <= size + merkle.LEAF_MOST and end == len(text.encode())


def test_an_insertion_into_a_repetitive_text_is_found():
    a, b = trees(["word " * 4000, "word " * 2000 + "INSERT" + "word " * 2000])
    assert merkle.likeness(a, b) > 0.98
    start, end = merkle.edit_span(b, a)
    assert start <= 10_000 and 10_006 <= end <= start + 4 * merkle.LEAF_MOST


def test_neighbours_and_slices_do_not_move_a_cut():
    together = trees(["pre fix", *TEXTS, None, ""])
    for text, tree in zip(TEXTS, together[1:]):
        assert tree == trees([text])[0]
    assert together[-1].leaves == [] and together[-2].root == together[-1].root


def test_near_edited_of_every_document(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(10_000 + k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")
    rows = merkle.fingerprints(docs.union(more), parts=5).collect()
    assert len(rows) > len(TEXTS) and min(r["near_edited"] for r in rows) >= 0.4

"""Exact length histogram of encoded documents, and what it answers: totals, quantiles and truncated totals for every
context limit, from suffix sums over the lengths that occur."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bazaarlens.llm.tables import ship
from bazaarlens.llm.words import slices
from bazaarlens.session import cut_lineage

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK = 1024


def token_counts(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """(doc_id, n_tokens) for every row; a null text has 0 tokens. `ranks`: a vocabulary file, read by the driver."""
    with open(ranks, "rb") as f:
        held = ship(docs.sparkSession, f.read())  # a vocabulary: a few hundred kB
    name = os.path.basename(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken
        table = {base64.b64decode(a): int(b) for a, b in (x.split() for x in held().splitlines() if x)}
        coder = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        for b in batches:
            for at, texts in slices(b.column(1)):
                n = [len(coder.encode_ordinary(t)) if t else 0 for t in texts.to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(n)), pa.array(n, pa.int64())],
                                                 ["doc_id", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long")


def length_histogram(counts: DataFrame) -> DataFrame:
    """A row per length that occurs: n_tokens, n_docs, and for that length as a context limit docs_at_least,
    tokens_at_least (of documents that long or longer), docs_below, truncated_total (tokens left if every document is
    cut there) and total_tokens.

    Sums run within blocks of lengths and over block totals, so no task sees more than the lengths of one block or one
    row per block. An empty table has no rows."""
    hist = cut_lineage(counts.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs")))  # texts are encoded once
    hist = hist.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn(
        "tokens", F.col("n_tokens") * F.col("n_docs"))
    after = W.orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("docs_after"),
                           F.coalesce(F.sum("t").over(after), F.lit(0)).alias("tokens_after"))
    here = W.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(W.unboundedPreceding, 0)
    whole = hist.agg(F.sum("n_docs").alias("all_docs"), F.sum("tokens").alias("total_tokens"))  # one row
    rows = hist.withColumns({"docs_here": F.sum("n_docs").over(here), "tokens_here": F.sum("tokens").over(here)})
    rows = rows.join(blocks, "block").withColumns({
        "docs_at_least": F.col("docs_here") + F.col("docs_after"),
        "tokens_at_least": F.col("tokens_here") + F.col("tokens_after")}).join(F.broadcast(whole))
    return rows.select(
        "n_tokens", "n_docs", "docs_at_least", "tokens_at_least",
        (F.col("all_docs") - F.col("docs_at_least")).alias("docs_below"),
        (F.col("total_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias(
            "truncated_total"), "total_tokens")


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """(limit, docs_cut, kept_tokens) for any context limits, whether or not a document has that length."""
    wanted = histogram.sparkSession.createDataFrame([(int(x),) for x in limits], "limit long")
    over = F.when(F.col("n_tokens") > F.col("limit"), F.col("n_docs")).otherwise(0)
    kept = F.least("n_tokens", "limit") * F.col("n_docs")
    # the listed limits against the histogram, one row per length
    return histogram.join(F.broadcast(wanted)).groupBy("limit").agg(
        F.sum(over).alias("docs_cut"), F.sum(kept).alias("kept_tokens"))


def length_quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the smallest length that at least this share of documents does not exceed."""
    wanted = histogram.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    upto, whole = F.col("docs_below") + F.col("n_docs"), F.col("docs_below") + F.col("docs_at_least")
    reach = histogram.join(F.broadcast(wanted)).where(upto >= F.col("share") * whole)
    return reach.groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))

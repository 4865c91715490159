"""From raw documents to token ids: language ID, near duplicates, benchmark decontamination, SentencePiece.

Each stage works on all that its predecessor kept, written as Parquet in between. `ORACLE_SQL` is None: neither the
language models nor the near-duplicate join can be said in SQL; the tests compare every stage with a brute-force
version."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import bazaarlens
from bazaarlens.llm import decontaminate, jaccard, langid, pieces
from bazaarlens.llm.tables import table
from bazaarlens.session import cut_lineage

# Workers get the package's functions with the tasks, so it need not be installed on them.
cloudpickle.register_pickle_by_value(bazaarlens)

ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a learned language. Those without a letter, and those far from every language, go."""
    return langid.drop_rejected(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: 5-word shingles, similarity 0.8 or more."""
    return jaccard.keep_one_of_each(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lie in windows of benchmark items."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, decoded_sha256, round_trip of what is left."""
    return pieces.encoded(docs)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("sentencepiece", sentencepiece)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs

"""Stupid-backoff scores of documents under the n-gram counts of all other documents.

The corpus is cut into blocks of whole documents. Each block sends its distinct n-grams with their counts to count
tables partitioned by n-gram hash; a table's partition adds up the counts of all blocks and answers each block in the
order it asked; the answers are joined to the block again, whose exploded n-grams are looked up and summed per document.
An n-gram travels once per block that holds it, however often it occurs, so a frequent one loads no partition. Rows
hold packed arrays of a block's n-grams in one partition instead of one n-gram each."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.llm.tables import small_batches
from bazaarlens.llm.words import ALNUM, Words, column, concat_ranges, words
from bazaarlens.session import fresh_path

ORDER = 3
ALPHA = 0.4
BLOCK_BYTES = 10 << 20  # text of a block
TABLE_ROWS = 600_000  # n-grams of a partition of a count table, about
_PACK = "block string, docs binary, bounds binary, text binary, n_words long"


def _blocks(docs: DataFrame, size: int) -> DataFrame:
    """Rows of about `size` bytes of whole documents: ids, bounds and the compressed text. They are kept as a table
    bucketed by block, so that they need not move again when the answers come back to them."""
    spark = docs.sparkSession

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0
        for b in batches:
            for i, t in zip(column(b, "doc_id"), column(b, "text")):
                raw = b"" if not t.is_valid else t.as_buffer().to_pybytes()
                if texts and held + len(raw) > size:
                    yield _row(ids, texts)
                    ids, texts, held = [], [], 0
                ids.append(i.as_py())
                texts.append(raw)
                held += len(raw)
        if texts:
            yield _row(ids, texts)

    def _row(ids: list, texts: list[bytes]) -> pa.RecordBatch:
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        none = np.array([i is None for i in ids])
        numbers = np.array([0 if i is None else i for i in ids], np.int64)
        raw = b"".join(texts)
        n = len(_unpack_words(raw, bounds).hashes)
        cols = [uuid.uuid4().hex, np.concatenate([numbers, none]).astype(np.int64).tobytes(), bounds.tobytes(),
                zstandard.ZstdCompressor(level=9).compress(raw), n]
        kinds = (pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cols, kinds)],
                                          ["block", "docs", "bounds", "text", "n_words"])

    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    name, buckets = f"blocks_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    (rows.mapInArrow(pack, _PACK).write.format("parquet").bucketBy(buckets, "block")
     .option("path", fresh_path(spark, "blocks")).saveAsTable(name))
    return spark.table(name)


def _unpack_words(raw: bytes, bounds: np.ndarray) -> Words:
    texts = pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(raw)])
    return words(texts, ALNUM)


def _read(b: pa.RecordBatch, i: int) -> Words:
    raw = zstandard.ZstdDecompressor().decompress(column(b, "text")[i].as_py())
    return _unpack_words(raw, np.frombuffer(column(b, "bounds")[i].as_py(), np.int64))


def _planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte, the lowest byte of all first: the high bytes of small numbers compress to nothing."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), 8).T).tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    flat = np.frombuffer(data, np.uint8)
    return np.ascontiguousarray(flat.reshape(8, len(flat) // 8).T).view(np.uint64).ravel()


def _sparse(counts: np.ndarray) -> bytes:
    """Counts, nearly all of which are 1, as places and values of the others."""
    more = np.flatnonzero(counts > 1)
    return _planes(np.concatenate([np.diff(more, prepend=0), counts[more]]).astype(np.uint64))


def _from_sparse(data: bytes, size: int) -> np.ndarray:
    flat = _from_planes(data)
    out = np.ones(size, np.uint64)
    out[np.cumsum(flat[: len(flat) // 2]).astype(np.int64)] = flat[len(flat) // 2:]
    return out


def _edges(parts: int) -> np.ndarray:
    return np.array([(k << 64) // parts for k in range(1, parts)], np.uint64)


def _requests(blocks: DataFrame, order: int, parts: int) -> DataFrame:
    """(part, n, block, keys, counts): the distinct n-grams of a block in one partition of the n-gram tables."""
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, block in enumerate(column(b, "block").to_pylist()):
                w = _read(b, i)
                for n in range(1, order + 1):
                    keys, counts = np.unique(w.grams(n)[0], return_counts=True)
                    at = [0, *np.searchsorted(keys, _edges(parts)).tolist(), len(keys)]
                    rows = [(p * order + n - 1, n, block, _planes(np.diff(keys[lo:hi], prepend=np.uint64(0))),
                             _sparse(counts[lo:hi]))
                            for p, (lo, hi) in enumerate(zip(at[:-1], at[1:])) if hi > lo]
                    kinds = (pa.int64(), pa.int32(), pa.string(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(list(zip(*rows)) or [[]] * 5,
                                                                                         kinds)],
                                                     ["part", "n", "block", "keys", "counts"])

    return blocks.select("block", "bounds", "text").mapInArrow(
        ask, "part long, n int, block string, keys binary, counts binary")


def _answers(requests: DataFrame) -> DataFrame:
    """(block, n, part, totals): per request the counts of its n-grams over all blocks, in the order asked."""
    def add(t: pa.Table) -> pa.Table:
        keys = [np.cumsum(_from_planes(x.as_py()), dtype=np.uint64) for x in t["keys"]]
        counts = [_from_sparse(x.as_py(), len(k)) for x, k in zip(t["counts"], keys)]
        flat = np.concatenate(keys)
        order = np.argsort(flat, kind="stable")
        ranked = flat[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        group = np.cumsum(new) - 1
        total = np.zeros(group[-1] + 1, np.uint64)
        np.add.at(total, group, np.concatenate(counts)[order])
        back = np.empty(len(flat), np.uint64)
        back[order] = total[group]
        at = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
        totals = [_planes(back[a:b]) for a, b in zip(at[:-1], at[1:])]
        return pa.table({"block": t["block"], "n": t["n"], "part": t["part"], "totals": pa.array(totals, pa.binary())})

    return requests.groupBy("part").applyInArrow(add, "block string, n int, part long, totals binary")


def _score(w: Words, totals: dict[int, np.ndarray], order: int, alpha: float, n_corpus: int) -> tuple:
    """Per document: summed natural logarithm of its words' scores, and how many words each length of n-gram scored."""
    n_doc = w.counts
    doc = np.repeat(np.arange(len(n_doc)), n_doc)
    others = {}  # per place that an n-gram starts at: its count in other documents
    for n in range(1, order + 1):
        grams, places = w.grams(n)
        keys, which = np.unique(grams, return_inverse=True)
        own, inverse, here = np.unique(doc[places] * np.int64(max(1, len(keys))) + which, return_inverse=True,
                                       return_counts=True)
        others[n] = np.zeros(len(w.hashes) + 1, np.int64)
        if len(places):
            others[n][places] = totals[n].astype(np.int64)[which] - here[inverse]
    logs = np.zeros(len(w.hashes))
    level = np.zeros(len(w.hashes), np.int64)
    open_ = np.ones(len(w.hashes), bool)
    inside = concat_ranges(np.zeros(len(n_doc), np.int64), n_doc)  # place in the document
    rest = np.maximum(n_corpus - n_doc, 1)[doc]
    back = np.zeros(len(w.hashes), np.int64)  # steps back so far
    for n in range(order, 0, -1):
        at = np.flatnonzero(open_ & (inside >= n - 1))
        hit = others[n][at - (n - 1)]
        below = others[n - 1][at - (n - 1)] if n > 1 else rest[at]
        ok = hit > 0
        at, hit, below = at[ok], hit[ok], below[ok]
        logs[at] = np.log(hit / below) + back[at] * np.log(alpha)
        level[at], open_[at] = n, False
        back[inside >= n - 1] += 1
    logs[open_] = back[open_] * np.log(alpha) - np.log(rest[open_])
    sums = np.concatenate([[0], np.cumsum(logs)])
    per_doc = [np.bincount(doc[level == n], minlength=len(n_doc)) for n in range(order + 1)]
    return np.add.reduceat(np.append(logs, 0.0), w.bounds[:-1]) * (n_doc > 0) if len(n_doc) else sums[:0], per_doc


def backoff_scores(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, log_score, mean_log_score, n_1 .. n_order, n_unseen for every row of docs (doc_id, text).

    A word scores the relative frequency of the longest n-gram that ends there and occurs in another document, times
    alpha for each step back from the longest that fits into the text; a word that no other document has scores
    alpha once more, over all other words. Counts are those of the whole corpus less the document's own. Words are
    those of `ALNUM`. A text that is null or has no words has 0 words, score 0 and a null mean; a lone document has
    only unseen words. Each repeated row is a document of its own; an empty table has no rows."""
    blocks = _blocks(docs, block_bytes)
    n_corpus = int(blocks.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0])
    parts = max(1, -(-n_corpus // TABLE_ROWS))
    answers = _answers(_requests(blocks, order, parts))
    names = ["doc_id", "n_words", "log_score", "mean_log_score", *[f"n_{n}" for n in range(1, order + 1)], "n_unseen"]

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        parts_of: dict[int, list] = {n: [] for n in range(1, order + 1)}
        right = right.sort_by("part")
        for n, x in zip(right["n"].to_pylist(), right["totals"]):
            parts_of[n].append(_from_planes(x.as_py()))
        totals = {n: np.concatenate(x) if x else np.zeros(0, np.uint64) for n, x in parts_of.items()}
        b = left.combine_chunks().to_batches()[0]
        w = _read(b, 0)
        packed = np.frombuffer(column(b, "docs")[0].as_py(), np.int64)
        ids, none = packed[: len(packed) // 2], packed[len(packed) // 2:] > 0
        logs, per_doc = _score(w, totals, order, alpha, n_corpus)
        n = w.counts
        mean = pa.array(logs / np.maximum(n, 1), pa.float64(), mask=n == 0)
        cols = [pa.array(ids, pa.int64(), mask=none), pa.array(n, pa.int64()), pa.array(logs, pa.float64()), mean,
                *[pa.array(x, pa.int64()) for x in per_doc[1:]], pa.array(per_doc[0], pa.int64())]
        return pa.table(cols, names=names)

    schema = ", ".join(f"{n} {'double' if 'score' in n else 'long'}" for n in names)
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, schema)

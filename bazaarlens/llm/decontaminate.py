"""Benchmark decontamination as a prefix-filtered set join.

A window of an item is a record of word shingles. Shingles are ordered by rarity over the whole corpus; since all of a
window must occur, its rarest shingle is prefix enough. Documents are searched for prefix shingles only; a find
must leave room for the whole window before and after it (length and position bounds) and is then verified word by
word over the item-sized window. Documents never move: windows go to them in blocks of bounded size."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaarlens.llm.tables import fresh, ship
from bazaarlens.llm.words import ALNUM, Words, column, concat_ranges, slices, words
from bazaarlens.session import cut_lineage

WINDOW = 13
SHINGLE = 3
BLOCK = 100_000  # windows broadcast at once: about 20 MB with shingles
CUT = 4  # blocks chained in one job
RESULT = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
_KINDS = {"n_words": T.LongType(), "n_hit": T.LongType(), "n_items": T.LongType(), "items_sha256": T.StringType(),
          "contaminated": T.BooleanType(), "spans": T.ArrayType(T.LongType()), "items": T.ArrayType(T.StringType())}
_ARROW = {"n_words": pa.int64(), "n_hit": pa.int64(), "n_items": pa.int64(), "items_sha256": pa.string(),
          "contaminated": pa.bool_(), "spans": pa.list_(pa.int64()), "items": pa.list_(pa.string())}


def item_windows(benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(item, n, words, shingles) for every window; an item of fewer words is one window, one without words none."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items = b.column(0).to_pylist()
            for at, texts in slices(b.column(1)):
                w = words(texts, ALNUM)
                rows = []
                for i, (lo, hi) in enumerate(zip(w.bounds[:-1], w.bounds[1:])):
                    size = int(min(window, hi - lo))
                    for s in range(lo, hi - size + 1) if size else ():
                        part = w.hashes[s: s + size]
                        grams, _ = Words(part, np.array([0, size])).grams(min(shingle, size))
                        rows.append((items[at + i], size, part.tobytes(), grams.view(np.int64).tolist()))
                    if len(rows) > 20_000:
                        yield _rows(rows)
                        rows = []
                yield _rows(rows)

    def _rows(rows: list) -> pa.RecordBatch:
        cols = list(zip(*rows)) or [[], [], [], []]
        kinds = (pa.string(), pa.int32(), pa.binary(), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)],
                                          ["item", "n", "words", "shingles"])

    items = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string"))
    return items.mapInArrow(cut, "item string, n int, words binary, shingles array<long>")


class _Keys:
    """Sorted 64-bit keys with a bit table in front, for looking up many numbers."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        bits = min(24, max(16, int(len(self.keys) * 16).bit_length()))
        self.mask = np.uint64((1 << bits) - 1)
        self.table = np.zeros(1 << bits, bool)
        self.table[(self.keys & self.mask).astype(np.int64)] = True

    def find(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in g that hold a key, and which key."""
        if not len(self.keys):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        maybe = np.flatnonzero(self.table[(g & self.mask).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, g[maybe]), len(self.keys) - 1)
        ok = self.keys[at] == g[maybe]
        return maybe[ok], at[ok]


def _document_counts(docs: DataFrame, keys: dict[int, _Keys]) -> dict[int, np.ndarray]:
    """In how many documents each shingle occurs, over the whole corpus; keys by shingle length."""
    held = ship(docs.sparkSession, keys)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {s: np.zeros(len(k.keys), np.int64) for s, k in held().items()}
        for b in batches:
            for _, texts in slices(b.column(0)):
                w = words(texts, ALNUM)
                for s, k in held().items():
                    g, places = w.grams(s)
                    at, which = k.find(g)
                    doc = np.searchsorted(w.bounds, places[at], "right") - 1
                    pairs = np.unique(doc * np.int64(len(k.keys)) + which)
                    totals[s] += np.bincount(pairs % len(k.keys), minlength=len(k.keys)) if len(pairs) else 0
        for s, n in totals.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), s), pa.int32()), pa.array(some, pa.int64()),
                                              pa.array(n[some], pa.int64())], ["s", "k", "n"])

    found = docs.select(F.col("text").cast("string")).mapInArrow(count, "s int, k long, n long")
    out = {s: np.zeros(len(k.keys), np.int64) for s, k in keys.items()}
    for r in found.groupBy("s", "k").agg(F.sum("n").alias("n")).toLocalIterator():  # a row per broadcast key at most
        out[r["s"]][r["k"]] = r["n"]
    return out


def _sorted(items: Iterable[str | None]) -> list[str | None]:
    """Different items by name; one without an id comes last."""
    return sorted(set(items), key=lambda x: (x is None, x or ""))


class _Index:
    """Windows of one block under their rarest shingle."""

    def __init__(self, rows: list, shingle: int):
        self.items = _sorted(r["item"] for r in rows)
        at = {x: i for i, x in enumerate(self.items)}
        self.item = np.array([at[r["item"]] for r in rows], np.int64)
        self.n = np.array([r["n"] for r in rows], np.int64)
        self.words = np.zeros((len(rows), int(self.n.max(initial=1))), np.uint64)
        for i, r in enumerate(rows):
            self.words[i, : r["n"]] = np.frombuffer(bytes(r["words"]), "<u8")
        self.sizes = np.minimum(self.n, shingle)
        self.shingles = [np.array(r["shingles"], np.int64).view(np.uint64) for r in rows]

    def keys(self) -> dict[int, _Keys]:
        return {int(s): _Keys(np.concatenate([g for g, z in zip(self.shingles, self.sizes) if z == s]))
                for s in np.unique(self.sizes)}

    def order(self, keys: dict[int, _Keys], counts: dict[int, np.ndarray]) -> None:
        """Keep of every window its rarest shingle and that shingle's place; ties go to the smaller hash."""
        self.offset = np.zeros(len(self.n), np.int64)
        prefix = np.zeros(len(self.n), np.uint64)
        for i, (g, s) in enumerate(zip(self.shingles, self.sizes)):
            df = counts[int(s)][np.searchsorted(keys[int(s)].keys, g)]
            best = np.lexsort((g, df))[0]
            self.offset[i], prefix[i] = best, g[best]
        self.prefix, self.under = {}, {}
        for s in keys:
            own = np.flatnonzero(self.sizes == s)
            k = _Keys(prefix[own])
            which = np.searchsorted(k.keys, prefix[own])
            order = np.argsort(which, kind="stable")
            starts = np.searchsorted(which[order], np.arange(len(k.keys) + 1))
            self.prefix[s], self.under[s] = k, (own[order], starts)
        del self.shingles

    def hits(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of every occurrence of a window in the texts."""
        found = []
        for s, k in self.prefix.items():
            g, places = w.grams(s)
            at, which = k.find(g)
            own, starts = self.under[s]
            many = starts[which + 1] - starts[which]
            window = own[concat_ranges(starts[which], many)]
            place = np.repeat(places[at], many)
            doc = np.searchsorted(w.bounds, place, "right") - 1
            start = place - self.offset[window]
            fits = (start >= w.bounds[doc]) & (start + self.n[window] <= w.bounds[doc + 1])
            start, window = start[fits], window[fits]
            for j in range(self.words.shape[1]):
                same = self.n[window] <= j
                same[~same] = w.hashes[start[~same] + j] == self.words[window[~same], j]
                start, window = start[same], window[same]
            found.append((start, window))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _scan(index: Callable[[], _Index], text: str, carried: list[str], keep: list[str], names: list[str],
          schema: pa.Schema, last: bool) -> Callable:
    """One block of windows against a partition. `carried`: the span and item columns of earlier blocks, if any."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index()
        for b in batches:
            outs = [[] for _ in names]
            for at, texts in slices(column(b, text)):
                w = words(texts, ALNUM)
                start, window = ix.hits(w)
                doc = np.searchsorted(w.bounds, start, "right") - 1
                spans = [(doc, start - w.bounds[doc], ix.n[window])]
                items = [[] for _ in range(len(texts))]
                for d, i in set(zip(doc.tolist(), ix.item[window].tolist())):
                    items[d].append(ix.items[i])
                if carried:
                    old = column(b, carried[0]).slice(at, len(texts)).to_pylist()
                    for d, x in enumerate(old):
                        if x:
                            x = np.array(x, np.int64)
                            spans.append((np.full(len(x), d), x >> 16, x & 0xFFFF))
                    for d, x in enumerate(column(b, carried[1]).slice(at, len(texts)).to_pylist()):
                        items[d] += x or []
                doc, start, n = (np.concatenate(x) for x in zip(*spans))
                got = _totals(w, doc, start, n, items) if last else _state(len(texts), doc, start, n, items)
                for o, x in zip(outs, got):
                    o.extend(x)
            cols = [column(b, c) for c in keep]
            new = [pa.array(o, schema.field(n).type) for n, o in zip(names, outs)]
            yield pa.RecordBatch.from_arrays(cols + new, keep + names)

    return run


def _state(size: int, doc, start, n, items) -> list[list]:
    """Spans as start * 2^16 + length, and item names, per text."""
    spans = [[] for _ in range(size)]
    for d, x in sorted(set(zip(doc.tolist(), ((start << 16) + n).tolist()))):
        spans[d].append(x)
    return [spans, [_sorted(x) for x in items]]


def _totals(w: Words, doc, start, n, items) -> list[list]:
    cover = np.zeros(len(w.hashes) + 1, np.int64)
    at = w.bounds[doc] + start
    np.add.at(cover, at, 1)
    np.add.at(cover, at + n, -1)
    hit = np.concatenate([[0], np.cumsum(np.cumsum(cover)[:-1] > 0)])
    n_hit = (hit[w.bounds[1:]] - hit[w.bounds[:-1]]).tolist()
    counts = w.counts.tolist()
    names = [_sorted(x) for x in items]
    sha = [hashlib.sha256(",".join(i for i in x if i is not None).encode()).hexdigest() for x in names]
    return [counts, n_hit, [len(x) for x in names], sha, [h > 0 and 20 * h >= c for h, c in zip(n_hit, counts)]]


def mark_contaminated(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, window: int = WINDOW,
                      shingle: int = SHINGLE, block: int = BLOCK) -> tuple[DataFrame, list[str]]:
    """The rows of docs with the columns `keep` (all by default) and five new ones, whose names are returned too:
    words, hit words, items found, a digest of their names, and the decision (`RESULT`, underscored if taken).

    A text that is null or has no words has 0 words and is clean; rows may repeat; ties and extra columns do not
    matter. Items without an id count as one item, which has no name in the digest. Items without words are left out; an
    empty benchmark hits nothing."""
    keep = docs.columns if keep is None else keep
    names = fresh(docs, *RESULT)
    state = fresh(docs, "spans", "items")
    windows = cut_lineage(item_windows(benchmark, window, shingle).dropDuplicates(["item", "words"]))
    n_blocks = max(1, -(-windows.count() // block))
    windows = windows.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(n_blocks)))
    now = docs
    for k in range(n_blocks):
        index = _Index(windows.where(F.col("block") == k).collect(), shingle)  # about `block` windows
        keys = index.keys()
        index.order(keys, _document_counts(docs, keys))
        last = k == n_blocks - 1
        cols, added = (keep, names) if last else (docs.columns, state)
        base = RESULT if last else ["spans", "items"]
        fields = [T.StructField(n, _KINDS[x]) for n, x in zip(added, base)]
        schema = T.StructType([docs.schema[c] for c in cols] + fields)
        types = pa.schema([pa.field(n, _ARROW[x]) for n, x in zip(added, base)])
        run = _scan(ship(docs.sparkSession, index), "text", state if k else [], cols, added, types, last)
        now = now.mapInArrow(run, schema)
        if k % CUT == CUT - 1 and not last:
            now = cut_lineage(now)
    return now, names


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs."""
    rows, _ = mark_contaminated(docs.select("doc_id", F.col("text").cast("string").alias("text")), benchmark,
                                keep=["doc_id"], **options)
    return rows


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that are not contaminated, with their own columns only."""
    rows, names = mark_contaminated(docs, benchmark, **options)
    return rows.where(~F.col(names[-1])).select(*docs.columns)

"""Document fingerprints: a Merkle tree over leaves, paragraphs and sections.

Leaves are pieces of a paragraph that end where a rolling hash of the bytes before says so and have a largest size, which
grows from one character at the start of a text to `LEAF_MOST` bytes. Paragraphs end at line breaks, sections after
paragraphs chosen by their digest, so an edit moves no boundary far from it. Equal roots mean equal texts; where roots
differ, only differing branches are opened, down to the leaves that locate the edit."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.llm.tables import small_batches
from bazaarlens.llm.words import column, mix, slices, text_bytes
from bazaarlens.session import cut_lineage

LEAF = 32  # bytes of a leaf, on average
LEAF_MOST = 64  # bytes of a leaf at most, but for the rest of a last character
HEAD = 4  # a leaf that starts k bytes into a text has 1 + k / HEAD bytes at most
ROLL = 8  # bytes under the rolling hash
BLOCK = 1 << 20  # bytes hashed at once
PART_BYTES = 32 << 20  # text in a part of the order
SECTION = 4  # paragraphs of a section, on average


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


@dataclass
class Tree:
    """Digests by level; `leaf_size` in bytes, and how many leaves or paragraphs each node above has."""

    leaves: list[bytes]
    leaf_size: list[int]
    paragraphs: list[bytes]
    paragraph_leaves: list[int]
    sections: list[bytes]
    section_paragraphs: list[int]
    root: str


def trees(texts: pa.Array) -> Iterator[Tree]:
    """The tree of each text; null counts as empty, and an empty text has no leaf."""
    raw, bounds = text_bytes(texts)
    rolled = _rolled(raw)
    chosen = np.flatnonzero(rolled % np.uint16(LEAF) == 0)
    chosen = chosen[chosen - bounds[np.searchsorted(bounds, chosen, "right") - 1] >= ROLL]
    lines = np.flatnonzero(raw == 0x0A) + 1
    cuts = np.unique(np.concatenate([bounds, chosen, lines]))
    cuts = np.unique(np.concatenate([cuts, _forced(rolled, cuts, bounds)]))
    new_line = np.isin(cuts, lines)
    data = raw.tobytes()
    at = np.searchsorted(cuts, bounds)
    cuts, new_line = cuts.tolist(), new_line.tolist()
    for lo, hi in zip(at[:-1], at[1:]):
        yield _tree([data[cuts[k]: cuts[k + 1]] for k in range(lo, hi)], new_line[lo: hi])


_INSIDE = 0xFFFF  # of a place inside a character
_SAME = 0xFFFD  # of a place after a run of one byte, which would else be cut at each byte or at none


def _rolled(raw: np.ndarray) -> np.ndarray:
    """At each place a number of 16 bits from the `ROLL` bytes before it, odd where no leaf may end by itself."""
    out = np.full(len(raw), _SAME, np.uint16)
    for lo in range(ROLL, len(raw), BLOCK):
        hi = min(lo + BLOCK, len(raw))
        part = np.ascontiguousarray(raw[lo - ROLL: hi])
        x = np.ndarray((hi - lo,), dtype="<u8", buffer=part.data, strides=(1,))
        same = x == (x & np.uint64(0xFF)) * np.uint64(0x0101010101010101)
        out[lo:hi] = np.where(same, _SAME, mix(x + np.uint64(1)) >> np.uint64(48))
    out[(raw & 0xC0) == 0x80] = _INSIDE
    return out


def _forced(rolled: np.ndarray, cuts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Further cuts for leaves above their largest size: of the upper half of the sizes allowed, the place with the
    least number, so that a text that repeats itself is cut at the same phase again."""
    base = bounds[np.searchsorted(bounds, cuts[:-1], "right") - 1]
    far = cuts[:-1] - base
    wide = np.flatnonzero(np.diff(cuts) > np.minimum(LEAF_MOST, 1 + far // HEAD))
    out = []
    for s, e, base in zip(cuts[wide].tolist(), cuts[wide + 1].tolist(), base[wide].tolist()):
        while e - s > (most := min(LEAF_MOST, 1 + (s - base) // HEAD)):
            lo = s + most // 2 + 1
            # where the text is young, the bytes before may be another text's
            at = lo + int(rolled[lo: s + most + 1].argmin()) if lo - base >= ROLL else s + most
            while at < e and rolled[at] == _INSIDE:
                at += 1
            if at == e:
                break
            out.append(at)
            s = at
    return np.array(out, np.int64)


def _tree(pieces: list[bytes], new_line: list[bool]) -> Tree:
    leaves = [_digest(p) for p in pieces]
    paragraphs, counts, run = [], [], []
    for k, leaf in enumerate(leaves):
        if run and new_line[k]:
            paragraphs.append(_digest(b"".join(run)))
            counts.append(len(run))
            run = []
        run.append(leaf)
    if run:
        paragraphs.append(_digest(b"".join(run)))
        counts.append(len(run))
    sections, members, run = [], [], []
    for p in paragraphs:
        run.append(p)
        if p[0] % SECTION == 0:
            sections.append(_digest(b"".join(run)))
            members.append(len(run))
            run = []
    if run:
        sections.append(_digest(b"".join(run)))
        members.append(len(run))
    return Tree(leaves, [len(p) for p in pieces], paragraphs, counts, sections, members,
                hashlib.sha256(b"".join(sections)).hexdigest())


def _unshared(digests: list[bytes], other: list[bytes]) -> list[int]:
    """Places of the digests that the other side does not hold as often."""
    left = Counter(other)
    out = []
    for k, d in enumerate(digests):
        if left[d] > 0:
            left[d] -= 1
        else:
            out.append(k)
    return out


def _open(groups: list[int], counts: list[int]) -> list[int]:
    """Places of the children of the named groups."""
    at = np.concatenate([[0], np.cumsum(counts)]).tolist()
    return [k for g in groups for k in range(at[g], at[g + 1])]


def differing_leaves(a: Tree, b: Tree) -> tuple[list[int], list[int]]:
    """Leaves of each side that the other lacks, found from the root down through differing branches only."""
    if a.root == b.root:
        return [], []
    x, y = _unshared(a.sections, b.sections), _unshared(b.sections, a.sections)
    x, y = _open(x, a.section_paragraphs), _open(y, b.section_paragraphs)
    px, py = [a.paragraphs[k] for k in x], [b.paragraphs[k] for k in y]
    x, y = [x[k] for k in _unshared(px, py)], [y[k] for k in _unshared(py, px)]
    x, y = _open(x, a.paragraph_leaves), _open(y, b.paragraph_leaves)
    lx, ly = [a.leaves[k] for k in x], [b.leaves[k] for k in y]
    return [x[k] for k in _unshared(lx, ly)], [y[k] for k in _unshared(ly, lx)]


def likeness(a: Tree, b: Tree) -> float:
    """Share of both texts' bytes that lies in common branches: 1 for equal texts, 0 for nothing in common."""
    x, y = differing_leaves(a, b)
    total = sum(a.leaf_size) + sum(b.leaf_size)
    lost = sum(a.leaf_size[k] for k in x) + sum(b.leaf_size[k] for k in y)
    return 1.0 if a.root == b.root else (total - lost) / total


def edit_span(a: Tree, b: Tree) -> tuple[int | None, int | None]:
    """First byte and end of the part of a that b lacks; null if it lacks none."""
    x, _ = differing_leaves(a, b)
    if not x:
        return None, None
    at = np.concatenate([[0], np.cumsum(a.leaf_size)])
    return int(at[x[0]]), int(at[x[-1] + 1])


def in_order(docs: DataFrame, parts: int) -> DataFrame:
    """Rows (part, ghost, doc_id, text) such that each part, sorted, is a run of the descending order of doc_id, and ends
    with a ghost: the row that comes next, from the part behind it or, after the last, from the first.

    One shuffle of the texts, every part in a partition of its own. Bounds come from a quantile sketch and are found
    again in a sorted array; the ghosts come from a table with a row per part. Null ids come last; rows of one id are
    ordered by a hash of their text."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = keyed.select("doc_id", F.xxhash64("text").alias("tie"))
    shares = [k / parts for k in range(1, parts)]
    splits = ids.where("doc_id is not null").approxQuantile("doc_id", shares, 0.1 / parts) if shares else []
    edges = np.unique(np.array(splits, np.float64)).astype(np.int64)

    @F.arrow_udf("int")
    def part_of(doc_id: pa.Array) -> pa.Array:
        below = np.searchsorted(edges, doc_id.fill_null(0).to_numpy(zero_copy_only=False), "right")
        return pa.array(np.where(doc_id.is_null().to_numpy(zero_copy_only=False), len(edges), len(edges) - below), pa.int32())

    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), (-F.col("doc_id")).alias("o"), "tie")).alias("first")
    heads = cut_lineage(ids.withColumn("part", part_of("doc_id")).groupBy("part").agg(first))
    used = sorted(r[0] for r in heads.select("part").collect())  # a row per part
    behind = [(p, used[k - 1]) for k, p in enumerate(used)]  # the head of each part also ends the part before it
    ends = heads.join(docs.sparkSession.createDataFrame(behind, "part int, ends int"), "part").select(
        "part", "ends", F.col("first.o").alias("head_o"), F.col("first.tie").alias("head_tie"))
    placed = keyed.withColumn("part", part_of("doc_id")).join(F.broadcast(ends), "part")  # a row per part
    is_head = (-F.col("doc_id")).eqNullSafe(F.col("head_o")) & (F.xxhash64("text") == F.col("head_tie"))
    both = F.array(F.struct(F.col("part"), F.lit(False).alias("ghost")), F.struct(F.col("ends").alias("part"), F.lit(True).alias("ghost")))
    out = placed.select(F.explode(F.when(is_head, both).otherwise(F.slice(both, 1, 1))).alias("to"), "doc_id", "text")
    out = out.select("to.part", "to.ghost", "doc_id", "text").repartitionById(len(edges) + 1, "part")
    return out.withColumn("tie", F.xxhash64("text")).sortWithinPartitions(
        "part", "ghost", F.desc_nulls_last("doc_id"), "tie").drop("tie")


def part_count(docs: DataFrame) -> int:
    """Parts of about PART_BYTES, and no fewer than the session has shuffle partitions."""
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    return max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))


def fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, edit_start, edit_end.

    The edited text replaces the last third of the characters (rounded down) by as many first ones of the next
    document in descending doc_id, or all it has; the last document is followed by the first. Null texts are empty. An
    only row is its own next. Of rows with one doc_id the order is that of a hash of their texts; rows with null ids
    come last. edit_start and edit_end are bytes of the text, null if nothing differs. A very long text is one row of one
    part like any other; an empty table gives an empty result."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = parts or part_count(docs)
    kinds = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(),
             "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64(),
             "edit_start": pa.int64(), "edit_end": pa.int64()}

    def rows(ids, texts, ghosts, own) -> Iterator[pa.RecordBatch]:
        """Rows 0 to n - 2 of the arrays, each followed by the next."""
        edited = []
        for a, b in zip(texts[:-1], texts[1:]):
            cut = len(a) // 3
            edited.append(a[: len(a) - cut] + b[:cut])
        changed = list(trees(pa.array(edited, pa.large_string())))
        out = [[] for _ in kinds]
        for k, e in enumerate(edited):
            if ghosts[k]:
                continue
            start, end = edit_span(own[k], changed[k])
            for o, x in zip(out, (ids[k], len(texts[k]), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(),
                                  own[k].root, changed[k].root, likeness(own[k], changed[k]),
                                  likeness(own[k], own[k + 1]), start, end)):
                o.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, kinds.values())], list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row so far: it waits for its next
        for b in batches:
            for at, part in slices(column(b, "text"), 2 << 20):
                n = len(part)
                where = column(b, "part").slice(at, n).to_pylist()
                ghost, ids = (column(b, c).slice(at, n).to_pylist() for c in ("ghost", "doc_id"))
                texts, own = part.to_pylist(), list(trees(part))
                if held is not None:
                    where, ghost, ids, texts, own = ([h, *x] for h, x in zip(held, (where, ghost, ids, texts, own)))
                # a row after the first ghost of a part is a repeat of that ghost
                yield from rows(ids, texts, ghost, own)
                held = (where[-1], ghost[-1], ids[-1], texts[-1], own[-1])

    schema = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double, edit_start long, edit_end long")
    return in_order(docs, parts).mapInArrow(run, schema)

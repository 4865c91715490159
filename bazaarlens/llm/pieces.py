"""SentencePiece unigram encoding and decoding: the best-scored segmentation of a text into pieces (Viterbi over a
double-array trie), byte pieces where no piece fits, spaces carried as whitespace markers.

A text falls into units that no piece crosses: a run of markers with what follows it, and control characters. Equal
units of a run of texts are segmented once, and many of them together: each step of the search is an array operation
over all units that are still open. Texts are coded whole, in the task that reads them; nothing is shuffled."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaarlens.llm.tables import fresh, ship
from bazaarlens.llm.words import column, concat_ranges, hash_spans, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
UNKNOWN_PENALTY = 10.0
VECTOR = 48  # bytes; longer units are searched one by one
RESULT = ["ids", "n_tokens", "decoded_sha256", "round_trip"]


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field number and value of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        elif tag & 7 == 1:
            yield tag >> 3, data[at: at + 8]
            at += 8
        elif tag & 7 == 2:
            n = varint()
            yield tag >> 3, data[at: at + n]
            at += n
        else:
            yield tag >> 3, data[at: at + 4]
            at += 4


def read_pieces(path: str) -> tuple[list[tuple[str, float, int]], bool]:
    """(piece, score, kind) by id, and whether a marker is put ahead of a text, from a model file."""
    pieces, ahead = [], True
    with open(path, "rb") as f:
        data = f.read()
    for number, value in _fields(data):
        if number == 1:
            m = dict(_fields(value))
            score = struct.unpack("<f", m[2])[0] if 2 in m else 0.0
            pieces.append((m[1].decode(), score, m.get(3, NORMAL)))
        elif number == 3:
            m = dict(_fields(value))
            if m.get(2):
                raise ValueError("models that rewrite characters are not supported")
            ahead = bool(m.get(3, 1))
    return pieces, ahead


def double_array(entries: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check and value of a double-array trie: state s goes to base[s] + byte + 1 if check there is s."""
    tree: list[dict[int, int]] = [{}]
    ends = {0: -1}
    for key, value in entries:
        node = 0
        for b in key:
            if b not in tree[node]:
                tree[node][b] = len(tree)
                tree.append({})
            node = tree[node][b]
        ends[node] = value
    room = len(tree) * 2 + 1024
    base, check, value = ([0] * room, [-1] * room, [-1] * room)
    check[0] = 0
    single, wide, queue, at = 1, 1, [(0, 0)], 0  # first slots worth a try for nodes of one child and of several
    while at < len(queue):
        node, state = queue[at]
        at += 1
        value[state] = ends.get(node, -1)
        children = sorted(tree[node])
        if not children:
            continue
        low, span = children[0], children[-1] - children[0]
        slot = max(single if span == 0 else wide, low + 2)
        tries = 0
        while True:
            while slot + span >= len(check):
                for x, y in ((base, 0), (check, -1), (value, -1)):
                    x.extend([y] * len(x))
            if check[slot] < 0 and all(check[slot + c - low] < 0 for c in children):
                break
            slot += 1
            tries += 1
        if span == 0:
            single = slot if slot > low + 2 else single
        elif tries > 64:
            wide = slot
        base[state] = slot - low - 1
        for c in children:
            check[slot + c - low] = state
            queue.append((tree[node][c], slot + c - low))
    top = max(i for i, c in enumerate(check) if c >= 0) + 258
    return tuple(np.array((x + [y] * top)[:top], np.int32) for x, y in ((base, 0), (check, -1), (value, -1)))


@dataclass
class Pieces:
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    scores: np.ndarray
    byte_ids: np.ndarray  # id of the piece of each byte, or the unknown piece
    text: np.ndarray  # bytes that each id stands for, end to end
    bounds: np.ndarray
    unknown_id: int
    unknown_score: float
    ahead: bool
    at_marks: bool  # no piece has a marker after another character
    at_controls: bool  # no piece holds a control character next to another

    @classmethod
    def load(cls, path: str = MODEL) -> Pieces:
        return cls.of(*read_pieces(path))

    @classmethod
    def of(cls, pieces: list[tuple[str, float, int]], ahead: bool = True) -> Pieces:
        spelled = [(i, p, s) for i, (p, s, k) in enumerate(pieces) if k in (NORMAL, USER) and p]
        base, check, value = double_array([(p.encode(), i) for i, p, _ in spelled])
        unknown = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        byte_ids = np.full(256, unknown, np.int32)
        out = []
        for i, (p, _, kind) in enumerate(pieces):
            if kind == BYTE:
                byte_ids[int(p[3:5], 16)] = i
                out.append(bytes([int(p[3:5], 16)]))
            else:
                out.append(b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN
                           else p.replace(MARK, " ").encode())
        least = min((s for _, _, s in spelled), default=0.0)
        return cls(base, check, value, np.array([s for _, s, _ in pieces], np.float64), byte_ids,
                   np.frombuffer(b"".join(out), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in out])]),
                   unknown, least - UNKNOWN_PENALTY, ahead,
                   all(MARK not in p.lstrip(MARK) for _, p, _ in spelled),
                   all(len(p) == 1 or min(p) >= " " for _, p, _ in spelled))

    # --- encoding -------------------------------------------------------------------------------------------------
    def units(self, raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where units begin in the marked bytes of several texts."""
        cut = np.zeros(len(raw) + 1, bool)
        cut[bounds[:-1]] = True
        if self.at_marks and len(raw) > 2:
            mark = (raw[:-2] == 0xE2) & (raw[1:-1] == 0x96) & (raw[2:] == 0x81)
            first = mark.copy()
            first[3:] &= ~mark[:-3]
            cut[:-3] |= first
        if self.at_controls:
            control = raw < 0x20
            cut[:-1] |= control
            cut[1:] |= control
        return np.flatnonzero(cut[:-1])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the bounds of each text's."""
        marked = [((MARK if self.ahead else "") + t.replace(" ", MARK) if t else "") for t in texts]
        data = [t.encode("utf-8", "surrogatepass") for t in marked]
        raw = np.frombuffer(b"".join(data), np.uint8)
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)
        full = bounds[:-1][np.diff(bounds) > 0]
        if not len(full):
            return np.empty(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        starts = self.units(raw, np.append(full, len(raw)))
        ends = np.append(starts[1:], len(raw))
        _, first, which = np.unique(hash_spans(raw, starts, ends), return_index=True, return_inverse=True)
        ids, at = self.segment(raw, starts[first], ends[first])
        many = np.diff(at)
        out = ids[concat_ranges(at[:-1][which], many[which])]
        before = np.concatenate([[0], np.cumsum(many[which])])
        return out, before[np.searchsorted(starts, bounds)]

    def segment(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each unit end to end, and their bounds."""
        size = ends - starts
        parts: list = [None] * len(starts)
        order = np.argsort(size, kind="stable")
        short = order[size[order] <= VECTOR]
        blocks = []
        for k in range(0, len(short), 16_384):
            own = short[k: k + 16_384]
            blocks.append((own, *self._together(raw, starts[own], size[own])))
        counts = np.zeros(len(starts), np.int64)
        for own, _, n in blocks:
            counts[own] = n
        for i in order[size[order] > VECTOR]:
            parts[i] = self._alone(raw[starts[i]: ends[i]].tobytes())
            counts[i] = len(parts[i])
        at = np.concatenate([[0], np.cumsum(counts)])
        ids = np.empty(at[-1], np.int32)
        for own, flat, n in blocks:
            ids[concat_ranges(at[own], n)] = flat
        for i, p in enumerate(parts):
            if p is not None:
                ids[at[i]: at[i + 1]] = p
        return ids, at

    def _together(self, raw: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The Viterbi search over many units of similar length at once. Of equal scores the longer last piece wins."""
        w, most = len(starts), int(size.max())
        padded = np.append(raw, np.zeros(most + 4, np.uint8))
        mat = padded[starts[:, None] + np.arange(most)].astype(np.int32)
        mat[np.arange(most) >= size[:, None]] = 256  # no byte; never in the trie
        best = np.full((most + 5, w), -np.inf)
        back = np.zeros((most + 5, w), np.int32)
        piece = np.full((most + 5, w), -1, np.int32)
        best[0] = 0
        for i in range(most):
            rows = np.flatnonzero(best[i] > -np.inf)
            rows = rows[size[rows] > i]
            if not len(rows):
                continue
            lead = mat[rows, i]
            char = np.where(lead < 0xC0, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
            char = np.minimum(char, size[rows] - i)
            single = np.zeros(len(rows), bool)
            state, own = np.zeros(len(rows), np.int32), np.arange(len(rows))
            for k in range(i, most):
                to = self.base[state] + mat[rows[own], k] + 1
                ok = (self.check[to] == state) & (to > 0)
                state, own = to[ok], own[ok]
                if not len(own):
                    break
                v = self.value[state]
                end = np.flatnonzero(v >= 0)
                if len(end):
                    who, v = own[end], v[end]
                    single[who] |= char[who] == k + 1 - i
                    r = rows[who]
                    score = best[i, r] + self.scores[v]
                    up = score > best[k + 1, r]
                    r, v = r[up], v[up]
                    best[k + 1, r], back[k + 1, r], piece[k + 1, r] = score[up], i, v
            lone = np.flatnonzero(~single)
            if len(lone):
                r, to = rows[lone], i + char[lone]
                score = best[i, r] + self.unknown_score
                up = score > best[to, r]
                r, to = r[up], to[up]
                best[to, r], back[to, r], piece[to, r] = score[up], i, -1
        where, what, unit = [], [], []
        rows, pos = np.arange(w), size.copy()
        while len(rows):
            p, b = piece[pos, rows], back[pos, rows]
            known = p >= 0
            where.append(b[known].astype(np.int64))
            what.append(p[known])
            unit.append(rows[known])
            for r, lo, hi in zip(rows[~known], b[~known], pos[~known]):  # a character without a piece: its bytes
                where.append(np.arange(lo, hi))
                what.append(self.byte_ids[mat[r, lo:hi]])
                unit.append(np.full(hi - lo, r))
            pos = b.astype(np.int64)
            rows, pos = rows[pos > 0], pos[pos > 0]
        where, what, unit = np.concatenate(where), np.concatenate(what), np.concatenate(unit)
        return what[np.argsort(unit * (most + 1) + where)], np.bincount(unit, minlength=w)

    def _alone(self, data: bytes) -> list[int]:
        """The same search over one long unit."""
        n = len(data)
        best, back, piece = [-np.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        base, check, value, scores = self.base, self.check, self.value, self.scores
        for i in range(n):
            if best[i] == -np.inf:
                continue
            b = data[i]
            char = min(n - i, 1 if b < 0xC0 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4)
            state, single = 0, False
            for k in range(i, n):
                to = int(base[state]) + data[k] + 1
                if check[to] != state:
                    break
                state = to
                v = int(value[state])
                if v >= 0:
                    single |= k + 1 - i == char
                    score = best[i] + float(scores[v])
                    if score > best[k + 1]:
                        best[k + 1], back[k + 1], piece[k + 1] = score, i, v
            if not single and best[i] + self.unknown_score > best[i + char]:
                best[i + char], back[i + char], piece[i + char] = best[i] + self.unknown_score, i, -1
        out, at = [], n
        while at:
            lo = back[at]
            out += [piece[at]] if piece[at] >= 0 else [int(self.byte_ids[x]) for x in data[lo:at][::-1]]
            at = lo
        return out[::-1]

    # --- decoding -------------------------------------------------------------------------------------------------
    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The texts of runs of ids. Bytes that are no UTF-8 become U+FFFD; the marker ahead of a text goes."""
        size = np.diff(self.bounds)[ids]
        data = self.text[concat_ranges(self.bounds[ids], size)].tobytes()
        at = np.concatenate([[0], np.cumsum(size)])[bounds]
        out = [data[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:])]
        return [x[1:] if self.ahead and x.startswith(" ") else x for x in out]


def encode(docs: DataFrame, path: str = MODEL, keep: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """The rows of docs with the columns `keep` (all by default) and, under the names returned: ids, their number, the
    SHA-256 of the text that the ids decode to, and whether that is the text itself.

    A null text has null ids, 0 tokens, no digest and a null round trip; an empty one has no ids. A text that holds the
    whitespace marker itself comes back with spaces. Rows may repeat; other columns are carried as they are."""
    keep = docs.columns if keep is None else keep
    names = fresh(docs, *RESULT)
    held = ship(docs.sparkSession, Pieces.load(path))  # a vocabulary file, read by the driver
    kinds = (T.ArrayType(T.IntegerType()), T.LongType(), T.StringType(), T.BooleanType())
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(n, k) for n, k in zip(names, kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = held()
        for b in batches:
            for at, part in slices(column(b, "text"), 1 << 20):
                texts = part.to_pylist()
                ids, bounds = pieces.encode(texts)
                back = pieces.decode(ids, bounds)
                none = np.array([t is None for t in texts], bool)
                offsets = pa.array(bounds.astype(np.int32), mask=np.append(none, False))
                lists = pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))
                sha = [None if t is None else hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
                       for t, x in zip(texts, back)]
                same = [None if t is None else t == x for t, x in zip(texts, back)]
                yield pa.RecordBatch.from_arrays(
                    [column(b, c).slice(at, len(texts)) for c in keep]
                    + [lists, pa.array(np.diff(bounds), pa.int64()), pa.array(sha, pa.string()),
                       pa.array(same, pa.bool_())], keep + names)

    return docs.mapInArrow(run, schema), names


def decode(rows: DataFrame, path: str = MODEL, ids: str = "ids", out: str = "text") -> DataFrame:
    """The rows with the text of their ids in a column `out` (underscored if taken). Null ids have a null text."""
    name, = fresh(rows, out)
    keep = rows.columns
    held = ship(rows.sparkSession, Pieces.load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = column(b, ids).to_pylist()
            flat = np.array([x for one in lists for x in one or ()], np.int64)
            bounds = np.concatenate([[0], np.cumsum([len(x or ()) for x in lists])]).astype(np.int64)
            texts = [None if x is None else t for x, t in zip(lists, held().decode(flat, bounds))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], keep + [name])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, T.StringType())]))


def encoded(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, ids, n_tokens, decoded_sha256, round_trip for every row of docs."""
    return encode(docs.select("doc_id", F.col("text").cast("string").alias("text")), path, keep=["doc_id"])[0]

"""Words of whole texts as 64-bit hashes, found in the bytes of an Arrow batch with numpy.

Both word rules of this subpackage are ASCII rules, so they can be read off UTF-8 bytes: every byte of a longer
character is 128 or more. Hashes are 64 bits wide; two different words share one with a chance of about 2^-64."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BYTES = np.arange(256)
#: Letters, digits and everything beyond ASCII: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z.
ALNUM = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
#: Everything but ASCII white space: `[^\x20\x09-\x0D]+`.
NONSPACE = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))
_LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)
_LONG = 64  # bytes; a longer word is hashed on its own
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=np.uint64)
_C1, _C2, _C3 = (np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finisher of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _C2
    x ^= x >> np.uint64(27)
    x = x * _C3
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """Words of several texts: `hashes[bounds[i]:bounds[i + 1]]` are those of text i, in order."""

    hashes: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every run of n words inside a text, with the place of its first word."""
        h = self.hashes
        if len(h) < n:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        g = h[: len(h) - n + 1].copy()
        for k in range(1, n):
            g = mix(g * _C1 + h[k: len(h) - n + 1 + k])
        inside = np.ones(len(g) + n, bool)
        for k in range(1, n):  # the last n - 1 words of a text start no run
            at = self.bounds[1:] - k
            at = at[at >= self.bounds[:-1]]
            inside[at[at < len(inside)]] = False
        places = np.flatnonzero(inside[: len(g)])
        return g[places], places


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array, and where each text begins and ends in them. Null counts as empty."""
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[texts.offset: texts.offset + len(texts) + 1]
    bounds = bounds.astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[bounds[0]: bounds[-1]], bounds - bounds[0]


def slices(texts: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, pa.Array]]:
    """Runs of whole texts of about `limit` bytes, so that working arrays stay small; a longer text is a run of its own."""
    if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type):
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield at, texts.slice(at, i - at)
            at, total = i, 0
        total += int(n)
    if at < len(texts):
        yield at, texts.slice(at)


def spans(raw: np.ndarray, bounds: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of every run of bytes of a kind that stays inside a text; bounds by text."""
    inside = np.zeros(len(raw) + 1, bool)
    inside[:-1] = kind[raw]
    before = np.empty(len(raw) + 1, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[bounds[:-1]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(raw) + 1, bool)
    after[:-1] = inside[1:]
    after[-1] = False
    ends_at = bounds[1:][bounds[1:] > 0] - 1
    after[ends_at] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span: eight bytes at a step, all spans at once."""
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    eights = np.ndarray((len(raw) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    size = ends - starts
    out = size.astype(np.uint64) * _C1
    open_ = np.arange(len(starts)) if not len(size) or size.max() <= _LONG else np.flatnonzero(size <= _LONG)
    step = 0
    while len(open_):
        left = size[open_] - 8 * step
        x = eights[starts[open_] + 8 * step] & _MASKS[np.minimum(left, 8)]
        out[open_] = mix(out[open_] ^ x) + _C1
        open_ = open_[left > 8]
        step += 1
    for i in np.flatnonzero(size > _LONG):
        digest = hashlib.blake2b(raw[starts[i]: ends[i]].tobytes(), digest_size=8).digest()
        out[i] = np.frombuffer(digest, "<u8")[0]
    return out


def words(texts: pa.Array, kind: np.ndarray) -> Words:
    """The words of texts, A-Z lower-cased."""
    raw, bounds = text_bytes(texts)
    raw = _LOWER[raw]
    starts, ends, at = spans(raw, bounds, kind)
    return Words(hash_spans(raw, starts, ends), at)


def concat_ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] of them), then those of the next range."""
    if not len(starts):
        return np.empty(0, np.int64)
    total = int(counts.sum())
    steps = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.repeat(starts, counts) + steps


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))

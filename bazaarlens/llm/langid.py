"""Language identification by interpolated Kneser-Ney character models, one per language.

Character n-grams of a bounded, labelled sample are counted on the cluster. Their smoothed probabilities, for all
languages side by side, lie in arrays sorted by n-gram hash; that model is what tasks get. A text goes to the language
with the lowest cross-entropy per character, over the whole text. Rejection is calibrated on labelled texts that
the models have not seen: a text is rejected if its cross-entropy lies half-way between its language's mean there
and that of symbols no model expects, and beyond how far texts of its length stray."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaarlens.llm.tables import fresh, ship
from bazaarlens.llm.words import column, mix, slices

ORDER = 4
SAMPLE_CHARS = 2_000_000  # of labelled text per language, about; bounds the model
HELD_BACK = 5  # one in so many sampled texts calibrates instead of training
SPREAD = 1.5  # rejection limit over the widest stray of calibration texts
SOFT = 32  # characters at most that count towards the score
EDGE = 0x20
RESULT = ["lang_pred", "score", "cross_entropy", "rejected"]
_STEP = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def _classes() -> np.ndarray:
    """Per code point: 2 for a letter, 1 for a mark inside words, 0 for anything else."""
    kinds = {"L": 2, "M": 1}
    return np.array([kinds.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)], np.uint8)


@dataclass
class Symbols:
    """Texts as code points: lower case, every run of other characters one EDGE, ORDER - 1 edges ahead of each."""

    codes: np.ndarray
    bounds: np.ndarray
    letters: np.ndarray


def symbols(texts: list[str | None], order: int = ORDER) -> Symbols:
    ahead = "\n" * (order - 1)
    parts = [f"{ahead}{(t or '').lower()} " for t in texts]
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    kinds = _classes()[codes]
    keep = kinds > 0
    letters = np.concatenate([[0], np.cumsum(kinds == 2)])
    after = np.zeros(len(codes), bool)
    after[1:] = keep[:-1] & ~keep[1:]
    codes = np.where(keep, codes, EDGE).astype(np.uint32)
    keep |= after
    for k in range(order - 1):
        keep[bounds[:-1] + k] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    return Symbols(codes[keep], kept[bounds], letters[bounds[1:]] - letters[bounds[:-1]])


def _hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """At each place, the hash of the k symbols that end there (from place k - 1 on)."""
    h = codes[: len(codes) - k + 1].astype(np.uint64)
    for j in range(1, k):
        h = mix(h * _STEP + codes[j: len(codes) - k + 1 + j])
    return h


@dataclass
class Sorted:
    """Rows of values under sorted 64-bit keys, with a jump table over their leading bits."""

    keys: np.ndarray
    rows: np.ndarray
    jump: np.ndarray = field(init=False)
    shift: np.uint64 = field(init=False)

    def __post_init__(self):
        order = np.argsort(self.keys)
        self.keys = np.append(self.keys[order], np.uint64(2**64 - 1))
        self.rows = self.rows[order]
        bits = max(1, len(self.keys).bit_length())
        self.shift = np.uint64(64 - bits)
        edges = np.arange(1 << bits, dtype=np.uint64) << self.shift
        self.jump = np.searchsorted(self.keys[:-1], edges).astype(np.int32)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The row of each hash, and whether it is there."""
        at = self.jump[(h >> self.shift).astype(np.int64)]
        open_ = np.flatnonzero(self.keys[at] < h)
        while len(open_):
            at[open_] += 1
            open_ = open_[self.keys[at[open_]] < h[open_]]
        found = (self.keys[at] == h) & (at < len(self.rows))
        return at, found


@dataclass
class Model:
    languages: list[str]
    order: int
    grams: list[Sorted]  # by length: log probability of the last symbol after the ones before, per language
    contexts: list[Sorted]  # by length of what follows them: log weight of the shorter model, per language
    floor: float
    mean: np.ndarray | None = None
    stray: np.ndarray | None = None

    def log_likelihoods(self, s: Symbols) -> np.ndarray:
        """Per text and language: the summed log probability of its symbols."""
        n, size = self.order, len(s.bounds) - 1
        totals = np.zeros((size, len(self.languages)))
        counts = np.diff(s.bounds) - (n - 1)
        some = np.flatnonzero(counts > 0)
        if not len(some):
            return totals
        inside = np.ones(len(s.codes), bool)
        for k in range(n - 1):
            inside[s.bounds[:-1] + k] = False
        places = np.flatnonzero(inside)
        logs = np.zeros((len(places), len(self.languages)), np.float32)
        open_ = np.arange(len(places))
        for k in range(n, 0, -1):
            h = _hashes(s.codes, k)[places[open_] - (k - 1)]
            row, found = self.grams[k].find(h)
            logs[open_[found]] += self.grams[k].rows[row[found]]
            open_ = open_[~found]
            if not len(open_):
                break
            if k > 1:
                h = _hashes(s.codes, k - 1)[places[open_] - 1 - (k - 2)]
                row, found = self.contexts[k].find(h)
                logs[open_[found]] += self.contexts[k].rows[row[found]]
            else:
                logs[open_] += np.float32(self.floor)
        starts = np.concatenate([[0], np.cumsum(counts[some])[:-1]])
        totals[some] = np.add.reduceat(logs.astype(np.float64), starts, axis=0)
        return totals

    def judge(self, texts: list[str | None]) -> tuple[list, list, list, list]:
        """Language, score, cross-entropy per symbol and rejection of each text."""
        s = symbols(texts, self.order)
        n = np.maximum(np.diff(s.bounds) - (self.order - 1), 1)
        if not self.languages:
            return (["und"] * len(texts), [0.0] * len(texts), [None] * len(texts), [True] * len(texts))
        entropy = -self.log_likelihoods(s) / n[:, None]
        best = entropy.argmin(1)
        own = entropy[np.arange(len(best)), best]
        weight = np.exp(-(entropy - own[:, None]) * np.minimum(n, SOFT)[:, None])
        score = 1 / weight.sum(1)
        none = s.letters == 0
        limit = np.full(len(best), np.inf)
        if self.mean is not None:
            blank = 0.5 * np.maximum(-self.floor - self.mean[best], 0)  # half-way to symbols that are all unexpected
            limit = self.mean[best] + np.maximum(self.stray[best] / np.sqrt(n), blank)
        return ([("und" if x else self.languages[b]) for x, b in zip(none, best)],
                np.where(none, 0.0, score).tolist(), [None if x else float(e) for x, e in zip(none, own)],
                (none | (own > limit)).tolist())


def train_model(counts: list[tuple[str, str, int]], order: int = ORDER) -> Model:
    """A model from (language, n-gram of `order` characters, count). The table is bounded by the sample it is from."""
    languages = sorted({c[0] for c in counts})
    own = {x: i for i, x in enumerate(languages)}
    if not languages:
        return Model([], order, [], [], 0.0)
    grams = np.array([[ord(x) for x in g] for _, g, _ in counts], np.uint32).reshape(-1, order)
    lang = np.array([own[x] for x, _, _ in counts])
    n = np.array([c for _, _, c in counts], np.float64)
    vocabulary = len(np.unique(grams)) + 1
    size = len(languages)
    floor = -np.log(vocabulary)
    levels = []  # (symbols, language, count) from the longest to single ones
    for k in range(order, 0, -1):
        levels.append((grams, lang, n))
        if k > 1:  # below the top, a gram counts the different symbols it follows
            key = np.unique(np.column_stack([lang, grams[:, 1:]]), axis=0, return_counts=True)
            lang, grams, n = key[0][:, 0].astype(np.int64), key[0][:, 1:].astype(np.uint32), key[1].astype(np.float64)
    tables: list = [None] * (order + 1)
    weights: list = [None] * (order + 1)
    shorter = None
    for k, (grams, lang, n) in zip(range(1, order + 1), reversed(levels)):
        keys = _row_hashes(grams)
        all_keys, first, which = np.unique(keys, return_index=True, return_inverse=True)
        symbols_of = grams[first]
        count = np.zeros((len(all_keys), size))
        np.add.at(count, (which, lang), n)
        discount = np.array([_discount(count[:, x]) for x in range(size)])
        context = _row_hashes(symbols_of[:, :-1]) if k > 1 else np.zeros(len(all_keys), np.uint64)
        contexts, of = np.unique(context, return_inverse=True)
        total, types = np.zeros((len(contexts), size)), np.zeros((len(contexts), size))
        np.add.at(total, of, count)
        np.add.at(types, of, count > 0)
        weight = np.where(total > 0, discount * types / np.maximum(total, 1e-300), 1.0)
        if k == 1:
            below = np.full((len(all_keys), size), np.exp(floor))
        else:
            below = shorter(symbols_of[:, 1:])
        p = np.where(total[of] > 0, np.maximum(count - discount, 0) / np.maximum(total[of], 1e-300), 0) + weight[of] * below
        tables[k] = Sorted(all_keys, np.log(p).astype(np.float32))
        weights[k] = Sorted(contexts, np.log(np.maximum(weight, 1e-12)).astype(np.float32))

        def shorter(g, k=k):  # every suffix of a counted gram is counted one level down
            return np.exp(tables[k].rows[tables[k].find(_row_hashes(g))[0]].astype(np.float64))
    unseen = float(np.mean(weights[1].rows[0])) + floor
    return Model(languages, order, tables, weights, unseen)


def _row_hashes(grams: np.ndarray) -> np.ndarray:
    h = grams[:, 0].astype(np.uint64)
    for j in range(1, grams.shape[1]):
        h = mix(h * _STEP + grams[:, j])
    return h


def _discount(counts: np.ndarray) -> float:
    once, twice = (counts == 1).sum(), (counts == 2).sum()
    return float(once / (once + 2 * twice)) if once else 0.5


def gram_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, n): character n-grams of labelled texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = np.array(column(b, "lang").to_pylist(), object)
            for at, texts in slices(column(b, "text"), 1 << 18):
                texts, names = texts.to_pylist(), langs[at: at + len(texts)]
                for name in set(names):
                    s = symbols([t for t, x in zip(texts, names) if x == name], order)
                    inside = np.ones(len(s.codes), bool)
                    for k in range(order - 1):
                        inside[s.bounds[:-1] + k] = False
                    ends = np.flatnonzero(inside)
                    if not len(ends):
                        continue
                    _, first, n = np.unique(_hashes(s.codes, order)[ends - order + 1], return_index=True,
                                            return_counts=True)
                    grams = np.column_stack([s.codes[ends[first] - order + 1 + j] for j in range(order)])
                    grams = np.ascontiguousarray(grams).view(f"<U{order}").ravel()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(n), pa.string()), pa.array(grams.tolist(), pa.string()),
                         pa.array(n, pa.int64())], ["lang", "gram", "n"])

    rows = docs.select("lang", "text").mapInArrow(run, "lang string, gram string, n long")
    return rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, key: Column, order: int = ORDER, sample_chars: int = SAMPLE_CHARS) -> Model:
    """A calibrated model from rows (lang, text). About `sample_chars` characters of each language are read, chosen by
    a hash of `key` and text; texts without a label or a letter teach nothing."""
    rows = labelled.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"),
                           F.xxhash64(key, F.col("text")).alias("h")).where("lang is not null and text is not null")
    totals = rows.groupBy("lang").agg(F.sum(F.length("text")).alias("n")).collect()  # a row per language
    if not totals:
        return train_model([], order)
    rates = F.create_map([F.lit(x) for r in totals for x in (r["lang"], min(1.0, sample_chars / max(1, r["n"])))])
    draw = F.pmod("h", F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.where(draw < F.element_at(rates, F.col("lang"))).withColumn(
        "held", F.pmod(F.shiftright("h", 32), F.lit(HELD_BACK)) == 0)
    counts = gram_counts(sample.where("not held"), order).collect()  # bounded by the sample
    model = train_model([(r["lang"], r["gram"], r["n"]) for r in counts], order)
    held = ship(labelled.sparkSession, model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held()
        for b in batches:
            names = column(b, "lang").to_pylist()
            for at, texts in slices(column(b, "text"), 1 << 18):
                s = symbols(texts.to_pylist(), m.order)
                n = np.diff(s.bounds) - (m.order - 1)
                logs = m.log_likelihoods(s)
                ok = [i for i in range(len(n)) if s.letters[i] and names[at + i] in m.languages]
                own = [-logs[i, m.languages.index(names[at + i])] for i in ok]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[at + i] for i in ok], pa.string()), pa.array([int(n[i]) for i in ok], pa.int64()),
                     pa.array(own, pa.float64())], ["lang", "n", "nats"])

    seen = sample.where("held").select("lang", "text").mapInArrow(measure, "lang string, n long, nats double")
    mean = seen.groupBy("lang").agg((F.sum("nats") / F.sum("n")).alias("mean"))
    wide = seen.join(mean, "lang").groupBy("lang", "mean").agg(
        F.max((F.col("nats") / F.col("n") - F.col("mean")) * F.sqrt("n")).alias("stray")).collect()  # a row per language
    got = {r["lang"]: (r["mean"], r["stray"]) for r in wide}
    model.mean = np.array([got.get(x, (np.inf, 0))[0] for x in model.languages])
    model.stray = SPREAD * np.array([max(got.get(x, (0, 0))[1], 0.5) for x in model.languages])
    return model


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """The rows of docs with the columns `keep` (all by default) and, under the names returned: the language, a score
    from 0 to 1, the cross-entropy in nats per character, and whether the text is rejected.

    A text that is null or has no letter is `und`, with score 0, and rejected; so is every text if nothing was learned.
    Equal cross-entropies go to the language first by name. Rows may repeat, other columns are carried as they are."""
    keep = docs.columns if keep is None else keep
    names = fresh(docs, *RESULT)
    held = ship(docs.sparkSession, model)
    kinds = (T.StringType(), T.DoubleType(), T.DoubleType(), T.BooleanType())
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(n, k) for n, k in zip(names, kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            outs = ([], [], [], [])
            for _, texts in slices(column(b, "text"), 1 << 18):
                for o, x in zip(outs, held().judge(texts.to_pylist())):
                    o.extend(x)
            new = [pa.array(o, k) for o, k in zip(outs, (pa.string(), pa.float64(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([column(b, c) for c in keep] + new, keep + names)

    return docs.mapInArrow(run, schema), names


def held_out() -> Column:
    """Rows that no model may learn from: crc32 of the id as text leaves 1 when divided by 3. A null id is neither
    held out nor learned from."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1


def fit_documents(docs: DataFrame, **options) -> Model:
    return fit(docs.where(~held_out()), F.col("doc_id"), **options)


def predictions(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy, rejected for every row of docs (doc_id, text, lang)."""
    model = fit_documents(docs, **options)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"),
                       F.coalesce(held_out(), F.lit(False)).alias("held_out"))
    return identify(rows, model, keep=["doc_id", "held_out"])[0]


def drop_rejected(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs whose text is not rejected, with their own columns only."""
    rows, names = identify(docs, fit_documents(docs, **options))
    return rows.where(~F.col(names[3])).select(*docs.columns)

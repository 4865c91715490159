"""N-gram Jaccard join with several global token orders.

Texts of one shingle set are one node from the start, so exact copies never pair. Under any global order of shingles
two sets above the threshold share a token in their prefixes; candidates are met under the first order and must then
share prefix tokens under every other order before their sets are compared. All orders put shingles that are
frequent in the corpus last (frequencies from a fixed-size count sketch over all texts) and differ in how they arrange
the rest, by hash. The shortest possible sets, lengths and positions prune as well.

Posting lists meet inside tasks, in blocks of bounded size, and parity marks of the whole sets reject nearly all that
are not alike before a pair leaves its task. A group of k near copies is not expanded into k * k pairs either: a forest
round sends only a spanning forest of what could be alike on to the comparison; nodes found connected share a label,
and the last round sends every pair that still differs in label."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from bazaarlens.llm.components import components
from bazaarlens.llm.tables import bitmap, combine_parts, emit_parts, fresh, joined_parts, ship, slot, small_batches
from bazaarlens.llm.words import NONSPACE, column, mix, slices, words
from bazaarlens.session import cut_lineage

SIZE = 3
PERCENT = 90
ORDERS = 3
SKETCH_BITS = 20  # slots of the frequency sketch: 8 MB in a task, 1 MB as broadcast levels
PARTS = 16
FORESTS = 1  # forest rounds before the pairs that remain
BLOCK = 1024  # a longer posting list is cut into blocks that meet two at a time
SLOT_BITS = 27  # most bits of the table that tells kept rows apart: 16 MB
MARKS = (256, 8192)  # fewest and most bits of the parity marks of a set
_SEEDS = [np.uint64(0xA24BAED4963EE407 * (2 * k + 1) % 2**64) for k in range(8)]


def shingle_sets(texts: pa.Array, size: int, kind: np.ndarray) -> Iterator[np.ndarray]:
    """Sorted distinct shingles of each text: runs of `size` words; fewer words are one shingle; none are none."""
    w = words(texts, kind)
    g, places = w.grams(size)
    at = np.searchsorted(places, w.bounds)
    short = {}
    for n in range(1, size):
        own = np.flatnonzero(w.counts == n)
        if len(own):
            gs, ps = w.grams(n)
            short.update(zip(own.tolist(), gs[np.searchsorted(ps, w.bounds[own])]))
    for i in range(len(texts)):
        yield np.array([short[i]], np.uint64) if i in short else np.unique(g[at[i]: at[i + 1]])


def _node(s: np.ndarray) -> int:
    """A 64-bit name of a set."""
    with np.errstate(over="ignore"):
        total = mix(np.array([mix(s ^ _SEEDS[6]).sum(dtype=np.uint64) ^ (np.uint64(len(s)) * _SEEDS[7])], np.uint64))
    return int(total.view(np.int64)[0])


def _prefix(s: np.ndarray, order: int, levels: np.ndarray, bits: int, percent: int) -> np.ndarray:
    """The first tokens of a set under an order: rare before frequent, then by a hash of the order."""
    p = len(s) - (percent * len(s) + 99) // 100 + 1
    rank = mix(s ^ _SEEDS[order]) >> np.uint64(8)
    rank |= levels[(s >> np.uint64(64 - bits)).astype(np.int64)].astype(np.uint64) << np.uint64(56)
    first = np.argpartition(rank, p - 1)[:p] if p < len(s) else np.arange(len(s))
    return s[first[np.argsort(rank[first], kind="stable")]]


def _marks(s: np.ndarray) -> bytes:
    """Per slot the parity of the tokens that fall into it, with about a slot for each token. Two sets that differ in d
    tokens differ in d marks at most. Marks fold to half their size by xor of the halves."""
    bits = MARKS[0]
    while bits < min(len(s), MARKS[1]):
        bits *= 2
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def _differing(marks: pa.Array, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """In how many marks the rows i and j differ, pair by pair, at the smaller size of each pair."""
    rows = [np.frombuffer(x.as_buffer(), np.uint64) for x in marks]
    size = np.array([len(x) for x in rows])
    width, out = np.minimum(size[i], size[j]), np.zeros(len(i), np.int64)
    for w in np.unique(width).tolist():
        own = np.flatnonzero(width == w)
        used, at = np.unique(np.concatenate([i[own], j[own]]), return_inverse=True)
        folded = np.stack([np.bitwise_xor.reduce(rows[k].reshape(-1, w), axis=0) for k in used])
        x, y = at[: len(own)], at[len(own):]
        for lo in range(0, len(own), 1 << 15):
            part = slice(lo, lo + (1 << 15))
            out[own[part]] = np.bitwise_count(folded[x[part]] ^ folded[y[part]]).sum(axis=1, dtype=np.int64)
    return out


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of edges (a, b) that connect what all of them connect and form no circle; earlier edges come first."""
    ends, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a):]
    root, left, kept = np.arange(len(ends)), np.arange(len(a)), []
    while True:
        x, y = root[u[left]], root[v[left]]
        left, x, y = (z[x != y] for z in (left, x, y))
        if not len(left):
            return np.concatenate(kept) if kept else left
        high, first = np.unique(np.maximum(x, y), return_index=True)  # every root hangs on a smaller one, once
        kept.append(left[first])
        up = np.arange(len(ends))
        up[high] = np.minimum(x, y)[first]
        while (up[up] != up).any():
            up = up[up]
        root = up[root]


def _near_pairs(rows: pa.Table, percent: int, forest: int | None) -> pa.RecordBatch:
    """Pairs (a, b) of nodes under one key that can be alike: labels differ, lengths, positions and marks allow it.
    rows: whole keys in order. In a cell of two blocks only rows of different blocks meet. With a forest number only
    as many pairs as connect the same labels: the nearest ones for forest 0, any for others."""
    key, node, n, pos, label, block, two = (
        rows.column(c).to_numpy() for c in ("key", "node", "n", "pos", "label", "block", "two"))
    left, right = [], []
    i, step = np.arange(len(key)), 1
    while len(i):
        i = i[i + step < len(key)]
        i = i[key[i + step] == key[i]]
        j = i + step
        least = -(-percent * (n[i] + n[j]) // (100 + percent))
        ok = ((label[i] != label[j]) & (~two[i] | (block[i] != block[j])) & (node[i] != node[j])
              & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
              & (np.minimum(n[i] - pos[i], n[j] - pos[j]) >= least))
        left.append(i[ok])
        right.append(j[ok])
        step += 1
    i, j = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right))
    least = -(-percent * (n[i] + n[j]) // (100 + percent))
    apart = _differing(rows.column("marks").combine_chunks(), i, j)
    ok = apart <= n[i] + n[j] - 2 * least
    i, j, apart = i[ok], j[ok], apart[ok]
    if forest is not None:
        seed = _SEEDS[forest]
        turn = apart if forest == 0 else mix(node[i].view(np.uint64) ^ mix(node[j].view(np.uint64) ^ seed))
        order = np.argsort(turn, kind="stable")
        i, j = i[order], j[order]
        kept = _forest(label[i], label[j])
        i, j = i[kept], j[kept]
    a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
    pairs = np.unique(np.stack([a, b]), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(pairs[0], pa.int64()), pa.array(pairs[1], pa.int64())], ["a", "b"])


class _Join:
    def __init__(self, docs: DataFrame, size: int, percent: int, kind: np.ndarray, orders: int, bits: int,
                 tied: bool = False):
        self.spark, self.size, self.percent, self.kind = docs.sparkSession, size, percent, kind
        self.orders, self.bits = orders, bits
        small_batches(self.spark)
        self.texts = docs.select(F.col("text").cast("string").alias("text")).withColumn("at", F.xxhash64("text"))
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.extra = ["tie"] if tied else []
        if tied:
            self.docs = self.docs.withColumn("tie", F.xxhash64("text"))

    def names(self) -> tuple[DataFrame, DataFrame]:
        """A row (doc_id, n, node) per document, with a hash `tie` of its text if asked for, and parts of the frequency
        sketch; one pass over the texts."""
        size, kind, bits, extra = self.size, self.kind, self.bits, self.extra

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts, seen = np.zeros(1 << bits, np.int64), set()
            for b in batches:
                ids, ns, nodes = column(b, "doc_id"), [], []
                for _, texts in slices(column(b, "text")):
                    fresh_sets = []
                    for s in shingle_sets(texts, size, kind):
                        ns.append(len(s))
                        nodes.append(_node(s) if len(s) else None)
                        if nodes[-1] not in seen and len(s):
                            seen.add(nodes[-1])
                            fresh_sets.append(s >> np.uint64(64 - bits))
                    if fresh_sets:
                        counts += np.bincount(np.concatenate(fresh_sets).astype(np.int64), minlength=1 << bits)
                yield _named(ids, ns, nodes, [None] * len(ns), [None] * len(ns), [column(b, c) for c in extra])
            if counts.any():
                parts, data = emit_parts(counts, PARTS)
                none = [None] * len(parts)
                yield _named(pa.array(none, pa.int64()), none, none, parts, data, [pa.array(none, pa.int64()) for _ in extra])

        def _named(ids, ns, nodes, parts, data, more):
            return pa.RecordBatch.from_arrays(
                [ids, pa.array(ns, pa.int64()), pa.array(nodes, pa.int64()), pa.array(parts, pa.int32()),
                 pa.array(data, pa.binary()), *more], ["doc_id", "n", "node", "part", "data", *extra])

        schema = ", ".join(["doc_id long, n long, node long, part int, data binary", *(f"{c} long" for c in extra)])
        rows = cut_lineage(self.docs.mapInArrow(run, schema))
        return (rows.where("part is null").select("doc_id", "n", "node", *extra),
                rows.where("part is not null").select("part", "data"))

    def levels(self, parts: DataFrame) -> np.ndarray:
        """Per sketch slot the binary logarithm of its count."""
        def log(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                data = [np.log2(np.frombuffer(x.as_py(), np.int64) + 1).astype(np.uint8).tobytes() for x in b.column(1)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], ["part", "data"])

        small = combine_parts(parts, "int64", "add").mapInArrow(log, "part int, data binary")
        return joined_parts(small, "uint8", 1 << self.bits, PARTS)

    def prefixes(self, levels: np.ndarray) -> DataFrame:
        """(node, at, n, prefix, marks) under the first order, for sets that another set can match; `at` finds a text of
        the set again."""
        size, kind, bits, percent = self.size, self.kind, self.bits, self.percent
        held = self.levels_held = ship(self.spark, levels)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = set()
            for b in batches:
                cols = [[], [], [], [], []]
                ats = column(b, "at").to_numpy(zero_copy_only=False)
                for first, texts in slices(column(b, "text")):
                    for i, s in enumerate(shingle_sets(texts, size, kind)):
                        if 100 * len(s) < percent * (len(s) + 1) or (node := _node(s)) in seen:
                            continue
                        seen.add(node)
                        prefix = _prefix(s, 0, held(), bits, percent).view(np.int64)
                        for c, x in zip(cols, (node, int(ats[first + i]), len(s), prefix, _marks(s))):
                            c.append(x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in cols[:3]]
                    + [pa.array(cols[3], pa.list_(pa.int64())), pa.array(cols[4], pa.binary())],
                    ["node", "at", "n", "prefix", "marks"])

        schema = "node long, at long, n long, prefix array<long>, marks binary"
        return cut_lineage(self.texts.mapInArrow(run, schema))

    def sets(self, wanted: DataFrame, others: int = 0) -> DataFrame:
        """(node, shingles, p1, p2, ...) of the wanted nodes, with their prefixes under the other orders; wanted:
        (node, at). Texts are passed over by a fixed-size bitmap; the few it lets through beyond are met by no join."""
        size, kind, bits, percent = self.size, self.kind, self.bits, self.percent
        chosen, levels = ship(self.spark, bitmap(wanted, "at")), self.levels_held
        names = [f"p{k}" for k in range(1, others + 1)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen, marks = set(), chosen()
            width = (len(marks) * 8).bit_length() - 1
            for b in batches:
                at = slot(column(b, "at").to_numpy(zero_copy_only=False), width)
                b = b.filter(pa.array((marks[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1))
                cols = [[] for _ in range(2 + others)]
                for _, texts in slices(column(b, "text")):
                    for s in shingle_sets(texts, size, kind):
                        if len(s) and (node := _node(s)) not in seen:
                            seen.add(node)
                            prefix = [_prefix(s, k, levels(), bits, percent).view(np.int64) for k in range(1, others + 1)]
                            for c, x in zip(cols, (node, s.tobytes(), *prefix)):
                                c.append(x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary())]
                    + [pa.array(c, pa.list_(pa.int64())) for c in cols[2:]], ["node", "shingles", *names])

        schema = "node long, shingles binary" + "".join(f", {n} array<long>" for n in names)
        return self.texts.mapInArrow(run, schema)

    def verified(self, pairs: DataFrame, prefixes: DataFrame) -> DataFrame:
        """The pairs that share prefix tokens under every other order and whose sets are alike enough."""
        others = self.orders - 1
        sets = cut_lineage(self.sets(cut_lineage(self._of(prefixes, pairs)), others))
        if others:
            names = [f"p{k}" for k in range(1, others + 1)]
            side = sets.select("node", *names).dropDuplicates(["node"])
            both = (pairs.join(side.toDF("a", *[f"a{x}" for x in names]), "a")
                    .join(side.toDF("b", *[f"b{x}" for x in names]), "b"))
            for x in names:
                both = both.where(F.arrays_overlap(f"a{x}", f"b{x}"))
            pairs = cut_lineage(both.select("a", "b"))
        percent = self.percent

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = []
                for x, y in zip(column(b, "x"), column(b, "y")):
                    x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                    both = len(x) + len(y) - len(np.union1d(x, y))
                    keep.append(100 * both >= percent * (len(x) + len(y) - both))
                yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        whole = sets.select("node", "shingles").dropDuplicates(["node"])
        met = pairs.join(whole.toDF("a", "x"), "a").join(whole.toDF("b", "y"), "b")
        return cut_lineage(met.mapInArrow(compare, "a long, b long"))

    @staticmethod
    def _of(prefixes: DataFrame, pairs: DataFrame) -> DataFrame:
        """(node, at): one text for each node of the pairs."""
        nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        return prefixes.select("node", "at").join(nodes, "node", "left_semi").groupBy("node").agg(F.min("at").alias("at"))

    def links(self, prefixes: DataFrame) -> DataFrame:
        """Links (a, b) between nodes: enough of them that every link joins nodes of one component."""
        rows = prefixes.select("node", "n", F.posexplode("prefix").alias("pos", "token"))
        by_size = W.partitionBy("token").orderBy("n")
        near = ((100 * F.lag("n").over(by_size) >= self.percent * F.col("n"))
                | (100 * F.col("n") >= self.percent * F.lead("n").over(by_size)))
        # the smallest partner that a token can bring leaves the most room for its place
        partner = F.greatest(100 * F.min("n").over(W.partitionBy("token")), self.percent * F.col("n"))
        room = 100 * (100 + self.percent) * (F.col("n") - F.col("pos")) >= self.percent * (100 * F.col("n") + partner)
        entries = cut_lineage(rows.repartition("token").dropDuplicates(["token", "node"])
                              .withColumn("near", near & room).where("near").drop("near"))
        found, tried, labels = None, None, None
        for k in [*range(FORESTS), None]:
            open_ = entries.withColumn("label", F.col("node")) if labels is None else self._open(entries, labels)
            pairs = self._pairs(open_, prefixes, k)
            if tried is not None:
                pairs = pairs.join(tried, ["a", "b"], "left_anti")
            pairs = cut_lineage(pairs)
            tried = pairs if tried is None else tried.union(pairs)
            good = self.verified(pairs, prefixes)
            found = good if found is None else found.union(good)
            if k is not None:
                labels = components(found).withColumnRenamed("component", "label")
        return found

    @staticmethod
    def _open(entries: DataFrame, labels: DataFrame) -> DataFrame:
        """Entries of tokens whose nodes still differ in label."""
        e = entries.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        per_token = W.partitionBy("token")
        e = e.withColumns({"lo": F.min("label").over(per_token), "hi": F.max("label").over(per_token)})
        return cut_lineage(e.where("lo < hi").drop("lo", "hi"))

    def _pairs(self, e: DataFrame, prefixes: DataFrame, forest: int | None) -> DataFrame:
        """Pairs of different labels under a token that lengths, positions and marks allow: a forest of them, or all.
        They are met inside tasks, in blocks of bounded size, and only those that pass leave them."""
        blocks = F.ceil(F.count(F.lit(1)).over(W.partitionBy("token")) / F.lit(BLOCK)).cast("int")
        e = e.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
        cells = e.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
            F.xxhash64("token", F.least("block", "other"), F.greatest("block", "other")).alias("key"),
            "node", "n", "pos", "label", "block", (F.col("block") != F.col("other")).alias("two"))
        # a row of the cell (k, k) comes once, one of the cell (k, l) from either block
        marks = prefixes.select("node", "marks").dropDuplicates(["node"])
        rows = cells.join(marks, "node").select("key", "node", "n", "pos", "label", "block", "two", "marks")
        percent = self.percent

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = None
            for b in batches:
                t = pa.Table.from_batches([b])
                t = t if held is None else pa.concat_tables([held, t])
                keys = t.column("key").to_numpy()
                cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
                held = t.slice(cut)
                if cut:
                    yield _near_pairs(t.slice(0, cut), percent, forest)
            if held is not None:
                yield _near_pairs(held, percent, forest)

        return rows.repartition("key").sortWithinPartitions("key").mapInArrow(meet, "a long, b long").distinct()


def jaccard_components(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, kind: np.ndarray = NONSPACE,
                       orders: int = ORDERS, bits: int = SKETCH_BITS) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text; other columns are not read).

    Two texts link when 100 * shared >= percent * united shingles. component_id is the smallest doc_id that links
    lead to, its own included; a null doc_id is never the smallest unless there is no other. A text that is null or
    without words has 0 shingles and its own doc_id. Repeated rows and ties are rows like any other; an empty table
    gives an empty result."""
    join = _Join(docs, size, percent, kind, orders, bits)
    named, parts = join.names()
    prefixes = join.prefixes(join.levels(parts))
    found = components(join.links(prefixes))
    least = named.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"))
    grouped = least.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    ids = cut_lineage(grouped.join(first, "component").select("node", "component_id"))
    out = named.join(ids, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"),
                      F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one_of_each(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, kind: np.ndarray = NONSPACE,
                     orders: int = ORDERS, bits: int = SKETCH_BITS) -> DataFrame:
    """One row of docs per component, with its own columns only: the one with the smallest doc_id, of these the one with
    the smallest hash of its text; one without a doc_id only if no row of the component has one. A row without words
    stays, but of those that repeat a doc_id and its text one stays."""
    join = _Join(docs, size, percent, kind, orders, bits, tied=True)
    named, parts = join.names()
    found = components(join.links(join.prefixes(join.levels(parts))))
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")
    least = named.where("node is not null").groupBy("node").agg(F.min(key).alias("least"))
    grouped = cut_lineage(least.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")))
    first = grouped.groupBy("component").agg(F.min("least").alias("first"))
    firsts = first.select("first.doc_id", "first.tie")
    # a key (doc_id, tie) is one text, so its rows are all of one component or all without words
    wordless = named.where("node is null").groupBy("doc_id", "tie").agg(F.count("*").alias("rows"))
    again = named.where("node is not null").groupBy("doc_id", "tie").agg(F.count("*").alias("rows"))
    suspects = again.join(firsts.withColumn("first", F.lit(True)), [
        again["doc_id"].eqNullSafe(firsts["doc_id"]), again["tie"] == firsts["tie"]], "left").select(
        again["doc_id"], again["tie"], F.col("first").isNull().alias("drop"), "rows").where("drop or rows > 1")
    more = wordless.where("rows > 1 and doc_id is not null").select("doc_id", "tie", F.lit(False).alias("drop"), "rows")
    return _without(docs, cut_lineage(suspects.unionByName(more).select("doc_id", "tie", "drop")))


def _without(docs: DataFrame, suspects: DataFrame) -> DataFrame:
    """docs without the rows whose key (doc_id, hash of the text) is to drop, and one row of each other suspect key.

    A bit table with sixteen slots a suspect, up to a fixed size, tells rows whose key is surely none of them: they
    pass in place. Only the others, about as many as suspects, meet the keys."""
    i, t, drop, word, bits = fresh(docs, "its_id", "its_tie", "its_drop", "its_word", "its_bits")
    size = min(max(1 << 16, 1 << (16 * suspects.count()).bit_length()), 1 << SLOT_BITS)
    slot = lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(size))
    bit = lambda s: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(s, F.lit(64)).cast("int"))
    keyed = suspects.withColumn("slot", slot(F.col("doc_id"), F.col("tie")))
    table = keyed.groupBy(F.floor(F.col("slot") / 64).alias(word)).agg(F.bit_or(bit(F.col("slot"))).alias(bits))
    own = slot(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")))
    marked = docs.withColumn(word, F.floor(own / 64)).join(F.broadcast(table), word, "left")  # 2^SLOT_BITS / 64 rows at most
    hit = F.coalesce(F.col(bits).bitwiseAND(bit(own)) != 0, F.lit(False))
    clear = marked.where(~hit).select(*docs.columns)
    same = F.col(i).eqNullSafe(F.col("doc_id").cast("long")) & (F.col(t) == F.xxhash64(F.col("text").cast("string")))
    met = marked.where(hit).join(suspects.toDF(i, t, drop), same, "left")
    again = met.where(~F.col(drop)).select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return clear.unionByName(met.where(F.col(drop).isNull()).select(*docs.columns)).unionByName(again)

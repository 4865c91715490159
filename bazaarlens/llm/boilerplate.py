"""Main text of web pages: mark-up first, then the suffixes of each host's pages decide what the mark-up leaves open.

The text of a page is a stream of words, its article and the rest two zones of it. Suffixes of all streams of a host are
ordered by a 64-bit hash of (host, zone, first RUN words): equal neighbours are the windows of repeated substrings. A longer
repeat is the union of its windows, so the order beyond RUN words is not needed. Equal streams count once.

Pages lie in packs of PACK_BYTES of text, as a table bucketed by pack, so that no text is shuffled. A pack sends its distinct
keys in order, with how many of its streams hold each, to the key's range (`_totals`); the range adds up what all packs
sent and answers each pack in the order it asked. A window travels once per pack, however many pages hold it, and keys
travel as differences. The first round sends only the first bits of every key, enough to tell nearly all windows that
do not repeat; what may repeat goes on with its whole key, is counted again, and then voted on.

A repeated window is boilerplate if PAGES different streams or more that hold it have enough text of their own beside
it, and these are half of its holders at least: pages that are copies of each other share their text, but it is not
boilerplate. A block that the mark-up leaves open goes if boilerplate covers it and it hangs on the head or the tail of its page, or is shared by a tenth
of the host; a block of links alone goes too. What an article holds always stays: passages that many articles quote are
not boilerplate. So windows of articles meet those of articles, and they count as repeated, but remove nothing."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.llm.markup import KEEP, OPEN, Block, blocks
from bazaarlens.llm.tables import small_batches
from bazaarlens.llm.urls import host_of
from bazaarlens.llm.words import ALNUM, column, mix, spans, text_bytes, words
from bazaarlens.session import cut_lineage, fresh_path

RUN = 6  # words
PAGES = 3
OWN = 0.25  # share of a stream's windows that is not repeated, for the stream to have text of its own
COVER = 0.8  # share of a block's words
HOST_SHARE = 0.1
PACK_BYTES = 7 << 20  # text of a pack, about
TABLE_ROWS = 2_000_000  # keys of a range, about
SPARE_BITS = 3  # of a key in the first round, beyond those that number all windows
_CUT = ""  # stands between the article and the rest of a stream: no window runs across it
_LETTERS = ALNUM | ((np.arange(256) >= 0x41) & (np.arange(256) <= 0x5A))  # before A-Z are lower-cased
_ODD, _HOST, _ARTICLE = (np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0xA0761D6478BD642F))

_PAGE = ("page_id long, url string, host binary, stream binary, kept boolean, "
         "rest array<struct<state:int,linked:boolean,text:string>>")
_PACK = "pack long, n_words long, streams array<binary>, pages binary"
_CANDIDATES = ("pack long, n_keys long, keys binary, counts binary, zones binary, places binary, page binary, which binary, "
               "hosts binary, votes binary, sizes binary")
_ANSWER = "pack long, part int, data binary"


def _rest(found: list[Block]) -> list[Block]:
    """The blocks of a page's stream, with an empty one wherever its article begins or ends."""
    out = []
    for b in found:
        if out and (out[-1].state == KEEP) != (b.state == KEEP):
            out.append(Block(_CUT, KEEP))
        out.append(b)
    return out


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (page_id, url, host, html): a row per page, whether it has an article, and the stream."""
    for b in batches:
        host_ids, streams, kept, ends, every = [], [], [], [0], []
        for page, url, host, html in zip(*(b.column(i).to_pylist() for i in range(4))):
            found = blocks(html)
            kept.append(any(x.state == KEEP for x in found))
            rest = _rest(found)
            name = hashlib.blake2b(f"{host}\n{kept[-1]}".encode("utf-8", "surrogatepass"), digest_size=16)
            for x in rest or [Block("", page, url)]:  # pages without a stream do not meet
                name.update(f"\n{x.state} {x.linked} {x.text}".encode("utf-8", "surrogatepass"))
            streams.append(name.digest())
            host_ids.append(hashlib.blake2b(host.encode("utf-8", "surrogatepass"), digest_size=16).digest())
            every += rest
            ends.append(len(every))
        block = pa.StructArray.from_arrays(
            [pa.array([x.state for x in every], pa.int32()), pa.array([x.linked for x in every], pa.bool_()),
             pa.array([x.text for x in every], pa.string())], ["state", "linked", "text"])
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(host_ids, pa.binary()), pa.array(streams, pa.binary()),
             pa.array(kept, pa.bool_()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), block)],
            ["page_id", "url", "host", "stream", "kept", "rest"])


def _rows(pages: DataFrame) -> DataFrame:
    small_batches(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        host_of(F.col("url").cast("string")).alias("host"), F.col("html").cast("string").alias("html"))


def _parsed(pages: DataFrame) -> DataFrame:
    """A row per page: whether it has an article, and the stream."""
    return _rows(pages).mapInArrow(_read, _PAGE)


def _squeezed(x: np.ndarray) -> bytes:
    """Numbers byte by byte, the lowest byte of all first, compressed: small numbers take little."""
    x = np.ascontiguousarray(x, "<u8")
    width = max(1, -(-int(x.max()).bit_length() // 8)) if len(x) else 1
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(bytes([width]) + planes)


def _numbers(data: bytes) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = int(flat[0])
    out = np.zeros(((len(flat) - 1) // width, 8), np.uint8)
    out[:, :width] = flat[1:].reshape(width, -1).T
    return out.view("<u8").ravel()


def _rising(x: np.ndarray) -> bytes:
    return _squeezed(np.diff(x.astype(np.uint64), prepend=np.uint64(0)))


def _risen(data: bytes) -> np.ndarray:
    return np.cumsum(_numbers(data), dtype=np.uint64)


def _one(schema: str, *values: object) -> pa.Table:
    """A row of a schema whose columns are long, binary or array<binary>."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary())}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table([pa.array([v], kinds[k]) for v, (_, k) in zip(values, fields)], [n for n, _ in fields])


def _bucketed(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table bucketed by pack: they need not move again when answers come back to them."""
    spark = df.sparkSession
    table, buckets = f"{name}_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    (df.write.format("parquet").bucketBy(buckets, "pack").option("path", fresh_path(spark, name)).saveAsTable(table))
    return spark.table(table)


def _packing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs of whole batches of pages."""
    first, n, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

    def row() -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        b = t.to_batches()[0]
        raw, bounds = text_bytes(pc.struct_field(pc.list_flatten(column(b, "rest")), "text"))
        n_words = len(spans(raw, bounds, _LETTERS)[0])
        sink = pa.BufferOutputStream()
        body = t.drop_columns(["stream"]).to_batches()[0]
        with pa.ipc.new_stream(sink, body.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as out:
            out.write_batch(body)
        return _one(_PACK, first + n, n_words, column(b, "stream").to_pylist(), sink.getvalue().to_pybytes()).to_batches()[0]

    for b in batches:
        if not b.num_rows:
            continue
        new = pc.sum(pc.binary_length(pc.struct_field(pc.list_flatten(column(b, "rest")), "text"))).as_py() or 0
        if held and size + new > PACK_BYTES:
            yield row()
            n, held, size = n + 1, [], 0
        held.append(b)
        size += new
    if held:
        yield row()


class _Pages:
    """The pages of a pack: their words' bounds by block, and the blocks' page, zone and stretch."""

    def __init__(self, pack: pa.Table) -> None:
        self.rows = pa.ipc.open_stream(pack["pages"][0].as_buffer()).read_all().combine_chunks().to_batches()[0]
        rest = column(self.rows, "rest")
        self.ends = rest.offsets.to_numpy() - rest.offsets[0].as_py()
        found = rest.flatten()
        self.texts = pc.struct_field(found, "text")
        self.linked = pc.struct_field(found, "linked").to_numpy(zero_copy_only=False)
        self.states = pc.struct_field(found, "state").to_numpy()
        self.page = np.repeat(np.arange(len(rest)), np.diff(self.ends))
        self.hosts = np.frombuffer(b"".join(x[:8] for x in column(self.rows, "host").to_pylist()), "<u8")
        self.kept = column(self.rows, "kept").to_numpy(zero_copy_only=False)

    def starts(self) -> np.ndarray:
        """Blocks at which a stretch begins that windows do not cross."""
        out = self.empty()
        out[self.ends[:-1][np.diff(self.ends) > 0]] = True
        return out

    def empty(self) -> np.ndarray:
        return pc.equal(pc.binary_length(self.texts), 0).to_numpy(zero_copy_only=False).copy()

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every window's key, the place of its first word among the pack's, and the block it begins in."""
        w = words(self.texts, ALNUM)
        codes, counts = w.hashes >> np.uint64(32), w.counts
        n = len(codes) - RUN + 1
        places = _places(self.starts(), counts)
        if not len(places):
            return np.empty(0, np.uint64), places, np.empty(0, np.int64)
        key = mix(np.repeat(self.hosts, np.diff(self.ends)) ^ np.where(self.states == KEEP, _ARTICLE, np.uint64(0)))
        key, pair = np.repeat(key, counts)[:n], (codes[:-1] << np.uint64(32)) | codes[1:]
        for k in range(0, RUN, 2):
            key = mix(key * _ODD + pair[k: k + n])
        return key[places], places, np.repeat(np.arange(len(counts)), counts)[places]


def _places(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """First words of the windows that stay inside a stretch of blocks; starts: whether a block begins one."""
    stretch = np.repeat(np.cumsum(starts), counts)
    return np.flatnonzero(stretch[: max(0, len(stretch) - RUN + 1)] == stretch[RUN - 1:])


def windows(texts: list[str], run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of `run` consecutive words of a stream that cross no cut, as rows of 32-bit word codes; the place of
    each among the stream's words; and where the words of every block begin (and the last end)."""
    w = words(pa.array(texts, pa.string()), ALNUM)
    codes = (w.hashes >> np.uint64(32)).astype(">u4")
    if len(codes) < run:
        return np.empty((0, run), ">u4"), np.empty(0, np.int64), w.bounds
    every = np.lib.stride_tricks.sliding_window_view(codes, run)
    stretch = np.repeat(np.cumsum([t == _CUT for t in texts]), w.counts)
    places = np.flatnonzero(stretch[: len(every)] == stretch[run - 1:])
    return every[places], places, w.bounds


def _requests(pack: int, keys: np.ndarray, counts: np.ndarray, bits: int, parts: int) -> pa.Table:
    """A pack's distinct keys of so many bits, in order, by range."""
    edges = np.array([(k << bits) // parts for k in range(1, parts)], np.uint64)
    at = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
    cuts = [(p, lo, hi) for p, (lo, hi) in enumerate(zip(at[:-1], at[1:])) if hi > lo]
    return pa.table({"pack": pa.array([pack] * len(cuts), pa.int64()), "part": pa.array([p for p, _, _ in cuts], pa.int32()),
                     "keys": pa.array([_rising(keys[lo:hi]) for _, lo, hi in cuts], pa.binary()),
                     "counts": pa.array([_squeezed(counts[lo:hi]) for _, lo, hi in cuts], pa.binary())})


_REQUEST = "pack long, part int, keys binary, counts binary"


def _totals(requests: DataFrame) -> DataFrame:
    """(pack, part, data): per request the sums of its keys over all packs, in the order asked; 0 for less than PAGES."""
    def add(t: pa.Table) -> pa.Table:
        keys = [_risen(x.as_py()) for x in t["keys"]]
        at = np.cumsum([0, *map(len, keys)])
        flat = np.concatenate(keys)
        del keys
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        del flat
        sums = np.add.reduceat(np.concatenate([_numbers(x.as_py()) for x in t["counts"]])[order], first)
        sums[sums < PAGES] = 0
        back = np.empty(len(order), np.uint64)
        back[order] = np.repeat(sums, np.diff(first, append=len(order)))
        return pa.table({"pack": t["pack"], "part": t["part"],
                         "data": pa.array([_squeezed(back[a:b]) for a, b in zip(at[:-1], at[1:])], pa.binary())})

    return requests.groupBy("part").applyInArrow(add, _ANSWER)


def _answered(t: pa.Table) -> np.ndarray:
    """The sums for all keys of a pack."""
    t = t.sort_by("part")
    return np.concatenate([np.empty(0, np.int64), *(_numbers(x.as_py()).astype(np.int64) for x in t["data"])])


def _firsts(packs: DataFrame) -> DataFrame:
    """(pack, firsts): the pages of a pack that are the first of their stream. A pack without one has no row."""
    every = packs.select("pack", F.posexplode("streams").alias("at", "stream"))
    first = every.groupBy("stream").agg(F.min(F.struct("pack", "at")).alias("first")).select("first.*")
    return first.groupBy("pack").agg(F.collect_list("at").alias("firsts"))


def _are_first(t: pa.Table, n: int) -> np.ndarray:
    out = np.zeros(n, bool)
    for x in t["firsts"].drop_null():
        out[x.values.to_numpy()] = True
    return out


def _candidates(packs: DataFrame) -> DataFrame:
    """A row per pack: the keys that may repeat, with how many of its streams hold each, and where; the keys of its hosts."""
    total = int(packs.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0])
    bits = min(64, max(1, total).bit_length() + SPARE_BITS)
    parts, shift = max(1, -(-total // TABLE_ROWS)), np.uint64(64 - bits)

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        p = _Pages(left)
        keys, _, block = p.keys()
        short, inverse = np.unique(keys >> shift, return_inverse=True)
        own = _are_first(right, len(p.kept))[p.page[block]]
        counts = np.minimum(np.bincount(inverse[own], minlength=len(short)), PAGES)
        return _requests(left["pack"][0].as_py(), short, counts, bits, parts)

    def choose(left: pa.Table, right: pa.Table) -> pa.Table:
        p = _Pages(left)
        keys, places, block = p.keys()
        page, first = p.page[block], _are_first(right, len(p.kept))
        _, inverse = np.unique(keys >> shift, return_inverse=True)
        sizes = np.zeros(len(p.kept), np.int64)
        open_ = (first & ~p.kept)[page]
        order = np.lexsort((keys[open_], page[open_]))
        a, b = keys[open_][order], page[open_][order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(a)]
        np.add.at(sizes, b[new], 1)
        may = (_answered(right.filter(pc.is_valid(right["data"]))) > 0)[inverse]
        places, page, block = places[may], page[may], block[may]
        hosts = mix(p.hosts + _HOST)
        every, at = np.unique(np.concatenate([keys[may], hosts]), return_inverse=True)
        which, hosts = at[: len(places)], at[len(places):]
        zones = np.full(len(every), 2)
        zones[which] = p.states[block] == KEEP
        held = np.unique((page * len(every) + which)[first[page]]) % len(every)
        counts = np.bincount(np.concatenate([held, hosts[first]]), minlength=len(every))
        votes = np.where(first, np.where(p.kept, 1, 2), 0)
        return _one(_CANDIDATES, left["pack"][0].as_py(), len(every), _rising(every), _squeezed(counts), _squeezed(zones),
                    _rising(places), _rising(page), _squeezed(which), _squeezed(hosts), _squeezed(votes), _squeezed(sizes))

    firsts = cut_lineage(_firsts(packs))
    asked = packs.groupBy("pack").cogroup(firsts.groupBy("pack")).applyInArrow(ask, _REQUEST)
    answers = _totals(asked).unionByName(firsts, allowMissingColumns=True)
    return _bucketed(packs.groupBy("pack").cogroup(answers.groupBy("pack")).applyInArrow(choose, _CANDIDATES), "candidates")


class _Candidates:
    def __init__(self, t: pa.Table) -> None:
        one = {c: t[c][0].as_py() for c in t.column_names}
        self.pack, self.keys, self.counts = one["pack"], _risen(one["keys"]), _numbers(one["counts"])
        self.zones = _numbers(one["zones"])  # of a key: 0 outside articles, 1 in articles, 2 a host
        self.places, self.page = (_risen(one[c]).astype(np.int64) for c in ("places", "page"))
        self.which, self.hosts = (_numbers(one[c]).astype(np.int64) for c in ("which", "hosts"))
        self.votes, self.sizes = _numbers(one["votes"]), _numbers(one["sizes"]).astype(np.int64)  # of a page

    def cast(self, holders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are repeated windows, and how many streams with text of their own hold each."""
        repeated = (holders > 0) & (self.zones < 2)
        hit = repeated[self.which] & (self.votes > 0)[self.page]
        page, key = np.divmod(np.unique(self.page[hit] * len(self.keys) + self.which[hit]), max(1, len(self.keys)))
        found = np.bincount(page, minlength=len(self.votes))
        own = (self.votes == 1) | ((self.votes == 2) & (self.sizes - found >= OWN * self.sizes))
        return repeated, np.bincount(key[own[page]], minlength=len(self.keys))


def _marks(packs: DataFrame) -> DataFrame:
    """(pack, some binary, common binary): places among a pack's words of the windows that are boilerplate or of articles,
    and of those that a tenth of their host's streams hold outside articles."""
    found = _candidates(packs)
    total = int(found.agg(F.coalesce(F.sum("n_keys"), F.lit(0))).first()[0])
    parts = max(1, -(-total // TABLE_ROWS))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                one = {c: column(b, c)[i].as_py() for c in ("pack", "keys", "counts")}
                yield from _requests(one["pack"], _risen(one["keys"]), _numbers(one["counts"]), 64, parts).to_batches()

    def vote(left: pa.Table, right: pa.Table) -> pa.Table:
        c = _Candidates(left)
        repeated, votes = c.cast(_answered(right))
        return _requests(c.pack, c.keys[repeated], votes[repeated], 64, parts)

    def mark(left: pa.Table, right: pa.Table) -> pa.Table:
        c = _Candidates(left)
        holders = _answered(right.filter(pc.equal(right["round"], 0)))
        repeated, votes = (holders > 0) & (c.zones < 2), np.zeros(len(holders), np.int64)
        votes[repeated] = _answered(right.filter(pc.equal(right["round"], 1)))
        chosen = (repeated & (votes >= PAGES) & (2 * votes >= holders))[c.which]
        common = chosen & (c.zones[c.which] == 0) & (holders[c.which] >= HOST_SHARE * holders[c.hosts[c.page]])
        return _one("pack long, some binary, common binary", c.pack, _rising(c.places[chosen]), _rising(c.places[common]))

    holders = cut_lineage(_totals(found.select("pack", "keys", "counts").mapInArrow(ask, _REQUEST)))
    votes = _totals(found.groupBy("pack").cogroup(holders.groupBy("pack")).applyInArrow(vote, _REQUEST))
    both = holders.withColumn("round", F.lit(0)).unionByName(votes.withColumn("round", F.lit(1)))
    return found.groupBy("pack").cogroup(both.groupBy("pack")).applyInArrow(mark, "pack long, some binary, common binary")


def boilerplate(parsed: DataFrame) -> DataFrame:
    """(stream, found array<struct<words binary, common boolean, article boolean>>): the repeated windows of every stream
    that has some, boilerplate or of articles. A window is common if a tenth of its host's streams hold it."""
    packs = _bucketed(parsed.mapInArrow(_packing, _PACK), "packs")

    def spell(left: pa.Table, right: pa.Table) -> pa.Table:
        p = _Pages(left)
        some, common = (_risen(right[c][0].as_py()).astype(np.int64) for c in ("some", "common"))
        w = words(p.texts, ALNUM)
        codes = (w.hashes >> np.uint64(32)).astype(">u4")
        block = np.repeat(np.arange(len(w.counts)), w.counts)
        found: dict[bytes, dict] = {}
        streams = left["streams"][0].as_py()
        for at, b, c in zip(some.tolist(), block[some].tolist(), np.isin(some, common).tolist()):
            article = bool(p.states[b] == KEEP)
            name = codes[at: at + RUN].tobytes()
            found.setdefault(streams[p.page[b]], {})[name, article] = {"words": name, "common": c, "article": article}
        kind = pa.list_(pa.struct([("words", pa.binary()), ("common", pa.bool_()), ("article", pa.bool_())]))
        return pa.table({"stream": pa.array(list(found), pa.binary()),
                         "found": pa.array([[*x.values()] for x in found.values()], kind)})

    return (packs.groupBy("pack").cogroup(_marks(packs).groupBy("pack"))
            .applyInArrow(spell, "stream binary, found array<struct<words:binary,common:boolean,article:boolean>>")
            .dropDuplicates(["stream"]))


def _mostly(marked: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Blocks that have words, COVER of them marked."""
    before = np.concatenate([[0], np.cumsum(marked)])
    sizes = np.diff(bounds)
    return (sizes > 0) & (np.diff(before[bounds]) >= COVER * sizes)


def _staying(open_: np.ndarray, linked: np.ndarray, covered: np.ndarray, everywhere: np.ndarray) -> np.ndarray:
    """Of a page's blocks, the open ones that stay."""
    gone = ~open_ | everywhere | linked
    loose = gone | covered
    edge = np.logical_and.accumulate(loose) | np.logical_and.accumulate(loose[::-1])[::-1]
    return ~gone & ~edge


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_repeated for every row of pages (page_id, url, html; other columns are not read).

    The text is the article's blocks in page order, joined by an empty line; empty if there is none, and for a null or
    empty html. n_repeated counts the words of the whole page in passages that it shares with others of its host: in the
    article those of other articles, outside it boilerplate. Urls that are null or name no host count as one host. Rows
    that repeat a page are rows of their own, with one text; repeated and very long pages are whole. An empty table gives an empty result."""
    packs = _bucketed(_rows(pages).mapInArrow(lambda batches: _packing(_read(batches)), _PACK), "packs")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        p = _Pages(left)
        raw, bounds = text_bytes(p.texts)
        starts, _, bounds = spans(raw, bounds, _LETTERS)
        marked = np.zeros((2, len(starts) + 1), np.int64)
        for k, c in enumerate(("some", "common")):
            at = _risen(right[c][0].as_py()).astype(np.int64)
            marked[k, at] += 1
            marked[k, at + RUN] -= 1
        some, common = marked.cumsum(axis=1)[:, :-1] > 0
        covered, everywhere = _mostly(some, bounds), _mostly(common, bounds)
        repeated = np.diff(np.concatenate([[0], np.cumsum(some)])[bounds[p.ends]])
        blocks_, out = p.texts.to_pylist(), []
        keep, open_ = (p.states == KEEP) & ~p.empty(), p.states == OPEN
        for kept, a, b in zip(p.kept.tolist(), p.ends[:-1].tolist(), p.ends[1:].tolist()):
            stays = keep[a:b] if kept else _staying(open_[a:b], p.linked[a:b], covered[a:b], everywhere[a:b])
            out.append("\n\n".join([blocks_[a + i] for i in np.flatnonzero(stays)]))
        return pa.table([column(p.rows, "page_id"), column(p.rows, "url"), pa.array(out, pa.string()),
                         pa.array([len(t) for t in out], pa.int64()), pa.array(repeated, pa.int64())],
                        ["page_id", "url", "text", "n_chars", "n_repeated"])

    return (packs.groupBy("pack").cogroup(_marks(packs).groupBy("pack"))
            .applyInArrow(run, "page_id long, url string, text string, n_chars long, n_repeated long"))

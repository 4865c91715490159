"""Albums from a live message stream: the batch rule as keyed state, flushed by arrival time.

A shard of senders is what one listener holds: its open albums, at most `max_open` of them. An album closes when a
message does not fit, when nothing has arrived for the idle time or the album is as old as the span allows (clock time
plus a grace, so a quiet chat closes its last album too), when a shard opens one too many (the album that has waited
longest goes), or when a flush marker arrives at shutdown. No message is dropped for being late: one older than what
its sender has closed already is taken like any other and also listed."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any, NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from bazaarlens.operators.sessions import AlbumRules

GRACE_MS = 5_000
MAX_OPEN = 50
FLUSH = "flush"
OUTPUT = ("record string, chat long, sender long, album_key long, n_messages int, n_images int, total_bytes long, "
          "first_ms long, last_ms long, usable boolean, keys array<long>")
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000
ROWS_OUT = 8192  # records that leave a shard together


@dataclass
class Album:
    """The open album of a sender. `ms` are message times, `seen` are arrival times."""
    first_ms: int
    last_ms: int
    first_seen: int
    last_seen: int
    images: int = 0
    bytes: int = 0
    usable: bool = False
    keys: dict[int, None] = field(default_factory=dict)  # in order of arrival


class Arrivals:
    """One shard's messages of one trigger in order of time, flush markers last. They are held as columns of some fifty
    bytes a message, however many there are; only the one at hand is an object."""

    def __init__(self, parts: Iterator[pd.DataFrame]):
        held: dict[str, list] = {c: [] for c in ("chat", "sender", "key", "ms", "bytes", "flush", "photo", "usable")}
        for part in parts:
            kind = part["kind"].to_numpy()
            photo, missing = np.asarray(kind == "image", bool), part["missing"].to_numpy()
            seen = ~missing if missing.dtype == bool else np.array([not x for x in missing], bool)
            for name, values in (("flush", np.asarray(kind == FLUSH, bool)), ("photo", photo), ("usable", photo & seen),
                                 *((c, part[c].to_numpy().copy()) for c in ("chat", "sender", "key", "ms", "bytes"))):
                held[name].append(values)
        self.columns = {c: np.concatenate(v) if v else np.empty(0) for c, v in held.items()}
        self.order = np.lexsort((self.columns["key"], self.columns["ms"], self.columns["flush"]))

    def __iter__(self) -> Iterator[Message]:
        names = Message._fields
        for i in self.order:
            yield Message(*[self.columns[c][i] for c in names])


class Message(NamedTuple):
    chat: Any
    sender: Any
    key: Any
    ms: Any
    bytes: Any
    flush: bool
    photo: bool
    usable: bool


class AlbumProcessor(StatefulProcessor):
    """The open albums of one shard."""

    def __init__(self, rules: AlbumRules, max_open: int, grace_ms: int):
        self.rules, self.max_open, self.grace_ms = rules, max_open, grace_ms
        self.idle_ms, self.span_ms = int(rules.idle_s * 1000), int(rules.span_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        who = "chat long, sender long"
        self.albums = handle.getMapState("albums", who, "first_ms long, last_ms long, first_seen long, last_seen long, "
                                                        "images int, bytes long, usable boolean, keys array<long>")
        self.closed_at = handle.getMapState("closed", who, "last_ms long", DAY_MS)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = int(timerValues.getCurrentProcessingTimeInMs())
        batch = Arrivals(rows)
        held, out, changed = self.load(), [], set()
        ended = {w: v[0] for w, v in ((tuple(w), v) for w, v in self.closed_at.iterator())}
        for m in batch:
            if len(out) >= ROWS_OUT:
                yield records(out)
                out = []
            if m.flush:
                for who in sorted(held):
                    out.append(self.end(who, held, ended, changed))
                break
            who, photo = (int(m.chat), int(m.sender)), bool(m.photo)
            album = held.get(who)
            if album and m.key in album.keys:
                continue
            if m.ms < ended.get(who, m.ms):
                out.append({"record": "late", "chat": who[0], "sender": who[1], "first_ms": int(m.ms), "keys": [int(m.key)]})
            if album and not self.joins(album, m, photo):
                out.append(self.end(who, held, ended, changed))
                album = None
            if album is None:
                if len(held) >= self.max_open:
                    oldest = min(held, key=lambda w: (held[w].last_seen, held[w].last_ms, w))
                    out.append(self.end(oldest, held, ended, changed))
                album = held[who] = Album(int(m.ms), int(m.ms), now, now)
            album.keys[int(m.key)] = None
            album.images += photo
            album.bytes += int(m.bytes) if photo else 0
            album.usable |= bool(m.usable)
            album.last_ms, album.last_seen = max(album.last_ms, int(m.ms)), now
            changed.add(who)
        self.store(held, ended, changed)
        if out:
            yield records(out)

    def joins(self, a: Album, m, photo: bool) -> bool:
        fits = m.ms - a.last_ms <= self.idle_ms and m.ms - a.first_ms <= self.span_ms
        return fits and (not photo or (a.images < self.rules.max_images and a.bytes + m.bytes <= self.rules.max_bytes))

    def due(self, a: Album) -> int:
        return min(a.last_seen + self.idle_ms, a.first_seen + self.span_ms) + self.grace_ms

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = int(timerValues.getCurrentProcessingTimeInMs())
        held, out, changed, ended = self.load(), [], set(), {}
        for who in sorted(w for w, a in held.items() if self.due(a) <= now):
            out.append(self.end(who, held, ended, changed))
        self.store(held, ended, changed)
        if out:
            yield records(out)

    def load(self) -> dict[tuple, Album]:
        return {tuple(w): Album(*v[:7], dict.fromkeys(v[7])) for w, v in self.albums.iterator()}

    def store(self, held: dict, ended: dict, changed: set) -> None:
        """Write what changed, and set the one timer of the shard to its next due album."""
        for who in changed:
            if who in held:
                a = held[who]
                self.albums.updateValue(who, (a.first_ms, a.last_ms, a.first_seen, a.last_seen, int(a.images), a.bytes,
                                              a.usable, list(a.keys)))
            elif self.albums.containsKey(who):
                self.albums.removeKey(who)
            if who in ended:
                self.closed_at.updateValue(who, (ended[who],))
        timers, wanted = list(self.handle.listTimers()), min((self.due(a) for a in held.values()), default=None)
        for t in timers:
            if t != wanted:
                self.handle.deleteTimer(t)
        if wanted is not None and wanted not in timers:
            self.handle.registerTimer(wanted)

    @staticmethod
    def end(who: tuple, held: dict, ended: dict, changed: set) -> dict:
        a = held.pop(who)
        ended[who] = max(ended.get(who, a.last_ms), a.last_ms)
        changed.add(who)
        return {"record": "album", "chat": who[0], "sender": who[1], "album_key": next(iter(a.keys)),
                "n_messages": len(a.keys), "n_images": int(a.images), "total_bytes": a.bytes, "first_ms": a.first_ms,
                "last_ms": a.last_ms, "usable": a.usable, "keys": list(a.keys)}


EMPTY = dict.fromkeys(c.split()[0] for c in OUTPUT.split(", "))


def records(out: list[dict]) -> pd.DataFrame:
    return pd.DataFrame([{**EMPTY, **r} for r in out])


def stream_albums(messages: DataFrame, rules: AlbumRules = AlbumRules(), shards: int = 64, max_open: int = MAX_OPEN,
                  grace_ms: int = GRACE_MS) -> DataFrame:
    """Records of a streaming DataFrame with chat, sender, key, ms, kind, bytes, missing: `album` for a closed album,
    `late` for a message behind what its sender had closed (counted there, and taken into an album all the same).

    Flush markers (`flush_markers`) close what is open. State is kept in RocksDB and checkpointed; closed times of a
    sender are forgotten a day after the last one."""
    shard = F.when(F.col("kind") == FLUSH, F.col("sender")).otherwise(F.pmod(F.xxhash64("chat", "sender"), F.lit(shards)))
    rows = messages.select(shard.cast("long").alias("shard"), "chat", "sender", "key", "ms", "kind", "bytes", "missing")
    return rows.groupBy("shard").transformWithStateInPandas(AlbumProcessor(rules, max_open, grace_ms), OUTPUT, "Append",
                                                            "ProcessingTime")


MARKERS = "chat long, sender long, key long, ms long, kind string, bytes long, missing boolean"


def flush_markers(spark: SparkSession, shards: int) -> DataFrame:
    """A marker per shard, in the columns of messages."""
    return spark.range(shards).select(
        F.lit(0).cast("long").alias("chat"), F.col("id").alias("sender"), F.lit(0).cast("long").alias("key"),
        F.lit(0).cast("long").alias("ms"), F.lit(FLUSH).alias("kind"), F.lit(0).cast("long").alias("bytes"),
        F.lit(False).alias("missing"))


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state with timers needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)

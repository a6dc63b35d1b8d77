"""Entries that say again what their scope was told lately: in a table, and on a stream.

An entry is dropped if one that was *kept* in the same scope ``hours`` before or less is near to it.
Whether an entry counts depends on all kept ones before, but only through the latest ``RECENT`` of them.  A table is
cut into parts of one or more scopes, or of a stretch of one, and all parts are read at once, each in the order of time;
a part is read again with the kept entries that the part before has ended with, until each has begun with what it
should have.  What is remembered soon no longer depends on where a part began, so a few rounds do; at worst, each round
settles one part more.
"""

from __future__ import annotations

import hashlib
import json
from bisect import insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import near_form
from ..operators.graph import ensure_checkpoint_dir

#: How far back entries are compared, when they go stale, how similar near texts are and from how many characters on
#: one may be part of the other, and how many of the latest kept ones are compared. Fixed values.
HOURS, STALE_DAYS, SIMILARITY, PART_CHARS, RECENT = 24, 7, 0.92, 30, 64


@dataclass(frozen=True)
class Entry:
    """A normal form at a time, with its words."""

    at: int
    form: str
    words: frozenset[str]

    @staticmethod
    def of(at: int, form: str) -> Entry:
        return Entry(at, form, frozenset(form.split(" ")))

    def near(self, other: Entry) -> bool:
        """Whether two entries say the same; an empty one is near to none."""
        a, b = sorted((self.form, other.form), key=len)
        if not a:
            return False
        if a == b or (len(a) >= PART_CHARS and a in b):
            return True
        few, many = sorted((len(self.words), len(other.words)))
        if few < SIMILARITY * many:
            return False
        shared = len(self.words & other.words)
        return shared >= SIMILARITY * (few + many - shared)


@dataclass
class Recent:
    """The latest kept entries of a scope, the oldest first; those of one time in the order they came in."""

    seconds: int
    kept: list[Entry] = field(default_factory=list)

    def admit(self, at: int, form: str) -> bool:
        """Keep an entry unless it repeats one; entries come in the order of time, or nearly so on a stream."""
        new = Entry.of(at, form)
        if any(abs(at - e.at) <= self.seconds and new.near(e) for e in reversed(self.kept)):
            return False
        insort(self.kept, new, key=lambda e: e.at)
        del self.kept[:-RECENT]
        return True

    def forget(self, now: int) -> None:
        self.kept = [e for e in self.kept if now - e.at <= self.seconds]


def _prepared(entries: DataFrame) -> DataFrame:
    return entries.select(F.coalesce("scope", F.lit("")).alias("scope"), F.unix_timestamp("ts").alias("at"), "ts", F.col("id").cast("long").alias("id"), F.coalesce(near_form(F.col("text")), F.lit("")).alias("form"))


#: What a part returns: its kept rows (place null), the entries it remembers at its end (from 0), and a digest of those as form (-1).
_ENTRY, _DIGEST = RECENT, -1
_OUT = "part int, first string, scope string, ts timestamp, id long, at long, form string, place int"


def _end(part: int, first: str, scope: str, recent: Recent, schema: pa.Schema) -> pa.RecordBatch:
    held = [(e.at, e.form) for e in recent.kept]
    digest = hashlib.sha256(json.dumps(held).encode()).hexdigest() if held else ""
    n = len(held) + 1
    columns = [[part] * n, [first] * n, [scope] * n, [None] * n, [None] * n, [None, *(at for at, _ in held)], [digest, *(form for _, form in held)], range(_DIGEST, n - 1)]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _keep(seconds: int):
    """Rows come sorted by part: what it begins with, then its entries in the order of time."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = first = scope = schema = None
        recent = Recent(seconds)
        for batch in batches:
            schema, kept = batch.schema, []
            for p, s, at, form, place in zip(*(batch.column(c).to_pylist() for c in ("part", "scope", "at", "form", "place")), strict=True):
                if p != part:
                    if part is not None:
                        yield _end(part, first, scope, recent, schema)
                    part, first, scope, recent = p, None, None, Recent(seconds)
                if place < _ENTRY:
                    scope = s
                    recent.kept.append(Entry.of(at, form))
                    kept.append(False)
                    continue
                first = s if first is None else first
                if s != scope:
                    scope, recent = s, Recent(seconds)
                if at is not None:
                    recent.forget(at)
                kept.append(at is None or recent.admit(at, form))
            own = batch.filter(pa.array(kept, pa.bool_()))
            for name in ("at", "form", "place"):
                at_column = schema.get_field_index(name)
                own = own.set_column(at_column, schema.field(name), pa.nulls(len(own), schema.field(name).type))
            yield own
        if part is not None:
            yield _end(part, first, scope, recent, schema)

    return rows


def first_in_window(entries: DataFrame, *, hours: int = HOURS, parts: int | None = None) -> DataFrame:
    """(scope, ts, id) of ``entries`` (scope, ts, id, text) that repeat no kept entry of the last ``hours``.

    Entries of one time go by id, then by text.  A null scope is the empty one, a null or wordless text repeats nothing,
    and an entry without a time is kept and compared with none.  ``parts`` (by default, as many as Spark makes of a
    shuffle) are ranges of scope, time and id.  The driver sees a digest for each part, no text.
    """
    spark = entries.sparkSession
    ensure_checkpoint_dir(spark)
    cut = ["scope", "at", "id"]
    prepared = _prepared(entries)
    ranges = prepared.repartitionByRange(parts, *cut) if parts else prepared.repartitionByRange(*cut)
    empty = F.lit(None).cast("string").alias("first")
    rows = ranges.select(F.spark_partition_id().alias("part"), empty, "scope", "ts", "id", "at", "form", F.lit(_ENTRY).alias("place")).checkpoint()

    def read(asked: DataFrame) -> DataFrame:
        return asked.repartition("part").sortWithinPartitions("part", "place", "scope", "at", "id", "form").mapInArrow(_keep(hours * 3600), _OUT)

    now, begun = read(rows).checkpoint(), {}
    while True:
        ends = sorted(now.where(F.col("place") == _DIGEST).select("part", "first", "scope", "form").collect())
        wanted = {q.part: (p.part, p.form if p.scope == q.first else "") for p, q in zip(ends, ends[1:], strict=False)}
        again = {q: (p, digest) for q, (p, digest) in wanted.items() if digest != begun.get(q, "")}
        if not again:
            return now.where("place is null").select("scope", "ts", "id")
        begun |= {q: digest for q, (_, digest) in again.items()}
        follows = F.broadcast(spark.createDataFrame([(p, q) for q, (p, digest) in again.items() if digest] or [(-1, -1)], "before int, next int"))
        starts = now.where("place >= 0").join(follows, F.col("part") == F.col("before")).select(F.col("next").alias("part"), *now.columns[1:])
        changed = F.col("part").isin(list(again))
        now = read(rows.where(changed).unionByName(starts)).unionByName(now.where(~changed)).checkpoint()


def fresh(entries: DataFrame, now: Column, *, days: int = STALE_DAYS) -> DataFrame:
    """``entries`` (ts and more) that are not yet stale."""
    return entries.where(F.unix_timestamp("ts") >= F.unix_timestamp(now) - days * 86400)


class _Window(StatefulProcessor):
    """State of a scope: its latest kept entries, forgotten by a timer once the window has passed."""

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", "at long, form string")

    def _load(self) -> Recent:
        return Recent(self.seconds, [Entry.of(int(r[0]), r[1]) for r in self.recent.get()])

    def _store(self, recent: Recent) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if recent.kept:
            self.recent.put([(e.at, e.form) for e in recent.kept])
            self.handle.registerTimer((recent.kept[0].at + self.seconds + 1) * 1000)
        else:
            self.recent.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        recent = self._load()
        for part in rows:
            part = part.sort_values(["at", "id", "form"], kind="stable")
            keep = [recent.admit(int(at), form) for at, form in zip(part["at"], part["form"], strict=True)]
            yield part[keep][["scope", "ts", "id"]]
        self._store(recent)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        recent = self._load()
        recent.forget(expiredTimerInfo.getExpiryTimeInMs() // 1000)
        self._store(recent)
        return iter([])

    def close(self) -> None:
        pass


#: The store that keyed state with timers needs.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def first_in_window_stream(entries: DataFrame, *, hours: int = HOURS, late: str = "1 hour") -> DataFrame:
    """``first_in_window`` of a stream: the session needs ``STATE_STORE``; entries later than ``late`` are dropped, and state is given up once the watermark has passed its window."""
    prepared = _prepared(entries).where("ts is not null").withWatermark("ts", late)
    return prepared.groupBy("scope").transformWithStateInPandas(_Window(hours * 3600), "scope string, ts timestamp, id long", "Append", "EventTime")

"""Near-duplicate signals as state of a place, with expiry by event-time timers; the batch form gives the same rows.

Time is that of the events. An entry lives MAX_AGE_S seconds after it was last mentioned; then it is timed out, by the next signal of its place or by the timer, whichever comes first, and its state is gone.
So what is kept for a place is what lives there, however many signals have passed.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Seconds since the last mention. Fixed value.
MAX_AGE_S = 3600
#: Characters that two longer descriptions must share at their start to be alike. Fixed value.
HEAD = 20
SCHEMA = "location string, signal_id string, ts timestamp, kind string, duplicate_of string"
#: The store that state variables and timers need: value of spark.sql.streaming.stateStore.providerClass.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_COLUMNS = ["location", "signal_id", "ts", "kind", "duplicate_of"]
_ENTRY = "signal_id string, description string, seen long"


def alike(a: str, b: str) -> bool:
    """Two descriptions in lower case: either holds the other, or both begin with the same HEAD characters; two empty ones are alike, one is not."""
    if not a or not b:
        return not a and not b
    return a in b or b in a or (len(a) >= HEAD and len(b) >= HEAD and a[:HEAD] == b[:HEAD])


class Place:
    """What lives at one place: (signal_id, description, last mention in microseconds), first come first. `step` and `expire` give rows of signal_id, microseconds, kind and duplicate_of."""

    def __init__(self, entries: list[tuple] = (), max_age_s: float = MAX_AGE_S):
        self.entries, self.age = list(entries), int(max_age_s * 1_000_000)

    def expire(self, until: int) -> list[tuple]:
        """Entries whose time ended at `until` or before."""
        gone = [e for e in self.entries if e[2] + self.age <= until]
        self.entries = [e for e in self.entries if e[2] + self.age > until]
        return [(i, seen + self.age, "timeout", None) for i, _, seen in gone]

    def step(self, at: int, signal_id: str | None, description: str | None) -> list[tuple]:
        out, text = self.expire(at), (description or "").lower()
        hit = next((k for k, (i, d, _) in enumerate(self.entries) if i == signal_id), None)
        kind = "again"
        if hit is None:
            hit, kind = next((k for k, (_, d, _) in enumerate(self.entries) if alike(text, d)), None), "duplicate"
        if hit is None:
            self.entries.append((signal_id, text, at))
            return [*out, (signal_id, at, "new", None)]
        known, kept, seen = self.entries[hit]
        self.entries[hit] = (known, kept, max(seen, at))
        return [*out, (signal_id, at, kind, known if kind == "duplicate" else None)]


def _keyed(events: DataFrame) -> DataFrame:
    """place: the location in lower case; a signal without one is a place by itself, as nothing is its duplicate."""
    low = F.lower(F.coalesce("location", F.lit("")))
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events.select(F.when(low == "", F.concat(F.lit("\0"), F.coalesce("signal_id", F.lit("")))).otherwise(low).alias("place"), "ts", "pos", "signal_id", "description").filter("ts is not null")


def _shown(place: str) -> str:
    return "" if place.startswith("\0") else place


def near_duplicates(events: DataFrame, until: datetime.datetime | None = None, *, max_age_s: float = MAX_AGE_S) -> DataFrame:
    """SCHEMA for every signal (signal_id, ts, pos, location, description), in order of ts, then pos: "new", "duplicate" of an older live one of its location, or "again" for a live id; and a "timeout" row at the end of each entry's time.

    Rows stream through a task in the order of their place; what is held is what lives at one place. `until`: when the last timeouts are looked for (None: not after a place's last signal). Null locations and
    descriptions are empty; events without a time are left out; the table may be empty.
    """
    rows = _keyed(events).withColumn("ts", F.unix_micros("ts")).repartition("place").sortWithinPartitions("place", "ts", "pos")
    end = None if until is None else int(until.replace(tzinfo=until.tzinfo or datetime.timezone.utc).timestamp() * 1_000_000)
    schema = pa.schema([("location", pa.string()), ("signal_id", pa.string()), ("us", pa.int64()), ("kind", pa.string()), ("duplicate_of", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, place = None, Place(max_age_s=max_age_s)
        for batch in batches:
            out = []
            for key, at, _, signal_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != name:
                    out += [(_shown(name), *r) for r in (place.expire(end) if end is not None and name is not None else [])]
                    name, place = key, Place(max_age_s=max_age_s)
                out += [(_shown(key), *r) for r in place.step(at, signal_id, text)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema) if out else pa.RecordBatch.from_pylist([], schema)
        last = [(_shown(name), *r) for r in place.expire(end)] if name is not None and end is not None else []
        if last:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*last, strict=True), schema, strict=True)], schema=schema)

    made = rows.mapInArrow(run, "location string, signal_id string, us long, kind string, duplicate_of string")
    return made.select("location", "signal_id", F.timestamp_micros("us").alias("ts"), "kind", "duplicate_of")


class DuplicateProcessor(StatefulProcessor):
    """State of a place: a list of its live entries, and a timer at the end of each one's time."""

    def __init__(self, max_age_s: float = MAX_AGE_S):
        self.max_age_s = max_age_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.live = handle.getListState("live", _ENTRY)

    def _place(self) -> Place:
        return Place([tuple(e) for e in self.live.get()] if self.live.exists() else [], self.max_age_s)

    def _keep(self, place: Place) -> None:
        if place.entries:
            self.live.put(place.entries)
        elif self.live.exists():
            self.live.clear()
        # timers are of milliseconds: the first one at or after the end
        wanted = {-(-(seen + place.age) // 1000) for _, _, seen in place.entries}
        set_ = set(self.handle.listTimers())
        for t in set_ - wanted:
            self.handle.deleteTimer(t)
        for t in wanted - set_:
            self.handle.registerTimer(t)

    def _frame(self, key: str, rows: list[tuple]) -> pd.DataFrame:
        made = [(_shown(key), i, datetime.datetime.fromtimestamp(us / 1e6, datetime.timezone.utc).replace(tzinfo=None), kind, of) for i, us, kind, of in rows]
        out = pd.DataFrame(made, columns=_COLUMNS)
        out["ts"] = pd.to_datetime(out["ts"])
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        place, out = self._place(), []
        pdf = pd.concat(list(rows)).sort_values(["us", "pos"])
        for at, signal_id, text in pdf[["us", "signal_id", "description"]].itertuples(index=False):
            out += place.step(int(at), signal_id, text)
        self._keep(place)
        yield self._frame(key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        place = self._place()
        out = place.expire(int(expiredTimerInfo.getExpiryTimeInMs()) * 1000)
        if place.entries:
            self.live.put(place.entries)
        elif self.live.exists():
            self.live.clear()
        yield self._frame(key[0], out)

    def close(self) -> None:
        pass


def near_duplicates_stream(events: DataFrame, late: str, *, max_age_s: float = MAX_AGE_S) -> DataFrame:
    """The streaming form of `near_duplicates`: signals within a batch go in order of ts and pos, timeouts come when the watermark (`late` behind) has passed an entry's end. Needs the session's state store to be PROVIDER."""
    rows = _keyed(events).withColumn("us", F.unix_micros("ts")).withWatermark("ts", late)
    return rows.groupBy("place").transformWithStateInPandas(DuplicateProcessor(max_age_s), outputStructType=SCHEMA, outputMode="Append", timeMode="EventTime")

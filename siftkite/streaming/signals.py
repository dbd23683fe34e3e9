"""Signals as keyed state over event time: creation, transitions with cooldown, terminal states, duplicates; batch and streaming forms share `Machine`.

Time is that of the events, never the wall clock.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The allowed transitions.
TRANSITIONS = {
    "NEW": ["CONFIRMED", "REJECTED", "REFINED", "UNCERTAIN"],
    "CONFIRMED": ["REJECTED", "UNCERTAIN"],
    "REFINED": ["CONFIRMED", "REJECTED", "UNCERTAIN"],
    "UNCERTAIN": ["CONFIRMED", "REJECTED"],
    "REJECTED": [],
}
COOLDOWN_S, MAX_CHANGES = 5.0, 15
SCHEMA = "signal_id string, ts timestamp, state string, accepted boolean, reason string, changes int"


def _seconds(ts: Column) -> Column:
    return ts.cast("timestamp").cast("double")


def valid(old: str, new: str) -> bool:
    return new in TRANSITIONS.get(old, [])


@dataclass
class Machine:
    """One signal's state. `step` gives (accepted, reason)."""

    state: str | None = None
    changed_at: float = 0.0
    changes: int = 0
    history: list = field(default_factory=list)

    def step(self, at: float, new: str) -> tuple[bool, str]:
        if self.state is None:
            self.state, self.changed_at = new, at
            return True, "created"
        if self.state == new:
            return False, "same"
        if not TRANSITIONS.get(self.state):
            return False, "terminal"
        if self.changes >= MAX_CHANGES:
            return False, "too many changes"
        if at - self.changed_at < COOLDOWN_S:
            return False, "cooldown"
        if not valid(self.state, new):
            return False, "not allowed"
        self.state, self.changed_at, self.changes = new, at, self.changes + 1
        return True, "changed"


def _rows(machine: Machine, pdf: pd.DataFrame, key: str) -> list[tuple]:
    out = []
    for ts, state in pdf[["ts", "state"]].itertuples(index=False):
        accepted, reason = machine.step(ts.timestamp(), state)
        out.append((key, ts, machine.state, accepted, reason, machine.changes))
    return out


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["signal_id", "ts", "state", "accepted", "reason", "changes"])


def replay(events: DataFrame) -> DataFrame:
    """The batch form: each signal's events (signal_id, ts, pos, state) in order of ts, then pos; one row for each, blocked ones too.

    A signal's events are one group: a signal is an item under review, of which the machine accepts MAX_CHANGES changes.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "pos"])
        return _frame(_rows(Machine(), pdf, pdf["signal_id"].iloc[0]))

    return events.select("signal_id", "ts", "pos", "state").groupBy("signal_id").applyInPandas(run, SCHEMA)


def stream(events: DataFrame) -> DataFrame:
    """The streaming form over (signal_id, ts, pos, state): state lives in the store between batches; within one, events go in order of ts."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine = Machine(*state.get) if state.exists else Machine()
        pdf = pd.concat(list(batches)).sort_values(["ts", "pos"])
        rows = _rows(machine, pdf, key[0])
        state.update((machine.state, machine.changed_at, machine.changes))
        yield _frame(rows)

    return events.select("signal_id", "ts", "pos", "state").groupBy("signal_id").applyInPandasWithState(run, SCHEMA, "state string, changed_at double, changes int", "append", GroupStateTimeout.NoTimeout)


def audit(events: DataFrame) -> DataFrame:
    """Each event with the state before it in its signal and whether the table allows that step; built-ins only."""
    w = Window.partitionBy("signal_id").orderBy("ts", "pos")
    rows = events.withColumn("before", F.lag("state").over(w)).withColumn("gap_s", _seconds(F.col("ts")) - _seconds(F.lag("ts").over(w)))
    pairs = F.array(*[F.lit(f"{a}>{b}") for a, bs in TRANSITIONS.items() for b in bs])
    return rows.select("signal_id", "pos", "before", "state", F.when(F.col("before").isNull(), True).otherwise(F.array_contains(pairs, F.concat_ws(">", "before", "state"))).alias("allowed"), (F.col("gap_s") < COOLDOWN_S).alias("cooling"))


def rate(events: DataFrame, seconds: int, limit: int, key: list[str]) -> DataFrame:
    """Events within the last `seconds` of each, itself included, by key, and whether they pass the limit."""
    w = Window.partitionBy(*key).orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("recent", F.count("*").over(w)).withColumn("limited", F.col("recent") > limit)


def rate_stream(events: DataFrame, seconds: int, late: str) -> DataFrame:
    """Counts by key in windows of `seconds`, late events up to `late`."""
    return events.withWatermark("ts", late).groupBy("signal_id", F.window("ts", f"{seconds} seconds")).count()


def first_seen_stream(events: DataFrame, late: str) -> DataFrame:
    """The first event of each (location, description) within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["location", "description"])


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """(signal_id, start, end, n): runs of events with gaps under `gap`."""
    return events.groupBy("signal_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("signal_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def expired(entries: DataFrame, now, ttl_s: float, *, size: str | None = None, ts: str = "ts") -> DataFrame:
    """Entries older than their time to live: half for small ones (under 10 KiB), double for large ones (over 1 MiB)."""
    ttl = F.lit(float(ttl_s))
    if size:
        ttl = F.when(F.col(size) < 10240, F.floor(ttl / 2)).when(F.col(size) > 1048576, ttl * 2).otherwise(ttl)
    return entries.filter(_seconds(now) - _seconds(F.col(ts)) > ttl)


def temperature(accesses: DataFrame, key: str, now, *, hits: int = 5, days: int = 30) -> DataFrame:
    """(key, n, last, kind): hot with enough hits and a recent one, cold with few and none recent, else warm."""
    out = accesses.groupBy(key).agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    idle = (_seconds(now) - _seconds(F.col("last"))) / 86400
    return out.withColumn("kind", F.when((F.col("n") < hits) & (idle > days), "cold").when((F.col("n") >= hits) & (idle < days), "hot").otherwise("warm"))

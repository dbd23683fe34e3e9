"""Distributed ranks and prefix sums: a global sort by ranges, running sums within each task, and what each range carries into the next.

The rows are sorted over all tasks; each task numbers and sums its own as they stream by. What the driver sees is one short row for each task: the totals of the group that is open at its end.
From these it makes what each task must add, and a second pass adds it. No window holds a group, so a group of any share of the rows is spread over as many tasks as the rows are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftkite.staging import stage


def prefix_sums(df: DataFrame, group: str | None, order: Sequence[str], sums: Sequence[str] = (), *, at: str = "at", drop: Sequence[str] = ()) -> DataFrame:
    """df with column `at`, a row's number from 0 within its group in the given order, and for each long column c of `sums` the column before_c: its sum over the group's earlier rows.

    Sums wrap around at 64 bits, so sums of hashes are hashes of sets. group: a long column without nulls, None for one group of all rows. Ties in `order` are numbered in any order, but once: the sorted
    rows are staged. Columns group, order and sums must exist; those of `drop` only sort. An empty table gives none.
    """
    nth = "_nth"
    keys = ([group] if group else []) + list(order)
    rows = df.withColumn(nth, F.monotonically_increasing_id()).repartitionByRange(*keys, nth).sortWithinPartitions(*keys, nth).drop(nth, *drop)
    columns = rows.columns
    made = [at, *[f"before_{c}" for c in sums], "_part", "_first"]
    where = [columns.index(c) for c in sums]
    grouped = columns.index(group) if group else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        carried, last, first, seen = np.zeros(1 + len(where), np.int64), None, None, False
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            of = np.asarray(batch.column(grouped)) if grouped is not None else np.zeros(n, np.int64)
            if not seen:
                first, last, seen = of[0], of[0], True
            values = np.vstack([np.ones(n, np.int64), *[np.asarray(batch.column(k)) for k in where]])
            with np.errstate(over="ignore"):
                before = np.cumsum(values, axis=1) - values
                starts = np.flatnonzero(np.concatenate([[of[0] != last], of[1:] != of[:-1]]))
                base = np.zeros((len(values), n), np.int64)
                base -= carried[:, None]
                if len(starts):  # a group's sums start at its first row
                    runs = np.diff(np.append(starts, n))
                    base[:, starts[0] :] = np.repeat(before[:, starts], runs, axis=1)
                out = before - base
                carried, last = out[:, -1] + values[:, -1], of[-1]
            extra = [pa.array(x) for x in out] + [pa.array(np.full(n, part, np.int32)), pa.array(of == first)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*columns, *made])

    types = ", ".join(f"{c} long" for c in made[:-2]) + ", _part int, _first boolean"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", " + types
    own = stage(rows.mapInArrow(run, schema), "sums")

    key = F.col(group) if group else F.lit(0)
    row = F.struct(key.alias("g"), *made[:-2], *[F.col(c).alias(f"own_{c}") for c in sums], "_first")
    # the last row of a task has the greatest number within the last group; groups ascend within a task
    ends = own.groupBy("_part").agg(F.max(row).alias("last"), F.min(key).alias("first")).select("_part", "first", "last.*").sort("_part").collect()
    carry, open_group, total = {}, None, np.zeros(1 + len(sums), np.int64)
    with np.errstate(over="ignore"):
        for e in ends:
            into = total if e["first"] == open_group else np.zeros_like(total)
            carry[e["_part"]] = into
            ended = np.array([e[at] + 1, *[np.int64(e[f"before_{c}"]) + np.int64(e[f"own_{c}"]) for c in sums]], np.int64)
            total = ended + into if e["_first"] else ended
            open_group = e["g"]

    spread = own.sparkSession.sparkContext.broadcast({p: c for p, c in carry.items() if c.any()})
    shown = [*columns, *made[:-2]]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, head = np.asarray(batch.column("_part")), np.asarray(batch.column("_first"))
            out = [batch.column(c) for c in shown]
            for part in np.unique(parts[head]).tolist():
                if (into := spread.value.get(part)) is not None:
                    hit = head & (parts == part)
                    for k in range(len(into)):
                        with np.errstate(over="ignore"):
                            out[len(columns) + k] = pa.array(np.where(hit, np.asarray(out[len(columns) + k]) + into[k], np.asarray(out[len(columns) + k])))
            yield pa.RecordBatch.from_arrays(out, names=shown)

    if not spread.value:
        return own.select(*shown)
    return own.mapInArrow(add, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.select(*shown).schema))

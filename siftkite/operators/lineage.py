"""As-of joins by counting, and the lineage of variables through them.

In one sort of both sides, the number of marks before a row is the number of the mark that it is looking for. So a lookup is a sort and an equi join, whatever share of the rows one key has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftkite.scan import prefix_sums
from siftkite.staging import stage

#: How far above a use an assignment is looked for, and the first line that is looked at. Fixed values.
REACH, FIRST_LINE = 48, 2
#: Lines that start a method. Fixed value.
METHOD = r"\b(public|private|protected)\s+\w+"


def as_of(rows: DataFrame, marks: DataFrame, by: Sequence[str], at: str, *, strict: bool = True) -> DataFrame:
    """rows, each with the other columns of the last mark of equal `by` before its `at` (or with strict=False at it), nulls where there is none; the mark's own `at` is column mark_at.

    Marks are unique in (by, at), else the result takes any of them. Rows and marks with a null in `by` or `at` meet nothing; all rows stay, repeated ones too.
    """
    rid = "_rid"
    rows = stage(rows.withColumn(rid, F.monotonically_increasing_id()), "rows")
    known = [*by, at]
    usable = lambda df: df.dropna(subset=known)
    held = stage(usable(marks), "marks")
    is_mark = lambda x: F.lit(x).cast("long").alias("_is")
    events = usable(rows).select(*known, F.lit(0 if strict else 1).alias("_tie"), is_mark(0), F.col(rid))
    events = events.unionByName(held.select(*known, F.lit(1 if strict else 0).alias("_tie"), is_mark(1), F.lit(None).cast("long").alias(rid)))
    # the marks' numbers follow from the same order, so their other columns need not come along
    numbers = prefix_sums(events, None, [*known, "_tie"], ["_is"], drop=["_tie", at, *by])
    asked = numbers.filter("_is = 0").select(rid, (F.col("before__is") - 1).alias("_n"))
    marked = prefix_sums(held, None, known, at="_n")
    side = marked.select("_n", *[F.col(c).alias(f"_mark_{c}") for c in by], F.col(at).alias("mark_at"), *[c for c in held.columns if c not in known])
    found = rows.join(asked, rid, "left").join(side, "_n", "left")
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_mark_{c}"))
    extra = [c for c in side.columns if c != "_n" and not c.startswith("_mark_")]
    return found.select(*[c for c in rows.columns if c != rid], *[F.when(same & F.col("_n").isNotNull(), F.col(c)).alias(c) for c in extra])


def method_starts(lines: DataFrame, text: Column) -> DataFrame:
    """(file, line) of the lines (file, line) whose text starts a method."""
    return lines.filter(text.rlike(METHOD)).select("file", "line").distinct()


def assignments(lines: DataFrame, text: Column) -> DataFrame:
    """(file, line, var, value, source) of every assignment in a line: what is written before and after the first = of each kind of name; source: the value if it is a name by itself, else null."""
    found = lines.select("file", "line", F.explode(F.regexp_extract_all(text, F.lit(r"(\w+)\s*="), F.lit(1))).alias("var"), F.trim(F.regexp_extract(text, r"\w+\s*=\s*(.+)", 1)).alias("value"))
    return found.select("file", "line", "var", "value", F.when(F.col("value").rlike(r"^\w+$"), F.col("value")).alias("source")).distinct()


def nearest_assignment(uses: DataFrame, given: DataFrame, boundaries: DataFrame | None = None, *, reach: int | None = REACH, strict: bool = True) -> DataFrame:
    """uses (file, line, var, ...) with the other columns of the nearest assignment (file, line, var, ...) above it, and its line as mark_at; nulls where there is none.

    The search ends at the first boundary (file, line) above the use, the boundary's own line included, and after `reach` lines or at FIRST_LINE; with reach None neither counts. strict=False also looks at the use's own line.
    """
    extra = [c for c in given.columns if c not in ("file", "line", "var")]
    if boundaries is not None:
        uses = as_of(uses, boundaries.select("file", "line").distinct(), ["file"], "line", strict=strict).withColumnRenamed("mark_at", "_scope")
    else:
        uses = uses.withColumn("_scope", F.lit(None).cast("long"))
    out = as_of(uses, given, ["file", "var"], "line", strict=strict)
    near = F.col("mark_at") >= F.coalesce("_scope", F.col("mark_at"))
    if reach is not None:
        near = near & (F.col("mark_at") >= F.greatest(F.col("line") - reach, F.lit(FIRST_LINE)))
    return out.select(*[c for c in uses.columns if c != "_scope"], *[F.when(near, F.col(c)).alias(c) for c in ("mark_at", *extra)])


def trace_origin(given: DataFrame, starts: DataFrame, boundaries: DataFrame | None = None, *, reach: int | None = REACH) -> DataFrame:
    """(file, line, var, hop, at, origin): from each use of a variable back to its nearest assignment, and on through plain copies, each time from the line reached, within the method that it is in.

    given: file, line, var, source (the variable that is copied, or null: the trace ends there), unique in its first three. Where each copy leads to is looked up once, for all of them; then tables of 2, 4, 8... hops at once are made
    from each other until no trace is that long. The traces are filled in from the widest hops down, so n hops take about 2 log2(n) joins, and no more rows are made than twice the result and these tables.
    """
    given = stage(given.select("file", "line", "var", "source"), "given")
    starts = starts.select("file", "line", "var").distinct()
    copies = given.filter("source is not null").select("file", "line", F.col("source").alias("var"))
    # uses and copies are looked up together, as what is above a name does not depend on which it is
    near = stage(nearest_assignment(starts.union(copies).distinct(), given, boundaries, reach=reach).filter("mark_at is not null"), "near")
    step = near.select(F.col("file").alias("_f"), F.col("line").alias("_l"), F.col("var").alias("_v"), F.col("mark_at").alias("_at"), F.col("source").alias("_origin"))
    found = near.join(starts, ["file", "line", "var"], "left_semi")
    out = stage(found, "first").select("file", "line", "var", F.lit(1).alias("hop"), F.col("mark_at").alias("at"), F.col("source").alias("origin"))
    hops = [step]
    while True:
        on = hops[-1].select(F.col("_f").alias("_g"), F.col("_l").alias("_m"), F.col("_v").alias("_w"), F.col("_at").alias("_to"), F.col("_origin").alias("_from"))
        ends = hops[-1].filter("_origin is not null")
        twice = ends.join(on, (F.col("_f") == F.col("_g")) & (F.col("_at") == F.col("_m")) & (F.col("_origin") == F.col("_w")))
        twice = stage(twice.select("_f", "_l", "_v", F.col("_to").alias("_at"), F.col("_from").alias("_origin")), "hops")
        if twice.isEmpty():
            break
        hops.append(twice)
    for k in reversed(range(len(hops))):
        more = out.filter("origin is not null").join(hops[k], (F.col("file") == F.col("_f")) & (F.col("at") == F.col("_l")) & (F.col("origin") == F.col("_v")))
        more = more.select("file", "line", "var", (F.col("hop") + 2**k).cast("int").alias("hop"), F.col("_at").alias("at"), F.col("_origin").alias("origin"))
        out = out.unionByName(stage(more, "traces"))
    return out

"""URL filters by a temporal list join, in DataFrame functions only.

A list's dated entries (pattern, date, action) become validity intervals: an entry holds from its date to the next date of its pattern. A capture is judged by the
entries that were active when it was fetched: of its host and the host's parent domains, the longest pattern active then decides. Captures are reduced to
distinct (host, fetched) pairs before the join, so a host with a third of all captures costs no more there than one row for each fetch time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftkite.llm.common import fresh

#: Ends an entry's interval without starting another.
LIFT = "lift"


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute URL, without user, port and a last dot; null if there is none. An address in brackets keeps them."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#\[]+)", 1))
    return F.nullif(F.regexp_replace(host, r"\.$", ""), F.lit(""))


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, action, since, until) of list entries (pattern, effective, seq, action); until is exclusive, null: without end.

    Of a pattern's entries on one date the one with the highest seq counts (equal seq: the greatest action by name). An entry with a null pattern, date or action has no effect. LIFT entries close
    intervals and open none.
    """
    entries = entries.filter(F.col("pattern").isNotNull() & F.col("effective").isNotNull() & F.col("action").isNotNull()).withColumn("pattern", F.lower("pattern"))
    # a pattern's dates: as many as the list was edited
    dated = entries.groupBy("pattern", "effective").agg(F.max(F.struct("seq", "action")).alias("last"))
    over = Window.partitionBy("pattern").orderBy("effective")
    spans = dated.select("pattern", F.col("last.action").alias("action"), F.col("effective").alias("since"), F.lead("effective").over(over).alias("until"))
    return spans.filter(F.col("action") != LIFT)


def suffixes(host: Column) -> Column:
    """The host and its parent domains, down to the last label; an address of four numbers or in brackets has none."""
    labels = F.when(host.rlike(r"^\[|^[0-9]+(\.[0-9]+){3}$"), F.array(host)).otherwise(F.split(host, r"\."))
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def judge(captures: DataFrame, entries: DataFrame, *, url_col: str = "url", time_col: str = "fetched", default: str = "none") -> DataFrame:
    """captures with host, pattern, action and since of the entry that decides; action is `default`, pattern and since null, where none is active.

    A null URL, one without a host and a null fetch time match no entry. Repeated captures are each judged, columns of captures stay, but for those of the four names,
    which are replaced. Empty captures give no rows, an empty list decides nothing.
    """
    captures = captures.drop("host", "pattern", "action", "since")
    host, at, hit = (fresh(captures, name) for name in ("_host", "_at", "_hit"))
    captures = captures.withColumn(host, host_of(F.col(url_col)))
    asked = captures.select(F.col(host).alias("host"), F.col(time_col).alias("at")).filter(F.col("host").isNotNull() & F.col("at").isNotNull()).distinct()
    tried = asked.withColumn("pattern", F.explode(suffixes(F.col("host"))))
    spans = intervals(entries)
    active = tried.join(spans, "pattern").filter((F.col("at") >= F.col("since")) & (F.col("until").isNull() | (F.col("at") < F.col("until"))))
    # at most one interval of a pattern holds at a time, so a pair's rows are at most its host's labels
    best = active.groupBy("host", "at").agg(F.max_by(F.struct("pattern", "action", "since"), F.length("pattern")).alias(hit))
    best = best.select(F.col("host").alias(host), F.col("at").alias(at), hit)
    out = captures.withColumn(at, F.col(time_col)).join(best, [host, at], "left")
    names = [c for c in captures.columns if c != host]
    return out.select(*names, F.col(host).alias("host"), F.col(hit)["pattern"].alias("pattern"), F.coalesce(F.col(hit)["action"], F.lit(default)).alias("action"), F.col(hit)["since"].alias("since"))

"""Writers: tables, audit records, reports as JSON, Markdown, HTML and SARIF, sessions. Writing is Spark's; reports render aggregates of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def append(df: DataFrame, path: str, *, partition: list[str] = ()) -> None:
    df.write.mode("append").partitionBy(*partition).parquet(path)


def refresh(df: DataFrame, path: str) -> DataFrame:
    """Rewrite a materialized result and read it back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def audited_write(df: DataFrame, path: str, audit: str, name: str, *, skipped=None) -> dict:
    """Append df to path and a row (etl_name, status, processed, skipped, error) to audit, whatever the outcome; a failure is raised again."""
    spark, seen = df.sparkSession, Observation(f"etl_{name}")
    skip = F.count_if(skipped) if skipped is not None else F.lit(0)
    row = {"etl_name": name, "status": "completed", "processed": 0, "skipped": 0, "error": None}
    try:
        df.observe(seen, F.count(F.lit(1)).alias("processed"), skip.alias("skipped")).write.mode("append").parquet(path)
        row |= seen.get
    except Exception as e:
        row |= {"status": "failed", "error": str(e)[:500]}
        raise
    finally:
        schema = "etl_name string, status string, processed long, skipped long, error string"
        spark.createDataFrame([tuple(row[c] for c in ("etl_name", "status", "processed", "skipped", "error"))], schema).write.mode("append").parquet(audit)
    return row


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def markdown(df: DataFrame, title: str) -> DataFrame:
    """(value): the lines of a table, the heading first; written as text from one partition, so for reports of bounded size."""
    head = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    cell = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\|", "\\\\|")
    rows = df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in df.columns]), F.lit(" |")).alias("value"))
    return df.sparkSession.createDataFrame([(x,) for x in head], "value string").coalesce(1).union(rows)


def html(df: DataFrame, title: str, limit: int) -> str:
    """A page with the first `limit` rows; a report's limit is its feature."""
    from html import escape

    rows = "".join("<tr>" + "".join(f"<td>{escape(str(v))}</td>" for v in r) + "</tr>" for r in df.limit(limit).collect())
    return f"<!DOCTYPE html><html><head><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1><table><tr>{''.join(f'<th>{escape(c)}</th>' for c in df.columns)}</tr>{rows}</table></body></html>"


def sarif_results(findings: DataFrame, keep: list[str] = ()) -> DataFrame:
    """(keep, result): each finding as a SARIF result in JSON, its fingerprint path:line:rule."""
    level = F.when(F.col("severity").isin("critical", "high"), "error").when(F.col("severity") == "medium", "warning").otherwise("note")
    where = F.struct(F.struct(F.struct(F.col("file_path").alias("uri")).alias("artifactLocation"), F.struct(F.greatest("line", F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation"))
    print_ = F.struct(F.concat_ws(":", "file_path", "line", "rule_id").alias("primary"))
    return findings.select(*keep, F.to_json(F.struct(F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(F.col("description").alias("text")).alias("message"), F.array(where).alias("locations"), print_.alias("fingerprints"))).alias("result"))


def sarif_rules(findings: DataFrame) -> DataFrame:
    """(rule): each rule as its first finding describes it."""
    first = findings.withColumn("_n", F.row_number().over(Window.partitionBy("rule_id").orderBy("pos"))).filter("_n = 1")
    return first.select(F.to_json(F.struct(F.col("rule_id").alias("id"), F.struct(F.col("description").alias("text")).alias("shortDescription"))).alias("rule"))

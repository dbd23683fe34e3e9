"""The vulnerability warehouse: summary view, product and version queries, details, statistics, upserts.

All tables are DataFrames with the columns of FIXTURES.md; nothing is collected. Limits come after a total order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftkite import staging
from siftkite.functions.versions import order_key
from siftkite.operators.intervals import stab
from siftkite.staging import stage, tasks_for


def cve_summary(cve: DataFrame, cvss: DataFrame, kev: DataFrame, exploit: DataFrame, poc: DataFrame, cve_cwe: DataFrame) -> DataFrame:
    """One row for each CVE: score, exploited flag, exploit and PoC counts, most stars and the sorted set of CWEs.

    The many-sides are aggregated by cve_id before the joins, so every join is one to at most one.
    """
    exploits = exploit.groupBy("cve_id").agg(F.count("*").alias("exploit_count"))
    pocs = poc.groupBy("cve_id").agg(F.count("*").alias("poc_count"), F.max("stars").alias("max_stars"))
    cwes = cve_cwe.groupBy("cve_id").agg(F.array_sort(F.collect_set("cwe_id")).alias("cwe_ids"))
    out = cve.join(cvss.select("cve_id", "score", "severity"), "cve_id", "left").join(kev.select("cve_id", F.col("exploited").alias("is_kev")), "cve_id", "left")
    out = out.join(exploits, "cve_id", "left").join(pocs, "cve_id", "left").join(cwes, "cve_id", "left")
    return out.select(
        "cve_id", "description", "score", "severity", "is_kev", F.coalesce("exploit_count", F.lit(0)).alias("exploit_count"), F.coalesce("poc_count", F.lit(0)).alias("poc_count"),
        F.coalesce("max_stars", F.lit(0)).alias("max_stars"), "cwe_ids",
    )


def find_exploitable(summary: DataFrame, min_score: float, limit: int) -> DataFrame:
    """Known exploited or with an exploit, at or above the score: known exploited first, then by score."""
    hit = summary.filter((F.col("score") >= min_score) & (F.coalesce("is_kev", F.lit(False)) | (F.col("exploit_count") > 0)))
    return hit.orderBy(F.col("is_kev").desc_nulls_last(), F.col("score").desc_nulls_last(), F.col("exploit_count").desc(), "cve_id").limit(limit)


def find_poc(summary: DataFrame, poc: DataFrame, min_score: float, min_stars: int, limit: int) -> DataFrame:
    """PoC repositories of CVEs at or above a score, most stars first."""
    rows = poc.filter(F.col("stars") >= min_stars).join(summary.filter(F.col("score") >= min_score).select("cve_id", "score"), "cve_id")
    return rows.orderBy(F.desc("stars"), "cve_id", "id").limit(limit)


def scan_product(cpe: DataFrame, cvss: DataFrame, kev: DataFrame, vendor: str, product: str, min_score: float, limit: int) -> DataFrame:
    """One row for each CPE of the product whose CVE reaches the score: known exploited first, then by score, then by id."""
    rows = cpe.filter((F.col("vendor") == vendor) & (F.col("product") == product)).join(cvss.filter(F.col("score") >= min_score).select("cve_id", "score", "severity"), "cve_id")
    rows = rows.join(kev.select("cve_id", "exploited"), "cve_id", "left")
    rows = rows.orderBy(F.col("exploited").desc_nulls_last(), F.col("score").desc_nulls_last(), "cve_id", "id").limit(limit)
    return rows.select("cve_id", "id", "vendor", "product", "score", "severity", "exploited")


def scan_product_version(cpe: DataFrame, targets: DataFrame, *, lexicographic: bool = False) -> DataFrame:
    """Distinct (vendor, product, version, cve_id) whose interval holds the target's version.

    By `stab`, on keys made once for each distinct row; empty bounds are none, bounds count by their type.
    """
    key = (lambda c: c) if lexicographic else order_key
    low, high = F.nullif(F.col("version_start"), F.lit("")), F.nullif(F.col("version_end"), F.lit(""))
    kinds = (F.col("version_start_type") != "excluding").alias("low_inclusive"), (F.col("version_end_type") == "including").alias("high_inclusive")
    ranges = cpe.select("vendor", "product", "cve_id", key(low).alias("low"), key(high).alias("high"), *kinds).distinct()
    asked = targets.select("vendor", "product", "version").distinct().withColumn("v", key(F.col("version")))
    hit = stage(stab(asked, ranges, ["vendor", "product"]).select("vendor", "product", "version", "cve_id"), "hits")
    return hit.repartition(tasks_for(hit), *hit.columns).distinct()


def cve_detail(cve: DataFrame, cvss: DataFrame, cve_cwe: DataFrame, cwe: DataFrame, exploit: DataFrame, poc: DataFrame) -> DataFrame:
    """Every CVE with its score, counts of exploits and PoCs, and sorted distinct CWE ids and names."""
    named = cve_cwe.join(cwe.select("cwe_id", "name"), "cwe_id", "left").groupBy("cve_id").agg(F.array_sort(F.collect_set("cwe_id")).alias("cwe_ids"), F.array_sort(F.collect_set("name")).alias("cwe_names"))
    count = lambda df, name: df.groupBy("cve_id").agg(F.count("*").alias(name))
    out = cve.join(cvss.select("cve_id", "score"), "cve_id", "left").join(named, "cve_id", "left").join(count(exploit, "exploits"), "cve_id", "left").join(count(poc, "pocs"), "cve_id", "left")
    return out.select("cve_id", "score", "cwe_ids", "cwe_names", F.coalesce("exploits", F.lit(0)).alias("exploits"), F.coalesce("pocs", F.lit(0)).alias("pocs"))


def exploits_of(exploit: DataFrame, cve_id: str) -> DataFrame:
    return exploit.filter(F.col("cve_id") == cve_id).orderBy(F.desc("verified"), "id")


def pocs_of(poc: DataFrame, cve_id: str) -> DataFrame:
    return poc.filter(F.col("cve_id") == cve_id).orderBy(F.desc("stars"), "id")


def search_vulnerabilities(cve: DataFrame, cvss: DataFrame, cve_cwe: DataFrame, *, cwe_id: str | None = None, severity: str | None = None, limit: int = 100) -> DataFrame:
    """CVEs with score and severity, best score first; a given cwe_id or severity filters, None doesn't."""
    out = cve.join(cvss.select("cve_id", "score", "severity"), "cve_id", "left")
    if cwe_id is not None:
        out = out.join(cve_cwe.filter(F.col("cwe_id") == cwe_id).select("cve_id"), "cve_id", "left_semi")
    if severity is not None:
        out = out.filter(F.upper("severity") == severity.upper())
    return out.select("cve_id", "description", "score", "severity").distinct().orderBy(F.col("score").desc_nulls_last(), "cve_id").limit(limit)


def cwe_with_cves(cwe: DataFrame, cve_cwe: DataFrame, cvss: DataFrame, top: int) -> DataFrame:
    """Each CWE with how many CVEs it has, their average, largest and least score (0 where none), and its best `top` CVEs in order.

    Pairs are dealt to as many tasks as they ask for, first by CVE, then by CWE; a CWE of more pairs than a task's rows goes in pieces.
    """
    links = stage(cve_cwe.select("cve_id", "cwe_id").filter("cwe_id is not null").distinct(), "links")
    tasks = tasks_for(links)
    counts = links.groupBy("cwe_id").agg(F.count("cve_id").alias("cves"), F.count("*").alias("_pairs"))
    large = counts.filter(F.col("_pairs") > staging.TASK_ROWS).select("cwe_id", F.lit(True).alias("_large"))  # few: all rows by TASK_ROWS at most
    scored = links.repartition(tasks, "cve_id").join(cvss.select("cve_id", "score"), "cve_id", "left").join(F.broadcast(large), "cwe_id", "left")
    scored = scored.withColumn("_piece", F.when(F.col("_large"), F.pmod(F.xxhash64("cve_id"), F.lit(tasks))).otherwise(0)).repartition(tasks, "cwe_id", "_piece")
    nth = F.row_number().over(Window.partitionBy("cwe_id", "_piece").orderBy(F.col("score").desc_nulls_last(), "cve_id"))
    place = F.struct(F.isnull("score").alias("none"), (~F.isnan("score")).alias("number"), (-F.col("score")).alias("rest"), "cve_id")
    pieces = scored.withColumn("_nth", nth).groupBy("cwe_id", "_piece").agg(F.sum("score").alias("total"), F.count("score").alias("n"), F.max("score").alias("most"), F.min("score").alias("least"), F.collect_list(F.when(F.col("_nth") <= top, place)).alias("best"))
    best = F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, top)
    stats = pieces.repartition(tasks, "cwe_id").groupBy("cwe_id").agg(F.try_divide(F.sum("total"), F.sum("n")).alias("avg_score"), F.max("most").alias("max_score"), F.min("least").alias("min_score"), F.transform(best, lambda x: x["cve_id"]).alias("top_cves"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    out = cwe.select("cwe_id", "name").join(counts, "cwe_id", "left").join(stats, "cwe_id", "left")
    return out.select("cwe_id", "name", F.coalesce("cves", F.lit(0)).alias("cves"), zero("avg_score"), zero("max_score"), zero("min_score"), "top_cves")


def cwe_scores(cve_cwe: DataFrame, cvss: DataFrame) -> DataFrame:
    """Each CWE of the links with the average, largest and least score of its links (0 where none), its CVEs and those of them with a score's row. A pair is put together where its CVE's scores are, so that only sums move."""
    rows = cve_cwe.join(cvss.select("cve_id", "score", F.lit(1).alias("there")), "cve_id", "left")
    pairs = rows.groupBy("cwe_id", "cve_id").agg(F.sum("score").alias("total"), F.count("score").alias("n"), F.max("score").alias("most"), F.min("score").alias("least"), F.max("there").alias("there"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    mean = F.try_divide(F.sum("total"), F.sum("n"))
    return pairs.groupBy("cwe_id").agg(zero(mean).alias("avg_score"), zero(F.max("most")).alias("max_score"), zero(F.min("least")).alias("min_score"), F.count("cve_id").alias("cves"), F.count("there").alias("scored"))


def keyword_cwes(cwe: DataFrame, keywords: list[str], limit: int) -> DataFrame:
    """CWEs by keyword: 3 for each keyword in the name, 1 for each in the description; confidence min(1, score / 6)."""
    hit = lambda col, k, n: F.when(F.contains(F.lower(col), F.lit(k.lower())), n).otherwise(0)
    score = reduce(lambda a, b: a + b, [hit("name", k, 3) + hit("description", k, 1) for k in keywords], F.lit(0))
    out = cwe.withColumn("match_score", score).filter("match_score > 0").orderBy(F.desc("match_score"), "cwe_id").limit(limit)
    return out.select("cwe_id", "name", "match_score", F.least(F.lit(1.0), F.col("match_score") / 6).alias("match_confidence"))


def library_cves(cwe: DataFrame, cve_cwe: DataFrame, cvss: DataFrame, keywords: list[str], *, cwes: int = 10, min_score: float = 0.0, limit: int = 50) -> DataFrame:
    """The CVEs of the CWEs that the keywords find, a null score counting 0, in the order of the CWEs' match and then of score."""
    found = keyword_cwes(cwe, keywords, cwes)
    rows = found.join(cve_cwe.select("cve_id", "cwe_id").distinct(), "cwe_id").join(cvss.select("cve_id", "score"), "cve_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return rows.filter(F.col("score") >= min_score).orderBy(F.desc("match_score"), "cwe_id", F.desc("score"), "cve_id").limit(limit).select("cwe_id", "cve_id", "score", "match_score")


def search_cves(cve: DataFrame, cvss: DataFrame, cve_cwe: DataFrame, *, prefix: str | None = None, cwe_id: str | None = None, min_score: float | None = None, max_score: float | None = None, since: str | None = None, until: str | None = None, tags: list[str] | None = None, tag_table: DataFrame | None = None, limit: int = 100) -> DataFrame:
    """Conjunction of the given filters; bounds are inclusive and 0 is a bound. Tags are any-of. Ordered by id."""
    out = cve.join(cvss.select("cve_id", "score"), "cve_id", "left")
    tests = [
        prefix is not None and F.col("cve_id").startswith(prefix or ""),
        min_score is not None and F.col("score") >= min_score,
        max_score is not None and F.col("score") <= max_score,
        since is not None and F.col("published_date") >= F.lit(since).cast("timestamp"),
        until is not None and F.col("published_date") <= F.lit(until).cast("timestamp"),
    ]
    for test in tests:
        if isinstance(test, Column):
            out = out.filter(test)
    if cwe_id is not None:
        out = out.join(cve_cwe.filter(F.col("cwe_id") == cwe_id), "cve_id", "left_semi")
    if tags and tag_table is not None:
        out = out.join(tag_table.filter(F.lower("tag").isin([t.lower() for t in tags])), "cve_id", "left_semi")
    return out.select("cve_id", "score", "published_date").orderBy("cve_id").limit(limit)


def fuzzy_search(rows: DataFrame, keywords: list[str], columns: list[str], score: str, date: str, key: str, limit: int) -> DataFrame:
    """Rows that hold the keywords, joined by blanks, in any of the columns whatever the case: best score first, then latest."""
    like = "%" + " ".join(keywords).replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
    hit = reduce(lambda a, b: a | b, [F.coalesce(F.col(c), F.lit("")).ilike(like) for c in columns])
    return rows.filter(hit).orderBy(F.col(score).desc_nulls_last(), F.col(date).desc_nulls_last(), key).limit(limit)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n) for each table."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], *, keep: list[str] = (), order: str | None = None) -> DataFrame:
    """`new` over `old` by key. Columns in `keep` stay as they are in old rows. Of several new rows of a key the last by `order` counts."""
    if order:
        new = new.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).filter("_n = 1").drop("_n")
    values = [c for c in old.columns if c not in keys]
    both = old.withColumn("_old", F.lit(True)).alias("o").join(new.withColumn("_new", F.lit(True)).alias("n"), keys, "full_outer")
    pick = lambda c: F.when(F.col("_new").isNull() | (F.col("_old").isNotNull() & F.lit(c in keep)), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c)
    return both.select(*keys, *[pick(c) for c in values]).select(*old.columns)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of `new` whose key is not there yet are added, of several the first by `order`."""
    first = new.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("_n = 1").drop("_n")
    return old.unionByName(first.join(old.select(*keys), keys, "left_anti").select(*old.columns))


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """All child rows of the parents in `new` are replaced by the distinct rows of `new`."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new.distinct())


def cascade_delete(tables: dict[str, DataFrame], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    return {name: df.join(gone.select(key), key, "left_anti") for name, df in tables.items()}


def graph_of(cve_cwe: DataFrame, cpe: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, kind) and edges (src, dst, type), each once, of CVEs, CWEs and products."""
    product = F.concat_ws(":", "vendor", "product")
    nodes = cve_cwe.select(F.col("cve_id").alias("id"), F.lit("CVE").alias("kind")).union(cve_cwe.select("cwe_id", F.lit("CWE"))).union(cpe.select("cve_id", F.lit("CVE"))).union(cpe.select(product, F.lit("Product")))
    edges = cve_cwe.select(F.col("cve_id").alias("src"), F.col("cwe_id").alias("dst"), F.lit("BELONGS_TO").alias("type")).union(cpe.select("cve_id", product, F.lit("AFFECTS")))
    return nodes.distinct(), edges.distinct()


def attack_chains(edges: DataFrame, first: str, second: str, ends: list[str], limit: int) -> DataFrame:
    """Two hops: a -first-> sink <-second- b for the sinks in `ends`, the first `limit` by source, sink and cve.

    Of each sink only the first `limit` sources and cves can be among them, so no more meet.
    """
    near = lambda df, c: df.distinct().withColumn("_n", F.row_number().over(Window.partitionBy("sink").orderBy(c))).filter(F.col("_n") <= limit).drop("_n")
    of = lambda kind, c: near(edges.filter((F.col("type") == kind) & F.col("dst").isin(ends)).select(F.col("src").alias(c), F.col("dst").alias("sink")), c)
    return of(first, "source").join(of(second, "cve"), "sink").select("source", "sink", "cve").orderBy("source", "sink", "cve").limit(limit)


def graph_context(edges: DataFrame) -> DataFrame:
    """(id, type, neighbours): each node's sorted distinct neighbours by edge type."""
    return edges.groupBy(F.col("src").alias("id"), "type").agg(F.array_sort(F.collect_set("dst")).alias("neighbours"))


def change_sets(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): removed, added, changed (newer or another size, and another hash) or unchanged, of indexes (path, hash, mtime, size)."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col("o.path") == F.col("n.path"), "full_outer")
    touched = (F.col("n.mtime") > F.col("o.mtime")) | (F.col("n.size") != F.col("o.size"))
    kind = F.when(F.col("n.path").isNull(), "removed").when(F.col("o.path").isNull(), "added").when(touched & (F.col("n.hash") != F.col("o.hash")), "changed").otherwise("unchanged")
    return both.select(F.coalesce("n.path", "o.path").alias("path"), kind.alias("change"))


def unified(parts: dict[str, DataFrame]) -> DataFrame:
    """UNION ALL of sources with a column that names the source; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("source", F.lit(name)) for name, df in parts.items()])

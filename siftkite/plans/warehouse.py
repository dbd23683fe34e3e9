"""Queries of the vulnerability warehouse."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftkite.functions import versions as V
from siftkite.operators import intervals as I
from siftkite.operators import warehouse as W
from siftkite.plans.registry import query
from siftkite.plans.roles import TABLES

_SUMMARY = """
summary as (
    select c.cve_id, c.description, s.score, s.severity, k.exploited as is_kev,
        coalesce(e.n, 0) as exploit_count, coalesce(p.n, 0) as poc_count, coalesce(p.m, 0) as max_stars, w.cwe_ids
    from cve c left join cvss s on s.cve_id = c.cve_id left join kev k on k.cve_id = c.cve_id
    left join (select cve_id, count(*) n from exploit group by 1) e on e.cve_id = c.cve_id
    left join (select cve_id, count(*) n, max(stars) m from poc group by 1) p on p.cve_id = c.cve_id
    left join (select cve_id, list_sort(list_distinct(list(cwe_id))) cwe_ids from cve_cwe group by 1) w on w.cve_id = c.cve_id)
"""


def _summary(t):
    return W.cve_summary(t.cve, t.cvss, t.kev, t.exploit, t.poc, t.cve_cwe)


@query("cve_summary", f"with {_SUMMARY} select * from summary")
def _(t):
    return _summary(t)


@query("find_exploitable", f"with {_SUMMARY} select * from summary where score >= 5 and (coalesce(is_kev, false) or exploit_count > 0) order by is_kev desc nulls last, score desc nulls last, exploit_count desc, cve_id limit 50")
def _(t):
    return W.find_exploitable(_summary(t), 5.0, 50)


@query("find_poc", "select p.id, p.cve_id, p.repo_url, p.stars, p.language, s.score from poc p join cvss s on s.cve_id = p.cve_id where s.score >= 6 and p.stars >= 20 order by p.stars desc, p.cve_id, p.id limit 40")
def _(t):
    return W.find_poc(_summary(t), t.poc, 6.0, 20, 40)


@query("scan_product", "select c.cve_id, c.id, c.vendor, c.product, s.score, s.severity, k.exploited from cpe c join cvss s on s.cve_id = c.cve_id left join kev k on k.cve_id = c.cve_id where c.vendor = 'vendor3' and c.product = 'product7' and s.score >= 4 order by k.exploited desc nulls last, s.score desc nulls last, c.cve_id, c.id limit 30")
def _(t):
    return W.scan_product(t.cpe, t.cvss, t.kev, "vendor3", "product7", 4.0, 30)


_KEY = "(list_concat(list_transform(list_filter(string_split({0}, '.'), lambda x: x <> ''), lambda x: x::bigint), [0,0,0,0,0,0,0,0]::bigint[]))[1:8]"
_TARGETS = "targets as (select distinct vendor, product, cast(id % 5 as varchar) || '.1' as version from cpe)"


@query(
    "scan_product_version",
    f"""with {_TARGETS} select distinct c.vendor, c.product, t.version, c.cve_id from cpe c join targets t on c.vendor = t.vendor and c.product = t.product
    where (nullif(c.version_start, '') is null or case when c.version_start_type <> 'excluding' then {_KEY.format("t.version")} >= {_KEY.format("c.version_start")} else {_KEY.format("t.version")} > {_KEY.format("c.version_start")} end)
    and (nullif(c.version_end, '') is null or case when c.version_end_type = 'including' then {_KEY.format("t.version")} <= {_KEY.format("c.version_end")} else {_KEY.format("t.version")} < {_KEY.format("c.version_end")} end)""",
)
def _(t):
    version = F.concat_ws(".", (F.col("id") % 5).cast("string"), F.lit("1"))
    return W.scan_product_version(t.cpe, t.cpe.select("vendor", "product", version.alias("version")).distinct())


@query(
    "scan_product_version_text",
    f"""with {_TARGETS} select distinct c.vendor, c.product, t.version, c.cve_id from cpe c join targets t on c.vendor = t.vendor and c.product = t.product
    where (nullif(c.version_start, '') is null or (c.version_start_type <> 'excluding' and t.version >= c.version_start) or t.version > c.version_start)
    and (nullif(c.version_end, '') is null or (c.version_end_type = 'including' and t.version <= c.version_end) or t.version < c.version_end)""",
)
def _(t):
    version = F.concat_ws(".", (F.col("id") % 5).cast("string"), F.lit("1"))
    return W.scan_product_version(t.cpe, t.cpe.select("vendor", "product", version.alias("version")).distinct(), lexicographic=True)


@query(
    "cve_detail",
    """select c.cve_id, s.score, w.cwe_ids, w.cwe_names, coalesce(e.n, 0) as exploits, coalesce(p.n, 0) as pocs from cve c left join cvss s on s.cve_id = c.cve_id
    left join (select cve_id, list_sort(list_distinct(list(b.cwe_id))) cwe_ids, list_sort(list_distinct(coalesce(list(w.name) filter (w.name is not null), []))) cwe_names from cve_cwe b left join cwe w on w.cwe_id = b.cwe_id group by 1) w on w.cve_id = c.cve_id
    left join (select cve_id, count(*) n from exploit group by 1) e on e.cve_id = c.cve_id left join (select cve_id, count(*) n from poc group by 1) p on p.cve_id = c.cve_id""",
)
def _(t):
    return W.cve_detail(t.cve, t.cvss, t.cve_cwe, t.cwe, t.exploit, t.poc)


@query("exploits_of", "select * from exploit where cve_id = 'CVE-2020-1000007'")
def _(t):
    return W.exploits_of(t.exploit, "CVE-2020-1000007")


@query("pocs_of", "select * from poc where cve_id = 'CVE-2020-1000007'")
def _(t):
    return W.pocs_of(t.poc, "CVE-2020-1000007")


@query("search_vulnerabilities", "select distinct c.cve_id, c.description, s.score, s.severity from cve c left join cvss s on s.cve_id = c.cve_id where c.cve_id in (select cve_id from cve_cwe where cwe_id = 'CWE-7') and upper(s.severity) = 'HIGH' order by s.score desc nulls last, c.cve_id limit 60")
def _(t):
    return W.search_vulnerabilities(t.cve, t.cvss, t.cve_cwe, cwe_id="CWE-7", severity="high", limit=60)


@query(
    "cwe_with_cves",
    """with scored as (select b.cwe_id, b.cve_id, s.score, row_number() over (partition by b.cwe_id order by s.score desc nulls last, b.cve_id) nth from (select distinct cve_id, cwe_id from cve_cwe) b left join cvss s on s.cve_id = b.cve_id)
    select w.cwe_id, w.name, count(distinct cve_id) as cves, coalesce(avg(score), 0) as avg_score, coalesce(max(score), 0) as max_score, coalesce(min(score), 0) as min_score, list(cve_id order by nth) filter (nth <= 3) as top_cves
    from cwe w left join scored s on s.cwe_id = w.cwe_id group by 1, 2""",
)
def _(t):
    return W.cwe_with_cves(t.cwe, t.cve_cwe, t.cvss, 3)


_MATCH = "m as (select cwe_id, name, (case when contains(lower(name), 'red') then 3 else 0 end) + (case when contains(lower(description), 'red') then 1 else 0 end) + (case when contains(lower(name), 'bolt') then 3 else 0 end) + (case when contains(lower(description), 'bolt') then 1 else 0 end) as match_score from cwe)"


@query("keyword_cwes", f"with {_MATCH} select cwe_id, name, match_score, least(1.0::double, match_score / 6) as match_confidence from m where match_score > 0 order by match_score desc, cwe_id limit 10")
def _(t):
    return W.keyword_cwes(t.cwe, ["red", "Bolt"], 10)


@query("library_cves", f"with {_MATCH}, top as (select * from m where match_score > 0 order by match_score desc, cwe_id limit 10) select t.cwe_id, b.cve_id, coalesce(s.score, 0) as score, t.match_score from top t join (select distinct cve_id, cwe_id from cve_cwe) b on b.cwe_id = t.cwe_id left join cvss s on s.cve_id = b.cve_id where coalesce(s.score, 0) >= 3 order by t.match_score desc, t.cwe_id, coalesce(s.score, 0) desc, b.cve_id limit 50")
def _(t):
    return W.library_cves(t.cwe, t.cve_cwe, t.cvss, ["red", "bolt"], min_score=3.0)


@query(
    "search_cves",
    """select c.cve_id, s.score, c.published_date from cve c left join cvss s on s.cve_id = c.cve_id where c.cve_id like 'CVE-2020-10%' and s.score >= 0 and s.score <= 8 and c.published_date >= timestamp '1995-01-01' and c.published_date <= timestamp '1999-01-01'
    and c.cve_id in (select cve_id from cve_cwe where cwe_id = 'CWE-5') and c.cve_id in (select cve_id from exploit where lower(platform) in ('a', 'r')) order by c.cve_id limit 100""",
)
def _(t):
    tags = t.exploit.select("cve_id", F.col("platform").alias("tag"))
    return W.search_cves(t.cve, t.cvss, t.cve_cwe, prefix="CVE-2020-10", cwe_id="CWE-5", min_score=0.0, max_score=8.0, since="1995-01-01", until="1999-01-01", tags=["A", "R"], tag_table=tags)


@query("fuzzy_search", "select c.cve_id, c.description, s.score, c.published_date from cve c left join cvss s on s.cve_id = c.cve_id where c.description ilike '%priority 1-urgent%' order by s.score desc nulls last, c.published_date desc nulls last, c.cve_id limit 25")
def _(t):
    rows = t.cve.join(t.cvss.select("cve_id", "score"), "cve_id", "left").select("cve_id", "description", "score", "published_date")
    return W.fuzzy_search(rows, ["PRIORITY", "1-urgent"], ["description"], "score", "published_date", "cve_id", 25)


@query("severity_top", "select cve_id, score from cvss where upper(severity) = 'CRITICAL' order by score desc, cve_id limit 20")
def _(t):
    return t.cvss.filter(F.upper("severity") == "CRITICAL").orderBy(F.col("score").desc_nulls_last(), "cve_id").limit(20).select("cve_id", "score")


@query("cwe_scores", "select b.cwe_id, coalesce(avg(s.score), 0) as avg_score, coalesce(max(s.score), 0) as max_score, coalesce(min(s.score), 0) as min_score, count(distinct b.cve_id) as cves, count(distinct s.cve_id) as scored from cve_cwe b left join cvss s on s.cve_id = b.cve_id group by 1")
def _(t):
    return W.cwe_scores(t.cve_cwe, t.cvss)


@query("table_counts", " union all ".join(f"select '{x}' as table_name, count(*) as n from {x}" for x in TABLES))
def _(t):
    return W.table_counts({x: getattr(t, x) for x in TABLES})


@query("cwe_ids", "select distinct cwe_id from cve_cwe order by 1")
def _(t):
    return t.cve_cwe.select("cwe_id").distinct().orderBy("cwe_id")


@query(
    "upsert_cve",
    """with new as (select cve_id, 'new ' || description as description, published_date + interval 5 day as published_date, last_modified + interval 9 day as last_modified from cve where description like 'F %' union all select cve_id || 'x', 'added', published_date, last_modified from cve where description like 'P %')
    select coalesce(o.cve_id, n.cve_id) as cve_id, coalesce(n.description, o.description) as description, coalesce(o.published_date, n.published_date) as published_date, coalesce(n.last_modified, o.last_modified) as last_modified from cve o full join new n on n.cve_id = o.cve_id""",
)
def _(t):
    days = lambda c, n: (F.col(c) + F.expr(f"interval {n} days")).alias(c)
    seven = t.cve.filter("description like 'F %'").select("cve_id", F.concat(F.lit("new "), "description").alias("description"), days("published_date", 5), days("last_modified", 9))
    added = t.cve.filter("description like 'P %'").select(F.concat("cve_id", F.lit("x")).alias("cve_id"), F.lit("added").alias("description"), "published_date", "last_modified")
    return W.upsert(t.cve, seven.union(added), ["cve_id"], keep=["published_date"])


@query("insert_ignore", "select cve_id, min(l) as platform from (select cve_id, 'old' as l from kev) group by 1 union all select cve_id, arg_min(platform, id) from exploit where cve_id not in (select cve_id from kev) group by 1")
def _(t):
    old = t.kev.select("cve_id", F.lit("old").alias("platform"), F.lit(0).cast("long").alias("id"))
    return W.insert_ignore(old, t.exploit.select("cve_id", "platform", "id"), ["cve_id"], "id").select("cve_id", "platform")


@query("replace_children", "select cve_id, repo_url from poc where cve_id not in (select cve_id from exploit) union all select distinct cve_id, 'from exploits' from exploit")
def _(t):
    return W.replace_children(t.poc.select("cve_id", "repo_url"), t.exploit.select("cve_id", F.lit("from exploits").alias("repo_url")), "cve_id")


@query("cascade_delete", "select 'cvss' as name, count(*) as n from cvss where cve_id not in (select cve_id from kev) union all select 'poc', count(*) from poc where cve_id not in (select cve_id from kev)")
def _(t):
    return W.table_counts(W.cascade_delete({"cvss": t.cvss, "poc": t.poc}, t.kev, "cve_id")).withColumnRenamed("table_name", "name")


@query("graph_nodes", "select cve_id as id, 'CVE' as kind from cve_cwe union select cwe_id, 'CWE' from cve_cwe union select cve_id, 'CVE' from cpe union select vendor || ':' || product, 'Product' from cpe")
def _(t):
    return W.graph_of(t.cve_cwe, t.cpe)[0]


@query("graph_context", "select src as id, type, list_sort(list(dst)) as neighbours from (select cve_id as src, cwe_id as dst, 'BELONGS_TO' as type from cve_cwe union select cve_id, vendor || ':' || product, 'AFFECTS' from cpe) group by 1, 2")
def _(t):
    return W.graph_context(W.graph_of(t.cve_cwe, t.cpe)[1])


@query("attack_chains", "with e as (select distinct cve_id as src, cwe_id as dst from cve_cwe), f as (select distinct cve_id as src, vendor || ':' || product as dst from cpe), k as (select distinct k.cve_id as src, p.dst from kev k join f p on p.src = k.cve_id) select k.src as source, k.dst as sink, f.src as cve from k join f on f.dst = k.dst where k.dst in ('vendor1:product1', 'vendor3:product7', 'vendor11:product21') order by 1, 2, 3 limit 10")
def _(t):
    _, edges = W.graph_of(t.cve_cwe, t.cpe)
    affects = edges.filter("type = 'AFFECTS'")
    both = affects.join(t.kev.select(F.col("cve_id").alias("src")), "src", "left_semi").withColumn("type", F.lit("TRIGGERS")).union(affects.withColumn("type", F.lit("HAS_SINK")))
    return W.attack_chains(both.select("src", "dst", "type"), "TRIGGERS", "HAS_SINK", ["vendor1:product1", "vendor3:product7", "vendor11:product21"], 10)


@query(
    "change_sets",
    """with o as (select path, sha256(content) as hash, size as mtime, size from file where lang <> 'es'), n as (select path, case when lang = 'fr' then sha256(content || 'x') else sha256(content) end as hash, case when size > 1000 then size + 1 else size end as mtime, size from file where not contains(path, '/src5/'))
    select coalesce(n.path, o.path) as path, case when n.path is null then 'removed' when o.path is null then 'added' when (n.mtime > o.mtime or n.size <> o.size) and n.hash <> o.hash then 'changed' else 'unchanged' end as change from o full join n on n.path = o.path""",
)
def _(t):
    f = t.file.withColumn("content", F.col("content"))
    old = f.filter("lang <> 'es'").select("path", F.sha2("content", 256).alias("hash"), F.col("size").alias("mtime"), "size")
    new = f.filter(~F.contains("path", F.lit("/src5/"))).select("path", F.sha2(F.when(F.col("lang") == "fr", F.concat("content", F.lit("x"))).otherwise(F.col("content")), 256).alias("hash"), F.when(F.col("size") > 1000, F.col("size") + 1).otherwise(F.col("size")).alias("mtime"), "size")
    return W.change_sets(old, new)


@query("unified_sources", "select cve_id, platform, null as stars, 'exploit' as source from exploit union all select cve_id, null, stars, 'poc' from poc")
def _(t):
    return W.unified({"exploit": t.exploit.select("cve_id", "platform"), "poc": t.poc.select("cve_id", "stars")})


@query("version_conflicts", "select ecosystem, name, list_sort(list_distinct(list(version))) as versions from dependency group by 1, 2 having count(distinct version) > 1")
def _(t):
    out = t.dependency.groupBy("ecosystem", "name").agg(F.array_sort(F.collect_set("version")).alias("versions"))
    return out.filter(F.size("versions") > 1)


@query("dependency_advisories", f"""with adv as (select distinct product as name, cve_id, version_end from cpe where version_end is not null and cve_id in (select cve_id from kev where exploited)),
    d as (select distinct name, version from dependency)
    select d.name, d.version, a.cve_id from d join adv a on 'product' || substr(d.name, 4) = a.name where {_KEY.format("d.version")} < {_KEY.format("a.version_end")}""")
def _(t):
    known = t.kev.filter("exploited").select("cve_id")
    advice = t.cpe.filter("version_end is not null").join(known, "cve_id", "left_semi").select(F.col("product"), "cve_id", F.concat(F.lit("<"), "version_end").alias("spec")).distinct()
    deps = t.dependency.select("name", "version").distinct().withColumn("product", F.concat(F.lit("product"), F.substring("name", 4, 9)))
    return I.affected(deps, advice.withColumn("bounds", V.spec_range(F.col("spec"))), ["product"]).select("name", "version", "cve_id")

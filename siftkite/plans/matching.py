"""Queries of look-ups, path and line matching, cascades and merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftkite.operators import matching as M
from siftkite.operators import neighbours as N
from siftkite.operators import patterns as P
from siftkite.operators import typed as Z
from siftkite.operators import usage as U
from siftkite.plans.registry import query
from siftkite.staging import spread


@query("staged_lookup", "with w as (select c_custkey, 'part' || (c_custkey % 30) as n from customer), k as (select p_partkey, case when p_partkey % 2 = 0 then 'Part' else 'part' end || (p_partkey % 40) as n from part) select c_custkey, p_partkey, stage from (select w.c_custkey, k.p_partkey, case when w.n = k.n then 0 else 1 end as stage, row_number() over (partition by c_custkey order by case when w.n = k.n then 0 else 1 end, p_partkey) r from w join k on lower(w.n) = lower(k.n)) where r = 1")
def _(t):
    w = t.customer.select("c_custkey", F.concat(F.lit("part"), (F.col("c_custkey") % 30).cast("string")).alias("w_name"))
    k = t.part.select("p_partkey", F.concat(F.when(F.col("p_partkey") % 2 == 0, "Part").otherwise("part"), (F.col("p_partkey") % 40).cast("string")).alias("k_name"))
    return M.staged_lookup(w, k, "c_custkey", [F.col("w_name") == F.col("k_name"), F.lit(True)], ["p_partkey"]).select("c_custkey", "p_partkey", "stage")


@query("suffix_join", "with h as (select distinct case when user_id % 3 = 0 then 'd' || (user_id % 10) || '/F' || user_id || '.py' else './repo/src/d' || (user_id % 10) || '/F' || user_id || '.py' end as hit, user_id from events), f as (select distinct file_path from finding) select file_path, hit from f join h on f.file_path = h.hit or (ends_with(f.file_path, '/' || h.hit) and not exists (select 1 from h g where g.hit = f.file_path))")
def _(t):
    base = F.concat(F.lit("d"), (F.col("user_id") % 10).cast("string"), F.lit("/F"), F.col("user_id").cast("string"), F.lit(".py"))
    hits = t.events.select(F.when(F.col("user_id") % 3 == 0, base).otherwise(F.concat(F.lit("./repo/src/"), base)).alias("hit")).distinct()
    return M.suffix_join(t.finding.select("file_path").distinct(), hits, "file_path", "hit")


@query("cascade", "select path, case when path in (select path from file where contains(content, 'token')) then 'hard' else 'rest' end as part from file")
def _(t):
    hard, rest = M.cascade(t.file.select("path"), t.file.filter(F.contains("content", F.lit("token"))), "path")
    return hard.withColumn("part", F.lit("hard")).union(rest.withColumn("part", F.lit("rest")))


@query("near_any", "select pos from finding f where source = 'ai' and exists (select 1 from finding g where g.source = 'static' and g.file_path = f.file_path and abs(g.line - f.line) <= 2)")
def _(t):
    return M.near_any(t.finding.filter("source = 'ai'"), t.finding.filter("source = 'static'"), "file_path", "line", 2).select("pos")


@query("match_lines", """with l as (select path, generate_subscripts(string_split(content, chr(10)), 1) as line, unnest(string_split(content, chr(10))) as text from file),
    s as (select path || ':' || line as key, path, '  ' || text as snippet, line + (length(text) % 3) as reported from l union all select path || ':none', path, 'no such line', 3 from file),
    m as (select s.key, min(abs(l.line - s.reported)) as d, arg_min(l.line, (abs(l.line - s.reported), l.line)) as line from s join l on l.path = s.path and trim(l.text) = trim(s.snippet) and abs(l.line - s.reported) <= 20 group by 1)
    select s.key, coalesce(m.line, s.reported) as line, case when m.key is null then 'NOT_FOUND' when m.d = 0 then 'EXACT' else 'ADJUSTED' end as status from s left join m on m.key = s.key""")
def _(t):
    lines = P.lines_of(t.file)
    key = F.concat("path", F.lit(":"), F.col("line").cast("string"))
    own = lines.select(key.alias("key"), "path", F.concat(F.lit("  "), "text").alias("snippet"), (F.col("line") + F.length("text") % 3).alias("reported"))
    none = t.file.select(F.concat("path", F.lit(":none")).alias("key"), "path", F.lit("no such line").alias("snippet"), F.lit(3).alias("reported"))
    return M.match_lines(own.union(none), lines, 20)


@query("fuse_lines", "with l as (select path, generate_subscripts(string_split(content, chr(10)), 1) as line, unnest(string_split(content, chr(10))) as text from file) select path, line, least(1.0::double, case when contains(text, 'tion') then 0.2::double else 0 end + case when contains(text, 'the') then 0.5::double else 0 end + case when regexp_matches(text, '[0-9]{3}') then 0.3::double else 0 end) as score from l where contains(text, 'tion') or contains(text, 'the') or regexp_matches(text, '[0-9]{3}')")
def _(t):
    lines = P.lines_of(t.file)
    leg = lambda test: lines.filter(test).select("path", "line", F.lit(1.0).alias("score"))
    return M.fuse_lines({"token": (leg(F.contains("text", F.lit("tion"))), 0.2), "pattern": (leg(F.contains("text", F.lit("the"))), 0.5), "context": (leg(F.col("text").rlike("[0-9]{3}")), 0.3)})


@query("merged_plans", "select rule_id, sum(line) as line, bool_or(verified) as verified, list_sort(list_distinct(flatten(list([severity, split_part(description, ' ', 1)])))) as tags from finding group by 1")
def _(t):
    parts = t.finding.select("rule_id", "line", "verified", F.array("severity", F.split_part("description", F.lit(" "), F.lit(1))).alias("tags"))
    return M.merge_keyed(parts, "rule_id", ["line"], ["verified"], ["tags"])


@query("incremental_feed", "with b as (select cve_id, last_modified, 'recent' as feed, 0 as p from cve where description like 'O %' union all select cve_id, last_modified + interval 1 day, 'modified', 1 from cve where description like '%URGENT'), r as (select *, row_number() over (partition by cve_id order by last_modified desc, p desc) n from b) select cve_id, last_modified, feed from r where n = 1 and last_modified >= timestamp '1996-01-01'")
def _(t):
    recent = t.cve.filter("description like 'O %'").select("cve_id", "last_modified", F.lit("recent").alias("feed"))
    modified = t.cve.filter("description like '%URGENT'").select("cve_id", (F.col("last_modified") + F.expr("interval 1 day")).alias("last_modified"), F.lit("modified").alias("feed"))
    return M.incremental(recent, modified, "cve_id", "last_modified", F.lit("1996-01-01").cast("timestamp_ntz"))


@query("reuse_unchanged", "select path, case when lang = 'fr' then 'work' else 'cached' end as part from file")
def _(t):
    files = t.file.select("lang", "path", F.md5("content").alias("digest"))
    cache = files.withColumn("digest", F.when(F.col("lang") == "fr", "old").otherwise(F.col("digest")))
    work, held = M.reuse_unchanged(files, cache, "path", "digest")
    return work.select("path", F.lit("work").alias("part")).union(held.select("path", F.lit("cached")))


@query("unpivot_fields", "select cve_id, 'description' as field, description as content from cve union all select cve_id, 'last_modified', strftime(last_modified, '%Y-%m-%d %H:%M:%S') from cve")
def _(t):
    return M.unpivot_fields(t.cve, "cve_id", ["description", "last_modified"])


@query("review_conflicts", "select distinct signal_id, 'conflict' as review from signal where state = 'CONFIRMED' and agent = 'view' and signal_id in (select signal_id from signal where state = 'REJECTED' and agent = 'click')")
def _(t):
    s = t.signal
    return M.missing_reviews(s.filter("state = 'CONFIRMED' and agent = 'view'").select("signal_id"), s.filter("state = 'REJECTED' and agent = 'click'"), "signal_id")


@query("tiered_files", "select path, case when regexp_matches(path, '/fr/.*[05][.]') then 'critical' when regexp_matches(path, '[.](py|java)$') then 'high' else 'low' end as tier from file order by case when regexp_matches(path, '/fr/.*[05][.]') then 0 when regexp_matches(path, '[.](py|java)$') then 1 else 2 end, pos limit 60")
def _(t):
    rows = M.tiered(t.file, [("critical", "/fr/.*[05][.]"), ("high", "[.](py|java)$")], "path")
    return rows.orderBy("tier_order", "pos").limit(60).select("path", "tier")


@query("risk_summary", "select case when regexp_matches(path, '[.]py$') then 'high' else 'low' end as tier, count(*) as n from file group by rollup (case when regexp_matches(path, '[.]py$') then 'high' else 'low' end)")
def _(t):
    return M.tiered(t.file, [("high", "[.]py$")], "path").rollup("tier").agg(F.count("*").alias("n"))


@query("approx_neighbours")
def _(t):
    index = N.build_index(t.embeddings)
    return N.search(index, t.embeddings.filter("vec_id % 50 = 0")).select("query", F.col("key").alias("vec_id"), "distance", "nth")


@query("sample_agreement", "with a as (select finding_id, max(n) as m from (select finding_id, decision, count(*) n from vote group by 1, 2) group by 1), b as (select finding_id, max(n) as m from (select finding_id, severity, count(*) n from vote group by 1, 2) group by 1) select a.finding_id, c.n, greatest(a.m, b.m) / c.n as agreement from a join b on a.finding_id = b.finding_id join (select finding_id, count(*) n from vote group by 1) c on c.finding_id = a.finding_id")
def _(t):
    return M.sampled_agreement(t.vote, [F.col("decision"), F.col("severity")], "finding_id")


@query("weighted_fields", "with n as (select finding_id, sum(token_cost * confidence) / nullif(sum(confidence), 0) as token_cost from vote group by 1), d as (select finding_id, decision from (select finding_id, decision, row_number() over (partition by finding_id order by round(sum(confidence), 9) desc, decision) r from vote group by 1, 2) where r = 1) select n.*, d.decision from n left join d on d.finding_id = n.finding_id")
def _(t):
    return M.weighted_fields(t.vote, "finding_id", ["token_cost"], ["decision"], "confidence")


@query("rule_totals", "select rule_id, count(*) as total, count(distinct substr(sha256(code_snippet), 1, 16)) as patterns from finding group by 1")
def _(t):
    return t.finding.groupBy("rule_id").agg(F.count("*").alias("total"), F.countDistinct(F.substring(F.sha2("code_snippet", 256), 1, 16)).alias("patterns"))


@query("funnel_rates", "select count(*) filter (severity = 'critical') / greatest(count(*), 1) as first_rate, count(*) filter (severity = 'critical' and verified) / greatest(count(*) filter (severity = 'critical'), 1) as second_rate from finding")
def _(t):
    first, second = F.count_if(F.col("severity") == "critical"), F.count_if((F.col("severity") == "critical") & F.col("verified"))
    return t.finding.agg((first / F.greatest(F.count("*"), F.lit(1))).alias("first_rate"), (second / F.greatest(first, F.lit(1))).alias("second_rate"))


@query("file_statistics", "select lang, count(*) as files, sum(size) as bytes, avg(size) as mean, sum(length(content) - length(replace(content, chr(10), '')) + 1) as lines from file group by rollup (lang)")
def _(t):
    lines = F.length("content") - F.length(F.replace("content", F.lit("\n"))) + 1
    return t.file.rollup("lang").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.avg("size").alias("mean"), F.sum(lines).alias("lines"))


@query("files_by_language", "select lang, list_sort(list(path)) as paths from file group by 1")
def _(t):
    return t.file.groupBy("lang").agg(F.array_sort(F.collect_list("path")).alias("paths"))


@query("priority_tiers", "select case when r >= 0.7 then 'P0' when r >= 0.5 then 'P1' when r >= 0.3 then 'P2' else 'P3' end as tier, count(*) as n, avg(r) as mean from (select confidence as r from finding) group by 1")
def _(t):
    from siftkite.functions.scoring import priority_tier

    return t.finding.groupBy(priority_tier(F.col("confidence")).alias("tier")).agg(F.count("*").alias("n"), F.avg("confidence").alias("mean"))


@query("download_check", "select distinct path, sha256(content) as digest from file where path in (select path from file where lang = 'de')")
def _(t):
    seen = t.file.filter("lang = 'de'").select("path")
    return t.file.join(seen, "path", "left_semi").select("path", F.sha2("content", 256).alias("digest")).distinct()


@query("quarterly_forecast_points", "select count(*) as days, regr_slope(n, x) as slope from (select datediff('day', date '2024-01-01', cast(ts as date)) as x, count(*) as n from events group by 1)")
def _(t):
    d = U.daily(t.events, "ts").select(F.datediff("day", F.lit("2024-01-01").cast("date")).alias("x"), "n")
    return d.agg(F.count("*").alias("days"), F.regr_slope("n", "x").alias("slope"))


@query("typed_merge")
def _(t):
    """Every vote of a finding as a nested sample."""
    json = F.to_json(F.struct("decision", "severity", "confidence", F.array("agent_id").alias("agents"), F.struct("token_cost", F.struct("execution_time_ms").alias("time")).alias("cost")))
    return Z.merge_typed(spread(t.vote).select("finding_id", "pos", F.col("confidence").alias("weight"), json.alias("json")), "finding_id")

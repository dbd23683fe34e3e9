"""Queries of file priorities, assessments, decisions and linking joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftkite.functions import priorities as P
from siftkite.operators import linking as L
from siftkite.operators import findings as O
from siftkite.plans.registry import query

_LANGUAGE = "case lang when 'en' then 'python' when 'fr' then 'typescript' when 'de' then 'java' else 'yaml' end"


@query(
    "file_complexity",
    f"""select path, round(least(1, case when n > 1000 then 0.4 when n > 500 then 0.3 when n > 200 then 0.2 when n > 100 then 0.1 else 0 end
        + case when s > 102400 then 0.3 when s > 51200 then 0.2 when s > 20480 then 0.1 else 0 end
        + case when l in ('java', 'typescript') then 0.1 when l = 'python' then 0.05 else 0 end)::double, 4) as score
    from (select path, size // 10 as n, size * 3 as s, {_LANGUAGE} as l from file)""",
)
def _(t):
    return t.file.select("path", P.file_complexity(F.expr("size div 10"), F.col("size") * 3, F.expr(_LANGUAGE)).alias("score"))


@query(
    "change_frequency",
    """select path, round(least(1, case when pos % 60 > 50 then 0.4 when pos % 60 > 20 then 0.3 when pos % 60 > 10 then 0.2 when pos % 60 > 5 then 0.1 else 0 end
        + case when pos % 3 = 0 then 0.2 else 0 end + case when pos % 4 = 0 then 0.2 else 0 end
        + case when pos % 13 > 10 then 0.3 when pos % 13 > 5 then 0.2 when pos % 13 > 2 then 0.1 else 0 end)::double, 4) as score from file""",
)
def _(t):
    return t.file.select("path", P.change_frequency(F.col("pos") % 60, F.col("pos") % 3 == 0, F.col("pos") % 4 == 0, F.col("pos") % 13).alias("score"))


@query("content_scores", "select path, round((least(1.0, pos % 14 * 0.1) * 0.5 + pos % 11 * 0.1 * 0.3 + pos % 6 * 0.2 * 0.2)::double, 4) as score from file")
def _(t):
    return t.file.select("path", P.content_score(F.col("pos") % 14, F.col("pos") % 11 * 0.1, F.col("pos") % 6 * 0.2).alias("score"))


@query(
    "propagation_scores",
    """select pos, round(greatest(0, least(10, 5 + case when f then 2 else 0 end + case when x then 2 else 0 end
            + case when x and n > 2 then 0.1 else 0 end + case when x and n > 3 then 0.1 else 0 end + case when n > 3 then 1 else 0 end - s * 0.5))::double, 4) as score,
        round((case when x then 0.15 + least((m - 1) * 0.05, 0.15) + least((n - 2) * 0.03, 0.1) else 0 end)::double, 4) as bonus
    from (select pos, pos % 8 as n, pos % 3 = 0 as f, pos % 2 = 0 as x, pos % 23 as s, 1 + pos % 6 as m from finding)""",
)
def _(t):
    n, x = F.col("pos") % 8, F.col("pos") % 2 == 0
    return t.finding.select("pos", P.propagation(n, F.col("pos") % 3 == 0, x, F.col("pos") % 23).alias("score"), P.cross_file_bonus(x, 1 + F.col("pos") % 6, n).alias("bonus"))


@query(
    "assessment_scores",
    """select pos, round(least(1, 0.5 + case when confidence >= 0.9 then 0.2 when confidence >= 0.7 then 0.1 else 0 end
            + case when r in ('SQL_INJECTION', 'SSRF') then 0.2 else 0 end + case when pos % 2 = 0 then 0.1 else 0 end + case when pos % 3 = 0 then 0.1 else 0 end)::double, 4) as exploitability,
        round(least(1, 0.5 + case severity when 'critical' then 0.4 when 'high' then 0.3 when 'medium' then 0.2 when 'low' then 0.1 else 0 end
            + case when pos % 4 = 0 then 0.1 else 0 end + case when pos % 5 = 0 then 0.1 else 0 end)::double, 4) as impact
    from (select *, case when rule_id like 'SQL_INJECTION%' then 'SQL_INJECTION' when rule_id like '%SSRF' then 'SSRF' else rule_id end as r from finding)""",
)
def _(t):
    rule = F.when(F.col("rule_id").startswith("SQL_INJECTION"), "SQL_INJECTION").when(F.col("rule_id").endswith("SSRF"), "SSRF").otherwise(F.col("rule_id"))
    each = lambda n, name: F.when(F.col("pos") % n == 0, name)
    return t.finding.select(
        "pos",
        P.finding_exploitability(rule, F.col("confidence"), each(2, "production"), each(3, "public")).alias("exploitability"),
        P.finding_impact(F.col("severity"), each(4, "high"), each(5, "high")).alias("impact"),
    )


@query("scan_strategies", "select path, case when size // 40 < 50 then 'FAST' when pos % 13 > 10 or contains(content, 'eval') then 'TAINT_FIRST' when size > 4000 then 'DEEP' else 'RULE_FIRST' end as strategy from file")
def _(t):
    high = F.when(F.col("size") > 4000, "high")
    return t.file.select("path", P.scan_strategy(F.expr("size div 40"), F.col("pos") % 13, F.contains("content", F.lit("eval")), high).alias("strategy"))


@query(
    "verified_confidence",
    """select pos, round(least(1, case when v >= 0.6 then v else v * 0.6 + confidence::decimal(9, 4) * 0.4 end)::double, 4) as confidence
    from (select pos, confidence, case when pos % 2 = 0 then 0.25 else 0 end + case when pos % 3 <> 0 then 0.35 else 0 end + (pos % 11)::decimal(4, 1) / 10::decimal(4, 1) * 0.4 as v from finding)""",
)
def _(t):
    return t.finding.select("pos", P.verified_confidence(F.col("pos") % 2 == 0, F.col("pos") % 3 != 0, F.col("pos") % 11 / 10, F.col("confidence")).alias("confidence"))


@query(
    "state_overrides",
    """select pos, case when d in ('CONFIRMED', 'REJECTED') then d when d = 'REFINED' and state <> 'CONFIRMED' then d else state end as state,
        coalesce(case when d = 'REFINED' then state not in ('CONFIRMED', 'REFINED') when d in ('CONFIRMED', 'REJECTED') then d <> state end, false) as overridden
    from (select *, case pos % 7 when 0 then 'CONFIRMED' when 1 then 'REFINED' when 2 then 'REJECTED' when 3 then 'OTHER' end as d from signal)""",
)
def _(t):
    d = F.when(F.col("pos") % 7 == 0, "CONFIRMED").when(F.col("pos") % 7 == 1, "REFINED").when(F.col("pos") % 7 == 2, "REJECTED").when(F.col("pos") % 7 == 3, "OTHER")
    return t.signal.select("pos", P.merged_state(d, F.col("state")).alias("state"), P.overrides(d, F.col("state")).alias("overridden"))


@query(
    "cost_projection",
    """select lang, round((round_even(round_even(70807.0 * n, 0) * 0.8, 0) / 1000 * 0.00027 + round_even(round_even(70807.0 * n, 0) * 0.2, 0) / 1000 * 0.0011)::double, 4) as usd
    from (select lang, count(*) as n from file group by 1)""",
)
def _(t):
    counted = t.file.groupBy("lang").agg(F.count("*").alias("n"))
    return counted.select("lang", P.projected_cost(F.col("n"), F.lit(70807.0), F.lit(0.8), F.lit(0.00027), F.lit(0.0011)).alias("usd"))


@query(
    "supplemented",
    "select 'few' as case_of, pos from finding where severity = 'critical' and pos < 20 union all select 'few', pos from finding where severity = 'high' union all select 'enough', pos from finding where severity = 'critical'",
)
def _(t):
    critical, high = t.finding.filter("severity = 'critical'").select("pos"), t.finding.filter("severity = 'high'").select("pos")
    few, enough = L.supplement(critical.filter("pos < 20"), high, 50), L.supplement(critical, high, 50)
    return few.select(F.lit("few").alias("case_of"), "pos").union(enough.select(F.lit("enough"), "pos"))


@query(
    "reachable_sinks",
    """with f as (select pos, 'app/' || lang || '/m' || (pos % 40)::varchar || '/f' || pos::varchar || '.py' as path, regexp_replace('app/' || lang || '/m' || (pos % 40)::varchar || '/f', '/[^/]*$', '') as dir from file),
    e as (select * from f where pos % 97 = 0),
    calls as (select distinct e.path as entry, s.path as sink from e join f s on s.pos = e.pos * 3 + 1),
    pairs as (select s.pos, e.pos as first_at, e.path as entry from f s join e on e.dir = s.dir union select s.pos, e.pos, e.path from f s join calls c on c.sink = s.path join e on e.path = c.entry)
    select f.path, coalesce(n, 0) as n_entries, g.entry, n is not null as reachable, case when n is null then 0.0::double end as base_score, case when n is null then 0.9 else 0.8 end::double as confidence
    from f left join (select pos, count(*) as n, arg_min(entry, first_at) as entry from pairs group by 1) g on g.pos = f.pos""",
)
def _(t):
    f = t.file.select("pos", F.expr("'app/' || lang || '/m' || cast(pos % 40 as string) || '/f' || cast(pos as string) || '.py'").alias("path"))
    entries = f.filter("pos % 97 = 0")
    calls = entries.select((F.col("pos") * 3 + 1).alias("at"), F.col("path").alias("entry")).join(f.select(F.col("pos").alias("at"), F.col("path").alias("sink")), "at").select("entry", "sink")
    return L.reachable(f, entries, calls).select("path", F.col("n_entries").cast("long").alias("n_entries"), "entry", "reachable", "base_score", "confidence")


@query(
    "first_matches",
    """with s as (select pos, location, lower(agent) as kind from signal), v as (select pos, 'f' || (pos % 20)::varchar || '.py:' || (line % 9)::varchar as location, lower(rule_id) as kind from finding where pos % 3 <> 1),
    place as (select location, min(pos) as p from v group by 1), kinds as (select s.kind, min(v.pos) as k from (select distinct kind from s) s join v on contains(v.kind, s.kind) group by 1)
    select s.pos, least(p, k) as matched from s left join place using (location) left join kinds using (kind)""",
)
def _(t):
    findings = t.finding.filter("pos % 3 <> 1").select("pos", F.expr("'f' || cast(pos % 20 as string) || '.py:' || cast(line % 9 as string)").alias("location"), F.col("rule_id").alias("kind"))
    signals = t.signal.select("pos", "location", F.col("agent").alias("kind"))
    return L.first_match(signals, findings.withColumnRenamed("pos", "at_pos").withColumnRenamed("location", "location"), key="pos", location="location", kind="kind", order="at_pos")


@query(
    "similar_titles",
    """select c.cwe_id, c.name as title, c.description, 1.0::double as similarity from cwe c
    where c.cwe_id <> 'CWE-7' and (contains(c.description, (select name[1:8] from cwe where cwe_id = 'CWE-7')) or contains(c.name, (select name[1:8] from cwe where cwe_id = 'CWE-7'))) order by 1 limit 5""",
)
def _(t):
    short = F.when(F.col("cwe_id") == "CWE-7", F.substring("name", 1, 8)).otherwise(F.col("name"))
    return L.similar_titles(t.cwe.select("cwe_id", short.alias("title"), "description"), "CWE-7", key="cwe_id")


@query(
    "flat_reports",
    """select coalesce(f.r, u.r) as report_id, n_findings::int as n_findings, n_risky::int as n_risky, n_records::int as n_records, tokens::bigint as tokens from
    (select pos % 50 as r, count(*) as n_findings, count(*) filter (severity in ('critical', 'high')) as n_risky from finding group by 1) f
    join (select pos % 50 as r, count(*) as n_records, sum(token_cost) as tokens from vote group by 1) u on f.r = u.r""",
)
def _(t):
    findings = t.finding.groupBy((F.col("pos") % 50).alias("report_id")).agg(F.collect_list(F.struct("severity")).alias("findings"))
    records = t.vote.groupBy((F.col("pos") % 50).alias("report_id")).agg(F.collect_list(F.struct(F.col("token_cost").alias("total_tokens"))).alias("token_records"))
    return L.flat_report(findings.join(records, "report_id"))


_PARTS = {"business": "(pos % 11) / 10.0", "complexity": "(size % 1000) / 1000.0", "security": "(pos % 7) / 6.0", "change_frequency": "(pos % 13) / 12.0", "port_config": "(pos % 3) / 2.0", "api_route": "(pos % 5) / 4.0", "security_config": "(pos % 2) / 1.0"}


def _totals() -> str:
    one = lambda w: " + ".join(f"{_PARTS[c].replace('.0', '.0::double')} * {x}::double" for c, x in w.items() if x)
    return " union all ".join(f"select path, pos, '{s}' as strategy, round({one(w)}, 9) as total from file" for s, w in P.STRATEGIES.items())


@query(
    "ranked_files",
    f"""select path, strategy, total, case when total >= 0.8 then 'critical' when total >= 0.6 then 'high' when total >= 0.4 then 'medium' when total >= 0.2 then 'low' else 'info' end as level,
    row_number() over (partition by strategy order by total desc, pos) as rank from ({_totals()})""",
)
def _(t):
    return O.ranked_files(t.file.withColumns({c: F.expr(e + "D") for c, e in _PARTS.items()}), list(P.STRATEGIES))

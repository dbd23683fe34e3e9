"""Queries of signals, usage, cost, trends and incremental work."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftkite.functions import scoring as S
from siftkite.operators import usage as U
from siftkite.plans.registry import query
from siftkite.streaming import duplicates as D
from siftkite.streaming import signals as G

_ALLOWED = ", ".join(f"'{a}>{b}'" for a, bs in G.TRANSITIONS.items() for b in bs)


@query("signal_audit", f"select signal_id, pos, before, state, coalesce(before || '>' || state in ({_ALLOWED}), true) as allowed, gap < 5 as cooling from (select signal_id, pos, state, lag(state) over w as before, epoch(ts) - epoch(lag(ts) over w) as gap from signal window w as (partition by signal_id order by ts, pos))")
def _(t):
    return G.audit(t.signal)


@query("signal_replay")
def _(t):
    return G.replay(t.signal)


@query("signal_summary", "select state, agent, count(*) as n from signal group by 1, 2")
def _(t):
    return t.signal.groupBy("state", "agent").agg(F.count("*").alias("n"))


@query("rate_limit", "select pos, recent, recent > 3 as limited from (select pos, count(*) over (partition by signal_id order by ts range between interval 1 hour preceding and current row) as recent from signal)")
def _(t):
    return G.rate(t.signal, 3600, 3, ["signal_id"]).select("pos", "recent", "limited")


@query("sessions", "select signal_id, min(ts) as start, max(ts) + interval 2 hour as \"end\", count(*) as n from (select *, sum(fresh) over (partition by signal_id order by ts, pos) as s from (select *, case when ts - lag(ts) over (partition by signal_id order by ts, pos) < interval 2 hour then 0 else 1 end as fresh from signal)) group by signal_id, s")
def _(t):
    return G.sessions(t.signal, "2 hours")


@query("expired_entries", "select pos from signal where epoch(timestamp '2024-02-01') - epoch(ts) > 1296000")
def _(t):
    return G.expired(t.signal, F.lit("2024-02-01").cast("timestamp"), 1296000).select("pos")


@query("expired_by_size", "select path from file where epoch(timestamp '2024-02-01') - (1706659200 - size * 10) > case when size < 10240 then 43200 when size > 1048576 then 172800 else 86400 end")
def _(t):
    rows = t.file.withColumn("ts", F.timestamp_seconds(F.lit(1706659200) - F.col("size") * 10))
    return G.expired(rows, F.lit("2024-02-01").cast("timestamp"), 86400, size="size").select("path")


@query("temperature", "select signal_id, n, last, case when n < 70 and idle > 0.5 then 'cold' when n >= 70 and idle < 0.5 then 'hot' else 'warm' end as kind from (select signal_id, count(*) as n, max(ts) as last, (epoch(timestamp '2024-01-31') - epoch(max(ts))) / 86400 as idle from signal group by 1)")
def _(t):
    return G.temperature(t.signal, "signal_id", F.lit("2024-01-31").cast("timestamp"), hits=70, days=0.5)


_COST = "round(prompt_tokens / 1000.0::double * case when model like 'gpt-4o-mini%' then 0.00015::double when model like 'gpt-4o%' then 0.005::double when model like 'deepseek%' then 0.00027::double else 0.001::double end + completion_tokens / 1000.0::double * case when model like 'gpt-4o-mini%' then 0.0006::double when model like 'gpt-4o%' then 0.015::double when model like 'deepseek%' then 0.0011::double else 0.002::double end, 10)"


@query("cost_breakdown", f"select agent, step, model, sum(prompt_tokens + completion_tokens) as tokens, sum({_COST}) as cost_usd, count(*) as calls, sum(latency) as latency, grouping(agent) * 4 + grouping(step) * 2 + grouping(model) as level from usage group by grouping sets ((agent), (step), (model), ())")
def _(t):
    return U.breakdown(t.usage, ["agent", "step", "model"])


@query("session_rollup", "select session_id, file_path, sum(prompt_tokens) as prompt_tokens, sum(completion_tokens) as completion_tokens from usage group by rollup (session_id, file_path)")
def _(t):
    return t.usage.rollup("session_id", "file_path").agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))


@query("usage_stats", "select coalesce(step, 'all') as step, count(*) as n, avg(latency) as mean, median(latency) as median, min(latency) as least, max(latency) as most, coalesce(stddev_samp(latency), 0) as deviation, avg(case when success then 1.0::double else 0 end) as success_rate, avg(latency) filter (success) as success_latency, avg(case when cache_hit then 1.0::double else 0 end) as hit_rate from usage group by rollup (step)")
def _(t):
    return U.statistics(t.usage, "step")


@query(
    "roi",
    f"""with u as (select sum({_COST}) as cost, sum(prompt_tokens + completion_tokens) as tokens, count(distinct file_path) as files, count(*) filter (cache_hit) as hits, count(*) as asked, sum(prompt_tokens + completion_tokens) filter (cache_hit) as saved from usage),
    f as (select count(*) as found, count(*) filter (status = 'CONFIRMED') as confirmed, count(*) filter (status = 'REJECTED') as eliminated from finding)
    select round(cost / files, 8) as cost_per_file, round(cost / found, 8) as cost_per_finding, round(cost / confirmed, 8) as cost_per_confirmed, round(cost / eliminated, 8) as cost_per_eliminated,
    round(found * 1000 / tokens, 6) as findings_per_1k, round(confirmed * 1000 / tokens, 6) as confirmed_per_1k, round(hits / asked, 4) as hit_rate, round(saved * cost / tokens, 8) as saved_usd,
    found as findings, confirmed, eliminated, round(cost, 8) as cost_usd, tokens::bigint as tokens from u, f""",
)
def _(t):
    found = t.finding.select(F.coalesce(F.col("status") == "CONFIRMED", F.lit(False)).alias("confirmed"), F.coalesce(F.col("status") == "REJECTED", F.lit(False)).alias("eliminated"))
    return U.roi(t.usage, found)


@query("daily_trend", "select cast(ts as date) as day, count(*) as n from events group by 1")
def _(t):
    return U.daily(t.events, "ts")


@query("trend_forecast", "with d as (select datediff('day', date '2024-01-01', cast(ts as date)) as x, count(*) as y from events group by 1), f as (select regr_slope(y, x) as m, regr_intercept(y, x) as b, max(x) as last from d) select last + i as day_index, greatest(0, round_even(b + m * (last + i), 0)) as predicted from f, range(1, 8) r(i)")
def _(t):
    return U.forecast(U.daily(t.events, "ts"), 7)


@query("top_tags", "select tag, count(*) as n from (select unnest([event_type, 'u' || (user_id % 9), json_extract_string(props, '$.k')]) as tag from events) group by 1 order by n desc, tag limit 10")
def _(t):
    tags = F.explode(F.array("event_type", F.concat(F.lit("u"), (F.col("user_id") % 9).cast("string")), F.get_json_object("props", "$.k")))
    return t.events.select(tags.alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(10)


@query("recent_usage", "select pos, agent from usage order by ts desc, pos desc limit 100")
def _(t):
    return t.usage.orderBy(F.desc("ts"), F.desc("pos")).limit(100).select("pos", "agent")


@query("similar_runs", "with near as (select o_orderkey, o_totalprice, abs(o_custkey - 100) as d from orders where o_custkey between 70 and 130 order by d, o_orderkey limit 10) select sum(o_totalprice * w) / sum(w) as estimate from (select o_totalprice, 1 / (1 + d) as w from near)")
def _(t):
    near = t.orders.filter("o_custkey between 70 and 130").withColumn("d", F.abs(F.col("o_custkey") - 100)).orderBy("d", "o_orderkey").limit(10)
    return near.agg((F.sum(F.col("o_totalprice") / (1 + F.col("d"))) / F.sum(1 / (1 + F.col("d")))).alias("estimate"))


@query("agent_means", "select agent, avg(case when success then latency end) as mean, count(*) filter (not success) as failures from usage group by 1")
def _(t):
    return t.usage.groupBy("agent").agg(F.avg(F.when(F.col("success"), F.col("latency"))).alias("mean"), F.count_if(~F.col("success")).alias("failures"))


@query("unit_costs", "select model, round(sum(round(prompt_tokens / 1000 * case when model like 'gpt-4o-mini%' then 0.00015::double when model like 'deepseek%' then 0.00027::double else 0.001::double end + completion_tokens / 1000 * case when model like 'gpt-4o-mini%' then 0.0006::double when model like 'deepseek%' then 0.0011::double else 0.002::double end, 10)), 6) as cost from usage group by 1")
def _(t):
    return t.usage.groupBy("model").agg(F.round(F.sum(S.cost(F.col("model"), F.col("prompt_tokens"), F.col("completion_tokens"))), 6).alias("cost"))


@query(
    "dependency_risk",
    """with own as (select ecosystem, least(50, sum(case when l >= 9 then 15 when l >= 7 then 10 when l >= 4 then 5 else 2 end))
            + least(20, case when count(*) > 200 then 15 when count(*) > 100 then 10 when count(*) > 50 then 5 else 0 end
                + case when count(*) filter (dependency_type = 'transitive') / count(*) > 0.8 then 5 when count(*) filter (dependency_type = 'transitive') / count(*) > 0.5 then 3 else 0 end) as own
        from (select *, pos % 10 as l from dependency) group by 1),
    warned as (select ecosystem, sum(case pos % 5 when 0 then 15 when 1 then 10 when 2 then 5 when 3 then 2 else 0.5 end * 0.25) as warned from dependency where pos % 997 < 2 group by 1)
    select ecosystem, round_even(least(100, own + least(30, coalesce(warned, 0)))::double, 1) as risk from own left join warned using (ecosystem)""",
)
def _(t):
    level = F.element_at(F.array(*map(F.lit, ("critical", "high", "medium", "low", "info"))), (F.col("pos") % 5 + 1).cast("int"))
    warnings = t.dependency.filter("pos % 997 < 2").select("ecosystem", level.alias("level"), F.lit(0.25).alias("confidence"))
    return U.dependency_risk(t.dependency.withColumn("cvss", (F.col("pos") % 10).cast("double")), "ecosystem", warnings)


@query("deep_transitive", "select ecosystem, count(*) as n from dependency group by 1 having count(*) filter (dependency_type = 'transitive') / count(*) > 0.7 and count(*) > 50")
def _(t):
    out = t.dependency.groupBy("ecosystem").agg(F.count("*").alias("n"), F.avg((F.col("dependency_type") == "transitive").cast("double")).alias("share"))
    return out.filter("share > 0.7 and n > 50").select("ecosystem", "n")


@query("primary_ecosystem", "select ecosystem from dependency group by 1 order by count(*) desc, min(pos) limit 1")
def _(t):
    return t.dependency.groupBy("ecosystem").agg(F.count("*").alias("n"), F.min("pos").alias("p")).orderBy(F.desc("n"), "p").limit(1).select("ecosystem")


@query("category_sequences", "select user_id, event_id from (select user_id, event_id, event_type as a, lead(event_type) over w as b, lead(event_type, 2) over w as c from events window w as (partition by user_id order by ts, event_id)) where a = 'view' and b = 'click' and c = 'purchase'")
def _(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = t.events.withColumn("b", F.lead("event_type").over(w)).withColumn("c", F.lead("event_type", 2).over(w))
    return rows.filter("event_type = 'view' and b = 'click' and c = 'purchase'").select("user_id", "event_id")


@query("last_before", "select e.event_id, (select max(ts) from events p where p.user_id = e.user_id and p.event_type = 'view' and p.ts < e.ts) as last_view from events e where e.event_type = 'purchase'")
def _(t):
    w = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # views at the same moment don't come before: their times are less only for later rows
    before = F.max(F.when(F.col("event_type") == "view", F.col("ts"))).over(w)
    return t.events.withColumn("last_view", before).filter("event_type = 'purchase'").select("event_id", "last_view")


@query("pending_files", "select path from file where path not in (select path from file where lang = 'en')")
def _(t):
    return t.file.join(t.file.filter("lang = 'en'").select("path"), "path", "left_anti").select("path")


@query("json_bag", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def _(t):
    return t.events.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("duplicate_signals")
def _(t):
    return D.near_duplicates(t.signal, max_age_s=3 * 86400)

"""Queries over findings, votes and files: filters, de-duplication, fusion, votes, joins, roll-ups, orders."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftkite.functions import findings as X
from siftkite.operators import findings as O
from siftkite.operators import selection as Y
from siftkite.plans.registry import query

_SEV = "(list_position(['critical','high','medium','low','info'], severity) - 1)"


def _when(cases: list[tuple[str, str]], default: str) -> str:
    return "case " + " ".join(f"when {c} then '{v}'" for c, v in cases) + f" else {default} end"


def _any(col: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains({col}, '{w}')" for w in words) + ")"


#: The rule families in SQL, from the same fixed values.
RULE_SQL = (
    "case when coalesce(rule_id, '') = '' then '' when regexp_matches(rule_id, '_.*_[0-9]+$') then regexp_replace(rule_id, '_[0-9]+$', '') when regexp_matches(rule_id, '_(windows|linux|unix)$') then regexp_replace(rule_id, '_[a-z]+$', '') "
    + " ".join(f"when {' and '.join(_any('lower(rule_id)', g) for g in groups)} then '{family}'" for family, groups in X.RULE_WORDS)
    + " "
    + " ".join(f"when ends_with(lower(rule_id), '{s}') and length(rule_id) > {len(s)} then upper(regexp_extract(lower(rule_id), '^(.+?){s}$', 1))" for s in X.RULE_SUFFIXES)
    + " else rule_id end"
)
KEY_SQL = f"concat_ws('_', {RULE_SQL}, " + ", ".join(f"case when {_any('lower(description)', words)} then '{name}' end" for name, words in X.DESCRIPTION_WORDS) + ")"

PLAIN_FILTERS = {
    "filter_severity": ("severity in ('critical', 'high')", lambda t: O.at_least(t.finding, F.col("severity"), X.SEVERITIES, "high", falling=True)),
    "filter_level": ("verification_level in ('double_verified', 'triple_verified')", lambda t: O.at_least(t.finding, F.col("verification_level"), X.VERIFICATION_LEVELS, "double_verified")),
    "filter_file": ("file_path = './repo/src/d3/F13.py'", lambda t: t.finding.filter(F.col("file_path") == "./repo/src/d3/F13.py")),
    "filter_rule": ("rule_id = 'RULE_windows'", lambda t: t.finding.filter(F.col("rule_id") == "RULE_windows")),
    "filter_confidence": ("confidence >= 0.8", lambda t: t.finding.filter(F.col("confidence") >= 0.8)),
    "filter_score_range": ("confidence between 0.25 and 0.5", lambda t: t.finding.filter(F.col("confidence").between(0.25, 0.5))),
    "filter_hallucinations": ("not (is_hallucination and coalesce(confidence, 1.0) < 0.2)", lambda t: t.finding.filter(~(F.col("is_hallucination") & (F.coalesce("confidence", F.lit(1.0)) < 0.2)))),
    "filter_high_risk": ("severity in ('critical', 'high') and source is not null", lambda t: t.finding.filter(F.col("severity").isin("critical", "high") & F.col("source").isNotNull())),
    "filter_path_pattern": ("regexp_matches(file_path, 'd[0-4]/F[0-9]*[13][.]py$')", lambda t: t.finding.filter(F.col("file_path").rlike("d[0-4]/F[0-9]*[13][.]py$"))),
}
for _name, (_where, _fn) in PLAIN_FILTERS.items():
    query(_name, f"select pos, severity, confidence from finding where {_where}")(lambda t, f=_fn: f(t).select("pos", "severity", "confidence"))

query("filter_language", "select path, size from file where lang in ('de', 'fr') and size >= 500 and size <= 5000")(lambda t: t.file.filter(F.col("lang").isin("de", "fr", "nosuch") & (F.col("size") >= 500) & (F.col("size") <= 5000)).select("path", "size"))
query("filter_tag_join", "select pos from finding where file_path in (select file_path from finding where status = 'CONFIRMED' and severity = 'critical')")(lambda t: t.finding.join(t.finding.filter("status = 'CONFIRMED' and severity = 'critical'").select("file_path").distinct(), "file_path", "left_semi").select("pos"))
query("distinct_ports", "select distinct rule_id from finding where rule_id like 'PORT-%'")(lambda t: t.finding.filter(F.col("rule_id").startswith("PORT-")).select("rule_id").distinct())


@query("clean_and_validate", "select cve_id, trim(regexp_replace(description, '\\s+', ' ', 'g')) as description from cve where cve_id <> '' and length(description) >= 10")
def _(t):
    return t.cve.filter((F.col("cve_id") != "") & (F.length("description") >= 10)).select("cve_id", F.trim(F.regexp_replace("description", r"\s+", " ")).alias("description"))


@query("normal_rules", f"select distinct rule_id, {RULE_SQL} as family from finding")
def _(t):
    return t.finding.select("rule_id", X.normal_rule(F.col("rule_id")).alias("family")).distinct()


@query("semantic_keys", f"select pos, {KEY_SQL} as semantic_key, cast(floor(line / 5) * 5 as bigint) as bucket from finding")
def _(t):
    return t.finding.select("pos", X.semantic_key(F.col("rule_id"), F.col("description")).alias("semantic_key"), X.line_bucket(F.col("line")).alias("bucket"))


def _distinct_on(keys: str, order: str, table: str = "finding", columns: str = "pos") -> str:
    return f"select {columns} from (select *, row_number() over (partition by {keys} order by {order}) nth from {table}) where nth = 1"


query("deduplicate", _distinct_on("rule_id, file_path, line, substr(code_snippet, 1, 50)", "pos"))(lambda t: O.deduplicate(t.finding).select("pos"))
query("deduplicate_confident", _distinct_on("rule_id, file_path, line, severity", "confidence desc, pos"))(lambda t: O.most_confident(t.finding).select("pos"))
query("merge_verified", _distinct_on("rule_id, file_path", f"verified desc, {_SEV}, pos"))(lambda t: O.merge_verified(t.finding).select("pos"))
query("smart_deduplicate", f"with near as ({_distinct_on(f'{RULE_SQL}, file_path, floor(line / 5)', 'confidence desc, pos', columns='* exclude (nth)')}) {_distinct_on(KEY_SQL, 'confidence desc, pos', 'near')}")(lambda t: O.smart_deduplicate(t.finding).select("pos"))


@query("merge_lists", "with a as (select * from (select *, row_number() over (partition by rule_id, line order by pos desc) n from finding where source = 'ai') where n = 1), u as (select pos, rule_id, line, confidence, 0 as side from a union all select pos, rule_id, line, confidence, 1 from finding where source = 'tool') select pos from (select *, row_number() over (partition by rule_id, line order by confidence desc, side, pos) n from u) where n = 1")
def _(t):
    return O.merge_lists(t.finding.filter("source = 'ai'"), t.finding.filter("source = 'tool'")).select("pos")


@query("protect_verified", "with best as (select * from (select *, row_number() over (partition by rule_id, file_path order by pos) n from finding where source = 'static' and verified) where n = 1) select f.rule_id, f.file_path, case when b.pos is not null and f.source is distinct from 'static' then b.pos else f.pos end as pos, case when b.pos is not null and f.source is distinct from 'static' then b.line else f.line end as line from finding f left join best b on b.rule_id = f.rule_id and b.file_path = f.file_path")
def _(t):
    return O.protect_verified(t.finding.select("pos", "rule_id", "file_path", "line", "source", "verified"), ["static"]).select("rule_id", "file_path", "pos", "line")


@query("chunk_dedup", "select min(doc_id) as doc_id, count(*) as copies from documents group by text")
def _(t):
    return t.documents.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


@query("line_dedup", "select doc_id, array_to_string(list_transform(list_sort(list(struct_pack(i := i, l := l))), lambda x: x.l), chr(10)) as text from (select doc_id, l, min(i) as i from (select doc_id, trim(unnest(string_split(text, chr(10))), ' ') as l, generate_subscripts(string_split(text, chr(10)), 1) as i from documents) where l <> '' group by 1, 2) group by 1")
def _(t):
    lines = F.transform(F.split("text", "\n"), lambda x: F.trim(x))
    out = t.documents.select("doc_id", F.array_join(F.array_distinct(F.filter(lines, lambda x: x != "")), "\n").alias("text"))
    return out.filter("text <> ''")


@query("near_lines", "select a.pos, b.pos as r_pos from finding a join finding b on a.file_path = b.file_path and abs(a.line - b.line) <= 5 where a.source = 'ai' and b.source = 'tool'")
def _(t):
    return O.near_lines(t.finding.filter("source = 'ai'").select("pos", "file_path", "line"), t.finding.filter("source = 'tool'").select("pos", "file_path", "line"), 5).select("pos", "r_pos")


_PATH = "lower(substr(regexp_replace({0}.file_path, '^(\\./)+', ''), strpos(lower(regexp_replace({0}.file_path, '^(\\./)+', '')), '/src/') + 1))"
_JACCARD = "case when len(list_distinct(string_split(lower(a.description), ' '))) = 0 then 0 else len(list_intersect(list_distinct(string_split(lower(a.description), ' ')), list_distinct(string_split(lower(b.description), ' ')))) / len(list_distinct(list_concat(string_split(lower(a.description), ' '), string_split(lower(b.description), ' ')))) end"


@query("tool_matches", f"select a.pos, b.pos as r_pos from finding a join finding b on {_PATH.format('a')} = {_PATH.format('b')} where a.source = 'tool' and b.source = 'static' and ((a.line > 0 and b.line > 0 and abs(a.line - b.line) <= 3) or (a.line = 0 and b.line = 0)) and (a.cwe_id = b.cwe_id or lower(a.rule_id) = lower(b.rule_id) or {_JACCARD} > 0.5)")
def _(t):
    return O.tool_matches(t.finding.filter("source = 'tool'"), t.finding.filter("source = 'static'"))


@query("tool_merge", f"with m as (select a.pos, b.pos as r_pos, a.confidence from finding a join finding b on {_PATH.format('a')} = {_PATH.format('b')} where a.source = 'tool' and b.source = 'static' and ((a.line > 0 and b.line > 0 and abs(a.line - b.line) <= 3) or (a.line = 0 and b.line = 0)) and (a.cwe_id = b.cwe_id or lower(a.rule_id) = lower(b.rule_id) or {_JACCARD} > 0.5)) select f.pos, greatest(f.confidence, max(m.confidence)) as confidence, count(m.pos) as tools from finding f left join m on m.r_pos = f.pos where f.source = 'static' group by f.pos, f.confidence union all select pos, confidence, 0 from finding where source = 'tool' and pos not in (select pos from m)")
def _(t):
    tool, own = t.finding.filter("source = 'tool'"), t.finding.filter("source = 'static'").select("pos", "confidence")
    pairs = O.tool_matches(tool, t.finding.filter("source = 'static'"))
    by = pairs.join(tool.select("pos", "confidence"), "pos").groupBy(F.col("r_pos").alias("pos")).agg(F.max("confidence").alias("best"), F.count("*").alias("n"))
    merged = own.join(by, "pos", "left").select("pos", F.greatest("confidence", "best").alias("confidence"), F.coalesce("n", F.lit(0)).alias("tools"))
    rest = tool.join(pairs.select("pos").distinct(), "pos", "left_anti").select("pos", "confidence", F.lit(0).cast("long").alias("tools"))
    return merged.unionByName(rest)


_VOTES = """v as (select finding_id, count(*) as votes, count(*) filter (decision = 'CONFIRMED') as n_confirmed, count(*) filter (decision = 'REJECTED') as n_rejected, count(*) filter (decision = 'REFINED') as n_refined,
    coalesce(sum(confidence) filter (decision = 'CONFIRMED'), 0) as c_confirmed, coalesce(sum(confidence) filter (decision = 'REJECTED'), 0) as c_rejected, coalesce(sum(confidence) filter (decision = 'REFINED'), 0) as c_refined,
    avg(execution_time_ms) as avg_time_ms, sum(token_cost) as tokens, count(distinct agent_id) as agents from vote group by 1),
s as (select finding_id, severity from (select finding_id, severity, row_number() over (partition by finding_id order by count(*) desc, list_position(['critical','high','medium','low','info'], severity)) n from vote group by 1, 2) where n = 1)"""


@query("votes_by_finding", f"with {_VOTES} select v.*, s.severity from v join s on s.finding_id = v.finding_id")
def _(t):
    return O.votes_by_finding(t.vote)


_BEST = "greatest(n_confirmed, n_rejected, n_refined)"


@query("vote_decisions", f"""with {_VOTES} select finding_id, case when n_confirmed = {_BEST} then 'CONFIRMED' when n_rejected = {_BEST} then 'REJECTED' else 'REFINED' end as majority, {_BEST} / votes as majority_share,
    case when round(c_confirmed + c_rejected + c_refined, 6) = 0 then 'REJECTED' when round(c_confirmed, 6) >= round(greatest(c_rejected, c_refined), 6) then 'CONFIRMED' when round(c_rejected, 6) >= round(c_refined, 6) then 'REJECTED' else 'REFINED' end as weighted,
    case when n_confirmed / votes >= 0.6 then 'CONFIRMED' when n_rejected / votes >= 0.6 then 'REJECTED' else 'REFINED' end as consensus,
    case when {_BEST} / votes >= 0.99 then 'unanimous' when {_BEST} / votes >= 0.8 then 'strong' when {_BEST} / votes >= 0.6 then 'moderate' when {_BEST} / votes >= 0.4 then 'weak' else 'none' end as level,
    votes >= 2 and {_BEST} - least(n_confirmed, n_rejected, n_refined) <= 1 as controversial from v""")
def _(t):
    rounded = O.votes_by_finding(t.vote).withColumns({c: F.round(c, 6) for c in ("c_confirmed", "c_rejected", "c_refined")})
    return O.decide(rounded).select("finding_id", "majority", "majority_share", "weighted", "consensus", "level", "controversial")


@query("vote_totals", f"with {_VOTES} select count(*) as findings, sum(n_confirmed) as confirmed, sum(n_rejected) as rejected, sum(n_refined) as refined, avg({_BEST} / votes) as agreement from v")
def _(t):
    d = O.decide(O.votes_by_finding(t.vote))
    return d.agg(F.count("*").alias("findings"), F.sum("n_confirmed").alias("confirmed"), F.sum("n_rejected").alias("rejected"), F.sum("n_refined").alias("refined"), F.avg("majority_share").alias("agreement"))


@query("fuse", f"select file_path, line, ['critical','high','medium','low','info'][least(min({_SEV}), 3) + 1] as severity, avg(confidence) as confidence, count(*) as n, list_sort(coalesce(list(distinct source) filter (source is not null), [])) as sources, list_sort(list(distinct rule_id)) as rules, " + ", ".join(f"count(*) filter (severity = '{s}') as n_{s}" for s in X.SEVERITIES) + " from finding group by 1, 2")
def _(t):
    return O.fuse(t.finding, ["file_path", "line"])


@query("confidence_by_source", "select file_path, list(s order by s) as sources, list(m order by s) as means from (select file_path, coalesce(source, 'Unknown') as s, avg(confidence) as m from finding group by 1, 2) group by 1")
def _(t):
    return O.confidence_by_source(t.finding, ["file_path"], "pos").select("file_path", F.map_keys("confidence_by_source").alias("sources"), F.map_values("confidence_by_source").alias("means"))


@query("fuse_union", "select rule_id, count(*) as n, max(confidence) as confidence from (select rule_id, confidence from finding where source = 'ai' union all select rule_id, confidence from finding where source = 'static' union all select rule_id, confidence from finding where source = 'tool') group by 1")
def _(t):
    parts = [t.finding.filter(F.col("source") == s).select("rule_id", "confidence") for s in ("ai", "static", "tool")]
    return O.union_all(parts).groupBy("rule_id").agg(F.count("*").alias("n"), F.max("confidence").alias("confidence"))


@query("severity_histogram", "select v as value, count(f.pos) as n from (values ('critical'), ('high'), ('medium'), ('low'), ('info'), ('fatal')) b(v) left join finding f on f.severity = b.v group by 1")
def _(t):
    return O.histogram(t.finding, F.col("severity"), [*X.SEVERITIES, "fatal"])


@query("grouped_counts", " union all ".join(f"select '{k}' as dimension, cast({k} as varchar) as value, count(*) as n from finding group by 2" for k in ("severity", "rule_id", "file_path", "verification_level")))
def _(t):
    return O.grouped_counts(t.finding, ["severity", "rule_id", "file_path", "verification_level"])


@query("finding_summary", "select count(*) as total, avg(confidence) as avg_confidence, count(distinct file_path) as files, count(distinct rule_id) as rules, " + ", ".join(f"count(*) filter (verification_level = '{v}') as {v}" for v in X.VERIFICATION_LEVELS) + ", count(*) filter (verification_level is null) as no_level, count(*) filter (is_hallucination) as hallucinations, 100 * count(distinct rule_id) filter (status = 'CONFIRMED' or verified) / count(distinct rule_id) as coverage, count(*) filter (status = 'CONFIRMED') + count(*) filter (verified) as verified_twice from finding")
def _(t):
    return O.summary(t.finding)


_CHANCE = "(0.15::double + case when coalesce(nullif(confidence, 0), 0.5) < 0.6 then 0.10::double else 0 end + case when upper(coalesce(status, 'UNCERTAIN')) in ('UNCERTAIN', 'UNVERIFIED') then 0.15::double else 0 end + case when " + _any("upper(title)", X.PLACEHOLDER_TITLES) + " then 0.20::double else 0 end)"


@query("false_positive_rate", f"select 'all' as severity, count(*) as n, round_even(100 * least(greatest(avg({_CHANCE}), 0.1), 0.4), 2) as rate from finding union all select severity, count(*), round_even(100 * avg({_CHANCE}), 2) from finding group by 1")
def _(t):
    return O.false_positive_rate(t.finding)


@query("category_counts", "select case when rule_id like 'PORT-%' then 'port_related' when regexp_matches(rule_id, '^(API|AUTH|DATA|CFG)-') then 'special_scan' else 'general_static' end as category, case when rule_id like 'API-%' then 'api_security' when rule_id like 'AUTH-%' then 'auth_security' when rule_id like 'DATA-%' then 'data_protection' when rule_id like 'CFG-%' then 'config_security' else '' end as area, count(*) as n from finding group by 1, 2")
def _(t):
    r = F.col("rule_id")
    return t.finding.groupBy(X.category(r).alias("category"), X.scan_area(r).alias("area")).agg(F.count("*").alias("n"))


@query("port_pivot", "select file_path, count(*) filter (severity = 'critical') as critical, count(*) filter (severity = 'high') as high, list_sort(list(distinct rule_id)) as rules from finding where rule_id like 'PORT-%' group by 1")
def _(t):
    ports = t.finding.filter(F.col("rule_id").startswith("PORT-"))
    return ports.groupBy("file_path").agg(F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "high").alias("high"), F.array_sort(F.collect_set("rule_id")).alias("rules"))


@query("risk_matrix", "select severity as likelihood, " + ", ".join(f"count(*) filter (coalesce(status, 'NONE') = '{s}') as \"{s}\"" for s in ("CONFIRMED", "REFINED", "REJECTED", "UNCERTAIN", "NONE")) + " from finding group by 1")
def _(t):
    return O.risk_matrix(t.finding, F.col("severity"), F.coalesce("status", F.lit("NONE")), ["CONFIRMED", "REFINED", "REJECTED", "UNCERTAIN", "NONE"])


@query("file_risk", "select file_path, 0.7 * max(confidence) + 0.3 * avg(confidence) as risk, count(*) as n from finding group by 1 order by risk desc, file_path limit 10")
def _(t):
    out = t.finding.groupBy("file_path").agg((0.7 * F.max("confidence") + 0.3 * F.avg("confidence")).alias("risk"), F.count("*").alias("n"))
    return out.orderBy(F.desc("risk"), "file_path").limit(10)


@query("sort_severity", f"select row_number() over (order by {_SEV}, confidence desc, file_path, line, pos) as place, pos from finding where source = 'ai' order by place limit 200")
def _(t):
    order = [X.severity_order(F.col("severity")), F.desc("confidence"), "file_path", "line", "pos"]
    top = t.finding.filter("source = 'ai'").orderBy(*order).limit(200)  # the numbering below is over these rows alone
    return top.select(F.row_number().over(Window.orderBy(*order)).alias("place"), "pos")


@query("sort_confidence", "select pos from finding order by confidence, severity, file_path, line, pos limit 50")
def _(t):
    return t.finding.orderBy("confidence", "severity", "file_path", "line", "pos").limit(50).select("pos")


@query("prioritize", f"select pos, round(confidence * (5 - {_SEV}), 6) as score from finding order by is_hallucination, score desc, pos limit 100")
def _(t):
    score = F.round(F.col("confidence") * (5 - X.severity_order(F.col("severity"))), 6)
    return t.finding.withColumn("score", score).orderBy("is_hallucination", F.desc("score"), "pos").limit(100).select("pos", "score")


@query("top_share", "select pos from (select pos, row_number() over (order by confidence desc, pos) n, count(*) over () c from finding) where n <= greatest(1, floor(0.3 * c))")
def _(t):
    return Y.top_share(t.finding, "confidence", "pos", 0.3).select("pos")


@query("top_per_file", "select file_path, pos, nth from (select file_path, pos, row_number() over (partition by file_path order by confidence desc, line, pos) nth from finding) where nth <= 3")
def _(t):
    return O.top_per(t.finding, ["file_path"], [F.desc("confidence"), "line", "pos"], 3).select("file_path", "pos", "nth")


@query("latest_per_level", "select verification_level, arg_max(pos, pos) as pos from finding where verification_level is not null group by 1")
def _(t):
    return t.finding.filter("verification_level is not null").groupBy("verification_level").agg(F.max_by("pos", "pos").alias("pos"))


@query("line_context", "select file_path, pos, list(code_snippet) over (partition by file_path order by line, pos rows between 2 preceding and 2 following) as context from finding")
def _(t):
    w = Window.partitionBy("file_path").orderBy("line", "pos").rowsBetween(-2, 2)
    return t.finding.select("file_path", "pos", F.collect_list("code_snippet").over(w).alias("context"))


@query("partition_max", "select pos, confidence / nullif(max(confidence) over (partition by file_path), 0) as relative from finding")
def _(t):
    return t.finding.select("pos", F.try_divide("confidence", F.max("confidence").over(Window.partitionBy("file_path"))).alias("relative"))


@query("conflicts", "select a.signal_id, a.pos as pos_a, b.pos as pos_b, k as kind from signal a join signal b on a.signal_id = b.signal_id and a.pos < b.pos, (values ('state_conflict'), ('confidence_conflict')) x(k) where ((k = 'state_conflict' and a.state <> b.state) or (k = 'confidence_conflict' and abs(a.confidence - b.confidence) > 0.3))")
def _(t):
    return O.conflicts(t.signal)


@query(
    "conflict_counts",
    """with k as (select signal_id, state, confidence, count(*) as n, min(pos) as first_pos from signal group by 1, 2, 3)
    select a.signal_id, a.state, a.confidence, any_value(a.n) as n, any_value(a.first_pos) as first_pos, coalesce(sum(b.n) filter (b.state <> a.state), 0)::bigint as n_state, coalesce(sum(b.n) filter (round(abs(b.confidence - a.confidence), 9) > 0.3::double), 0)::bigint as n_confidence
    from k a join k b on a.signal_id = b.signal_id group by 1, 2, 3""",
)
def _(t):
    return O.conflict_counts(t.signal)


@query("consensus", "select signal_id, count(*) as n, max(confidence) - min(confidence) <= 0.2 + 1e-12 as agreed from signal group by 1")
def _(t):
    return O.consensus(t.signal)


@query("upper_medians", "select finding_id, list_sort(list(confidence))[len(list(confidence)) // 2 + 1] as median, mode_count from (select *, count(*) over (partition by finding_id) as mode_count from vote) group by finding_id, mode_count")
def _(t):
    return Y.upper_median(t.vote, ["finding_id"], "confidence").select("finding_id", "median", F.col("n").alias("mode_count"))


@query("median_rows", "select finding_id, pos, confidence from (select *, row_number() over (partition by finding_id order by confidence, pos) as i, count(*) over (partition by finding_id) as n from vote) where i = n // 2 + 1")
def _(t):
    return Y.row_at(t.vote, ["finding_id"], "confidence", "pos", F.floor(F.col("n") / 2)).select("finding_id", "pos", "confidence")


@query("position_weighted", "select finding_id, decision, sum(confidence * (1 + (c - nth) / c)) as weight from (select *, row_number() over (partition by finding_id order by pos) nth, count(*) over (partition by finding_id) c from vote) group by 1, 2")
def _(t):
    by = Window.partitionBy("finding_id")
    rows = t.vote.withColumn("nth", F.row_number().over(by.orderBy("pos"))).withColumn("c", F.count("*").over(by))
    return rows.groupBy("finding_id", "decision").agg(F.sum(F.col("confidence") * (1 + (F.col("c") - F.col("nth")) / F.col("c"))).alias("weight"))


@query("largest_group", "select finding_id, decision, n from (select finding_id, decision, count(*) n, row_number() over (partition by finding_id order by count(*) desc, round(sum(confidence), 6) desc, decision) r from vote group by 1, 2) where r = 1")
def _(t):
    by = t.vote.groupBy("finding_id", "decision").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 6).alias("s"))
    return O.first_of(by, ["finding_id"], [F.desc("n"), F.desc("s"), "decision"]).select("finding_id", "decision", "n")


@query("confidence_dispersion", "select agent_id, coalesce(stddev_pop(confidence), 0) as dispersion, avg(confidence) as mean from vote group by 1")
def _(t):
    return t.vote.groupBy("agent_id").agg(F.coalesce(F.stddev_pop("confidence"), F.lit(0.0)).alias("dispersion"), F.avg("confidence").alias("mean"))


@query("confusion", "select source, count(*) filter (l.toxic = 1 and contains(d.text, 'the')) as tp, count(*) filter (l.toxic = 0 and contains(d.text, 'the')) as fp, count(*) filter (l.toxic = 1 and not contains(d.text, 'the')) as fn, count(*) filter (l.toxic = 0 and not contains(d.text, 'the')) as tn from documents d join labels l on l.doc_id = d.doc_id group by 1")
def _(t):
    hit, toxic = F.contains("text", F.lit("the")), F.col("toxic") == 1
    rows = t.documents.join(t.labels, "doc_id")
    return rows.groupBy("source").agg(F.count_if(toxic & hit).alias("tp"), F.count_if(~toxic & hit).alias("fp"), F.count_if(toxic & ~hit).alias("fn"), F.count_if(~toxic & ~hit).alias("tn"))


@query("rule_improvements", "select rule_id, avg(case when status = 'REJECTED' then 1.0::double else 0 end) as fp_rate, count(*) as total from finding group by 1 having avg(case when status = 'REJECTED' then 1.0::double else 0 end) > 0.2 or (avg(case when status = 'CONFIRMED' then 1.0::double else 0 end) < 0.1 and count(*) > 10)")
def _(t):
    rate = lambda s: F.avg(F.when(F.col("status") == s, 1.0).otherwise(0.0))
    out = t.finding.groupBy("rule_id").agg(rate("REJECTED").alias("fp_rate"), rate("CONFIRMED").alias("tp_rate"), F.count("*").alias("total"))
    return out.filter("fp_rate > 0.2 or (tp_rate < 0.1 and total > 10)").drop("tp_rate")


@query("pattern_counts", "select substr(sha256(code_snippet), 1, 16) as pattern, count(*) as n from finding group by 1 order by n desc, pattern limit 50")
def _(t):
    return t.finding.groupBy(F.substring(F.sha2("code_snippet", 256), 1, 16).alias("pattern")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pattern").limit(50)

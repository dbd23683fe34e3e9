"""Queries of the text, version, pattern and scoring expressions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftkite.functions import findings as X
from siftkite.functions import scoring as S
from siftkite.functions import text as T
from siftkite.functions import versions as V
from siftkite.operators import findings as O
from siftkite.operators import retrieval as R
from siftkite.operators import matching as M
from siftkite.operators import patterns as P
from siftkite.operators import screening as SC
from siftkite.plans.registry import query


@query("text_clean", "select page_id, trim(regexp_replace(regexp_replace(html, '\\s+', ' ', 'g'), '<[^>]+>', '', 'g')) as plain, case when length(url) > 20 then url[1:20] || '...' else url end as short, url[1:4] || repeat('*', length(url) - 4) as masked from pages")
def _(t):
    return t.pages.select("page_id", T.strip_tags(F.col("html")).alias("plain"), T.truncate(F.col("url"), 20).alias("short"), T.mask(F.col("url")).alias("masked"))


@query("char_chunks", "select doc_id, i as start, substr(text, i + 1, 500) as content from (select doc_id, text, unnest(range(0, greatest(length(text), 1), 450)) as i from documents where length(text) > 0)")
def _(t):
    return t.documents.select("doc_id", F.explode(T.char_chunks(F.col("text"), 500, 50)).alias("c")).select("doc_id", F.col("c.start").cast("long").alias("start"), "c.content")


@query("chunk_stats", "with c as (select doc_id, length(substr(text, i + 1, 500)) as n from (select doc_id, text, unnest(range(0, length(text), 450)) as i from documents where length(text) > 0)) select count(*) as chunks, avg(n) as avg_size, max(n) as max_size, min(n) as min_size from c")
def _(t):
    c = t.documents.select(F.explode(T.char_chunks(F.col("text"), 500, 50)).alias("c")).select(F.length("c.content").alias("n"))
    return c.agg(F.count("*").alias("chunks"), F.avg("n").alias("avg_size"), F.max("n").alias("max_size"), F.min("n").alias("min_size"))


@query("line_chunks", "with l as (select doc_id, string_split(text, chr(10)) as lines from documents), s as (select doc_id, lines, unnest(range(0, len(lines), 8)) as i from l) select doc_id, i + 1 as first_line, least(i + 10, len(lines)) as last_line, md5('d' || doc_id || ':' || (i + 1) || '-' || least(i + 10, len(lines))) as chunk_id, array_to_string(lines[i + 1:i + 10], chr(10)) as content from s where i = 0 or i + 2 < len(lines)")
def _(t):
    path = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    return t.documents.select("doc_id", F.explode(T.line_chunks(F.col("text"), path, 10, 2)).alias("c")).select("doc_id", "c.*")


@query("sentence_packing")
def _(t):
    return t.documents.select("doc_id", F.posexplode(T.pack_sentences(F.col("text"), 400)).alias("nth", "content"))


@query("word_overlap", "select a.doc_id, b.doc_id as next_id, len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) as similarity from (select doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) x from documents) a join (select doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) y from documents) b on b.doc_id = a.doc_id + 1 where len(list_concat(x, y)) > 0")
def _(t):
    d = t.documents.select("doc_id", "text")
    pairs = d.join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("after")), "doc_id")
    tokens = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9_]+"), 0))
    pairs = pairs.select("doc_id", tokens("text").alias("x"), tokens("after").alias("y")).withColumn("n", F.size(F.array_union("x", "y"))).filter("n > 0")
    return pairs.select("doc_id", (F.col("doc_id") + 1).alias("next_id"), (F.size(F.array_intersect("x", "y")) / F.col("n")).alias("similarity"))


@query("near_names", "select a.p_partkey, b.p_partkey as other, levenshtein(a.p_name, b.p_name) as distance, 1 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name)) as similarity from part a join part b on a.p_brand = b.p_brand and a.p_type = b.p_type and a.p_size = b.p_size and a.p_partkey < b.p_partkey")
def _(t):
    part, by = t.part.select("p_partkey", "p_name", "p_brand", "p_type", "p_size"), ["p_brand", "p_type", "p_size"]
    pairs = R.pairs_within(part, by, "p_partkey", {"p_partkey": "other", "p_name": "o_name"})
    a, b = F.col("p_name"), F.col("o_name")
    rows = R.by_kind(pairs, part.select(*by, "p_name").distinct(), "p_name", "o_name", by, lambda x: x.select(a, b, T.edit_distance(a, b).alias("distance"), T.edit_similarity(a, b).alias("similarity")))
    return rows.select("p_partkey", "other", "distance", "similarity")


@query("typosquatting", "with known as (select distinct p_name as k from part where p_type = 'ECONOMY'), n as (select distinct case when p_size % 2 = 0 then p_name || 's' else replace(p_name, 'l', '1') end as name from part) select name, k as similar_to from n join known on levenshtein(name, k) = 1 or (name = replace(k, 'l', '1') and name <> k)")
def _(t):
    name = F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit("s"))).otherwise(F.regexp_replace("p_name", "l", "1"))
    known = t.part.filter("p_type = 'ECONOMY'").select(F.col("p_name").alias("known"))
    return M.typosquats(t.part.select(name.alias("name")), known, [("l", "1")]).select("name", F.col("known").alias("similar_to"))


@query("locations", "select pos, regexp_extract(location, '^(.*):[^:]*$', 1) as path, coalesce(try_cast(regexp_extract(location, ':([^:]*)$', 1) as int), -1) as line from signal")
def _(t):
    return t.signal.select("pos", X.location_path(F.col("location")).alias("path"), X.location_line(F.col("location")).alias("line"))


@query("normal_paths", "select distinct file_path, lower(substr(regexp_replace(file_path, '^(\\./)+', ''), strpos(lower(regexp_replace(file_path, '^(\\./)+', '')), '/src/') + 1)) as path from finding")
def _(t):
    return t.finding.select("file_path", X.normal_path(F.col("file_path")).alias("path")).distinct()


@query("classify_text", "select doc_id, case when contains(lower(text), 'password') or contains(lower(text), 'token') then 'secret' when contains(lower(text), '@') then 'contact' else 'other' end as kind, len(list_filter(['the','und','que','der'], lambda w: contains(lower(text), w))) / 4 as coverage from documents")
def _(t):
    kind = T.first_keyword(F.col("text"), [("secret", ["password", "token"]), ("contact", ["@"])], "other")
    return t.documents.select("doc_id", kind.alias("kind"), T.coverage(F.col("text"), ["the", "und", "que", "der"]).alias("coverage"))


_LEVEL = "case pos % 7 when 0 then ' HIGH ' when 1 then 'error' when 2 then 'note' when 3 then cast(pos % 11 as string) when 4 then 'odd' when 5 then severity else 'Warning' end"
_TOOL = "case when pos % 2 = 0 then 'bandit' else 'scanner' end"


@query(
    "tool_severities",
    f"""with x as (select distinct {_LEVEL.replace("as string", "as varchar")} as level, {_TOOL} as tool from finding)
    select level, tool, case when tool = 'bandit' and upper(level) in ('HIGH', 'MEDIUM', 'LOW') then lower(level) when lower(trim(level)) = 'error' then 'high' when lower(trim(level)) = 'warning' then 'medium' when lower(trim(level)) in ('note', 'none') then case lower(trim(level)) when 'note' then 'low' else 'info' end
        when try_cast(level as double) >= 9 then 'critical' when try_cast(level as double) >= 7 then 'high' when try_cast(level as double) >= 4 then 'medium' when try_cast(level as double) > 0 then 'low' when try_cast(level as double) is not null then 'info'
        when lower(trim(level)) in ('critical', 'high', 'medium', 'low', 'info') then lower(trim(level)) else 'medium' end as severity from x""",
)
def _(t):
    rows = t.finding.select(F.expr(_LEVEL).alias("level"), F.expr(_TOOL).alias("tool")).distinct()
    return rows.withColumn("severity", X.tool_severity(F.col("level"), F.col("tool")))


@query("cvss_bands", "select cve_id, case when score is null then 'medium' when score >= 9 then 'critical' when score >= 7 then 'high' when score >= 4 then 'medium' else 'low' end as band from cvss")
def _(t):
    return t.cvss.select("cve_id", X.cvss_band(F.col("score")).alias("band"))


_PARTS = "list_transform(list_filter(string_split(regexp_replace({0}, '[^0-9.]', '', 'g'), '.'), lambda x: x <> ''), lambda x: x::bigint)"


@query("version_keys", f"select distinct version, list_concat({_PARTS.format('version')}, [0,0,0,0,0,0,0,0]::bigint[])[1:8] as key, list_concat({_PARTS.format('version')}, [0,0,0,0,0,0,0,0]::bigint[])[1:8] < [3,5,0,0,0,0,0,0]::bigint[] as old from dependency")
def _(t):
    key = V.version_key(F.col("version"))
    return t.dependency.select("version", key.alias("key"), (key < V.version_key(F.lit("3.5"))).alias("old")).distinct()


_REQ = "case pos % 5 when 0 then '>=1.4, <3' when 1 then '~=2.3.1' when 2 then '==2.5' when 3 then '<=4.1' else '3.7' end"


@query("version_specs", f"""with d as (select pos, version, {_REQ} as spec, list_concat({_PARTS.format('version')}, [0,0,0,0,0,0,0,0]::bigint[])[1:8] as k from dependency)
    select pos, spec, case pos % 5 when 0 then k >= [1,4,0,0,0,0,0,0]::bigint[] and k < [3,0,0,0,0,0,0,0]::bigint[] when 1 then k >= [2,3,1,0,0,0,0,0]::bigint[] and k < [2,4,0,0,0,0,0,0]::bigint[]
        when 2 then k = [2,5,0,0,0,0,0,0]::bigint[] when 3 then k <= [4,1,0,0,0,0,0,0]::bigint[] else k = [3,7,0,0,0,0,0,0]::bigint[] end as fits from d""")
def _(t):
    v = F.col("version")
    spec = F.when(F.col("pos") % 5 == 0, ">=1.4, <3").when(F.col("pos") % 5 == 1, "~=2.3.1").when(F.col("pos") % 5 == 2, "==2.5").when(F.col("pos") % 5 == 3, "<=4.1").otherwise("3.7")
    return t.dependency.withColumn("spec", spec).select("pos", "spec", V.matches(v, V.spec_range(F.col("spec"))).alias("fits"))


@query("pattern_scan", r"""select path, line, strpos(text, m) - 1 as col, 'number' as rule_id, m as match from (select path, generate_subscripts(string_split(content, chr(10)), 1) as line, unnest(string_split(content, chr(10))) as text, regexp_extract(unnest(string_split(content, chr(10))), '[0-9]{3,}', 0) as m from file) where m <> '' and not regexp_matches(text, '^\s*(#|//|$)')
    union all select path, line, strpos(text, m) - 1, 'mail', m from (select path, generate_subscripts(string_split(content, chr(10)), 1) as line, unnest(string_split(content, chr(10))) as text, regexp_extract(unnest(string_split(content, chr(10))), '[a-z0-9.]+@[a-z0-9.]+', 0) as m from file where not contains(content, 'token')) where m <> '' and not regexp_matches(text, '^\s*(#|//|$)')""")
def _(t):
    catalog = [P.Pattern("number", "[0-9]{3,}"), P.Pattern("mail", "[a-z0-9.]+@[a-z0-9.]+", safe="token")]
    return P.scan_lines(t.file, catalog, first=True).select("path", "line", "col", "rule_id", "match")


@query("pattern_scores", "select path, 2.0::double * len(regexp_extract_all(content, '[0-9]{3,}')) + 1.0::double * len(regexp_extract_all(content, 'the')) as score, len(regexp_extract_all(content, '[0-9]{3,}')) + len(regexp_extract_all(content, 'the')) as hits from file")
def _(t):
    return P.weighted_score(t.file, [P.Pattern("number", "[0-9]{3,}", weight=2.0), P.Pattern("the", "the", weight=1.0)])


@query("screen_files", "select path, least(1.0::double, case when length(content) < 200 and r = 0 then b * 0.5 else b end) as risk, r as rules from (select path, content, (regexp_matches(content, '[0-9]{16}')::int + regexp_matches(content, '@')::int + regexp_matches(content, 'token')::int) as r, greatest(case when regexp_matches(content, '[0-9]{16}') then 0.5::double else 0 end, case when regexp_matches(content, '@') then 0.3::double else 0 end, case when regexp_matches(content, 'token') then 0.7::double else 0 end) + case when (regexp_matches(content, '[0-9]{16}')::int + regexp_matches(content, '@')::int + regexp_matches(content, 'token')::int) >= 3 then 0.15::double when (regexp_matches(content, '[0-9]{16}')::int + regexp_matches(content, '@')::int + regexp_matches(content, 'token')::int) >= 2 then 0.08::double else 0 end as b from file)")
def _(t):
    return P.screen(t.file, [P.Pattern("card", "[0-9]{16}", weight=0.5), P.Pattern("mail", "@", weight=0.3), P.Pattern("token", "token", weight=0.7)])


_FAMILY = {"source": ["the "], "sink": ["der ", "que "], "sanitizer": ["123"]}


@query("family_lines", "select path, line, family from (select path, generate_subscripts(string_split(content, chr(10)), 1) as line, lower(unnest(string_split(content, chr(10)))) as l from file), (values ('source'), ('sink'), ('sanitizer')) f(family) where (family = 'source' and contains(l, 'the ')) or (family = 'sink' and (contains(l, 'der ') or contains(l, 'que '))) or (family = 'sanitizer' and contains(l, '123'))")
def _(t):
    return P.family_lines(t.file, _FAMILY)


@query("unguarded_flows", "with l as (select path, generate_subscripts(string_split(content, chr(10)), 1) as line, lower(unnest(string_split(content, chr(10)))) as l from file), a as (select path, line from l where contains(l, 'the ')), s as (select path, line from l where contains(l, 'and ')), g as (select path, line from l where contains(l, 'tion')) select a.path, a.line as source_line, min(s.line) as sink_line, exists (select 1 from g where g.path = a.path and g.line > a.line and g.line < min(s.line)) as guarded from a join s on s.path = a.path and s.line >= a.line group by a.path, a.line")
def _(t):
    hits = P.family_lines(t.file, {"source": ["the "], "sanitizer": ["tion"], "sink": ["and "]})
    # at one line a sink comes after a source, whatever the names
    order = F.when(F.col("family") == "source", "a").when(F.col("family") == "sanitizer", "b").otherwise("c")
    return P.unguarded(hits.withColumn("family", order), "a", "c", "b")


@query("page_links", "select page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) as href from pages")
def _(t):
    return P.links(t.pages, "page_id", "html")


@query("libraries", "select lang, name, min(doc_id) as doc_id from (select doc_id, lang, unnest(regexp_extract_all(lower(text), '([a-z]+)tion', 1)) as name from documents) where name <> '' group by 1, 2")
def _(t):
    rows = t.documents.select("doc_id", "lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)tion"), 1)).alias("name"))
    return rows.filter("name <> ''").groupBy("lang", "name").agg(F.min("doc_id").alias("doc_id"))


@query("intents", "select conv_id, turn, case when greatest(q, e, f) = 0 then null when q >= e and q >= f then 'question' when e >= f then 'error' else 'fix' end as intent from (select conv_id, turn, (case when contains(text, '?') then 2 else 0 end) as q, (case when contains(lower(text), 'error') then 1 else 0 end + case when contains(lower(text), 'the') then 1 else 0 end) as e, (case when contains(lower(text), 'que') then 1 else 0 end + case when contains(lower(text), 'der') then 1 else 0 end) as f from conversations)")
def _(t):
    has = lambda w: F.when(F.contains(F.lower("text"), F.lit(w)), 1).otherwise(0)
    q, e, f = F.when(F.contains("text", F.lit("?")), 2).otherwise(0), has("error") + has("the"), has("que") + has("der")
    best = F.greatest(q, e, f)
    return t.conversations.select("conv_id", "turn", F.when(best == 0, None).when(q == best, "question").when(e == best, "error").otherwise("fix").alias("intent"))


@query("turn_entities", "select conv_id, turn, unnest(list_distinct(regexp_extract_all(text, '[0-9]{2,}|[A-Za-z0-9_.]+@[A-Za-z0-9.]+'))) as entity from conversations")
def _(t):
    found = F.array_distinct(F.regexp_extract_all("text", F.lit("[0-9]{2,}|[A-Za-z0-9_.]+@[A-Za-z0-9.]+"), 0))
    return t.conversations.select("conv_id", "turn", F.explode(found).alias("entity"))


_CVSS = "case when {0} >= 80 then 9.0 + ({0} - 80) / 20 when {0} >= 55 then 7.0 + ({0} - 55) / 24 * 1.9::double when {0} >= 25 then 4.0 + ({0} - 25) / 29 * 2.9::double when {0} >= 1 then 0.1::double + ({0} - 1) / 23 * 3.8::double else 0 end"


@query("risk_scores", f"""with b as (select event_id, case event_id % 4 when 0 then 30.0 when 1 then 22.0 when 2 then 12.0 else 5.0 end + case event_id % 3 when 0 then 20.0 when 1 then 12.0 else 5.0 end + case when event_id % 2 = 0 then 6.0 else 20.0 end + case when event_id % 5 = 0 then 5.0 else 15.0 end + 7.0 as x,
        round_even((case event_id % 4 when 0 then 1.0::double when 1 then 0.6::double when 2 then 0.3::double else 0 end + 0.6::double + 0.3::double) / 3 * 50 + (event_id % 40 + 0.06::double), 2) as i, 30.0 + least(event_id % 5 * 3.0, 10.0) + case when event_id % 7 = 0 then 5.0 else 0 end as p, 40.0 + case when event_id % 9 <= 1 then 15.0 when event_id % 9 <= 3 then 11.0 when event_id % 9 <= 6 then 7.0 else 3.0 end + 5.0 as d from events),
    c as (select *, round_even(0.3::double * x + 0.35::double * i + 0.15::double * p + 0.2::double * d, 2) as score from b)
    select event_id, x as exploitability, i as impact, p as prevalence, d as detectability, score, round(round_even({_CVSS.format('score')}, 1), 1) as cvss, case when score >= 80 then 'critical' when score >= 55 then 'high' when score >= 25 then 'medium' when score >= 1 then 'low' else 'info' end as band from c""")
def _(t):
    e, lit = F.col("event_id"), F.lit
    pick = lambda n, *names: F.element_at(F.array(*map(lit, names)), ((e % n) + 1).cast("int"))
    rows = t.events.select(
        "event_id",
        S.exploitability(pick(4, "network", "adjacent", "local", "physical"), pick(3, "low", "medium", "high"), e % 2 == 0, e % 5 == 0, lit("proof_of_concept")).alias("exploitability"),
        S.impact(pick(4, "high", "medium", "low", "none"), lit("medium"), lit("low"), factors=e % 40 + 0.06).alias("impact"),
        S.prevalence(lit(None).cast("double"), e % 5, e % 7 == 0).alias("prevalence"),
        S.detectability(lit(20.0), lit(10.0), lit(10.0), e % 9, lit(None).cast("double")).alias("detectability"),
    )
    rows = rows.withColumn("score", S.composite({k: F.col(k) for k in S.WEIGHTS}))
    return rows.withColumn("cvss", S.to_cvss(F.col("score"))).withColumn("band", S.composite_band(F.col("score")))


@query("real_risk", "select pos, s as risk, case when s >= 0.7 then 'P0' when s >= 0.5 then 'P1' when s >= 0.3 then 'P2' else 'P3' end as tier from (select pos, line % 11 / 10 * confidence * (0.5::double + col / 24) * (1 - col / 40) as s from finding)")
def _(t):
    score = S.real_risk(F.col("line") % 11, F.col("confidence"), 0.5 + F.col("col") / 24, 1 - F.col("col") / 40)
    return t.finding.select("pos", score.alias("risk"), S.priority_tier(score).alias("tier"))


@query("reachability", "select pos, round(least(1.0::double, least(1.0::double, line % 5 / 3) * greatest(0, 1 - 0.2::double * greatest(col % 6 - 1, 0)) * greatest(0, 1 - 0.3::double * (line % 4)) * 0.9::double), 9) as reach from finding")
def _(t):
    return t.finding.select("pos", F.round(S.reachability(F.col("line") % 5, F.col("col") % 6, F.col("line") % 4, F.lit(0.9)), 9).alias("reach"))


@query("assessments", "select pos, case when is_hallucination then 0 else round((0.4::double * (4 - (list_position(['critical','high','medium','low','info'], severity) - 1)) / 4 + 0.3::double * confidence + 0.2::double * 0.5::double + 0.1::double * confidence) * case when verified then 1.0::double else 0.8::double end, 9) end as score, case severity when 'critical' then 80.0 when 'high' then 24.0 when 'medium' then 8.0 when 'low' then 2.0 else 0.5 end * 1.75 as hours from finding")
def _(t):
    sev = (4 - X.severity_order(F.col("severity"))) / 4
    score = F.round(S.assessment(sev, F.col("confidence"), F.lit(0.5), F.col("confidence"), F.when(F.col("verified"), 1.0).otherwise(0.8), F.col("is_hallucination")), 9)
    h = S.fix_hours(F.col("severity"), F.lit(""))
    return t.finding.select("pos", score.alias("score"), (h["fix"] + h["test"] + h["deploy"]).alias("hours"))


@query("model_costs", "select pos, round(prompt_tokens / 1000 * p + completion_tokens / 1000 * c, 10) as cost from (select *, case when model like 'gpt-4o-mini%' then 0.00015::double when model like 'gpt-4o%' then 0.005::double when model like 'deepseek%' then 0.00027::double else 0.001::double end as p, case when model like 'gpt-4o-mini%' then 0.0006::double when model like 'gpt-4o%' then 0.015::double when model like 'deepseek%' then 0.0011::double else 0.002::double end as c from usage)")
def _(t):
    return t.usage.select("pos", S.cost(F.col("model"), F.col("prompt_tokens"), F.col("completion_tokens")).alias("cost"))


@query(
    "evidence_confidence",
    """with g as (select rule_id, file_path, count(*) as n, avg(coalesce(confidence, 0.5::double)) as m, coalesce(stddev_pop(coalesce(confidence, 0.5::double)), 0) as d,
        0.15::double * count(*) filter (length(code_snippet) > 10) + 0.1::double * count(*) filter (file_path not in ('N/A', 'Unknown', '')) as context, 0.15::double * count(*) filter (length(description) > 20) as clarity from finding group by 1, 2)
    select rule_id, file_path, least(0.95::double, (case when n <= 3 then 0.3::double when n <= 6 then 0.5::double else 0.7::double end * 0.4::double + m * 0.3::double + least(context, 0.3::double) + least(clarity, 0.3::double))
        * case when d < 0.05::double and m > 0.7::double then 0.85::double else 1 end) as confidence from g""",
)
def _(t):
    return O.evidence_by(t.finding, ["rule_id", "file_path"], "confidence", "code_snippet", "file_path", "description", "pos")


@query("file_scores", "select path, round(round_even(0.3::double * r + 0.25::double + 0.2::double * o, 3), 3) as priority, least(1.0::double, r * case when r > 0.7::double then 1.1::double when r > 0.5::double then 1.05::double else 1 end) as adjusted from (select path, (pos % 11)::double / 10 as r, least(0.7::double, 0.1::double * (pos % 9)) + least(0.3::double, 0.05::double * (pos % 8)) as o from file)")
def _(t):
    r, o = F.col("pos") % 11 / 10, S.capped_counts(F.col("pos") % 9, F.col("pos") % 8)
    return t.file.select("path", S.file_priority(r, F.lit(None).cast("double"), o).alias("priority"), S.nonlinear(r, F.lit(0.0)).alias("adjusted"))


@query("line_proximity", "with f as (select path, generate_subscripts(string_split(content, chr(10)), 1) as line, unnest(string_split(content, chr(10))) as text from file), s as (select path, line from f where contains(text, 'tion')) select f.path, f.line, coalesce(max(1 / (1 + 0.15::double * (f.line - s.line) * (f.line - s.line))), 0) as proximity from f left join s on s.path = f.path and abs(s.line - f.line) <= 15 group by 1, 2")
def _(t):
    rows = P.lines_of(t.file).withColumn("sink", F.contains("text", F.lit("tion")))
    near = F.collect_list(F.when(F.col("sink"), F.col("line"))).over(Window.partitionBy("path").orderBy("line").rowsBetween(-15, 15))  # 31 lines at most
    score = F.array_max(F.transform("near", lambda s: 1 / (1 + 0.15 * (F.col("line") - s) * (F.col("line") - s))))
    return rows.withColumn("near", near).select("path", "line", F.coalesce(score, F.lit(0.0)).alias("proximity"))


_RULES = [("card", "[0-9]{16}", 0.5, "CWE-312"), ("mail", "[a-z]+@[a-z]+", 0.3, "CWE-359"), ("token", "token *= *.", 0.75, "CWE-798"), ("word", "tion[.]$", 0.22, "CWE-1")]
_NAMED = "case pos % 6 when 0 then replace(path, '/d', '/auth_d') when 1 then replace(path, '/d', '/db_config') when 2 then path || '.lock' when 3 then path || '.XML' else path end"


def _screen_sql() -> str:
    from siftkite.operators import screening as C

    lists = {k: "(" + ", ".join(f"'{e}'" for e in v) + ")" for k, v in (("high", C.HIGH_EXTENSIONS), ("medium", C.MEDIUM_EXTENSIONS), ("off", C.SKIPPED_EXTENSIONS))}
    boosts = " + ".join(f"case when regexp_matches(name, '{p}') then {w}::double else 0 end" for p, w in C.NAME_BOOSTS)
    counts = ", ".join(f"len(list_filter(lines, lambda x: regexp_matches(x, '{r}'))) as c{i}" for i, (_, r, _, _) in enumerate(_RULES))
    worst = ", ".join(f"case when c{i} > 0 then {w}::double else 0 end" for i, (_, _, w, _) in enumerate(_RULES))
    kinds = " + ".join(f"(c{i} > 0)::int" for i in range(len(_RULES)))
    return f"""with f as (select {_NAMED} as path, string_split(content, chr(10)) as every from file),
    n as (select path, regexp_extract(path, '([^/]*)$', 1) as name, len(every) as n, list_filter(every, lambda x: not regexp_matches(x, '^\\s*(#|//|/\\*|\\*|''|<!--|\\{{#)')) as lines from f),
    e as (select *, lower(regexp_extract(name, '[^.]([.][^.]+)$', 1)) as ext from n),
    c as (select path, name, ext, n, {counts} from e),
    r as (select *, {kinds} as kinds, {" + ".join(f"c{i}" for i in range(len(_RULES)))} as hits, greatest(case when ext in {lists['high']} then 0.05::double when ext in {lists['medium']} then 0.02::double else 0 end + {boosts}, {worst}) as worst from c),
    s as (select *, case when kinds >= 3 then least(worst + 0.15::double, 1) when kinds >= 2 then least(worst + 0.08::double, 1) else worst end * case when n < 10 and hits = 0 then 0.5::double else 1 end as risk, ext in {lists['off']} as skipped from r)
    select path, round(case when skipped then 1 else risk end, 9) as risk, case when skipped then 0 else kinds end as rules, case when skipped then 0 else hits end as hits, case when skipped then 0 else kinds end as weaknesses,
    case when skipped or round(risk, 9) < 0.2 then 'skip' when round(risk, 9) >= 0.6 then 'fast_confirm' else 'proceed' end as decision from s"""


@query("tier_screen", _screen_sql())
def _(t):
    catalog = [P.Pattern(name, regex, weight=weight) for name, regex, weight, _ in _RULES]
    return SC.tier_screen(t.file.withColumn("path", F.expr(_NAMED)), catalog, {name: cwe for name, _, _, cwe in _RULES})


_FAMILIES = {"a": ["the ", "of[.]", "tion"], "b": ["que", "les", "euxqu"], "c": ["und ", "der", "[0-9]{4}"], "d": ["root", "ADMIN", "@"]}
_SCORES = ", ".join("(" + " + ".join(f"regexp_matches(text, '(?i){x}')::int" for x in v) + f") as {k}" for k, v in _FAMILIES.items())


@query(
    "family_levels",
    f"""with s as (select doc_id, {_SCORES} from documents), h as (select *, a + b + c + d as total, (a >= 3)::int + (b >= 3)::int + (c >= 3)::int + (d >= 3)::int as high from s)
    select doc_id, a, b, c, d, total, case when high >= 2 or total >= 8 then 'high' when high >= 1 or total >= 4 then 'medium' else 'low' end as level from h""",
)
def _(t):
    return SC.family_levels(t.documents, F.col("text"), _FAMILIES).select("doc_id", *_FAMILIES, "total", "level")

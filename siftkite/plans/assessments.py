"""Queries of file and exploit scores, tool rules, violated controls, flows of tokens, references, neighbourhoods and mapped lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftkite.functions import findings as N
from siftkite.functions import priorities as P
from siftkite.functions import scoring as S
from siftkite.operators import linking as L
from siftkite.operators import matching as M
from siftkite.operators import patterns as O
from siftkite.plans.registry import query
from siftkite.staging import spread, stage

BUSINESS = ["main", "app", "server", "client", "core", "engine", "manager", "service", "controller", "handler", "client"]
FOLDERS = ["src/Main/app_core", "app/config/security", "lib/util/dto", "api/user_service", "x/repository", "port/gateway", "web/login", "plain"]
NAMES = ["UserController.java", "views.py", "order.router.ts", "Helper.java", "api.py", "auth_filter.js", "a", "jwt_token.py", "@Repository.java", "password.yml"]
PAYLOADS = ["' or 1=1 --", "<script>alert(\"x\");</script>" + "{}[]()$" * 3, "a" * 120, "`|;&" * 60, ""]
CONTEXTS = ["cur.execute(Parameterized)", "shlex.quote(x); whitelist; os.environ", "escape encode sanitize CSP innerText", "config.a settings.b app.config", "realpath canonical", ""]
RULES = ["python.django.sqli.thing", "java.audit.SQL-Injection-x", "java/SqlInjection", "js/csrf-x", "java:S2076", "s3649", "B608", "b3", "security/detect-unsafe-regex", "no-eval", "path\\Xss", "unknown", "cpp/", "x.y.jwt"]
TOOLS = ["semgrep", "codeql cli", "sonarqube", "bandit", "eslint", "other", None]
KINDS = ["sql_injection", "command_injection", "xss", "path_traversal", "ssrf", "deserialization", "xxe", "other"]
CONTROLLED = ["SQL_INJECTION", "XXE", "HARDCODED_CREDENTIALS", "BROKEN_ACCESS_CONTROL", "PROMPT_INJECTION", "OTHER", "SECURITY_MISCONFIGURATION"]
REFERENCES = ["it", " The File ", "those files", "agent3", "S1", "s12", "F2", "gent", "", "nothing at all", "class"]


def _text(s) -> str:
    return "null" if s is None else "'" + s.replace("'", "''") + "'"


def _case(items, of: str = "pos") -> str:
    return f"case {of} % {len(items)} " + " ".join(f"when {i} then {_text(x)}" for i, x in enumerate(items)) + " end"


def _pick(items, of: str = "pos"):
    return F.element_at(F.array(*map(F.lit, items)), (F.col(of) % len(items) + 1).cast("int"))


def _map(table: dict, of: str) -> str:
    return "map {" + ", ".join(f"{_text(k)}: {_text(v) if isinstance(v, str) else v}" for k, v in table.items()) + "}[" + of + "]"


def _list(items) -> str:
    return "[" + ", ".join(_text(x) for x in items) + "]"


def _any(items, of: str = "p") -> str:
    return "(" + " or ".join(f"contains({of}, {_text(x)})" for x in items) + ")"


def _n(items, of: str = "p") -> str:
    return f"len(list_filter({_list(items)}, lambda w: contains({of}, w)))"


_PATH = f"({_case(FOLDERS)} || '/' || {_case(NAMES)})"
_KIND = "case pos % 3 when 0 then 'source' when 1 then 'config' else 'test' end"
_LANG = "case lang when 'en' then 'python' when 'fr' then 'typescript' when 'de' then 'java' else 'javascript' end"
_FILES = f"(select pos, lower({_PATH}) as p, regexp_replace(string_split(lower({_PATH}), '/')[-1], '(.)\\.[^.]+$', '\\1') as s, {_KIND} as k, {_LANG} as l from file)"
_PORT = f"case when {_any(P.PORT_PARTS)} then 0.2 else 0 end"
_ROUTE = f"""case when {_any(P.ROUTE_PARTS)} then 0.25 else 0 end
    + case when k <> 'source' then 0 when {_any(["controller", "handler"])} then 0.3 when {_any(["service", "manager", "business"])} then 0.2 when {_any(["repository", "mapper", "dao"])} then 0.15 else 0 end
    + case when l <> 'java' then 0 when {_any(["@restcontroller", "@requestmapping", "@getmapping", "@postmapping"])} then 0.3 when {_any(["@repository", "@mapper"])} then 0.15 when {_any(["@service", "@component"])} then 0.1 else 0 end
    + case when l in ('javascript', 'typescript') and {_any(["router", "controller", "handler", "middleware"])} then 0.25 else 0 end + case when l in ('javascript', 'typescript') and (s like '%.route' or s like '%.router') then 0.3 else 0 end
    + case when l = 'python' and s in ('views', 'controllers', 'handlers', 'api', 'endpoints') then 0.3 else 0 end + case when l = 'python' and contains(p, 'app.route') then 0.25 else 0 end"""
_GUARD = f"case when {_any(P.GUARD_PARTS)} then 0.15 else 0 end + case when contains(p, 'config') and {_any(['security', 'auth', 'filter', 'cors'])} then 0.2 else 0 end"


def _scored(t):
    path = F.concat(_pick(FOLDERS), F.lit("/"), _pick(NAMES))
    return t.file.select("pos", path.alias("path"), F.expr(_KIND).alias("kind"), F.expr(_LANG).alias("language"))


@query(
    "file_criticality",
    f"""select pos, round(greatest(0, least(1, {_n(BUSINESS)} * 0.1 + case k when 'source' then 0.2 when 'config' then 0.15 else -0.1 end + case when {_any(["entry", "main", "app"])} then 0.15 else 0 end
            + case when {_any(["core", "engine", "service"])} then 0.1 else 0 end))::double, 4) as criticality,
        round(least(1, {_n(P.SENSITIVE_PARTS)} * 0.08 + {_n(P.SENSITIVE_WORDS)} * 0.05 + case when k = 'config' then 0.15 else 0 end
            + case when l = 'python' and {_any(["views.py", "controllers.py", "handlers.py", "api.py"])} then 0.2 else 0 end
            + case when l in ('javascript', 'typescript') and {_any(["route", "controller", "handler", "middleware", "api"])} then 0.15 else 0 end)::double, 4) as sensitivity from {_FILES}""",
)
def _(t):
    path, kind, language = F.col("path"), F.col("kind"), F.col("language")
    return _scored(t).select("pos", P.business_criticality(path, kind, BUSINESS).alias("criticality"), P.security_sensitivity(path, kind, language).alias("sensitivity"))


@query(
    "api_first_scores",
    f"""select pos, round((port * half)::double, 4) as port_config, round(least(1, route)::double, 4) as api_route, round((guard * half)::double, 4) as security_config
    from (select *, case when route = 0 and {_any(P.UTILITY_PARTS)} then 0.5 else 1 end as half from (select pos, p, {_PORT} as port, {_ROUTE} as route, {_GUARD} as guard from {_FILES}))""",
)
def _(t):
    return _scored(t).select("pos", P.api_first(F.col("path"), F.col("kind"), F.col("language")).alias("s")).select("pos", "s.*")


_DEFENCES = " ".join(f"when {_text(k)} then " + " + ".join(f"regexp_matches(c, {_text('(?i)' + r)})::int" for r in v) for k, v in P.DEFENCES.items())


@query(
    "exploit_scores",
    f"""select pos, round(((case when length(y) < 30 then 1.0 when length(y) < 100 then 0.8 when length(y) < 200 then 0.6 when length(y) < 500 then 0.4 else 0.2 end * 0.6
            + case when x < 5 then 1.0 when x < 15 then 0.7 when x < 30 then 0.5 else 0.3 end * 0.4) * 0.3
        + case severity when 'critical' then 1.0 when 'high' then 0.85 when 'medium' then 0.65 when 'low' then 0.45 else 0.3 end * case when pos % 3 = 0 then 0.6 else 1.0 end * case when pos % 4 = 0 and severity <> 'info' then 0.75 else 1.0 end * 0.25
        + case when d = 0 then 0.95 when d = 1 then 0.7 when d = 2 then 0.5 when d <= 4 then 0.3 else 0.1 end * 0.25
        + greatest(0, coalesce({_map(P.PORTABILITY, "k")}, 0.5) - e * 0.05) * 0.2)::double, 4) as score
    from (select *, length(y) - length(regexp_replace(y, '[<>"''\\\\;|&$`(){{}}\\[\\]]', '', 'g')) as x, case k {_DEFENCES} else 0 end as d, {" + ".join(f"regexp_matches(c, {_text(r)})::int" for r in P.ENVIRONMENT)} as e
        from (select pos, severity, {_case(PAYLOADS)} as y, {_case(CONTEXTS)} as c, {_case(KINDS)} as k from finding))""",
)
def _(t):
    score = P.exploit_score(_pick(KINDS), _pick(CONTEXTS), _pick(PAYLOADS), F.col("severity"), F.col("pos") % 3 == 0, (F.col("pos") % 4 == 0) & (F.col("severity") != "info"))
    return t.finding.select("pos", score.alias("score"))


@query(
    "weakness_prevalence",
    f"""select pos, round(least(100, coalesce({_map(S.PREVALENCE, "cwe_id")}, 30) + least(n * 3, 10) + case when pos % 4 = 0 then 5 else 0 end)::double, 2) as prevalence
    from (select *, case when pos % 2 = 0 then case pos % {len(KINDS)} {" ".join(f"when {i} then {len([x for x in ['flask', 'flask', 'axios', 'yaml'] if x in S.STACKS.get(k, [])])}" for i, k in enumerate(KINDS))} end else 0 end as n from finding)""",
)
def _(t):
    stack = F.when(F.col("pos") % 2 == 0, F.array(F.lit("Flask"), F.lit("flask"), F.lit("axios"), F.lit("yaml")))
    return t.finding.select("pos", S.cwe_prevalence(F.col("cwe_id"), F.upper(_pick(KINDS)), stack, F.col("pos") % 4 == 0).alias("prevalence"))


@query(
    "cvss_vectors",
    """select pos, 'CVSS:3.1/AV:' || case when e >= 75 then 'N' when e >= 50 then 'A' when e >= 25 then 'L' else 'P' end || '/AC:' || case when e >= 60 then 'L' else 'H' end
        || '/PR:' || case when e >= 80 then 'N' when e >= 40 then 'L' else 'H' end || '/UI:' || case when e >= 65 then 'N' else 'R' end || '/S:' || case when i >= 75 then 'C' else 'U' end
        || '/C:' || case when i >= 80 then 'H' when i >= 25 then 'L' else 'N' end || '/I:' || case when i >= 80 then 'H' when i >= 50 then 'L' else 'N' end || '/A:' || case when i >= 80 then 'H' when i >= 50 then 'L' else 'N' end as vector
    from (select pos, pos % 101 as e, pos * 7 % 101 as i from finding)""",
)
def _(t):
    return t.finding.select("pos", S.cvss_vector(F.col("pos") % 101, F.col("pos") * 7 % 101).alias("vector"))


def _first(table: dict, test: str) -> str:
    return "list_filter([" + ", ".join(f"{{'k': {_text(k.lower())}, 'v': {_text(v)}}}" for k, v in table.items()) + f"], lambda x: {test})[1].v"


_LAST = r"string_split(replace(r, '\', '/'), '/')[-1]"
_SEMGREP = f"coalesce(list_filter(list_transform(list_reverse(string_split(lower(r), '.')), lambda p: {_map(N.SEMGREP_CWES, 'p')}), lambda v: v is not null)[1], {_first(N.SEMGREP_CWES, 'contains(lower(r), x.k)')})"
_CODEQL = f"coalesce({_map(N.CODEQL_CWES, _LAST)}, {_first(N.CODEQL_CWES, f'x.k = lower({_LAST})')}, {_first(N.CODEQL_CWES, f'contains(lower({_LAST}), x.k) or contains(x.k, lower({_LAST}))')})"
_SONAR = f"coalesce({_map(N.SONAR_CWES, "'S' || regexp_extract(r, '(?i)s([0-9]+)', 1)")}, {_map(N.SONAR_CWES, 'r')})"
_BANDIT = _map(N.BANDIT_CWES, "'B' || regexp_extract(r, '(?i)b([0-9]+)', 1)")
_ESLINT = f"coalesce({_map(N.ESLINT_CWES, 'r')}, {_map(N.ESLINT_CWES, "string_split(r, '/')[-1]")})"


@query(
    "tool_cwes",
    f"""select pos, coalesce(case when t = 'semgrep' then {_SEMGREP} when t = 'codeql cli' then {_CODEQL} when t = 'sonarqube' then {_SONAR} when t = 'bandit' then {_BANDIT} when t = 'eslint' then {_ESLINT}
        else coalesce({_SEMGREP}, {_CODEQL}, {_SONAR}, {_BANDIT}, {_ESLINT}) end, '') as cwe from (select pos, {_case(RULES)} as r, coalesce({_case(TOOLS, "(pos // 14)")}, '') as t from finding)""",
)
def _(t):
    rows = t.finding.withColumn("_t", F.expr("pos div 14"))
    return rows.select("pos", N.tool_cwe(_pick(RULES), _pick(TOOLS, "_t")).alias("cwe"))


@query(
    "violated_controls",
    "select * from ("
    + " union all ".join(
        f"select pos, '{name}' as standard, c as control_id, coalesce({_map(names, 'c')}, {_text(rest)}) as control_name from (select pos, {_map(controls, _case(CONTROLLED))} as c from finding) where c is not null"
        for name, (controls, names, rest) in N.STANDARDS.items()
    )
    + ")",
)
def _(t):
    return t.finding.select("pos", F.explode(N.violations(_pick(CONTROLLED), ["owasp", "CWE", "PCI-DSS", "soc2", "ISO"])).alias("v")).select("pos", "v.*")


_FAMILIES = {"source": ["the "], "sanitizer": ["tion"], "sink": ["and "], "auth": ["zu"]}
_HITS = "select path, line, f as family from (select path, generate_subscripts(string_split(content, chr(10)), 1) as line, lower(unnest(string_split(content, chr(10)))) as t from file), (select unnest(['source', 'sanitizer', 'sink', 'auth']) as f) where contains(t, case f when 'source' then 'the ' when 'sanitizer' then 'tion' when 'sink' then 'and ' else 'zu' end)"


@query(
    "input_flows",
    f"""with h as materialized ({_HITS}), s as (select a.path, a.line, min(g.line) as open_to from h a left join h g on g.path = a.path and g.family = 'sanitizer' and g.line > a.line where a.family = 'source' group by 1, 2)
    select s.path, s.line, s.open_to, count(*) filter (k.line <= coalesce(s.open_to, k.line)) as n_open, count(*) filter (k.line > s.open_to) as n_guarded,
        case when count(*) filter (k.line <= coalesce(s.open_to, k.line)) = 0 then 'LOW' when s.path in (select path from h where family = 'auth') then 'MEDIUM' else 'HIGH' end as risk
    from s join h k on k.path = s.path and k.family = 'sink' group by 1, 2, 3""",
)
def _(t):
    return O.input_flows(O.family_lines(t.file, _FAMILIES))


_CATEGORY = "case event_id % 5 when 0 then 'source' when 1 then 'transform' when 2 then 'sink' when 3 then 'transform' else case when event_id % 35 = 4 then 'sanitizer' else 'source' end end"


@query(
    "token_flows",
    f"""with k as materialized (select user_id as path, event_id * 7919 % 400 as line, event_id as pos, {_CATEGORY} as category from events),
    r as (select path, count(*) filter (c0 = 'source' and c1 = 'transform' and c2 = 'sink') + count(*) filter (c0 = 'source' and c1 = 'sink') + count(*) filter (c0 = 'source' and c1 = 'transform' and c2 = 'transform' and c3 = 'sink') as n_sequences
        from (select path, category as c0, lead(category) over w as c1, lead(category, 2) over w as c2, lead(category, 3) over w as c3 from k window w as (partition by path order by line, pos)) group by 1),
    d as (select a.path, count(*) as n from k a join k b on a.path = b.path and a.category = 'source' and b.category = 'sink' and b.line > a.line
        where not exists (select 1 from k g where g.path = a.path and g.category = 'sanitizer' and g.line > a.line and g.line < b.line) group by 1)
    select r.path, n_sequences, coalesce(n, 0) as n_direct, round(least(1, n_sequences * 0.8 + coalesce(n, 0) * 0.95)::double, 4) as risk_score from r left join d on d.path = r.path""",
)
def _(t):
    tokens = t.events.select(F.col("user_id").alias("path"), (F.col("event_id") * 7919 % 400).alias("line"), F.col("event_id").alias("pos"), F.expr(_CATEGORY).alias("category"))
    return O.token_flows(tokens)


_ENTITIES = "select pos % 23 as scope, case pos % 5 when 0 then 'file' when 1 then 'function' when 2 then 'class' when 3 then 'variable' else 'port' end as type, case when pos % 2 = 0 then 'S' || cast(pos % 31 as string) else 'f' || cast(pos % 7 as string) || '_agent' || cast(pos % 9 as string) end as name, pos % 101 as seen, pos from signal where pos % 3 = 0"


@query(
    "resolved_references",
    f"""with e as materialized ({_ENTITIES.replace(" as string)", " as varchar)")}), q as (select pos, pos % 29 as scope, {_case(REFERENCES)} as reference from vote),
    w as (select *, row_number() over (partition by scope order by seen desc, pos) as n from e),
    u as (select distinct scope, reference, lower(trim(reference)) as low from q),
    p as (select scope, reference, {_map(L.PRONOUNS, "low")} as of from u),
    one as (select p.scope, p.reference, arg_min(name, n) as name from p join w on w.scope = p.scope and n <= 5 and (of = 'entity' or of = type) group by 1, 2),
    two as (select u.scope, u.reference, arg_min(name, (case when e.name <> u.reference then 9 else coalesce(list_position(['file', 'function', 'class', 'variable'], type), 5) end) * 100000000 + e.pos) as name from u join e on e.scope = u.scope and lower(e.name) = lower(u.reference) group by 1, 2),
    three as (select u.scope, u.reference, arg_min(name, e.pos) as name from u join e on e.scope = u.scope and contains(lower(e.name), low) group by 1, 2)
    select q.pos, coalesce(one.name, two.name, three.name) as name from q left join one using (scope, reference) left join two using (scope, reference) left join three using (scope, reference)""",
)
def _(t):
    entities = t.over(_ENTITIES, "signal")
    asked = t.vote.select("pos", (F.col("pos") % 29).alias("scope"), _pick(REFERENCES).alias("reference"))
    return L.resolve_references(asked, entities, scope="scope", key="pos")


@query(
    "neighbourhoods",
    """with i as (select cwe_id, case when cwe_id in ('CWE-7', 'CWE-11', 'CWE-90') then name[1:4] else name end as title, description from cwe), few as (select unnest(['CWE-7', 'CWE-90', 'CWE-3', 'CWE-11', 'CWE-5']) as cwe_id)
    select cwe_id, neighbour, 1.0::double as score from (select a.cwe_id, b.cwe_id as neighbour, row_number() over (partition by a.cwe_id order by b.cwe_id) as n
        from few join i a using (cwe_id) join i b on b.cwe_id <> a.cwe_id and (contains(b.description, a.title) or contains(b.title, a.title))) where n <= 5""",
)
def _(t):
    short = F.when(F.col("cwe_id").isin("CWE-7", "CWE-11", "CWE-90"), F.substring("name", 1, 4)).otherwise(F.col("name"))
    hits = t.spark.createDataFrame([(i, f"CWE-{n}") for i, n in enumerate([7, 90, 3, 11, 5, 8, 9])], "place int, cwe_id string")
    return L.neighbourhood(hits, t.cwe.select("cwe_id", short.alias("title"), "description"), key="cwe_id")


@query("mapped_lines")
def _(t):
    """Every line of every text, every other one said to be three lines further down; every fifth with white space doubled, every seventh cut to its first two thirds."""
    files = stage(spread(t.file.select("path", "content")), "files")  # dealt to all tasks once, and read many times
    lines = files.select("path", F.posexplode(F.split("content", "\n")).alias("i", "text"))
    n = F.length("text")
    snippet = F.when(F.col("i") % 7 == 3, F.substr("text", F.lit(1), (n * 2 / 3).cast("int"))).when(F.col("i") % 5 == 2, F.regexp_replace("text", " ", "  ")).otherwise(F.col("text"))
    asked = lines.select(F.concat_ws(":", "path", "i").alias("key"), "path", snippet.alias("snippet"), F.when(F.col("i") % 2 == 0, F.col("i") + 1).otherwise(F.col("i") + 4).alias("reported"))
    return M.map_lines(asked, files)

"""Queries of what files expose: every file's text with one of some lines of code below it and one of some suffixes, as the tables hold no code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftkite.operators import surfaces as S
from siftkite.plans.registry import query

SUFFIXES = [".yml", ".py", ".java", ".js", ".properties", ".json", ".go", ".cpp", ".env", ".xml", ".txt"]
CODE = [
    "server:\n  name: a\n  port: 9090\nlisten: 81\naddress: https host:8443",
    "server.port=7001\n# port=7\nhttps.port = 8443 tcp\nPORT=5",
    '{"server": {"port": 7002}, "listen": 99}',
    "<port>81</port>\n<http-port>82</http-port> udp",
    "@RestController public class A {\n  ServerBootstrap() .bind(new InetSocketAddress(h, 9000))\n x.port( 12 )",
    "app = Flask(__name__)\n@app.route('/a', methods=['PUT', \"POST\"])\ndef a():\napp.run(host='h', port=5001)",
    "@app.get('/b')\n@app.route( '/c' )\n  path('d', x), url(\"e\")",
    "app.listen(3000)\nconst port = process.env.PORT\napp.set('port', 3001)\n// app.listen(1)\nrouter.post('/q', f)\napp.get(\"/r\", f)",
    'http.ListenAndServe(":8082", nil)\nnet.Listen("tcp", ":8083")',
    "bind(s, htons(77))\nint port = 78;\nlisten(sock, 5)\n/* port = 1 */",
    "port = Math.random()\nos.getenv('PORT')\ntimestamp",
    "class AuthMiddleware\n@CrossOrigin(x)\nclass MySecurityConfig extends WebSecurityConfigurerAdapter\nclass LogFilter extends B\nclass XInterceptor",
    "// public void gone() {\n// more\n  public int kept(int a) {\nprivate void other() {",
    "  @Override\n @Deprecated\n  public String shown (int a)\n@GetMapping(\"/x\")\nprotected  int z( a )",
    "export function f(a) {}\nexports.g = 1\nrouter.get('/z', h)\n  @ApiOperation (v)",
]


def _files(t) -> DataFrame:
    pick = lambda items: F.element_at(F.array(*map(F.lit, items)), (F.col("pos") % len(items) + 1).cast("int"))
    code = pick(CODE)
    whole = F.when(F.col("pos") % len(SUFFIXES) == SUFFIXES.index(".json"), code).otherwise(F.concat(F.col("content"), F.lit("\n"), code))
    path = F.concat(F.lit("app/m"), (F.col("pos") % 7).cast("string"), F.lit("/f"), F.col("pos").cast("string"), pick(SUFFIXES))
    return t.file.select(path.alias("path"), whole.alias("content"), (F.col("pos") % 40).alias("project"))


def _quoted(s: str) -> str:
    return " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in s.split("\n"))


def _regex(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_JSON = SUFFIXES.index(".json")
_LINES = f"""f as materialized (select path || kind as path, kind, project, case when pos % {len(SUFFIXES)} <> {_JSON} then content || chr(10) else '' end || code as content
        from (select pos, 'app/m' || pos % 7 || '/f' || pos as path, pos % 40 as project, content,
            case pos % {len(SUFFIXES)} {" ".join(f"when {i} then '{s}'" for i, s in enumerate(SUFFIXES))} end as kind, case pos % {len(CODE)} {" ".join(f"when {i} then {_quoted(c)}" for i, c in enumerate(CODE))} end as code from file)),
    l as materialized (select path, kind, project, content, string_split(content, chr(10)) as lines, generate_subscripts(string_split(content, chr(10)), 1) as line, unnest(string_split(content, chr(10))) as text from f)"""


def _in(kinds) -> str:
    return "kind in (" + ", ".join(f"'{k}'" for k in kinds) + ")"


def _type_sql() -> str:
    has = lambda *words: " or ".join(f"contains(lower(text), '{w}')" for w in words)
    return f"case when {has('ssl', 'tls', 'https')} then 'https' when {has('udp', 'datagram')} then 'udp' when {has('tcp', 'http', 'web')} then 'tcp' when {has('api')} then 'http' else 'unknown' end"


def _ports_sql() -> str:
    fixed = {"code_java_netty": "'tcp'", "code_cpp": "'tcp'"}
    parts = []
    for g in S.PORT_GROUPS + S.DYNAMIC_GROUPS:
        for name, regex in g.patterns:
            bare = g.source == "code_java_spring" or g.source.startswith("dynamic") or "(\\d+)" not in regex
            port = "''" if bare else f"regexp_extract(text, {_regex(regex)}, 1)"
            kind = "'unknown'" if g.source.startswith("dynamic") else _type_sql() if g.source.startswith("config") else fixed.get(g.source, "'http'")
            if g.source.startswith("dynamic") or (bare and g.source.startswith(("code_python", "code_cpp"))):
                protocol = "'dynamic'"
            elif g.source == "code_node_express":
                protocol = "'dynamic'" if "dynamic" in name else "case when contains(text, 'process.env') then 'dynamic' else 'static' end"
            else:
                protocol = "'static'"
            parts.append(f"select path, line::int as line, {port} as port, {kind} as port_type, '{g.source}' as source, {protocol} as protocol, '{name}' as pattern from l where {_in(g.suffixes)} and not regexp_matches(text, {_regex(g.skip)}) and regexp_matches(text, {_regex(regex)})")
    return f"with {_LINES} " + " union all ".join(parts)


def _routes_sql() -> str:
    listed = r"regexp_extract(text, 'methods\s*=\s*\[([^\]]+)\]', 1)"
    own = f"""list_transform(string_split({listed}, ','), lambda x: regexp_replace(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), '^["'']+|["'']+$', '', 'g'))"""
    parts = []
    for kinds, table, named in (([".py"], S.FLASK_ROUTES, True), ([".py"], S.FASTAPI_ROUTES, False), ([".py"], S.DJANGO_ROUTES, False), ([".js", ".ts"], S.EXPRESS_ROUTES, False)):
        for regex, methods in table.items():
            each = str(methods)
            if named:
                each = f"case when contains(text, 'methods=') and {listed} <> '' then {own} else {each} end"
            parts.append(f"select path, line::int as line, regexp_extract(text, {_regex(regex)}, 1) as route, unnest({each}) as method from l where {_in(kinds)} and regexp_matches(text, {_regex(regex)})")
    return f"with {_LINES} " + " union all ".join(parts)


def _components_sql() -> str:
    ports = ", ".join(f"regexp_extract(x, {_regex('(?i)' + r)}, 1)" for r in S.SERVER_PORTS)
    named = f"list_filter(list_transform(flatten(list_transform(list_filter(lines, lambda x: not regexp_matches(x, {_regex(S.HASH)})), lambda x: [{ports}])), lambda p: try_cast(p as int)), lambda p: p between 1 and 65535)[1]"
    json = "case when json_valid(content) then coalesce(try_cast(content ->> '$.server.port' as int), try_cast(content ->> '$.port' as int)) end"
    yaml = r"try_cast(regexp_extract(content, '(?m)^server:[ \t]*\n(?:[ \t]+.*\n|[ \t]*\n)*?[ \t]+port:[ \t]*(\d+)[ \t]*(?:#.*)?$', 1) as int)"
    port = f"coalesce(case when kind in ('.properties', '.env') then {named} when kind = '.json' then {json} when kind in ('.yml', '.yaml') then {yaml} end, 8080)"
    parts = []
    for kind, table in S.COMPONENTS.items():
        for label, regex in table:
            r = _regex("(?i)" + regex)
            if kind == "route_handler":
                name = f"regexp_extract(text, {r}, 2)" if label.startswith("express") or "rest_mapping" in label else r"regexp_replace(text, '^\s+|\s+$', '', 'g')[1:50]"
            else:
                name = rf"coalesce(nullif(regexp_extract(text, 'class\s+(\w+)', 1), ''), nullif(regexp_extract(text, '@(\w+)', 1), ''), '{kind}')"
            parts.append(f"select path, port, line::int as line, '{kind}' as component_type, {name} as name, '{label}' as pattern from p where regexp_matches(text, {r})")
    return f"with {_LINES}, p as materialized (select path, {port}::int as port, line, text from l where {_in(S.COMPONENT_FILES)}) " + " union all ".join(parts)


def _entries_sql() -> str:
    kind = " ".join(f"when language = '{lang}' and regexp_matches(text, {_regex(regex)}) then '{name}'" for lang, table in S.ENTRY_POINTS.items() for regex, name in table)
    strip = lambda c: rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
    two, one, own = strip("lines[line - 2]"), strip("lines[line - 1]"), strip("text")
    first, second = f"(line < 3 or {two} like '@%')", f"(line < 2 or {one} like '@%')"
    marks = f"list_filter([case when line >= 3 and {first} then {two} end, case when line >= 2 and {first} and {second} then {one} end, case when {first} and {second} and {own} like '@%' then {own} end], lambda x: x is not null)"
    return rf"""with {_LINES}, g as (select project, min(case kind when '.java' then 0 when '.py' then 1 when '.js' then 2 else 3 end) as least from f group by 1),
        k as (select l.*, case least when 1 then 'python' when 2 then 'javascript' else 'java' end as language from l join g using (project)),
        e as (select *, case {kind} end as kind_of from k)
        select path, line::int as line, coalesce(nullif(case language when 'java' then regexp_extract(text, '(public|private|protected)?\s*\w+\s+(\w+)\s*\(', 2) when 'python' then regexp_extract(text, 'def\s+(\w+)\s*\(', 1) end, ''), 'unknown') as name, kind_of as kind,
        case when contains(text, 'public') then 'public' when contains(text, 'private') then 'private' when contains(text, 'protected') then 'protected' else 'package' end as access, {marks} as annotations from e where kind_of is not null"""


def _commented_sql() -> str:
    word = " or ".join(f"contains(t, '{w}')" for w in S.METHOD_WORDS)
    return rf"""with {_LINES} select path, line::int as line from (select path, line, off, lag(off) over (partition by path order by line) as before
        from (select path, line, t like '//%' as off from (select path, line, regexp_replace(text, '^\s+|\s+$', '', 'g') as t from l) where {word})) where before and not off"""


@query("port_scan", _ports_sql())
def _(t):
    return S.scan_ports(_files(t))


@query("route_scan", _routes_sql())
def _(t):
    return S.scan_routes(_files(t))


@query("component_scan", _components_sql())
def _(t):
    return S.scan_components(_files(t))


@query("entry_point_scan", _entries_sql())
def _(t):
    return S.entry_points(_files(t), project="project")


@query("commented_methods", _commented_sql())
def _(t):
    return S.commented_methods(_files(t))

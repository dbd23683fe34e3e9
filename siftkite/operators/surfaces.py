"""What files expose: ports, routes, components bound to ports, entry points, and methods that are commented out.

Each scan explodes a file's lines once and tries the patterns of the file's kind in built-in expressions; nothing is shuffled. A null text has no lines. `\\w`, `\\d` and `\\s` are ASCII.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Group:
    """Patterns, as (name, regex), for the lines of some kinds of files; lines that match `skip` are passed over. The value is the regex's first group."""

    source: str
    suffixes: tuple[str, ...]
    patterns: tuple[tuple[str, str], ...]
    skip: str = r"^\s*$"


HASH, SLASH, BLOCK = r"^\s*(#|$)", r"^\s*(//|$)", r"^\s*(//|/\*|$)"
CONFIG, CODE = (".yml", ".yaml", ".properties", ".xml", ".json", ".env"), (".java", ".kt", ".py", ".js", ".ts", ".go", ".c", ".cpp", ".h", ".hpp")

# Names and expressions of port settings by kind of file.
YAML_PORTS = (
    ("yaml_server_port", r"server\s*:\s*port\s*:\s*(\d+)"),
    ("yaml_port", r"port\s*:\s*(\d+)"),
    ("yaml_ports", r"ports\s*:\s*(\d+)"),
    ("yaml_http_port", r"http\s*:\s*port\s*:\s*(\d+)"),
    ("yaml_https_port", r"https\s*:\s*port\s*:\s*(\d+)"),
    ("yaml_listen", r"listen\s*:\s*(\d+)"),
    ("yaml_bind", r"bind\s*:\s*(\d+)"),
    ("yaml_address_port", r"address\s*:\s*\S+:(\d+)"),
)
PROPERTIES_PORTS = (
    ("props_server_port", r"server\.port\s*=\s*(\d+)"),
    ("props_port", r"port\s*=\s*(\d+)"),
    ("props_http_port", r"http\.port\s*=\s*(\d+)"),
    ("props_https_port", r"https\.port\s*=\s*(\d+)"),
    ("props_listen_port", r"listen\.port\s*=\s*(\d+)"),
)
JSON_PORTS = (
    ("json_port", r'"port"\s*:\s*(\d+)'),
    ("json_server_port", r'"server"\s*:\s*\{[^}]*"port"\s*:\s*(\d+)'),
    ("json_http_port", r'"http"\s*:\s*\{[^}]*"port"\s*:\s*(\d+)'),
    ("json_https_port", r'"https"\s*:\s*\{[^}]*"port"\s*:\s*(\d+)'),
    ("json_listen", r'"listen"\s*:\s*(\d+)'),
)
XML_PORTS = (
    ("xml_port", r"<port>(\d+)</port>"),
    ("xml_server_port", r"<server-port>(\d+)</server-port>"),
    ("xml_http_port", r"<http-port>(\d+)</http-port>"),
    ("xml_listener_port", r"<listener-port>(\d+)</listener-port>"),
)
ENV_PORTS = (
    ("env_port", r"^PORT\s*=\s*(\d+)"),
    ("env_server_port", r"^SERVER_PORT\s*=\s*(\d+)"),
    ("env_http_port", r"^HTTP_PORT\s*=\s*(\d+)"),
    ("env_https_port", r"^HTTPS_PORT\s*=\s*(\d+)"),
    ("env_listen_port", r"^LISTEN_PORT\s*=\s*(\d+)"),
)
SPRING_PORTS = (
    ("java_rest_controller", r"@RestController[^@]*public\s+class\s+\w+"),
    ("java_request_mapping", r'@RequestMapping[^)]*\([^)]*value\s*=\s*"[^"]*"'),
    ("java_get_mapping", r'@GetMapping[^)]*\([^)]*value\s*=\s*"[^"]*"'),
    ("java_post_mapping", r'@PostMapping[^)]*\([^)]*value\s*=\s*"[^"]*"'),
    ("java_server_port", r"\.port\s*\(\s*(\d+)\s*\)"),
    ("java_server_props_port", r"ServerProperties[^}]*port\s*=\s*(\d+)"),
)
NETTY_PORTS = (
    ("java_netty_bootstrap", r"ServerBootstrap\(\)"),
    ("java_netty_bind", r"\.bind\s*\(\s*new\s+InetSocketAddress\s*\([^,]+,\s*(\d+)\s*\)"),
    ("java_netty_bind_port", r"\.bind\s*\s*(\d+)\s*\)"),
    ("java_netty_local_port", r"\.localAddress\s*\(\s*(\d+)\s*\)"),
)
FLASK_PORTS = (
    ("python_flask_route", r"@app\.route\s*\([^)]*\)"),
    ("python_flask_run_port", r"\.run\s*\([^)]*host\s*=\s*[^,)]*,\s*port\s*=\s*(\d+)"),
    ("python_flask_run_port_short", r"\.run\s*\([^)]*port\s*=\s*(\d+)"),
    ("python_flask_app", r"app\s*=\s*Flask\s*\([^)]*\)"),
    ("python_flask_run_host_port", r"run\s*\(\s*host\s*=\s*[^,)]*,\s*port\s*=\s*(\d+)"),
)
DJANGO_PORTS = (
    ("python_django_runserver", r"python_manage\.py\s+runserver\s+(\d+)"),
    ("django_port_option", r"--port\s*=\s*(\d+)"),
    ("django_port_setting", r"PORT\s*=\s*(\d+)"),
)
EXPRESS_PORTS = (
    ("node_express_listen", r"app\.listen\s*\(\s*(\d+)"),
    ("node_server_listen", r"server\.listen\s*\(\s*(\d+)"),
    ("node_dynamic_port", r"\.listen\s*\(\s*process\.env\.PORT"),
    ("node_port_env", r"const\s+port\s*=\s*process\.env\.PORT"),
    ("node_app_set_port", r"""app\.set\s*\(\s*["']port["']\s*,\s*(\d+)"""),
)
GO_PORTS = (
    ("go_listen_serve", r'http\.ListenAndServe\s*\(\s*"[^"]*:(\d+)"'),
    ("go_listen_serve_short", r'http\.ListenAndServe\s*\(\s*":(\d+)"'),
    ("go_net_listen", r'net\.Listen\s*\(\s*"tcp"\s*,\s*":(\d+)"'),
    ("go_listen_tls", r'ListenAndServeTLS\s*\(\s*"[^"]*:(\d+)"'),
    ("go_listener_listen", r'\.Listen\s*\(\s*":(\d+)"'),
)
CPP_PORTS = (
    ("cpp_socket_bind", r"socket\s*\([^)]*PF_INET[^)]*htons\s*\(\s*(\d+)\s*\)"),
    ("cpp_bind_port", r"bind\s*\([^)]*htons\s*\(\s*(\d+)\s*\)"),
    ("cpp_listen", r"listen\s*\(\s*sock\s*,\s*(\d+)\s*\)"),
    ("cpp_port_assign", r"port\s*=\s*(\d+)"),
)
DYNAMIC_ENV = (
    ("java_system_getenv", r"""System\.getenv\s*\(\s*["']PORT["']"""),
    ("java_system_getproperty", r"""System\.getProperty\s*\(\s*["']port["']"""),
    ("node_env_port", r"process\.env\.PORT"),
    ("node_env_dynamic_port", r"process\.env\.[A-Z_]+PORT"),
    ("python_os_environ", r"""os\.environ\s*\[["']PORT["']\]"""),
    ("python_os_getenv", r"""os\.getenv\s*\(["']PORT["']"""),
    ("python_environ_get", r"""os\.environ\.get\s*\(["']PORT["']"""),
    ("node_env_var_port", r"const\s+\w+\s*=\s*process\.env\.\w+PORT"),
)
DYNAMIC_RANDOM = (
    ("java_math_random", r"Math\.random\s*\(\s*\)"),
    ("java_random_new", r"new\s+Random\s*\(\s*\)"),
    ("java_uuid", r"UUID\.randomUUID\s*\(\s*\)"),
    ("dynamic_timestamp", r"timestamp"),
    ("java_timestamp", r"Timestamp\.now\s*\(\s*\)"),
    ("python_random", r"random\.randint\s*\(\s*\)"),
    ("js_random", r"randomNumber"),
)
DYNAMIC_CONFIG = (
    ("java_config_load", r"ConfigFactory\.load\s*\([^)]*\)"),
    ("python_yaml_load", r"Yaml\s*\.load\s*\([^)]*\)"),
    ("js_json_parse", r"JSON\.parse\s*\([^)]*\)"),
    ("python_json_loads", r"json\.loads\s*\([^)]*\)"),
    ("java_config_manager", r"ConfigurationManager\.getInstance\s*\([^)]*\)"),
)

PORT_GROUPS = [
    Group("config_yaml", (".yml", ".yaml"), YAML_PORTS, HASH),
    Group("config_properties", (".properties",), PROPERTIES_PORTS, HASH),
    Group("config_json", (".json",), JSON_PORTS, HASH),
    Group("config_xml", (".xml",), XML_PORTS, HASH),
    Group("config_env", (".env",), ENV_PORTS, HASH),
    Group("code_java_spring", (".java", ".kt"), SPRING_PORTS),
    Group("code_java_netty", (".java", ".kt"), NETTY_PORTS),
    Group("code_python_flask", (".py",), FLASK_PORTS, HASH),
    Group("code_python_django", (".py",), DJANGO_PORTS, HASH),
    Group("code_node_express", (".js", ".ts"), EXPRESS_PORTS, SLASH),
    Group("code_go", (".go",), GO_PORTS, SLASH),
    Group("code_cpp", (".c", ".cpp", ".h", ".hpp"), CPP_PORTS, BLOCK),
]
DYNAMIC_GROUPS = [
    Group("dynamic_env", CONFIG, DYNAMIC_ENV, HASH),
    Group("dynamic_env", CODE, DYNAMIC_ENV),
    Group("dynamic_config_read", CONFIG, DYNAMIC_CONFIG, HASH),
    Group("dynamic_random", CODE, DYNAMIC_RANDOM),
]

# Expressions of routes by framework, and the methods that each stands for.
FLASK_ROUTES = {
    r"""@app\.route\s*\(\s*["']([^"']+)["'].*?\)""": ["GET", "POST"],
    r"""@app\.get\s*\(\s*["']([^"']+)["'].*?\)""": ["GET"],
    r"""@app\.post\s*\(\s*["']([^"']+)["'].*?\)""": ["POST"],
    r"""@app\.put\s*\(\s*["']([^"']+)["'].*?\)""": ["PUT"],
    r"""@app\.delete\s*\(\s*["']([^"']+)["'].*?\)""": ["DELETE"],
}
FASTAPI_ROUTES = {
    r"""@app\.get\s*\(\s*["']([^"']+)["'].*?\)""": ["GET"],
    r"""@app\.post\s*\(\s*["']([^"']+)["'].*?\)""": ["POST"],
    r"""@app\.put\s*\(\s*["']([^"']+)["'].*?\)""": ["PUT"],
    r"""@app\.delete\s*\(\s*["']([^"']+)["'].*?\)""": ["DELETE"],
    r"""@app\.patch\s*\(\s*["']([^"']+)["'].*?\)""": ["PATCH"],
}
DJANGO_ROUTES = {
    r"""path\s*\(\s*["']([^"']+)["']""": ["GET"],
    r"""url\s*\(\s*["']([^"']+)["']""": ["GET"],
}
EXPRESS_ROUTES = {
    r"""app\.get\s*\(\s*["']([^"']+)["']""": ["GET"],
    r"""app\.post\s*\(\s*["']([^"']+)["']""": ["POST"],
    r"""app\.put\s*\(\s*["']([^"']+)["']""": ["PUT"],
    r"""app\.delete\s*\(\s*["']([^"']+)["']""": ["DELETE"],
    r"""router\.get\s*\(\s*["']([^"']+)["']""": ["GET"],
    r"""router\.post\s*\(\s*["']([^"']+)["']""": ["POST"],
}

# Components by type, matched whatever the case, and expressions of a server's port.
VERBS = "get|post|put|delete|patch|options|head"
MAPPINGS = "GetMapping|PostMapping|PutMapping|DeleteMapping|PatchMapping"
COMPONENTS = {
    "route_handler": (
        ("express_route", rf"""app\.({VERBS})\s*\(\s*["']([^"']+)["']"""),
        ("express_router", rf"""router\.({VERBS})\s*\(\s*["']([^"']+)["']"""),
        ("express_router_template", rf"router\.({VERBS})\s*\(\s*`([^`]+)`"),
        ("flask_route", r"""@app\.route\(["']([^"']+)["']"""),
        ("flask_blueprint", r"""@blueprint\.route\(["']([^"']+)["']"""),
        ("spring_controller", r"@(RestController|Controller)\b"),
        ("spring_request_mapping", r"""@RequestMapping\s*\(\s*value\s*=\s*["']([^"']+)["']"""),
        ("spring_rest_mapping", rf"""@({MAPPINGS})\s*\(\s*value\s*=\s*["']([^"']+)["']"""),
        ("spring_rest_mapping_short", rf"""@({MAPPINGS})\s*\(\s*["']([^"']+)["']"""),
        ("django_path", r"""path\(["']([^"']+)["']"""),
        ("django_re_path", r"""re_path\(["']([^"']+)["']"""),
    ),
    "middleware": (
        ("middleware_class", r"class\s+\w+Middleware"),
        ("middleware_decorator", r"@Middleware\s*\(\s*\)"),
        ("express_middleware", r"""app\.use\s*\(\s*["']([^"']+)["']"""),
        ("express_middleware_fn", r"app\.use\s*\(\s*function"),
        ("middleware_function", r"function\s+\w+\s*\([^)]*\)\s*\{[^}]*next\s*\(\)"),
    ),
    "filter": (
        ("filter_decorator", r"@Filter\s*\(\s*\)"),
        ("filter_class", r"class\s+\w+Filter\s+extends"),
        ("python_filter", r"class\s+\w+Filter\s*:\s*.*Filter"),
        ("handler_filter", r"class\s+\w+HandlerFilter"),
    ),
    "interceptor": (
        ("interceptor_decorator", r"@Interceptor\s*\(\s*\)"),
        ("interceptor_class", r"class\s+\w+Interceptor"),
        ("handler_interceptor", r"class\s+\w+HandlerInterceptorAdapter"),
    ),
    "security_config": (
        ("security_config", r"@Configuration\s*(?:class\s+\w+)?\s*extends\s+WebSecurityConfigurerAdapter"),
        ("security_config_class", r"class\s+\w+SecurityConfig"),
        ("security_config_extends", r"class\s+\w+Config\s*extends\s+WebSecurityConfigurerAdapter"),
        ("enable_web_security", r"@EnableWebSecurity"),
        ("enable_method_security", r"@EnableGlobalMethodSecurity"),
        ("security_keyword", r"SecurityConfig|WebSecurityConfigurerAdapter"),
    ),
    "cors_config": (
        ("cors_annotation", r"@CrossOrigin\s*\("),
        ("cors_configuration", r"CorsConfiguration\s*\("),
        ("cors_middleware", r"cors\s*\(\s*\{"),
        ("cors_keywords", r"allowedOrigins|allowedOriginPatterns|allowedHeaders|allowedMethods|exposedHeaders"),
        ("cors_registry", r"addCorsMappings\s*\(\s*registry"),
    ),
    "swagger_config": (
        ("swagger_api", r"@Api\s*\("),
        ("swagger_operation", r"@ApiOperation\s*\("),
        ("openapi_annotation", r"@OpenAPI\s*\("),
        ("openapi_operation", r"@Operation\s*\("),
        ("swagger_config_class", r"SwaggerConfig|OpenApiConfig"),
        ("api_doc_tool", r"Redoc|scalar"),
    ),
}
SERVER_PORTS = [
    r"server\.port\s*=\s*(\d+)",
    r"port\s*:\s*(\d+)",
    r"listen\s+(\d+)",
    r"""binding\s*:\s*["']?(\d+)""",
    r"--server\.port\s*(\d+)",
    r"process\.env\.PORT\s*=\s*(\d+)",
    r"process\.env\.VITE_SERVER_PORT\s*=\s*(\d+)",
]
COMPONENT_FILES = (".java", ".kt", ".py", ".js", ".ts", ".jsx", ".tsx", ".go", ".rb", ".php", ".cs", ".scala", ".yml", ".yaml", ".json", ".xml", ".properties", ".env")
DEFAULT_PORT = 8080

# Expressions of entry points by language, the first that a line matches gives its kind.
ENTRY_POINTS = {
    "java": [
        (r"@(GetMapping|PostMapping|PutMapping|DeleteMapping|RequestMapping)", "handler"),
        (r"@(RestController|Controller)", "controller"),
        (r"public\s+\w+\s+\w+\s*\(", "public_method"),
    ],
    "python": [
        (r"@(app|router)\.(get|post|put|delete)", "endpoint"),
        (r"def\s+\w+\s*\(", "function"),
    ],
    "javascript": [
        (r"(app|router)\.(get|post|put|delete)\s*\(", "endpoint"),
        (r"function\s+\w+\s*\(", "function"),
        (r"exports?\.\w+\s*=", "exported"),
    ],
}
METHOD_WORDS = ["public", "private", "protected", "def ", "function ", "class "]


def suffix(path: Column) -> Column:
    """The file name's last dot and what follows; '' for a name with no dot or only a leading one."""
    return F.regexp_extract(path, r"[^/](\.[^./]+)$", 1)


def _lines(files: DataFrame, path: str, content: str, kind: Column, kinds: tuple[str, ...], *more: Column) -> DataFrame:
    """path, kind, line and text of the files of some kinds."""
    rows = files.select(F.col(path).alias("path"), kind.alias("kind"), *more, F.col(content).alias("_content")).filter(F.col("kind").isin(*kinds))
    return rows.select(*[c for c in rows.columns if c != "_content"], F.posexplode(F.split("_content", "\n")).alias("_i", "text")).withColumn("line", F.col("_i") + 1).drop("_i")


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _value(regex: str, group: int = 1) -> Column:
    return F.regexp_extract("text", regex, group) if re.compile(regex).groups >= group else F.lit("")


def _kinds(groups: list[Group]) -> tuple[str, ...]:
    return tuple(sorted({s for g in groups for s in g.suffixes}))


def port_type(text: Column) -> Column:
    """The first of https, udp, tcp and http that words of the line speak for, else unknown. A line with http or web is tcp."""
    lower = F.lower(text)
    has = lambda *words: reduce(lambda a, b: a | b, [F.contains(lower, F.lit(w)) for w in words])
    return F.when(has("ssl", "tls", "https"), "https").when(has("udp", "datagram"), "udp").when(has("tcp", "http", "web"), "tcp").when(has("api"), "http").otherwise("unknown")


def scan_ports(files: DataFrame, *, path: str = "path", content: str = "content", dynamic: bool = True) -> DataFrame:
    """path, line, port ('' if none is named), port_type, source, protocol (static, dynamic) and pattern of each expression's first match in each line.

    A line that several expressions match gives several rows. `dynamic` adds ports read from the environment, from configuration or made at random.
    """
    groups = PORT_GROUPS + (DYNAMIC_GROUPS if dynamic else [])

    def hit(g: Group, name: str, regex: str) -> Column:
        port = F.lit("") if g.source in ("code_java_spring", "dynamic_env", "dynamic_config_read", "dynamic_random") else _value(regex)
        static = F.lit("static")
        if g.source.startswith("dynamic"):
            kind, protocol = F.lit("unknown"), F.lit("dynamic")
        elif g.source.startswith("config"):
            kind, protocol = port_type(F.col("text")), static
        elif g.source == "code_node_express":
            kind, protocol = F.lit("http"), F.when(F.contains("text", F.lit("process.env")) | F.lit("dynamic" in name), "dynamic").otherwise("static")
        elif g.source in ("code_python_flask", "code_python_django", "code_cpp"):
            kind, protocol = F.lit("tcp" if g.source == "code_cpp" else "http"), F.when(port == "", "dynamic").otherwise("static")
        else:
            kind, protocol = F.lit("tcp" if g.source == "code_java_netty" else "http"), static
        row = F.struct(port.alias("port"), kind.alias("port_type"), F.lit(g.source).alias("source"), protocol.alias("protocol"), F.lit(name).alias("pattern"))
        return F.when(F.col("kind").isin(*g.suffixes) & ~F.col("text").rlike(g.skip) & F.col("text").rlike(regex), row)

    hits = F.array_compact(F.array(*[hit(g, name, regex) for g in groups for name, regex in g.patterns]))
    return _lines(files, path, content, F.lower(suffix(F.col(path))), _kinds(groups)).select("path", "line", F.explode(hits).alias("h")).select("path", "line", "h.*")


def scan_routes(files: DataFrame, *, path: str = "path", content: str = "content") -> DataFrame:
    """path, line, route and method of the routes in Python and script files, one row for each framework, expression and method.

    A line that is a route of two frameworks counts for both. On lines with `methods=` the list there replaces the methods of the first framework's expressions.
    """
    python, script = [".py"], [".js", ".ts"]
    listed = F.regexp_extract("text", r"methods\s*=\s*\[([^\]]+)\]", 1)
    own = F.transform(F.split(listed, ","), lambda m: F.regexp_replace(_strip(m), r"""^["']+|["']+$""", ""))

    def hit(kinds: list[str], regex: str, methods: list[str], named: bool) -> Column:
        each = F.array(*map(F.lit, methods))
        if named:
            each = F.when(F.contains("text", F.lit("methods=")) & (listed != ""), own).otherwise(each)
        return F.when(F.col("kind").isin(*kinds) & F.col("text").rlike(regex), F.struct(F.regexp_extract("text", regex, 1).alias("route"), each.alias("methods")))

    tables = [(python, FLASK_ROUTES, True), (python, FASTAPI_ROUTES, False), (python, DJANGO_ROUTES, False), (script, EXPRESS_ROUTES, False)]
    hits = F.array_compact(F.array(*[hit(kinds, regex, methods, named) for kinds, table, named in tables for regex, methods in table.items()]))
    rows = _lines(files, path, content, suffix(F.col(path)), (".py", ".js", ".ts")).select("path", "line", F.explode(hits).alias("h"))
    return rows.select("path", "line", F.col("h.route").alias("route"), F.explode("h.methods").alias("method"))


def detect_port(path: Column, content: Column) -> Column:
    """The port that a settings file names, else null: the first of .properties and .env files within 1 to 65535, or server.port, port or ports.http, api or app of JSON, or server.port or port of block YAML."""
    lines = F.filter(F.split(content, "\n"), lambda x: ~x.rlike(HASH))
    regexes = [f"(?i){r}" for r in SERVER_PORTS]
    ports = F.flatten(F.transform(lines, lambda x: F.array(*[F.regexp_extract(x, r, 1) for r in regexes])))
    named = F.get(F.filter(F.transform(ports, lambda p: p.try_cast("int")), lambda p: p.between(1, 65535)), 0)
    whole = lambda key: F.nullif(F.when(F.get_json_object(content, key).rlike(r"^-?\d+$"), F.get_json_object(content, key)).try_cast("int"), F.lit(0))
    json = F.coalesce(*[whole(k) for k in ("$.server.port", "$.port", "$.ports.http", "$.ports.api", "$.ports.app")])
    block = lambda r: F.nullif(F.regexp_extract(content, r, 1).try_cast("int"), F.lit(0))
    yaml = F.coalesce(block(r"(?m)^server:[ \t]*\n(?:[ \t]+.*\n|[ \t]*\n)*?[ \t]+port:[ \t]*(\d+)[ \t]*(?:#.*)?$"), block(r"(?m)^port:[ \t]*(\d+)[ \t]*(?:#.*)?$"))
    is_one = lambda *ends: reduce(lambda a, b: a | b, [F.endswith(path, F.lit(e)) for e in ends])
    return F.when(is_one(".properties", ".env"), named).when(is_one(".json"), json).when(is_one(".yml", ".yaml"), yaml)


def scan_components(files: DataFrame, *, path: str = "path", content: str = "content", default_port: int = DEFAULT_PORT) -> DataFrame:
    """path, port, line, component_type, name and pattern of each component expression's first match in each line, whatever the case.

    port: what the file itself names, else the default. A route handler's name is its path where the expression has a verb and a path, else the line's first 50 characters; others take
    their class, else their annotation, else their type.
    """

    def hit(kind: str, label: str, regex: str) -> Column:
        regex = f"(?i){regex}"
        if kind == "route_handler":
            name = F.regexp_extract("text", regex, 2) if re.compile(regex).groups >= 2 else F.substring(_strip(F.col("text")), 1, 50)
        else:
            some = lambda r: F.nullif(F.regexp_extract("text", r, 1), F.lit(""))
            name = F.coalesce(some(r"class\s+(\w+)"), some(r"@(\w+)"), F.lit(kind))
        return F.when(F.col("text").rlike(regex), F.struct(F.lit(kind).alias("component_type"), name.alias("name"), F.lit(label).alias("pattern")))

    hits = F.array_compact(F.array(*[hit(kind, label, regex) for kind, table in COMPONENTS.items() for label, regex in table]))
    port = F.coalesce(detect_port(F.col(path), F.col(content)), F.lit(default_port)).alias("port")
    return _lines(files, path, content, suffix(F.col(path)), COMPONENT_FILES, port).select("path", "port", "line", F.explode(hits).alias("h")).select("path", "port", "line", "h.*")


def entry_points(files: DataFrame, *, path: str = "path", content: str = "content", project: str | None = None) -> DataFrame:
    """path, line, name, kind, access and annotations of lines that can be called from outside.

    The language is that of the project's files: Java if any is, else Python, else script, else Java. Without a project column each file is its own. annotations: the lines from two above
    to the line itself, up to the first that doesn't begin with @.
    """
    rank = F.when(F.lower(suffix(F.col(path))) == ".java", 0).when(F.lower(suffix(F.col(path))) == ".py", 1).when(F.lower(suffix(F.col(path))).isin(".js", ".ts"), 2).otherwise(3)
    rows = files.select(F.col(path).alias("path"), F.col(content).alias("_content"), rank.alias("_rank"), (F.col(project) if project else F.lit(None).cast("string")).alias("_project"))
    if project:
        least = rows.groupBy("_project").agg(F.min("_rank").alias("_least"))
        rows = rows.withColumnRenamed("_project", "_of").join(least, F.col("_of").eqNullSafe(F.col("_project"))).withColumn("_rank", F.col("_least"))
    language = F.when(F.col("_rank") == 1, "python").when(F.col("_rank") == 2, "javascript").otherwise("java")
    split = rows.select("path", language.alias("language"), F.split("_content", "\n").alias("_all"))
    near = F.transform("_all", lambda x, i: F.struct(x.alias("text"), F.get("_all", i - 2).alias("two"), F.get("_all", i - 1).alias("one")))
    lines = split.select("path", "language", F.posexplode(near).alias("_i", "_x")).select("path", "language", (F.col("_i") + 1).alias("line"), "_x.*")
    kind = F.coalesce(*[F.when((F.col("language") == language) & F.col("text").rlike(regex), kind) for language, table in ENTRY_POINTS.items() for regex, kind in table])
    java = F.regexp_extract("text", r"(public|private|protected)?\s*\w+\s+(\w+)\s*\(", 2)
    name = F.when(F.col("language") == "java", java).when(F.col("language") == "python", F.regexp_extract("text", r"def\s+(\w+)\s*\(", 1)).otherwise("")
    access = F.when(F.contains("text", F.lit("public")), "public").when(F.contains("text", F.lit("private")), "private").when(F.contains("text", F.lit("protected")), "protected").otherwise("package")
    two, one, own = [_strip(F.col(c)) for c in ("two", "one", "text")]
    at = lambda c: F.coalesce(F.startswith(c, F.lit("@")), F.lit(False))
    first, second = F.col("two").isNull() | at(two), F.col("one").isNull() | at(one)
    marks = F.array_compact(F.array(F.when(first, two), F.when(first & second, one), F.when(first & second & at(own), own)))
    out = lines.withColumn("kind", kind).filter("kind is not null")
    return out.select("path", "line", F.coalesce(F.nullif(name, F.lit("")), F.lit("unknown")).alias("name"), "kind", access.alias("access"), marks.alias("annotations"))


def commented_methods(files: DataFrame, *, path: str = "path", content: str = "content") -> DataFrame:
    """path, line of each definition whose nearest definition above is commented out with //. Lines between, definitions or not, don't count if they are comments."""
    word = lambda x: reduce(lambda a, b: a | b, [F.contains(x, F.lit(w)) for w in METHOD_WORDS])
    each = F.transform(F.split(content, "\n"), lambda x, i: F.struct(_strip(x).alias("text"), (i + 1).alias("line")))
    marked = F.transform(F.filter(each, lambda x: word(x["text"])), lambda x: F.struct(x["line"].alias("line"), F.startswith(x["text"], F.lit("//")).alias("off")))
    rows = files.select(F.col(path).alias("path"), marked.alias("_m"))
    found = F.filter(F.transform("_m", lambda x, i: F.when(~x["off"] & F.coalesce(F.get("_m", i - 1)["off"], F.lit(False)), x["line"])), lambda n: n.isNotNull())
    return rows.select("path", F.explode(found).alias("line"))

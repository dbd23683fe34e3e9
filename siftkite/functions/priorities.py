"""Scores and decisions about files, paths, findings and scans as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftkite.functions.scoring import clamp, lookup

# Points of a count above a bound, highest bound first.
LINE_POINTS = [(1000, 0.4), (500, 0.3), (200, 0.2), (100, 0.1)]
BYTE_POINTS = [(100 * 1024, 0.3), (50 * 1024, 0.2), (20 * 1024, 0.1)]
LANGUAGE_POINTS = {"cpp": 0.1, "java": 0.1, "typescript": 0.1, "python": 0.05}
COMMIT_POINTS = [(50, 0.4), (20, 0.3), (10, 0.2), (5, 0.1)]
FIX_POINTS = [(10, 0.3), (5, 0.2), (2, 0.1)]
IMPACT_POINTS = {"critical": 0.4, "high": 0.3, "medium": 0.2, "low": 0.1, "info": 0.0}
EXPLOITABLE_RULES = ["SQL_INJECTION", "COMMAND_INJECTION", "XSS", "SSRF", "INSECURE_DESERIALIZATION"]
WARNING_POINTS = {"critical": 15.0, "high": 10.0, "medium": 5.0, "low": 2.0, "info": 0.5}

# Parts of paths; one that is listed twice counts twice.
SENSITIVE_PARTS = [
    "auth", "login", "password", "credential", "token", "session", "api_key", "secret", "crypto", "encrypt", "decrypt", "hash", "salt", "permission", "privilege", "admin", "root", "sudo", "user",
    "account", "profile", "payment", "transaction", "order", "checkout", "cart", "invoice", "billing", "subscription", "license", "validation", "sanitize", "escape", "filter", "input", "output",
    "request", "response", "header", "cookie", "upload", "download", "file", "path", "url", "redirect", "forward", "proxy", "socket", "network", "database", "query", "sql", "nosql", "cache", "queue",
    "message", "event", "handler", "controller", "route", "endpoint", "api", "rest", "graphql", "rpc", "grpc", "soap", "wsdl", "xmlrpc", "callback", "webhook", "hook", "middleware", "interceptor",
    "filter", "guard", "shield", "barrier", "gate", "wall", "firewall", "waf", "ids", "ips", "siem", "log", "audit", "monitor", "alert", "notify", "report", "analytics", "tracking", "telemetry",
    "metric", "health", "status", "ping", "heartbeat",
]
SENSITIVE_WORDS = [
    "password", "secret", "key", "token", "credential", "auth", "login", "session", "cookie", "header", "input", "request", "query", "sql", "execute", "eval", "system", "subprocess", "shell", "command",
    "inject", "xss", "csrf", "srf", "rce", "lfi", "rfi", "ssrf", "xxe", "sqli", "bypass", "vulnerability", "exploit", "attack", "hack", "malicious", "threat", "risk", "dangerous", "unsafe", "insecure",
    "sensitive", "confidential", "private", "protected", "restricted", "classified", "critical", "important", "valuable",
]
PORT_PARTS = [
    "application.yml", "application.yaml", "application.properties", "config.json", "config.yaml", "config.yml", "application-dev.yml", "application-prod.yml", "application-test.yml", "bootstrap.yml",
    "bootstrap.yaml", "nacos", "apollo", "consul", "etcd", "zookeeper", "port", "server.port", "server.address", "bind.address", "listen", "socket", "endpoint", "gateway", "proxy",
]
ROUTE_PARTS = [
    "restcontroller", "requestmapping", "getmapping", "postmapping", "putmapping", "deletemapping", "patchmapping", "apimapping", "router", "route", "endpoint", "controller", "handler", "view",
    "action", "app.route", "router.post", "router.get", "router.put", "router.delete", "router.patch", "api/", "/api", "rest/", "/rest", "graphql", "grpc", "websocket", "socket.io", "signalr",
]
GUARD_PARTS = [
    "filter", "interceptor", "auth", "authentication", "authorization", "security", "shiro", "springsecurity", "oauth", "jwt", "token", "credential", "permission", "role", "access", "cors", "csrf",
    "xss", "waf", "firewall", "gateway",
]
UTILITY_PARTS = [
    "util", "helper", "tool", "common", "constant", "enum", "model", "dto", "vo", "entity", "object", "bean",
]

# Fixed values of exploit scores.
PAYLOAD_POINTS = [(30, 1.0), (100, 0.8), (200, 0.6), (500, 0.4)]
SPECIAL_POINTS = [(5, 1.0), (15, 0.7), (30, 0.5)]
SPECIAL_CHARS = "<>\"'\\;|&$`(){}[]"
ACCESS_POINTS = {"critical": 1.0, "high": 0.85, "medium": 0.65, "low": 0.45, "info": 0.3}
DEFENCES = {
    "sql_injection": [r"parameterized", r"prepared\s*statement", r"bind\s*param", r"escape_string", r"quote_literal", r"sanitize"],
    "command_injection": [r"shlex\.quote", r"shellescape", r"whitelist", r"allowed_commands", r"safe_list"],
    "xss": [r"escape", r"encode", r"sanitize", r"CSP", r"Content-Security-Policy", r"textContent", r"innerText"],
    "path_traversal": [r"realpath", r"canonical", r"basename", r"allowed_path", r"path_traversal.*check", r"\.\./.*filter"],
    "ssrf": [r"url.*valid", r"whitelist", r"allowed_host", r"dns.*rebind", r"block.*internal", r"private.*ip"],
    "deserialization": [r"ObjectInputFilter", r"serialVersionUID", r"whitelist.*class", r"resolveClass", r"safe.*deserializ"],
    "xxe": [r"FEATURE_SECURE_PROCESSING", r"disallow-doctype-decl", r"external-general-entities.*false", r"external-parameter-entities.*false"],
}
PORTABILITY = {"sql_injection": 0.9, "command_injection": 0.85, "xss": 0.95, "path_traversal": 0.8, "ssrf": 0.7, "deserialization": 0.6, "xxe": 0.75}
ENVIRONMENT = [r"os\.environ", r"System\.getenv", r"process\.env", r"config\.", r"settings\.", r"app\.config"]


def above(value: Column, points: list[tuple[int, float]]) -> Column:
    """The points of the first bound that the value is over; 0 below all, and for null."""
    out = F.when(value > points[0][0], points[0][1])
    for bound, p in points[1:]:
        out = out.when(value > bound, p)
    return out.otherwise(0.0)


def _if(test: Column, points: float) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), points).otherwise(0.0)


def _share(value: Column) -> Column:
    return F.round(clamp(value, 0.0, 1.0), 4)


def file_complexity(lines: Column, size: Column, language: Column) -> Column:
    """Bands of lines and bytes, and of the language; 0 to 1."""
    return _share(above(lines, LINE_POINTS) + above(size, BYTE_POINTS) + lookup(language, LANGUAGE_POINTS, 0.0))


def change_frequency(commits: Column, recent: Column, hotspot: Column, fixes: Column) -> Column:
    return _share(above(commits, COMMIT_POINTS) + _if(recent, 0.2) + _if(hotspot, 0.2) + above(fixes, FIX_POINTS))


def content_score(patterns: Column, complexity: Column, size: Column) -> Column:
    """Half from the number of security patterns, a tenth each, the rest from complexity and size."""
    return F.round(F.least(F.lit(1.0), patterns * 0.1) * 0.5 + complexity * 0.3 + size * 0.2, 4)


def propagation(steps: Column, cross_function: Column, cross_file: Column, sanitizers: Column) -> Column:
    """0 to 10: 5, more for a path that crosses functions and files and has over three steps, half a point less for each sanitizer. Over five steps give no more than over three."""
    length = F.when(cross_file & (steps > 3), 0.2).when(cross_file & (steps > 2), 0.1).otherwise(0.0) + _if(steps > 3, 1.0)
    return F.round(clamp(F.lit(5.0) + _if(cross_function, 2.0) + _if(cross_file, 2.0) + length - sanitizers * 0.5, 0.0, 10.0), 4)


def cross_file_bonus(cross_file: Column, files: Column, steps: Column) -> Column:
    """Within a file 0; else 0.15 and what more files (up to 0.15) and steps (up to 0.1) add to two of each."""
    return F.round(F.when(cross_file, F.lit(0.15) + F.least((files - 1) * 0.05, F.lit(0.15)) + F.least((steps - 2) * 0.03, F.lit(0.1))).otherwise(0.0), 4)


def finding_exploitability(rule: Column, confidence: Column, environment: Column, users: Column) -> Column:
    sure = F.when(F.coalesce(confidence, F.lit(0.5)) >= 0.9, 0.2).when(confidence >= 0.7, 0.1).otherwise(0.0)
    return _share(F.lit(0.5) + sure + _if(rule.isin(EXPLOITABLE_RULES), 0.2) + _if(environment == "production", 0.1) + _if(users == "public", 0.1))


def finding_impact(severity: Column, sensitivity: Column, asset: Column) -> Column:
    return _share(F.lit(0.5) + lookup(F.coalesce(severity, F.lit("medium")), IMPACT_POINTS, 0.0) + _if(sensitivity == "high", 0.1) + _if(asset == "high", 0.1))


def scan_strategy(lines: Column, sinks: Column, risky_calls: Column, complexity: Column) -> Column:
    """FAST for short code, TAINT_FIRST for many sinks or risky calls, DEEP for complex code, else RULE_FIRST."""
    risky = (F.coalesce(sinks, F.lit(0)) > 10) | F.coalesce(risky_calls, F.lit(False))
    return F.when(F.coalesce(lines, F.lit(0)) < 50, "FAST").when(risky, "TAINT_FIRST").when(complexity == "high", "DEEP").otherwise("RULE_FIRST")


def verified_confidence(path: Column, code: Column, cwe: Column, stated: Column) -> Column:
    """A quarter for a valid path, 0.35 for valid code, 0.4 of the CWE match; below 0.6 mixed three to two with the stated confidence (0.5 if none)."""
    seen = _if(path, 0.25) + _if(code, 0.35) + F.greatest(F.coalesce(cwe, F.lit(0.0)), F.lit(0.0)) * 0.4
    return _share(F.when(F.round(seen, 9) >= 0.6, seen).otherwise(seen * 0.6 + F.coalesce(stated, F.lit(0.5)) * 0.4))


def overrides(decision: Column, state: Column) -> Column:
    """Whether a verification decision replaces a state: CONFIRMED and REJECTED any other one, REFINED all but CONFIRMED."""
    state = F.coalesce(state, F.lit("NEW"))
    other = decision.isin("CONFIRMED", "REFINED", "REJECTED") & (decision != state)
    return F.coalesce(other & ~((decision == "REFINED") & (state == "CONFIRMED")), F.lit(False))


def merged_state(decision: Column, state: Column) -> Column:
    return F.when(overrides(decision, state), decision).otherwise(F.coalesce(state, F.lit("NEW")))


def projected_cost(files: Column, tokens_per_file: Column, prompt_share: Column, prompt_price: Column, completion_price: Column) -> Column:
    """USD of scanning so many files: tokens rounded half to even, prices for a thousand."""
    total = F.bround(F.greatest(F.lit(1.0), tokens_per_file) * F.greatest(F.lit(0), files), 0)
    return F.round(F.bround(total * prompt_share, 0) / 1000 * prompt_price + F.bround(total * (1 - prompt_share), 0) / 1000 * completion_price, 4)


def _has(text: Column, parts: list[str]) -> Column:
    """Whether any part occurs; as `_count`, over an array of literals."""
    return F.exists(F.array(*map(F.lit, parts)), lambda w: F.contains(text, w))


def _count(text: Column, parts: list[str]) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, parts)), lambda w: F.contains(text, w)))


def stem(path: Column) -> Column:
    """The file name without its last suffix; a leading dot begins no suffix."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]+$", "")


def business_criticality(path: Column, kind: Column, parts: list[str]) -> Column:
    """0 to 1: a tenth for each of the caller's parts that the path has, whatever the case (a part listed twice counts twice), and points of the kind of file (source, config, test)."""
    low = F.lower(path)
    of_kind = lookup(kind, {"source": 0.2, "config": 0.15, "test": -0.1}, 0.0)
    return _share(_count(low, parts) * 0.1 + of_kind + _if(_has(low, ["entry", "main", "app"]), 0.15) + _if(_has(low, ["core", "engine", "service"]), 0.1))


def security_sensitivity(path: Column, kind: Column, language: Column) -> Column:
    """0 to 1 by parts of the path, whatever the case, the kind of file and handlers of its language."""
    low = F.lower(path)
    handlers = _if((language == "python") & _has(low, ["views.py", "controllers.py", "handlers.py", "api.py"]), 0.2)
    handlers = handlers + _if(language.isin("javascript", "typescript") & _has(low, ["route", "controller", "handler", "middleware", "api"]), 0.15)
    return _share(_count(low, SENSITIVE_PARTS) * 0.08 + _count(low, SENSITIVE_WORDS) * 0.05 + _if(kind == "config", 0.15) + handlers)


def api_first(path: Column, kind: Column, language: Column) -> Column:
    """struct<port_config, api_route, security_config> of 0 to 1 each; a utility's path without any route score halves the others."""
    low = F.lower(path)
    own = stem(low)
    has = lambda *parts: _has(low, list(parts))
    port = _if(_has(low, PORT_PARTS), 0.2)
    role = F.when(has("controller", "handler"), 0.3).when(has("service", "manager", "business"), 0.2).when(has("repository", "mapper", "dao"), 0.15).otherwise(0.0)
    marks = F.when(has("@restcontroller", "@requestmapping", "@getmapping", "@postmapping"), 0.3).when(has("@repository", "@mapper"), 0.15).when(has("@service", "@component"), 0.1).otherwise(0.0)
    route = _if(_has(low, ROUTE_PARTS), 0.25) + F.when(kind == "source", role).otherwise(0.0) + F.when(language == "java", marks).otherwise(0.0)
    script = language.isin("javascript", "typescript")
    route = route + _if(script & has("router", "controller", "handler", "middleware"), 0.25) + _if(script & own.rlike(r"\.router?$"), 0.3)
    route = route + _if((language == "python") & own.isin("views", "controllers", "handlers", "api", "endpoints"), 0.3) + _if((language == "python") & has("app.route"), 0.25)
    guard = _if(_has(low, GUARD_PARTS), 0.15) + _if(has("config") & has("security", "auth", "filter", "cors"), 0.2)
    half = F.when(_has(low, UTILITY_PARTS) & (route == 0), 0.5).otherwise(1.0)
    return F.struct(_share(port * half).alias("port_config"), _share(route).alias("api_route"), _share(guard * half).alias("security_config"))


def exploit_score(kind: Column, context: Column, payload: Column, severity: Column, needs_login: Column, needs_user: Column) -> Column:
    """0 to 1: 0.3 for a short plain payload, a quarter each for what access and which defences stand before it, a fifth for what it needs of its environment. Null texts are empty, a null severity is medium."""
    payload, context = F.coalesce(payload, F.lit("")), F.coalesce(context, F.lit(""))
    below = lambda value, points, rest: reduce(lambda out, p: out.when(value < p[0], p[1]), points[1:], F.when(value < points[0][0], points[0][1])).otherwise(rest)
    special = F.length(payload) - F.length(F.translate(payload, SPECIAL_CHARS, ""))
    plain = below(F.length(payload), PAYLOAD_POINTS, 0.2) * 0.6 + below(special, SPECIAL_POINTS, 0.3) * 0.4
    access = lookup(F.lower(F.coalesce(severity, F.lit("medium"))), ACCESS_POINTS, 0.5) * F.when(needs_login, 0.6).otherwise(1.0) * F.when(needs_user, 0.75).otherwise(1.0)
    hits = lambda regexes: reduce(lambda a, b: a + b, [context.rlike(r).cast("int") for r in regexes])
    n = reduce(lambda out, kv: out.when(kind == kv[0], hits([f"(?i){r}" for r in kv[1]])), list(DEFENCES.items())[1:], F.when(kind == "sql_injection", hits([f"(?i){r}" for r in DEFENCES["sql_injection"]]))).otherwise(0)
    bypass = F.when(n == 0, 0.95).when(n == 1, 0.7).when(n == 2, 0.5).when(n <= 4, 0.3).otherwise(0.1)
    portable = clamp(lookup(kind, PORTABILITY, 0.5) - hits(ENVIRONMENT) * 0.05, 0.0, 1.0)
    return _share(plain * 0.3 + access * 0.25 + bypass * 0.25 + portable * 0.2)


# Weights of each strategy's scores, least totals of the levels.
STRATEGIES = {
    "balanced": {"business": 0.25, "complexity": 0.25, "security": 0.30, "change_frequency": 0.20},
    "security_first": {"business": 0.15, "complexity": 0.15, "security": 0.50, "change_frequency": 0.20},
    "complexity_first": {"business": 0.20, "complexity": 0.40, "security": 0.20, "change_frequency": 0.20},
    "business_first": {"business": 0.40, "complexity": 0.20, "security": 0.20, "change_frequency": 0.20},
    "change_frequency_first": {"business": 0.20, "complexity": 0.20, "security": 0.20, "change_frequency": 0.40},
    "api_first": {"business": 0.0, "complexity": 0.15, "security": 0.25, "change_frequency": 0.0, "port_config": 0.30, "api_route": 0.25, "security_config": 0.05},
}
LEVELS = [(0.8, "critical"), (0.6, "high"), (0.4, "medium"), (0.2, "low")]


def strategy_total(strategy: str) -> Column:
    """The weighted sum of the columns that the strategy names, to nine digits."""
    return F.round(sum((F.coalesce(c, F.lit(0.0)) * w for c, w in STRATEGIES[strategy].items() if w), F.lit(0.0)), 9)


def priority_level(total: Column) -> Column:
    return reduce(lambda out, b: out.when(total >= b[0], b[1]), LEVELS[1:], F.when(total >= LEVELS[0][0], LEVELS[0][1])).otherwise("info")

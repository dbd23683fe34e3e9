"""The vulnerability, finding, vote and usage tables that the registered queries run on, made from the test tables.

Each is one SELECT that Spark and DuckDB read alike, so a query and its SQL start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from siftkite.staging import tasks_for

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

_CONF = "cast(cast(floor(value * 100) as bigint) % 101 as double) / 100"
_SEV = "case {0} % 5 when 0 then 'critical' when 1 then 'high' when 2 then 'medium' when 3 then 'low' else 'info' end"

ROLES: dict[str, str] = {
    "cve": "select 'CVE-2020-' || cast(1000000 + o_orderkey as string) as cve_id, o_orderstatus || ' issue of priority ' || o_orderpriority as description, o_orderdate as published_date, o_orderdate as last_modified from orders",
    "cvss": "select 'CVE-2020-' || cast(1000000 + o_orderkey as string) as cve_id, cast(cast(floor(o_totalprice) as bigint) % 101 as double) / 10 as score, case when cast(floor(o_totalprice) as bigint) % 101 >= 90 then 'CRITICAL' when cast(floor(o_totalprice) as bigint) % 101 >= 70 then 'HIGH' when cast(floor(o_totalprice) as bigint) % 101 >= 40 then 'MEDIUM' else 'LOW' end as severity, '3.1' as version from orders where o_orderstatus <> 'P'",
    "kev": "select 'CVE-2020-' || cast(1000000 + o_orderkey as string) as cve_id, o_totalprice > 200000 as exploited, cast(o_orderdate as date) as due_date from orders where o_orderpriority = '1-URGENT'",
    "exploit": "select l_orderkey * 10 + l_linenumber as id, 'CVE-2020-' || cast(1000000 + l_orderkey as string) as cve_id, l_returnflag as platform, l_linestatus as exploit_type, l_linenumber = 1 as verified from lineitem where l_returnflag = 'R'",
    "poc": "select l_orderkey * 10 + l_linenumber as id, 'CVE-2020-' || cast(1000000 + l_orderkey as string) as cve_id, 'https://code.example.com/r' || cast(l_partkey as string) as repo_url, cast(l_quantity as int) as stars, l_returnflag as language from lineitem where l_linestatus = 'O'",
    "cwe": "select 'CWE-' || cast(p_partkey as string) as cwe_id, p_name as name, p_type as status, p_name || ' weakness in ' || p_brand as description from part",
    "cve_cwe": "select distinct 'CVE-2020-' || cast(1000000 + l_orderkey as string) as cve_id, 'CWE-' || cast(l_partkey as string) as cwe_id, l_linenumber = 1 as is_primary from lineitem",
    "cpe": "select l_orderkey * 10 + l_linenumber as id, 'CVE-2020-' || cast(1000000 + l_orderkey as string) as cve_id, 'vendor' || cast(l_suppkey % 20 as string) as vendor, 'product' || cast(l_partkey % 50 as string) as product, case when l_linenumber % 2 = 0 then cast(l_linenumber as string) || '.' || cast(l_partkey % 12 as string) else '' end as version_start, case when l_partkey % 3 = 0 then cast(l_linenumber + 2 as string) || '.' || cast(l_suppkey % 13 as string) || '.1' end as version_end, case when l_partkey % 2 = 0 then 'including' else 'excluding' end as version_start_type, case when l_suppkey % 2 = 0 then 'including' else 'excluding' end as version_end_type from lineitem",
    "finding": f"select event_id as pos, case event_id % 9 when 0 then 'SQL_INJECTION_' || cast(event_id % 3 + 1 as string) when 1 then 'RemoteTokenServices_SSRF' when 2 then 'RULE_windows' when 3 then 'Spring_Cloud_Vulnerability' when 4 then 'PORT-' || cast(user_id % 4 as string) when 5 then 'API-' || event_type when 6 then 'Hardcoded_secret' when 7 then 'CFG-weakness' else upper(event_type) || '_' || cast(user_id % 3 as string) || '_7' end as rule_id, event_type || ' sql injection near ' || cast(user_id % 7 as string) || ' in config' as description, {_SEV.format('(event_id * 7)')} as severity, './repo/src/d' || cast(user_id % 10 as string) || '/F' || cast(user_id as string) || '.py' as file_path, cast(event_id % 60 as int) as line, cast(event_id % 13 as int) as col, {_CONF} as confidence, 'x = ' || event_type || cast(event_id % 11 as string) as code_snippet, case event_id % 4 when 0 then 'ai' when 1 then 'static' when 2 then 'tool' end as source, event_id % 3 = 0 as verified, case event_id % 5 when 0 then 'CONFIRMED' when 1 then 'REFINED' when 2 then 'REJECTED' when 3 then 'UNCERTAIN' end as status, case event_id % 6 when 0 then 'triple_verified' when 1 then 'double_verified' when 2 then 'single_verified' when 3 then 'unverified' when 4 then 'unknown' end as verification_level, event_id % 7 = 0 as is_hallucination, case when event_id % 8 = 0 then 'UNVERIFIED_RISK' else event_type end as title, case when event_id % 3 = 0 then 'CWE-' || cast(event_id % 40 as string) end as cwe_id from events",
    "vote": f"select event_id as pos, 'A' || cast(user_id % 7 as string) as agent_id, 'F' || cast(event_id % 499 as string) as finding_id, case event_id % 7 when 0 then 'REJECTED' when 1 then 'REFINED' when 2 then 'REJECTED' else 'CONFIRMED' end as decision, {_CONF} as confidence, {_SEV.format('event_id')} as severity, cast(floor(value * 10) as bigint) as execution_time_ms, cast(user_id as bigint) as token_cost from events",
    "signal": "select event_id as pos, 'S' || cast(user_id as string) as signal_id, ts, event_type as agent, case event_id % 5 when 0 then 'NEW' when 1 then 'CONFIRMED' when 2 then 'REFINED' when 3 then 'UNCERTAIN' else 'REJECTED' end as state, event_type || ' risk ' || cast(user_id % 5 as string) as description, 'f' || cast(user_id % 20 as string) || '.py:' || cast(event_id % 9 as string) as location, " + _CONF + " as confidence from events",
    "usage": "select event_id as pos, ts, 'agent' || cast(user_id % 5 as string) as agent, event_type as step, case user_id % 3 when 0 then 'deepseek-chat' when 1 then 'gpt-4o-mini' else 'local' end as model, cast(floor(value * 10) as bigint) as prompt_tokens, cast(user_id * 3 as bigint) as completion_tokens, value as latency, event_id % 11 <> 0 as success, 'session' || cast(user_id % 4 as string) as session_id, 'f' || cast(user_id as string) as file_path, event_id % 4 = 0 as cache_hit from events",
    "dependency": "select l_orderkey * 10 + l_linenumber as pos, 'pkg' || cast(l_partkey % 300 as string) as name, case l_suppkey % 3 when 0 then 'pypi' when 1 then 'npm' else 'maven' end as ecosystem, cast(l_linenumber as string) || '.' || cast(l_partkey % 12 as string) || case when l_suppkey % 4 = 0 then '.' || cast(l_suppkey as string) else '' end as version, case when l_linenumber = 1 then 'direct' else 'transitive' end as dependency_type from lineitem",
    "file": "select doc_id as pos, 'src/' || lang || '/' || source || '/d' || cast(doc_id as string) || case lang when 'en' then '.py' when 'fr' then '.js' when 'de' then '.java' else '.yaml' end as path, text as content, lang, n_chars as size from documents",
}

_NEEDS = {"cve": ["orders"], "cvss": ["orders"], "kev": ["orders"], "exploit": ["lineitem"], "poc": ["lineitem"], "cwe": ["part"], "cve_cwe": ["lineitem"], "cpe": ["lineitem"], "finding": ["events"], "vote": ["events"], "signal": ["events"], "usage": ["events"], "dependency": ["lineitem"], "file": ["documents"]}


def with_roles(sql: str) -> str:
    """The SQL with the roles it names put before it, for DuckDB."""
    named = set(re.findall(r"\b\w+\b", sql))
    parts = [f"{r} as ({q.replace(' as string)', ' as varchar)')})" for r, q in ROLES.items() if r in named]
    if not parts:
        return sql
    body = re.sub(r"^\s*with\b", ",", sql, count=1, flags=re.I) if re.match(r"\s*with\b", sql, re.I) else sql
    return "with " + ", ".join(parts) + body if body.startswith(",") else "with " + ", ".join(parts) + " " + body


class Tables:
    """The test tables and roles of one directory as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in ROLES:
            return self.distinct(ROLES[name], *_NEEDS[name]) if ROLES[name].startswith("select distinct ") else self.over(ROLES[name], *_NEEDS[name])
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        raise AttributeError(name)

    def distinct(self, sql: str, name: str) -> DataFrame:
        """A SELECT DISTINCT over one table. Its rows are dealt by their first column to as many tasks as they ask for, where these are more than the session's, so that what one task holds does not grow with the table."""
        tasks = tasks_for(getattr(self, name))
        if tasks <= int(self.spark.conf.get("spark.sql.shuffle.partitions")):
            return self.over(sql, name)
        rows = self.over(sql.replace("select distinct ", "select ", 1), name)
        return rows.repartition(tasks, rows.columns[0]).distinct()

    def over(self, sql: str, *names: str) -> DataFrame:
        """A SELECT whose FROM clauses name tables or roles, run on these and not on the session's views of the names."""
        for n in names:
            sql = re.sub(rf"\bfrom {n}\b", f"from {{{n}}}", sql)
        return self.spark.sql(sql, **{n: getattr(self, n) for n in names})


__all__ = ["ROLES", "Tables", "with_roles"]

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from siftkite.functions import versions as V
from siftkite.operators import plugins
from siftkite.operators.patterns import Pattern
from siftkite.sources import feeds, sinks


@pytest.fixture
def put(tmp_path):
    def write(name, content):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(content if isinstance(content, str) else json.dumps(content))
        return str(tmp_path)

    return write


def test_cve5(spark, put):
    put("a/CVE-2024-0001.json", {"cveMetadata": {"cveId": "CVE-2024-0001", "datePublished": "2024-01-02T03:04:05Z", "dateUpdated": "bad"}, "containers": {"cna": {"descriptions": [{"lang": "de", "value": "d"}, {"lang": "en", "value": "e"}]}}})
    put("CVE-bad.json", {"cveMetadata": {"cveId": "X-1"}})
    put("other.json", {"cveMetadata": {"cveId": "CVE-2024-0009"}})
    folder = put("b/CVE-2024-0002.json", {"cveMetadata": {"cveId": "CVE-2024-0002"}, "containers": {"cna": {"descriptions": [{"lang": "fr", "value": "f"}]}}})
    rows = {r.cve_id: r for r in feeds.read_cve5(spark, folder).collect()}
    assert set(rows) == {"CVE-2024-0001", "CVE-2024-0002"}
    assert rows["CVE-2024-0001"].description == "e" and rows["CVE-2024-0001"].last_modified is None and rows["CVE-2024-0001"].published_date.hour == 3
    assert rows["CVE-2024-0002"].description == "f"


def test_nvd2(spark, put):
    metric = lambda s, sev=None: [{"cvssData": {"baseScore": s, "baseSeverity": sev, "vectorString": "v", "version": "3"}, "baseSeverity": "MEDIUM"}]
    match = [{"criteria": "cpe:2.3:a:ven:prod:1.0:*", "vulnerable": True, "versionEndIncluding": "2.0"}, {"criteria": "cpe:2.3:o:ven:os:*", "versionStartExcluding": "1", "versionEndExcluding": "3"}]
    cves = [
        {"cve": {"id": "CVE-1", "metrics": {"cvssMetricV30": metric(5.0, "M30"), "cvssMetricV31": metric(9.8, "CRITICAL")}, "configurations": [{"nodes": [{"cpeMatch": match}]}], "descriptions": [{"lang": "en", "value": "x"}], "weaknesses": [{"type": "Primary", "description": [{"lang": "en", "value": "CWE-79"}]}], "references": [{"url": "u"}]}},
        {"cve": {"id": "CVE-2", "metrics": {"cvssMetricV2": metric(4.0)}}},
        {"cve": {"id": "CVE-3"}},
    ]
    nvd = feeds.read_nvd2(spark, put("nvd.json", {"vulnerabilities": cves}) + "/nvd.json")
    assert {(r.cve_id, r.score, r.severity) for r in feeds.nvd2_cvss(nvd).collect()} == {("CVE-1", 9.8, "CRITICAL"), ("CVE-2", 4.0, "MEDIUM")}
    cpe = {r["product"]: r for r in feeds.nvd2_cpe(nvd).collect()}
    assert (cpe["prod"].version, cpe["prod"].version_end, cpe["prod"].version_end_type, cpe["prod"].version_start) == ("1.0", "2.0", "including", None)
    assert (cpe["os"].version_start_type, cpe["os"].version_end_type) == ("excluding", "excluding")
    assert next(r for r in feeds.nvd2_rows(nvd).collect() if r.cve_id == "CVE-1").cwe_id == "CWE-79"


def test_formats(spark, put):
    put("f/a.json", {"vulnerabilities": []})
    put("f/b.json", {"CVE_Items": []})
    put("f/c.json", {"cve": {}, "impact": {}})
    folder = put("f/d.json", {"x": 1})
    got = {r.path.rpartition("/")[2]: r.format for r in feeds.feed_format(spark, folder + "/f").collect()}
    assert got == {"a.json": "v2.0", "b.json": "v1.1_collection", "c.json": "v1.1", "d.json": "unknown"}


def test_cwe_xml(spark, put):
    xml = '<C><Weaknesses><Weakness ID="79" Name="XSS" Abstraction="Base" Status="Stable"><Description>d</Description><Related_Vulnerabilities><Related_Vulnerability CVE_ID="CVE-1" Nature="Primary"/><Related_Vulnerability CVE_ID="CVE-2" Nature="Other"/></Related_Vulnerabilities></Weakness></Weaknesses></C>'
    cwe, links = feeds.read_cwe(spark, put("cwe.xml", xml) + "/cwe.xml")
    assert cwe.first().cwe_id == "CWE-79" and {(r.cve_id, r.is_primary) for r in links.collect()} == {("CVE-1", True), ("CVE-2", False)}


def test_kev_exploits_pocs(spark, put):
    folder = put("kev.json", {"vulnerabilities": [{"cveID": "CVE-1", "dueDate": "2024-02-03"}, {"cveID": ""}, {"notes": "n"}]})
    assert [(r.cve_id, str(r.due_date)) for r in feeds.read_kev(spark, folder + "/kev.json").collect()] == [("CVE-1", "2024-02-03")]
    put("x.csv", 'id,file,description,type,platform,port,codes,verified\n1,f,"a, ""q""\nsee cve-2020-12345",t,p,80,,1\n2,g,none,t,p,,,yes\n3,h,d,t,p,,OSVDB-1;CVE-2021-0001,no\n')
    assert {(r.cve_id, r.verified) for r in feeds.read_exploits(spark, folder + "/x.csv").collect()} == {("CVE-2020-12345", True), ("CVE-2021-0001", False)}
    put("p/a.json", [{"name": "poc CVE-2020-0001", "stargazers_count": 0, "stars": 3}, {"name": "none"}])
    put("p/b.json", {"full_name": "x/cve-2020-0002", "stargazers_count": 5})
    put("p/c.json", '"text"')
    assert {(r.cve_id, r.stars) for r in feeds.read_pocs(spark, folder + "/p").collect()} == {("CVE-2020-0001", 3), ("CVE-2020-0002", 5)}


def test_osv_and_sarif(spark, put):
    folder = put("o.json", {"id": "G1", "severity": [{"score": ""}, {"score": "7.1"}], "affected": [{"package": {"name": "n", "ecosystem": "e"}, "ranges": [{"events": [{"introduced": "0"}, {"fixed": "1.2"}, {"introduced": "2"}]}]}]})
    assert {(r.introduced, r.fixed, r.severity) for r in feeds.read_osv(spark, folder + "/o.json").collect()} == {("0", "1.2", "7.1"), ("2", None, "7.1")}
    rules = [{"id": "a", "defaultConfiguration": {"level": "error"}}, {"id": "b", "properties": {"security-severity": "5.5"}}]
    results = [{"ruleId": "a", "message": {"text": "m"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "f.py"}, "region": {"startLine": 3}}}]}, {"ruleId": "b"}, {"ruleId": "a", "level": "note"}]
    put("s.json", {"runs": [{"tool": {"driver": {"name": "t", "rules": rules}}, "results": results}]})
    assert sorted((r.rule_id, r.level, r.startLine) for r in feeds.read_sarif(spark, folder + "/s.json").collect()) == [("a", "error", 3), ("a", "note", 0), ("b", "warning", 0)]


def test_rules_zip_and_files(spark, put, tmp_path):
    folder = put("r.json", {"rules": [{"id": "1", "language": "*", "category": "c", "enabled": True}, {"id": "2", "language": "Java", "enabled": False}, {"id": "3", "language": "java", "deprecated": True}]})
    rules = feeds.read_rules(spark, folder + "/r.json")
    assert [r.id for r in feeds.list_rules(rules, language="JAVA").collect()] == ["1"]
    assert sorted(r.id for r in feeds.list_rules(rules, language="java", enabled_only=False).collect()) == ["1", "2", "3"]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("b.json", '{"x": 2}')
        z.writestr("a.json", '{"x": 1}')
        z.writestr("c.txt", "no")
    assert [(r.member, r.v.x) for r in feeds.read_zip_json(spark, folder, "x int").orderBy("member").collect()] == [("a.json", 1), ("b.json", 2)]
    put("src/a.py", "one\ntwo\n")
    put("src/deep/b.yml", "k: v")
    put("src/node_modules/c.js", "x")
    got = {r.path.rpartition("/")[2]: r for r in feeds.discover_files(spark, folder + "/src", exclude="node_modules").collect()}
    assert set(got) == {"a.py", "b.yml"} and (got["a.py"].language, got["a.py"].lines, got["b.yml"].language) == ("python", 3, "yaml")


def test_manifests(spark):
    df = lambda text: spark.createDataFrame([("p", text)], "path string, content string")
    got = {r.name: r for r in feeds.requirements(df("# c\nDjango>=2.0,<3 # x\nrequests[sec]==2.1\n-r other\nflask\npkg~=1.4.2 ; python_version>'3'\n")).collect()}
    assert set(got) == {"Django", "requests", "flask", "pkg"}
    assert (got["Django"].range.low, got["Django"].range.high, got["requests"].range.exact, got["pkg"].range.high) == ("2.0", "3", "2.1", "1.5")
    npm = {r.name: r.range for r in feeds.package_json(df(json.dumps({"dependencies": {"a": "^1.2.3", "b": "~0.2.1", "c": "1.x"}, "devDependencies": {"d": "1.0.0 - 2.0.0", "e": "^0.0.3", "f": "1.2.3", "g": ">=1.0 <2.0"}}))).collect()}
    assert [(npm[k].low, npm[k].high, npm[k].exact) for k in "abcdefg"] == [("1.2.3", "2", None), ("0.2.1", "0.3", None), ("1", "2", None), ("1.0.0", "2.0.0", None), ("0.0.3", "0.0.4", None), (None, None, "1.2.3"), ("1.0", "2.0", None)]
    assert feeds.gradle(df("implementation 'g:a:1.0'\n testImplementation(\"h:b:2\")")).select("artifact_id", "version").collect() == [("a", "1.0"), ("b", "2")]
    xml = '<project xmlns="http://m"><properties><v.x>3.1</v.x></properties><dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId><version>${v.x}</version></dependency><dependency><groupId>g</groupId><artifactId>b</artifactId><version>[1,2)</version></dependency></dependencies></project>'
    rows = {r.artifact_id: r for r in feeds.pom(df(xml)).collect()}
    assert rows["a"].version == "3.1" and (rows["b"].range.low, rows["b"].range.high, rows["b"].range.high_inclusive) == ("1", "2", False)
    assert {r.name for r in feeds.pyproject(df('[project]\ndependencies = [\n "a>=1",\n "b[x]~=2.0; os",\n]\n')).collect()} == {"a", "b"}


@pytest.mark.parametrize("version,spec,fits", [("1.10", ">=1.9", True), ("1.9", "<=1.9", True), ("1.9", "<1.9", False), ("2.0", ">=1,<2", False), ("1.4.9", "~=1.4.2", True), ("1.5", "~=1.4.2", False), ("1.0rc1", "==1.1", True), (None, "<1", True), ("1.2", "==1.2.0", True)])
def test_ranges(spark, version, spec, fits):
    row = spark.createDataFrame([(version, spec)], "v string, s string").select(V.matches(F.col("v"), V.spec_range(F.col("s"))).alias("m")).first()
    assert row.m == fits


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "r", "f.py", 3, "high", "a|b")], "pos long, rule_id string, file_path string, line int, severity string, description string")
    assert sinks.audited_write(df, str(tmp_path / "o"), str(tmp_path / "audit"), "x", skipped=F.col("line") > 1)["skipped"] == 1
    with pytest.raises(Exception, match="no_such"):
        sinks.audited_write(df.withColumn("z", F.expr("raise_error('no_such')")), str(tmp_path / "o2"), str(tmp_path / "audit"), "y")
    assert {(r.etl_name, r.status, r.processed) for r in spark.read.parquet(str(tmp_path / "audit")).collect()} == {("x", "completed", 1), ("y", "failed", 0)}
    assert sinks.refresh(df, str(tmp_path / "m")).count() == 1
    assert [r.value for r in sinks.markdown(df.select("line", "description"), "T").collect()] == ["# T", "", "| line | description |", "|---|---|", "| 3 | a\\|b |"]
    assert "<td>f.py</td>" in sinks.html(df, "t", 5)
    result = json.loads(sinks.sarif_results(df).first().result)
    assert result["level"] == "error" and result["fingerprints"]["primary"] == "f.py:3:r"
    assert json.loads(sinks.sarif_rules(df).first().rule)["id"] == "r"


def test_plugins(spark):
    files = spark.createDataFrame([("a.py", "x = 12345\n", "python"), ("b.js", "y = 67890\n", "js")], "path string, content string, language string")
    r = plugins.Registry()
    r.register("num", plugins.rule(Pattern("num", "[0-9]{5}")))
    r.register("py", plugins.rule(Pattern("x", "x ="), "python"), supports=lambda t: t == "python")
    r.register("off", plugins.rule(Pattern("y", "y")), enabled=False)
    with pytest.raises(ValueError):
        r.register("num", None)
    assert r.names("js") == ["num"]
    assert {(x.path, x.rule_id) for x in plugins.fan_out(r, files).collect()} == {("a.py", "num"), ("b.js", "num"), ("a.py", "x")}
    assert plugins.matches_language("*", "go") and not plugins.matches_language("java", "go")


def test_nvd1_streams_and_rules(spark, put, tmp_path):
    item = {"cve": {"CVE_data_meta": {"ID": "CVE-9"}, "description": {"description_data": [{"lang": "en", "value": "d"}]}, "problemtype": {"problemtype_data": [{"description": [{"lang": "en", "value": "CWE-1"}]}]}, "references": {"reference_data": [{"url": "u"}]}}, "impact": {"baseMetricV3": {"cvssV3": {"baseScore": 5.5, "baseSeverity": "MEDIUM"}}}}
    row = feeds.read_nvd1(spark, put("n1.json", {"CVE_Items": [item]}) + "/n1.json").first()
    assert (row.cve_id, row.description, row.cwe_id, row.score, row.references) == ("CVE-9", "d", "CWE-1", 5.5, ["u"])
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    for n in (1, 2):
        put(f"feed/{n}.json", '{"x": %d}\n' % n)
        feeds.import_folder(spark, str(tmp_path / "feed"), "x int", out, mark)
    assert sorted(r.x for r in spark.read.parquet(out).collect()) == [1, 2]
    assert feeds.read_json_rows(spark, put("s.json", {"rows": [{"a": 1}, {"a": 2}]}) + "/s.json", "rows array<struct<a:int>>", "rows").count() == 2
    df = spark.createDataFrame([("src/auth.py", "Password = 1")], "p string, c string")
    rules = [{"kind": "keyword", "value": "password", "weight": 2}, {"kind": "path", "value": "auth", "weight": 1}, {"kind": "pattern", "value": "^x", "weight": 4}]
    assert df.select(feeds.priority_rules(rules, F.col("p"), F.col("c")).alias("w")).first().w == 3.0


def test_setup_py(spark):
    text = """from setuptools import setup
setup(
    name="x",
    install_requires=[
        "requests[socks]>=2.0,<3",
        'numpy==1.26.0; python_version > "3.8"',
    ],
    extras_require={"dev": ["pytest>=7"], 'docs': ['sphinx']},
)
"""
    files = spark.createDataFrame([("a/setup.py", text), ("b/setup.py", "setup(install_requires=['one'])"), ("c/setup.py", "setup()"), ("d/setup.py", None)], "path string, content string")
    out = {(r.path, r.name, r.spec, r.dependency_type) for r in feeds.setup_py(files).collect()}
    assert out == {("a/setup.py", "requests", ">=2.0,<3", "direct"), ("a/setup.py", "numpy", "==1.26.0", "direct"), ("a/setup.py", "pytest", ">=7", "optional"), ("a/setup.py", "sphinx", "", "optional"), ("b/setup.py", "one", "", "direct")}

"""Readers of vulnerability feeds, advisories, SARIF, rule catalogs, archives, manifests and source trees. Each gives DataFrames with explicit schemas."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftkite.functions import versions as V
from siftkite.sources.pieces import read_zip

CVE_ID = r"CVE-\d{4}-\d{4,}"
_TEXTS = "array<struct<lang:string,value:string>>"
_METRIC = "array<struct<cvssData:struct<baseScore:double,baseSeverity:string,vectorString:string,version:string>,baseSeverity:string,type:string>>"
_MATCH = "array<struct<criteria:string,vulnerable:boolean,versionStartIncluding:string,versionStartExcluding:string,versionEndIncluding:string,versionEndExcluding:string>>"
CVE5 = f"cveMetadata struct<cveId:string,datePublished:string,dateUpdated:string>, containers struct<cna:struct<descriptions:{_TEXTS}>>"
NVD2 = (
    f"vulnerabilities array<struct<cve:struct<id:string,published:string,lastModified:string,descriptions:{_TEXTS},metrics:struct<cvssMetricV31:{_METRIC},cvssMetricV30:{_METRIC},cvssMetricV2:{_METRIC}>,"
    f"weaknesses:array<struct<type:string,description:{_TEXTS}>>,configurations:array<struct<nodes:array<struct<cpeMatch:{_MATCH}>>>>,references:array<struct<url:string>>>>>"
)
OSV = "id string, summary string, severity array<struct<type:string,score:string>>, affected array<struct<package:struct<name:string,ecosystem:string>,ranges:array<struct<type:string,events:array<struct<introduced:string,fixed:string>>>>>>"
SARIF = (
    "version string, runs array<struct<tool:struct<driver:struct<name:string,rules:array<struct<id:string,defaultConfiguration:struct<level:string>,properties:map<string,string>>>>>,"
    "results:array<struct<ruleId:string,level:string,message:struct<text:string>,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int,startColumn:int,endLine:int,endColumn:int>>>>>>>>"
)


def english(texts: Column) -> Column:
    """The first English text that isn't empty, else the first of any language, else ''."""
    own = F.get(F.filter(texts, lambda x: x["lang"] == "en"), F.lit(0))["value"]
    return F.coalesce(F.nullif(own, F.lit("")), F.get(texts, F.lit(0))["value"], F.lit(""))


def iso_time(text: Column) -> Column:
    """An ISO 8601 time; null if it is none."""
    return F.try_to_timestamp(text)


def read_cve5(spark: SparkSession, folder: str) -> DataFrame:
    """cve_id, description, published_date, last_modified of CVE-*.json files at any depth; files without a valid id give no row."""
    df = spark.read.schema(CVE5).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "CVE-*.json").json(folder)
    m = F.col("cveMetadata")
    out = df.select(m["cveId"].alias("cve_id"), english(F.col("containers.cna.descriptions")).alias("description"), iso_time(m["datePublished"]).alias("published_date"), iso_time(m["dateUpdated"]).alias("last_modified"))
    return out.filter(F.col("cve_id").rlike(f"^{CVE_ID}$"))


def read_nvd2(spark: SparkSession, path: str) -> DataFrame:
    """One row with column cve for each vulnerability of NVD 2.0 files."""
    return spark.read.schema(NVD2).option("multiLine", True).json(path).select(F.explode("vulnerabilities").alias("v")).select("v.cve")


def nvd2_cvss(nvd: DataFrame) -> DataFrame:
    """cve_id, score, severity, vector, version by the newest metric there is; version 2 keeps its severity beside the data."""
    first = lambda name: F.get(F.col(f"cve.metrics.{name}"), F.lit(0))
    picked = F.coalesce(*[F.when(first(m).isNotNull(), F.struct(first(m)["cvssData"].alias("d"), F.coalesce(first(m)["cvssData"]["baseSeverity"], first(m)["baseSeverity"]).alias("s"))) for m in ("cvssMetricV31", "cvssMetricV30", "cvssMetricV2")])
    return nvd.select(F.col("cve.id").alias("cve_id"), picked.alias("p")).filter("p is not null").select("cve_id", F.col("p.d.baseScore").alias("score"), F.col("p.s").alias("severity"), F.col("p.d.vectorString").alias("vector"), F.col("p.d.version").alias("version"))


def nvd2_cpe(nvd: DataFrame) -> DataFrame:
    """cve_id, vendor, product, version and both bounds with their types; a bound that is missing is null and each bound keeps its value."""
    m = nvd.select(F.col("cve.id").alias("cve_id"), F.explode("cve.configurations").alias("c")).select("cve_id", F.explode("c.nodes").alias("n")).select("cve_id", F.explode("n.cpeMatch").alias("m"))
    part = lambda i: F.split_part("m.criteria", F.lit(":"), F.lit(i))
    start, end = F.coalesce("m.versionStartIncluding", "m.versionStartExcluding"), F.coalesce("m.versionEndIncluding", "m.versionEndExcluding")
    kind = lambda inc, exc: F.when(F.col(inc).isNotNull(), "including").when(F.col(exc).isNotNull(), "excluding")
    return m.filter(F.col("m.criteria").startswith("cpe:2.3:")).select(
        "cve_id", part(4).alias("vendor"), part(5).alias("product"), part(6).alias("version"), start.alias("version_start"), end.alias("version_end"),
        kind("m.versionStartIncluding", "m.versionStartExcluding").alias("version_start_type"), kind("m.versionEndIncluding", "m.versionEndExcluding").alias("version_end_type"),
    )


def nvd2_rows(nvd: DataFrame) -> DataFrame:
    """cve_id, description, primary English CWE, products and reference URLs."""
    primary = F.get(F.filter("cve.weaknesses", lambda w: w["type"] == "Primary"), F.lit(0))["description"]
    return nvd.select(F.col("cve.id").alias("cve_id"), english(F.col("cve.descriptions")).alias("description"), F.nullif(english(primary), F.lit("")).alias("cwe_id"), F.transform("cve.references", lambda r: r["url"]).alias("references"))


def feed_format(spark: SparkSession, path: str) -> DataFrame:
    """(path, format): v2.0, v1.1, v1.1_collection or unknown, by the keys at the root."""
    keys = F.json_object_keys("value")
    has = lambda k: F.array_contains(F.col("keys"), k)
    df = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), keys.alias("keys"))
    kind = F.when(has("vulnerabilities"), "v2.0").when(has("CVE_Items"), "v1.1_collection").when(has("cve") & has("impact"), "v1.1").otherwise("unknown")
    return df.select("path", F.coalesce(kind, F.lit("unknown")).alias("format"))


def read_cwe(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(cwe, cve_cwe) from weakness catalogs in XML."""
    schema = "_ID string, _Name string, _Abstraction string, _Status string, Description string, Related_Vulnerabilities struct<Related_Vulnerability:array<struct<_CVE_ID:string,_Nature:string>>>"
    df = spark.read.format("xml").option("rowTag", "Weakness").schema(schema).load(path)
    cwe_id = F.concat(F.lit("CWE-"), "_ID")
    weaknesses = df.select(cwe_id.alias("cwe_id"), F.col("_Name").alias("name"), F.col("_Abstraction").alias("weakness_abstraction"), F.col("_Status").alias("status"), F.trim("Description").alias("description"))
    links = df.select(cwe_id.alias("cwe_id"), F.explode("Related_Vulnerabilities.Related_Vulnerability").alias("r")).select(F.col("r._CVE_ID").alias("cve_id"), "cwe_id", (F.col("r._Nature") == "Primary").alias("is_primary"))
    return weaknesses, links


def read_kev(spark: SparkSession, path: str) -> DataFrame:
    schema = "vulnerabilities array<struct<cveID:string,dueDate:string,shortDescription:string,notes:string>>"
    v = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("vulnerabilities").alias("v"))
    return v.filter("v.cveID is not null and v.cveID <> ''").select(F.col("v.cveID").alias("cve_id"), F.lit(True).alias("exploited"), F.col("v.dueDate").try_cast("date").alias("due_date"), F.col("v.shortDescription").alias("short_description"), F.col("v.notes").alias("notes"))


def first_cve(*columns: Column) -> Column:
    """The first CVE id in the columns, in their order; null if none has one."""
    return F.coalesce(*[F.nullif(F.regexp_extract(F.upper(F.coalesce(c, F.lit(""))), f"({CVE_ID})", 1), F.lit("")) for c in columns])


def read_exploits(spark: SparkSession, path: str) -> DataFrame:
    """cve_id, description, platform, exploit_type, port, file_path, verified of CSV rows that name a CVE in codes or the description."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    out = df.select(first_cve(F.col("codes"), F.col("description")).alias("cve_id"), "description", "platform", F.col("type").alias("exploit_type"), "port", F.col("file").alias("file_path"), F.lower("verified").isin("1", "true", "yes").alias("verified"))
    return out.filter("cve_id is not null")


def read_pocs(spark: SparkSession, path: str) -> DataFrame:
    """cve_id, repo_url, stars, language, description from files that hold a list of repositories or one; other roots give nothing."""
    item = "struct<name:string,full_name:string,description:string,body:string,html_url:string,stargazers_count:int,stars:int,language:string>"
    text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    rows = text.select(F.when(F.col("v").startswith("["), F.from_json("v", f"array<{item}>")).when(F.col("v").startswith("{"), F.array(F.from_json("v", item))).alias("r")).select(F.explode("r").alias("r")).select("r.*")
    cve = first_cve(F.col("name"), F.col("full_name"), F.col("description"), F.col("body"))
    return rows.select(cve.alias("cve_id"), F.col("html_url").alias("repo_url"), F.coalesce(F.nullif("stargazers_count", F.lit(0)), "stars", F.lit(0)).alias("stars"), "language", "description").filter("cve_id is not null")


def read_osv(spark: SparkSession, path: str) -> DataFrame:
    """id, name, ecosystem, introduced, fixed, severity: each introduced event with the fix that follows it in its range; 'unknown' severity by default."""
    df = spark.read.schema(OSV).option("multiLine", True).json(path)
    severity = F.coalesce(F.get(F.filter(F.transform("severity", lambda s: s["score"]), lambda s: s != ""), F.lit(0)), F.lit("unknown"))
    ranges = df.select("id", severity.alias("severity"), F.explode_outer("affected").alias("a")).select("id", "severity", F.col("a.package.name").alias("name"), F.col("a.package.ecosystem").alias("ecosystem"), F.posexplode_outer("a.ranges").alias("nth", "r"))
    events = ranges.select("id", "severity", "name", "ecosystem", "nth", F.posexplode_outer("r.events").alias("i", "e"))
    after = F.lead("e.fixed").over(Window.partitionBy("id", "name", "nth").orderBy("i"))
    return events.select("id", "name", "ecosystem", F.col("e.introduced").alias("introduced"), after.alias("fixed"), "severity").filter("introduced is not null").union(events.filter("e is null").select("id", "name", "ecosystem", F.lit("unknown"), F.lit(None).cast("string"), "severity"))


def read_sarif(spark: SparkSession, path: str) -> DataFrame:
    """tool, rule_id, level, message, file_path, positions of each result; the level is its own, else the rule's, else by the rule's security-severity."""
    runs = spark.read.schema(SARIF).option("multiLine", True).json(path).select(F.explode("runs").alias("r"))
    rows = runs.select(F.col("r.tool.driver.name").alias("tool"), F.col("r.tool.driver.rules").alias("rules"), F.explode("r.results").alias("x"))
    rule = F.get(F.filter("rules", lambda y: y["id"] == F.col("x.ruleId")), F.lit(0))
    number = F.get(F.filter("rules", lambda y: y["id"] == F.col("x.ruleId")), F.lit(0))["properties"]["security-severity"].try_cast("double")
    level = F.coalesce("x.level", rule["defaultConfiguration"]["level"], F.when(number >= 7, "error").when(number >= 4, "warning").when(number.isNotNull(), "note"), F.lit("warning"))
    at = F.get(F.col("x.locations"), F.lit(0))["physicalLocation"]
    return rows.select("tool", F.col("x.ruleId").alias("rule_id"), level.alias("level"), F.col("x.message.text").alias("message"), at["artifactLocation"]["uri"].alias("file_path"), *[F.coalesce(at["region"][c], F.lit(0)).alias(c) for c in ("startLine", "startColumn", "endLine", "endColumn")])


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    rule = "struct<id:string,name:string,severity:string,category:string,language:string,pattern:string,enabled:boolean,deprecated:boolean>"
    return spark.read.schema(f"rules array<{rule}>").option("multiLine", True).json(path).select(F.explode("rules").alias("r")).select("r.*")


def list_rules(rules: DataFrame, *, language: str | None = None, category: str | None = None, severity: str | None = None, enabled_only: bool = True) -> DataFrame:
    """The catalog's rules: enabled and not deprecated, of the language or any, of the category and severity."""
    if enabled_only:
        rules = rules.filter(F.coalesce("enabled", F.lit(True)) & ~F.coalesce("deprecated", F.lit(False)))
    if language is not None:
        rules = rules.filter(F.lower("language").isin(language.lower(), "*"))
    for name, value in (("category", category), ("severity", severity)):
        if value is not None:
            rules = rules.filter(F.col(name) == value)
    return rules


def read_zip_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(archive, member, v) of the JSON members of zip files, v parsed by the schema. Members are read in groups by many tasks; the driver reads the archives' directories."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path")
    paths = [re.sub("^file:/(?=[^/])", "file:///", r.path) for r in files.collect()]
    return read_zip(spark, sorted(paths), ".json").select(F.col("path").alias("archive"), F.col("name").alias("member"), F.from_json("text", schema).alias("v"))


# Languages by extension.
LANGUAGES = {"py": "python", "js": "javascript", "ts": "typescript", "java": "java", "go": "go", "rb": "ruby", "php": "php", "c": "c", "cpp": "cpp", "cs": "csharp", "rs": "rust", "yaml": "yaml", "yml": "yaml", "json": "json", "xml": "xml"}


def discover_files(spark: SparkSession, folder: str, *, pattern: str = "*", exclude: str | None = None, min_size: int = 0, max_size: int | None = None) -> DataFrame:
    """path, size, extension, language, sha256, lines and content of the files of a tree; the size bounds keep contents of others unread. Empty files give no row."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).filter(F.col("length") >= min_size)
    if max_size is not None:
        df = df.filter(F.col("length") <= max_size)
    if exclude is not None:
        df = df.filter(~F.col("path").rlike(exclude))
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    language = F.coalesce(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[ext], F.lit("unknown"))
    text = F.expr("try_validate_utf8(cast(content as string))")
    return df.select("path", F.col("length").alias("size"), ext.alias("extension"), language.alias("language"), F.sha2("content", 256).alias("sha256"), (F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1).alias("lines"), text.alias("content"))


def requirements(files: DataFrame) -> DataFrame:
    """path, name, spec, range of requirements.txt lines."""
    lines = files.select("path", F.explode(F.split("content", r"\r?\n")).alias("l")).withColumn("l", F.trim(F.regexp_replace("l", "#.*$", ""))).filter("l <> '' and l not like '-%'")
    pattern = r"^([A-Za-z0-9][A-Za-z0-9._-]*)(?:\[[^\]]*\])?\s*([^;]*)"
    return lines.select("path", F.regexp_extract("l", pattern, 1).alias("name"), F.trim(F.regexp_extract("l", pattern, 2)).alias("spec")).withColumn("range", V.spec_range(F.col("spec")))


def package_json(files: DataFrame) -> DataFrame:
    """path, name, spec, dependency_type, range of the four dependency maps."""
    kinds = ["dependencies", "devDependencies", "peerDependencies", "optionalDependencies"]
    parsed = files.select("path", F.from_json("content", ", ".join(f"{k} map<string,string>" for k in kinds)).alias("p"))
    each = parsed.select("path", F.explode(F.array(*[F.struct(F.lit(k).alias("dependency_type"), F.col(f"p.{k}").alias("m")) for k in kinds])).alias("x"))
    rows = each.select("path", F.col("x.dependency_type").alias("dependency_type"), F.explode("x.m").alias("name", "spec"))
    return rows.withColumn("range", V.npm_range(F.col("spec")))


def gradle(files: DataFrame) -> DataFrame:
    pattern = r"(?:implementation|api|compile|runtimeOnly|testImplementation)\s*\(?\s*['\"]([^:'\"]+):([^:'\"]+):([^'\"]+)['\"]"
    return files.select("path", F.explode(F.arrays_zip(*[F.regexp_extract_all("content", F.lit(pattern), i).alias(n) for i, n in ((1, "group_id"), (2, "artifact_id"), (3, "version"))])).alias("d")).select("path", "d.*")


def pom(files: DataFrame) -> DataFrame:
    """path, group_id, artifact_id, version, range of a POM's dependencies; ${name} is the property of that name."""
    body = F.regexp_replace("content", r"\sxmlns(:\w+)?=\"[^\"]*\"|\s\w+:\w+=\"[^\"]*\"", "")
    x = files.select("path", body.alias("b"))
    at = lambda tag: F.expr(f"xpath(b, '/project/dependencies/dependency/{tag}/text()')")
    rows = x.select("path", "b", F.posexplode(F.arrays_zip(at("groupId").alias("group_id"), at("artifactId").alias("artifact_id"))).alias("i", "d"))
    block = F.regexp_extract_all("b", F.lit(r"(?s)<dependency>(.*?)</dependency>"), 1)
    version = F.regexp_extract(F.get(block, F.col("i")), r"<version>\s*([^<]*?)\s*</version>", 1)
    name = F.regexp_extract(version, r"^\$\{(.+)\}$", 1)
    pattern = F.concat(F.lit("<"), F.regexp_replace(name, r"([.\-])", r"\\$1"), F.lit(r">\s*([^<]*?)\s*</"))
    value = F.call_function("regexp_extract", F.col("b"), pattern, F.lit(1))
    real = F.when(name != "", value).otherwise(version)
    return rows.select("path", "d.group_id", "d.artifact_id", real.alias("version")).withColumn("range", V.maven_range(F.col("version")))


def pyproject(files: DataFrame) -> DataFrame:
    """path, name, spec, range of PEP 508 strings in [project] dependencies."""
    block = F.regexp_extract("content", r"(?s)\bdependencies\s*=\s*\[(.*?)\n?\s*\]\s*(?:\n|$)", 1)
    rows = files.select("path", F.explode(F.regexp_extract_all(block, F.lit("[\"']([^\"']+)[\"']"), 1)).alias("l"))
    pattern = r"^([A-Za-z0-9][A-Za-z0-9._-]*)(?:\[[^\]]*\])?\s*([^;]*)"
    return rows.select("path", F.regexp_extract("l", pattern, 1).alias("name"), F.trim(F.regexp_extract("l", pattern, 2)).alias("spec")).withColumn("range", V.spec_range(F.col("spec")))


def setup_py(files: DataFrame) -> DataFrame:
    """path, name, spec, range, dependency_type of PEP 508 strings in install_requires (direct) and extras_require (optional)."""
    kinds = F.array(
        F.struct(F.lit("direct").alias("kind"), F.regexp_extract("content", r"(?s)\binstall_requires\s*=\s*\[(.*?)\n?\s*\]\s*(?:,|\)|\n|$)", 1).alias("block")),
        F.struct(F.lit("optional").alias("kind"), F.regexp_extract("content", r"(?s)\bextras_require\s*=\s*\{(.*?)\}", 1).alias("block")),
    )
    rows = files.select("path", F.explode(kinds).alias("k")).select("path", "k.kind", F.regexp_replace("k.block", "[\"'][^\"']*[\"']\\s*:", "").alias("block"))
    rows = rows.select("path", "kind", F.explode(F.regexp_extract_all("block", F.lit("[\"']([^\"']+)[\"']"), 1)).alias("l"))
    pattern = r"^([A-Za-z0-9][A-Za-z0-9._-]*)(?:\[[^\]]*\])?\s*([^;]*)"
    rows = rows.select("path", F.regexp_extract("l", pattern, 1).alias("name"), F.trim(F.regexp_extract("l", pattern, 2)).alias("spec"), F.col("kind").alias("dependency_type"))
    return rows.withColumn("range", V.spec_range(F.col("spec"))).select("path", "name", "spec", "range", "dependency_type")


NVD1 = f"CVE_Items array<struct<cve:struct<CVE_data_meta:struct<ID:string>,description:struct<description_data:{_TEXTS}>,problemtype:struct<problemtype_data:array<struct<description:{_TEXTS}>>>,references:struct<reference_data:array<struct<url:string>>>>,impact:struct<baseMetricV3:struct<cvssV3:struct<baseScore:double,baseSeverity:string>>>,publishedDate:string,lastModifiedDate:string>>"


def read_nvd1(spark: SparkSession, path: str) -> DataFrame:
    """cve_id, description, cwe_id, score, severity, references of NVD 1.1 collections; score and severity beside what `nvd2_rows` gives."""
    x = spark.read.schema(NVD1).option("multiLine", True).json(path).select(F.explode("CVE_Items").alias("x"))
    problem = F.get(F.col("x.cve.problemtype.problemtype_data"), F.lit(0))["description"]
    v3 = F.col("x.impact.baseMetricV3.cvssV3")
    return x.select(F.col("x.cve.CVE_data_meta.ID").alias("cve_id"), english(F.col("x.cve.description.description_data")).alias("description"), F.nullif(english(problem), F.lit("")).alias("cwe_id"), v3["baseScore"].alias("score"), v3["baseSeverity"].alias("severity"), F.transform("x.cve.references.reference_data", lambda r: r["url"]).alias("references"))


def import_folder(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str) -> None:
    """Append the rows of JSON-lines files that came to the folder since the last call to `out`; the checkpoint remembers the files."""
    rows = spark.readStream.schema(schema).json(folder)
    rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()


def read_json_rows(spark: SparkSession, path: str, schema: str, field: str | None = None) -> DataFrame:
    """Rows of a JSON file by a schema: the root's objects, or those in the array `field` (sessions, lookup tables, advisories)."""
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    return df.select(F.explode(field).alias("r")).select("r.*") if field else df


def priority_rules(rules: list[dict], path: Column, content: Column) -> Column:
    """The summed weights of keyword, pattern and path rules (kind, value, weight) that hold; the rules are a user's file, read on the driver."""
    tests = {"keyword": lambda v: F.contains(F.lower(content), F.lit(v.lower())), "pattern": content.rlike, "path": path.rlike}
    total = F.lit(0.0)
    for r in rules:
        total = total + F.when(tests[r["kind"]](r["value"]), float(r["weight"])).otherwise(0.0)
    return total

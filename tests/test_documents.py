import json
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from siftkite.sources import documents as D
from siftkite.sources import feeds

SCHEMA = "pos long, rule_id string, description string, severity string, file_path string, line int"


def findings(spark, n=500):
    rows = [(n - i, f"R{i % 7}", f'says "{i}" <b> & é\n', ["critical", "medium", "low", None][i % 4], f"src/{i % 9}.py", i % 50) for i in range(n)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(6)


def test_a_sarif_file_is_read_back(spark, tmp_path):
    rows, df = findings(spark)
    for _ in range(2):  # the second one replaces the first
        D.write_sarif(df, f"file://{tmp_path}/out/s.sarif", "tool")
    doc = json.loads((tmp_path / "out/s.sarif").read_text())
    run = doc["runs"][0]
    assert doc["version"] == "2.1.0" and run["tool"]["driver"]["name"] == "tool" and [r["id"] for r in run["tool"]["driver"]["rules"]] == [f"R{i}" for i in range(7)]
    assert [r["message"]["text"] for r in run["results"]] == [r[2] for r in sorted(rows)]
    back = feeds.read_sarif(spark, f"{tmp_path}/out/s.sarif")
    assert sorted((r.rule_id, r.startLine) for r in back.select("rule_id", "startLine").collect()) == sorted((r[1], max(r[5], 1)) for r in rows)
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["s.sarif"]


def test_empty_reports_are_valid(spark, tmp_path):
    _, df = findings(spark, 3)
    D.write_sarif(df.limit(0), f"file://{tmp_path}/e.sarif", "tool")
    assert json.loads((tmp_path / "e.sarif").read_text())["runs"][0]["results"] == []
    D.write_json_report(df.limit(0), f"file://{tmp_path}/e.json", ["pos"])
    assert json.loads((tmp_path / "e.json").read_text()) == {"findings": []}


def test_json_and_html(spark, tmp_path):
    rows, df = findings(spark, 60)
    D.write_json_report(df, f"file://{tmp_path}/r.json", ["severity", "pos"], {"title": "t", "n": 60})
    doc = json.loads((tmp_path / "r.json").read_text())
    assert doc["n"] == 60 and [r["pos"] for r in doc["findings"]] == [r[0] for r in sorted(rows, key=lambda r: (r[3] is not None, r[3] or "", r[0]))] and doc["findings"][0]["severity"] is None
    D.write_html_report(df, f"file://{tmp_path}/r.html", ["pos"], "All <of> them")

    class Cells(HTMLParser):
        cells, on = [], False

        def handle_starttag(self, tag, attrs):
            self.on = tag == "td"
            if self.on:
                self.cells.append("")

        def handle_endtag(self, tag):
            self.on = False

        def handle_data(self, data):
            if self.on:
                self.cells[-1] += data

    page = Cells()
    page.feed((tmp_path / "r.html").read_text())
    assert page.cells == ["" if v is None else str(v) for r in sorted(rows) for v in r]


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    _, df = findings(spark, 50)
    broken = df.withColumn("description", F.when(F.col("pos") == 17, F.raise_error(F.lit("broken row")).cast("string")).otherwise(F.col("description")))
    with pytest.raises(Exception, match="broken row"):
        D.write_json_report(broken, f"file://{tmp_path}/out/x.json", ["rule_id"])
    assert not (tmp_path / "out").exists() or list((tmp_path / "out").iterdir()) == []

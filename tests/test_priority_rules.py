import fnmatch
import json

import pytest
from pyspark.sql import functions as F

from siftkite.sources import priority_rules as P

RULES = {
    "priority_rules": {
        "custom": {
            "name": "mine",
            "keywords": {"high_priority": ["Password", "eval("], "medium_priority": ["login"], "low_priority": ["util"]},
            "file_patterns": {"high_priority": ["*.sec.py", "auth?.py"], "low_priority": ["[ab]*.js", "x.y"]},
            "path_rules": {"high_priority": ["**/src/**/core/", "app/**/api"], "medium_priority": ["lib/", "**/deep"]},
            "weights": {"keyword_match": 0.5, "file_pattern": 0.2, "path_match": 0.3},
        }
    }
}
FILES = [("src/x/core/auth1.py", "PASSWORD = 1; eval(x)"), ("core/src/a.js", "login"), ("lib/util/x.sec.py", None), ("app/v1/api/b.js", ""), ("q/deeper/xzy", "none"), ("app/apiary/x.y", "utility")]


def by_hand(path, text):
    custom = RULES["priority_rules"]["custom"]
    points = {"high_priority": 1.0, "medium_priority": 0.6, "low_priority": 0.3}

    def share(rules, test):
        return min(1.0, sum(p for k, p in points.items() for x in rules.get(k, []) if test(x)) / sum(len(rules.get(k, [])) * p for k, p in points.items()))

    def on_path(x):
        import re

        if x == "**/src/**/core/":
            return "core/" in path[path.find("src/") + 4 :] if "src/" in path else False
        return re.search(x.replace("**/", ".*/"), path) is not None if x == "app/**/api" else x.removeprefix("**/") in path

    text = (text or "").lower()
    k, f, p = share(custom["keywords"], lambda x: x.lower() in path.lower() or x.lower() in text), share(custom["file_patterns"], lambda x: fnmatch.fnmatchcase(path.rpartition("/")[2], x)), share(custom["path_rules"], on_path)
    return k, f, p, 0.7 * (0.5 * k + 0.2 * f + 0.3 * p) + 0.3 * 0.5


@pytest.mark.parametrize("name", ["r.yaml", "r.json", "r.txt"])
def test_rules_from_files(spark, tmp_path, name):
    text = json.dumps(RULES)
    if name == "r.yaml":
        yaml = pytest.importorskip("yaml")
        text = yaml.safe_dump(RULES)
    elif name == "r.txt":
        pytest.importorskip("yaml")
    (tmp_path / name).write_text(text)
    rules = P.read_priority_rules(f"file://{tmp_path}/{name}")
    assert rules.name == "mine" and rules.keyword_weight == 0.5
    out = P.rule_priorities(spark.createDataFrame(FILES, "path string, content string"), rules, related=F.lit(0.5)).collect()
    for r in out:
        want = by_hand(*next(f for f in FILES if f[0] == r.path))
        assert (r.keyword_score, r.pattern_score, r.path_score, r.total) == pytest.approx(want, abs=1e-8), r.path
        assert r.level == ("high" if r.total >= 0.7 else "medium" if r.total >= 0.4 else "low")
    assert {r.level for r in out} == {"medium", "low"}


def test_no_rules(spark):
    df = spark.createDataFrame(FILES, "path string, content string")
    for config in (None, {}, {"priority_rules": {"custom": {"keywords": None}}}):
        assert {(r.total, r.level) for r in P.rule_priorities(df, P.parse_priority_rules(config)).collect()} == {(0.0, "low")}

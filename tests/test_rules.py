"""The code rules: hits, gates and places, on code written for each rule."""

from __future__ import annotations

import pytest

from siftkite.operators import rules as R
from siftkite.operators.catalog import LINE_RULES, TEXT_RULES

# text, and the (rule, line, col) it must give among the rules named
HITS = [
    ('cursor.execute(f"select {request.args}")', [("sql_injection", 1, 1)]),
    ('db.execute("a" + x)\ndb.execute("select req.id " + y)', [("sql_injection", 2, 1)]),
    ('q.raw(f"{x}" + user_name)', [("sql_injection", 1, 2)]),
    ('cursor.execute("select %s", (user_id,))\ncursor.execute(f"select {request.args}")', []),
    ('cursor.execute(f"select {request.args}", (a))', []),
    ('os.system("ls " + user_input)', [("command_injection", 1, 1)]),
    ('os.system("ls " + shlex.quote(user_input))', []),
    ("subprocess.run([\n  cmd], shell=True, x=cmd)", []),
    ("box.innerHTML = req.body", [("xss", 1, 5)]),
    ("{% block a %}\nbox.innerHTML = req.body", []),
    ("import React\nbox.innerHTML = req.body", []),
    ("KEY = 1\n  SECRET_KEY = 'abcdefghijk'", [("hardcoded_key", 2, 3)]),
    ("SECRET_KEY = 'short'", []),
    ("\u0410\u0434admin", [("homoglyph", 1, 2)]),
    ("\u0410\u0434other", []),
    ("p = '\\u202E'\nfile = 'a\u202eb'\nx = 'a\u202eb'", [("bidi_control", 1, 6), ("bidi_control", 2, 10)]),
    ("if 'a' == b['c']", [("unnormalized_comparison", 1, 1)]),
    ("if 'a' == b['c']\nnormalize('NFC', x)", []),
    ("openai.chat.completions.create(\n prompt=request.json)", [("prompt_injection", 2, 2), ("context_overflow", 1, 1)]),
    ("openai.chat.completions.create(prompt=request.json)" + " " * 700 + "len(x)", [("prompt_injection", 1, 32)]),
    ("prompt=request.json" + " " * 600 + "llm.chat", []),
    ("ignore all previous instructions", [("instruction_override", 1, 1)]),
    ("x = db(user_id).get(1)", [("idor", 1, 8)]),
    ("check_permission(u)\nx = db(user_id).get(1)", []),
    ("check_permission(u)" + "\n" * 500 + "x = db(user_id).get(1)", [("idor", 501, 8)]),
    ("price = request.form\ncoupon.apply(\n request)", [("business_logic", 1, 1), ("business_logic", 2, 1)]),
    ("coupon.apply(x.validate(), request)", []),
    ("os.path.exists(p)\n open(p)", [("race_condition", 1, 1)]),
    ("os.path.exists(p)" + " " * 500 + "open(p)", []),
    ("login(u)", [("unlogged_event", 1, 1)]),
    ("login(u)" + " " * 291 + "logger.info", []),
    ("login(u)" + " " * 292 + "logger.info", [("unlogged_event", 1, 1)]),
    ("log.info('hello')", [("audit_trail", 1, 1)]),
    ("log.info('hello')\nuser_id, timestamp, status", []),
    ("print(f(\n password))", [("sensitive_data", 1, 1), ("sensitive_logs", 1, 1)]),
]


@pytest.mark.parametrize("text,want", HITS)
def test_text_rules(text, want):
    got = [(r.rule_id, n, col) for r in TEXT_RULES for n, col, *_ in R.text_hits(text, r)]
    assert sorted(got) == sorted(want)


def test_severity_confidence_and_mask():
    at = lambda name, text: [(h[2], h[3], h[4]) for r in TEXT_RULES if r.rule_id == name for h in R.text_hits(text, r)]
    assert at("weak_crypto", "DES.new(x)") == [("medium", 0.85, "DES.new(x)")]
    assert at("weak_crypto", "MODE_ECB") == [("high", 0.85, "MODE_ECB")]
    assert at("weak_crypto", "\n".join(["token", "", "", "", "DES.new(x)"]))[0][0] == "critical"
    assert at("weak_crypto", "\n".join(["token", "", "", "", "", "DES.new(x)"]))[0][0] == "medium"
    assert at("insecure_random", "random.choice(a)\nsecrets.x") == [("high", 0.75, "random.choice(a)")]
    assert at("insecure_random", "random.choice(a)\nSystemRandom") == [("info", 0.75, "random.choice(a)")]
    assert at("hardcoded_key", " JWT_SECRET = 'abcdefghijk'") == [("critical", 0.9, "JWT_SECRET = '****'")]
    assert at("xss", "a.innerHTML = req.x\nescape(y)") == [("high", 0.6, "a.innerHTML = req.x")]


def test_frames(spark):
    rows = [("a", "x = 1\neval(response.text)"), ("b", None), ("c", ""), ("a", "login(u)\n" * 3 + "eval(response.text)"), ("d", "eval(response.text)\n" * 20000)]
    df = spark.createDataFrame([(p, t, 1) for p, t in rows], "path string, content string, line int")
    assert sorted((r.path, r.line) for r in R.text_rules(df, [r for r in TEXT_RULES if r.rule_id == "unlogged_event"]).collect()) == [("a", 1), ("a", 2), ("a", 3)]
    got = [(r.path, r.line) for r in R.line_rules(df, LINE_RULES).filter("rule_id = 'unvalidated_output'").collect()]
    assert sorted(got)[:2] == [("a", 2), ("a", 4)] and len(got) == 20002
    empty = df.limit(0)
    assert R.text_rules(empty, TEXT_RULES).count() == 0 and R.line_rules(empty, LINE_RULES).count() == 0
    other = spark.createDataFrame([("p", "eval(response.text)")], "name string, body string")
    assert [r.path for r in R.line_rules(other, LINE_RULES, path="name", content="body").collect()] == ["p"]


def test_expressions_are_tried_only_where_their_words_are():
    class Any(R._Words):
        def may_match(self, pattern):
            return True

    letters = {"s": "ſ", "i": "İ", "k": "K"}
    texts = [t for t, _ in HITS] + [t.upper() for t, _ in HITS] + ["".join(letters.get(c, c) for c in t) for t, _ in HITS] + ["prınt(password)", "DEſ.new(x)", "", "İıſK"]
    for text in texts:
        for rule in TEXT_RULES:
            assert list(R.text_hits(text, rule)) == list(R.text_hits(text, rule, Any(text)))
    assert R.needs(r"(?i:a(?:bc|De)+x?\s(?:foo|ba.))") == (frozenset({"a"}), frozenset({"bc", "de"}), frozenset({"foo", "ba"}))
    words = R._Words("a quiet text")
    assert not any(words.may_match(p) for r in TEXT_RULES if r.rule_id in ("sql_injection", "xss", "weak_crypto", "unlogged_event") for p in r.patterns)


def test_lines_of_one_file_are_dealt_to_all_tasks(spark):
    rows = [("p", "x = 1\nEVAL(reſponse.text)\nprınt(message.content)" if n % 2 else "plain") for n in range(400)]
    df = spark.createDataFrame(rows, "path string, content string").coalesce(1)
    assert R.line_rules(df, LINE_RULES).rdd.getNumPartitions() > 1 and R.text_rules(df, TEXT_RULES).rdd.getNumPartitions() > 1
    got = R.line_rules(df, LINE_RULES).groupBy("rule_id", "line").count().collect()
    assert {(r.rule_id, r.line): r["count"] for r in got} == {("unvalidated_output", 2): 200, ("safety_filter_missing", 3): 200}

from siftkite.operators import linking
from siftkite.functions import priorities as P
from pyspark.sql import functions as F


def test_reachable_without_entries(spark):
    sinks = spark.createDataFrame([("a/x.py",), ("b/y.py",), (None,)], "path string")
    entries = spark.createDataFrame([("a/m.py", 3), ("a/n.py", 1), ("c/z.py", 0)], "path string, pos int")
    calls = spark.createDataFrame([("c/z.py", "a/x.py"), ("a/m.py", "a/x.py"), ("c/z.py", "a/x.py")], "entry string, sink string")
    got = {r.path: tuple(r)[1:] for r in linking.reachable(sinks, entries, calls).collect()}
    assert got["a/x.py"] == (3, "c/z.py", True, None, 0.8) and got["b/y.py"] == (0, None, False, 0.0, 0.9)
    none = {r.path: tuple(r)[1:] for r in linking.reachable(sinks, entries.limit(0), calls).collect()}
    assert none["a/x.py"] == none["b/y.py"] == (0, None, True, 0.7, 0.3)


def test_first_match_takes_the_first_of_either_kind(spark):
    signals = spark.createDataFrame([(1, "f:1", "sql"), (2, "f:9", "SQL"), (3, "f:9", "none"), (4, None, None)], "pos int, location string, kind string")
    findings = spark.createDataFrame([(7, "f:1", "xss"), (8, "f:2", "Blind_SQL_injection"), (9, None, None)], "at_pos int, location string, kind string")
    got = {r.pos: r.matched for r in linking.first_match(signals, findings, key="pos", location="location", kind="kind", order="at_pos").collect()}
    assert got == {1: 7, 2: 8, 3: None, 4: None}


def test_overrides(spark):
    rows = [(d, s) for d in ("CONFIRMED", "REFINED", "REJECTED", "OTHER", None) for s in ("NEW", "CONFIRMED", "REFINED", "REJECTED", None)]
    got = {(r.d, r.s): (r.m, r.o) for r in spark.createDataFrame(rows, "d string, s string").select("d", "s", P.merged_state(F.col("d"), F.col("s")).alias("m"), P.overrides(F.col("d"), F.col("s")).alias("o")).collect()}
    for d, s in rows:
        state = s or "NEW"
        replaces = (d in ("CONFIRMED", "REJECTED") and d != state) or (d == "REFINED" and state not in ("CONFIRMED", "REFINED"))
        assert got[d, s] == (d if replaces else state, replaces)


def test_flat_report_of_null_arrays(spark):
    df = spark.createDataFrame([(1, [("high",), (None,)], None), (2, None, [(5,), (None,)])], "report_id int, findings array<struct<severity:string>>, token_records array<struct<total_tokens:int>>")
    assert {tuple(r) for r in linking.flat_report(df).collect()} == {(1, 2, 1, 0, 0), (2, 0, 0, 2, 5)}

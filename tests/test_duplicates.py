import datetime
import random
from collections import Counter

from siftkite.streaming import duplicates as D

START = datetime.datetime(2024, 1, 1)
SCHEMA = "signal_id string, ts timestamp, pos long, location string, description string"


def at(s):
    return START + datetime.timedelta(seconds=s)


def loop(rows, age, until):
    """All signals in order; every place's live list is looked through for each."""
    live, out = {}, Counter()

    def drop(place, now):
        for e in [e for e in live.get(place, []) if e[2] + age <= now]:
            live[place].remove(e)
            out[place, e[0], at(e[2] + age), "timeout", None] += 1

    for i, ts, _, location, text in sorted(rows, key=lambda r: (r[1], r[2])):
        now, place, text = (ts - START).total_seconds(), (location or "").lower(), (text or "").lower()
        if not place:
            known = next((e for e in live.get(("", i), []) if e[2] + age > now), None)
            gone = [e for e in live.get(("", i), []) if e[2] + age <= now]
            for e in gone:
                out["", i, at(e[2] + age), "timeout", None] += 1
            live["", i] = [[i, text, now]]
            out["", i, ts, "again" if known else "new", None] += 1
            continue
        drop(place, now)
        held = live.setdefault(place, [])
        same = next((e for e in held if e[0] == i), None)
        dup = next((e for e in held if (text and e[1] and (text in e[1] or e[1] in text or (len(text) >= 20 and len(e[1]) >= 20 and text[:20] == e[1][:20]))) or (not text and not e[1])), None)
        if same or dup:
            (same or dup)[2] = max((same or dup)[2], now)
            out[place, i, ts, "again" if same else "duplicate", None if same else dup[0]] += 1
        else:
            held.append([i, text, now])
            out[place, i, ts, "new", None] += 1
    for place in live:
        for e in live[place]:
            if e[2] + age <= until:
                out["" if isinstance(place, tuple) else place, e[0], at(e[2] + age), "timeout", None] += 1
    return out


def some_rows(n=300):
    rng = random.Random(2)
    texts = ["sql injection", "SQL injection in login form of the shop", "sql injection in login page", "xss", None, "", "a long description of a thing", "a long description of another", "x"]
    t, rows = 0, []
    for pos in range(n):
        t += rng.choice([0, 1, 5, 30, 200])
        rows.append((f"s{rng.randrange(120)}", at(t), pos, rng.choice(["F.py:1", "f.py:1", "g.py:2", "", None, "hot"]), rng.choice(texts)))
    return rows, t


def test_batch_is_the_loop(spark):
    rows, t = some_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = Counter(tuple(r) for r in D.near_duplicates(df, at(t + 50), max_age_s=100).collect())
    want = loop(rows, 100, t + 50)
    assert got == want and {k[3] for k in want} == {"new", "duplicate", "again", "timeout"}
    assert D.near_duplicates(df.limit(0), at(0)).count() == 0 and D.near_duplicates(df).filter("kind = 'new'").count() > 0


def test_the_stream_is_the_batch_and_state_goes(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", D.PROVIDER)
    try:
        rows, t = some_rows(120)
        rows.append(("end", at(t + 1000), 999, "elsewhere", "end"))
        for i in range(0, len(rows), 40):
            spark.createDataFrame(rows[i : i + 40], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for i, name in enumerate(sorted((tmp_path / "in").glob("*.parquet"), key=lambda p: p.stat().st_mtime)):  # files are read in the order of their times
            import os

            os.utime(name, (1_700_000_000 + i * 10, 1_700_000_000 + i * 10))
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

        def run():  # a second start goes on from the first one's state
            q = D.near_duplicates_stream(source, "0 seconds", max_age_s=100).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").start()
            q.processAllAvailable()
            q.stop()

        run()
        spark.createDataFrame([("late", at(t + 2000), 1000, "elsewhere", "other")], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run()
        rows.append(("late", at(t + 2000), 1000, "elsewhere", "other"))
        got = Counter(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(*D._COLUMNS).collect())
        assert got == Counter(tuple(r) for r in D.near_duplicates(spark.createDataFrame(rows, SCHEMA), at(t + 2000), max_age_s=100).collect())
        state = spark.read.format("statestore").option("path", str(tmp_path / "state")).option("stateVarName", "live").load()
        assert state.count() == 1  # all but the last signal's place has expired
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)

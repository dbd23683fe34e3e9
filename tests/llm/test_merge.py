import hashlib
import json
import random
import zlib
from collections import Counter

import oracle
import pytest

from siftkite.llm import merge, queries


def code(branch, doc_id, name):
    return zlib.crc32(f"{branch}:{'' if doc_id is None else doc_id}:{name}".encode()) % 11


def joined(base, left, right):
    """(merged state, verdict) of one unit; None: absent."""
    if left == right:
        return left, None if left == base else "clean"
    if right == base or left == base:
        return (left if right == base else right), "clean"
    return base, "insert_insert" if base is None else "edit_delete" if None in (left, right) else "edit_edit"


def brute(docs):
    """Whole documents in plain Python: branch by branch, then unit by unit."""
    keyed = {}
    for i, *values in docs:
        row = tuple(v or "" for v in values)
        keyed[i] = max(keyed.get(i, row), row)
    edit = lambda c, v, empty: {0: empty, 1: v + "!", 2: v + "?"}.get(c, v)
    out, added = {}, {}
    for i, (text, lang, source) in keyed.items():
        lines = text.split("\n")
        branch = {}
        for b in "LR":
            columns = [edit(code(b, i, n), v, "") for n, v in (("lang", lang), ("source", source))]
            codes = [code(b, i, k) for k in range(len(lines))]
            branch[b] = columns, [edit(c, x, None) for c, x in zip(codes, lines, strict=True)], [{3: "!", 4: "?"}.get(c) for c in codes], code(b, i, "row")
            if i is not None and branch[b][3] in (3, 4):
                added.setdefault((-1 if b == "L" else -2) - i, {})[b] = ("!" if branch[b][3] == 3 else "?", lang, source)
        l, r = branch["L"], branch["R"]
        drops = [b for b in "LR" if branch[b][3] == 0]
        units = [joined(*x) for x in [*zip((lang, source), l[0], r[0], strict=True), *zip(lines, l[1], r[1], strict=True), *((None, a, b) for a, b in zip(l[2], r[2], strict=True))]]
        if drops:
            kept = branch["R" if drops == ["L"] else "L"]
            clash = len(drops) == 1 and (kept[0] != [lang, source] or kept[1] != lines or any(kept[2]))
            out[i] = (*((lang, source, text) if clash else (None,) * 3), int(not clash), 0, int(clash), 0)
            continue
        n = len(lines)
        text = [x for k in range(n) for x in (units[2 + k][0], units[2 + n + k][0]) if x is not None]
        counts = Counter(v for _, v in units)
        out[i] = (units[0][0], units[1][0], "\n".join(text), *[counts[k] for k in merge.KINDS])
    for i, by in added.items():
        if i not in keyed:
            row, verdict = joined(None, by.get("L"), by.get("R"))
            text, lang, source = row or (None,) * 3
            out[i] = (lang, source, text, *[int(verdict == k) for k in merge.KINDS])
    return Counter((i, *v) for i, v in out.items())


SCHEMA = "doc_id long, text string, lang string, source string, slot int, branch string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(5)


def some_rows(n=400):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        text = "\n".join(rng.choice(["", "a", "a line", "é\r", "-", "+", "\t", '{"q"}']) for _ in range(rng.choice([1, 1, 2, 5, 30])))
        rows.append((i, text, rng.choice(["en", "fr", "", None]), rng.choice(["s", "t", None])))
    rows += [(n, None, None, None), (n + 1, "\n" * 3000, "en", "s"), (n + 2, "x" * 300_000 + "\nend\n", "de", "s"), (None, "a\nb\nc", "en", None), (None, "a", "en", None), (-3, "q", "en", "s"), (-5, "r\nr", "en", "t")]
    return rows + [(7, "zz\nzz", "en", "s"), (7, "aa", "en", "s"), *rows[20:25]]


def test_the_merge_is_that_of_the_definition(spark, monkeypatch):
    rows = some_rows()
    want = brute(rows)
    for block in (4, 512):
        monkeypatch.setattr(merge, "BLOCK", block)
        assert Counter(map(tuple, merge.merge_edited(frame(spark, rows)).collect())) == want
    seen = Counter(k for r in want for k, n in zip(merge.KINDS, r[4:], strict=True) if n)
    assert set(seen) == set(merge.KINDS)
    unique = [r for i, r in enumerate(rows) if r[0] is not None and r[0] >= 0 and i < 400]
    assert Counter(map(tuple, merge.merge_edited(frame(spark, unique)).collect())) == brute(unique)
    assert merge.merge_edited(frame(spark, rows[:1]).limit(0)).count() == 0


def test_order_and_repeats_of_states_do_not_matter(spark):
    states = merge.edited_states(merge.keyed(frame(spark, some_rows(60))))
    once = Counter(map(tuple, merge.merge_states(states).collect()))
    assert once == Counter(map(tuple, merge.merge_states(states.unionByName(states).unionByName(states.sample(0.5, 1)).repartition(7)).collect()))


def test_own_branches(spark):
    """Changes that any branch may state: whole rows, equal edits, equal additions, states as in the base, units of rows that aren't there."""
    base = merge.base_states(merge.keyed(frame(spark, [(1, "a\nb", "en", "s"), (2, "c", "en", "s"), (3, "d", "en", "s")])))
    added = "+" + json.dumps({"text": "n", "lang": "x", "source": ""}, separators=(",", ":"))
    rows = [(1, 0, 1, "+a"), (1, 0, 2, "-"), (1, 3, 1, "+new"), (1, 3, 2, "+new"), (1, merge.LANG, 1, "+de"), (1, merge.LANG, 2, "+de"), (2, merge.ROW, 1, "-"), (2, merge.ROW, 2, "-"), (3, merge.ROW, 2, "-"), (3, 0, 1, "+d")]
    rows += [(9, merge.ROW, 1, added), (9, merge.ROW, 2, added), (8, 0, 1, "+lost")]
    out = {r.doc_id: tuple(r)[1:] for r in merge.merge_states(base.unionByName(spark.createDataFrame(rows, merge.STATES))).collect()}
    assert out == {1: ("de", "s", "b\nnew", 3, 0, 0, 0), 2: (None, None, None, 1, 0, 0, 0), 3: (None, None, None, 1, 0, 0, 0), 9: ("x", "", "n", 1, 0, 0, 0)}


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_op13(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    want = Counter((i, lang, source, text if text is None else hashlib.sha256(text.encode()).hexdigest(), *n) for i, lang, source, text, *n in brute(rows).elements())
    out = queries.op13_merge(spark, sf_dir)
    assert Counter(map(tuple, out.collect())) == want
    assert oracle.differences(out, oracle.connect(sf_dir), queries.OP13_SQL) == ""

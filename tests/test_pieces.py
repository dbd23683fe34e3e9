import json
import random
import zipfile

import pytest

from siftkite.sources import pieces as P


def elements(rng, n):
    odd = ["", "a", 'quote " here', "back\\slash", '\\"', "[{,}]", "é𝒳", "\n\t", "\\\\", '"]']
    some = lambda d: rng.choice([None, 1, -2.5, True, rng.choice(odd), *([] if d == 0 else [[some(d - 1) for _ in range(rng.randrange(3))], {rng.choice(odd): some(d - 1)}])])
    return [some(3) for _ in range(n)]


@pytest.mark.parametrize("piece", [7, 64, 1 << 20])
def test_elements_are_those_of_a_parser(spark, tmp_path, piece):
    rng = random.Random(piece)
    items = elements(rng, 40 if piece == 7 else 400)
    docs = {None: items, "Items": {"skip": [1, [2]], 'x"Items': {"Items": [9]}, "text": '"Items": [1, 2]', "Items": items, "after": [[5], 6]}}
    for field, doc in docs.items():
        for indent in (None, 2):
            path = tmp_path / f"{field}{indent}.json"
            path.write_text(json.dumps(doc, indent=indent, ensure_ascii=indent is None))
            rows = sorted(P.read_json_array(spark, f"file://{path}", field, piece_bytes=piece).collect(), key=lambda r: r["at"])
            assert [json.loads(r.text) for r in rows] == items
            raw = path.read_bytes()
            assert all(raw[r["at"] :].startswith(r.text.encode()) for r in rows)


def test_arrays_that_are_empty_or_absent(spark, tmp_path):
    for i, (text, field) in enumerate([("[]", None), (' {"a": [] , "b": 1}', "a"), ('{"a": 1}', "b"), ('{"a": {"b": [1]}}', "b"), ("", None)]):
        path = tmp_path / f"{i}.json"
        path.write_text(text)
        assert P.read_json_array(spark, f"file://{path}", field).count() == 0
    (tmp_path / "cut.json").write_text('[1, "2')
    with pytest.raises(ValueError, match="no end"):
        P.index_json(spark, f"file://{tmp_path}/cut.json")


def test_as_many_tasks_as_pieces(spark, tmp_path):
    path = tmp_path / "big.json"
    path.write_text(json.dumps({"vulnerabilities": [{"id": i, "text": "x" * 200} for i in range(20_000)]}))
    df = P.read_json_array(spark, f"file://{path}", "vulnerabilities", piece_bytes=1 << 18)
    assert df.rdd.getNumPartitions() >= 15
    assert df.selectExpr("cast(from_json(text, 'id long').id as long) as id").distinct().count() == 20_000


def test_zip_members(spark, tmp_path):
    for k in range(2):
        with zipfile.ZipFile(tmp_path / f"{k}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            for i in range(20):
                z.writestr(f"d/{k}-{i}.{'json' if i % 3 else 'txt'}", json.dumps({"i": i, "pad": "é" * 500 * i}))
    paths = [f"file://{tmp_path}/{k}.zip" for k in range(2)]
    df = P.read_zip(spark, paths, ".json", piece_bytes=60)
    assert df.rdd.getNumPartitions() > 10
    assert sorted(r.name for r in df.collect()) == sorted(f"d/{k}-{i}.json" for k in range(2) for i in range(20) if i % 3)
    assert sorted(r.i for r in P.read_zip(spark, paths).selectExpr("from_json(text, 'i int').i as i").collect()) == sorted([*range(20)] * 2)


def test_a_stream_resumes_without_loss_or_repeat(spark, tmp_path):
    path = tmp_path / "feed.json"
    path.write_text(json.dumps([{"id": i} for i in range(500)]))
    index = P.save_index(spark, "json", P.index_json(spark, f"file://{path}", piece_bytes=300))
    fail = tmp_path / "fail"
    fail.touch()

    def sink(batch, number):
        batch.selectExpr("from_json(text, 'id long').id as id").write.mode("overwrite").parquet(str(tmp_path / f"out/batch={number}"))
        if number == 2 and fail.exists():
            fail.unlink()
            raise RuntimeError("killed after the write and before the commit")

    def run():
        q = P.stream_pieces(spark, index, f"file://{tmp_path}/progress/at.json", per_batch=4).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "state")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    with pytest.raises(Exception, match="killed"):
        run()
    run()
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.id for r in rows.collect()) == list(range(500)) and rows.select("batch").distinct().count() > 3
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 500

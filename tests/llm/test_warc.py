import hashlib
import struct
from collections import Counter

import oracle
import pytest
import zstandard

from siftkite.llm import queries, warc

SCHEMA = "page_id long, url string, html string, digest string, again int"


def brute(rows):
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    out = Counter()
    for i, _, html in rows:
        data = (html or "").encode()
        to = first.get(html or "")
        whole = len(data) < 100 or to is None or to == i
        out[i, len(data), hashlib.sha256(data).hexdigest(), "response" if whole else "revisit", None if whole else to] += 1
    return out


def page_rows():
    a, b, c = "<p>é</p>" * 30, "x" * 100, "y" * 300
    rows = [(5, "http://h/ü r\n", a), (2, None, a), (9, "u", a), (1, "u", b), (0, "u", b[:-1]), (7, "u", b[:-1]), (3, "u", None), (4, "u", ""), (6, "u", "z" * 3_000_000)]
    return rows + [(2, None, a), (5, "other", a), (None, "u", a), (None, "u", c), (None, None, c), (11, "u", "\r\n\r\nWARC/1.1\r\n" * 20), (-4, "u", b)] + [(100 + i, "u", "copy " * 40) for i in range(300)]


def test_the_round_trip_and_its_rows(spark):
    rows = page_rows()
    pages = spark.createDataFrame([(*r, "d", 1) for r in rows], SCHEMA).repartition(5)
    out = warc.write_and_read(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert Counter(map(tuple, out.collect())) == brute(rows)
    assert warc.write_and_read(pages.filter("page_id > 1000")).count() == 0


def test_payloads_and_slices(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SLICE_BYTES", 2000)
    rows = page_rows()
    manifest = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), f"file://{tmp_path}/w")
    assert manifest.count() > 2 and manifest.agg({"n_records": "sum"}).first()[0] == len(rows)
    held = warc.with_full_payloads(warc.read_archives(manifest, with_payload=True))
    assert Counter((warc.page_of(r.record_id), r.payload.decode()) for r in held.collect()) == Counter((i, h or "") for i, _, h in rows)
    paths = sorted({r.path for r in manifest.collect()})
    assert warc.read_archives(warc.list_archives(spark, paths)).count() == len(rows)
    with pytest.raises(Exception, match="in the manifest"):
        warc.read_archives(manifest.selectExpr("path", "first", "last", "n_records + 1 as n_records")).count()


@pytest.mark.parametrize("samples", [[], [b"ab"], [b"some bytes in common %d " % i * 20 for i in range(200)]])
def test_archives_of_others(tmp_path, samples):
    """Dictionaries raw and compressed, frames without content size or checksum, skippable frames between records, chunks smaller than frames."""
    raw = warc.make_dictionary(samples)
    made = [warc.write_record("response", i, "http://h/", b"some bytes in common %d " % i * (1 + i * 40), len(b"some bytes in common %d " % i) * (1 + i * 40), hashlib.sha256(b"some bytes in common %d " % i * (1 + i * 40)).hexdigest()) for i in range(30)]
    for lead in [warc.dictionary_frame(raw), struct.pack("<II", warc.DICTIONARY_MAGIC, len(raw)) + raw, *([b""] if not raw else [])]:
        body = b""
        for i, m in enumerate(made):
            press = zstandard.ZstdCompressor(level=1 + i % 5, dict_data=warc._dictionary(raw), write_content_size=i % 2 == 0, write_checksum=i % 3 == 0)
            body += press.compress(m) if i % 2 == 0 else (lambda o: o.compress(m) + o.flush())(press.compressobj())
            body += struct.pack("<II", warc.SKIPPABLE_MAGIC + i % 16, 5) + b"skip!" if i % 4 == 0 else b""
        path = tmp_path / "a.warc.zst"
        path.write_bytes(lead + body)
        for chunk in (1, 50, 1 << 20):
            got = list(warc.read_slice(str(path), 0, None, chunk))
            assert [warc.page_of(r["record_id"]) for _, r in got] == list(range(30))
        at = got[11][0]
        assert [warc.page_of(r["record_id"]) for _, r in warc.read_slice(str(path), at, got[14][0])] == [11, 12, 13]
        for cut in (1, 4, 30):
            path.write_bytes((lead + body)[:-cut])
            with pytest.raises(ValueError, match="at"):
                list(warc.read_slice(str(path), 0, None))
        broken = bytearray(lead + body)
        broken[at] ^= 1
        path.write_bytes(broken)
        with pytest.raises(ValueError, match=f"at {at}"):
            list(warc.read_slice(str(path), 0, None))


def test_faults_are_errors():
    good = warc.write_record("response", 3, "http://h/", b"payload", 7, hashlib.sha256(b"payload").hexdigest())
    assert warc.read_record(good)["payload"] == b"payload"
    again = warc.write_record("revisit", 4, "u", b"", 7, "00", 3)
    assert warc.read_record(again)["payload_bytes"] == 7
    for data in (
        good.replace(b"WARC/1.1", b"WARC/9.1"),
        good.replace(b"WARC-Date", b"X-Date"),
        good.replace(b"WARC-Record-ID: <urn:page:3>\r\n", b""),
        good.replace(b"payload\r\n\r\n", b"payloads\r\n\r\n"),
        good.replace(b"payload\r\n\r\n", b"paylaod\r\n\r\n"),
        good.replace(b"Content-Length: 7", b"Content-Length: 6"),
        good.replace(b"Content-Length: 7", b"Content-Length: x"),
        good[:-1],
        good + b"\n",
        good.replace(b"HTTP/1.1", b"XTTP/1.1"),
        good.replace(b"WARC-Type: response", b"no colon here"),
        again.replace(b"WARC-Refers-To: <urn:page:3>\r\n", b""),
        b"",
    ):
        with pytest.raises(ValueError):
            warc.read_record(data)


def test_op12_is_its_sql(spark, sf):
    assert oracle.differences(queries.op12_warc(spark, sf), oracle.connect(sf), queries.OP12_SQL) == ""

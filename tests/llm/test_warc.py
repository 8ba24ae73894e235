import glob
import gzip
import hashlib
import io
import uuid

import pytest

from quire.llm import warc


@pytest.mark.parametrize("version", [1, 2])
def test_arc_files_are_read_by_version_and_length(version):
    pages = [("http://a/ b", "text/html", b"HTTP/1.1 200 OK\r\n\r\n<p>\n\nx</p>\r\n\r\n"), ("http://b", "text/dns", b""), ("http://c", "text/plain", b"1 2 3 4 5\nURL x\n")]
    info, *records = warc.read_arc(warc.write_arc(pages, version))
    assert info.fields["url"] == "filedesc://pages.arc" and [r.body for r in records] == [p[2] for p in pages]
    assert [r.fields["url"] for r in records] == ["http://a/%20b", "http://b", "http://c"]
    out = [warc.to_warc(r) for r in (info, *records)]
    assert [r.fields["WARC-Type"] for r in out] == ["warcinfo", "response", "resource", "resource"]
    assert out[1].fields["WARC-Date"] == "2024-01-01T00:00:00Z" and out[1].fields["Content-Type"] == "application/http;msgtype=response"
    assert out[1].fields["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(b"<p>\n\nx</p>\r\n\r\n").hexdigest()
    assert len({r.fields["WARC-Record-ID"] for r in out}) == 4
    stream = io.BytesIO(warc.END.join(r.to_bytes() for r in out) + warc.END)
    assert [(r.fields, r.block) for r in warc.read_warc(stream)] == [(r.fields, r.block) for r in out]


def test_damaged_arc_files_are_errors():
    good = warc.write_arc([("http://a", "text/html", b"abc")], 1)
    for bad in (good[:-1], good.replace(b"\n1 0 ", b"\n7 0 ", 1), good.replace(b"http://a ", b"http://a x ")):
        with pytest.raises(ValueError):
            list(warc.read_arc(bad))


def test_short_dates():
    assert warc._timestamp("2001") == "2001-01-01T00:00:00Z" and warc._timestamp("20011231") == "2001-12-31T00:00:00Z"


def test_round_trip(spark):
    big = "<html>\r\n\r\nWARC/1.1\r\n\r\n é日" * 9
    rows = [(5, "http://x/1", big), (2, "http://x/2", big), (9, None, big), (None, "u", big), (3, "http://x", "short"), (4, "http://x", "short"), (6, "a b\nc", None), (7, "", ""), (8, "http://y", "z" * 200_000), (2, "http://x/2", big), (10, "http://e", "ä" * 50), (11, "http://e", "ä" * 50), (12, "http://f", "b" * 99), (13, "http://f", "b" * 99)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int").repartition(3)
    got = warc.round_trip(df).collect()
    assert len(got) == len(rows)
    html = {r[0]: (r[2] or "").encode() for r in rows}
    for r in got:
        body = html[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha256(body).hexdigest())
        if r.page_id in (5, 9, None):
            assert (r.record_type, r.refers_to) == ("revisit", 2)
        elif r.page_id == 11:
            assert (r.record_type, r.refers_to) == ("revisit", 10)
        else:
            assert (r.record_type, r.refers_to) == ("response", None)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_files_are_plain_warc_and_references_resolve(spark, tmp_path):
    folder = str(tmp_path / uuid.uuid4().hex)
    df = spark.createDataFrame([(i, f"http://x/{i}", "same payload " * 20) for i in range(6)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(df, folder)
    records = [r for f in glob.glob(folder + "/*.gz") for r in warc.read_warc(io.BytesIO(gzip.open(f).read()))]
    kinds = [r.fields["WARC-Type"] for r in records]
    assert kinds.count("response") == 1 and kinds.count("revisit") == 5
    home = next(r for r in records if r.fields["WARC-Type"] == "response")
    assert {r.fields["WARC-Refers-To"] for r in records if r.fields["WARC-Type"] == "revisit"} == {home.fields["WARC-Record-ID"]}
    assert len({r.fields["WARC-Record-ID"] for r in records}) == 6
    assert all(r.block == warc.http_parts(r.block)[0] for r in records if r.fields["WARC-Type"] == "revisit")


def test_page_ids_may_be_text(spark):
    df = spark.createDataFrame([("b", "u", "page " * 50), ("a", "u", "page " * 50), (None, "u", "x")], "page_id string, url string, html string")
    assert sorted((r.page_id or "", r.record_type, r.refers_to) for r in warc.round_trip(df).collect()) == [("", "response", None), ("a", "response", None), ("b", "revisit", "a")]


def test_repeated_payloads_by_shuffle_equal_those_by_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([(i, "u", f"page {i % 5} " * 50) for i in range(40)], "page_id long, url string, html string").repartition(4)
    want = sorted(tuple(r) for r in warc.round_trip(df).fillna(-1).collect())
    monkeypatch.setattr(warc, "BROADCAST_PAYLOADS", -1)
    assert sorted(tuple(r) for r in warc.round_trip(df).fillna(-1).collect()) == want and len(want) == 40


def test_folders_of_legacy_archives_are_converted(spark, tmp_path):
    bodies = [b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>\xe9\xff \r\n\r\n</p>" + bytes([i]) * i for i in range(7)]
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "one.arc").write_bytes(warc.write_arc([(f"http://x/{i}", "text/html", b) for i, b in enumerate(bodies[:3])], 1, "one.arc"))
    (tmp_path / "in" / "deep" / "two.arc.gz").write_bytes(gzip.compress(warc.write_arc([(f"http://x/{3 + i}", "text/html", b) for i, b in enumerate(bodies[3:])], 2, "two.arc", "2003")))
    folder = str(tmp_path / "out")
    warc.convert_archives(spark, str(tmp_path / "in"), folder)
    records = [r for f in glob.glob(folder + "/*.gz") for r in warc.read_warc(io.BytesIO(gzip.open(f).read()))]
    found = {r.fields["WARC-Target-URI"]: r.block for r in records if r.fields["WARC-Type"] == "response"}
    assert found == {f"http://x/{i}": b for i, b in enumerate(bodies)} and len(records) == 9
    assert {r.fields["WARC-Date"] for r in records} == {"2024-01-01T00:00:00Z", "2003-01-01T00:00:00Z"}
    rows = warc.read_archives(spark, folder).where("record_type = 'response'").collect()
    assert {r.target_uri: r.payload_bytes for r in rows} == {f"http://x/{i}": len(warc.http_parts(b)[1]) for i, b in enumerate(bodies)}
    (tmp_path / "in" / "bad.arc").write_bytes(b"no archive")
    with pytest.raises(Exception, match="bad.arc"):
        warc.convert_archives(spark, str(tmp_path / "in"), folder + "2")

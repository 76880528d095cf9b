"""WARC archives: bytes, round trip, transactions."""

import base64
import glob
import gzip
import hashlib

import pytest

from octavilla.llm import warc
from octavilla.llm.common import shared_folder

ROWS = [
    (1, "http://a.example/x?y=1", "<p>one</p>"), (2, "http://a.example", "<p>one</p>"), (9, "https://b.example/ä", "<p>one</p>"),
    (3, None, None), (4, "http://c.example/\r\nX: y", ""), (5, "u", "é\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nWARC/"),
    (6, "u", "z" * 5000), (6, "v", "z" * 5000), (7, "u", "twice"), (7, "u", "twice"), (7, "u", "other"), (None, "u", "lost"),
    (None, "u", "twice"),
]


def write(spark, rows, least=0):
    path = shared_folder(spark, "w")
    frame = spark.createDataFrame([(*r, 5, "x") for r in rows], "page_id long, url string, html string, dup int, sha string").repartition(3)
    warc.write_archives(frame, path, "2026-01-01T00:00:00Z", least)
    return path


def expected(rows, least=0):
    groups = {}
    for i, _, html in rows:
        groups.setdefault(html or "", []).append(i)
    out = []
    for html, ids in groups.items():
        known = [i for i in ids if i is not None]
        lead = max(known) if known else None
        left = ids.copy()
        left.remove(lead)
        b = html.encode()
        digest = base64.b32encode(hashlib.sha1(b).digest()).decode()
        small = len(b) < least
        out.append((lead, len(b), digest, "response", None))
        out += [(i, len(b), digest, "response" if small else "revisit", None if small else lead) for i in left]
    return sorted(map(str, out))


@pytest.mark.parametrize("least", [0, 8])
def test_round_trip(spark, least, monkeypatch):
    path = write(spark, ROWS, least)
    monkeypatch.setattr(warc, "shared_folder", lambda *_: path)
    monkeypatch.setattr(warc, "write_archives", lambda *_, **__: None)
    monkeypatch.setattr(warc, "table", lambda *_: None)
    got = warc.op9_warc_transactions(spark, "").collect()
    assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got) == expected(ROWS, least)


def test_records_are_warc(spark):
    path = write(spark, ROWS)
    data = b"".join(gzip.open(f).read() for f in glob.glob(path.removeprefix("file://") + "/part-*"))
    at, kinds = 0, []
    while at < len(data):
        head, _, rest = data[at:].partition(b"\r\n\r\n")
        lines = head.split(b"\r\n")
        assert lines[0] == b"WARC/1.1"
        fields = dict(line.split(b": ", 1) for line in lines[1:])
        n = int(fields[b"Content-Length"])
        assert rest[n:n + 4] == b"\r\n\r\n" and fields[b"WARC-Record-ID"].startswith(b"<urn:uuid:")
        kinds.append(fields[b"WARC-Type"])
        at += len(head) + 4 + n + 4
    assert len(kinds) == 3 * len(ROWS) and kinds.count(b"request") == kinds.count(b"metadata") == len(ROWS)


def test_transactions_nest(spark):
    rows = warc.transactions(warc.read_records(spark, write(spark, ROWS))).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert len(r.requests) == len(r.metadata) == 1
        assert (r.original is None) == (r.capture.type == "response")
        assert r.capture.type == "revisit" or hashlib.sha1(bytes(r.capture.payload)).digest() == base64.b32decode(r.capture.computed_digest)
    payloads = {bytes(r.capture.payload).decode() for r in rows if r.capture.type == "response"}
    assert payloads == {h or "" for _, _, h in ROWS}


def test_lone_records_and_empty_tables(spark):
    schema = warc._RECORD
    none = (None,) * 8
    rows = [("a", "response", *none[:6], 3, None, b"abc"), ("q", "request", "a", *none[:5], None, None, None),
            ("q2", "request", "a", *none[:5], None, None, None), ("m", "metadata", "nowhere", *none[:5], None, {"page-id": "4"}, None),
            ("r", "revisit", None, "gone", *none[:4], None, None, None)]
    got = {r.record_id: r for r in warc.transactions(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == {"a", "r"} and [q.record_id for q in got["a"].requests] == ["q", "q2"]
    assert got["r"].requests == [] and got["r"].metadata == [] and got["r"].original is None
    path = write(spark, [])
    assert warc.transactions(warc.read_records(spark, path)).count() == 0


def test_archive_with_a_gzip_member_per_record(spark, tmp_path):
    records = [f"WARC/1.1\r\nWARC-Type: metadata\r\nWARC-Record-ID: <r{i}>\r\nContent-Length: 6\r\n\r\nid: {i:02d}\r\n\r\n".encode() for i in range(5)]
    (tmp_path / "usual.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    got = warc.read_records(spark, str(tmp_path)).collect()
    assert sorted((r.record_id, r.fields["id"]) for r in got) == [(f"<r{i}>", f"{i:02d}") for i in range(5)]

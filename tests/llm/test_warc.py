"""WARC round trips, revisits, damaged archives with exact gaps, and ranges that cut records."""

import hashlib

import pytest
from llm_compare import differences

from geoloom.llm import warc


def record(k, body, url="http://a/"):
    return warc.record("response", k, url, body, hashlib.sha256(body).hexdigest(), len(body))


BODIES = [b"first", b"", b"two\r\n\r\nWARC/1.1\r\nparts" * 30, b"x" * 5000, b"\x1f\x8b\x08 no member", b"last"]


@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("range_bytes", [1 << 20, 97])
def test_damage_is_skipped_and_logged(spark, tmp_path, packed, range_bytes):
    parts = [record(k, b) for k, b in enumerate(BODIES)]
    if packed:
        parts = [warc.member(p) for p in parts]
    noise = b"\x00garbage\x1f\x8b\x08WARC/1.1\r\n" * 3
    broken = bytearray(parts[3])
    broken[len(broken) // 2] ^= 0xFF
    data = parts[0] + noise + parts[1] + parts[2] + bytes(broken) + parts[4] + parts[5][: len(parts[5]) // 2] + parts[5]
    path = tmp_path / "a.warc"
    path.write_bytes(data)
    files = warc.list_archives(spark, str(tmp_path))
    got = warc.read_archives(files, with_payload=True, range_bytes=range_bytes).orderBy("start").collect()
    assert [r.record_id for r in got] == ["0", "1", "2", "4", "5"]
    assert [bytes(r.payload) for r in got] == [BODIES[k] for k in (0, 1, 2, 4, 5)]
    lost = warc.gaps(files, warc.read_archives(files, range_bytes=range_bytes)).orderBy("start").collect()
    assert [(r.start, r.size) for r in lost] == [
        (len(parts[0]), len(noise)),
        (len(parts[0] + noise + parts[1] + parts[2]), len(broken)),
        (len(data) - len(parts[5]) - len(parts[5]) // 2, len(parts[5]) // 2),
    ]


def test_record_inside_a_payload(spark, tmp_path):
    inner = record(7, b"inner body")
    (tmp_path / "a.warc").write_bytes(record(1, b"." * 300 + inner + b"." * 300) + record(2, b"z"))
    files = warc.list_archives(spark, str(tmp_path))
    for n in (64, 1 << 20):
        assert sorted(r.record_id for r in warc.read_archives(files, range_bytes=n).collect()) == ["1", "2"]


def test_rows_with_nulls_and_copies(spark, tmp_path):
    long = "é" * 60
    rows = [(4, "u", long, 1), (2, None, long, 1), (2, "u\r\nX: y", long, 1), (9, "u", "short", 1), (1, "u", "short", 1), (None, "u", None, 1), (3, "u", "", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    files = warc.write_archives(pages, str(tmp_path / "out"))
    got = warc.read_archives(files).collect()
    key = lambda x: (str(x[0]), x[1], str(x[2]), x[3])
    want = [("4", "revisit", "2", 120), ("2", "response", None, 120), ("2", "response", None, 120), ("9", "response", None, 5),
            ("1", "response", None, 5), (None, "response", None, 0), ("3", "response", None, 0)]
    assert sorted(((r.record_id, r.record_type, r.refers_to, r.payload_bytes) for r in got), key=key) == sorted(want, key=key)
    assert all(r.payload_digest == hashlib.sha256(long.encode()).hexdigest() for r in got if r.payload_bytes == 120)
    assert warc.read_archives(warc.write_archives(pages.where("false"), str(tmp_path / "none"))).collect() == []


def test_damaged_heads_are_quarantined(spark, tmp_path):
    good = record(1, b"good body")
    revisit = warc.record("revisit", 2, "u", None, "ab", 1234, 1)
    heads = [
        revisit.replace(b"X-Payload-Length: 1234", b"X-Payload-Length: ten"), good.replace(b"Content-Length: ", b"Content-Length: \xc2\xb2"),
        good.replace(b"Content-Length: ", b"Content-Length: -"), good.replace(b"WARC-Type: ", b"no colon here\r\nWARC-Type "),
    ]
    data = b"".join(h + good for h in heads)
    (tmp_path / "a.warc").write_bytes(data)
    files = warc.list_archives(spark, str(tmp_path))
    assert [r.record_id for r in warc.read_archives(files).collect()] == ["1"] * len(heads)
    assert sum(r.size for r in warc.gaps(files, warc.read_archives(files)).collect()) == sum(map(len, heads))


def test_long_heads_and_foreign_digests():
    import base64

    body = b"some payload"
    sha1 = hashlib.sha1(body)
    base = [b"WARC/1.0", b"WARC-Type: resource", b"Content-Length: %d" % len(body)]
    for name, value, good in (
        ("sha1", base64.b32encode(sha1.digest()).decode(), True), ("SHA-1", sha1.hexdigest().upper(), True), ("sha1", "A" * 32, False),
        ("md5", hashlib.md5(body).hexdigest(), True), ("sha256", "0" * 64, False), ("crc9", "whatever", True),
    ):
        for field in ("WARC-Block-Digest", "WARC-Payload-Digest"):
            data = b"\r\n".join([*base, f"{field}: {name}:{value}".encode()]) + b"\r\n\r\n" + body + b"\r\n\r\n"
            assert (warc.parse(data) is not None) == good
    import io

    head = b"\r\n".join([*base, *(b"X-%d: %s" % (k, b"v" * 1000) for k in range(3000))])
    data = head + b"\r\n\r\n" + body + b"\r\n\r\n"
    assert len(head) > 3_000_000
    for whole in (data, warc.member(data)):
        got = list(warc.salvage(warc.Reader(io.BytesIO(whole), len(whole)), 0, len(whole)))
        assert [(a, n, f["payload"]) for a, n, f in got] == [(0, len(whole), body)]


def test_revisits_of_other_writers():
    head = b"HTTP/1.1 200 OK\r\nContent-Length: 77\r\n\r\n"
    for block, extra, want in ((head, b"", (77, None)), (b"", b"WARC-Payload-Digest: sha1:ABC\r\n", (None, "sha1:ABC"))):
        data = b"WARC/1.1\r\nWARC-Type: revisit\r\n" + extra + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
        got = warc.parse(data)
        assert (got["payload_bytes"], got["payload_digest"]) == want


def test_text_ids_and_lost_records(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    ids = ["a b", "ü>%", "", None, "x\r\nWARC-Type: y", "10"]
    pq.write_table(pa.table({"page_id": ids, "url": ["u"] * 6, "html": ["h" * 200] * 3 + ["k", None, "h" * 200]}), tmp_path / "pages.parquet")
    got = warc.report(spark, str(tmp_path)).collect()
    assert sorted((str(r.page_id), r.record_type, str(r.refers_to)) for r in got) == sorted(
        [("a b", "revisit", ""), ("ü>%", "revisit", ""), ("", "response", "None"), ("None", "response", "None"), (ids[4], "response", "None"), ("10", "revisit", "")]
    )
    pages = spark.read.parquet(str(tmp_path / "pages.parquet"))
    files = warc.write_archives(pages, str(tmp_path / "out"))
    path = files.first().path
    with open(path, "r+b") as f:
        f.seek(3)
        f.write(b"\xff\xff")
    with pytest.raises(RuntimeError, match="6 records written, 5 read"):
        warc.all_read(files, warc.read_archives(files))


def test_query(spark):
    assert differences(spark, "op5_warc", "/root/testdata/sf0.001") == []

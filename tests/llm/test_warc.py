import base64
import hashlib
import struct

import pytest
import zstandard

from weftgraph.llm import warc as W


def expected(rows):
    last = {}
    for p, _, h in rows:
        k = h or ""
        if p is not None:
            last[k] = max(last.get(k, p), p)
    out = []
    for p, _, h in rows:
        b = (h or "").encode()
        top = last.get(h or "")
        many = sum((x[2] or "") == (h or "") for x in rows) > 1
        ref = top if many and top is not None and p != top else None
        out.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if ref is None else "revisit", ref))
    return sorted(out, key=str)


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, W.op8_warc_zstd(spark, sf).collect()), key=str) == expected(rows)


def test_copies_nulls_and_odd_urls(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<p>{i % 7}é</p>" * (i % 5)) for i in range(60)]
    rows += [(70, None, None), (71, "http://x/\r\nWARC-Type: evil é", ""), (72, "", "a\r\n\r\nb"), (3, "http://again", "<p>3é</p>" * 3), (None, "u", "only"), (None, "v", "<p>1é</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as last", "'x' as sha1", "2 as refers_to").repartition(3)
    W.write_archives(df, str(tmp_path / "a"))
    back = W.read_archives(spark.read.parquet(str(tmp_path / "a"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(tuple, back.collect()), key=str) == expected(rows)


def test_empty_table(spark, tmp_path):
    W.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "a"))
    assert W.read_archives(spark.read.schema("n_records long, content binary").parquet(str(tmp_path / "a"))).count() == 0


def archive(n=40):
    out = []
    for i in range(n):
        p = f"<html><body>page {i} of many, with words that return {i * i}</body></html>".encode() * 20
        out.append(W.record(i, f"http://h/{i}", p, base64.b32encode(hashlib.sha1(p).digest()).decode(), None))
    return out


def test_dictionary_and_files(spark, tmp_path):
    recs = archive()
    data = W.pack(recs)
    assert struct.unpack_from("<I", data)[0] == W.DICTIONARY_FRAME
    assert [r for _, r in W.records(data)] == recs
    plain = zstandard.ZstdDecompressor().decompress(data[8 : 8 + struct.unpack_from("<I", data, 4)[0]])
    raw = struct.pack("<II", W.DICTIONARY_FRAME, len(plain)) + plain + data[8 + struct.unpack_from("<I", data, 4)[0] :]
    assert [r for _, r in W.records(raw)] == recs  # the dictionary may be stored as it is
    assert [r for _, r in W.records(W.pack(recs[:2]))] == recs[:2]
    other = data + struct.pack("<II", 0x184D2A51, 3) + b"xyz" + W.pack(recs[:1])
    (tmp_path / "x.warc.zst").write_bytes(other)
    assert W.read_files(spark, str(tmp_path / "x.warc.zst")).count() == 41


def test_damage_is_found():
    recs = archive(12)
    data = W.pack(recs)
    for bad in (data[:-3], data[:6], data[:-1] + bytes([data[-1] ^ 1]), b"junkjunkjunk", data + b"\0" * 9):
        with pytest.raises(ValueError):
            list(W.records(bad))
    good = recs[0]
    for bad in (good.replace(b"WARC/1.1", b"WARC/9.9"), good[:-1], good.replace(b"page 0", b"page 9", 1), good.replace(b"Content-Length: ", b"Content-Length: 1", 1), good.replace(b"WARC-Date: ", b"WARC-Date", 1), good.replace(b"response", b"metadata", 1)):
        with pytest.raises((ValueError, KeyError)):
            W.parse(bad)


@pytest.mark.parametrize("n", [1, 2, 7, 12])
def test_every_archive_leads_with_a_dictionary(n):
    recs = archive(n)
    data = W.pack(recs)
    assert struct.unpack_from("<I", data)[0] == W.DICTIONARY_FRAME
    assert [r for _, r in W.records(data)] == recs
    assert [r for _, r in W.records(data + W.pack(recs[:1]))] == recs + recs[:1]
    bare = zstandard.ZstdCompressor(level=W.LEVEL, write_checksum=True).compress(recs[0])
    first = [e - s for m, s, e in W.frames(data) if m == W.ZSTD_MAGIC][0]
    assert first < len(bare)


def foreign(kind, block, **fields):
    lines = ["WARC/1.0", f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:12345678-1234-1234-1234-123456789abc>", "WARC-Date: 2020-01-01T00:00:00Z"]
    lines += [f"{k.replace('_', '-')}: {v}" for k, v in fields.items()] + [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def test_foreign_archives(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nServer: x\r\nX-Odd\r\n\r\n"
    recs = [
        foreign("warcinfo", b"software: any\r\n", Content_Type="application/warc-fields"),
        foreign("request", b"GET / HTTP/1.1\r\nHost: h\r\n\r\n", Content_Type="application/http;msgtype=request", WARC_Target_URI="http://h/"),
        foreign("response", http + b"hello", Content_Type="application/http;msgtype=response", WARC_Target_URI="http://h/"),
        foreign("response", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nContent-Length: 99\r\n\r\nhello", Content_Type="application/http", WARC_Payload_Digest="sha1:ANY"),
        foreign("revisit", http, Content_Type="application/http", WARC_Profile="http://netpreserve.org/warc/1.0/revisit/server-not-modified", WARC_Refers_To="<urn:uuid:1>"),
        foreign("resource", b"\0\1", WARC_Payload_Digest="sha256:" + hashlib.sha256(b"\0\1").hexdigest()),
    ]
    packer, body = zstandard.ZstdCompressor(level=3), b""
    for r in recs:
        stream = packer.compressobj()  # no content size in the frame
        body += stream.compress(r) + stream.flush()
    (tmp_path / "f.warc.zst").write_bytes(body)
    got = W.read_files(spark, str(tmp_path / "f.warc.zst")).collect()
    assert [r.record_type for r in got] == ["warcinfo", "request", "response", "response", "revisit", "resource"]
    assert [r.payload_bytes for r in got] == [15, 27, 5, 5, 0, 2] and {r.page_id for r in got} == {None}
    assert got[2].payload_digest == base64.b32encode(hashlib.sha1(b"hello").digest()).decode() and got[3].payload_digest == "ANY"
    assert got[4].refers_to_id == "<urn:uuid:1>" and got[0].record_id.startswith("<urn:uuid:")
    for bad in (foreign("resource", b"x", WARC_Payload_Digest="sha1:WRONG"), recs[2].replace(b"Content-Length: ", b"Content-Length: -"), recs[0].replace(b"WARC-Date", b"WARC-Data")):
        with pytest.raises(ValueError):
            W.parse(bad)

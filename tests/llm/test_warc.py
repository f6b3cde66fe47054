"""Archives of other writers: heads that lack fields, other record types, codings, gzip members, cut files."""

import base64
import gzip
import hashlib
import os
import zlib

import pytest

from recordloom.llm import warc


def one(kind, block=b"", **head):
    lines = ["WARC/1.0", *([f"WARC-Type: {kind}"] if kind else []), *(f"{k.replace('_', '-')}: {v}" for k, v in head.items()), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


BODY = "<p>é</p>".encode() * 300
HTTP = {"Content_Type": "application/http; msgtype=response"}


def http(body, *fields):
    return b"\r\n".join([b"HTTP/1.1 200 OK", *fields, b"", b""]) + body


CHUNKED = b"5\r\n" + BODY[:5] + b"\r\n" + f"{len(BODY) - 5:x}".encode() + b";x=1\r\n" + BODY[5:] + b"\r\n0\r\n\r\n"
SHA = hashlib.sha1(BODY).hexdigest()
RECORDS = [
    one("warcinfo", b"software: x\r\n", Content_Type="application/warc-fields"),
    one("request", b"GET / HTTP/1.1\r\n\r\n", Content_Type="application/http; msgtype=request", WARC_Target_URI="<http://a/%41>"),
    one("response", http(BODY), WARC_Target_URI="http://a/1", WARC_Payload_Digest="sha1:" + base64.b32encode(bytes.fromhex(SHA)).decode(), **HTTP),
    one("response", http(gzip.compress(BODY), b"Content-Encoding: gzip"), WARC_Target_URI="http://a/2", **HTTP),
    one("response", http(zlib.compress(BODY)[2:-4], b"content-encoding: deflate"), WARC_Target_URI="http://a/3", **HTTP),
    one("response", http(CHUNKED, b"Transfer-Encoding: chunked"), WARC_Target_URI="http://a/4", WARC_Payload_Digest="md5:00", **HTTP),
    one("response", http(b"not zipped", b"Content-Encoding: gzip"), WARC_Target_URI="http://a/5", **HTTP),
    one("revisit", http(b""), WARC_Target_URI="http://a/6", WARC_Payload_Digest=f"sha1:{SHA.upper()}", **HTTP),
    one("resource", b"", WARC_Target_URI="file:x"),
    one(None, b"x"),
]


@pytest.mark.parametrize("name", ["x.warc", "x.warc.gz"])
def test_other_archives(spark, tmp_path, name):
    whole = b"".join(gzip.compress(r) for r in RECORDS) if name.endswith("gz") else b"".join(RECORDS)
    cut = one("response", b"y" * 5000, WARC_Target_URI="http://cut")[:-1000]
    (tmp_path / name).write_bytes(whole + (gzip.compress(cut) if name.endswith("gz") else cut))
    (tmp_path / "empty.warc").write_bytes(b"")
    (tmp_path / "notes.json").write_text("{}")
    out = warc.read_archive(spark, f"file://{tmp_path}").collect()
    rows = {(r.warc_type, r.target_uri): r for r in out}
    assert len(out) == len(RECORDS) and all(r.page_id is None and r.refers_to is None for r in out)
    for k in "1234":
        r = rows["response", f"http://a/{k}"]
        assert r.payload == BODY and r.payload_length == len(BODY) and r.payload_digest == ("md5:00" if k == "4" else SHA)
    assert rows["response", "http://a/5"].payload == b"not zipped"
    r = rows["revisit", "http://a/6"]
    assert (r.payload, r.payload_digest, r.payload_length) == (None, SHA, None)
    assert rows["request", "http://a/%41"].payload == b"GET / HTTP/1.1\r\n\r\n" and rows["warcinfo", None].payload == b"software: x\r\n"
    assert (rows["resource", "file:x"].payload, rows[None, None].payload_length) == (b"", 1)
    heads = warc.read_archive(spark, f"file://{tmp_path}", payload=False)
    assert heads.where("payload is not null").count() == 0 and heads.where("warc_type = 'response'").count() == 5
    assert heads.where(f"payload_digest = '{SHA}' and payload_length > 10").count() == 3
    assert sorted(r.target_uri for r in heads.where("target_uri in ('http://a/1', 'http://a/6')").collect()) == ["http://a/1", "http://a/6"]


def test_unlisted_own_files(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    pages = spark.createDataFrame([(1, "http://a", "x" * 2000), (2, "http://b", "x" * 2000), (3, None, None)], "page_id long, url string, html string")
    warc.write_archive(warc.with_record_types(pages), folder)
    own = sorted(os.listdir(f"{tmp_path}/w"))
    data = b"".join((tmp_path / "w" / n).read_bytes() for n in own if n.endswith(".warc"))
    assert data.count(b"WARC-Refers-To: <urn:uuid:") == 1
    target = data.split(b"WARC-Refers-To: ")[1].split(b"\r\n")[0]
    assert data.count(b"WARC-Record-ID: " + target) == 1
    (tmp_path / "w" / ("part-" + "0" * 32 + ".warc")).write_bytes(RECORDS[2])  # of a failed attempt
    (tmp_path / "w" / "other.warc").write_bytes(RECORDS[2])
    assert warc.read_archive(spark, folder).count() == 4
    for n in own:
        if n.startswith("list-"):
            (tmp_path / "w" / n).unlink()
    assert warc.read_archive(spark, folder).count() == 5

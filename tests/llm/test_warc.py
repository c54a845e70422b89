import gzip
import hashlib
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidewake.llm import queries, warc
from tidewake.llm.common import shared_dir

LONG = "<p>" + "words and more " * 20 + "</p>"


def archive(spark, rows, **more):
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({"digest": F.lit("x"), "key": F.lit("y"), "original": F.lit(1)})
    return warc.archive_pages(pages, **more)


def files(path):
    return [gzip.decompress(p.read_bytes()) for p in Path(path.removeprefix("file:")).glob("*.gz")]


def parsed(raw):
    """Records by their stated length alone, as any reader of the format takes them: (headers, block)."""
    out = []
    while raw:
        head, _, rest = raw.partition(b"\r\n\r\n")
        first, *lines = head.decode().split("\r\n")
        assert first == "WARC/1.1"
        headers = dict(x.split(": ", 1) for x in lines)
        n = int(headers["Content-Length"])
        assert rest[n : n + 4] == b"\r\n\r\n"
        out.append((headers, rest[:n]))
        raw = rest[n + 4 :]
    return out


def payload(block):
    head, _, body = block.partition(b"\r\n\r\n")
    return warc.dechunk(body) if b"chunked" in head else body


TRICKY = [
    "", None, "\r\n\r\n", "WARC/1.1\r\nWARC-Type: revisit\r\n\r\n", "x\r\n\r\n\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n", "a\nWARC/1.\nWARC/1.0", "é" * 60 + "\n", "tail\r\n", "tail\r", "0\r\n\r\n", "WARC/1.WARC/1.WARC/1.",
    LONG, LONG, LONG + "é", LONG + "\nWARC/1.1\r\n" + LONG, LONG + "\nWARC/1.1\r\n" + LONG, "z" * 99, "z" * 99, "z" * 100, "z" * 100, "é" * 50, "é" * 50,
]


def expected(rows):
    first = {}
    for page, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(html or "", page)
    seen, out = set(), []
    for page, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (html or "").encode()
        again = len(raw) >= 100 and html in seen
        seen.add(html)
        out.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[html or ""] if again else None))
    return sorted(out, key=str)


def read(spark, path):
    return sorted(((None if r.page_id is None else int(r.page_id), r.n_bytes, r.digest, r.type, None if r.refers_to is None else int(r.refers_to)) for r in warc.resolved(warc.read_archive(spark, path)).collect()), key=str)


@pytest.mark.parametrize("split", ["64m", "1k"])
def test_round_trip(spark, split):
    rows = [(i * 7 % 23, None if i % 5 == 0 else f"http://a.example/{i}\r\nX: y ü\nWARC/1.1", t) for i, t in enumerate(TRICKY)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        path = f"{shared_dir(spark)}/round-{split}"
        pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
        warc.write_archive(warc.with_originals(warc.page_records(pages)), path, compression="none")  # plain files are read in splits
        back = warc.read_archive(spark, path)
        assert read(spark, path) == expected(rows) and back.filter("broken").isEmpty()
        whole = {int(r.page_id): bytes(r.payload) for r in back.filter("type = 'response'").collect()}
        assert all(whole[p] == (t or "").encode() for p, _, t in rows if p in whole)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_records_stand_alone(spark):
    """What a reader that knows only lengths finds, with fresh headers and resolvable references."""
    rows = [(i, f"http://a.example/{i}", t) for i, t in enumerate(TRICKY)]
    records = [r for raw in files(archive(spark, rows)) for r in parsed(raw)]
    assert len(records) == len(rows) and len({h["WARC-Record-ID"] for h, _ in records}) == len(rows)
    by_id = {h["WARC-Record-ID"]: (h, b) for h, b in records}
    for h, b in records:
        assert re.fullmatch(r"<urn:uuid:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}>", h["WARC-Record-ID"])
        if h["WARC-Type"] == "response":
            assert "sha256:" + hashlib.sha256(payload(b)).hexdigest() == h["WARC-Payload-Digest"]
            assert payload(b) == (rows[int(h["WARC-Page-ID"])][2] or "").encode()
        else:
            first, block = by_id[h["WARC-Refers-To"]]
            assert first["WARC-Type"] == "response" and first["WARC-Payload-Digest"] == h["WARC-Payload-Digest"] and first["WARC-Target-URI"] == h["WARC-Refers-To-Target-URI"] and payload(b) == b""


def test_repeated_and_null_ids(spark):
    rows = [(4, "u", LONG), (4, "u", LONG), (4, "v", LONG), (None, "u", LONG), (None, None, LONG), (9, None, None), (9, None, None)]
    got = read(spark, archive(spark, rows))
    assert [r[3] for r in got].count("response") == 3 and sum(r[4] == 4 for r in got) == 4
    alone = read(spark, archive(spark, [(None, "u", LONG), (None, "u", LONG)]))
    assert sorted(r[3] for r in alone) == ["response", "revisit"]


def test_hot_digest_by_both_joins(spark, monkeypatch):
    rows = [(i, "u", LONG if i % 3 == 0 else f"{LONG}{i % 100}") for i in range(900)]
    want = read(spark, archive(spark, rows))
    assert want == expected(rows)
    monkeypatch.setattr(warc, "BROADCAST_GROUPS", 0)
    monkeypatch.setattr(warc, "LEAST_HOT", 20)
    assert read(spark, archive(spark, rows)) == want


def test_archives_of_others_are_deduplicated(spark, tmp_path):
    """Copies of two archives, a revisit of one that both hold, bytes that aren't UTF-8, and a record cut off."""
    body = bytes(range(256)) * 2
    sha = hashlib.sha256(body).hexdigest()
    gone = "ab" * 32

    def record(kind, name, block, *more):
        lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x:{name}>", "WARC-Date: 2020-01-01T00:00:00Z", f"WARC-Target-URI: http://b.example/{name}", *more, f"Content-Length: {len(block)}"]
        return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    http = "Content-Type: application/http; msgtype=response"
    one = record("warcinfo", "i", b"software: none") + record("response", "a", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nServer: s\r\n\r\n200\r\n" + body + b"\r\n0\r\n\r\n", http)
    two = record("response", "b", b"HTTP/1.1 200 OK\r\nContent-Length: 512\r\n\r\n" + body, http) + record("revisit", "c", b"HTTP/1.1 200 OK\r\n\r\n", http, f"WARC-Payload-Digest: sha256:{sha}") + record("revisit", "d", b"", f"WARC-Payload-Digest: sha256:{gone}")
    (tmp_path / "one.warc.gz").write_bytes(gzip.compress(one[:90]) + gzip.compress(one[90:]))
    (tmp_path / "two.warc").write_bytes(two + record("response", "e", b"HTTP/1.1 200 OK\r\n\r\n" + body, http)[:-100])
    out = warc.deduplicate_archives(spark, [str(tmp_path / "one.warc.gz"), str(tmp_path / "two.warc")], str(tmp_path / "out"))
    back = warc.read_archive(spark, out).collect()
    assert sorted(r.type for r in back) == ["response", "revisit", "revisit", "revisit"]
    (kept,) = (r for r in back if r.type == "response")
    assert bytes(kept.payload) == body and kept.uri == "http://b.example/a" and "Server: s" in kept.head
    assert sorted((r.digest, r.n_bytes) for r in warc.resolved(warc.read_archive(spark, out)).collect() if r.type == "revisit") == sorted([(sha, 512), (sha, 512), (gone, None)])


def test_no_pages(spark):
    assert read(spark, archive(spark, [])) == []


def test_query_is_whole(spark):
    data = Path("/root/testdata/sf0.001")
    if not data.exists():
        pytest.skip("needs the driver's tables")
    found = queries.op12_warc(spark, str(data))
    assert found.count() == spark.read.parquet(str(data / "pages.parquet")).count() and found.dtypes[1] == ("payload_bytes", "bigint")

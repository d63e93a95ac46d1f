import base64
import gzip
import hashlib
import random
from pathlib import Path

from ragspark.llm import queries as Q
from ragspark.llm import warc as A

SF = "/root/testdata/sf0.001"


def expected(pages):
    last = {}
    for page_id, _, html in pages:
        if page_id is not None:
            key = (html or "").encode()
            last[key] = max(last.get(key, page_id), page_id)
    for page_id, _, html in pages:
        body = (html or "").encode()
        top = last.get(body)
        again = top is not None and page_id != top
        yield page_id, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", top if again else None


def order(rows):
    return sorted(map(tuple, rows), key=repr)


def test_query_equals_brute_force(spark):
    pages = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    assert order(Q.op1_warc(spark, SF).collect()) == order(expected(pages))


def test_edges(spark):
    long = "é\r\n\r\n0\r\n\r\nWARC/1.1\r\n" * 9000
    pages = [(1, "http://a/", "x"), (2, None, "x"), (2, "http://b/", "x"), (3, "u\nv", None), (4, "", ""), (5, "http://c/", long), (6, "http://c/", long), (None, "http://d/", "y"), (None, "http://d/", "x"), (8, "z", "\r\n\r\n")]
    df = spark.createDataFrame([(*p, i) for i, p in enumerate(pages)], "page_id long, url string, html string, sha int")
    for options in ({}, {"segment_bytes": 100, "records_per_file": 3}):
        rows = A.round_trip(df, **options)
        cols = rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
        assert order(cols) == order(expected(pages))
        assert {r.status for r in rows.collect()} == {"ok"}
    assert max(r.segments for r in rows.collect()) > 100
    assert A.round_trip(df.limit(0)).count() == 0
    kept = A.round_trip(df, least=2).where("record_type = 'revisit'").collect()
    assert [(r.page_id, r.refers_to) for r in kept] == [(5, 6)]


def test_archives_are_plain_warc(spark, tmp_path):
    df = spark.createDataFrame([(i, f"http://h/{i}", "text " * i * 50) for i in range(20)], "page_id long, url string, html string")
    A.write(df, str(tmp_path / "w"), segment_bytes=1000)
    seen = 0
    for f in Path(tmp_path / "w").glob("*.gz"):
        for head, block in A.parse(gzip.decompress(f.read_bytes())):
            assert len(block) == int(head["content-length"]) and head["warc-type"] in ("response", "continuation", "revisit")
            seen += head["warc-type"] != "continuation"
    assert seen == 20


def test_reassembly_in_any_order_and_broken_groups():
    payload = bytes(random.Random(1).randbytes(5000))
    block = A.HTTP + A.frame(payload, 700)
    parts = [(n + 1, None, block[i : i + 333]) for n, i in enumerate(range(0, len(block), 333))]
    parts[-1] = (parts[-1][0], len(block), parts[-1][2])
    random.Random(2).shuffle(parts)
    status, got = A.reassemble(parts)
    assert status == "ok" and A.body_of(got) == payload
    last = max(parts)
    assert A.reassemble([p for p in parts if p[0] != 3])[0] == "missing segment"
    assert A.reassemble([p for p in parts if p[0] != last[0]])[0] == "missing segment"
    assert A.reassemble([p if p[0] != last[0] else (p[0], p[1] + 1, p[2]) for p in parts])[0] == "wrong length"
    assert A.unframe(b"5;x=y\r\nhello\r\n0\r\nTrailer: 1\r\n\r\n") == b"hello"
    assert A.unframe(b"5\r\nhell") is None and A.unframe(b"") is None

import hashlib
import random
import re

import pytest

from ragspark.llm import blocks as B
from ragspark.llm import queries as Q

SF = "/root/testdata/sf0.001"


def brute(rows, window=20):
    """rows: (doc_id, text), each (doc_id, text) once."""
    rows = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        for p in range(len(w) - window + 1):
            first.setdefault(tuple(w[p : p + window]), (i, p))
    for i, w in rows:
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] != (i, p):
                gone |= set(range(p, p + window))
        kept = " ".join(x for n, x in enumerate(w) if n not in gone)
        yield i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()


def order(rows):
    return sorted(map(tuple, rows), key=repr)


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = Q.op6_fixed_blocks(spark, SF).collect()
    assert order(got) == order(brute(rows))
    assert sum(r.n_removed for r in got) > 0


@pytest.mark.parametrize(("seed", "limit"), [(1, 2000), (2, 2 << 20), (3, 500)])
def test_random_overlaps(spark, monkeypatch, seed, limit):
    monkeypatch.setattr(B.C.build, "__defaults__", (limit,))
    rng = random.Random(seed)
    pool = [" ".join(f"w{rng.randrange(60)}" for _ in range(90)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            w = rng.choice(pool).split()
            a = rng.randrange(60)
            parts += [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(12))] + w[a : a + rng.randrange(5, 60)]
        rows.append((i * 7 % 60, rng.choice([" ", "\n", " \t"]).join(parts)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = B.dedup(df).collect()
    assert order((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out) == order(brute(rows))
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 and sum(s.end - s.start for s in r.spans) == r.n_removed for r in out)


def test_edges(spark):
    passage = " ".join(f"p{i}" for i in range(21))
    rows = [(0, None), (1, ""), (2, " \n "), (3, "é" * 300_000), (4, passage), (5, passage), (6, "x " + passage + " é🙂"), (None, passage), (7, "a b " * 3000), (8, passage.replace(" ", " ")), (9, " ".join(f"q{i}" for i in range(20)))]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, kept string, key int")
    assert order(B.dedup(df).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()) == order(brute(rows))
    twice = df.where("doc_id IN (4, 9)").unionAll(df.where("doc_id IN (4, 9)"))
    assert {r.n_removed for r in B.dedup(twice).collect()} == {0}
    assert B.dedup(df.limit(0)).count() == 0


def test_a_frequent_block_is_sent_once_a_chunk():
    """A gram that all texts of a chunk hold costs one entry, however many texts there are."""
    import numpy as np

    def payload(n):
        texts = [f"own{i} " + " ".join(f"w{j}" for j in range(10)) + " " for i in range(n)]
        data, off = "".join(texts).encode(), np.cumsum([0, *map(len, texts)]).astype("<i8")
        row = B.pa.RecordBatch.from_arrays([B.pa.array([7], B.pa.int64()), B.pa.array([off.tobytes()]), B.pa.array([B.C.zstandard.compress(data)])], names=["chunk", "off", "body"])
        (sent,) = B._send_probes(10, 16)([row])
        return sum(int(np.frombuffer(p, "<u4", 1)[0]) for p in sent.column(2).to_pylist())

    # The text's own first block, and the shared window that follows.
    assert payload(100) == 101 and payload(400) == 401

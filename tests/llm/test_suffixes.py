import hashlib
import random

import numpy as np
import pytest

from ragspark.llm import queries as Q
from ragspark.llm import suffixes as S

SF = "/root/testdata/sf0.001"


def brute(rows, length=400):
    rows = [(i, (t or "").encode()) for i, t in rows]
    seen = {}
    for _, b in rows:
        for p in range(len(b) - length + 1):
            k = hash(b[p : p + length])
            seen[k] = seen.get(k, 0) + 1
    for i, b in rows:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if seen[hash(b[p : p + length])] > 1:
                gone[p : p + length] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        yield i, len(b), int(gone.sum()), len(S.K.runs(gone)[0]), hashlib.sha256(kept).hexdigest()


def order(rows):
    return sorted(map(tuple, rows), key=repr)


def digest(df):
    return order(df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = Q.op4_suffix_array(spark, SF).collect()
    assert order(got) == order(brute(rows))
    assert sum(r.n_removed for r in got) > 0


@pytest.mark.parametrize(("seed", "limit", "hot"), [(1, 6000, S.HOT), (2, 2 << 20, S.HOT), (3, 1, S.HOT), (4, 6000, 0), (5, 6000, 6), (6, 1, 8)])
def test_random_overlaps(spark, monkeypatch, seed, limit, hot):
    monkeypatch.setattr(S.C.build, "__defaults__", (limit,))
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefé") for _ in range(rng.randrange(1, 9)))
    pool = [" ".join(word() for _ in range(250)) for _ in range(5)]
    rows = []
    for i in range(50):
        text = ""
        for _ in range(rng.randrange(1, 4)):
            p = rng.choice(pool)
            a = rng.randrange(len(p) - 300)
            text += " ".join(word() for _ in range(rng.randrange(30))) + p[a : a + rng.choice([398, 399, 400, 401, 402, 450, 700])]
        rows.append((i, text))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert digest(S.dedup(df, hot=hot)) == order(brute(rows))


def test_edges(spark):
    unique = " ".join(f"u{i}" for i in range(3000))
    rows = [(0, None), (1, ""), (2, "a" * 399), (3, "b" * 400), (4, "c" * 401), (5, "Is onhe. " * 2000), (6, "x" * 600 + "Is onhe. " * 60 + "y"), (7, unique), (8, "é🙂" * 80), (None, "z" + unique[:500]), (9, "Is onhe. " * 45), (10, "a" * 9000 + unique[100:480] + "a" * 420), (11, "\n" * 30_000)]
    rows += [(12, "q" * 30 + unique[5000:5800]), (12, "q" * 30 + unique[5000:5800]), (13, unique[200:599]), (14, unique[7000:7400])]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, kept string, key int")
    assert digest(S.dedup(df)) == digest(S.dedup(df, hot=1)) == order(brute(rows))
    out = {r.doc_id: r for r in S.dedup(df.where("doc_id IN (7, 14)")).collect()}
    assert [tuple(s) for s in out[7].spans] == [(7000, 7400)] and out[14].kept == b""
    assert S.dedup(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_deep_shallow_sorts(seed):
    rng = random.Random(seed)
    head = bytes(rng.randrange(97, 100) for _ in range(48))
    tails = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(30, 60))) for _ in range(4)]
    rows = [head + rng.choice(tails)[: rng.randrange(60)] + bytes(rng.choice(b"ab") for _ in range(rng.randrange(60))) for _ in range(200)]
    group = np.array([rng.randrange(3) for _ in rows])
    size = np.array([min(len(r), 150) for r in rows])
    text = np.zeros((len(rows), 150), np.uint8)
    for i, r in enumerate(rows):
        text[i, : size[i]] = np.frombuffer(r[:150], np.uint8)
    got, common = S.deep_shallow(group, text, size)
    keys = [(group[i], rows[i][:150]) for i in got]
    assert keys == sorted(keys)
    for n in range(1, len(got)):
        if keys[n][0] == keys[n - 1][0]:
            assert common[n] == S.prefix(keys[n][1], keys[n - 1][1])
        else:
            assert common[n] == 0


def test_cost_of_empty_buckets():
    """A chunk's work follows what it has, not the number of buckets (2^22: 18 TB of text)."""
    import time

    hashes = np.random.default_rng(1).integers(0, 2**64, 5800, np.uint64)

    def seconds(buckets):
        start = time.perf_counter()
        for _ in range(20):
            S._asked(hashes, buckets, False)
            S.C.bucket_order(hashes, buckets)
        return time.perf_counter() - start

    seconds(1 << 12)
    assert seconds(1 << 22) < 4 * seconds(1 << 12) + 0.1
    assert S.C.chunk_bytes(1 << 30) == 1 << 20 and S.C.chunk_bytes(1 << 40) == 4 << 20 and S.C.chunk_bytes(1 << 50) == 16 << 20


def test_a_hot_gram_is_no_task_of_its_own():
    """However many chunks hold a gram, above HOT places none sends its surroundings."""
    text = ("some words that many texts hold in the middle of others, and nobody knows why they all begin " * 6).encode()
    off = np.array([0, len(text)], "<i8")
    place, hashed = S.minima(np.frombuffer(text, np.uint8), off)
    asked = dict(S._asked(hashed, 16, False))
    answers = {b: S._twice(3, 4)(b, [p] * 10)[0] for b, p in asked.items()}
    a = S.Anchors(off.tobytes(), S.zstandard.compress(text), place.astype("<u4").tobytes(), hashed.tobytes(), 16)
    assert a.repeated(answers, 16) == [] and list(a.sent) == []
    starts, strings = a.strings(answers)
    assert len(starts) == len(text) - 399 and len(np.unique(strings)) < len(starts)

import random
import re

import numpy as np
import pytest

from ragspark.llm import jaccard as J
from ragspark.llm import queries as Q

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    comp = list(range(len(sets)))

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                comp[root(x)] = root(y)
    low = {}
    for x, (i, s) in enumerate(sets):
        r = root(x)
        low[r] = min((v for v in (low.get(r), i) if v is not None), default=None)
    for x, (i, s) in enumerate(sets):
        yield i, len(s), low[root(x)]


def order(rows):
    return sorted(map(tuple, rows), key=repr)


def digest(df):
    return order(df.select("doc_id", "n_shingles", "component_id").collect())


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert digest(Q.op8_jaccard_join(spark, SF)) == order(brute(rows))


@pytest.mark.parametrize(("seed", "rare", "limit"), [(1, 64, 2 << 20), (2, 2, 3000), (3, 1, 2 << 20)])
def test_random_copies(spark, monkeypatch, seed, rare, limit):
    monkeypatch.setattr(J.C.build, "__defaults__", (limit,))
    monkeypatch.setattr(J.signatures, "__defaults__", (75, rare))
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    passage = [word() for _ in range(40)]
    rows = []
    for i in range(25):
        base = [word() for _ in range(rng.choice([3, 5, 8, 20, 60, 200]))] + passage * rng.randrange(2)
        for _ in range(rng.choice([1, 1, 2, 12])):
            copy = [word() if rng.random() < rng.choice([0, 0.01, 0.03, 0.06]) else w for w in base]
            cut = rng.randrange(1 + len(copy) // 5)
            rows.append((len(rows) * 17 % 1009, " ".join(copy[cut:])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = order(brute(rows))
    assert len({r[2] for r in want}) < len(want) - 10
    assert digest(J.join(df)) == want


def test_edges(spark):
    a = " ".join(f"w{i}" for i in range(100))
    rows = [(0, None), (1, ""), (2, " \t"), (3, "One two"), (4, "one  TWO"), (5, "a b c d e"), (9, a), (8, a.upper()), (7, a + " x y z"), (7, a + " x y z"), (None, a), (None, "solo null"), (10, "é É"), (11, "É É"), (12, "ha " * 200_000), (13, "ha " * 50), (14, "two one")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, cls int, chunk string")
    assert digest(J.join(df)) == order(brute(rows))
    assert J.join(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_signatures_lose_no_pair(seed):
    """Any two sets at the threshold share a signature, whatever the frequencies."""
    rng = np.random.default_rng(seed)
    universe = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    scale = rng.choice([8, 16, 60, 90, 120], 4000).astype(np.uint8)
    for _ in range(150):
        n = int(rng.integers(1, 300))
        both = rng.permutation(4000)[: n + 200]
        m = int(rng.integers(0, n // 7 + 1))
        x, y = both[:n], np.concatenate((both[m:n], both[n : n + int(rng.integers(0, n // 7 + 1))]))
        inter = len(set(x) & set(y))
        if len(y) and 100 * inter >= 75 * (len(x) + len(y) - inter):
            (sx, kx), (sy, ky) = J.signatures(universe[x], scale[x]), J.signatures(universe[y], scale[y])
            need = -(-75 * (len(x) + len(y)) // 175)
            lists = [{int(s) for s, k in zip(a, c, strict=True) if k <= n - need + 1} for a, c, n in ((sx, kx, len(x)), (sy, ky, len(y)))]
            assert lists[0] & lists[1]


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 180)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(50)] + [(500, i) for i in range(501, 540)]
    comp = {}

    def root(x):
        while comp.setdefault(x, x) != x:
            x = comp[x]
        return x

    for a, b in edges:
        if a != b:
            lo, hi = sorted((root(a), root(b)))
            comp[hi] = lo
    got = {r.cls: r.comp for r in J.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in list(comp)}


def test_many_near_copies_are_not_compared_in_pairs(spark, monkeypatch):
    """Two thousand near copies of a few texts that share a long passage: the same components with few comparisons."""
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(30)]
    bases = [[f"b{k}w{i}" for i in range(35)] for k in range(4)]
    rows = []
    for i in range(2000):
        words = list(bases[i % 4]) + passage
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            words[rng.randrange(len(words))] = f"x{i}_{rng.randrange(9)}"
        rows.append((i, " ".join(words)))
    compared = []
    links = J.links
    monkeypatch.setattr(J, "links", lambda pairs, *a: compared.append(pairs.count()) or links(pairs, *a))
    got = digest(J.join(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == order(brute(rows))
    assert len({c for _, _, c in got}) >= 4
    assert 0 < sum(compared) < 20 * len(rows)


def test_equal_tokens_of_a_chunk_are_sent_once():
    """A shingle that every text holds costs a chunk four bytes and a count, however many texts there are."""
    texts = [f"a b c d e own{i}" for i in range(500)]
    data = "".join(texts).encode()
    off = np.cumsum([0, *map(len, texts)]).astype("<i8")
    row = J.pa.RecordBatch.from_arrays([J.pa.array([7], J.pa.int64()), J.pa.array([off.tobytes()]), J.pa.array([J.zstandard.compress(data)])], names=["chunk", "off", "body"])
    (sent,) = J._send_tokens(16)([row])
    payloads = sent.column(2).to_pylist()
    assert sum(int(np.frombuffer(p, "<u4", 1)[0]) for p in payloads) == 501
    both = J._frequency(0, [payloads[0], payloads[0]])
    assert both[0] is not None and both[0] == both[1]

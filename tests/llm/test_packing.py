import zlib
from collections import Counter

import numpy as np
import pytest

from ragspark.llm import packing as P
from ragspark.llm import queries as Q

SF = "/root/testdata/sf0.001"


def check(rows, texts, capacity=1024):
    """rows: (doc_id, piece, start, length, crc, sequence, offset); texts by doc_id. Returns the number of sequences."""
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(Q.tokenizer_path())
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r[0], []).append(r)
        by_bin.setdefault(r[5], []).append((r[6], r[3]))
    assert set(by_doc) == set(texts)
    for doc, text in texts.items():
        ids = [*encode.encode(text or "", add_special_tokens=False).ids, 2]
        own = sorted(by_doc[doc], key=lambda r: r[1])
        assert [r[1] for r in own] == list(range(len(own)))
        at = 0
        for i, r in enumerate(own):
            assert r[2] == at and (r[3] == capacity or i == 0)
            assert r[4] == zlib.crc32(np.array(ids[at : at + r[3]], "<u4").tobytes())
            at += r[3]
        assert at == len(ids)
    for places in by_bin.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_bin)


def test_query_round_trip_and_fill(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = [tuple(r) for r in Q.op5_best_fit_packing(spark, SF).collect()]
    bins = check(rows, docs)
    total = sum(r[3] for r in rows)
    assert bins <= -(-total // 1024) + 2


def test_edges(spark):
    texts = {0: None, 1: "", 2: "a", 3: "word " * 5000, 4: "x" * 3000, 5: "<|endoftext|> é\u0000 🙂", 6: "a"}
    df = spark.createDataFrame([(k, v, 1) for k, v in texts.items()], "doc_id long, text string, piece int")
    check([tuple(r) for r in P.pack(df, Q.tokenizer_path()).collect()], texts)
    assert P.pack(df.limit(0), Q.tokenizer_path()).count() == 0


def test_ids_equal_the_library(spark):
    from tokenizers import Tokenizer

    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts += ["a\r\n\r\nb  c\t\td", "日本語テキスト 한국어 ﷺ", "I'll they're it's 'S", "𝔘𝔫𝔦 ‍ é", "١٢٣ ½ ²", " " * 50, "퟿", "<|endoftext|>x<|endoftext|>"]
    whole = Tokenizer.from_file(Q.tokenizer_path())
    assert P.encoder(Q.tokenizer_path())(texts) == [x.ids for x in whole.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("seed", range(5))
def test_plan_uses_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    counts = {int(k): int(n) for k, n in zip(rng.integers(1, 65, 30), rng.integers(1, 2000, 30), strict=True)}
    bins = P.plan(counts, 64)
    used = Counter()
    for lengths, times in bins:
        assert sum(lengths) <= 64
        for n in lengths:
            used[n] += times
    assert used == Counter(counts)


def test_search_empties_a_bin():
    # best fit alone leaves {6}, {5,3}, {4,4}... the exchanges free a bin
    before = Counter({(6, 2): 1, (5, 3): 1, (4,): 1, (4, 2): 1, (2, 2): 1})
    after = P.search(before, 10, 1000)
    assert sum(after.values()) < sum(before.values())
    assert Counter(x for p, n in after.items() for _ in range(n) for x in p) == Counter(x for p, n in before.items() for _ in range(n) for x in p)
    squares = lambda c: sum(n * sum(p) ** 2 for p, n in c.items())
    assert squares(after) > squares(before)


def test_two_for_one():
    step = P.exchange((3, 3, 1), (5, 4), 10)
    assert step is not None and sum(step[2]) == 10


def test_long_runs_of_spaces_have_the_library_ids(spark):
    """Texts that tiktoken rejects: the ids are those of tokenizers, and packing them does not fail."""
    texts = {1: " " * 1_200_000 + "x", 2: "\n" * 1_000_000 + "y", 3: "z" * 1_000_000, 4: "end"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check([tuple(r) for r in P.pack(df, Q.tokenizer_path(), rounds=5, givers=8).collect()], texts)


@pytest.mark.parametrize("seed", range(4))
def test_best_fit_decreasing(seed):
    """The same bins as piece by piece."""
    rng = np.random.default_rng(seed)
    counts = {int(k): int(n) for k, n in zip(rng.integers(1, 65, 25), rng.integers(1, 40, 25), strict=True)}
    bins = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [b for b in bins if sum(b) + length <= 64]
            if fits:
                max(fits, key=sum).append(length)
            else:
                bins.append([length])
    got = P.best_fit(counts, 64)
    assert sum(got.values()) == len(bins)
    assert sorted(sum(p) for p, n in got.items() for _ in range(n)) == sorted(map(sum, bins))


def test_search_ends_without_an_exchange_that_helps():
    """Nothing bounds the search but that no pair of open bins has an exchange left."""
    rng = np.random.default_rng(3)
    counts = {int(k): int(n) for k, n in zip(*np.unique(rng.integers(17, 29, 400), return_counts=True), strict=True)}
    bins = dict(P.plan(counts, 64))
    open_ = [p for p in bins if sum(p) < 64]
    if sum(bins.values()) > -(-sum(k * n for k, n in counts.items()) // 64):
        assert not any(P.exchange(g, t, 64) for g in open_ for t in open_ if sum(g) <= sum(t) and (g != t or bins[g] > 1))

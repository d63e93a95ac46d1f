"""The index in the order of impact finds what scoring everything finds."""

import random

import pytest
from pyspark.sql import functions as F

from ragspark.operators import impact, lexical


def rows(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "doc_id", "score").collect())


def both(spark, tmp_path, docs, queries, k, **options):
    docs = spark.createDataFrame(docs, "doc_id long, text string, key string, term string")
    queries = spark.createDataFrame(queries, "query_id long, text string")
    index = impact.build(docs, f"{tmp_path}/{random.randrange(10**9)}", **options)
    return index, queries, rows(impact.search(index, queries, k)), rows(lexical.top(lexical.bm25(docs, queries), k, "query_id"))


def corpus(seed, n, words=400):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    odds = [1 / (i + 1) for i in range(words)]
    out = [(i, " ".join(draw.choices(vocabulary, odds, k=draw.choice([1, 5, 40, 200]))), "x", "y") for i in range(n)]
    return out + [(n + i, out[draw.randrange(20)][1], "x", "y") for i in range(n // 2)]  # copies: ties


@pytest.mark.parametrize("k", [1, 7, 500])
def test_same_as_scoring_everything(spark, tmp_path, k):
    draw = random.Random(k)
    queries = [(i, " ".join(f"w{draw.choice([0, 1, 2, draw.randrange(400)])}" for _ in range(draw.randrange(1, 9)))) for i in range(12)]
    _, _, got, want = both(spark, tmp_path, corpus(3, 300), [*queries, (90, None), (91, ""), (92, "unknown words"), (93, "W0 w0 w399")], k)
    assert got == want and len({r[0] for r in got}) >= 12


def test_empty_tables_null_texts_and_one_word_everywhere(spark, tmp_path):
    assert both(spark, tmp_path, [], [(1, "a")], 3)[2] == []
    _, _, got, want = both(spark, tmp_path, [(1, None, None, None), (2, "", "", ""), (3, "a a a", "k", "t"), (4, "a", "k", "t")], [(1, "a")], 3)
    assert got == want and [r[2] for r in got] == [3, 4]
    _, _, got, want = both(spark, tmp_path, [(i, "same", "k", "t") for i in range(1000)], [(1, "same"), (2, "same other")], 4)
    assert got == want and [r[2] for r in got] == [0, 1, 2, 3] * 2
    assert both(spark, tmp_path, [(1, "a", "k", "t")], [], 3)[2] == []


def test_long_text_and_rows_that_repeat(spark, tmp_path):
    docs = [(1, "deep " * 200_000 + "rare", "k", "t"), (2, "deep rare", "k", "t"), (2, "deep rare", "k", "t"), (3, "deep", "k", "t")]
    _, _, got, want = both(spark, tmp_path, docs, [(1, "rare deep"), (1, "rare deep")], 2)
    assert got == want


def test_blocks_are_skipped_and_bounded(spark, tmp_path):
    docs = [(i, "common " * (1 + i % 9) + ("rare" if i < 20 else f"filler{i % 5}"), "k", "t") for i in range(6000)]
    index, queries, got, want = both(spark, tmp_path, docs, [(1, "common rare")], 5)
    assert got == want
    assert index.blocks.agg(F.max(F.size("postings"))).first()[0] <= impact.BLOCK
    read = impact.blocks_read(index, impact.allowances(index, queries, 5)).first()
    assert read.blocks > 45 and read.read <= 3  # of the common word's blocks none is read for candidates


def test_an_index_is_opened_again(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i % 7} all", "k", "t") for i in range(50)], "doc_id long, text string, key string, term string")
    made = impact.build(docs, f"{tmp_path}/kept", shards=3)
    again = impact.opened(spark, f"{tmp_path}/kept")
    queries = spark.createDataFrame([(1, "word3"), (2, "all")], "query_id long, text string")
    assert made.terms.agg(F.max('shard')).first()[0] < 3 and rows(impact.search(again, queries, 4)) == rows(impact.search(made, queries, 4)) == rows(lexical.top(lexical.bm25(docs, queries), 4, "query_id"))

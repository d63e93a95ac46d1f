import hashlib
import re

import numpy as np
import pandas as pd

from ragspark.llm import decontaminate as D
from ragspark.llm import queries as Q

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    wins = []
    for item, text in items:
        w = words(text)
        wins += [(str(item), tuple(w[i : i + 13])) for i in range(len(w) - 12)] if len(w) >= 13 else [(str(item), tuple(w))] if w else []
    by = {}
    for item, w in wins:
        by.setdefault(w, set()).add(item)
    sizes = {len(w) for w in by}
    for text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if got := by.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= got
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        yield len(w), len(hit), len(found), sha, len(hit) > 0 and 20 * len(hit) >= len(w)


def result(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return D.matches(d, b, **options).orderBy("doc_id").collect()


def test_query_equals_brute_force(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id")
    items = pd.read_parquet(f"{SF}/benchmark.parquet")
    want = list(brute(docs.text, items[["item_id", "text"]].values.tolist()))
    got = [tuple(r)[1:] for r in Q.op9_decontaminate(spark, SF).orderBy("doc_id").collect()]
    assert got == want
    assert any(r[4] for r in got)


def test_edges_and_blocks(spark):
    long = " ".join(f"w{i % 97}" for i in range(40_000))
    item = " ".join(f"w{i}" for i in range(30, 60))
    docs = [None, "", "...", "Solo", "x solo y solo", long, item.upper(), f"été {item}, {item} été", "é", "İ i"]
    items = [(1, item), (2, None), (3, "solo"), (4, "SOLO!"), (5, ""), (6, "é"), (6, "é"), (7, "w1 w2"), (8, " ".join(f"w{i}" for i in range(40, 53)))]
    want = list(brute(docs, items))
    for options in ({}, {"block_bytes": 150}, {"block_bytes": 10}):
        got = [(r.n_words, r.n_hit, len({m["item"] for m in r.matches})) for r in result(spark, docs, items, **options)]
        assert got == [w[:3] for w in want]


def test_longest_matches(spark):
    item = [f"w{i}" for i in range(50)]
    [row] = result(spark, ["a b " + " ".join(item[10:40]) + " c"], [(1, " ".join(item))])
    assert [tuple(m) for m in row.matches] == [("1", 2, 10, 30)]


def test_extra_columns_and_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b", 5, 6, "z")], "doc_id long, text string, n_words int, matches int, `odd name` string")
    b = spark.createDataFrame([], "item_id long, text string")
    out = D.matches(d, b).collect()
    assert out[0]["n_words"] == 2 and out[0]["odd name"] == "z" and not out[0]["matches"]
    kept = D.remove_contaminated(d.withColumn("hits", d.doc_id), b)
    assert kept.columns == [*d.columns, "hits"] and tuple(kept.collect()[0]) == (1, "a b", 5, 6, "z", 1)
    assert D.matches(d.limit(0), b).count() == 0


def test_one_block_is_held_at_a_time(spark, monkeypatch):
    """Three blocks of items and more: each is dropped before the next is read, and none holds all items."""
    items = [(i, " ".join(f"i{i}w{j}" for j in range(20))) for i in range(60)]
    docs = [" ".join(f"i{i}w{j}" for i in (d, d + 1, 59 - d) for j in range(3, 20)) for d in range(20)]
    sizes, whole = [], D.blocks

    def watched(*args):
        for last, ids, texts in whole(*args):
            sizes.append(len(ids))
            yield last, ids, texts

    monkeypatch.setattr(D, "blocks", watched)
    got = [(r.n_words, r.n_hit, len({m["item"] for m in r.matches})) for r in result(spark, docs, items, block_bytes=3000)]
    assert got == [w[:3] for w in brute(docs, items)]
    assert len(sizes) >= 3 and sum(sizes) == 60 and max(sizes) < 45


def test_suffix_array_holds_every_place_in_order():
    words = "b a c a b a c a b".split()
    rank = {w: i for i, w in enumerate("abc")}
    first = np.array([0, 5, 5, 9])
    shard = D.Shard(np.array([rank[w] for w in words], np.uint64), first, 4)
    stop = [5] * 5 + [9] * 4
    assert sorted(shard.order.tolist()) == list(range(9))
    suffix = [words[p : min(stop[p], p + 4)] for p in shard.order]
    assert suffix == sorted(suffix)

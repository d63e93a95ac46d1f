import math
import zlib
from collections import Counter

import numpy as np

from ragspark.llm import language as L
from ragspark.llm import queries as Q

SF = "/root/testdata/sf0.001"


def brute(rows):
    """rows: (doc_id, text, lang). Predictions by a plain naive Bayes over dictionaries of hashed n-grams."""
    seen, docs = {}, Counter()
    for i, text, lang in rows:
        if lang is not None and i is not None and zlib.crc32(str(i).encode()) % 5:
            docs[lang] += 1
            seen.setdefault(lang, Counter()).update(codes(text or ""))
    size = 1 << L.BITS
    for i, text, _ in rows:
        held = i is None or zlib.crc32(str(i).encode()) % 5 == 0
        if not docs or not any(map(str.isalpha, text or "")):
            yield held, "und", 0.0
            continue
        own, total = codes(text), {}
        for lang, c in sorted(seen.items()):
            below = sum(c.values()) + L.ALPHA * size
            total[lang] = math.log(docs[lang] / sum(docs.values())) + sum(n * math.log((c[g] + L.ALPHA) / below) for g, n in own.items())
        best = max(total, key=total.get)
        yield held, best, 1 / sum(math.exp(v - total[best]) for v in total.values())


def codes(text):
    low, out, mask = text.lower(), Counter(), (1 << 64) - 1
    for n in range(1, 4):
        for i in range(len(low) - n + 1):
            h = (ord(low[i]) + 1) * int(L.K._M1) & mask
            for c in low[i + 1 : i + n]:
                h = (h * 0x100000001B3 + ord(c)) * int(L.K._M1) & mask
            out[((h ^ h >> 29) * int(L.K._M2) & mask) >> (64 - L.BITS)] += 1
    return out


def same(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:2] == w[:2] and math.isclose(g[2], w[2], abs_tol=1e-6)


def test_query_equals_brute_force_and_is_accurate(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    got = Q.op7_language_id(spark, SF).orderBy("doc_id").collect()
    same([tuple(r)[1:] for r in got], list(brute([(r.doc_id, r.text, r.lang) for r in docs])))
    held = [(g.lang_pred, d.lang) for g, d in zip(got, docs, strict=True) if g.held_out]
    assert np.mean([a == b for a, b in held]) > 0.97


def test_edges(spark):
    rows = [(i, t, l) for i, (t, l) in enumerate([("the cat the dog", "en"), ("der hund die katze", "de"), ("le chat ou", "fr"), (None, "en"), ("", None), ("123 !!", "de"), ("İstanbul ß 🙂" * 30_000, None), ("the the", None), ("die der", "de")] * 3)]
    rows += [(None, "the", "en"), (3, "katze", "de"), (3, "katze", "de")]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    out = L.predict(df, L.train(df)).withColumn("held", L.held_out())
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score", "held"]
    got = sorted((r.doc_id is None, r.doc_id, r.text or "", r.held, r.lang_pred, r.score) for r in out.collect())
    want = sorted((r[0] is None, r[0], r[1] or "", *w) for r, w in zip(rows, brute(rows), strict=True))
    same([g[3:] for g in got], [w[3:] for w in want])
    none = df.where("lang IS NULL")
    assert {r.lang_pred for r in L.predict(none, L.train(none)).collect()} == {"und"}
    assert L.predict(df.limit(0), L.train(df)).count() == 0
    kept = L.keep_identified(df, L.train(df))
    assert kept.columns == df.columns and kept.where("text IS NULL OR text = '' OR score <> 0.5").count() == 0

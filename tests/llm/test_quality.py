import re

import pytest

from ragspark.llm import quality as R
from ragspark.llm import queries as Q

SF = "/root/testdata/sf0.001"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def fails(line):
    w = words(line)
    marks = len(re.findall(r"[|>»·•]", line))
    if marks >= 3 and marks >= 0.2 * len(w):
        return True
    if any(p in line.lower() for p in R.BOILERPLATE):
        return True
    return len(w) >= 4 and not re.search(r"[.!?:;,…|>。！？]", w[-1])


def brute(text):
    w, t = words(text), text or ""
    grams, seen, lines, dup = {}, set(), set(), 0
    for i in range(len(w) - 2):
        grams.setdefault(tuple(w[i : i + 3]), []).append(i)
    for at in grams.values():
        if len(at) > 1:
            seen |= {i + k for i in at for k in range(3)}
    kept = 0
    for line in t.split("\n"):
        if words(line):
            dup += line in lines
            lines.add(line)
            kept += 0 if fails(line) else sum(map(len, words(line)))
    chars = sum(map(len, w))
    failed = len(w) < 50 or 100 * len(seen) > 50 * len(w)
    return len(w), chars, sum(t.count(c) for c in "#*$%&|<>"), dup, len(seen), failed, not failed and (1 - kept / chars if chars else 0) <= 0.5


def test_query_equals_brute_force(spark):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r[0]: tuple(r)[1:] for r in Q.op3_line_quality(spark, SF).collect()}
    assert got == {i: brute(t) for i, t in text.items()}
    assert 0 < sum(g[-1] for g in got.values()) < len(got)


def test_edges(spark):
    prose = "Alpha%d beta%d gamma%d delta%d epsilon%d zeta%d eta%d theta%d iota."
    line = lambda i: prose.replace("%d", str(i))
    texts = [None, "", "\n\n \t", "a", "a b", "a b c", "a a a a", "x y z x y z", "é 🙂 # $ | <>\x0b\x85 b"]
    texts += ["\n".join(line(i) for i in range(12)), "\n".join([line(i) for i in range(4)] + ["Home | About | News | Contact me"] * 20), "\n".join([line(i) for i in range(6)] + ["read more about it here today"] * 2)]
    texts += ["one two three four " * 60, "\n".join(f"Word{i} alone{i} is{i} here{i}" for i in range(30)), " ".join(f"w{i % 5000}" for i in range(60_000)), "\n".join(["same line here."] * 3 + ["same line here. "])]
    df = spark.createDataFrame([(i, t, "a", 1) for i, t in enumerate(texts)] + [(1, "", "a", 1)], "doc_id long, text string, kept string, `l_` int")
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    out = R.statistics(df)
    got = out.select("doc_id", *cols).collect()
    assert sorted(map(tuple, got)) == sorted((i, *brute(t)) for i, t in [*enumerate(texts), (1, "")])
    assert R.statistics(df.limit(0)).count() == 0
    by = {r.doc_id: r for r in out.collect()}
    assert by[9].kept and not by[10].kept and "Home" not in by[10].cleaned


@pytest.mark.parametrize("line", ["a b c " + "." * 1_000_000 + " x", '"k":1,' * 170_000, "a b c data:" + "iVBORw0KGgo/+" * 80_000, "q" * 1_000_000, "a b c " + "。)" * 300_000 + "x", "a b c " + ")" * 1_000_000])
def test_one_long_line(spark, line):
    import time

    df = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    R.statistics(df).collect()
    df = spark.createDataFrame([(1, line)], "doc_id long, text string")
    start = time.monotonic()
    got = R.statistics(df).select("n_words", "base_failed").collect()
    assert time.monotonic() - start < 5 and got == [(len(line.split()), True)]


def test_last_words(spark):
    lines = ["a b c end", "a b c end.", 'a b c end.")  ', "a b c x.y", "a b c e|", "a b c 。)", "a b c 。x", "a. b. c. end", "a b end", "a b c \u00a0. \t", "a b c )."]
    out = spark.createDataFrame([(x,) for x in lines], "line string").select(R.line_fails(R.F.col("line"))).collect()
    assert [r[0] for r in out] == [True, False, False, False, False, False, True, True, False, False, False]

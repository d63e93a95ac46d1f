import re
from itertools import permutations

from pyspark.sql import functions as F

from ragspark.llm import interaction as I
from ragspark.llm import queries as Q

SF = "/root/testdata/sf0.001"


def flags(rows):
    low = {}
    for r in rows:
        if r["doc_id"] is not None:
            t = r["text"] or ""
            low[t] = min(low.get(t, r["doc_id"]), r["doc_id"])
    for r in rows:
        t = r["text"] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        again = r["doc_id"] is not None and r["doc_id"] > low[t]
        yield (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), again)


def brute(rows, labels):
    good = {r["doc_id"] for r in labels if r["quality"] == 1 and r["doc_id"] is not None}
    toxic = {r["doc_id"] for r in labels if r["toxic"] == 1 and r["doc_id"] is not None}
    parts = {}
    for r, f in zip(rows, flags(rows), strict=True):
        parts.setdefault(r["lang"] or "", []).append((r["doc_id"], f))
    out = []
    for part, held in parts.items():
        own = []
        for order in permutations(range(5)):
            left = held
            for step, f in enumerate(order, 1):
                gone = [x for x in left if x[1][f]]
                left = [x for x in left if not x[1][f]]
                fails = sum(x[1][f] for x in held)
                alone = sum(x[1][f] and sum(x[1]) == 1 for x in held)
                own.append((f, ["".join("ABCDE"[i] for i in order), step, len(left), len(gone), fails - len(gone), alone, sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone)]))
        total = [sum(r[3] for f, r in own if f == i) for i in range(5)]
        out += [(part, *r, total[f]) for f, r in own]
    return sorted(out)


def digest(df):
    return sorted(map(tuple, df.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect()))


def test_query_equals_brute_force(spark):
    read = lambda t: [r.asDict() for r in spark.read.parquet(f"{SF}/{t}.parquet").collect()]
    assert digest(Q.op12_filter_interaction(spark, SF)) == brute(read("documents"), read("labels"))


def test_odd_rows(spark, tmp_path):
    many = " ".join(f"w{i}" for i in range(250))
    texts = [None, "", " \t\n", many, many, many.upper(), "same " * 300, "x#", "É" * 50, "A", many + " $", "\x1cz\x85y" * 400, "w " * 200_000, "one" * 300_000]
    langs = [None, "", "de", "en"]
    rows = [dict(doc_id=i if i % 6 else None, text=t, lang=langs[i % 3]) for i, t in enumerate(texts * 3)]
    rows += [dict(doc_id=7, text=many, lang="xx"), dict(doc_id=7, text=many, lang="xx")]
    labels = [dict(doc_id=i, quality=q, toxic=t) for i, q, t in [(1, 1, 0), (1, 0, 1), (3, None, 1), (4, 1, None), (None, 1, 1), (7, 1, 1), (7, 1, 1), (99, 1, 1)]]
    docs = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"]) for r in rows], "doc_id long, text string, lang string")
    docs.withColumns({c: F.lit("clash") for c in ("A", "part", "content", "good", "n", "mask")}).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([tuple(r.values()) for r in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = digest(Q.op12_filter_interaction(spark, str(tmp_path)))
    assert got == brute(rows, labels) and len(got) == 600 * 3


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert I.audit(I.labelled(I.failures(docs), labels)).collect() == []


def test_other_filters(spark):
    rows = [("p", True, False, 1), ("p", True, True, 0), ("q", False, True, 1), ("q", False, False, 0)]
    df = spark.createDataFrame([(p, a, b, bool(g), False) for p, a, b, g in rows], "part string, X boolean, Y boolean, good boolean, toxic boolean")
    got = {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["shapley"]) for r in I.audit(df, "XY").collect()}
    assert got == {("p", "XY", 1): (0, 2, 0, 1, 1, 3), ("p", "XY", 2): (0, 0, 1, 0, 0, 1), ("p", "YX", 1): (1, 1, 0, 0, 0, 1), ("p", "YX", 2): (0, 1, 1, 1, 1, 3), ("q", "XY", 1): (2, 0, 0, 0, 0, 0), ("q", "XY", 2): (1, 1, 0, 1, 1, 2), ("q", "YX", 1): (1, 1, 0, 1, 1, 2), ("q", "YX", 2): (1, 0, 0, 0, 0, 0)}

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from ragspark.llm import merkle as M
from ragspark.llm import queries as Q

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def H(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf(r, more=0):
    given = [r["doc_id"], r["source"], r["lang"], None if r["n_chars"] is None else r["n_chars"] + more, r["text"]]
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in given])


def tree(nodes, fanout):
    """The top and, for each leaf, its (position, siblings) level by level."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        runs = [level[i : i + fanout] for i in range(0, len(level), fanout)]
        for path, i in zip(paths, at, strict=True):
            run = runs[i // fanout]
            path.append((i % fanout, run[: i % fanout] + run[i % fanout + 1 :]))
        at, level = [i // fanout for i in at], [H(*r) for r in runs]
    return level[0], paths


def brute(rows, fanout=2):
    parts = {}
    for r in rows:
        parts.setdefault(r["lang"], []).append(r)
    names = sorted(parts, key=lambda n: (n is not None, (n or "").encode()))
    low = {}
    for n in names:
        own = sorted(parts[n], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        low[n] = (own, *tree([leaf(r) for r in own], fanout))
    if not names:
        return []
    root, tops = tree([low[n][1] for n in names], fanout)
    out = []
    for n, top in zip(names, tops, strict=True):
        own, subroot, paths = low[n]
        for r, path in zip(own, paths, strict=True):
            tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            fold = leaf(r, int(tampered))
            for pos, others in path + top:
                fold = H(*others[:pos], fold, *others[pos:])
            out.append((r["doc_id"], leaf(r), subroot, root, H(*[x for _, o in path + top for x in o]), fold, fold == root))
    return sorted(out, key=repr)


def digest(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_query_equals_brute_force(spark):
    rows = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = digest(Q.op11_merkle(spark, SF))
    assert got == brute(rows) and 0 < sum(not r[-1] for r in got) < len(got)


def rows_of(n):
    langs = [None, "", "de", "é", "zz", "one"]
    out = [dict(doc_id=i if i % 9 else None, text="" if i % 5 == 0 else None if i % 5 == 1 else "tëxt " * i, lang="one" if i == n - 1 else langs[i * i % 5], source=None if i % 3 else "s", n_chars=None if i % 4 == 0 else i) for i in range(n)]
    return out + [dict(out[7]), dict(out[7]), dict(out[10], text="another"), dict(out[10])]


@pytest.mark.parametrize(("n", "fanout"), [(60, 2), (61, 3), (40, 16), (200, 2)])
def test_trees_of_all_shapes(spark, tmp_path, n, fanout, monkeypatch):
    rows = rows_of(n)
    df = spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], SCHEMA)
    df.withColumn("idx", F.lit("clash")).withColumn("grp", F.lit(1)).withColumn("hash", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    real = M.manifest
    monkeypatch.setattr(M, "manifest", lambda *a, **k: real(*a, fanout=fanout, **k))
    assert digest(Q.op11_merkle(spark, str(tmp_path))) == brute(rows, fanout)


def test_small_and_odd_tables(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    assert M.manifest(empty).collect() == []
    one = spark.createDataFrame([(5, "t" * 300_000, None, None, 2**63 - 1)], SCHEMA)
    r = M.manifest(one, now={"n_chars": F.try_add(F.col("n_chars"), F.lit(1))}).collect()[0]
    assert r["leaf"] == r["subroot"] == r["root"] and r["path"] == [] and r["folded"] != r["root"]
    with pytest.raises(ValueError, match="fanout"):
        M.manifest(one, fanout=1)


def test_other_fields_and_positions(spark):
    df = spark.range(37).select(F.col("id").alias("k"), (F.col("id") % 2).alias("p"), F.col("id").cast("string").alias("v"))
    got = M.manifest(df, key="k", part="p", fields=("k", "v"), fanout=4).orderBy("k").collect()
    assert [r["idx"] for r in got] == [r["k"] // 2 for r in got] and all(r["folded"] == r["root"] for r in got)
    assert len({bytes(r["root"]) for r in got}) == 1 and len({bytes(r["subroot"]) for r in got}) == 2

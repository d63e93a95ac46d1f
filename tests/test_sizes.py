"""What larger tables showed: scores that round to zero, and work that lands in few tasks."""

import random

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ragspark.functions import vectors as V
from ragspark.llm import multiindex
from ragspark.operators import elements, lexical, markup, retrieve
from ragspark.plans import catalogue, source_queries  # noqa: F401  the latter adds its queries


@pytest.fixture
def tables(spark, tmp_path):
    """Writes tables into a folder, and runs SQL on them."""

    class Tables:
        path = str(tmp_path)

        def write(self, name, df):
            df.toPandas().to_parquet(f"{tmp_path}/{name}.parquet", index=False)

        def sql(self, name):
            con = duckdb.connect()
            for f in tmp_path.glob("*.parquet"):
                con.execute(f"create view {f.stem} as select * from '{f}'")
            return con.execute(catalogue.SQL[name]).fetchdf()

        def both(self, name):
            """The rows of a query and of its SQL, sorted."""
            found, other = catalogue.QUERIES[name](spark, self.path).toPandas(), self.sql(name)
            plain = lambda v: v if isinstance(v, str) else None if pd.isna(v) else float(v)
            show = lambda df: sorted(repr([plain(v) for v in row]) for row in df[sorted(df.columns)].astype(object).itertuples(index=False))
            return show(found), show(other)

    return Tables()


def test_scores_that_round_to_zero(spark, tables):
    vectors = [(0, [1.0, 0.0]), (1, [4e-7, 1.0]), (2, [6e-7, 1.0]), (3, [-1.0, 0.0]), (4, [0.5, 0.5])]
    tables.write("embeddings", spark.createDataFrame(vectors, "vec_id long, embedding array<float>"))
    tables.write("documents", spark.createDataFrame([(0, "thention a"), (1, "b"), (9, "stion ering")], "doc_id long, text string"))
    for name in ("hybrid_trace", "hybrid_topk", "profile_recall", "score_stats"):
        found, wanted = tables.both(name)
        assert found == wanted, name
    found = catalogue.QUERIES["hybrid_trace"](spark, tables.path).collect()[0]
    assert (found["vector"], found["lexical"], found["fused"]) == (3, 2, 4)


def shape(node):
    """A tree as nested lists, and the tags that each node's walk finds."""
    return [node.tag, node.attrs, sorted(node.within), [n.tag for n in node.walk()], [c if isinstance(c, str) else shape(c) for c in node.children]]


def test_plain_markup_is_read_as_the_parser_reads_it():
    bits = ["<p>", "</p>", '<div class="l m">', "</div>", "<ul>", "<li>", "</ul>", "<table>", "<tr>", "<td>", "<br>", "<br/>", '<img src="a&amp;b" alt>', "<script>", "</script>", "<title>", "</title>"]
    bits += ["x", "a & b", "&amp;", "&notit", "<", ">", "<!-- c -->", "<!--a-b-->", "<!doctype html>", "<a href='x'>", '<A HREF="x" href="y" b="">', "</a>", "<nav/>", "<textarea>", "</textarea>", "<1>", "</ p>", '<td a="<">', "\n"]
    rng = random.Random(1)
    plain = 0
    for _ in range(3000):
        html = "".join(rng.choices(bits, k=rng.randint(0, 12)))
        b = markup._Builder()
        b.feed(html)
        b.close()
        markup.ended(b.root)
        assert shape(markup.parse(html)) == shape(b.root), html
        plain += markup._plain(html) is not None
    assert plain > 300
    assert markup._plain('<title>a | b</title><p class="x">b &amp; c<img src="https://i.test/1.png" alt="al"><script>no</script>') is not None
    assert [n.text() for n in markup.parse('<i class="a b">1</i><i class="b">2</i>').select("i.b")] == ["1", "2"]


@pytest.mark.parametrize("name", ["page_texts", "timeline_posts", "page_elements"])
def test_narrow_rows_are_dealt_over_tasks(spark, tables, name):
    """One small file of many rows whose pages take long."""
    part = spark.range(45_000).selectExpr("id AS p_partkey", "'n' AS p_name", "'b' AS p_brand", "'t' AS p_type", "int(id % 50) AS p_size", "1.0D AS p_retailprice")
    tables.write("part", part)
    assert spark.read.parquet(f"{tables.path}/part.parquet").rdd.getNumPartitions() == 1
    assert catalogue.QUERIES[name](spark, tables.path).rdd.getNumPartitions() == 4


def test_best_elements_are_chosen_where_they_are_made(spark, tables):
    pages = [(1, "<h2>a</h2><p>b</p><h1>c</h1><ul><li>d</ul><pre>e</pre><p>f</p>"), (2, "<p>x</p>"), (3, None), (4, "<img src=a><table><tr><td>1</table><h6>z</h6><h6>y</h6>")]
    df = spark.createDataFrame(pages, "page_id long, html string")
    for most in (1, 3, 50):
        wanted = elements.finalized(elements.extract(df, "page_id", "html"), "page_id", most)
        found = elements.extract(df, "page_id", "html", best=most)
        assert sorted(map(repr, found.select(wanted.columns).collect())) == sorted(map(repr, wanted.withColumn("omitted", wanted["omitted"].cast("long")).collect()))
    part = [(k, "n", "b", "t", 1, 1.0) for k in (1, 2, 2)]
    tables.write("part", spark.createDataFrame(part, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"))
    found, wanted = tables.both("best_page_elements")
    assert found == wanted and len(found) == 9
    plan = catalogue.QUERIES["best_page_elements"](spark, tables.path)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan


def test_best_documents_are_scored_within_their_rows(spark, monkeypatch):
    rng = random.Random(2)
    word = lambda: f"w{min(int(rng.expovariate(0.08)), 60)}"
    docs = [(i, " ".join(word() for _ in range(rng.randint(0, 40)))) for i in range(700)] + [(700, None), (None, "w1 w2"), (701, "W1, w2")] + [(i, "w3 w4 w9") for i in range(800, 900)]
    queries = [(i, " ".join(word() for _ in range(rng.randint(1, 9)))) for i in range(40)] + [(40, "nowhere"), (41, ""), (None, "w3 w4"), (3, "w7 w8")]
    df, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "query_id long, text string")
    rows = lambda d: sorted(map(repr, ((r["query_id"], r["doc_id"], r["rank"], r["score"]) for r in d.collect())))
    wanted = rows(lexical.top(lexical.bm25(df, q), 5, "query_id"))
    assert rows(lexical.best(df, q, 5)) == wanted
    assert "query_id, doc_id" not in lexical.best(df, q, 5)._jdf.queryExecution().executedPlan().toString()  # no shuffle of pairs
    monkeypatch.setattr(lexical, "PAIRS", 30)
    assert rows(lexical.best(df.repartition(3), q, 5)) == wanted
    twice = df.union(spark.createDataFrame([(5, "w1 w3"), (6, "w2")], df.schema))
    assert rows(lexical.best(twice, q, 5)) == rows(lexical.top(lexical.bm25(twice, q), 5, "query_id"))
    named = df.select(df.doc_id.cast("string").alias("id"), df.text.alias("body"))
    assert lexical.best(named, q, 2, key="id", text="body").where("query_id = 0").count() == 2
    assert lexical.best(df.limit(0), q, 5).count() == 0 and lexical.best(df, q.limit(0), 5).count() == 0


def test_recall_shuffles_no_text(spark, tables):
    docs = [(i, f"alpha{i % 7} beta gamma{i}") for i in range(60)] + [(60, None), (61, "")]
    tables.write("documents", spark.createDataFrame(docs, "doc_id long, text string"))
    tables.write("benchmark", spark.createDataFrame([(0, "alpha1 beta gamma8"), (1, "alpha2"), (2, "none"), (3, "beta")], "item_id long, text string"))
    for name in ("recall_at_5", "bm25_multi_query"):
        found, wanted = tables.both(name)
        assert found == wanted, name
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalogue.QUERIES["recall_at_5"](spark, tables.path)._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(doc_id" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_nearest_equals_all_pairs(spark, tables, monkeypatch):
    rng = random.Random(4)
    rows = [(i, [float(rng.choice((-1, 0, 0, 1, 2))) for _ in range(4)]) for i in range(300)] + [(300 + i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(300)]
    rows += [(600, [0.0] * 4), (601, [1.0, 2.0]), (650, [3.0]), (602, None), (700, None), (None, [1.0] * 4), (50, [1.0, 0.0, 0.0, 0.0]), (750, [float("nan"), 1.0, 0.0, 0.0]), (603, [1.0, None, 0.0, 0.0])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    asked = q.withColumnRenamed("embedding", "qe")
    pairs = e.join(asked, F.col("vec_id") != F.col("query_id")).select("query_id", "vec_id", V.cosine(F.col("embedding"), F.col("qe")).alias("score"))
    show = lambda df: sorted(map(repr, ((r["query_id"], r["rank"], r["vec_id"], None if r["score"] is None else r["score"] + 0.0) for r in df.collect())))
    wanted = show(lexical.top(pairs, 5, "query_id", key="vec_id"))
    assert show(retrieve.nearest(e, q, 5)) == wanted
    monkeypatch.setattr(retrieve, "ROUND", 3)
    assert show(retrieve.nearest(e, q, 5)) == wanted
    assert retrieve.nearest(e.limit(0), q.limit(0), 5).count() == 0
    tables.write("embeddings", e.where("vec_id < 600 AND exists(embedding, x -> x <> 0)"))
    found, wanted = tables.both("cosine_multi_query")
    assert found == wanted
    assert "NestedLoop" not in catalogue.QUERIES["cosine_multi_query"](spark, tables.path)._jdf.queryExecution().executedPlan().toString()


def test_a_regions_visitors_pass_by_in_chunks(monkeypatch):
    """Vectors are sent to regions with the cells that they visit there, and chunks of visitors find what all of them at once find."""
    rng = np.random.default_rng(3)
    rows = np.repeat(rng.normal(size=(150, 8)), 20, 0) + rng.normal(size=(3000, 8)) * 0.25
    rows = np.concatenate((rows, rows[:200])).astype(np.float32)
    monkeypatch.setattr(multiindex, "REGION", 64)
    index = multiindex.fit(multiindex.unit(rows), 40_000)
    listed = pa.array(list(rows), pa.list_(pa.float32()))
    batches = [pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows)))[i : i + 700], listed[i : i + 700]], names=["vec_id", "vec"]) for i in range(0, len(rows), 700)]
    sent = pa.Table.from_batches(list(multiindex._send(index, np.ones(max(1, len(index.pivots)), np.int64))(iter(batches))))
    sent = sent.sort_by([("task", "ascending"), ("role", "ascending"), ("key", "ascending")])
    role, task = sent["role"].to_numpy(), sent["task"].to_numpy()
    assert len(set(task.tolist())) > 4 and (role == multiindex.VISITOR).sum() > 1000
    for t, r, c in zip(task.tolist(), role.tolist(), sent["cells"].to_pylist(), strict=True):
        if r == multiindex.VISITOR:
            assert c and (index.region(np.frombuffer(c, "<i4").astype(np.int64)) == t).all()
    held = []
    whole = multiindex._found.__globals__["unit"]
    monkeypatch.setattr(multiindex, "unit", lambda x: held.append(len(x)) or whole(x))

    def links(chunk: int, size: int):
        held.clear()
        monkeypatch.setattr(multiindex, "CHUNK", chunk)
        out = pa.Table.from_batches(list(multiindex._found(index, "<f4")(iter(sent.combine_chunks().to_batches(size)))))
        got = out.group_by("key").aggregate([("links", "sum")])
        return dict(zip(got["key"].to_pylist(), got["links_sum"].to_pylist(), strict=True)), max(held)

    (one, most), (other, least) = links(1 << 20, 10_000), links(16, 7)
    assert one == other and sum(one.values()) > 1000 and least < most

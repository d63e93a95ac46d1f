"""Laws of the operators on small tables of their own."""

import math
import random

import pytest
from pyspark.sql import functions as F

from ragspark.errors import ValidationError, bounded, exactly_one
from ragspark.functions import numbers as N
from ragspark.functions import text as T
from ragspark.functions import urls as U
from ragspark.functions import vectors as V
from ragspark.operators import chunking, dedup, elements, fusion, hygiene, lexical, listings, markup, retrieve, threads


def values(spark, column, rows, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def bm25(spark, corpus, query):
    q = spark.createDataFrame([(0, query)], "query_id int, text string")
    return {r.doc_id: r.score for r in lexical.bm25(corpus, q).collect()}


def test_bm25_formula_saturation_and_repeats(spark):
    corpus = docs(spark, "red fox", "red red fox jumps", "blue", None, "red " * 20)
    got = bm25(spark, corpus, "Red red FOX")
    n, avg = 5, (2 + 4 + 1 + 0 + 20) / 5
    idf = lambda df: math.log((n - df + 0.5) / (df + 0.5) + 1)
    part = lambda tf, dl: tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg)) + 1
    assert got[0] == pytest.approx(idf(3) * part(1, 2) + idf(2) * part(1, 2))
    assert got[1] == pytest.approx(idf(3) * part(2, 4) + idf(2) * part(1, 4))
    assert set(got) == {0, 1, 4} and got == pytest.approx(bm25(spark, corpus, "red fox"))
    assert bm25(spark, corpus, "absent") == {} and bm25(spark, corpus, "!!") == {} and bm25(spark, corpus.limit(0), "red") == {}
    index = lexical.build_index(corpus)
    q = spark.createDataFrame([(0, "red fox")], "query_id int, text string")
    assert {r.doc_id: r.score for r in lexical.search(index, q).collect()} == pytest.approx(got)


def test_rrf_shared_item_wins_and_payload(spark):
    rows = [(0, 1, "a", "a0"), (0, 2, "b", "b0"), (0, 3, "a", "again"), (1, 1, "c", "c1"), (1, 2, "a", "a1")]
    out = {r.identity: r for r in fusion.rrf(spark.createDataFrame(rows, "ranking int, position int, key string, v string")).collect()}
    assert out["a"].rrf_score == pytest.approx(1 / 61 + 1 / 62) and out["a"].payload.v == "a1"
    assert out["b"].rrf_score == pytest.approx(1 / 62) and max(out.values(), key=lambda r: r.rrf_score).identity == "a"


def test_rrf_identity_and_key_differ(spark):
    rows = [(0, 1, "u1", "x", "first"), (0, 2, "u2", "x", "second"), (1, 1, "u3", "y", "third")]
    out = {r.identity: r for r in fusion.rrf(spark.createDataFrame(rows, "ranking int, position int, key string, id string, v string"), identity="id").collect()}
    assert out["x"].rrf_score == pytest.approx(1 / 61 + 1 / 62) and out["x"].payload.v == "first"


def test_rescore_and_signals(spark):
    df = spark.createDataFrame([(1, 0.1, 1.0), (2, 0.2, 0.0), (3, 0.3, 0.5)], "id int, rrf_score double, s double")
    out = {r.id: r.combined_score for r in fusion.rescore(df, {"rrfAnchor": 1.0, "s": 2.0}, ["s", "unknown_weight"][:1]).collect()}
    assert out == {1: 2.0, 2: 0.5, 3: 2.0}
    assert {r.combined_score for r in fusion.rescore(df.where("id = 1"), {"rrfAnchor": 1.0}, []).collect()} == {0.0}
    posts = spark.createDataFrame([(1, "2024-01-01", 10, 0), (2, "2024-01-31", 0, 5)], "id int, created string, points long, n long")
    by_date = fusion.discussion_signals(posts, "2024-02-01", "date", "created", "points", "n").columns
    assert "recency" not in by_date and "engagement" in by_date and "commentEngagement" in by_date


def test_name_tiers(spark):
    score = values(spark, lambda x: fusion.name_score(x, F.lit(1), "http client"), ["http-client", "http", "http-client-x", "my-http-client", "clienthttp", "xhttpx", "none"])
    assert score == [1000, 800, 500, 100, 50, 10, None]


def test_ages_and_recency(spark):
    at = "2024-02-01 00:00:00"
    got = values(spark, lambda x: N.age_days(x, at), ["3 days ago", "2 Weeks ago", "12 hours ago", "2024-01-30", None, "", "soon", " 1.5 days ago "])
    assert got == [3, 14, 0.5, 2, None, None, None, 1.5]
    got = values(spark, lambda x: N.posted_score(x, at), ["Posted 3 days ago", "20 days ago", "60 days ago", "400 days ago", "today", "posted yesterday", "2024-01-20", "junk", None])
    assert got == [1, 0.7, 0.3, 0, 1, 1, 0.7, 0, 0]


def test_numbers(spark):
    assert values(spark, N.salary_max, ["$80k - $95.5k", "100,000 a year", "none", None, "12 to 30"]) == [95500, 100000, None, None, 30]
    assert values(spark, N.with_suffix, ["1.2K", "3M", "1,234", "x"]) == [1200, 3_000_000, 1234, 0]
    assert str(values(spark, N.compact_timestamp, ["20240131T235900Z"])[0]) == "2024-01-31 23:59:00"


def test_urls(spark):
    cases = {
        "HTTP://WWW.Ex.com:80/a/?utm_source=x&b=1#f": "http://ex.com/a?b=1",
        "https://ex.com": "https://ex.com/",
        "https://ex.com:8443/": "https://ex.com:8443/",
        "https://ex.com/?REF=1": "https://ex.com/",
        "Not A Url//": "not a url",
        "": "",
    }
    assert values(spark, U.normalized, list(cases)) == list(cases.values())
    safe = ["http://a.com", "ftp://a.com", "http://localhost/x", "https://10.1.2.3", "http://172.20.0.1", "http://172.40.0.1", "http://[fe80::1]/", "http://metadata.google.internal", None, "junk"]
    assert values(spark, U.is_safe, safe) == [True, False, False, False, False, True, False, False, False, False]
    ids = ["dQw4w9WgXcQ", "https://youtu.be/dQw4w9WgXcQ?t=1", "https://www.youtube.com/watch?a=b&v=dQw4w9WgXcQ", "https://youtube.com/shorts/dQw4w9WgXcQ", "https://example.com/dQw4w9WgXcQ"]
    assert values(spark, U.video_id, ids) == ["dQw4w9WgXcQ"] * 4 + [None]
    assert values(spark, U.job_source, ["https://au.indeed.com/x", "https://www.seek.com.au/job/1", "https://notseek.com/x"]) == ["indeed", "seek", "other"]
    assert values(spark, U.job_id, ["https://s.com/job/42?x", "https://s.com/jobs/42", "https://s.com/viewjob/a%20b"]) == ["42", None, "a b"]
    assert values(spark, lambda x: U.under(x, "https://e.com/docs/"), ["https://e.com/docs", "https://e.com/docs/a", "https://e.com/docs/a/b", "https://o.com/docs/a"]) == [True, True, False, False]


def test_texts(spark):
    assert values(spark, T.without_site, ["Job - Site", "A | B - C", "plain", None]) == ["Job", "A | B", "plain", None]
    assert values(spark, T.normalized_title, [r"The \emph{Big} $x^2$ Idea!"]) == ["the big idea"]
    assert values(spark, T.first_author, ["Smith, J.", "J. A. Smith", ""]) == ["smith", "smith", ""]
    assert values(spark, T.decoded_numeric, ["a&#233;&amp;", "b&lt;", None]) == ["aé&", "b<", None]
    assert values(spark, T.composed, ["é", None]) == ["é", None]
    assert values(spark, T.stripped_html, ["<p>a<script>x</script> &amp; b</p>"]) == ["a & b"]
    assert values(spark, lambda x: T.truncated(x, 3), ["abcd", "abc"]) == ["abc... [truncated]", "abc"]


def test_vectors(spark):
    got = values(spark, lambda x: V.cosine(x, F.array(F.lit(1.0), F.lit(0.0))), [[1.0, 0.0], [0.0, 2.0], [0.0, 0.0], [1.0, 1.0]], "array<float>")
    assert got == pytest.approx([1, 0, 0, 2**-0.5])


def test_dedup(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "", 1), (3, "a", 9), (4, None, 1), (5, "", 2)], "id int, k string, v int")
    assert sorted(r.id for r in dedup.keep_first(df, F.col("k"), "id").collect()) == [1, 2, 4, 5]
    best = {r.id: r.v for r in dedup.keep_best(df, F.nullif("k", F.lit("")), F.col("v"), "id").collect()}
    assert best == {1: 9, 2: 1, 4: 1, 5: 2}
    again = dedup.keep_first(dedup.keep_first(df, F.col("k"), "id"), F.col("k"), "id")
    assert again.count() == 4


def test_papers_fold_in_order(spark):
    rows = [(1, "A  title", None, None, None), (2, "a title", None, "d", None), (3, "A Title", None, None, "v"), (4, "A title", 3, None, None), (5, "other", None, None, None)]
    out = {r.position: (r.doi, r.venue, r.citations) for r in dedup.dedup_papers(spark.createDataFrame(rows, "position int, title string, citations long, doi string, venue string")).collect()}
    assert out == {1: (None, None, 3), 5: (None, None, None)}


def test_budgets(spark):
    df = spark.createDataFrame([(1, "éé"), (2, "abcd"), (3, "x"), (4, "")], "id int, t string")
    ids = lambda b, **o: [r.id for r in dedup.prefix_budget(df, F.octet_length("t"), b, "id", **o).orderBy("id").collect()]
    assert ids(8) == [1, 2] and ids(4) == [1] and ids(0) == [] and ids(1, keep_one=True) == [1]
    kept = [len(ids(b)) for b in range(1, 12)]
    assert kept == sorted(kept)


def test_budget_over_ranges_equals_a_plain_sum(spark):
    rows = [(i * 7919 % 1000, f"s{i % 3}", i * 31 % 50 if i % 11 else None) for i in range(1000)]
    df = spark.createDataFrame(rows, "id int, s string, n int").repartition(7)
    for budget in (0, 1, 49, 700, 24_000, 10**9):
        used, expected = 0, []
        for r in sorted(rows, key=lambda r: (r[1], r[0])):
            used += r[2] or 0
            if used > budget or budget == 0:
                break
            expected.append((r[0], used))
        got = dedup.prefix_budget(df, F.col("n"), budget, "s", "id")
        assert got.columns == ["id", "s", "n", "used"]
        assert [(r.id, r.used) for r in got.orderBy("s", "id").collect()] == expected
    assert dedup.prefix_budget(df.limit(0), F.col("n"), 5, "s", "id", keep_one=True).count() == 0
    ties = spark.createDataFrame([(None, 2)] * 3 + [(1, 2)] * 4, "k int, n int")
    assert [(r.k, r.used) for r in dedup.prefix_budget(ties, F.col("n"), 9, "k").orderBy("used").collect()] == [(None, 2), (None, 4), (None, 6), (1, 8)]


def test_whole_table_budgets_have_no_window_over_all_rows(spark):
    df = spark.range(1000).select("id", F.lit("abc").alias("t"))
    plan = dedup.prefix_budget(df, F.octet_length("t"), 90, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(_range" in plan and "windowspecdefinition(id" not in plan


def test_eviction(spark):
    rows = [("old", 0, 90, 10), ("a", 50, 80, 10), ("b", 50, 70, 10), ("c", 50, 60, 10)]
    df = spark.createDataFrame(rows, "corpus_id string, created_at long, last_accessed_at long, total_bytes long")
    stay = lambda **o: sorted(r.corpus_id for r in dedup.evict(df, 100, 60, **o).collect())
    assert stay() == ["a", "b", "c"] and stay(most=2) == ["a", "b"] and stay(most_bytes=15) == ["a"] and stay(most=1, current="c") == ["a", "c"]


def test_banner(spark):
    pages = [(1, "We use cookies to\nAccept All Cookies\nreal text"), (2, "text\n" * 9 + "We use cookies to"), (3, "cookie one\nprivacy two\nreject tracking three"), (4, "cookie one\nprivacy two\nplain"), (5, "\n\n")]
    got = {r.k: round(r.ratio, 3) for r in hygiene.banner_ratio(spark.createDataFrame(pages, "k int, t string"), "k", "t").collect()}
    assert got == {1: 0.667, 2: 0.1, 3: 1.0, 4: 0.0}


def test_quality_and_boilerplate(spark):
    assert values(spark, hygiene.quality, ["", "Loading...", "short", "# T", "x " * 40, None]) == ["empty", "placeholder", "little", "meaningful", "meaningful", "empty"]
    nav = "\n".join(f"- [Item {i}](http://a/{i})" for i in range(8))
    texts = ["", nav, "```\n" + nav + "\n```", "A long prose line that has no link in it and goes on for quite a while.", "- a\n- b\n- c\n- d"]
    want = [chunking.is_boilerplate(t) for t in texts]
    assert values(spark, lambda x: hygiene.is_boilerplate(hygiene.line_stats(x)), texts) == want == [True, True, False, False, True]


def test_soft_constraint(spark):
    corpus = docs(spark, "alpha beta common", "alpha common", "common gamma", "nothing")

    def kept(q):
        rows, warned = lexical.soft_constraint(corpus, corpus, q)
        return [r.doc_id for r in rows.orderBy("doc_id").collect()], warned

    assert kept("alpha") == ([0, 1], False) and kept("alpha beta common") == ([0, 1], False)
    assert kept("the of") == ([0, 1, 2, 3], False) and kept("zeta eta") == ([0, 1, 2, 3], True) and kept("alph") == ([0, 1, 2, 3], True)


def test_retrieve_trace_and_validation(spark):
    d = spark.createDataFrame([("a", "apple pie", "u1", None), ("b", "car", "u2", None)], "id string, text string, url string, title string")
    e = spark.createDataFrame([("a", [0.0, 1.0]), ("b", [1.0, 0.0])], "id string, vector array<float>")
    rows, trace = retrieve.retrieve(retrieve.prepare(d, "search", e), "apple", [1.0, 0.0])
    assert trace == {"vector": 1, "lexical": 1, "fused": 2, "returned": 2} and {r.id for r in rows.collect()} == {"a", "b"}
    assert retrieve.retrieve(retrieve.prepare(d, "search"), "apple")[0].count() == 1
    empty = retrieve.prepare(d.limit(0), "search")
    assert empty.status == "empty" and retrieve.retrieve(empty, "x")[1]["fused"] == 0
    for bad in (e.limit(1), e.withColumn("vector", F.array(F.lit(float("nan")).cast("float"), F.lit(1.0).cast("float")))):
        with pytest.raises(ValidationError):
            retrieve.prepare(d, "search", bad)
    with pytest.raises(ValidationError):
        retrieve.profile("odd")
    assert retrieve.prepare(d, "search").corpus_id == retrieve.prepare(d, "search").corpus_id != retrieve.prepare(d, "other").corpus_id


def test_rerank(spark):
    d = spark.createDataFrame([(i, i, t) for i, t in enumerate(["x", "red fox", "red", "y"])], "position long, rank long, text string")
    out = retrieve.rerank(d, retrieve.overlap_scorer("red fox"), 2).orderBy("rerank_rank").collect()
    assert [r.position for r in out] == [1, 2] and out[0].median_delta > 0


def test_parents_and_flatten(spark):
    rows = [("1", None, "a", "root", "/r/1", 0), ("2", "t1_1", "b", "reply", None, 1), ("3", "t1_2", None, "deep", "http://x/3", 2), ("4", "t1_9", "c", "orphan", None, 3), ("5", "t1_6", "c", "under gone", None, 4), ("6", "t1_1", "c", "[deleted]", None, 5)]
    df = spark.createDataFrame([("t", *r) for r in rows], "thread string, id string, parent_id string, author string, body string, permalink string, position int")
    out = {r.id: r for r in threads.with_parents(df, 2, "https://h", ("thread",)).collect()}
    assert out["3"].text == "root\nreply\n\ndeep" and out["3"].section == "conversation" and out["3"].url == "http://x/3"
    assert out["4"].text == "orphan" and out["5"].text == "under gone" and "6" not in out and out["1"].url == "https://h/r/1"
    tree = df.withColumn("parent_id", threads.bare_id(F.col("parent_id")))
    assert [(r.id, r.depth) for r in threads.flattened(tree, "thread").orderBy("path").collect()] == [("1", 0), ("2", 1), ("3", 2), ("6", 1), ("5", 2)]


def test_deep_threads_stay_whole(spark):
    """Deeper than 64 levels, beside a cycle, an orphan's chain and an id that two comments share."""
    rows = [("a", str(i), str(i - 1) if i else None, i) for i in range(150)] + [("b", "1", "2", 0), ("b", "2", "1", 1), ("b", "3", "9", 2), ("b", "4", "3", 3)]
    rows += [("c", "0", None, 0), ("c", "1", "0", 1), ("c", "1", "0", 2), ("c", "2", "1", 3), ("c", "3", "2", 4)]
    df = spark.createDataFrame(rows, "thread string, id string, parent_id string, position int")
    got = threads.flattened(df, "thread").orderBy("path").collect()
    assert [(r.id, r.depth) for r in got if r.thread == "a"] == [(str(i), i) for i in range(150)]
    assert [(r.id, r.depth) for r in got if r.thread == "c"] == [("0", 0), ("1", 1), ("2", 2), ("3", 3), ("1", 1), ("2", 2), ("3", 3)]
    assert not [r for r in got if r.thread == "b"]
    assert threads.flattened(df, "thread", most=64, paths=False).where("thread = 'a'").count() == 64


def test_transcripts(spark):
    def groups(segs):
        df = spark.createDataFrame([("v", i, t, float(i), d) for i, (t, d) in enumerate(segs)], "video_id string, seg_no int, text string, offset double, duration double")
        return [(r.segments, r.text) for r in threads.transcript_chunks(df).orderBy("chunk_index").collect()]

    assert [n for n, _ in groups([("a", 1.0)] * 30)] == [12, 12, 6]
    assert [n for n, _ in groups([("x" * 500, 1.0)] * 5)] == [2, 2, 1]
    assert [n for n, _ in groups([("a", 25.0)] * 5)] == [2, 2, 1]
    assert groups([(" a  b ", -5.0), ("  ", 1.0), ("c", 1.0)]) == [(2, "a b c")]


def listing(spark, rows):
    cols = "position long, title string, company string, location string, work_mode string, salary_raw string, source string, source_url string, job_id string, posted_raw string, semantic double"
    return listings.confidence(spark.createDataFrame(rows, cols))


def test_listing_filters_rank_and_dedup(spark):
    rows = [
        (0, "Engineer", "Acme", "Sydney, NSW", "remote", "$90k - $100k", "jora", "u1", "1", "3 days ago", 0.5),
        (1, "Engineer", "ACME ", None, "unknown", None, "seek", "u1", "1", None, 0.0),
        (2, "Senior Manager", None, "Perth", "onsite", "$200k", "other", None, None, "2020-01-01", 0.9),
        (3, "engineer ", "acme", "Sydney", "hybrid", "$95k", "indeed", "u4", "7", "today", 0.1),
    ]
    df = listing(spark, rows)
    c = listings.Constraints(location=("sydney",), work_mode=("remote", "hybrid"), max_salary=100_000, exclude_titles=("manager",))
    out = {r.position: r for r in listings.rank(df, c, "2024-02-01").collect()}
    assert set(out) == {0, 1, 3} and out[0].matched == ["location: sydney", "work mode: remote", "salary within budget"] and out[1].matched == []
    assert out[0].overall == pytest.approx(0.45 * 0.5 + 0.2 + 0.15 + 0.1 + 0.1)
    free = {r.position: r.overall for r in listings.rank(df, listings.Constraints(), "2024-02-01").collect()}
    assert free[1] == pytest.approx(0.2 * 0.5 + 0.15 * 0.5 + 0.1 * 0.25)
    once = {r.position: (r.source, r.work_mode) for r in listings.dedup(df).collect()}
    assert once == {0: ("indeed", "hybrid"), 2: ("other", "onsite")}


MARKDOWN = "\n".join(["# Title", "", "Intro sentence one. " * 20, "## First", "Body text here. " * 150, "### Deep", "| a | b |", "| - | - |", "| 1 | 2 |", "Deep words follow. " * 30, "# Second title is text", "## Code", "```", "# not a heading", "```", "Code words follow. " * 30])


def test_chunker(spark):
    made, title = chunking.chunk(MARKDOWN)
    assert title == "Title" and len(made) > 3
    sections = [c.section for c, _ in made]
    assert any(s.endswith("## First") for s in sections) and all(s.startswith("# Title") for s in sections)
    assert all(n <= 480 for _, n in made) and [c.offset for c, _ in made] == sorted(c.offset for c, _ in made)
    assert any("# not a heading" in c.content for c, _ in made) and any("# Second title is text" in c.content for c, _ in made)
    assert chunking.chunk("") == ([], None) and chunking.chunk(None) == ([], None)
    assert len(chunking.chunk("short text")[0]) == 1
    nav = "\n".join(f"- [Item {i}](http://a/{i})" for i in range(8))
    kept, _ = chunking.chunk("## Nav\n" + nav + "\n## Text\n" + "Some real prose goes on here. " * 20)
    assert len(kept) == 1 and "Item" not in kept[0][0].content
    assert "Item 3" in chunking.chunk(nav)[0][0][0].content
    fence = "```\n" + "code line\n" * 400 + "```\n" + "After the code. " * 20
    assert any(c.content.count("code line") == 400 for c, _ in chunking.chunk(fence)[0])
    df = spark.createDataFrame([(1, MARKDOWN), (2, None)], "id int, t string")
    rows = chunking.chunks(df, "id", "t").orderBy("chunk_index").collect()
    assert [r.content for r in rows] == [c.content for c, _ in made] and {r.total_chunks for r in rows} == {len(made)}


@pytest.mark.parametrize("seed", range(5))
def test_chunks_cover_long_text(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["word ", "Sentence end. ", "line\n", "\n\n", "Why? ", "x" * 30]) for _ in range(1500)).strip()
    made = chunking.split(text, "", 0)
    assert made[0].offset == 0 and chunking.covered(text, made) and made[-1].content.endswith(text[-5:])


HTML = """<body><nav><p>skip</p></nav><h1 id=top>Head</h1><p>One<p>Two <b>bold</b><div><p>in</p></div>
<table><caption>Cap</caption><tr><th>a<th>b<tr><td>1<td>2</table><img src="javascript:x" alt=A><pre><code class="language-py">x = 1</code></pre>
<ul><li>i<li>j<ul><li>k</ul></ul><script>no</script><footer><h2>no</h2></footer></body>"""


def test_html_elements(spark):
    got = elements.from_html(HTML)
    assert [e["type"] for e in got] == ["heading", "text", "text", "text", "table", "image", "code", "list", "list"]
    assert got[0]["id"] == "top" and got[2]["text"] == "Two bold" and got[4]["markdown"] == "| a | b |\n| --- | --- |\n| 1 | 2 |" and got[4]["caption"] == "Cap"
    assert got[5]["src"] is None and got[6]["language"] == "py" and got[7]["items"][0] == "i"
    assert elements.from_html(None) == [] and elements.from_html("<p>" + "y" * 10_001)[0]["truncated"]
    df = spark.createDataFrame([(1, HTML), (2, "<h2>a</h2>" + "<p>t</p>" * 60)], "id int, h string")
    out = elements.finalized(elements.extract(df, "id", "h"), "id")
    two = out.where("id = 2").orderBy("position").collect()
    assert len(two) == 50 and two[0].type == "heading" and two[0].omitted == 11


def test_elements_are_whole_unless_limited(spark):
    html = "<h2>" + "h" * 10_001 + "</h2>" + "<p>t</p>" * 1100
    got = elements.extract(spark.createDataFrame([(1, html)], "id int, h string"), "id", "h")
    assert got.count() == 1101 and len(got.where("position = 0").first().text) == 10_001
    assert {r.omitted for r in elements.finalized(got, "id", 5).collect()} == {1096}
    cut = elements.from_html(html)
    assert len(cut) == 1000 and cut[0]["truncated"] and cut[0]["original_length"] == 10_001 and cut[0]["text"].endswith(elements.MARK)
    assert elements.from_markdown("- " + "y" * 10_001)[0]["truncated"] and len(elements.from_markdown("a\n" * 1100, None, None)) == 1100


def test_markdown_elements():
    md = "# H\ntext `code`\n\n- a\n- b\n  more\n\n1. x\n| a | b |\n|---|---|\n| 1 | 2 |\n![alt](s.png \"t\")\n```py\ny\n```"
    got = elements.from_markdown(md)
    assert [e["type"] for e in got] == ["heading", "text", "list", "list", "table", "image", "code"]
    assert got[2]["items"] == ["a", "b more"] and got[3]["ordered"] and (got[4]["n_rows"], got[4]["n_cols"]) == (2, 2) and got[5]["title"] == "t" and got[6]["content"] == "y" and got[1]["text"] == "text code"


def test_selectors():
    root = markup.parse('<div class="a b"><p id=x data-k="1">t<br>u</p></div><p>v')
    assert [n.text() for n in root.select("div.a p[data-k=1], p#none")] == ["tu"] and len(list(root.select("p"))) == 2 and root.first("span") is None


def test_arguments():
    assert bounded("n", 3, 1, 5) == 3 and exactly_one(a=None, b=1) == "b"
    for bad in (lambda: bounded("n", 6, 1, 5), lambda: bounded("n", True, 0, 5), lambda: exactly_one(a=1, b=2)):
        with pytest.raises(ValidationError):
            bad()


@pytest.mark.parametrize("seed", range(3))
def test_fuse_top_equals_the_whole_fusion(spark, seed):
    rng = random.Random(seed)
    rows = lambda name: spark.createDataFrame([(i, round(rng.random(), 2)) for i in rng.sample(range(1500), 900)], f"position long, {name} double")
    vectors, words = rows("vector_score"), rows("lexical_score")
    want = retrieve.fuse(vectors, words).where("rank <= 5").orderBy("rank").collect()
    assert retrieve.fuse_top(vectors, words, 5).orderBy("rank").collect() == want
    assert retrieve.fuse_top(None, words, 3).count() == 3

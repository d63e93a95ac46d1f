"""Normalisers, pages, the store, the tools and the stream on small inputs."""

import inspect
import json

import pytest
from pyspark.sql import functions as F

from ragspark.errors import ValidationError
from ragspark.functions import text as T
from ragspark.operators import chunking, listings
from ragspark.plans import tools
from ragspark.sources import records, web
from ragspark.sources.store import Store, canonical, corpus_id
from ragspark.streaming import events


def raw(spark, *answers):
    return spark.createDataFrame([(json.dumps(a),) for a in answers], "raw string")


ANSWERS = {
    "hackernews": {"hits": [{"objectID": "1", "title": "T", "points": 5, "created_at": "2024-01-01T00:00:00Z"}, {"objectID": "2"}, {"objectID": "3", "story_text": "<p>hi</p>"}]},
    "reddit": {"data": {"children": [{"data": {"id": "x", "title": "T", "permalink": "/r/a/1", "created_utc": 1.7e9}}, {"data": {"id": "y"}}]}},
    "stackoverflow": {"items": [{"question_id": 1, "title": "a &amp; b", "body": "<p>" + "z" * 4000 + "</p>", "creation_date": 1, "accepted_answer_id": 3}]},
    "npm": {"objects": [{"package": {"name": "n", "version": "1"}}, {"package": {}}]},
    "pypi": {"info": {"name": "p", "summary": "s", "keywords": "a, b"}},
    "pypi_top": {"rows": [{"project": "p", "download_count": 3}, {"project": "q"}]},
    "news": {"articles": [{"title": "T", "url": "http://www.a.com/x", "seendate": "20240101T000000Z"}, {"title": "no url"}]},
    "patents": {"patents": [{"patent_id": "7", "inventors": [{"inventor_name_first": "A", "inventor_name_last": "B"}]}]},
    "podcasts": {"results": [{"id": "1", "title_original": "T", "pub_date_ms": 1000}]},
    "producthunt": {"data": {"posts": {"edges": [{"node": {"id": "1", "name": "N", "topics": {"edges": [{"node": {"name": "ai"}}]}}}]}}},
    "youtube": {"items": [{"id": {"videoId": "v"}, "snippet": {"title": "T"}}, {"id": {}, "snippet": {"title": "T"}}]},
    "transcript": {"video_id": "v", "segments": [{"text": "a", "offset": 0, "duration": 1}]},
    "semantic_scholar": {"data": [{"paperId": "1", "title": "T", "authors": [{"name": "A B"}], "externalIds": {"DOI": "D"}, "venue": ""}]},
    "github_repo": {"items": [{"full_name": "a/b", "stargazers_count": 3}]},
    "github_tree": {"tree": [{"path": "a/b.py", "mode": "100644", "type": "blob", "size": 3}, {"path": "l", "mode": "120000", "type": "blob"}, {"path": "a", "type": "tree", "mode": "040000"}]},
    "github_code": {"items": [{"path": "p", "text_matches": [{"fragment": "f", "matches": [{"text": "t", "indices": [1, 2]}, {"text": "bad", "indices": [1]}]}]}]},
}
SEARCH = {
    "brave": {"web": {"results": [{"title": "A", "url": "https://www.a.com/x", "age": "1 day ago"}, {"title": "B", "url": "https://b.com/", "deep_results": {"buttons": [{"title": "t", "url": "u"}]}}]}},
    "searxng": {"results": [{"title": "B2", "url": "https://b.com", "engines": ["e1", "e2"], "publishedDate": "2024-01-31"}, {"title": "A2", "url": "https://a.com/x/"}]},
    "exa": {"results": [{"title": "C", "url": "https://c.com", "text": "t"}]},
}


@pytest.mark.parametrize("name", list(ANSWERS))
def test_normalizers(spark, name):
    rows = records.normalize(raw(spark, ANSWERS[name]), name).collect()
    kept = {"hackernews": 2, "github_tree": 3}.get(name, 1)
    assert len(rows) == kept and rows[0].position == 1
    one = rows[0].asDict()
    want = {
        "reddit": ("permalink", "https://www.reddit.com/r/a/1"),
        "stackoverflow": ("title", "a & b"),
        "pypi": ("keywords", ["a", "b"]),
        "news": ("domain", "a.com"),
        "patents": ("inventors", ["A B"]),
        "producthunt": ("topics", ["ai"]),
        "github_tree": ("type", "file"),
        "semantic_scholar": ("venue", None),
    }.get(name)
    assert want is None or one[want[0]] == want[1]
    assert records.normalize(raw(spark, {}, None), name).count() == 0


def test_unknown_source(spark):
    with pytest.raises(ValidationError):
        records.normalize(raw(spark, {}), "odd")


def test_arxiv_and_comments(spark):
    feed = '<feed><entry><id>http://arxiv.org/abs/2401.00001v2</id><title>A\n  B</title><summary>S &amp; T</summary><published>2024-01-02T00:00:00Z</published><author><name>X Y</name></author><category term="cs.AI"/><link title="pdf" href="http://p"/></entry><entry></entry></feed>'
    [r] = records.arxiv(spark.createDataFrame([(feed,)], "raw string")).collect()
    assert (r.id, r.title, r.text, r.year, r.authors, r.categories, r.pdf) == ("2401.00001", "A B", "S & T", 2024, ["X Y"], ["cs.AI"], "http://p")
    c = lambda i, parent, replies="": {"kind": "t1", "data": {"id": i, "parent_id": parent, "body": i, "permalink": f"/{i}", "replies": replies}}
    below = {"data": {"children": [c("b", "t1_a"), {"kind": "more", "data": {"id": "m"}}]}}
    tree = [{"data": {"children": [{"kind": "t3", "data": {"id": "p"}}]}}, {"data": {"children": [c("a", "t3_p", below), c("d", "t3_p")]}}]
    rows = records.comments(spark.createDataFrame([("k", json.dumps(tree)), ("z", "junk")], "thread string, raw string")).orderBy("position").collect()
    assert [(r.thread, r.id, r.parent_id, r.depth) for r in rows] == [("k", "a", "p", 0), ("k", "b", "a", 1), ("k", "d", "p", 0)]


def test_repository_files(spark):
    rows = [("src/a.py", "file", 10), ("docs/a.md", "file", 400_000), ("src/big.py", "file", 200_000), ("node_modules/x.js", "file", 1), ("a.png", "file", 1), ("src", "dir", None)]
    out = records.corpus_files(spark.createDataFrame(rows, "path string, type string, size long")).collect()
    assert [r.path for r in out] == ["src/a.py", "docs/a.md"]
    one = spark.createDataFrame([("a\nb\r\nc",)], "t string")
    assert one.select(records.file_slice(F.col("t"), 2, 1)).collect()[0][0] == "b"


def test_pages_and_sitemaps(spark):
    html = '<head><title>T - S</title><meta name=description content=D><meta property="og:image" content="/i.png"></head><body><nav>menu</nav><article><p>Some real text that is long enough to count.</p><script>x</script></article><time datetime="2024-01-01">'
    [r] = web.read_pages(spark.createDataFrame([(1, "https://a.com/p/", html)], "page_id int, url string, html string")).collect()
    assert (r.title, r.description, r.image, r.published, r.method) == ("T - S", "D", "https://a.com/i.png", "2024-01-01", "article") and r.text == "Some real text that is long enough to count."
    x = spark.createDataFrame([(1, "<urlset><loc>http://a?x&amp;y</loc><loc> http://b </loc><loc>http://a?x&amp;y</loc></urlset>"), (2, "")], "k int, xml string")
    assert [(r.position, r.url) for r in web.sitemap_urls(x, "k").orderBy("position").collect()] == [(1, "http://a?x&y"), (2, "http://b")]
    assert [r[0] for r in x.select(web.is_sitemap_index(F.lit("<sitemapindex >"))).limit(1).collect()] == [True]
    p = spark.createDataFrame([(1, "http://a.com/x", "t1"), (2, "http://a.com/x/", "t2"), (3, "http://a.com/y", "t1"), (4, "http://b.com/", "t4"), (5, "http://a.com/z", "t5")], "page_id int, url string, text string")
    assert [r.page_id for r in web.crawl(p, "http://a.com/z").orderBy("page_id").collect()] == [1, 5]
    assert [r.value for r in web.select_nodes(spark.createDataFrame([(1, html)], "page_id int, html string"), {"t": "article p"}).collect()] == ["Some real text that is long enough to count."]


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    chunks = lambda n: spark.createDataFrame([(i, f"text {i}") for i in range(n)], "position long, text string")
    vectors = lambda n: spark.createDataFrame([(i, [1.0, float(i)]) for i in range(n)], "position long, vector array<float>")
    a, b = corpus_id({"type": "x", "n": None}, "m", 2), corpus_id({"type": "y"}, "m", 2)
    assert a == corpus_id({"type": "x"}, "m", 2) != b and canonical({"b": 1, "a": [None, {"c": None}]}) == '{"a":[null,{}],"b":1}'
    assert s.read(a, 0) is None and s.evict(0) == []
    assert s.write(a, chunks(3), vectors(3), {"type": "x"}, 1000, "m", 2) and s.write(b, chunks(2), vectors(2), {"type": "y"}, 2000, "m", 2)
    assert not s.write("e", chunks(0), vectors(0), {}, 0, "m", 2)
    got = s.read(a, 5000)
    assert got[0].count() == 3 and got[1].count() == 3 and s.read(a, 1000 + 8 * 86_400_000) is None
    assert s.write(a, chunks(4), vectors(4), {"type": "x"}, 3000, "m", 2) and s.read(a, 6000)[0].count() == 4 and s.read(b, 6000)[0].count() == 2
    assert s.write("bad", chunks(2), vectors(1), {}, 1000, "m", 2) and s.read("bad", 2000) is None
    calls = []
    build = lambda: calls.append(1) or (chunks(2), vectors(2))
    first = s.get_or_build({"type": "z"}, "m", 2, 7000, build)
    assert s.get_or_build({"type": "z"}, "m", 2, 8000, build)[0] == first[0] and len(calls) == 1
    gone = s.evict(9000, most=2)
    assert first[0] not in gone and len(gone) == 2 and s.read(gone[0], 9000) is None


def test_web_search(spark):
    parts = {n: raw(spark, a) for n, a in SEARCH.items()}
    out = tools.web_search(parts, "2024-02-01 00:00:00", 10).collect()
    assert [r.domain for r in out] == ["b.com", "a.com", "c.com"] and [r.position for r in out] == [1, 2, 3] and out[1].title == "A2"
    assert tools.web_search(parts | {"brave": None}, "2024-02-01", 1).count() == 1
    with pytest.raises(ValidationError):
        tools.web_search({"brave": None}, "2024-02-01")
    with pytest.raises(ValidationError):
        tools.web_search(parts, "2024-02-01", 51)


def test_academic_and_discussion(spark):
    p = "position int, title string, doi string, authors array<string>, year int, citations long, venue string, text string, url string"
    a = spark.createDataFrame([(1, "Deep Nets", None, ["J. Doe"], 2023, None, None, None, "u1"), (2, "Old", None, ["X"], 1990, None, None, None, "u2")], p)
    b = spark.createDataFrame([(1, "Deep nets!", None, ["Doe, J."], 2023, 10, "V", None, "u3")], p)
    out = tools.academic_search({"arxiv": a, "s2": b}, 2024).collect()
    assert [r.title for r in out] == ["Deep nets!", "Old"] and tools.academic_search({"arxiv": a}, 2024, year_from=2000).count() == 1
    posts = spark.createDataFrame([(0, 1, "http://a", "2024-01-30", 5, 1), (0, 2, "http://b", "2023-01-30", 500, 90), (1, 1, "http://b", "2023-01-30", 500, 90)], "ranking int, position int, url string, created string, score long, num_comments long")
    assert [r.url for r in tools.discussion_search(posts, "2024-02-01").collect()] == ["http://b", "http://a"]
    assert tools.reddit_parameters("cats", None, "relevance", "year") == ("new", "week") and tools.reddit_parameters("cats", "aww", "relevance", "year") == ("relevance", "year")


PAGE = """<html><head><title>Page - Site</title><script type="application/ld+json">{"@graph": [{"@type": "JobPosting", "title": "Data Engineer", "datePosted": "2024-01-30",
"hiringOrganization": {"name": "Acme"}, "jobLocation": [{"address": {"addressLocality": "Sydney", "addressRegion": "NSW"}}], "identifier": {"value": "77"}}]}</script></head>
<body><p>Hybrid role, $90k - $110k + super. Contract via agency. %s</p></body></html>""" % ("Spark and more. " * 20)
PLAIN = '<h1>Office Clerk</h1><div class="company">Beta</div><span class=location>Perth</span><div data-jk="9"></div> onsite work, applications close soon, posted today'


def test_listings_from_pages(spark):
    pages = spark.createDataFrame([(1, "https://www.seek.com.au/job/42", PAGE), (2, "https://jora.com/x", PLAIN), (3, "https://o.com", "<p>nothing</p>")], "page_id int, url string, html string")
    out = {r.page_id: r for r in tools.extract_listings(pages).collect()}
    a, b = out[1], out[2]
    assert set(out) == {1, 2}
    assert (a.title, a.company, a.location, a.work_mode, a.salary_raw, a.posted_raw, a.job_id, a.source) == ("Data Engineer", "Acme", "Sydney NSW", "hybrid", "$90k - $110k", "2024-01-30", "42", "seek")
    assert a.caveats == ["contract", "agency"] and a.verification_status == "listing_page_fetched"
    assert (b.title, b.company, b.location, b.work_mode, b.posted_raw, b.job_id) == ("Office Clerk", "Beta", "Perth", "onsite", "posted today", "9")
    assert b.caveats == ["closing_soon"] and b.verification_status == "search_result_only"
    best = tools.semantic_jobs(pages, "data engineer spark", listings.Constraints(location=("sydney",)), "2024-02-01").collect()
    assert [r.page_id for r in best] == [1] and best[0].matched == ["location: sydney"] and best[0].overall > 0.45
    assert tools.job_query("engineer", listings.Constraints(location=("Perth",))) == "engineer Perth jobs"


def test_semantic_tools(spark):
    pages = spark.createDataFrame([(i, f"http://a.com/{i}", f"# Page {i}\n" + f"The {w} lives in the {w} house and eats {w} food every day of the year. " * 4) for i, w in enumerate(["fox", "bear", "wolf"])], "page_id int, url string, text string")
    rows, counts = tools.semantic_crawl(pages, "bear food", top_k=2)
    assert rows.collect()[0].page_id == 1 and counts["fused"] == 3 and counts["warning"] is None
    videos = spark.createDataFrame([("v1", "Foxes", "Zoo TV"), ("v2", "Bears", "Other")], "video_id string, title string, channel string")
    segs = spark.createDataFrame([(v, i, f"{w} talk number {i}", float(i), 5.0) for v, w in (("v1", "fox"), ("v2", "bear")) for i in range(14)], "video_id string, seg_no int, text string, offset double, duration double")
    rows, _ = tools.semantic_youtube(videos, segs, "bear talk", top_k=2)
    assert rows.collect()[0].video_id == "v2"
    rows, _ = tools.semantic_youtube(videos, segs, "bear talk", channel="zoo", top_k=2)
    assert {r.video_id for r in rows.collect()} == {"v1"}


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "2024-01-01 00:00:00", "a"), (2, "2024-01-01 01:00:00", "a"), (3, "2024-01-02 00:00:00", "b")], "id int, ts string, k string").withColumn("ts", F.to_timestamp_ntz("ts")).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    out = events.run_available(events.counts(read(), "k"), str(tmp_path))
    assert sorted((str(r.start), r.k, r.n) for r in out.collect()) == [("2024-01-01 00:00:00", "a", 2), ("2024-01-02 00:00:00", "b", 1)]
    once = events.run_available(events.first_seen(read(), "k"), str(tmp_path), "append")
    assert sorted(r.k for r in once.collect()) == ["a", "b"]


def test_page_corpus_keeps_every_page(spark):
    """More chunks than the 5000 that were kept once; the numbers follow the order without gaps."""
    pages = spark.range(5200).select(F.col("id").alias("page_id"), F.concat(F.lit("http://a.com/"), "id").alias("url"), F.concat(F.lit("The fox of house "), "id", F.lit(" eats plenty of food on every single day of the year.")).alias("text"))
    rows = tools.page_corpus(pages).select("position", "page_id").collect()
    assert sorted((r.position, r.page_id) for r in rows) == [(i, i) for i in range(5200)]
    with pytest.raises(ValidationError):
        tools.page_corpus(pages, most=5000)


def test_long_pages_are_read_to_the_end(spark):
    """Beyond the 50,000 characters that one answer of a tool may have."""
    html = "<article>" + "".join(f"<p>Sentence number {i} of a long page about nothing much.</p>" for i in range(1500)) + "<p>The last word is zebra.</p></article>"
    read = web.read_pages(spark.createDataFrame([(1, "http://a.com", html)], "page_id int, url string, html string"))
    [r] = read.collect()
    assert len(r.text) > 50_000 and r.text.endswith("The last word is zebra.")
    made = chunking.chunks(read, "page_id", "text").orderBy("chunk_index").collect()
    assert made[-1].content.endswith("The last word is zebra.")
    assert len(web.article(html, 50_000)[0]) == 50_000 + len(T.TRUNCATED)


def test_budgets_are_options_and_are_told(spark):
    c = spark.createDataFrame([("t", str(i), None, "u", f"the {w} eats food", None, i) for i, w in enumerate(["fox", "wolf", "bear"])], "thread string, id string, parent_id string, author string, body string, permalink string, position int")
    rows, counts = tools.semantic_reddit(c, "bear food", budget=35, top_k=1)
    assert counts["truncated"] and counts["dropped"] == 1 and rows.collect()[0].id != "2"
    for tool in (tools.semantic_reddit, tools.semantic_youtube):
        assert inspect.signature(tool).parameters["budget"].default is None
    rows, counts = tools.semantic_reddit(c, "bear food", top_k=1)
    assert rows.collect()[0].id == "2" and "dropped" not in counts

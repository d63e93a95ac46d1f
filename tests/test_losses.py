"""What earlier versions lost: deep pages, pages without unique ids, texts and items beyond a cap, a third sort."""

import json
from datetime import datetime

from ragspark.operators import elements, markup
from ragspark.plans import tools
from ragspark.sources import records, web

DEEP = 100_000


def test_deep_pages(spark):
    html = "<div>" * DEEP + "<p>" + "Words of a paragraph that is long enough. " * 3 + "</p><h2>Below</h2>" + "</div>" * DEEP
    assert web.article(html) == ("Words of a paragraph that is long enough. " * 3 + "Below", "paragraphs")
    assert [e["type"] for e in elements.from_html(html, None)] == ["text", "heading"]
    root = markup.parse("<nav><ul><li>a<b>c</b>d</ul></nav><p>e")
    assert root.text() == "acde" and root.text(frozenset({"b"})) == "ade" and [n.tag for n in root.walk()] == ["nav", "ul", "li", "b", "p"]
    assert root.first("b").inside({"nav"}) and not root.first("p").inside({"nav", "ul"})
    pages = spark.createDataFrame([(1, html), (2, "<p>a<b>c</b>d<i>e</i>f</p>")], "page_id long, html string")
    got = sorted(map(tuple, web.select_xpath(pages, {"p": ".//p", "i": ".//i"}).collect()))
    assert [(k, f, v[:5]) for k, f, _, v in got] == [(1, "p", "Words"), (2, "i", "e"), (2, "p", "acdef")]
    assert web.select_nodes(pages, {"h": "h2"}).collect()[0]["value"] == "Below"
    assert {r.page_id for r in web.read_pages(pages.selectExpr("page_id", "'u' AS url", "html")).collect()} == {1, 2}


def test_pages_without_unique_ids(spark):
    words = lambda w: " ".join(f"{w}{i}" for i in range(60))
    banner = "\n".join(["Accept all cookies", "We use cookies", "Cookie settings", "Accept all cookies"] * 10)
    pages = spark.createDataFrame([(None, "u0", words("a")), (1, "u1", words("b")), (1, "u2", words("c")), (1, "u3", banner), (None, "u4", None)], "page_id long, url string, text string")
    got = {r["url"]: r["text"][:2] for r in tools.page_corpus(pages).collect()}
    assert got == {"u0": "a0", "u1": "b0", "u2": "c0"}
    assert {r["url"] for r in web.text_pages(pages).collect()} == {"u0", "u1", "u2"}


def test_caps_are_parameters(spark):
    segments = [{"text": f"s{i}", "offset": float(i), "duration": 1.0} for i in range(2000)]
    raw = spark.createDataFrame([(json.dumps({"video_id": "v", "segments": segments}),)], "raw string")
    assert records.normalize(raw, "transcript").count() == 1500 and records.normalize(raw, "transcript", whole=True).count() == 2000
    raw = spark.createDataFrame([(json.dumps({"items": [{"question_id": 1, "title": "t", "body": "x" * 9000}]}),)], "raw string")
    assert len(records.normalize(raw, "stackoverflow").collect()[0]["text"]) < 3100 and len(records.normalize(raw, "stackoverflow", whole=True).collect()[0]["text"]) == 9000
    tree = None
    for i in reversed(range(300)):
        data = {"id": f"c{i}", "author": "a", "body": "b", "parent_id": f"t1_c{i - 1}", "replies": tree or ""}
        tree = {"kind": "Listing", "data": {"children": [{"kind": "t1", "data": data}]}}
    raw = spark.createDataFrame([(json.dumps(tree),)], "raw string")
    assert records.comments(raw).count() == 300 and records.comments(raw, most_depth=70).count() == 70
    files = spark.createDataFrame([(f"src/f{i}.py", "file", 10) for i in range(150)], "path string, type string, size long")
    assert records.corpus_files(files).count() == 100 and records.corpus_files(files, most=None).count() == 150
    pages = spark.createDataFrame([(i, f"https://h.test/{i}", f"t{i}") for i in range(130)], "page_id long, url string, text string")
    assert web.crawl(pages, "https://h.test/0").count() == 100 and web.crawl(pages, "https://h.test/0", most=None, budget=None).count() == 130


def test_papers_by_update(spark):
    entry = "<entry><id>http://arxiv.org/abs/{0}</id><title>T{0}</title><published>2020-01-0{0}T00:00:00Z</published>{1}</entry>"
    feed = entry.format(1, "<updated>2023-05-01T00:00:00Z</updated>") + entry.format(2, "") + entry.format(3, "<updated>2021-01-01T00:00:00Z</updated>")
    papers = records.arxiv(spark.createDataFrame([(feed,)], "raw string"))
    assert {r["title"]: r["updated"] for r in papers.collect()}["T2"] == datetime(2020, 1, 2)
    papers = papers.selectExpr("*", "int(substring(title, 2)) AS position")
    assert [r["title"] for r in records.chosen_papers(papers, sort="lastUpdatedDate").collect()] == ["T1", "T3", "T2"]
    assert [r["title"] for r in records.chosen_papers(papers, sort="submittedDate").collect()] == ["T3", "T2", "T1"]


def test_crawl_levels(spark):
    edges = [("a", "b", 1), ("a", "c", 0), ("c", "d", 0), ("d", "a", 0), ("b", "d", 0), ("b", "b", 1), ("d", "e", 3), ("d", "e", 3), (None, "x", 0), ("a", None, 5), ("e", "f", 0)]
    links = spark.createDataFrame([(*e, 1) for e in edges], "url string, target string, position int, way int")
    seeds = spark.createDataFrame([("a", 0), ("a", 4), (None, 1), ("z", 2)], "url string, position int")
    run = lambda **o: [(r["url"], r["depth"]) for r in web.crawl_levels(links, seeds, **o).orderBy("position").collect()]
    assert run(depth=0) == [("a", 0), ("z", 0)]
    assert run(depth=3) == [("a", 0), ("z", 0), ("c", 1), ("b", 1), ("d", 2), ("e", 3)]
    assert run(depth=3, strategy="depth") == [("a", 0), ("c", 1), ("d", 2), ("e", 3), ("b", 1), ("z", 0)]
    assert run(depth=5, most=3) == [("a", 0), ("z", 0), ("c", 1)] and len(run(depth=5)) == 7
    assert web.crawl_levels(links.limit(0), seeds.limit(0)).count() == 0

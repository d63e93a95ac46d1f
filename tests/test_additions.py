"""Markup lists, seeds, repository details, extraction settings, prompts, packed vectors, merged elements."""

import base64
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragspark.errors import ValidationError, extraction
from ragspark.functions import vectors as V
from ragspark.operators import elements, hygiene, markup, retrieve, tables
from ragspark.plans import tools
from ragspark.sources import records, store, web


def test_extraction_settings():
    fields = {"fields": [{"name": "a"}], "baseSelector": "li"}
    for kind in ("css_schema", "xpath_schema"):
        assert extraction({"type": kind, "schema": fields})["type"] == kind
        for bad in ({"baseSelector": " ", "fields": [1]}, {"baseSelector": "li", "fields": []}, {"baseSelector": "li"}):
            with pytest.raises(ValidationError):
                extraction({"type": kind, "schema": bad})
    assert extraction({"type": "regex", "patterns": ["email"]}) and extraction({"type": "regex", "customPatterns": {"a": "b"}})
    for bad in ({"type": "regex"}, {"type": "regex", "patterns": [], "customPatterns": {}}, {"type": "llm"}, {}):
        with pytest.raises(ValidationError):
            extraction(bad)


def test_attribute_selectors():
    root = markup.parse('<a href="/x/stars" class="big-row">1</a><a href="/x/forks">2</a><a>3</a>')
    pick = lambda s: [n.text() for n in root.select(s)]
    assert pick("a[href$=stars]") == ["1"] and pick('a[href^="/x"]') == ["1", "2"] and pick("a[class*=row]") == ["1"] and pick("a[href=/x/forks]") == ["2"] and pick("a[href]") == ["1", "2"]


def test_trending_leaves_out_rows_without_a_name(spark):
    row = '<article class="{}"><h1><a href="{}">r</a></h1><p>d</p><a href="/s/stargazers">1,234</a></article>'
    html = row.format("border", "/good/one/") + row.format("border", "/bad-/x") + row.format("border", "/alone") + row.format("border", "/o/two")
    got = web.trending(spark.createDataFrame([(1, html), (2, None), (3, "<p>none")], "page_id long, html string"))
    assert [(r.page_id, r["rank"], r.owner, r.repo, r.stars, r.forks, r.language) for r in got.orderBy("page_id", "rank").collect()] == [(1, 1, "good", "one", 1234, 0, ""), (1, 2, "o", "two", 1234, 0, "")]


def test_tweets_fall_back_and_cut(spark):
    html = '<div class="post"><b class="display-name">N</b><i class="handle">@n</i><p class="content">' + "x" * 1005 + '</p><time>2h</time><span><u class="likes"></u>3,500</span></div><div class="post"><p class="content"> </p></div>'
    [r] = web.tweets(spark.createDataFrame([(1, html)], "page_id long, html string"), "https://n.test").collect()
    assert (r.author, r.handle, r.timestamp, r.url, r.likes, r.retweets) == ("N", "@n", "2h", "", 3500, 0)
    assert r.content == "x" * 1000 + "... [truncated]"


def test_seed_shares(spark):
    shares = lambda n, most: [r.budget for r in web.seed_budgets(spark.range(n).withColumnRenamed("id", "position"), most).orderBy("position").collect()]
    assert shares(3, 10) == [4, 3, 3] and shares(4, 2) == [1, 1] and shares(1, 7) == [7] and shares(0, 5) == []


def test_seeds_hand_on_what_they_leave(spark):
    def plain(found, most):
        left, out = most, []
        for i, f in enumerate(found):
            if left <= 0:
                break
            share = max(1, math.ceil(left / (len(found) - i)))
            left -= min(f or 0, share)
            if f:
                out.append((i, share, min(f, share)))
        return out

    rng = random.Random(5)
    groups = {g: [rng.choice([None, 0, 0, 1, 2, 5, 40]) for _ in range(rng.randint(1, 60))] for g in (None, "a", "b", "c")}
    rows = [(g, i, f, "x") for g, fs in groups.items() for i, f in enumerate(fs)]
    df = spark.createDataFrame(rows, "g string, position int, pages int, seeds string").repartition(5)
    for most in (1, 7, 30, 500):
        got = web.seed_budgets(df, most, group=("g",), found="pages")
        assert got.columns == ["g", "position", "pages", "seeds", "budget", "kept"]
        for g, fs in groups.items():
            assert sorted((r.position, r.budget, r.kept) for r in got.collect() if r.g == g) == plain(fs, most)
    one = web.seed_budgets(df.where("g = 'a'"), 30, found="pages")
    assert sorted((r.position, r.budget, r.kept) for r in one.collect()) == plain(groups["a"], 30)
    assert web.seed_budgets(df.limit(0), 30, found="pages").count() == 0
    assert web.seed_budgets(df, 0, found="pages").count() == 0


def test_crawls_hand_on_pages(spark):
    pages = [(1, "https://a.test/", "seed a"), (2, "https://b.test/", ""), (3, "https://b.test/u", ""), (4, "https://b.test/v", "v"), (5, "https://b.test/w", "v"), (6, "https://b.test/x", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, text string")
    seeds = spark.createDataFrame([(0, "https://none.test/"), (1, "https://a.test/"), (2, "https://b.test/")], "position long, seed string")
    got = lambda most: sorted((r.page_id, r.seed_position) for r in web.crawl_seeds(df, seeds, most).collect())
    assert got(3) == [(1, 1), (2, 2), (3, 2)]
    assert got(4) == [(1, 1), (2, 2), (3, 2), (4, 2)]
    assert got(9) == [(1, 1), (2, 2), (3, 2), (4, 2), (6, 2)]


def test_pages_of_several_seeds(spark):
    pages = [(1, "https://a.test/docs/", "seed a"), (2, "https://a.test/docs/x", "x"), (3, "https://a.test/docs/y", "y"), (4, "https://a.test/docs/x/deep", "deep"), (5, "https://b.test/", "seed b"), (6, "https://b.test/z", "z"), (7, "https://b.test/x", "x"), (8, "http://localhost/", "no"), (9, "https://c.test/", "c")]
    df = spark.createDataFrame(pages, "page_id long, url string, text string")
    seeds = spark.createDataFrame([(0, "https://a.test/docs/"), (1, "https://b.test/")], "position long, seed string")
    got = lambda most: sorted((r.page_id, r.seed_position) for r in web.crawl_seeds(df, seeds, most).collect())
    assert got(4) == [(1, 0), (2, 0), (5, 1), (6, 1)]
    assert got(100) == [(1, 0), (2, 0), (3, 0), (5, 1), (6, 1)]  # the copy of x goes to the first seed


def test_symlinks(spark):
    tree = [("a", "file"), ("b", "symlink"), ("c", "symlink"), ("loop", "symlink"), ("gone", "symlink"), ("d", "dir")]
    links = [("b", "a"), ("c", "b"), ("loop", "loop"), ("gone", "nowhere")]
    df = records.followed(spark.createDataFrame(tree, "path string, type string"), spark.createDataFrame(links, "path string, target string"))
    assert {r.path: r.real_path for r in df.collect()} == {"a": "a", "b": "a", "c": "a", "loop": None, "gone": None, "d": "d"}
    short = records.followed(spark.createDataFrame(tree, "path string, type string"), spark.createDataFrame(links, "path string, target string"), hops=1)
    assert {r.path: r.real_path for r in short.collect()}["c"] is None


def test_paper_choice(spark):
    df = spark.createDataFrame([(1, ["a"], "2024-01-05 12:00:00"), (2, ["a", "b"], "2024-02-05 00:00:00"), (3, ["b"], None)], "position int, categories array<string>, published string").withColumn("published", F.col("published").cast("timestamp"))
    ids = lambda **o: [r.position for r in records.chosen_papers(df, **o).collect()]
    assert ids() == [1, 2, 3] and ids(category="b") == [2, 3] and ids(date_to="2024-01-05") == [1] and ids(date_from="2024-01-06") == [2] and ids(sort="submittedDate", limit=1) == [2]
    with pytest.raises(ValidationError):
        ids(sort="stars")


def test_ids_of_the_store(spark):
    df = spark.createDataFrame([('{"lang":"en"}',)], "s string")
    assert df.select(store.corpus_key(F.col("s"), "m", 8, size=3)).collect()[0][0] == store.corpus_id({"lang": "en", "x": None}, "m", 8, size=3)


def test_digest_depends_on_order_and_text_only(spark):
    rows = [(i, f"t{i % 7}") for i in range(2500)]
    one = lambda r, n=4: retrieve.content_hash(spark.createDataFrame(r, "p long, t string").repartition(n), "t", "p").collect()[0][0]
    assert one(rows) == one(rows[::-1], 1) != one([*rows[:-1], (2499, "other")])
    assert one([(0, None)]) == one([(0, "")])


def test_prompts_and_packed_vectors(spark):
    df = spark.createDataFrame([("def f", [1.5, -2.0]), ("Import x", None), ("plain words", [])], "t string, v array<float>")
    got = df.select(V.query_prompt(F.col("t")), V.document_prompt(F.col("t")), V.packed(F.col("v")), V.unpacked(V.packed(F.col("v")))).collect()
    assert [r[0].split(" | ")[0] for r in got] == ["task: code retrieval", "task: code retrieval", "task: search result"]
    assert got[0][1] == "title: none | text: def f"
    assert got[0][2] == base64.b64encode(np.array([1.5, -2], "<f4").tobytes()).decode() and got[0][3] == [1.5, -2.0]
    assert got[1][2] is None and got[1][3] is None
    assert df.select(V.unpacked(F.lit("AAA="))).collect()[0][0] is None


def test_merged_elements_count_what_is_cut(spark):
    one = lambda page, i, kind, cut=None: (1, page, i, kind, 1 if kind == "heading" else None, cut)
    rows = [one(1, 0, "text"), one(1, 1, "text", True), one(2, 0, "heading"), one(2, 1, "text", False)]
    df = spark.createDataFrame(rows, "g int, page int, position int, type string, level int, truncated boolean")
    got = elements.merged(df, "page", "g", 2).orderBy("page", "position").collect()
    assert [(r.page, r.position) for r in got] == [(1, 0), (2, 0)] and {r.omitted for r in got} == {2}


def test_search_then_crawl(spark):
    results = spark.createDataFrame([(1, "https://a.test/?utm_source=x"), (2, "http://localhost/"), (3, ""), (4, "https://b.test/")], "position int, url string")
    pages = spark.createDataFrame([(1, "https://b.test"), (2, "https://a.test/"), (3, "https://www.a.test"), (4, "https://c.test")], "page_id long, url string")
    assert [r.page_id for r in tools.search_then_crawl(results, pages).collect()] == [2, 1]
    assert [r.page_id for r in tools.search_then_crawl(results, pages, 1).collect()] == [2]


def test_numbers_by_ranges_follow_any_order(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(100)], "k int, s int").repartition(5)
    got = [(r.s, r.k) for r in tables.numbered(df, F.desc("s"), F.asc("k")).orderBy("position").collect()]
    assert got == sorted(got, key=lambda r: (-r[0], r[1]))


def test_banner_rows(spark):
    df = spark.createDataFrame([(1, "a\n\nWe use cookies to x\nb"), (2, " \n"), (3, None), (4, "privacy\ncookie\naccept tracking\nz")], "k int, t string")
    got = {r.k: (r.lines, r.banner_lines) for r in hygiene.banner_ratio(df, "k", "t").collect()}
    assert got == {1: (3, 1), 4: (4, 3)}

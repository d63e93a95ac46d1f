"""Search strings with qualifiers, and the services' own filters."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ragspark.errors import ValidationError
from ragspark.functions import qualifiers as Q
from ragspark.plans import searches

REPOS = [("a/one", "Fast queue", 5, "Go", ["x"], "2024-01-01"), ("a/two", "slow queue", 50, "Go", None, "2024-02-01"), ("b/three", None, 500, None, ["x", "y"], None), ("b/http", "see http://q now", None, "C", [], "2023-01-01")]


@pytest.fixture(scope="module")
def repos(spark):
    return spark.createDataFrame(REPOS, "name string, description string, stars long, language string, topics array<string>, pushed string").withColumn("pushed", F.col("pushed").cast("date"))


@pytest.mark.parametrize(
    "query, found",
    [
        ("", "b/three a/two a/one b/http"),
        ("QUEUE", "a/two a/one"),
        ('"fast queue"', "a/one"),
        ("queue -fast", "a/two"),
        ("-queue", "b/three b/http"),
        ("stars:>=50", "b/three a/two"),
        ("stars:5..50 language:Go", "a/two a/one"),
        ("stars:*..5", "a/one"),
        ("stars:50..*", "b/three a/two"),
        ("stars:*..*", "b/three a/two a/one"),
        ("stars:50", "a/two"),
        ("-stars:>5", "a/one b/http"),
        ("-language:Go", "b/three b/http"),
        ("pushed:<2024-01-15", "a/one b/http"),
        ("user:b topic:y", "b/three"),
        ("http://q", "b/http"),
        ('"" ', "b/three a/two a/one b/http"),
        ("nothing", ""),
    ],
)
def test_repositories(repos, query, found):
    assert [r.name for r in searches.repositories(repos, query).collect()] == found.split()


def test_values_that_cannot_be_compared(repos):
    for query in ("stars:many", "stars:>", "pushed:yesterday", "stars:1..x"):
        with pytest.raises(ValidationError):
            searches.repositories(repos, query)


def test_qualifiers_reach_the_scan(spark, repos, tmp_path):
    repos.write.parquet(str(tmp_path / "repos"))
    plan = spark.read.parquet(str(tmp_path / "repos")).where(Q.matching("stars:>=10 language:Go pushed:>2024-01-15 queue", Q.contains("name", "description"), {"stars": Q.number("stars"), "language": Q.exact("language"), "pushed": Q.day("pushed")}))
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    pushed = plan._jdf.queryExecution().executedPlan().toString().split("PushedFilters: [")[1].split("ReadSchema")[0]
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    for f in ("GreaterThanOrEqual(stars,10)", "EqualTo(language,Go)", "GreaterThan(pushed,2024-01-15)"):
        assert f in pushed
    assert [r.name for r in plan.collect()] == ["a/two"]


def test_code_query_and_search(spark):
    assert searches.code_query(" class Foo ", "me", "r", "py", "src") == "class Foo repo:me/r language:py path:src"
    assert searches.code_query("x", repo="r") == "x" and searches.code_query("x", "me") == "x user:me"
    files = spark.createDataFrame([("me/r", "src/a.py", "py", "class Foo"), ("me/r", "a.py", "py", "class foo"), ("me/rr", "src/a.py", "py", "class Foo"), ("you/r", "src/a.py", None, None)], "repository string, path string, language string, text string")
    got = lambda q: [(r.repository, r.path) for r in searches.code(files, q).collect()]
    assert got("class Foo repo:me/r path:src") == [("me/r", "src/a.py")]
    assert len(got("user:me")) == 3 and len(got("")) == 4 and got("-class") == [("you/r", "src/a.py")]


def test_stories_and_questions(spark):
    at = lambda d: datetime(2024, 1, d)
    items = spark.createDataFrame([("1", "A tale", None, ["story"], 3, at(1)), ("2", None, "a TALE told", ["comment"], None, at(2)), ("3", "tale", "", None, 9, None)], "id string, title string, text string, tags array<string>, points long, created timestamp")
    got = lambda *a, **o: [r.id for r in searches.stories(items, *a, **o).collect()]
    assert got("tale") == ["1"] and got("tale", "comment") == ["2"] and got("tale", "all") == ["3", "1", "2"] and got("tale", "all", "date") == ["2", "1", "3"]
    assert got("", "all", after=at(1)) == ["2"] and got("", "all", before=at(2)) == ["1"] and got("tale told", "all") == ["2"]
    asked = spark.createDataFrame([("1", "q", None, ["a"], 1, True, at(1), at(9), 5), ("2", "q", "z", ["b", "c"], 7, False, at(2), at(3), 6), ("3", "q", "z", None, None, None, None, None, None)], "id string, title string, text string, tags array<string>, score long, accepted boolean, created timestamp, active timestamp, views long")
    got = lambda *a, **o: [r.id for r in searches.questions(asked, *a, **o).collect()]
    assert got("q") == ["2", "1", "3"] and got("q", "activity") == ["1", "2", "3"] and got("q", "votes", "a;c") == ["2", "1"]
    assert got("q", accepted=True) == ["1"] and got("q", tagged=" ; ") == ["2", "1", "3"] and got("-z") == ["1"]
    for wrong in (lambda: searches.stories(items, "", "job"), lambda: searches.questions(asked, "", "hot"), lambda: searches.stories(items, "", limit=0)):
        with pytest.raises(ValidationError):
            wrong()


def test_patents(spark):
    rows = [("1", "A rotor, and a blade", ["Acme Rotor Works Inc.", None], "2020-01-01"), ("2", "blades", ["Acme"], "2021-01-01"), ("3", "Blade", ["Acmerotor works"], "2022-01-01"), ("4", None, None, None), ("5", "blade", None, "2022-01-01")]
    df = spark.createDataFrame(rows, "id string, text string, assignees array<string>, granted string")
    got = lambda *a: [r.id for r in searches.patents(df, *a).collect()]
    assert got("blade rotor") == ["3", "5", "1"] and got("blade", "acme ROTOR") == ["1"] and got("blades") == ["2"] and got("") == [] and got("blade", "rotor acme") == []

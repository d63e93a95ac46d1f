"""Searches of one service's rows by its own filters, as conditions that the scan can take. Each returns the best
``limit`` rows, ties by key."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.errors import ValidationError, bounded
from ragspark.functions import qualifiers as Q


def _sorted_by(sorts: dict[str, str], sort: str) -> str:
    if sort not in sorts:
        raise ValidationError(f"sort must be one of {', '.join(sorts)}")
    return sorts[sort]


def repositories(repos: DataFrame, query: str, limit: int = 30) -> DataFrame:
    """Of (name, description, stars, ...), most stars first: words in name or description, and qualifiers for the columns
    that there are: stars, forks, issues (numbers), pushed (a date), language, license, user (of the name), topic."""
    known = {c: Q.number(c) for c in ("stars", "forks", "issues")} | {"pushed": Q.day("pushed"), "language": Q.exact("language"), "license": Q.exact("license")}
    known = {k: q for k, q in known.items() if k in repos.columns}
    known["user"] = lambda value: F.col("name").startswith(value + "/")
    if "topics" in repos.columns:
        known["topic"] = Q.member("topics")
    found = repos.where(Q.matching(query, Q.contains("name", "description"), known))
    return found.orderBy(F.desc("stars"), "name").limit(bounded("limit", limit, 1, 1000))


def code_query(query: str, owner: str | None = None, repo: str | None = None, language: str | None = None, path: str | None = None) -> str:
    """The query with its qualifiers: a repository only counts with its owner."""
    scope = f"repo:{owner}/{repo}" if owner and repo else f"user:{owner}" if owner else ""
    parts = [query.strip(), scope, f"language:{language}" if language else "", f"path:{path}" if path else ""]
    return " ".join(p for p in parts if p)


def code(files: DataFrame, query: str, limit: int = 30) -> DataFrame:
    """Of files (repository, path, language, text) in the order of repository and path: words of the text, qualifiers
    repo, user, language and path (a prefix)."""
    known = {"repo": Q.exact("repository"), "user": lambda value: F.col("repository").startswith(value + "/"), "language": Q.exact("language"), "path": Q.prefix("path")}
    return files.where(Q.matching(query, Q.contains("text"), known)).orderBy("repository", "path").limit(bounded("limit", limit, 1, 1000))


def stories(items: DataFrame, query: str, kind: str = "story", sort: str = "relevance", after: datetime | None = None, before: datetime | None = None, limit: int = 20) -> DataFrame:
    """Of normalised items (id, title, text, tags, points, created): stories, comments or all, made between the two
    times (both left out), with every word in title or text; by points (relevance) or the newest first."""
    if kind not in ("story", "comment", "all"):
        raise ValidationError("kind must be story, comment or all")
    by = _sorted_by({"relevance": "points", "date": "created"}, sort)
    found = items.where(Q.matching(query, Q.contains("title", "text"), {}))
    if kind != "all":
        found = found.where(Q.member("tags")(kind))
    if after is not None:
        found = found.where(F.col("created") > F.lit(after))
    if before is not None:
        found = found.where(F.col("created") < F.lit(before))
    return found.orderBy(F.desc_nulls_last(by), "id").limit(min(bounded("limit", limit, 1, 1000), 50))


def questions(items: DataFrame, query: str, sort: str = "relevance", tagged: str = "", accepted: bool = False, limit: int = 20) -> DataFrame:
    """Of normalised questions (id, title, text, tags, score, accepted, created, active, views): those with every word,
    at least one of the tags (``a;b``), and an accepted answer if wanted; by views (relevance), score (votes), creation or
    activity."""
    by = _sorted_by({"relevance": "views", "votes": "score", "creation": "created", "activity": "active"}, sort)
    found = items.where(Q.matching(query, Q.contains("title", "text"), {}))
    tags = [t.strip() for t in tagged.split(";") if t.strip()]
    if tags:
        found = found.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    if accepted:
        found = found.where(F.col("accepted"))
    return found.orderBy(F.desc_nulls_last(by), "id").limit(min(bounded("limit", limit, 1, 1000), 100))


def patents(items: DataFrame, query: str, assignee: str = "", limit: int = 25) -> DataFrame:
    """Of normalised patents (id, text, assignees, granted), the last granted first: any word of the query in the abstract,
    and the words of ``assignee`` in a row in one assignee's name. Words are compared whole and in lower case; a query
    without words finds nothing."""
    words = lambda c: F.filter(F.split(F.lower(c), r"\W+"), lambda w: w != "")
    found = items.where(F.arrays_overlap(words(F.col("text")), words(F.lit(query))))
    if assignee:
        row = lambda c: F.concat(F.lit(" "), F.array_join(words(c), " "), F.lit(" "))
        found = found.where(F.exists("assignees", lambda a: F.contains(row(a), row(F.lit(assignee)))))
    return found.orderBy(F.desc_nulls_last("granted"), "id").limit(bounded("limit", limit, 1, 1000))

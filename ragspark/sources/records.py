"""Normalising projections: raw JSON (or XML) answers of public services, a string column ``raw``, to typed rows.

Each source is a schema for ``from_json``, the array of its items, the output columns, which rows stay, and the text
cap. Nothing is fetched here: raw answers are files or tables that Spark reads, so pruning, pushdown and parallel
parsing are Spark's."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragspark.errors import ValidationError
from ragspark.functions import numbers as N
from ragspark.functions import text as T
from ragspark.functions import urls as U


@dataclass(frozen=True)
class Source:
    schema: str
    items: str
    columns: Callable[[Callable[[Column, int], Column]], dict[str, Column]]  # given what cuts a text at its cap
    keep: str
    most: int | None = None  # items of an answer


def _i(name: str) -> Column:
    return F.col(f"i.{name}")


def _or(*cs: Column) -> Column:
    return F.coalesce(*[F.when(c != "", c) for c in cs])


def _names(path: str, field: str) -> Column:
    return F.array_join(F.transform(_i(path), lambda x: x[field]), ", ")


def _web(title: str, url: str, text: Column, **more: Column) -> dict[str, Column]:
    return {"title": _i(title), "url": _i(url), "domain": U.domain(_i(url)), "description": text, **more}


SOURCES: dict[str, Source] = {
    "brave": Source(
        "web struct<results:array<struct<title:string,url:string,description:string,age:string,page_age:string,extra_snippets:array<string>,deep_results:struct<buttons:array<struct<title:string,url:string>>>>>>",
        "web.results",
        lambda cap: _web("title", "url", _i("description"), age=_or(_i("age"), _i("page_age")), extra_snippet=F.array_join(_i("extra_snippets"), " "), deep_links=_i("deep_results.buttons")),
        "title IS NOT NULL AND url IS NOT NULL",
    ),
    "searxng": Source(
        "results array<struct<title:string,url:string,content:string,publishedDate:string,engines:array<string>>>",
        "results",
        lambda cap: _web("title", "url", _i("content"), age=_i("publishedDate"), extra_snippet=F.concat(F.lit("via "), F.array_join(_i("engines"), ", ")), deep_links=F.array().cast("array<struct<title:string,url:string>>")),
        "title IS NOT NULL AND url IS NOT NULL",
    ),
    "exa": Source(
        "results array<struct<title:string,url:string,text:string,publishedDate:string,score:double>>",
        "results",
        lambda cap: _web("title", "url", _i("text"), age=_i("publishedDate"), extra_snippet=F.lit(None).cast("string"), deep_links=F.array().cast("array<struct<title:string,url:string>>")),
        "url IS NOT NULL",
    ),
    "hackernews": Source(
        "hits array<struct<objectID:string,title:string,story_title:string,url:string,author:string,points:long,num_comments:long,created_at:string,story_text:string,comment_text:string,_tags:array<string>>>",
        "hits",
        lambda cap: {"id": _i("objectID"), "title": _or(_i("title"), _i("story_title")), "url": _i("url"), "author": _i("author"), "points": F.coalesce(_i("points"), F.lit(0)), "num_comments": F.coalesce(_i("num_comments"), F.lit(0)), "created": F.try_to_timestamp(_i("created_at")), "text": cap(T.stripped_html(_or(_i("story_text"), _i("comment_text"))), 2000), "tags": _i("_tags")},
        "title IS NOT NULL OR text IS NOT NULL",
    ),
    "reddit": Source(
        "data struct<children:array<struct<data:struct<id:string,title:string,selftext:string,subreddit:string,author:string,score:long,num_comments:long,created_utc:double,permalink:string,url:string,is_video:boolean>>>>",
        "data.children",
        lambda cap: {"id": _i("data.id"), "title": _i("data.title"), "text": cap(_i("data.selftext"), 2000), "subreddit": _i("data.subreddit"), "author": _i("data.author"), "score": F.coalesce(_i("data.score"), F.lit(0)), "num_comments": F.coalesce(_i("data.num_comments"), F.lit(0)), "created": F.timestamp_seconds(_i("data.created_utc")), "permalink": U.absolute(_i("data.permalink"), "https://www.reddit.com"), "url": _i("data.url"), "is_video": F.coalesce(_i("data.is_video"), F.lit(False))},
        "title <> ''",
    ),
    "stackoverflow": Source(
        "items array<struct<question_id:long,title:string,body:string,link:string,tags:array<string>,score:long,answer_count:long,is_answered:boolean,accepted_answer_id:long,creation_date:long,last_activity_date:long,view_count:long>>",
        "items",
        lambda cap: {"id": _i("question_id").cast("string"), "title": T.decoded(_i("title")), "text": cap(T.stripped_html(_i("body")), 3000), "url": _i("link"), "tags": _i("tags"), "score": _i("score"), "answers": _i("answer_count"), "accepted": _i("accepted_answer_id").isNotNull(), "created": F.timestamp_seconds(_i("creation_date")), "active": F.timestamp_seconds(_i("last_activity_date")), "views": _i("view_count")},
        "title <> ''",
    ),
    "npm": Source(
        "objects array<struct<package:struct<name:string,version:string,description:string,keywords:array<string>,date:string,links:struct<npm:string,repository:string>,publisher:struct<username:string>>,score:struct<final:double>>>",
        "objects",
        lambda cap: {"name": _i("package.name"), "version": _i("package.version"), "description": _i("package.description"), "keywords": _i("package.keywords"), "published": F.try_to_timestamp(_i("package.date")), "url": _or(_i("package.links.npm"), F.concat(F.lit("https://www.npmjs.com/package/"), _i("package.name"))), "repository": _i("package.links.repository"), "publisher": _i("package.publisher.username"), "score": _i("score.final")},
        "name <> ''",
    ),
    "pypi": Source(
        "info struct<name:string,version:string,summary:string,author:string,license:string,home_page:string,package_url:string,requires_python:string,keywords:string>",
        "array(info)",
        lambda cap: {"name": _i("name"), "version": _i("version"), "description": cap(_i("summary"), 500), "author": _i("author"), "license": _i("license"), "url": _or(_i("package_url"), _i("home_page")), "requires_python": _i("requires_python"), "keywords": F.filter(F.transform(F.split(_i("keywords"), ","), lambda k: F.trim(k)), lambda k: k != "")},
        "name <> ''",
    ),
    "pypi_top": Source("rows array<struct<project:string,download_count:long>>", "rows", lambda cap: {"name": _i("project"), "downloads": _i("download_count")}, "name IS NOT NULL AND downloads IS NOT NULL"),
    "news": Source(
        "articles array<struct<title:string,url:string,domain:string,language:string,seendate:string,sourcecountry:string,socialimage:string>>",
        "articles",
        lambda cap: {"title": _i("title"), "url": _i("url"), "domain": _or(_i("domain"), U.domain(_i("url"))), "language": _i("language"), "published": N.compact_timestamp(_i("seendate")), "country": _i("sourcecountry"), "image": _i("socialimage")},
        "title <> '' AND url <> ''",
    ),
    "patents": Source(
        "patents array<struct<patent_id:string,patent_title:string,patent_abstract:string,patent_date:string,assignees:array<struct<assignee_organization:string>>,inventors:array<struct<inventor_name_first:string,inventor_name_last:string>>>>",
        "patents",
        lambda cap: {"id": _i("patent_id"), "title": _i("patent_title"), "text": cap(_i("patent_abstract"), 2000), "granted": F.try_to_date(_i("patent_date")), "assignees": F.array_compact(F.transform(_i("assignees"), lambda a: a["assignee_organization"])), "inventors": F.transform(_i("inventors"), lambda a: F.concat_ws(" ", a["inventor_name_first"], a["inventor_name_last"])), "url": F.concat(F.lit("https://patents.google.com/patent/US"), _i("patent_id"))},
        "id <> ''",
    ),
    "podcasts": Source(
        "results array<struct<id:string,title_original:string,description_original:string,publisher_original:string,audio:string,link:string,pub_date_ms:long,audio_length_sec:long,podcast:struct<title_original:string>>>",
        "results",
        lambda cap: {"id": _i("id"), "title": _i("title_original"), "text": cap(T.stripped_html(_i("description_original")), 1000), "show": _i("podcast.title_original"), "publisher": _i("publisher_original"), "audio": _i("audio"), "url": _i("link"), "published": F.timestamp_millis(_i("pub_date_ms")), "seconds": _i("audio_length_sec")},
        "title <> ''",
    ),
    "producthunt": Source(
        "data struct<posts:struct<edges:array<struct<node:struct<id:string,name:string,tagline:string,description:string,url:string,website:string,votesCount:long,commentsCount:long,createdAt:string,topics:struct<edges:array<struct<node:struct<name:string>>>>>>>>>",
        "data.posts.edges",
        lambda cap: {"id": _i("node.id"), "name": _i("node.name"), "tagline": _i("node.tagline"), "text": cap(_i("node.description"), 500), "url": _i("node.url"), "website": _i("node.website"), "votes": _i("node.votesCount"), "num_comments": _i("node.commentsCount"), "created": F.try_to_timestamp(_i("node.createdAt")), "topics": F.transform(_i("node.topics.edges"), lambda t: t["node"]["name"])},
        "name <> ''",
    ),
    "youtube": Source(
        "items array<struct<id:struct<videoId:string>,snippet:struct<title:string,description:string,channelTitle:string,publishedAt:string>>>",
        "items",
        lambda cap: {"video_id": _i("id.videoId"), "title": T.decoded(_i("snippet.title")), "text": _i("snippet.description"), "channel": _i("snippet.channelTitle"), "published": F.try_to_timestamp(_i("snippet.publishedAt")), "url": F.concat(F.lit("https://www.youtube.com/watch?v="), _i("id.videoId"))},
        "video_id <> '' AND title <> ''",
    ),
    "transcript": Source("video_id string, segments array<struct<text:string,offset:double,duration:double>>", "segments", lambda cap: {"video_id": F.col("j.video_id"), "text": T.decoded(_i("text")), "offset": _i("offset"), "duration": _i("duration")}, "text IS NOT NULL", 1500),
    "semantic_scholar": Source(
        "data array<struct<paperId:string,title:string,abstract:string,year:int,citationCount:long,venue:string,externalIds:struct<DOI:string>,authors:array<struct<name:string>>,url:string>>",
        "data",
        lambda cap: {"id": _i("paperId"), "title": _i("title"), "text": cap(_i("abstract"), 2000), "year": _i("year"), "citations": _i("citationCount"), "venue": F.when(_i("venue") != "", _i("venue")), "doi": _i("externalIds.DOI"), "authors": F.transform(_i("authors"), lambda a: a["name"]), "url": _i("url")},
        "title <> ''",
    ),
    "github_repo": Source(
        "items array<struct<full_name:string,description:string,html_url:string,language:string,stargazers_count:long,forks_count:long,open_issues_count:long,default_branch:string,topics:array<string>,pushed_at:string,license:struct<spdx_id:string>>>",
        "items",
        lambda cap: {"name": _i("full_name"), "description": _i("description"), "url": _i("html_url"), "language": _i("language"), "stars": _i("stargazers_count"), "forks": _i("forks_count"), "issues": _i("open_issues_count"), "branch": _i("default_branch"), "topics": _i("topics"), "pushed": F.try_to_timestamp(_i("pushed_at")), "license": _i("license.spdx_id")},
        "name <> ''",
    ),
    "github_tree": Source(
        "sha string, truncated boolean, tree array<struct<path:string,mode:string,type:string,sha:string,size:long>>",
        "tree",
        lambda cap: {"path": _i("path"), "name": F.substring_index(_i("path"), "/", -1), "type": F.when(_i("mode") == "120000", "symlink").when(_i("type") == "blob", "file").when(_i("type") == "tree", "dir").when(_i("type") == "commit", "submodule").otherwise(_i("type")), "size": _i("size"), "sha": _i("sha")},
        "path <> ''",
    ),
    "github_code": Source(
        "items array<struct<name:string,path:string,html_url:string,repository:struct<full_name:string>,text_matches:array<struct<fragment:string,matches:array<struct<text:string,indices:array<int>>>>>>>",
        "items",
        lambda cap: {"name": _i("name"), "path": _i("path"), "url": _i("html_url"), "repository": _i("repository.full_name"), "fragments": F.transform(F.filter(_i("text_matches"), lambda m: m["fragment"] != ""), lambda m: m["fragment"]), "matches": F.flatten(F.transform(_i("text_matches"), lambda m: F.transform(F.filter(m["matches"], lambda x: F.size(x["indices"]) == 2), lambda x: F.struct(x["text"].alias("text"), x["indices"][0].alias("start"), x["indices"][1].alias("end")))))},
        "path <> ''",
    ),
}


def normalize(raw: DataFrame, source: str, column: str = "raw", limit: int | None = None, whole: bool = False) -> DataFrame:
    """The rows of ``source`` in the answers of ``column``, with their position (from 1) in each answer and the other
    columns of ``raw``. Texts and transcripts are cut at the source's caps, unless they are wanted ``whole``."""
    if source not in SOURCES:
        raise ValidationError(f"source must be one of {', '.join(SOURCES)}")
    s = SOURCES[source]
    others = [F.col(f"`{c}`") for c in raw.columns if c != column]
    parsed = raw.select(*others, F.from_json(column, s.schema).alias("j"))
    items = s.items.replace("array(", "array(j.") if "(" in s.items else f"j.{s.items}"
    if s.most is not None and not whole:
        items = f"slice({items}, 1, {s.most})"
    cap = (lambda c, n: c) if whole else T.truncated
    each = parsed.select(*others, "j", F.posexplode(F.expr(items)).alias("at", "i"))
    out = each.select(*others, (F.col("at") + 1).alias("position"), *[c.alias(n) for n, c in s.columns(cap).items()]).where(s.keep)
    return out if limit is None else out.where(F.col("position") <= limit)


def arxiv(raw: DataFrame, column: str = "raw", most_text: int | None = 2000) -> DataFrame:
    """Entries of Atom feeds, by regular expression: the feed's shape is fixed. An entry that was never updated has its
    day of publication as ``updated``."""
    tag = lambda n: T.collapsed(T.decoded(F.regexp_extract("entry", rf"(?s)<{n}[^>]*>(.*?)</{n}>", 1)))
    entry = F.explode(F.regexp_extract_all(column, F.lit(r"(?s)<entry>(.*?)</entry>"), F.lit(1))).alias("entry")
    df = raw.select(*[F.col(f"`{c}`") for c in raw.columns if c != column], entry)
    return df.select(
        *[F.col(f"`{c}`") for c in df.columns if c != "entry"],
        F.regexp_extract(tag("id"), r"abs/(.+?)(?:v\d+)?$", 1).alias("id"),
        tag("title").alias("title"),
        (tag("summary") if most_text is None else T.truncated(tag("summary"), most_text)).alias("text"),
        F.try_to_timestamp(tag("published")).alias("published"),
        F.coalesce(F.try_to_timestamp(tag("updated")), F.try_to_timestamp(tag("published"))).alias("updated"),
        N.year_of(tag("published")).alias("year"),
        F.regexp_extract_all("entry", F.lit(r"(?s)<author>\s*<name>(.*?)</name>"), F.lit(1)).alias("authors"),
        F.regexp_extract_all("entry", F.lit(r'<category[^>]*term="([^"]*)"'), F.lit(1)).alias("categories"),
        F.nullif(F.regexp_extract("entry", r'<link[^>]*title="pdf"[^>]*href="([^"]*)"', 1), F.lit("")).alias("pdf"),
        tag("arxiv:doi").alias("doi"),
    ).where("title IS NOT NULL")


def comments(raw: DataFrame, column: str = "raw", most_depth: int | None = None) -> DataFrame:
    """Comment trees (listing of listings) as an adjacency list: id, parent_id without its prefix, author, body,
    permalink, depth, position; stubs for more comments are dropped, and levels from ``most_depth`` on if it is given. The nesting has no schema, so one Arrow pass
    walks it."""
    import json

    import pandas as pd

    def nodes(text):
        try:
            top = json.loads(text or "null")
        except ValueError:
            return
        stack = [(c, 0) for part in reversed(top if isinstance(top, list) else [top]) for c in reversed(((part or {}).get("data") or {}).get("children") or [])]
        at = 0
        while stack:
            node, depth = stack.pop()
            data = node.get("data") or {}
            if node.get("kind") == "t1":
                link = data.get("permalink")
                yield data.get("id"), (data.get("parent_id") or "")[3:] or None, data.get("author"), data.get("body") or "", link and (link if link.startswith("http") else f"https://www.reddit.com{link}"), depth, at
                at += 1
                below = data.get("replies")
                if isinstance(below, dict) and (most_depth is None or depth + 1 < most_depth):
                    stack += [(c, depth + 1) for c in reversed((below.get("data") or {}).get("children") or [])]

    keep = [c for c in raw.columns if c != column]

    def run(batches):
        for b in batches:
            rows = [(*(b[k].iloc[i] for k in keep), *n) for i, t in enumerate(b[column]) for n in nodes(t)]
            yield pd.DataFrame(rows, columns=[*keep, "id", "parent_id", "author", "body", "permalink", "depth", "position"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in raw.schema.fields if f.name != column)
    return raw.mapInPandas(run, kinds + "id string, parent_id string, author string, body string, permalink string, depth int, position int")


#: Files of a repository that make a corpus (fixed values).
EXTENSIONS = [".md", ".mdx", ".rst", ".txt", ".py", ".ts", ".js", ".go", ".rs", ".java"]
DOC_EXTENSIONS = [".md", ".mdx", ".rst", ".txt"]
EXCLUDED_DIRS = ["node_modules", "dist", "build", "__pycache__", ".git", "vendor", "target", "out", "coverage", ".next", ".nuxt", ".cache", "bin", "obj", "__snapshots__", ".venv", "venv"]
CORE_DIRS = ["src", "lib", "app", "core", "internal", "pkg", "cmd", "server", "client", "cli", "packages"]
SURFACE_DIRS = ["examples", "example", "demo", "demos", "sample", "samples", "test", "tests", "spec", "specs", "fixture", "fixtures", "doc", "docs", "playground", "benchmark", "benchmarks"]


def is_corpus_file(path: Column, kind: Column, size: Column, extensions: list[str] | None = None) -> Column:
    """A file of a wanted type outside the excluded directories, up to 500 kB for documents and 100 kB for code."""
    parts, ext = F.split(path, "/"), F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    most = F.when(ext.isin(DOC_EXTENSIONS), 500_000).otherwise(100_000)
    return (kind == "file") & ~F.arrays_overlap(parts, F.array(*map(F.lit, EXCLUDED_DIRS))) & ext.isin(extensions or EXTENSIONS) & (F.coalesce(size, F.lit(0)) <= most)


def file_priority(path: Column) -> Column:
    """25 for each core directory, -25 for each surface directory, -2 a level, and a little for length."""
    parts = F.split(F.lower(path), "/")
    count = lambda names: F.size(F.filter(parts, lambda p: p.isin(names)))
    return 25.0 * (count(CORE_DIRS) - count(SURFACE_DIRS)) - 2.0 * F.size(parts) - F.length(path) / 1000.0


def corpus_files(tree: DataFrame, most: int | None = 100, extensions: list[str] | None = None) -> DataFrame:
    """The best ``most`` files of a tree (path, type, size), all of them for None."""
    kept = tree.where(is_corpus_file(F.col("path"), F.col("type"), F.col("size"), extensions))
    ranked = kept.orderBy(F.desc(F.round(file_priority(F.col("path")), 6)), "path")
    return ranked if most is None else ranked.limit(most)


def file_slice(content: Column, offset: int = 1, limit: int | None = None, unit: str = "lines") -> Column:
    """Lines (from 1) or bytes (from 0) of a text."""
    if unit == "bytes":
        return F.substring(F.encode(content, "utf-8"), offset + 1, limit if limit is not None else 2**31 - 1)
    lines = F.split(content, "\r\n|\n|\r")
    return F.array_join(F.slice(lines, offset, limit if limit is not None else 2**31 - 1), "\n")


def is_binary(content: Column, path: Column) -> Column:
    return F.contains(content, F.lit(b"\x00")) | F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin("png", "jpg", "jpeg", "gif", "webp", "ico", "pdf", "zip", "gz", "tar", "jar", "class", "exe", "dll", "so", "woff", "woff2", "ttf", "mp3", "mp4", "wasm")


#: Languages by the last part of a file's name (fixed values).
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "py": "python", "rb": "ruby", "go": "go", "rs": "rust", "java": "java", "kt": "kotlin",
    "swift": "swift", "cs": "csharp", "c": "c", "cpp": "cpp", "h": "c", "hpp": "cpp", "css": "css", "scss": "scss", "html": "html", "xml": "xml", "json": "json", "yaml": "yaml",
    "yml": "yaml", "md": "markdown", "sql": "sql", "sh": "bash", "bash": "bash", "zsh": "bash", "dockerfile": "dockerfile",
}


def language_of(path: Column) -> Column:
    """By what follows the last dot (the whole name without one), text for the others."""
    known = F.create_map(*[F.lit(x) for p in LANGUAGES.items() for x in p])
    return F.coalesce(known[F.lower(F.substring_index(path, ".", -1))], F.lit("text"))


def file_body(content: Column) -> Column:
    """The bytes of a base64 body, which may be broken into lines; null if it is none."""
    return F.try_to_binary(F.regexp_replace(content, r"\s", ""), F.lit("base64"))


def followed(tree: DataFrame, links: DataFrame, hops: int = 5, group: tuple[str, ...] = ()) -> DataFrame:
    """``tree`` (path, type, ...) with ``real_path``: where a symlink leads, by up to ``hops`` of ``links`` (path, target,
    both from the root); null where a link is broken, too long or goes in a circle."""
    at = tree.withColumn("real_path", F.col("path"))
    step = links.select(*group, F.col("path").alias("real_path"), F.col("target").alias("_to"))
    for _ in range(hops):
        at = at.join(step, [*group, "real_path"], "left").withColumn("real_path", F.coalesce("_to", "real_path")).drop("_to")
    ends = tree.where("type <> 'symlink'").select(*group, F.col("path").alias("real_path"), F.lit(True).alias("_ok"))
    return at.join(ends, [*group, "real_path"], "left").withColumn("real_path", F.when(F.col("_ok"), F.col("real_path"))).drop("_ok")


def repository_details(repos: DataFrame, releases: DataFrame, readmes: DataFrame) -> DataFrame:
    """Repositories (name, ...) with their latest release (name, tag, published) and README (name, content in base64)."""
    latest = releases.groupBy("name").agg(F.max_by(F.struct("tag", "published"), F.struct("published", "tag")).alias("release"))
    text = readmes.select("name", F.decode(file_body(F.col("content")), "utf-8").alias("readme"))
    return repos.join(latest, "name", "left").join(text, "name", "left")


def chosen_papers(papers: DataFrame, category: str | None = None, date_from: str | None = None, date_to: str | None = None, sort: str = "relevance", limit: int = 20) -> DataFrame:
    """arXiv papers of a category and a range of days (both ends in), by relevance (position), submission or update."""
    if sort not in ("relevance", "submittedDate", "lastUpdatedDate"):
        raise ValidationError("sort must be one of relevance, submittedDate, lastUpdatedDate")
    if category is not None:
        papers = papers.where(F.array_contains("categories", category))
    if date_from is not None:
        papers = papers.where(F.to_date("published") >= F.lit(date_from).cast("date"))
    if date_to is not None:
        papers = papers.where(F.to_date("published") <= F.lit(date_to).cast("date"))
    order = {"relevance": ["position"], "submittedDate": [F.desc("published"), "position"], "lastUpdatedDate": [F.desc("updated"), "position"]}[sort]
    return papers.orderBy(*order).limit(limit)


def without_known(candidates: DataFrame, known: DataFrame, name: str = "name") -> DataFrame:
    """The candidate names, and their forms with hyphens and underscores, that are not among the known ones."""
    plain = F.lower(F.trim(F.col(name)))
    forms = F.array_distinct(F.array(plain, F.regexp_replace(plain, r"[\s_]+", "-"), F.regexp_replace(plain, r"[\s-]+", "_")))
    each = candidates.select(F.explode(forms).alias(name)).where(F.col(name) != "").distinct()
    return each.join(known.select(F.lower(name).alias(name)), name, "left_anti")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Files of one JSON answer each, as (path, raw)."""
    return spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("path"), F.col("value").alias("raw"))

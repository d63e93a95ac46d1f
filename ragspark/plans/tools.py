"""The tools: each composes scans, chunking, retrieval and ranking into one plan. Scans are tables or raw answers; the
callbacks (scorers, embedders, builders) take their place where a tool has an extension point."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ragspark.errors import ValidationError, bounded
from ragspark.functions import numbers as N
from ragspark.functions import text as T
from ragspark.functions import urls as U
from ragspark.operators import chunking, fusion, hygiene, lexical, listings, markup, retrieve, threads
from ragspark.operators.dedup import dedup_papers, keep_first, prefix_budget
from ragspark.operators.tables import numbered, saved
from ragspark.sources import records, web

WEB_WEIGHTS = {"rrfAnchor": 0.6, "recency": 0.25, "hasDeepLinks": 0.15}
ACADEMIC_WEIGHTS = {"rrfAnchor": 0.5, "recency": 0.2, "citation_signal": 0.2, "venue_signal": 0.1}
DISCUSSION_WEIGHTS = {"rrfAnchor": 0.5, "recency": 0.2, "engagement": 0.2, "commentEngagement": 0.1}


def _union(parts: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """The lists that there are, numbered in order; none is an error."""
    out = None
    for number, (name, df) in enumerate((n, d) for n, d in parts.items() if d is not None):
        one = df.select(F.lit(number).alias("ranking"), "position", F.lit(name).alias("origin"), *columns)
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValidationError("no source gave an answer")
    return out


def _best(scored: DataFrame, limit: int, *ties: str) -> DataFrame:
    order = [F.desc("combined_score"), *ties]
    return scored.orderBy(*order).limit(limit).withColumn("position", F.row_number().over(Window.orderBy(*order)))


def web_search(parts: dict[str, DataFrame], as_of: str, limit: int = 10, weights: dict[str, float] | None = None) -> DataFrame:
    """Backends' raw answers by backend name (None for one that failed), fused and rescored."""
    return web_results({n: records.normalize(d, n) for n, d in parts.items() if d is not None}, as_of, limit, weights)


def web_results(rows: dict[str, DataFrame], as_of: str, limit: int = 10, weights: dict[str, float] | None = None) -> DataFrame:
    """Backends' results (title, url, position, ...), fused by URL and rescored by recency and deep links."""
    bounded("limit", limit, 1, 50)
    flat = _union({n: d.withColumn("deep_links", F.transform("deep_links", lambda x: x["url"])) for n, d in rows.items()}, ["title", "url", "domain", "description", "age", "extra_snippet", "deep_links"])
    fused = fusion.rrf(flat.withColumn("key", U.normalized(F.col("url"))))
    items = fusion.web_signals(fused.select("rrf_score", "first_ranking", "first_rank", "payload.*").drop("position", "ranking"), as_of)
    return _best(fusion.rescore(items, weights or WEB_WEIGHTS, ["recency", "hasDeepLinks"]), limit, "first_ranking", "first_rank")


def academic_search(parts: dict[str, DataFrame], year_now: int, limit: int = 20, year_from: int | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """Papers (title, doi, authors, year, citations, venue, text, url, position) of several sources, fused by DOI or
    title and surname, and rescored by recency, citations and venue."""
    bounded("limit", limit, 1, 50)
    columns = ["title", "doi", "authors", "year", "citations", "venue", "text", "url"]
    rows = _union(parts, columns)
    if year_from is not None:
        rows = rows.where(F.col("year") >= bounded("year_from", year_from, 1900, 2100))
    key = U.normalized(F.col("url"))
    rows = rows.withColumn("key", F.when(key != "", key).otherwise(T.normalized_title(F.col("title")))).withColumn("identity", T.paper_identity(F.col("doi"), F.col("title"), F.get("authors", F.lit(0))))
    fused = fusion.rrf(rows, identity="identity").select("rrf_score", "first_ranking", "first_rank", "payload.*").drop("position", "ranking")
    items = fusion.academic_signals(fused, year_now)
    return _best(fusion.rescore(items, weights or ACADEMIC_WEIGHTS, ["recency", "citation_signal", "venue_signal"]), limit, "first_ranking", "first_rank")


def by_citations(papers: DataFrame, limit: int) -> DataFrame:
    """One source alone: once by title, most cited first, unknown last."""
    return dedup_papers(papers).orderBy(F.desc_nulls_last("citations"), "position").limit(limit)


def discussion_search(posts: DataFrame, as_of: str, sort: str = "relevance", limit: int = 25, points: str = "score", weights: dict[str, float] | None = None) -> DataFrame:
    """Posts of one or two lists (ranking, position, url, created, points, num_comments); signals are those of the
    merged list."""
    bounded("limit", limit, 1, 100)
    fused = fusion.rrf(posts.withColumn("key", U.normalized(F.col("url")))).select("rrf_score", "first_ranking", "first_rank", "payload.*").drop("position", "ranking")
    items = fusion.discussion_signals(fused, as_of, sort, "created", points, "num_comments")
    return _best(fusion.rescore(items, weights or DISCUSSION_WEIGHTS, [s for s in ("recency", "engagement", "commentEngagement") if s in items.columns]), limit, "first_ranking", "first_rank")


def reddit_parameters(query: str, subreddit: str | None, sort: str, timeframe: str) -> tuple[str, str]:
    """A broad query over everything is asked for the newest of the week."""
    broad = subreddit is None and len(query.split()) <= 1
    return ("new", "week") if broad and sort == "relevance" and timeframe == "year" else (sort, timeframe)


def package_search(packages: DataFrame, query: str, limit: int = 20) -> DataFrame:
    scored = packages.withColumn("score", fusion.name_score(F.col("name"), F.col("downloads"), query)).where("score IS NOT NULL")
    return scored.orderBy(F.desc(F.round("score", 6)), F.desc("downloads"), "name").limit(bounded("limit", limit, 1, 50))


def repository_search(repos: DataFrame, text: str = "", language: str | None = None, least_stars: int | None = None, limit: int = 30) -> DataFrame:
    """Qualifiers as filters, so they reach the scan."""
    df = repos
    for w in text.lower().split():
        df = df.where(F.lower(F.concat_ws(" ", "name", "description")).contains(w))
    if language is not None:
        df = df.where(F.col("language") == language)
    if least_stars is not None:
        df = df.where(F.col("stars") >= least_stars)
    return df.orderBy(F.desc("stars"), "name").limit(bounded("limit", limit, 1, 1000))


def page_corpus(pages: DataFrame, key: str = "page_id", url: str = "url", text: str = "text", most: int | None = None) -> DataFrame:
    """Chunks of the pages with text, equal texts once, numbered: the chunk dedup goes before anything that costs per
    chunk, which the optimiser would not do by itself. Every row is a page of its own, also without a key or with one
    that others have. More than ``most`` chunks are an error."""
    row = "_row"
    own = saved(web.text_pages(pages.select(key, url, text), key, text).withColumn(row, F.monotonically_increasing_id()), "pages")
    made = chunking.chunks(own, row, text).join(own.select(row, key, F.col(url).alias("url")), row)
    once = keep_first(made, F.sha2("content", 256), key, "chunk_index", row)
    out = numbered(once, key, "chunk_index", row).withColumnRenamed("content", "text").drop(row)
    if most is not None and (n := out.count()) > most:
        raise ValidationError(f"{n} chunks, and at most {most} are allowed")
    return out


def semantic_search(
    chunks: DataFrame,
    query: str,
    top_k: int = 10,
    embedder: Callable[[Column], Column] = retrieve.hashed_embedding,
    scorer: Callable[[Column], Column] | None = None,
    pools: bool = False,
    profile: str = "balanced",
) -> tuple[DataFrame, dict]:
    """Hybrid retrieval over chunks (position, text, ...): fuse, annotate, drop incoherent borderline chunks, apply
    the soft lexical constraint, then rerank or cut. Returns the rows and what happened."""
    bounded("top_k", top_k, 1, 50)
    spark = chunks.sparkSession
    own = retrieve.profile(profile)
    # Chunks come numbered, so their table is written already; vectors are kept as 32-bit floats, as models give them.
    vectors = saved(chunks.select("position", embedder(F.col("text")).cast("array<float>").alias("vector")), "vectors")
    mine = spark.createDataFrame([(query,)], "text string").select(embedder(F.col("text")).alias("v")).collect()[0]["v"]
    words = retrieve.word_list(chunks, spark.createDataFrame([(0, query)], "query_id int, text string"))
    limits = {"pool_vectors": max(3 * top_k, 30), "pool_words": top_k} if pools else {}
    fused = saved(retrieve.fuse(retrieve.vector_list(vectors, mine), words, rrf_k=own.rrf_k, **limits), "fused")
    scored = retrieve.score_stats(fused, "vector_score", "lexical_score", "fused_score").join(chunks, "position").join(vectors, "position")
    near = retrieve.coherent(scored, hygiene.is_borderline(hygiene.line_stats(F.col("text"))))
    kept, warned = lexical.soft_constraint(near, chunks, query)
    counts = retrieve.trace(fused).collect()[0].asDict() | {"warning": "no chunk has enough of the query's rare words" if warned else None}
    kept = kept.drop("vector")
    if scorer is not None and kept.count() > top_k:
        return retrieve.rerank(kept, scorer, top_k).orderBy("rerank_rank"), counts
    return kept.orderBy("rank").limit(top_k), counts


def search_then_crawl(results: DataFrame, pages: DataFrame, most_seeds: int = 10, most_pages: int = 50) -> DataFrame:
    """The pages of a crawl table that the best safe results (position, url) of a search lead to, each page once."""
    seeds = results.where((F.col("url") != "") & U.is_safe(F.col("url"))).orderBy("position").limit(bounded("most_seeds", most_seeds, 1, 50))
    first = seeds.groupBy(U.normalized(F.col("url")).alias("_key")).agg(F.min("position").alias("seed_position"))
    met = pages.withColumn("_key", U.normalized(F.col("url"))).join(first, "_key").drop("_key")
    return keep_first(met, U.normalized(F.col("url")), "page_id").orderBy("seed_position").limit(bounded("most_pages", most_pages, 1, 1000))


def status_counts(listings_: DataFrame) -> DataFrame:
    """One row: listings found, fetched, only in search results, of aggregators, to be checked by hand, without pay."""
    is_ = lambda s: F.count_if(F.col("verification_status") == s)
    return listings_.agg(
        F.count("*").alias("listings"), is_("listing_page_fetched").alias("fetched"), is_("search_result_only").alias("search_only"),
        is_("aggregator_result").alias("aggregator"), is_("needs_manual_check").alias("manual"), F.count_if(F.col("salary_raw").isNull()).alias("without_pay"),
    )


def semantic_crawl(pages: DataFrame, query: str, **options) -> tuple[DataFrame, dict]:
    """Pages (page_id, url, text) to the best chunks."""
    chunks = page_corpus(pages)
    if chunks.isEmpty():
        return chunks.limit(0), {"vector": 0, "lexical": 0, "fused": 0, "warning": "no content"}
    return semantic_search(chunks, query, **options)


def _search_within(made: DataFrame, query: str, budget: int | None, *order: str, options: dict) -> tuple[DataFrame, dict]:
    """The search over all rows, or over those in order that fit the budget, with the number of the others."""
    if budget is None:
        return semantic_search(numbered(made, *order), query, **options)
    kept = numbered(prefix_budget(made, F.octet_length("text"), budget, *order).drop("used"), *order)
    dropped = made.count() - kept.count()
    rows, counts = semantic_search(kept, query, **options)
    return rows, counts | {"truncated": dropped > 0, "dropped": dropped}


def semantic_youtube(videos: DataFrame, segments: DataFrame, query: str, channel: str | None = None, budget: int | None = None, **options) -> tuple[DataFrame, dict]:
    """Videos (video_id, title, channel) and transcript segments to the best passages; with a ``budget``, of the first
    so many bytes, and how many were dropped."""
    if channel is not None:
        videos = videos.where(F.lower("channel").contains(channel.lower()))
    made = threads.transcript_chunks(segments.join(videos.select("video_id"), "video_id", "left_semi")).join(videos.select("video_id", F.coalesce("title", "video_id").alias("section")), "video_id")
    made = made.withColumn("url", F.concat(F.lit("https://www.youtube.com/watch?v="), "video_id"))
    return _search_within(made, query, budget, "video_id", "chunk_index", options=options)


def semantic_reddit(comments: DataFrame, query: str, budget: int | None = None, depth: int = 2, **options) -> tuple[DataFrame, dict]:
    """Comments (thread, id, parent_id, author, body, permalink, position) to the best, with their ancestors; with a
    ``budget``, of the first so many bytes, and how many were dropped."""
    made = threads.with_parents(comments, depth, "https://www.reddit.com", ("thread",))
    return _search_within(made, query, budget, "thread", "position", options=options)


# --- job listings ----------------------------------------------------------------------------------------------------

#: Pay, in the order in which patterns are tried; caveats, post dates, work modes and field selectors (fixed values).
SALARY = [
    r"\$\d+(?:,\d{3})*(?:\.\d+)?\s*[–-]\s*\$?\d+(?:,\d{3})*(?:\.\d+)?\s*/\s*hr",
    r"\$\d+(?:,\d{3})*(?:\.\d+)?\s*[–-]\s*\$?\d+(?:,\d{3})*(?:\.\d+)?\s*a\s*year",
    r"\$\d+(?:\.\d+)?k\s*[–-]\s*\$?\d+(?:\.\d+)?k",
    r"\$\d+(?:\.\d+)?k\s*\+\s*super",
]
CAVEATS = [("contract", r"\bcontract\b"), ("temp", r"\btemp(orary)?\b"), ("casual", r"\bcasual\b"), ("agency", r"\bvia agency\b|\brecruitment agency\b"), ("closing_soon", r"\bclosing soon\b|\bapplications close\b")]
POSTED = [r"posted\s+\d+\s+days?\s+ago", r"\d+\s+days?\s+ago", r"posted\s+today", r"posted\s+yesterday"]
MODES = [("hybrid", r"\bhybrid\b"), ("remote", r"\bremote\b"), ("onsite", r"\bonsite\b|\bon[- ]site\b|\bin[- ]office\b|\bin the office\b")]
FIELDS = {"company": [".company", "[data-company]", ".hiringOrganization", ".companyName"], "location": [".location", "[data-location]", ".jobsearch-JobInfoHeader-item"]}


def _postings(root: markup.Node):
    """JobPosting objects of the page's JSON-LD, in lists and graphs too."""

    def walk(v):
        if isinstance(v, list):
            for x in v:
                yield from walk(x)
        elif isinstance(v, dict):
            if isinstance(v.get("@type"), str) and v["@type"].lower() == "jobposting":
                yield v
            if isinstance(v.get("@graph"), list):
                yield from walk(v["@graph"])

    for s in root.select("script[type=application/ld+json]"):
        try:
            yield from walk(json.loads(s.text().strip()))
        except ValueError:
            continue


def _str(v) -> str | None:
    return markup.collapsed(v) if isinstance(v, str) else None


def _place(v) -> str | None:
    if isinstance(v, list):
        return next(filter(None, map(_place, v)), None)
    address = v.get("address") if isinstance(v, dict) else None
    if not isinstance(address, dict):
        return None
    parts = [p for p in (_str(address.get("addressLocality")), _str(address.get("addressRegion"))) if p]
    return " ".join(parts) or _str(address.get("streetAddress"))


def page_listings(html: str | None) -> list[dict]:
    """What the page's markup says: title, company, location, posted date and id for each listing, and its text."""
    root = markup.parse(html)
    text = markup.collapsed(root.text(frozenset({"script", "style", "noscript"}))) or ""
    pick = lambda ways: next((t for s in ways if (n := root.first(s)) and (t := markup.collapsed(n.text()))), None)
    found = list(_postings(root))
    lead = found[0] if found else {}
    heading, title = root.first("h1"), root.first("title")
    head = markup.collapsed(heading.text() if heading else None) or site_free(markup.collapsed(title.text() if title else None))
    attr = lambda a: (n := root.first(f"[{a}]")) and markup.collapsed(n.attrs.get(a))
    out = []
    for p in found or [{}]:
        org = lambda x: _str(x["hiringOrganization"].get("name")) if isinstance(x.get("hiringOrganization"), dict) else None
        ident = lead.get("identifier")
        ident = _str(ident) or (_str(ident.get("value")) or _str(ident.get("@value")) if isinstance(ident, dict) else None)
        made = {
            "title": _str(p.get("title")) or _str(lead.get("title")) or head,
            "company": org(p) or org(lead) or pick(FIELDS["company"]),
            "location": _place(p.get("jobLocation")) or _place(lead.get("jobLocation")) or pick(FIELDS["location"]),
            "posted": _str(p.get("datePosted")) or _str(lead.get("datePosted")),
            "page_job_id": attr("data-job-id") or attr("data-jk") or ident,
            "extracted_text": text,
        }
        if made["title"]:
            out.append(made)
    return out


def site_free(title: str | None) -> str | None:
    for mark in T.SITE_SEPARATORS:
        if title and title.rfind(mark) > 0:
            return title[: title.rfind(mark)].strip()
    return title


def extract_listings(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Listings of pages: the markup in one Arrow pass, everything that is in the text by expressions."""

    def run(batches):
        for b in batches:
            rows = [{key: k, "source_url": u, "n": i, **x} for k, u, h in zip(b[key], b[url], b[html], strict=True) for i, x in enumerate(page_listings(h))]
            yield pd.DataFrame(rows, columns=[key, "source_url", "n", "title", "company", "location", "posted", "page_job_id", "extracted_text"])

    kind = pages.schema[key].dataType.simpleString()
    df = pages.select(key, url, html).mapInPandas(run, f"{key} {kind}, source_url string, n int, title string, company string, location string, posted string, page_job_id string, extracted_text string")
    text = F.col("extracted_text")
    first = lambda ways: F.coalesce(*[T.collapsed(F.regexp_extract(text, f"(?i)({w})", 1)) for w in ways])
    mode = F.lit("unknown")
    for name, pattern in reversed(MODES):
        mode = F.when(text.rlike(f"(?i){pattern}"), name).otherwise(mode)
    jk = F.nullif(F.regexp_extract("source_url", r"[?&]jk=([^&#]+)", 1), F.lit(""))
    df = df.withColumns(
        {
            "source": U.job_source(F.col("source_url")),
            "work_mode": mode,
            "salary_raw": first(SALARY),
            "posted_raw": F.coalesce("posted", first(POSTED)),
            "job_id": F.coalesce(U.job_id(F.col("source_url")), "page_job_id", jk),
            "caveats": F.array_compact(F.array(*[F.when(text.rlike(f"(?i){p}"), F.lit(c)) for c, p in CAVEATS])),
        }
    )
    df = listings.confidence(df)
    status = F.when((F.col("source") == "jora") & text.rlike("(?i)aggregator|copied from|republished"), "aggregator_result").when(F.length(text) < 200, "search_result_only").when(F.col("confidence.overall") < 0.3, "needs_manual_check").otherwise("listing_page_fetched")
    return numbered(df.withColumn("verification_status", status).drop("posted", "page_job_id"), key, "n").drop("n")


def listing_text() -> Column:
    return F.concat_ws("\n\n", *[F.when(T.trimmed(F.col(c)) != "", F.col(c)) for c in ("title", "company", "location", "work_mode", "salary_raw", "extracted_text")])


def job_query(query: str, c: listings.Constraints) -> str:
    """The search text with the wanted places and modes, and the word jobs unless it is there."""
    words = [query, *c.location, *c.work_mode]
    return " ".join(words + ([] if re.search(r"\bjobs?\b", query, re.I) else ["jobs"]))


def semantic_jobs(pages: DataFrame, query: str, c: listings.Constraints, as_of: str, top_k: int = 10, embedder: Callable[[Column], Column] = retrieve.hashed_embedding) -> DataFrame:
    """Pages to listings: extract, dedup, filter, score by hybrid retrieval, rank by the composite."""
    bounded("top_k", top_k, 1, 50)
    spark = pages.sparkSession
    found = listings.dedup(extract_listings(pages)).where(listings.passes(c)).withColumn("text", listing_text())
    words = lexical.bm25(found, spark.createDataFrame([(0, query)], "query_id int, text string"), "position").select("position", F.col("score").alias("lexical_score"))
    mine = spark.createDataFrame([(query,)], "text string").select(embedder(F.col("text")).alias("v")).collect()[0]["v"]
    vectors = retrieve.vector_list(found.select("position", embedder(F.col("text")).alias("vector")), mine)
    own = retrieve.fuse(vectors, words).where(F.col("rank") <= top_k).join(found.select("position", "source_url"), "position")
    scores = own.select(F.coalesce("source_url", F.col("position").cast("string")).alias("key"), F.col("fused_score").alias("score"))
    ranked = listings.rank(listings.with_semantic(found.drop("text"), scores), c, as_of)
    return ranked.orderBy(F.desc("overall"), "position").limit(top_k).withColumn("overall", F.round("overall", 3))


def best_age(df: DataFrame, as_of: str) -> DataFrame:
    """Adds age_days of the ``age`` text."""
    return df.withColumn("age_days", N.age_days(F.col("age"), as_of))

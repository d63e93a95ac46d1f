"""Queries of the sources, the composed searches, the store and the listings: raw answers are built from the driver's
tables, taken apart by the library, and compared with what SQL makes of the tables directly."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ragspark.functions import text as T
from ragspark.functions import urls as U
from ragspark.functions import vectors as V
from ragspark.operators import chunking, dedup, elements, fusion, hygiene, listings, retrieve, threads
from ragspark.operators.tables import dealt, folder
from ragspark.plans import searches, tools
from ragspark.plans.catalogue import AS_OF, BM25, LISTING, ONE, QUERIES, QUESTION, SQL, STATS, comments, listing_rows, query, table
from ragspark.sources import records, store, web

MICROS = 1_000_000


# --- raw answers -------------------------------------------------------------------------------------------------------


def _source(name: str, raw: str, columns: list[str], sql: str, of: str = "part") -> None:
    """A query that builds the JSON ``raw`` from a table's row and normalises it, and its SQL."""

    def run(spark, sf):
        rows = table(spark, sf, of)
        key = rows.columns[0]
        return records.normalize(rows.select(key, F.expr(f"to_json({raw})").alias("raw")), name).selectExpr(key, "position", *columns)

    QUERIES[f"source_{name}"], SQL[f"source_{name}"] = run, sql


_source(
    "brave",
    "named_struct('web', named_struct('results', transform(array(true, false), ok -> named_struct('title', IF(ok, p_name, CAST(NULL AS STRING)), 'url', concat('https://www.k', p_partkey, '.example.com/a'), 'description', p_type, 'age', IF(p_partkey % 2 = 0, '3 days ago', CAST(NULL AS STRING)), 'page_age', '2024-01-01', 'extra_snippets', array(p_brand, 'x'), 'deep_results', named_struct('buttons', array(named_struct('title', 't', 'url', p_brand)))))))",
    ["title", "url", "domain", "description", "age", "extra_snippet", "deep_links[0].url AS link"],
    "SELECT p_partkey, 1 AS position, p_name AS title, 'https://www.k' || p_partkey || '.example.com/a' AS url, 'k' || p_partkey || '.example.com' AS domain, p_type AS description, CASE WHEN p_partkey % 2 = 0 THEN '3 days ago' ELSE '2024-01-01' END AS age, p_brand || ' x' AS extra_snippet, p_brand AS link FROM part",
)
_source(
    "searxng",
    "named_struct('results', transform(array(false, true), ok -> named_struct('title', p_name, 'url', IF(ok, concat('http://', p_size, '.org:80/'), CAST(NULL AS STRING)), 'content', p_type, 'publishedDate', '2024-01-05', 'engines', array('one', p_brand))))",
    ["title", "url", "domain", "description", "age", "extra_snippet", "size(deep_links) AS links"],
    "SELECT p_partkey, 2 AS position, p_name AS title, 'http://' || p_size || '.org:80/' AS url, p_size || '.org' AS domain, p_type AS description, '2024-01-05' AS age, 'via one, ' || p_brand AS extra_snippet, 0 AS links FROM part",
)
_source(
    "exa",
    "named_struct('results', array(named_struct('title', IF(p_partkey % 3 = 0, CAST(NULL AS STRING), p_name), 'url', IF(p_partkey % 5 = 0, CAST(NULL AS STRING), 'https://e.test/'), 'text', p_type, 'publishedDate', '2024', 'score', 0.5)))",
    ["title", "domain", "description", "age"],
    "SELECT p_partkey, 1 AS position, CASE WHEN p_partkey % 3 <> 0 THEN p_name END AS title, 'e.test' AS domain, p_type AS description, '2024' AS age FROM part WHERE p_partkey % 5 <> 0",
)
_source(
    "hackernews",
    "named_struct('hits', array(named_struct('objectID', CAST(p_partkey AS STRING), 'title', IF(p_partkey % 2 = 0, p_name, ''), 'story_title', p_brand, 'author', 'a', 'points', IF(p_partkey % 3 = 0, CAST(NULL AS INT), p_size), 'num_comments', p_size, 'created_at', '2024-01-02T03:04:05Z', 'story_text', concat('<p>', p_type, ' &amp; <b>more</b></p>'), 'comment_text', 'no')))",
    ["id", "title", "author", "points", "num_comments", "unix_seconds(created) AS created", "text"],
    "SELECT p_partkey, 1 AS position, p_partkey::VARCHAR AS id, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_brand END AS title, 'a' AS author, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_size END AS points, p_size AS num_comments, 1704164645 AS created, p_type || ' & more' AS text FROM part",
)
_source(
    "reddit",
    "named_struct('data', named_struct('children', array(named_struct('data', named_struct('id', concat('r', p_partkey), 'title', IF(p_partkey % 7 = 0, '', p_name), 'selftext', repeat(p_type, 200), 'subreddit', p_brand, 'author', 'me', 'score', p_size, 'created_utc', 1704164645.0, 'permalink', concat('/r/', p_partkey), 'url', 'https://i.test', 'is_video', p_size > 25)))))",
    ["id", "title", "md5(text) AS h", "subreddit", "author", "score", "num_comments", "unix_seconds(created) AS created", "permalink", "url", "CAST(is_video AS INT) AS video"],
    "SELECT p_partkey, 1 AS position, 'r' || p_partkey AS id, p_name AS title, md5(CASE WHEN length(repeat(p_type, 200)) > 2000 THEN substr(repeat(p_type, 200), 1, 2000) || '... [truncated]' ELSE repeat(p_type, 200) END) AS h, p_brand AS subreddit, 'me' AS author, p_size AS score, 0 AS num_comments, 1704164645 AS created, 'https://www.reddit.com/r/' || p_partkey AS permalink, 'https://i.test' AS url, (p_size > 25)::INT AS video FROM part WHERE p_partkey % 7 <> 0",
)
_source(
    "stackoverflow",
    "named_struct('items', array(named_struct('question_id', p_partkey, 'title', concat(p_name, ' &lt; &amp;'), 'body', concat('<pre>', p_type, '</pre><script>x</script>'), 'link', 'https://so.test/1', 'tags', array('t', p_brand), 'score', -p_size, 'answer_count', p_size, 'accepted_answer_id', IF(p_size > 10, 5, CAST(NULL AS INT)), 'creation_date', 1704164645, 'view_count', 7)))",
    ["id", "title", "text", "url", "array_join(tags, ' ') AS tags", "score", "answers", "CAST(accepted AS INT) AS accepted", "unix_seconds(created) AS created", "views"],
    "SELECT p_partkey, 1 AS position, p_partkey::VARCHAR AS id, p_name || ' < &' AS title, p_type AS text, 'https://so.test/1' AS url, 't ' || p_brand AS tags, -p_size AS score, p_size AS answers, (p_size > 10)::INT AS accepted, 1704164645 AS created, 7 AS views FROM part",
)
_source(
    "npm",
    "named_struct('objects', array(named_struct('package', named_struct('name', p_name, 'version', '1.0', 'description', p_type, 'keywords', array('k', p_brand), 'date', '2024-01-02T03:04:05.000Z', 'links', named_struct('npm', IF(p_size > 25, 'https://n.test', CAST(NULL AS STRING)), 'repository', 'git'), 'publisher', named_struct('username', 'u')), 'score', named_struct('final', p_size / 100))))",
    ["name", "version", "description", "array_join(keywords, ' ') AS keywords", "unix_seconds(published) AS published", "url", "repository", "publisher", "score"],
    "SELECT p_partkey, 1 AS position, p_name AS name, '1.0' AS version, p_type AS description, 'k ' || p_brand AS keywords, 1704164645 AS published, CASE WHEN p_size > 25 THEN 'https://n.test' ELSE 'https://www.npmjs.com/package/' || p_name END AS url, 'git' AS repository, 'u' AS publisher, p_size / 100.0::DOUBLE AS score FROM part",
)
_source(
    "pypi",
    "named_struct('info', named_struct('name', p_name, 'version', '2', 'summary', repeat(p_type, 60), 'author', 'a', 'license', 'MIT', 'home_page', 'https://h.test', 'package_url', IF(p_size > 25, '', 'https://p.test'), 'requires_python', '>=3', 'keywords', concat(p_brand, ', , b')))",
    ["name", "version", "md5(description) AS h", "author", "license", "url", "requires_python", "array_join(keywords, '|') AS keywords"],
    "SELECT p_partkey, 1 AS position, p_name AS name, '2' AS version, md5(CASE WHEN length(repeat(p_type, 60)) > 500 THEN substr(repeat(p_type, 60), 1, 500) || '... [truncated]' ELSE repeat(p_type, 60) END) AS h, 'a' AS author, 'MIT' AS license, CASE WHEN p_size > 25 THEN 'https://h.test' ELSE 'https://p.test' END AS url, '>=3' AS requires_python, p_brand || '|b' AS keywords FROM part",
)
_source(
    "pypi_top",
    "named_struct('rows', array(named_struct('project', p_name, 'download_count', p_partkey), named_struct('project', CAST(NULL AS STRING), 'download_count', 1), named_struct('project', p_brand, 'download_count', IF(p_size > 25, 3, CAST(NULL AS INT)))))",
    ["name", "downloads"],
    "SELECT p_partkey, 1 AS position, p_name AS name, p_partkey AS downloads FROM part UNION ALL SELECT p_partkey, 3, p_brand, 3 FROM part WHERE p_size > 25",
)
_source(
    "news",
    "named_struct('articles', transform(array(true, false), ok -> named_struct('title', IF(ok, p_name, ''), 'url', 'https://www.News.test/a', 'domain', IF(p_size > 25, '', 'd'), 'language', 'English', 'seendate', '20240102T030405Z', 'sourcecountry', 'X', 'socialimage', '')))",
    ["title", "url", "domain", "language", "unix_seconds(published) AS published", "country", "image"],
    "SELECT p_partkey, 1 AS position, p_name AS title, 'https://www.News.test/a' AS url, CASE WHEN p_size > 25 THEN 'news.test' ELSE 'd' END AS domain, 'English' AS language, 1704164645 AS published, 'X' AS country, '' AS image FROM part",
)
_source(
    "patents",
    "named_struct('patents', array(named_struct('patent_id', CAST(p_partkey AS STRING), 'patent_title', p_name, 'patent_abstract', p_type, 'patent_date', '2024-02-03', 'assignees', array(named_struct('assignee_organization', p_brand), named_struct('assignee_organization', CAST(NULL AS STRING))), 'inventors', array(named_struct('inventor_name_first', 'A', 'inventor_name_last', p_brand)))))",
    ["id", "title", "text", "date_format(granted, 'yyyy-MM-dd') AS granted", "array_join(assignees, '|') AS assignees", "array_join(inventors, '|') AS inventors", "url"],
    "SELECT p_partkey, 1 AS position, p_partkey::VARCHAR AS id, p_name AS title, p_type AS text, '2024-02-03' AS granted, p_brand AS assignees, 'A ' || p_brand AS inventors, 'https://patents.google.com/patent/US' || p_partkey AS url FROM part",
)
_source(
    "podcasts",
    "named_struct('results', array(named_struct('id', CAST(p_partkey AS STRING), 'title_original', IF(p_partkey % 4 = 0, '', p_name), 'description_original', concat('<i>', p_type, '</i>&nbsp;'), 'publisher_original', p_brand, 'audio', 'm', 'link', 'l', 'pub_date_ms', 1704164645000, 'audio_length_sec', p_size, 'podcast', named_struct('title_original', 'show'))))",
    ["id", "title", "text", "show", "publisher", "audio", "url", "unix_seconds(published) AS published", "seconds"],
    "SELECT p_partkey, 1 AS position, p_partkey::VARCHAR AS id, p_name AS title, p_type AS text, 'show' AS show, p_brand AS publisher, 'm' AS audio, 'l' AS url, 1704164645 AS published, p_size AS seconds FROM part WHERE p_partkey % 4 <> 0",
)
_source(
    "producthunt",
    "named_struct('data', named_struct('posts', named_struct('edges', array(named_struct('node', named_struct('id', CAST(p_partkey AS STRING), 'name', p_name, 'tagline', 'tag', 'description', p_type, 'url', 'u', 'website', 'w', 'votesCount', p_size, 'commentsCount', 2, 'createdAt', '2024-01-02T03:04:05Z', 'topics', named_struct('edges', array(named_struct('node', named_struct('name', p_brand)), named_struct('node', named_struct('name', 'z'))))))))))",
    ["id", "name", "tagline", "text", "url", "website", "votes", "num_comments", "unix_seconds(created) AS created", "array_join(topics, '|') AS topics"],
    "SELECT p_partkey, 1 AS position, p_partkey::VARCHAR AS id, p_name AS name, 'tag' AS tagline, p_type AS text, 'u' AS url, 'w' AS website, p_size AS votes, 2 AS num_comments, 1704164645 AS created, p_brand || '|z' AS topics FROM part",
)
_source(
    "youtube",
    "named_struct('items', transform(array(true, false), ok -> named_struct('id', named_struct('videoId', IF(ok, concat('v', p_partkey), '')), 'snippet', named_struct('title', concat(p_name, ' &#39;s'), 'description', p_type, 'channelTitle', p_brand, 'publishedAt', '2024-01-02T03:04:05Z'))))",
    ["video_id", "title", "text", "channel", "unix_seconds(published) AS published", "url"],
    "SELECT p_partkey, 1 AS position, 'v' || p_partkey AS video_id, p_name || ' ''s' AS title, p_type AS text, p_brand AS channel, 1704164645 AS published, 'https://www.youtube.com/watch?v=v' || p_partkey AS url FROM part",
)
_source(
    "transcript",
    "named_struct('video_id', concat('v', p_partkey), 'segments', transform(sequence(1, 3), i -> named_struct('text', IF(i = 2, CAST(NULL AS STRING), concat(p_name, ' &gt; ', i)), 'offset', i * 2.5, 'duration', 2.5)))",
    ["video_id", "text", "offset", "duration"],
    "SELECT p_partkey, i AS position, 'v' || p_partkey AS video_id, p_name || ' > ' || i AS text, i * 2.5::DOUBLE AS \"offset\", 2.5::DOUBLE AS duration FROM part, (VALUES (1), (3)) t(i)",
)
_source(
    "semantic_scholar",
    "named_struct('data', array(named_struct('paperId', CAST(p_partkey AS STRING), 'title', p_name, 'abstract', IF(p_size > 25, CAST(NULL AS STRING), p_type), 'year', 2000 + p_size, 'citationCount', IF(p_size > 40, CAST(NULL AS INT), p_size), 'venue', IF(p_size % 2 = 0, '', p_brand), 'externalIds', named_struct('DOI', concat('10.1/', p_partkey)), 'authors', array(named_struct('name', 'A B')), 'url', 'u')))",
    ["id", "title", "text", "year", "citations", "venue", "doi", "authors[0] AS author", "url"],
    "SELECT p_partkey, 1 AS position, p_partkey::VARCHAR AS id, p_name AS title, CASE WHEN p_size <= 25 THEN p_type END AS text, 2000 + p_size AS year, CASE WHEN p_size <= 40 THEN p_size END AS citations, CASE WHEN p_size % 2 <> 0 THEN p_brand END AS venue, '10.1/' || p_partkey AS doi, 'A B' AS author, 'u' AS url FROM part",
)
_source(
    "github_repo",
    "named_struct('items', array(named_struct('full_name', concat('o/', p_partkey), 'description', p_name, 'html_url', 'h', 'language', p_brand, 'stargazers_count', p_size, 'forks_count', 1, 'open_issues_count', 2, 'default_branch', 'main', 'topics', array('a', 'b'), 'pushed_at', '2024-01-02T03:04:05Z', 'license', named_struct('spdx_id', 'MIT'))))",
    ["name", "description", "url", "language", "stars", "forks", "issues", "branch", "array_join(topics, '|') AS topics", "unix_seconds(pushed) AS pushed", "license"],
    "SELECT p_partkey, 1 AS position, 'o/' || p_partkey AS name, p_name AS description, 'h' AS url, p_brand AS language, p_size AS stars, 1 AS forks, 2 AS issues, 'main' AS branch, 'a|b' AS topics, 1704164645 AS pushed, 'MIT' AS license FROM part",
)
_source(
    "github_tree",
    "named_struct('sha', 's', 'truncated', false, 'tree', array(named_struct('path', concat('src/', p_name, '.py'), 'mode', IF(p_partkey % 5 = 0, '120000', '100644'), 'type', element_at(array('blob', 'tree', 'commit'), CAST(p_partkey % 3 + 1 AS INT)), 'sha', p_brand, 'size', p_size)))",
    ["path", "name", "type", "size", "sha"],
    "SELECT p_partkey, 1 AS position, 'src/' || p_name || '.py' AS path, p_name || '.py' AS name, CASE WHEN p_partkey % 5 = 0 THEN 'symlink' ELSE ['file', 'dir', 'submodule'][(p_partkey % 3 + 1)::INT] END AS type, p_size AS size, p_brand AS sha FROM part",
)
_source(
    "github_code",
    "named_struct('items', array(named_struct('name', p_name, 'path', concat('a/', p_name), 'html_url', 'h', 'repository', named_struct('full_name', 'o/r'), 'text_matches', array(named_struct('fragment', p_type, 'matches', array(named_struct('text', 'x', 'indices', array(p_size, p_size + 1)), named_struct('text', 'y', 'indices', array(1)))), named_struct('fragment', '', 'matches', array())))))",
    ["name", "path", "url", "repository", "array_join(fragments, '|') AS fragments", "size(matches) AS n", "matches[0].text AS text", "matches[0].start AS start", "matches[0].end AS stop"],
    "SELECT p_partkey, 1 AS position, p_name AS name, 'a/' || p_name AS path, 'h' AS url, 'o/r' AS repository, p_type AS fragments, 1 AS n, 'x' AS text, p_size AS start, p_size + 1 AS stop FROM part",
)


def papers_of(spark, sf) -> DataFrame:
    """Atom feeds with two entries each, one without a title."""
    p = table(spark, sf, "part")
    entry = "concat('<feed><entry><id>http://arxiv.org/abs/24', p_partkey, '.1v2</id><title>', p_name, '\\n &amp; co</title><summary> ', p_type, ' </summary><published>20', lpad(p_size % 24, 2, '0'), '-01-05T00:00:00Z</published><author><name>Ann ', p_brand, '</name></author><category term=\"cs.', p_size % 3, '\"/><link title=\"pdf\" href=\"http://pdf/', p_partkey, '\"/></entry><entry><id>x</id></entry></feed>')"
    return records.arxiv(p.select("p_partkey", F.col("p_partkey").alias("position"), F.expr(entry).alias("raw")))


@query("SELECT p_partkey, '24' || p_partkey || '.1' AS id, p_name || ' & co' AS title, p_type AS text, 2000 + p_size % 24 AS year, 'Ann ' || p_brand AS author, 'cs.' || p_size % 3 AS category, 'http://pdf/' || p_partkey AS pdf FROM part")
def source_arxiv(spark, sf):
    return papers_of(spark, sf).select("p_partkey", "id", "title", "text", "year", F.col("authors")[0].alias("author"), F.col("categories")[0].alias("category"), "pdf")


@query("SELECT p_partkey, 2000 + p_size % 24 AS year FROM part WHERE p_size % 3 = 1 AND p_size % 24 BETWEEN 5 AND 20 ORDER BY year DESC, p_partkey LIMIT 20")
def arxiv_filtered(spark, sf):
    """A category, a range of days, the newest first."""
    return records.chosen_papers(papers_of(spark, sf), "cs.1", "2005-01-01", "2020-12-31", "submittedDate").select("p_partkey", "year")


@query("SELECT p_partkey, 'a' || p_partkey AS id, 'p' AS parent_id, 'x' AS author, p_name AS body, 'https://www.reddit.com/1' AS permalink, 0 AS depth, 0 AS position FROM part UNION ALL SELECT p_partkey, 'b' || p_partkey, 'a' || p_partkey, 'y', p_brand, 'https://z', 1, 1 FROM part UNION ALL SELECT p_partkey, 'c', 'p', NULL, '', NULL, 0, 2 FROM part")
def source_comments(spark, sf):
    """A post, a comment with a reply, a stub for more, and a bare comment."""
    inner = "named_struct('kind', 't1', 'data', named_struct('id', concat('b', p_partkey), 'parent_id', concat('t1_a', p_partkey), 'author', 'y', 'body', p_brand, 'permalink', 'https://z', 'replies', ''))"
    outer = f"named_struct('kind', 't1', 'data', named_struct('id', concat('a', p_partkey), 'parent_id', 't3_p', 'author', 'x', 'body', p_name, 'permalink', '/1', 'replies', named_struct('data', named_struct('children', array({inner})))))"
    raw = f"concat('[{{\"data\":{{\"children\":[{{\"kind\":\"t3\",\"data\":{{\"id\":\"p\"}}}}]}}}},{{\"data\":{{\"children\":[', to_json({outer}), ',{{\"kind\":\"more\",\"data\":{{}}}},{{\"kind\":\"t1\",\"data\":{{\"id\":\"c\",\"parent_id\":\"t3_p\"}}}}]}}}}]')"
    return records.comments(table(spark, sf, "part").select("p_partkey", F.expr(raw).alias("raw")))


# --- crawls by level ---------------------------------------------------------------------------------------------------


def _graph(spark, sf):
    """A page per part that links to three others, and two seeds."""
    p = table(spark, sf, "part")
    n = p.agg(F.count("*").alias("n"))
    site = lambda k: f"concat('https://site.test/', {k})"
    to = ["(3 * p_partkey + 1) % n", "(5 * p_partkey + 2) % n", "p_partkey - 1"]
    links = p.crossJoin(F.broadcast(n)).select(F.expr(site("p_partkey")).alias("url"), F.posexplode(F.expr(f"array({', '.join(map(site, to))})")).alias("position", "target"))
    return links, p.where("p_partkey IN (7, 11)").select(F.expr(site("p_partkey")).alias("url"), F.col("p_partkey").alias("position"))


def _ways(order: str) -> str:
    return f"""WITH RECURSIVE l AS (SELECT p_partkey AS k, unnest([(3 * p_partkey + 1) % n, (5 * p_partkey + 2) % n, p_partkey - 1]) AS t, unnest([0, 1, 2]) AS i FROM part, (SELECT count(*) AS n FROM part)),
    w AS (SELECT p_partkey AS k, [p_partkey] AS way FROM part WHERE p_partkey IN (7, 11) UNION ALL SELECT t, list_append(way, i) FROM w JOIN l USING (k) WHERE len(way) <= 5),
    b AS (SELECT k, min(len(way)) - 1 AS depth, min(way) FILTER (WHERE len(way) = short) AS way FROM (SELECT *, min(len(way)) OVER (PARTITION BY k) AS short FROM w) GROUP BY k)
    SELECT * FROM (SELECT 'https://site.test/' || k AS url, depth, row_number() OVER (ORDER BY {order}) - 1 AS position FROM b) WHERE position < 200"""


@query(_ways("depth, way"))
def crawl_breadth(spark, sf):
    return web.crawl_levels(*_graph(spark, sf), depth=5, most=200)


@query(_ways("way"))
def crawl_depth(spark, sf):
    return web.crawl_levels(*_graph(spark, sf), depth=5, strategy="depth", most=200)


# --- pages -------------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, 1 AS position, 'https://a.test/' || p_partkey AS url FROM part UNION ALL SELECT p_partkey, 2, 'https://a.test/?b=1&c=2' FROM part")
def sitemap_locations(spark, sf):
    xml = F.expr("concat('<urlset><url><loc> https://a.test/', p_partkey, '</loc></url><URL><LOC>https://a.test/?b=1&amp;c=2</LOC></URL><url><loc></loc></url><url><loc>https://a.test/', p_partkey, '</loc></url></urlset>')")
    return web.sitemap_urls(table(spark, sf, "part").select("p_partkey", xml.alias("xml")), "p_partkey")


ARTICLE = "concat('<article class=\"Box-row\"><h2><a href=\"/o', p_partkey % 50, '/r-', p_partkey, '\">x</a></h2><p> ', p_type, ' </p><span itemprop=\"programmingLanguage\">', p_brand, '</span><a href=\"/x/stargazers\">1,', lpad(p_size, 3, '0'), '</a><a href=\"/x/forks\">', p_size, '</a><span class=\"d-inline-block float-sm-right\">', p_size, ' stars today</span></article>')"


@query("SELECT p_partkey, 1 AS rank, 'o' || p_partkey % 50 AS owner, 'r-' || p_partkey AS repo, 'https://github.com/o' || p_partkey % 50 || '/r-' || p_partkey AS url, p_type AS description, p_brand AS language, 1000 + p_size AS stars, p_size AS forks, p_size AS today FROM part")
def trending_repositories(spark, sf):
    html = F.concat(F.lit('<html><article class="Box-row"><h2><a href="/only">x</a></h2></article>'), F.expr(ARTICLE))
    return web.trending(table(spark, sf, "part").select("p_partkey", html.alias("html")), "p_partkey")


@query("SELECT p_partkey, 0 AS position, p_brand AS author, '@h' AS handle, p_name AS content, 'https://n.test/h/1' AS url, 'Jan 1' AS timestamp, 1200 AS likes, p_size AS retweets, 0 AS replies FROM part")
def timeline_posts(spark, sf):
    html = F.expr("concat('<div class=\"timeline-item\"><a class=\"tweet-link\" href=\"/h/1\"></a><a class=\"fullname\">', p_brand, '</a><a class=\"username\">@h</a><span class=\"tweet-date\"><a href=\"/d\" title=\"Jan 1\">1h</a></span><div class=\"tweet-content\"> ', p_name, ' </div><span><i class=\"icon-heart\"></i> 1.2K</span><span><i class=\"icon-retweet\"></i> ', p_size, '</span><span><i class=\"icon-comment\"></i></span></div><div class=\"timeline-item\"></div>')")
    return web.tweets(dealt(table(spark, sf, "part")).select("p_partkey", html.alias("html")), "https://n.test", "p_partkey")


NODES = "concat('<div id=\"a\"><ul class=\"l\"><li>', p_name, '<li data-x=\"y\"> ', p_brand, ' ', p_type, '</ul></div>')"
NODES_SQL = "SELECT p_partkey, 'items' AS field, 0 AS position, p_name AS value FROM part UNION ALL SELECT p_partkey, 'items', 1, p_brand || ' ' || p_type FROM part UNION ALL SELECT p_partkey, 'marked', 0, p_brand || ' ' || p_type FROM part"


@query(NODES_SQL)
def css_nodes(spark, sf):
    return web.select_nodes(table(spark, sf, "part").select("p_partkey", F.expr(NODES).alias("html")), {"items": "#a ul.l li", "marked": "li[data-x^=y]"}, "p_partkey")


@query(NODES_SQL)
def xpath_nodes(spark, sf):
    return web.select_xpath(table(spark, sf, "part").select("p_partkey", F.expr(NODES).alias("html")), {"items": ".//div[@id='a']/ul/li", "marked": ".//li[@data-x='y']"}, "p_partkey")


MARKDOWN = "concat('# ', p_name, '\\n\\nsome `code` text\\n- one\\n- ', p_brand, '\\n\\n1. first\\n\\n| a | b |\\n|---|---|\\n| ', p_size, ' | 2 |\\n\\n```py\\nx = ', p_size, '\\n```\\n![alt](http://i.test/', p_partkey, ')')"


@query(
    """SELECT p_partkey, position, type, level, text, items, language, n_rows, src FROM (SELECT p_partkey, unnest([
{'position': 0, 'type': 'heading', 'level': 1, 'text': p_name, 'items': NULL, 'language': NULL, 'n_rows': NULL, 'src': NULL},
{'position': 1, 'type': 'text', 'level': NULL, 'text': 'some code text', 'items': NULL, 'language': NULL, 'n_rows': NULL, 'src': NULL},
{'position': 2, 'type': 'list', 'level': NULL, 'text': NULL, 'items': 'one|' || p_brand, 'language': NULL, 'n_rows': NULL, 'src': NULL},
{'position': 3, 'type': 'list', 'level': NULL, 'text': NULL, 'items': 'first', 'language': NULL, 'n_rows': NULL, 'src': NULL},
{'position': 4, 'type': 'table', 'level': NULL, 'text': NULL, 'items': NULL, 'language': NULL, 'n_rows': 2, 'src': NULL},
{'position': 5, 'type': 'code', 'level': NULL, 'text': NULL, 'items': NULL, 'language': 'py', 'n_rows': NULL, 'src': NULL},
{'position': 6, 'type': 'image', 'level': NULL, 'text': NULL, 'items': NULL, 'language': NULL, 'n_rows': NULL, 'src': 'http://i.test/' || p_partkey}], recursive := true) FROM part)"""
)
def markdown_elements(spark, sf):
    out = elements.extract(table(spark, sf, "part").select("p_partkey", F.expr(MARKDOWN).alias("text")), "p_partkey", "text", "markdown")
    return out.select("p_partkey", "position", "type", "level", "text", F.array_join("items", "|").alias("items"), "language", "n_rows", "src")


PAGE = "concat('<title>', p_name, ' | Site</title><meta name=\"description\" content=\"', p_type, '\"><nav>menu</nav><article><h2>', p_name, '</h2><p>The ', p_type, ' part has the brand <b>', p_brand, '</b> &amp; is sold in many places.</p><ul><li>one</li><li>', p_brand, '</li></ul><table><tr><th>a</th><th>b</th></tr><tr><td>', p_size, '</td><td>2</td></tr></table><pre><code class=\"language-py\">x = ', p_size, '</code></pre><img src=\"https://i.test/', p_partkey, '.png\" alt=\"al\"><script>no</script></article>')"
PAGE_SQL = """SELECT p_partkey, unnest([
{'position': 0, 'type': 'heading', 'level': 2, 'text': p_name, 'items': NULL, 'language': NULL, 'markdown': NULL, 'src': NULL},
{'position': 1, 'type': 'text', 'level': NULL, 'text': 'The ' || p_type || ' part has the brand ' || p_brand || ' & is sold in many places.', 'items': NULL, 'language': NULL, 'markdown': NULL, 'src': NULL},
{'position': 2, 'type': 'list', 'level': NULL, 'text': NULL, 'items': 'one|' || p_brand, 'language': NULL, 'markdown': NULL, 'src': NULL},
{'position': 3, 'type': 'table', 'level': NULL, 'text': NULL, 'items': NULL, 'language': NULL, 'markdown': '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || p_size || ' | 2 |', 'src': NULL},
{'position': 4, 'type': 'code', 'level': NULL, 'text': NULL, 'items': NULL, 'language': 'py', 'markdown': NULL, 'src': NULL},
{'position': 5, 'type': 'image', 'level': NULL, 'text': NULL, 'items': NULL, 'language': NULL, 'markdown': NULL, 'src': 'https://i.test/' || p_partkey || '.png'}], recursive := true) FROM part"""


def built_pages(spark, sf) -> DataFrame:
    return dealt(table(spark, sf, "part")).select("p_partkey", F.lit("https://a.test/").alias("url"), F.expr(PAGE).alias("html"))


def _shown(found: DataFrame, *more: str) -> DataFrame:
    return found.select("p_partkey", "position", "type", "level", "text", F.array_join("items", "|").alias("items"), "language", "markdown", "src", *more)


@query(PAGE_SQL)
def page_elements(spark, sf):
    """All six kinds of elements of a built page, in order."""
    return _shown(elements.extract(built_pages(spark, sf), "p_partkey", "html"))


@query(f"SELECT *, 3 AS omitted FROM ({PAGE_SQL}) WHERE position IN (0, 3, 4)")
def best_page_elements(spark, sf):
    """The three best of six, in document order; a page's are chosen where they are made."""
    return _shown(elements.extract(built_pages(spark, sf), "p_partkey", "html", best=3), "omitted")


@query("SELECT p_partkey, p_name || ' | Site' AS title, p_type AS description, p_name || 'The ' || p_type || ' part has the brand ' || p_brand || ' & is sold in many places.one' || p_brand || 'ab' || p_size || '2x = ' || p_size AS text, 'article' AS method FROM part")
def page_texts(spark, sf):
    """Metadata and article text of a built page."""
    return web.read_pages(built_pages(spark, sf), "p_partkey").select("p_partkey", "title", "description", "text", "method")


@query("SELECT p_partkey, 0 AS chunk_index, 1 AS total_chunks, a || chr(10) || chr(10) || b AS content, '# ' || p_name || ' > ## Details' AS section, p_name AS page_title, ceil(length(a || b) / 4.0 + 0.5) AS token_estimate FROM (SELECT *, 'The ' || p_type || ' part has the brand ' || p_brand || ' and number ' || p_partkey || ', and it is sold in many places.' AS a, 'This one is ' || p_size || ' long, which is told to all who ask for it in the shop.' AS b FROM part)")
def chunk_sections(spark, sf):
    """Two short sections under a title make one chunk."""
    text = F.expr("concat('# ', p_name, '\n\nThe ', p_type, ' part has the brand ', p_brand, ' and number ', p_partkey, ', and it is sold in many places.\n\n## Details\n\nThis one is ', p_size, ' long, which is told to all who ask for it in the shop.\n')")
    made = chunking.chunks(table(spark, sf, "part").select("p_partkey", text.alias("text")), "p_partkey", "text")
    return made.select("p_partkey", "chunk_index", "total_chunks", "content", "section", "page_title", "token_estimate")


@query("SELECT g, count(*)::BIGINT AS kept, max(n) - 50 AS omitted FROM (SELECT p_partkey % 10 AS g, 7 * count(*) OVER (PARTITION BY p_partkey % 10) AS n, row_number() OVER (PARTITION BY p_partkey % 10 ORDER BY p_partkey) AS i FROM part, (SELECT unnest(range(7)))) WHERE i <= 50 GROUP BY g".replace("7 * count(*)", "count(*)"))
def merged_elements(spark, sf):
    """The elements of several pages as one document of at most fifty."""
    out = elements.extract(table(spark, sf, "part").select("p_partkey", F.expr(MARKDOWN).alias("text")), "p_partkey", "text", "markdown")
    out = elements.merged(out.withColumn("g", F.col("p_partkey") % 10), "p_partkey", "g", 50)
    return out.groupBy("g").agg(F.count("*").alias("kept"), F.max("omitted").alias("omitted"))


@query("SELECT s_suppkey AS position, 1000 // n + (i < 1000 % n)::INT AS budget FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS i, count(*) OVER () AS n FROM supplier) WHERE 1000 // n + (i < 1000 % n)::INT > 0")
def seed_shares(spark, sf):
    return web.seed_budgets(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("position")), 1000)


@query(
    """WITH RECURSIVE s AS (SELECT c_nationkey AS g, c_custkey, c_custkey * 7 % 5 AS found, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer),
w AS (SELECT g, c_custkey, found, i, (12 + n - 1) // n AS budget, least(found, (12 + n - 1) // n) AS kept, 12 - least(found, (12 + n - 1) // n) AS rest FROM s WHERE i = 0
UNION ALL SELECT s.g, s.c_custkey, s.found, s.i, (rest + n - s.i - 1) // (n - s.i), least(s.found, (rest + n - s.i - 1) // (n - s.i)), rest - least(s.found, (rest + n - s.i - 1) // (n - s.i)) FROM w JOIN s ON s.g = w.g AND s.i = w.i + 1 WHERE rest > 0)
SELECT c_custkey, budget, kept FROM w WHERE found > 0"""
)
def seed_carry(spark, sf):
    """Crawls of 12 pages from the customers of each nation, of whom each fifth finds nothing."""
    seeds = table(spark, sf, "customer").select("c_nationkey", "c_custkey", (F.col("c_custkey") * 7 % 5).alias("found"))
    return web.seed_budgets(seeds, 12, "c_custkey", ("c_nationkey",), "found").select("c_custkey", "budget", "kept")


@query(
    r"""WITH r AS (SELECT page_id, page_id % 97 AS position, url FROM pages WHERE page_id % 3 = 0), s AS (SELECT min(position) AS at, regexp_replace(url, '\?.*$', '') AS k FROM (SELECT * FROM r WHERE page_id < 10) GROUP BY ALL)
SELECT min(page_id) AS page_id FROM (SELECT page_id, regexp_replace(url, '\?.*$', '') AS k FROM pages) JOIN s USING (k) GROUP BY k"""
)
def searched_pages(spark, sf):
    """Pages that the best results of a search lead to: those of the first ids, with or without tracking."""
    pages = table(spark, sf, "pages")
    results = pages.where("page_id % 3 = 0 AND page_id < 10").select((F.col("page_id") % 97).alias("position"), "url")
    return tools.search_then_crawl(results, pages.select("page_id", "url"), 50, 1000).select("page_id")


# --- composed searches -------------------------------------------------------------------------------------------------

WEB = "SELECT p_partkey AS k, p_size, 'https://k' || p_partkey || '.test/' AS url FROM part"


@query(
    f"""WITH w AS ({WEB}), a AS (SELECT k, url, row_number() OVER (ORDER BY k) AS r, CASE WHEN p_size % 2 = 0 THEN p_size || ' days ago' END AS age, 1 AS l FROM w WHERE k % 2 = 0),
b AS (SELECT k, url, row_number() OVER (ORDER BY k DESC) AS r, p_size || ' hours ago' AS age, 0 AS l FROM w WHERE k % 3 = 0),
f AS (SELECT k, sum(1.0::DOUBLE / (60 + r)) AS s, arg_max(age, n) AS age, arg_max(l, n) AS l, arg_min((n, r), n) AS first FROM (SELECT *, 0 AS n FROM a UNION ALL SELECT *, 1 AS n FROM b) GROUP BY k),
d AS (SELECT *, coalesce(exp(-(CASE WHEN contains(age, 'day') THEN split_part(age, ' ', 1)::DOUBLE ELSE split_part(age, ' ', 1)::DOUBLE / 24 END) / 7), 0) AS rc FROM f),
c AS (SELECT k, l, round(0.6 * (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()) + 0.25 * (rc - min(rc) OVER ()) / (max(rc) OVER () - min(rc) OVER ()) + 0.15 * l, 6) AS combined_score, first FROM d)
SELECT k, combined_score FROM c ORDER BY combined_score DESC, first LIMIT 50"""
)
def web_search(spark, sf):
    """Two backends' results, fused by URL, rescored by recency and deep links."""
    p = table(spark, sf, "part")
    base = [F.col("p_partkey").alias("k"), F.lit("t").alias("title"), F.expr("concat('https://k', p_partkey, '.test/')").alias("url"), F.lit("d").alias("domain"), F.lit("").alias("description"), F.lit("").alias("extra_snippet")]
    links = F.array(F.struct(F.lit("t").alias("title"), F.lit("u").alias("url")))
    a = p.where("p_partkey % 2 = 0").select(*base, F.col("p_partkey").alias("position"), F.expr("IF(p_size % 2 = 0, concat(p_size, ' days ago'), NULL)").alias("age"), links.alias("deep_links"))
    b = p.where("p_partkey % 3 = 0").select(*base, (-F.col("p_partkey")).alias("position"), F.expr("concat(p_size, ' hours ago')").alias("age"), F.slice(links, 1, 0).alias("deep_links"))
    best = tools.web_results({"one": a, "two": b}, AS_OF, 50)
    return best.select(F.regexp_extract("url", r"k(\d+)", 1).cast("long").alias("k"), "combined_score")


PAPERS = "SELECT p_partkey AS k, p_name || ' ' || p_partkey // 2 AS title, CASE WHEN p_partkey % 4 = 0 THEN '10.1/' || p_partkey END AS doi, 2000 + p_size % 25 AS year, CASE WHEN p_size <= 40 THEN p_size * p_size END AS citations, CASE WHEN p_size % 2 = 0 THEN p_brand END AS venue FROM part"


def paper_rows(spark, sf) -> DataFrame:
    return table(spark, sf, "part").selectExpr("p_partkey AS k", "concat(p_name, ' ', p_partkey DIV 2) AS title", "IF(p_partkey % 4 = 0, concat('10.1/', p_partkey), NULL) AS doi", "array('Bo Li') AS authors", "2000 + p_size % 25 AS year", "IF(p_size <= 40, p_size * p_size, NULL) AS citations", "IF(p_size % 2 = 0, p_brand, NULL) AS venue", "'' AS text", "'' AS url")


@query(
    f"""WITH p AS (SELECT *, coalesce(lower(doi), lower(title) || '|li') AS id, lower(title) AS key FROM ({PAPERS})),
a AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY k) AS o, 0 AS n, k AS pos FROM p WHERE k % 2 = 0 AND year >= 2003), b AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY -k) AS o, 1 AS n, -k AS pos FROM p WHERE k % 3 = 0 AND year >= 2003),
r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY pos) AS r FROM (SELECT * FROM a WHERE o = 1 UNION ALL SELECT * FROM b WHERE o = 1)),
f AS (SELECT id, sum(1.0::DOUBLE / (60 + r)) AS s, arg_max(k, n * 1000000 - r) AS k, arg_max(year, n * 1000000 - r) AS year, arg_max(coalesce(citations, 0), n * 1000000 - r) AS c, arg_max(coalesce(length(venue), 0), n * 1000000 - r) AS v, min((n, r)) AS first FROM r GROUP BY id),
d AS (SELECT *, exp(-365.0 * (2024 - year) / 1095) AS y, ln(1 + c) AS g FROM f),
e AS (SELECT k, round(0.5 * (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()) + 0.2 * (y - min(y) OVER ()) / (max(y) OVER () - min(y) OVER ()) + 0.2 * (g - min(g) OVER ()) / (max(g) OVER () - min(g) OVER ()) + 0.1 * (v > 0)::INT, 6) AS combined_score, first FROM d)
SELECT k, combined_score FROM e ORDER BY combined_score DESC, first LIMIT 50"""
)
def academic_search(spark, sf):
    """Two sources' papers, fused by DOI or title and surname, rescored by recency, citations and venue."""
    p = paper_rows(spark, sf)
    parts = {"one": p.where("k % 2 = 0").withColumn("position", F.col("k")), "two": p.where("k % 3 = 0").withColumn("position", -F.col("k"))}
    rows = {n: d.withColumn("text", F.col("k").cast("string")) for n, d in parts.items()}
    best = tools.academic_search(rows, 2024, 50, 2003)
    return best.select(F.col("text").cast("long").alias("k"), "combined_score")


@query(
    f"""WITH a AS (SELECT o_orderkey, o_orderdate, o_totalprice, o_custkey % 40 AS c, 0 AS n, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT o_orderkey, o_orderdate, o_totalprice, o_custkey % 40 AS c, 1 AS n, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders WHERE o_orderkey % 5 = 0),
f AS (SELECT o_orderkey, any_value(o_orderdate) AS t, any_value(floor(o_totalprice)) AS p, any_value(c) AS c, sum(1.0::DOUBLE / (60 + r)) AS s, min((n, r)) AS first FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY o_orderkey),
d AS (SELECT *, exp(-((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(t)) / 86400000000.0) / 180) AS y, ln(1 + p) AS g, ln(1 + c) AS h FROM f),
e AS (SELECT o_orderkey, round(0.5 * (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()) + 0.2 * (y - min(y) OVER ()) / (max(y) OVER () - min(y) OVER ()) + 0.2 * (g - min(g) OVER ()) / (max(g) OVER () - min(g) OVER ()) + 0.1 * (h - min(h) OVER ()) / (max(h) OVER () - min(h) OVER ()), 6) AS combined_score, first FROM d)
SELECT o_orderkey, combined_score FROM e ORDER BY combined_score DESC, first LIMIT 100"""
)
def discussion_search(spark, sf):
    """Posts of two lists, rescored by recency, points and comments of the merged list."""
    o = table(spark, sf, "orders")
    post = [F.col("o_orderkey").alias("id"), F.expr("concat('https://d.test/', o_orderkey)").alias("url"), F.col("o_orderdate").alias("created"), F.floor("o_totalprice").alias("score"), (F.col("o_custkey") % 40).alias("num_comments")]
    a = o.where("o_orderkey % 2 = 0").select(F.lit(0).alias("ranking"), F.col("o_orderkey").alias("position"), *post)
    number = F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "o_orderkey")).cast("long")
    b = o.where("o_orderkey % 5 = 0").select(F.lit(1).alias("ranking"), number.alias("position"), *post)
    return tools.discussion_search(a.unionByName(b), AS_OF, limit=100).select(F.col("id").alias("o_orderkey"), "combined_score")


@query(f"WITH p AS ({PAPERS}), h AS (SELECT title, k, citations, doi, venue, row_number() OVER (PARTITION BY lower(title) ORDER BY k) AS i, min(k) OVER (PARTITION BY lower(title)) AS slot FROM p), a AS (SELECT * FROM h WHERE i = 1), b AS (SELECT * FROM h WHERE i = 2), w AS (SELECT a.slot, CASE WHEN b.k IS NOT NULL AND ((b.citations IS NOT NULL AND a.citations IS NULL) OR (b.doi IS NOT NULL AND a.doi IS NULL) OR (b.venue IS NOT NULL AND a.venue IS NULL)) THEN b.k ELSE a.k END AS k FROM a LEFT JOIN b ON lower(a.title) = lower(b.title)) SELECT w.k, slot AS position FROM w JOIN p ON p.k = w.k ORDER BY citations DESC NULLS LAST, slot LIMIT 50")
def papers_by_citations(spark, sf):
    """One source alone: once by title, the richer record in the first one's place, most cited first, unknown last."""
    return tools.by_citations(paper_rows(spark, sf).withColumn("position", F.col("k")), 50).select("k", "position")


@query(rf"SELECT k, coalesce(lower(doi), trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g')) || '|li') AS id FROM ({PAPERS})")
def paper_identities(spark, sf):
    p = paper_rows(spark, sf)
    return p.select("k", T.paper_identity(F.col("doi"), F.col("title"), F.col("authors")[0]).alias("id"))


@query(f"WITH d AS (SELECT k, exp(-365.0 * coalesce(2024 - year, 10) / 1095) AS y, ln(1 + coalesce(citations, 0)) AS c, venue FROM ({PAPERS})) SELECT k, round((y - min(y) OVER ()) / (max(y) OVER () - min(y) OVER ()), 6) AS recency, round((c - min(c) OVER ()) / (max(c) OVER () - min(c) OVER ()), 6) AS citation_signal, (coalesce(length(venue), 0) > 0)::INT::DOUBLE AS venue_signal FROM d")
def academic_signals(spark, sf):
    return fusion.academic_signals(paper_rows(spark, sf), 2024).select("k", F.round("recency", 6).alias("recency"), F.round("citation_signal", 6).alias("citation_signal"), "venue_signal")


@query("WITH d AS (SELECT p_partkey, coalesce(exp(-(CASE WHEN p_size % 3 = 0 THEN p_size::DOUBLE WHEN p_size % 3 = 1 THEN p_size * 7.0 END) / 7), 0) AS r, p_size % 2 AS l FROM part) SELECT p_partkey, round((r - min(r) OVER ()) / (max(r) OVER () - min(r) OVER ()), 6) AS recency, l::DOUBLE AS deep FROM d")
def web_signals(spark, sf):
    p = table(spark, sf, "part").selectExpr("p_partkey", "CASE p_size % 3 WHEN 0 THEN concat(p_size, ' days ago') WHEN 1 THEN concat(p_size, ' weeks ago') END AS age", "IF(p_size % 2 = 1, array('u'), NULL) AS deep_links")
    return fusion.web_signals(p, AS_OF).select("p_partkey", F.round("recency", 6).alias("recency"), F.col("hasDeepLinks").alias("deep"))


@query("WITH d AS (SELECT o_orderkey, ln(1 + floor(o_totalprice)) AS g, ln(1 + o_custkey % 40) AS h FROM orders) SELECT o_orderkey, round((g - min(g) OVER ()) / (max(g) OVER () - min(g) OVER ()), 6) AS points, round((h - min(h) OVER ()) / (max(h) OVER () - min(h) OVER ()), 6) AS comments FROM d")
def discussion_signals(spark, sf):
    """Sorted by date: no recency, which the order has already."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", F.floor("o_totalprice").alias("p"), (F.col("o_custkey") % 40).alias("c"))
    out = fusion.discussion_signals(o, AS_OF, "date", "o_orderdate", "p", "c")
    return out.select("o_orderkey", F.round("engagement", 6).alias("points"), F.round("commentEngagement", 6).alias("comments"))


@query(
    "WITH t AS (SELECT p_partkey, lower(p_name) AS n, p_partkey AS d FROM part), s AS (SELECT p_partkey, d, CASE WHEN n = 'widget' THEN 1000 WHEN starts_with(n, 'widget') THEN 500 WHEN contains(n, 'widget') THEN 100 END AS tier FROM t) SELECT p_partkey FROM s WHERE tier IS NOT NULL ORDER BY round(tier + log10(greatest(d, 1)), 6) DESC, d DESC LIMIT 50"
)
def package_search(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_partkey").alias("downloads"))
    return tools.package_search(p, "widget", 50).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name || ' ' || p_type), 'widget') AND p_brand = (SELECT min(p_brand) FROM part) AND p_size >= 10 ORDER BY p_size DESC, p_name || p_partkey LIMIT 1000")
def repository_search(spark, sf):
    p = table(spark, sf, "part")
    least = p.agg(F.min("p_brand")).collect()[0][0]
    repos = p.select("p_partkey", F.concat("p_name", F.col("p_partkey").cast("string")).alias("name"), F.col("p_type").alias("description"), F.col("p_brand").alias("language"), F.col("p_size").alias("stars"))
    return tools.repository_search(repos, "widget", least, 10, 1000).select("p_partkey")


# --- searches by the services' own filters -----------------------------------------------------------------------------


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name || ' ' || p_type), 'widget') AND NOT contains(lower(p_name || ' ' || p_type), 'small') AND p_size BETWEEN 5 AND 40 AND p_partkey > 20 AND p_brand <> 'Brand#3' ORDER BY p_size DESC, p_name, p_partkey LIMIT 1000")
def repository_qualifiers(spark, sf):
    p = table(spark, sf, "part")
    repos = p.select("p_partkey", F.format_string("%s %012d", "p_name", "p_partkey").alias("name"), F.col("p_type").alias("description"), F.col("p_size").alias("stars"), F.col("p_partkey").alias("forks"), F.col("p_brand").alias("language"))
    return searches.repositories(repos, 'widget -small stars:5..40 forks:>20 -language:"Brand#3"', 1000).select("p_partkey")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'ing') AND lang = 'en' AND source = (SELECT min(source) FROM documents) AND doc_id::VARCHAR LIKE '1%' ORDER BY doc_id::VARCHAR LIMIT 1000")
def code_qualifiers(spark, sf):
    d = table(spark, sf, "documents")
    first = d.agg(F.min("source")).first()[0]
    files = d.select("doc_id", F.concat(F.lit("me/"), "source").alias("repository"), F.col("doc_id").cast("string").alias("path"), F.col("lang").alias("language"), "text")
    return searches.code(files, searches.code_query(" ing ", "me", first, "en", "1"), 1000).select("doc_id")


def _answers(spark, sf, raw: str, source: str) -> DataFrame:
    return records.normalize(table(spark, sf, "part").select("p_partkey", F.expr(f"to_json({raw})").alias("raw")), source)


@query("SELECT p_partkey FROM part WHERE p_partkey % 3 = 1 AND contains(p_name, 'widget') AND p_size > 10 AND p_size < 20 ORDER BY p_size DESC, p_partkey::VARCHAR LIMIT 50")
def story_filters(spark, sf):
    """Comments of some days of January about a word."""
    raw = "named_struct('hits', array(named_struct('objectID', CAST(p_partkey AS STRING), 'title', p_name, 'points', 1, '_tags', IF(p_partkey % 3 = 1, array('comment', 'author_a'), array('story')), 'created_at', date_format(timestampadd(DAY, p_size, TIMESTAMP '2024-01-01 00:00:00'), \"yyyy-MM-dd'T'HH:mm:ss'Z'\"))))"
    return searches.stories(_answers(spark, sf, raw, "hackernews"), "WIDGET", "comment", "date", datetime(2024, 1, 11), datetime(2024, 1, 21), 100).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') AND p_partkey % 2 = 0 AND NOT contains(p_name, 'red') ORDER BY p_size DESC, p_partkey::VARCHAR LIMIT 100")
def question_filters(spark, sf):
    raw = "named_struct('items', array(named_struct('question_id', p_partkey, 'title', p_name, 'tags', array('x', p_brand), 'last_activity_date', p_size, 'accepted_answer_id', IF(p_partkey % 2 = 0, 1, CAST(NULL AS INT)))))"
    return searches.questions(_answers(spark, sf, raw, "stackoverflow"), "-red", "activity", "Brand#1; Brand#2;Brand#3", True, 500).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE (p_name LIKE 'red %' OR p_name LIKE '% widget') AND p_brand = 'Brand#2' ORDER BY p_size DESC, p_partkey::VARCHAR LIMIT 1000")
def patent_assignees(spark, sf):
    """Abstracts with one of two words, of one company: Brand#2, but not Brand#21."""
    raw = "named_struct('patents', array(named_struct('patent_id', CAST(p_partkey AS STRING), 'patent_abstract', p_name, 'patent_date', CAST(date_add(DATE '2024-01-01', p_size) AS STRING), 'assignees', array(named_struct('assignee_organization', 'Other'), named_struct('assignee_organization', concat('The ', p_brand, ' Co.'))))))"
    return searches.patents(_answers(spark, sf, raw, "patents"), "Red, WIDGET", "brand#2 co", 1000).select("p_partkey")


@query("WITH c AS (SELECT DISTINCT unnest([lower(p_name), replace(lower(p_name), ' ', '-'), replace(lower(p_name), ' ', '_')]) AS name FROM part WHERE p_partkey % 2 = 0) SELECT name FROM c WHERE name NOT IN (SELECT lower(p_name) FROM part WHERE p_partkey % 2 = 1)")
def unknown_names(spark, sf):
    """Candidates for a direct lookup: names and their spellings that no index row has."""
    p = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("name"))
    return records.without_known(p.where("p_partkey % 2 = 0"), p.where("p_partkey % 2 = 1"))


@query("SELECT p_partkey, ['typescript', 'python', 'text', 'dockerfile', 'c'][(p_partkey % 5 + 1)::INT] AS language, CASE WHEN p_partkey % 7 <> 0 THEN p_name END AS body FROM part")
def repository_bodies(spark, sf):
    """Languages by file name, and bodies from base64 in lines."""
    p = table(spark, sf, "part")
    path = F.element_at(F.array(*map(F.lit, ("a/b.TSX", "x.py", "x.unknown", "deep/Dockerfile.dockerfile", "y.h"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    coded = F.base64(F.col("p_name").cast("binary"))
    body = F.when(F.col("p_partkey") % 7 == 0, F.lit("no base64!")).otherwise(F.concat(F.substring(coded, 1, 4), F.lit("\n"), F.substring(coded, 5, 1000)))
    return p.select("p_partkey", records.language_of(path).alias("language"), F.decode(records.file_body(body), "utf-8").alias("body"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'f' || p_partkey WHEN 1 THEN 'f' || p_partkey - 1 WHEN 2 THEN 'f' || p_partkey - 2 END AS real_path FROM part")
def symlink_targets(spark, sf):
    """Of four paths: a file, a link to it, a link to that link, and a link to itself."""
    p = table(spark, sf, "part").selectExpr("p_partkey", "concat('f', p_partkey) AS path", "IF(p_partkey % 4 = 0, 'file', 'symlink') AS type", "concat('f', IF(p_partkey % 4 = 3, p_partkey, p_partkey - 1)) AS target")
    return records.followed(p, p.where("type = 'symlink'").select("path", "target")).select("p_partkey", "real_path")


@query("SELECT p_partkey, 'v' || 1 + p_partkey % 3 AS tag, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS readme FROM part")
def repository_details(spark, sf):
    p = table(spark, sf, "part").withColumn("name", F.col("p_partkey").cast("string"))
    releases = p.select("name", F.explode(F.sequence(F.lit(1), (F.col("p_partkey") % 3 + 1).cast("int"))).alias("i")).select("name", F.concat(F.lit("v"), "i").alias("tag"), F.col("i").alias("published"))
    readmes = p.where("p_partkey % 2 = 0").select("name", F.base64(F.col("p_type").cast("binary")).alias("content"))
    return records.repository_details(p.select("p_partkey", "name"), releases, readmes).select("p_partkey", "release.tag", "readme")


# --- listings ----------------------------------------------------------------------------------------------------------


def confident(spark, sf) -> DataFrame:
    return listings.confidence(listing_rows(spark, sf))


@query(f"WITH l AS ({LISTING}) SELECT id, round((0.95 * 0.4 + coalesce(CASE WHEN location IS NOT NULL THEN 0.8 END, 0) * 0.25 + CASE WHEN work_mode <> 'unknown' THEN 0.9 ELSE 0 END * 0.2 + CASE WHEN salary_raw IS NOT NULL THEN 0.85 ELSE 0 END * 0.15)::DOUBLE, 6) AS overall FROM l")
def listing_confidence(spark, sf):
    return confident(spark, sf).select("id", F.round("confidence.overall", 6).alias("overall"))


@query(
    f"""WITH l AS (SELECT *, 'https://j.test/' || id // 3 AS u, ['jora', 'seek', 'other'][(id % 3 + 1)::INT] AS s FROM ({LISTING})) SELECT arg_min(id, CASE s WHEN 'seek' THEN 0 WHEN 'jora' THEN 2 ELSE 3 END) AS id, min(id) AS position FROM l GROUP BY u"""
)
def listing_dedup(spark, sf):
    """Three listings to a URL: that of the most reliable source stays, in the first one's place."""
    rows = confident(spark, sf).withColumns({"source_url": F.expr("concat('https://j.test/', id DIV 3)"), "source": F.expr("element_at(array('jora', 'seek', 'other'), CAST(id % 3 + 1 AS INT))"), "job_id": F.lit(None).cast("string"), "company": F.lit(None).cast("string"), "position": F.col("id")})
    return listings.dedup(rows).select("id", "position")


@query(f"SELECT id, CASE WHEN id % 2 = 0 THEN id / 7.0::DOUBLE WHEN id % 3 = 0 THEN 0.5 ELSE 0 END AS semantic FROM ({LISTING})")
def listing_scores(spark, sf):
    """Scores by URL, else by position, else 0."""
    rows = listing_rows(spark, sf).drop("semantic").withColumns({"source_url": F.expr("IF(id % 2 = 0, concat('u', id), NULL)"), "position": F.col("id")})
    scores = rows.where("id % 2 = 0").selectExpr("source_url AS key", "id / 7.0D AS score").unionByName(rows.where("id % 3 = 0").selectExpr("CAST(id AS STRING) AS key", "0.5D AS score"))
    return listings.with_semantic(rows, scores).select("id", "semantic")


JOB = "concat('<title>', s_name, ' - Site</title><script type=\"application/ld+json\">{\"@graph\":[{\"@type\":\"JobPosting\",\"title\":\"', s_name, '\",\"hiringOrganization\":{\"name\":\"Co ', s_nationkey, '\"},\"jobLocation\":{\"address\":{\"addressLocality\":\"City\",\"addressRegion\":\"R', s_nationkey, '\"}},\"datePosted\":\"2024-01-0', s_suppkey % 9 + 1, '\"}]}</script> <p>', IF(s_suppkey % 2 = 0, 'Hybrid work. $80k - $95k. ', 'A contract, closing soon. '), repeat('more text ', 30), '</p>')"


def extracted(spark, sf) -> DataFrame:
    pages = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("page_id"), F.expr("concat('https://www.seek.com.au/job/', s_suppkey, '?x')").alias("url"), F.expr(JOB).alias("html"))
    return tools.extract_listings(pages)


@query("SELECT s_suppkey AS page_id, s_name AS title, 'Co ' || s_nationkey AS company, 'City R' || s_nationkey AS location, 'seek' AS source, CASE WHEN s_suppkey % 2 = 0 THEN 'hybrid' ELSE 'unknown' END AS work_mode, CASE WHEN s_suppkey % 2 = 0 THEN '$80k - $95k' END AS salary_raw, '2024-01-0' || s_suppkey % 9 + 1 AS posted_raw, s_suppkey::VARCHAR AS job_id, CASE WHEN s_suppkey % 2 = 1 THEN 'contract|closing_soon' ELSE '' END AS caveats, 'listing_page_fetched' AS verification_status FROM supplier")
def listing_extract(spark, sf):
    """Job pages with JSON-LD: fields of the markup, and those of the text."""
    return extracted(spark, sf).select("page_id", "title", "company", "location", "source", "work_mode", "salary_raw", "posted_raw", "job_id", F.array_join("caveats", "|").alias("caveats"), "verification_status")


@query("SELECT count(*) AS listings, count(*) AS fetched, 0 AS search_only, 0 AS aggregator, 0 AS manual, count(*) FILTER (s_suppkey % 2 = 1) AS without_pay FROM supplier")
def listing_counters(spark, sf):
    return tools.status_counts(extracted(spark, sf))


@query(f"SELECT id, md5(concat_ws(chr(10) || chr(10), title, company, location, work_mode, salary_raw, 'text')) AS h FROM ({LISTING})")
def listing_texts(spark, sf):
    return listing_rows(spark, sf).withColumn("extracted_text", F.lit("text")).select("id", F.md5(tools.listing_text()).alias("h"))


@query("SELECT doc_id, (length(text) - length(replace(text, chr(10), '')) + 1) AS lines_count FROM documents")
def compacted_results(spark, sf):
    """Arrays replaced by their sizes."""
    return retrieve.compacted(table(spark, sf, "documents").select("doc_id", F.split("text", "\n", -1).alias("lines")), "lines")


# --- hygiene and threads -----------------------------------------------------------------------------------------------

LINKED = "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '[Home page](http://a) > [Next page](http://b)' || chr(10) || text WHEN 1 THEN '[Only a link here](http://a/b)' || chr(10) || 'two words' ELSE text END AS text FROM documents"
CONTEXT = STATS.replace("FROM documents", f"FROM ({LINKED})").replace("contains(t, '```') AS code FROM l)", r"contains(t, '```') AS code, len(list_filter(ls, lambda x: contains(x, '>') AND coalesce(list_sum(list_transform(regexp_extract_all(trim(x), '\[([^\]]+)\]\(([^)]+)\)'), lambda y: length(y))), 0) / length(trim(x)) > 0.8)) / nullif(len(ls), 0) AS crumbs, len(list_filter(ls, lambda x: length(regexp_extract(trim(x), '\[([^\]]+)\]\(([^)]+)\)')) / length(trim(x)) > 0.8)) / nullif(len(ls), 0) AS pure FROM l)")


@query(CONTEXT + "SELECT doc_id, round(crumbs, 6) AS crumbs, round(pure, 6) AS pure, lines = 0 OR (NOT code AND (link_density > 0.5 OR (list_density > 0.6 AND short_density > 0.7 AND link_density > 0.2) OR (list_density > 0.7 AND short_density > 0.8 AND words_per_line < 3))) OR coalesce(crumbs > 0.5 OR (words_per_line < 3 AND pure > 0.3), false) AS boilerplate FROM s")
def boilerplate_in_context(spark, sf):
    """Breadcrumbs and lines that are links only count too."""
    d = table(spark, sf, "documents").withColumn("text", F.expr("CASE doc_id % 4 WHEN 0 THEN concat('[Home page](http://a) > [Next page](http://b)\\n', text) WHEN 1 THEN '[Only a link here](http://a/b)\\ntwo words' ELSE text END"))
    s = d.select("doc_id", hygiene.line_stats(F.col("text"), context=True).alias("s"))
    return s.select("doc_id", F.round("s.breadcrumb_density", 6).alias("crumbs"), F.round("s.pure_link_density", 6).alias("pure"), F.coalesce(hygiene.is_boilerplate_in_context(F.col("s")), F.lit(False)).alias("boilerplate"))


@query(
    SQL["transcript_groups"].rsplit("SELECT conv_id, g::BIGINT", 1)[0].replace("AS i, length(", "AS i, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS txt, length(")
    + "SELECT f.conv_id, g::BIGINT AS chunk_index, md5(string_agg(txt, ' ' ORDER BY f.i)) AS h, min(turn) * 7.0::DOUBLE AS \"offset\", count(*) * 7.0::DOUBLE AS duration, max(turn) * 7.0::DOUBLE + 7 AS stop FROM f JOIN s ON s.conv_id = f.conv_id AND s.i = f.i GROUP BY f.conv_id, g"
)
def transcript_texts(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("seg_no"), "text", (F.col("turn") * 7.0).alias("offset"), F.lit(7.0).alias("duration"))
    return threads.transcript_chunks(c, "conv_id").select("conv_id", "chunk_index", F.md5("text").alias("h"), "offset", "duration", F.col("end_offset").alias("stop"))


@query("SELECT conv_id, turn FROM conversations WHERE lower(trim(text)) NOT IN ('', '[deleted]', '[removed]') AND turn % 3 <> 1")
def kept_comments(spark, sf):
    """Deleted, removed and blank comments go."""
    body = F.when(F.col("position") % 3 == 1, F.element_at(F.array(F.lit(" [Deleted] "), F.lit("[removed]"), F.lit("")), (F.col("position") % 3).cast("int"))).otherwise(F.col("body"))
    return comments(spark, sf).where(~threads.is_gone(body)).select("conv_id", F.col("position").alias("turn"))


# --- the store and ids ---------------------------------------------------------------------------------------------------


def _store(spark) -> store.Store:
    return store.Store(spark, f"{folder(spark)}/store-{uuid.uuid4().hex}")


def _corpus(spark, sf) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf, "documents").join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")
    return docs.select(F.col("doc_id").alias("position"), "text"), docs.select(F.col("doc_id").alias("position"), F.col("embedding").alias("vector"))


@query("SELECT doc_id AS position, md5(text) AS h, len(embedding) AS dims FROM documents JOIN embeddings ON vec_id = doc_id")
def store_round_trip(spark, sf):
    """A corpus built, written, and read back."""
    _, chunks, vectors = _store(spark).get_or_build({"path": sf}, "model", 64, 1000, lambda: _corpus(spark, sf))
    return chunks.join(vectors, "position").select("position", F.md5("text").alias("h"), F.size("vector").alias("dims"))


@query("SELECT 'kept' AS what, count(*) AS n, (sum(strlen(text)) > 0)::INT AS bytes FROM documents JOIN embeddings ON vec_id = doc_id UNION ALL SELECT 'expired', 0, 0 UNION ALL SELECT 'deleted', 0, 0")
def store_expiry(spark, sf):
    """A corpus within its time, after it, and after its removal."""
    own, (chunks, vectors) = _store(spark), _corpus(spark, sf)
    own.write("c", chunks, vectors, {"a": None, "b": 1}, 1000, "model", 64)
    rows = []
    for what, now in (("kept", 2000), ("expired", 1000 + store.TTL_MS + 1), ("deleted", 2000)):
        if what == "deleted":
            own.evict(1000 + store.TTL_MS + 1)
        found = own.read("c", now)
        rows.append((what, found[0].count() if found else 0, int(found is not None)))
    return spark.createDataFrame(rows, "what string, n long, bytes int")


@query(
    "WITH e AS (SELECT doc_id, sha256(concat_ws('|', 'u' || doc_id, '', text)) AS h FROM documents), b AS (SELECT doc_id // 1000 AS b, sha256(string_agg(h, chr(10) ORDER BY doc_id)) AS h FROM e GROUP BY 1), c AS (SELECT b // 1000 AS c, sha256(string_agg(h, chr(10) ORDER BY b)) AS h FROM b GROUP BY 1), w AS (SELECT sha256(string_agg(h, chr(10) ORDER BY c)) AS h FROM c) SELECT sha256('document|model|64|' || h) AS corpus_id FROM w"
)
def pipeline_corpus_id(spark, sf):
    chunks = table(spark, sf, "documents").select(F.col("doc_id").alias("position"), F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url"), F.lit(None).cast("string").alias("section"), "text")
    return spark.createDataFrame([(retrieve.corpus_id("document", "model", 64, chunks),)], "corpus_id string")


# --- vectors, prompts, retrieval ---------------------------------------------------------------------------------------


@query("SELECT p_partkey, 'task: ' || CASE WHEN p_partkey % 2 = 0 THEN 'code retrieval' ELSE 'search result' END || ' | query: ' || CASE WHEN p_partkey % 2 = 0 THEN 'def ' ELSE '' END || p_name AS asked, 'title: ' || CASE WHEN p_partkey % 3 = 0 THEN 'none' ELSE p_brand END || ' | text: ' || p_type AS told FROM part")
def embedding_prompts(spark, sf):
    p = table(spark, sf, "part")
    asked = F.concat(F.when(F.col("p_partkey") % 2 == 0, "def ").otherwise(""), "p_name")
    return p.select("p_partkey", V.query_prompt(asked).alias("asked"), V.document_prompt(F.col("p_type"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand"))).alias("told"))


@query("SELECT vec_id, len(embedding) AS n, 344 AS size, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total FROM embeddings")
def packed_vectors(spark, sf):
    """Vectors as base64 of 32-bit floats, and back: 64 of them are 256 bytes, 344 characters."""
    v = table(spark, sf, "embeddings").select("vec_id", F.regexp_replace(V.packed(F.col("embedding")), r"\s", "").alias("p"))
    v = v.select("vec_id", F.length("p").alias("size"), V.unpacked(F.col("p")).alias("v"))
    return v.select("vec_id", F.size("v").alias("n"), "size", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("SELECT vec_id, vec_id % 3 > 0 AS ok FROM embeddings")
def valid_vectors(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", F.when(F.col("vec_id") % 3 == 0, F.concat(F.slice("embedding", 1, 3), F.array(F.lit(float("nan")).cast("float")))).otherwise(F.col("embedding")).alias("v"))
    return v.select("vec_id", V.finite(F.col("v")).alias("ok"))


@query(BM25.replace("{queries}", ONE) + "SELECT doc_id, score AS lexical_score, round(1.0 / (60 + row_number() OVER (ORDER BY score DESC, doc_id)), 6) AS fused_score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM bm WHERE score > 0 ORDER BY rank LIMIT 20")
def prepared_retrieval(spark, sf):
    """A corpus of whole documents, prepared and searched at once, by words alone."""
    docs = table(spark, sf, "documents").select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("id"), "text", F.lit("u").alias("url"), F.lit("t").alias("title"))
    _, rows, _ = retrieve.prepare_and_retrieve(docs, QUESTION, top_k=20)
    return rows.select(F.col("id").cast("long").alias("doc_id"), "lexical_score", "fused_score", "rank")


@query()
def chunk_invariants(spark, sf):
    """Each document's chunks: how many, their words, and whether every one has a text."""
    c = chunking.chunks(table(spark, sf, "documents"), "doc_id", "text")
    return c.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.size(T.tokens(F.col("content")))).alias("words"), F.bool_and(F.col("content") != "").alias("full"))


@query("SELECT page_id, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path FROM pages WHERE starts_with(url, 'http://') OR starts_with(url, 'https://')")
def url_path(spark, sf):
    return table(spark, sf, "pages").where(U.scheme(F.col("url")).isin("http", "https")).select("page_id", U.path(F.col("url")).alias("path"))


@query("SELECT user_id, count(*) FILTER (n <= 5) AS n, max(used) FILTER (n <= 5) AS used FROM (SELECT user_id, row_number() OVER w AS n, row_number() OVER w AS used FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) GROUP BY user_id")
def count_budget(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id")
    kept = dedup.prefix_budget(e, F.lit(1), 5, "event_id", partition=("user_id",))
    return kept.groupBy("user_id").agg(F.count("*").alias("n"), F.max("used").alias("used"))

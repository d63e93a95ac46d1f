"""Pages: metadata, article text, elements, sitemaps, crawl-table selection."""

from __future__ import annotations

import re
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ragspark.errors import ValidationError, bounded
from ragspark.functions import numbers as N
from ragspark.functions import text as T
from ragspark.functions import urls as U
from ragspark.operators import hygiene, markup
from ragspark.operators.dedup import keep_first, prefix_budget
from ragspark.operators.tables import numbered, saved

GONE = frozenset({"script", "style", "noscript", "svg", "nav"})


def sitemap_urls(xml: DataFrame, key: str, column: str = "xml", most: int | None = None) -> DataFrame:
    """(key, position, url): the distinct locations in document order."""
    each = xml.select(key, F.posexplode(F.regexp_extract_all(column, F.lit(r"(?i)<loc>([^<]*)</loc>"), F.lit(1))).alias("at", "loc"))
    found = each.select(key, "at", F.trim(T.decoded(F.col("loc"))).alias("url")).where("url <> ''").groupBy(key, "url").agg(F.min("at").alias("at"))
    out = found.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("at"))).alias("position"), "url")
    return out if most is None else out.where(F.col("position") <= most)


def is_sitemap_index(xml: Column) -> Column:
    return xml.rlike(r"(?i)<sitemapindex\b")


def metadata(html: str | markup.Node | None, url: str | None) -> dict:
    """Title, description, image and date of a page (or its tree), with the usual fallbacks."""
    root = html if isinstance(html, markup.Node) else markup.parse(html)
    meta = {}
    for m in root.select("meta"):
        name = (m.attrs.get("property") or m.attrs.get("name") or "").lower()
        if name and (m.attrs.get("content") or "").strip():
            meta.setdefault(name, m.attrs["content"].strip())
    title, h1, time = root.first("title"), root.first("h1"), root.first("time[datetime]")
    image = meta.get("og:image") or meta.get("twitter:image")
    image = urljoin(url or "", image) if image else None
    return {
        "title": meta.get("og:title") or markup.collapsed(title.text() if title else None) or markup.collapsed(h1.text() if h1 else None),
        "description": meta.get("og:description") or meta.get("description") or meta.get("twitter:description"),
        "image": image if image and re.match(r"https?://", image) else None,
        "published": meta.get("article:published_time") or meta.get("date") or (time.attrs.get("datetime") if time else None),
    }


def article(html: str | markup.Node | None, most: int | None = None) -> tuple[str | None, str]:
    """The text of the article (article, main, or the block with most paragraph text), else of the page, and which.
    ``most``: cut to so many characters, with a mark, where one page is the answer of a tool (there 50,000)."""
    root = html if isinstance(html, markup.Node) else markup.parse(html)
    best = root.first("article") or root.first("main") or root.first("[role=main]")
    method = "article"
    if best is None:
        score: dict = {}
        for p in root.select("p"):
            score[p.parent] = score.get(p.parent, 0) + len(p.text())
        best, method = max(score, key=score.get, default=None), "paragraphs"
    if best is None or len(best.text(GONE).strip()) < 40:
        best, method = root, "page"
    text = markup.collapsed(best.text(GONE))
    return (text if text is None or most is None or len(text) <= most else text[:most] + T.TRUNCATED), method


def read_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", most: int | None = None) -> DataFrame:
    """Metadata and text of every page in one Arrow pass; a page's tree is made once."""
    fields = ["title", "description", "image", "published"]

    def run(batches):
        for b in batches:
            rows = []
            for k, u, h in zip(b[key], b[url], b[html], strict=True):
                root = markup.parse(h)
                found = metadata(root, u)
                rows.append((k, u, *[found[f] for f in fields], *article(root, most)))
            yield pd.DataFrame(rows, columns=[key, "url", *fields, "text", "method"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, url, html).mapInPandas(run, f"{key} {kind}, url string, title string, description string, image string, published string, text string, method string")


def select_nodes(pages: DataFrame, selectors: dict[str, str], key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, field, position, value): the texts that CSS selectors (the subset of ``markup``) find."""

    def run(batches):
        for b in batches:
            rows = []
            for k, h in zip(b[key], b[html], strict=True):
                root = markup.parse(h)
                rows += [(k, name, i, markup.collapsed(n.text())) for name, s in selectors.items() for i, n in enumerate(root.select(s))]
            yield pd.DataFrame(rows, columns=[key, "field", "position", "value"])

    return pages.select(key, html).mapInPandas(run, f"{key} {pages.schema[key].dataType.simpleString()}, field string, position int, value string")


def select_xpath(pages: DataFrame, paths: dict[str, str], key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, field, position, value): the texts that XPath expressions (those of the standard library's trees) find."""
    from xml.etree import ElementTree as E

    def tree(top: markup.Node) -> E.Element:
        made, left = {}, [top]
        while left:
            node = left.pop()
            out, last = E.Element(node.tag, {k: v or "" for k, v in node.attrs.items()}) if node is top else made.pop(id(node)), None
            first = out if node is top else None
            for c in node.children:
                if not isinstance(c, str):
                    last = made[id(c)] = E.SubElement(out, c.tag, {k: v or "" for k, v in c.attrs.items()})
                    left.append(c)
                elif last is None:
                    out.text = (out.text or "") + c
                else:
                    last.tail = (last.tail or "") + c
            root = first if first is not None else root
        return root

    def run(batches):
        for b in batches:
            rows = []
            for k, h in zip(b[key], b[html], strict=True):
                root = tree(markup.parse(h))
                rows += [(k, name, i, markup.collapsed("".join(n.itertext()))) for name, p in paths.items() for i, n in enumerate(root.findall(p))]
            yield pd.DataFrame(rows, columns=[key, "field", "position", "value"])

    return pages.select(key, html).mapInPandas(run, f"{key} {pages.schema[key].dataType.simpleString()}, field string, position int, value string")


#: Selectors of a trending page's and a tweet list's parts, tried in order (fixed values).
TRENDING = {
    "row": ["article.Box-row", "article[class*=Box-row]", "article.border"],
    "link": ["h2 a", "h1 a", "h2 a[href]"],
    "description": ["p", "p.col-9"],
    "language": ["[itemprop=programmingLanguage]"],
    "stars": ["a[href$=stargazers]"],
    "forks": ["a[href$=forks]", "a[href$=/network/members]"],
    "today": ["span.d-inline-block.float-sm-right", "span.float-sm-right", "span[class*=float-sm-right]"],
}
TWEETS = {
    "row": [".timeline-item", ".tweet-body", ".tweet-item", ".post"],
    "content": [".tweet-content", ".tweet-text", ".content"],
    "date": [".tweet-date a", ".tweet-date", "time", ".timestamp"],
    "handle": [".username", ".handle"],
    "author": [".fullname", ".display-name"],
    "likes": [".icon-heart", ".likes"],
    "retweets": [".icon-retweet", ".retweets"],
    "replies": [".icon-comment", ".replies"],
    "link": [".tweet-link", ".tweet-date a"],
}


def _found(node: markup.Node, selectors: list[str]) -> list[markup.Node]:
    return next((got for s in selectors if (got := list(node.select(s)))), [])


def _text(nodes: list[markup.Node]) -> str:
    return "".join(n.text() for n in nodes).strip()


def trending(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Repositories of trending pages: rank, owner, repo, url, description, language, stars, forks, today; rows without
    a valid owner and name are left out. Markup in one Arrow pass, numbers by expression."""
    fields = ["href", "description", "language", "stars", "forks", "today"]

    def run(batches):
        for b in batches:
            rows = []
            for k, h in zip(b[key], b[html], strict=True):
                for i, a in enumerate(_found(markup.parse(h), TRENDING["row"])):
                    link = _found(a, TRENDING["link"])
                    texts = [_text(_found(a, TRENDING[f])) for f in fields[1:5]]
                    rows.append((k, i, (link[0].attrs.get("href") or "") if link else "", *texts, _text(_found(a, TRENDING["today"])[-1:])))
            yield pd.DataFrame(rows, columns=[key, "at", *fields])

    df = pages.select(key, html).mapInPandas(run, f"{key} {pages.schema[key].dataType.simpleString()}, at int, " + ", ".join(f"{f} string" for f in fields))
    parts = F.split(F.regexp_replace("href", r"^/", ""), "/")
    name, n = r"^[a-zA-Z0-9](?:[a-zA-Z0-9-]*[a-zA-Z0-9])?$", lambda c: F.coalesce(F.regexp_extract(F.replace(F.col(c), F.lit(","), F.lit("")), r"(\d+)", 1).try_cast("long"), F.lit(0))
    df = df.withColumns({"owner": F.trim(F.get(parts, F.lit(0))), "repo": F.trim(F.get(parts, F.lit(1)))}).where(F.col("owner").rlike(name) & F.col("repo").rlike(name))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("at")).alias("rank")
    return df.select(key, rank, "owner", "repo", F.concat(F.lit("https://github.com/"), "owner", F.lit("/"), "repo").alias("url"), "description", "language", *[n(c).alias(c) for c in ("stars", "forks", "today")])


def tweets(pages: DataFrame, base: str, key: str = "page_id", html: str = "html", most: int | None = 1000) -> DataFrame:
    """Posts of timeline pages: position, author, handle, content (cut to ``most`` characters, with a mark), url,
    timestamp, likes, retweets, replies; posts without text are left out."""
    counts = ["likes", "retweets", "replies"]

    def run(batches):
        for b in batches:
            rows = []
            for k, h in zip(b[key], b[html], strict=True):
                for i, t in enumerate(_found(markup.parse(h), TWEETS["row"])):
                    date, link = _found(t, TWEETS["date"]), _found(t, TWEETS["link"])
                    # The counts stand beside their icons.
                    beside = [_text([n.parent for n in _found(t, TWEETS[c])]) for c in counts]
                    title = date[0].attrs.get("title") if date else None
                    rows.append((k, i, _text(_found(t, TWEETS["author"])[:1]), _text(_found(t, TWEETS["handle"])[:1]), _text(_found(t, TWEETS["content"])), (link[0].attrs.get("href") or "") if link else "", title if title is not None else _text(date), *beside))
            yield pd.DataFrame(rows, columns=[key, "position", "author", "handle", "content", "href", "timestamp", *counts])

    df = pages.select(key, html).mapInPandas(run, f"{key} {pages.schema[key].dataType.simpleString()}, position int, author string, handle string, content string, href string, timestamp string, " + ", ".join(f"{c} string" for c in counts))
    url = F.when(F.col("href") == "", "").otherwise(U.absolute(F.col("href"), base))
    number = lambda c: N.with_suffix(F.regexp_extract(F.replace(F.col(c), F.lit(","), F.lit("")), r"([\d.]+[KkMm]?)", 1)).alias(c)
    return df.where("content <> ''").select(key, "position", "author", "handle", (F.col("content") if most is None else T.truncated(F.col("content"), most)).alias("content"), url.alias("url"), F.nullif("timestamp", F.lit("")).alias("timestamp"), *[number(c) for c in counts])


def seed_budgets(seeds: DataFrame, most: int, order: str = "position", group: tuple[str, ...] = (), found: str | None = None) -> DataFrame:
    """``seeds`` with the share of ``most`` pages that each gets (``budget``): what is left, divided by the seeds still to
    come and rounded up, at least one; seeds after the last page get none.

    Without ``found`` every seed uses its share up. With the column of pages that a seed finds, it keeps (``kept``) no
    more than these, and what it leaves goes to the seeds after it; seeds that find nothing (or null) count as seeds to
    come and are left out. Each other one takes a page at least, so the fold of a group holds ``most`` seeds at most,
    however many there are. Groups may be null; equal places in ``order`` follow one another in any order."""
    if found is None:
        w = Window.partitionBy(*group)
        i, n = F.row_number().over(w.orderBy(order)) - 1, F.count("*").over(w)
        # Rounding up deals the remainder to the first seeds.
        share = F.floor(F.lit(most) / n) + (i < F.lit(most) % n).cast("long")
        return seeds.withColumn("budget", share.cast("long")).where("budget > 0")

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        left, out = most, []
        for r in rows.sort_values("row").itertuples(index=False):
            if left <= 0:
                break
            share = -(-left // (r.seeds - r.before)) if left > r.seeds - r.before else 1
            kept = min(share, r.found)
            left -= kept
            out.append((r.row, share, kept))
        return pd.DataFrame(out, columns=["_row", "budget", "kept"])

    rows = numbered(seeds, *group, order, name="_row")
    keys = [f"key{k}" for k in range(len(group))]
    narrow = rows.select(F.col("_row").alias("row"), F.col(f"`{found}`").cast("long").alias("found"), *[F.col(f"`{g}`").alias(k) for g, k in zip(group, keys, strict=True)])
    sizes = narrow.groupBy(*[F.col(k).alias(f"of_{k}") for k in keys]).agg(F.min("row").alias("first"), F.count("*").alias("seeds"))
    some = narrow.where("found > 0").join(sizes, [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys]) if keys else narrow.where("found > 0").crossJoin(F.broadcast(sizes))
    some = some.select("first", "row", "seeds", (F.col("row") - F.col("first")).alias("before"), F.least("found", F.lit(most)).alias("found"))
    some = some.withColumn("n", F.row_number().over(Window.partitionBy("first").orderBy("row"))).where(F.col("n") <= most)
    shares = some.groupBy("first").applyInPandas(fold, "_row long, budget long, kept long")
    return rows.join(shares, "_row").drop("_row")


def crawl_seeds(pages: DataFrame, seeds: DataFrame, most: int, order: str = "page_id", prefix: bool = True) -> DataFrame:
    """The pages (url, text, ...) of a crawl table that crawls from several seeds (position, seed) keep: each seed's own
    page first, then those directly below it (on its host, without ``prefix``), once by URL and once by content within
    the seed, up to its share of ``most`` pages; pages that a seed leaves over go to the next ones' shares. Of pages that
    several seeds keep, the first seed's stays, so there can be fewer than ``most``. Pages without text are no copies."""
    from_ = seeds.select("position", F.col("seed"), U.host(F.col("seed")).alias("_host"), F.regexp_replace(U.path(F.col("seed")), r"/+$", "").alias("_base"))
    own = pages.where(U.is_safe(F.col("url"))).withColumns({"_host": U.host(F.col("url")), "_way": F.regexp_replace(U.path(F.col("url")), r"/+$", "")})
    near = own.join(from_, "_host")
    if prefix:
        rest = F.expr("substring(_way, length(_base) + 2)")
        near = near.where((F.col("_way") == F.col("_base")) | (F.expr("startswith(_way, concat(_base, '/'))") & ~rest.contains("/") & (rest != "")))
    near = near.withColumn("_other", (F.col("url") != F.col("seed")).cast("int")).withColumnRenamed("position", "seed_position").drop("_host", "_way", "_base", "seed")
    by_url, by_text = U.normalized(F.col("url")), F.when(F.col("text") != "", F.sha2("text", 256))
    of_seed = lambda key: F.when(key != "", F.concat_ws(" ", F.col("seed_position").cast("string"), key))
    once = keep_first(near, of_seed(by_url), "_other", order)
    once = saved(keep_first(once, of_seed(by_text), "_other", order), "seeds")
    counts = once.groupBy("seed_position").agg(F.count("*").alias("_found"))
    found = from_.select(F.col("position").alias("seed_position")).join(counts, "seed_position", "left")
    shares = seed_budgets(found, most, "seed_position", found="_found").select("seed_position", "kept")
    ranked = once.withColumn("_n", F.row_number().over(Window.partitionBy("seed_position").orderBy("_other", order))).where(F.col("_n") <= most)
    kept = ranked.join(shares, "seed_position").where("_n <= kept").drop("_n", "kept")
    kept = keep_first(keep_first(kept, by_url, "seed_position", "_other", order), by_text, "seed_position", "_other", order)
    return kept.drop("_other")


def crawl(pages: DataFrame, seed: str, most: int | None = 100, budget: int | None = 250_000_000, prefix: bool = False, order: str = "page_id") -> DataFrame:
    """The pages of a crawl table that a crawl from ``seed`` would keep: safe URLs of its host, once by URL and once
    by content, the seed first, within the number of pages and characters (None for no bound)."""
    host = re.match(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", seed)
    df = pages.where(U.is_safe(F.col("url")) & (U.host(F.col("url")) == (host[1].lower() if host else "")))
    if prefix:
        df = df.where(U.under(F.col("url"), seed))
    df = keep_first(df, U.normalized(F.col("url")), order)
    df = keep_first(df, F.sha2("text", 256), order)
    df = df.withColumn("_other", (F.col("url") != seed).cast("int")).orderBy("_other", order)
    if most is not None:
        df = df.limit(most)
    if budget is None:
        return df.drop("_other")
    return prefix_budget(df, F.length(F.coalesce("text", F.lit(""))), budget, "_other", order, keep_one=True).drop("_other", "used")


def crawl_levels(links: DataFrame, seeds: DataFrame, depth: int = 2, strategy: str = "breadth", most: int | None = None) -> DataFrame:
    """(url, depth, position): the pages that a crawl reaches from ``seeds`` (url, position) along ``links`` (url, target,
    position) in at most ``depth`` (0 to 5) steps, numbered from 0 in the order of their visits, the first ``most`` of them.

    Each level is a join of the last one with the links, less all pages seen before, and a table of its own. A page has
    its least depth, and of the ways to it the first one by the links' positions; ``breadth`` goes level by level,
    ``depth`` goes below a page before it goes to the next one. Null urls and targets are nowhere; of equal seeds and links
    the first counts; a page that links to itself or back is not visited again."""
    if strategy not in ("breadth", "depth"):
        raise ValidationError("strategy must be breadth or depth")
    bounded("depth", depth, 0, 5)
    step = links.where("url IS NOT NULL AND target IS NOT NULL").groupBy("url", "target").agg(F.min(F.col("position").cast("long")).alias("step"))
    step = saved(step, "links")
    first = seeds.where("url IS NOT NULL").groupBy("url").agg(F.array(F.min(F.col("position").cast("long"))).alias("way"))
    level = seen = saved(first.withColumn("depth", F.lit(0)), "level")
    for d in range(1, depth + 1):
        found = level.join(step, "url").select(F.col("target").alias("url"), F.concat("way", F.array("step")).alias("way"))
        found = found.groupBy("url").agg(F.min("way").alias("way")).join(seen.select("url"), "url", "left_anti")
        level = saved(found.withColumn("depth", F.lit(d)), "level")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    order = ("depth", "way", "url") if strategy == "breadth" else ("way", "url")
    out = numbered(seen, *order).select("url", "depth", "position")
    return out if most is None else out.where(F.col("position") < most)


def text_pages(pages: DataFrame, key: str = "page_id", text: str = "text") -> DataFrame:
    """Pages with text that are not mostly a consent banner, each row judged by itself, whatever its key."""
    row = "_row"
    full = saved(pages.where(F.coalesce(F.col(text), F.lit("")) != "").withColumn(row, F.monotonically_increasing_id()), "text_pages")
    banner = hygiene.banner_ratio(full, row, text).where("ratio > 0.4").select(row)
    return full.join(banner, row, "left_anti").drop(row)

"""URL filters: rules, and link-graph propagation for the hosts that no rule judges.

Rules name a host and a path prefix; a rule fits its host and all subdomains, the longest fitting rule wins.

Propagation: every host has a share of pages that a block rule blocks and of pages that an allow rule allows.
Trust is a personalised PageRank from the allowed shares along the links between hosts; distrust is one from the
blocked shares along the reversed links, so it reaches the hosts that link to blocked ones. Both start from shares
and not from distributions, so a host's trust and distrust have one unit; what reaches a host without links ends
there. A page without a rule is blocked when its host's distrust exceeds its trust by ``threshold`` times the mean
distrust of the hosts that have any (so the verdict does not depend on the size of the graph), otherwise allowed.

Links are the href attributes of the a and area tags outside of comments, scripts, styles, text areas and titles (a tag
ends at its first ``>``), resolved as a browser does: those that begin with a scheme and ``//``, or with ``//`` alone,
lead to the host named there; one with another scheme leads nowhere; every other one stays on the host of the first
base tag that names one, else on the page's own, whatever stands in its query. Links within a host carry nothing. Host edges are summed before any join, the table of verdicts is written
first, so the join to the pages is broadcast if small or split by the adaptive skew join.

Defined results: a null url or one without ``://`` has an empty host and path, matches no rule and is allowed; null
html has no links, html of any length is searched whole; rules of equal length fit one url only if they are equal,
and then the later one wins; repeated rows count as pages of their own; an empty table gives no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragspark.llm.shared import save

#: The rules of the contract: verdict, host, path.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
DAMPING, ROUNDS, THRESHOLD = 0.85, 10, 0.5
#: Links that name a host.
OUTWARD = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//"
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"
#: What is no markup: comments, and the content of some tags; and an attribute with what stands before it.
HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<(?:script|style|textarea|title)[\s>].*?(?:</(?:script|style|textarea|title)|\z)"
ATTRIBUTE = r"""[\s"'/][^\s"'>/=]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]*)"""
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, SMALL), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(verdict, rule) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(out)
    return out


def _href(tag: Column) -> Column:
    """The first href of a tag's text: its attributes are read one after the other, so none is found in another's value."""
    each = F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(0))
    own = F.get(F.filter(each, lambda x: x.rlike(r"""(?i)^[\s"'/]href\s*=""")), F.lit(0))
    return F.regexp_extract(own, r"""=\s*["']?\s*([^"'\s>]*)""", 1)


def host_edges(pages: DataFrame) -> DataFrame:
    """(source, target, n) between different hosts; ``pages`` has host and html."""
    read = pages.where(F.col("html").contains("//")).select("host", F.split(F.regexp_replace("html", HIDDEN, " "), "<").alias("tags"))
    tags = lambda names: F.transform(F.filter("tags", lambda t, i: (i > 0) & t.rlike(f"(?i)^(?:{names})[\\s/]")), lambda t: _href(F.substring_index(t, ">", 1)))
    # A link that starts with // takes the page's scheme, which the host does not depend on.
    named = lambda u: host_of(F.when(u.startswith("//"), F.concat(F.lit("x:"), u)).otherwise(u))
    base = F.get(F.filter(tags("base"), lambda u: u.rlike(OUTWARD)), F.lit(0))
    found = read.select("host", F.coalesce(named(base), F.lit("")).alias("base"), tags("a|area").alias("links"))
    target = lambda u: F.when(u.rlike(OUTWARD), named(u)).when(u.rlike(SCHEME) | (u == ""), "").otherwise(F.col("base"))
    links = found.select(F.col("host").alias("source"), F.explode(F.transform("links", target)).alias("target"))
    return links.where("source <> target AND source <> '' AND target <> ''").groupBy("source", "target").agg(F.count("*").alias("n"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, value): personalised PageRank from ``seeds`` (host, seed) along ``edges`` (source, target, n)."""
    start = seeds.where("seed > 0").select("host", ((1 - damping) * F.col("seed")).alias("start"))
    out = edges.groupBy("source").agg(F.sum("n").alias("all"))
    share = save(edges.join(out, "source").select("source", "target", (F.col("n") / F.col("all")).alias("share")), "shares")
    if share.isEmpty():
        return start.withColumnRenamed("start", "value")
    value = start.withColumnRenamed("start", "value")
    for i in range(rounds):
        moved = value.join(share, value["host"] == share["source"]).select(F.col("target").alias("host"), (damping * F.col("value") * F.col("share")).alias("value"))
        value = moved.unionByName(start.withColumnRenamed("start", "value")).groupBy("host").agg(F.sum("value").alias("value"))
        if i % 3 == 2 or i == rounds - 1:
            value = save(value, "ranks")
    return value


def judge(pages: DataFrame, rules=RULES, damping: float = DAMPING, rounds: int = ROUNDS, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust for every row of ``pages`` (page_id, url, html)."""
    # The html is read only for links that leave their host.
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    parts = parts.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    edges = save(host_edges(parts), "edges")
    share = lambda v: F.avg(F.coalesce((F.col("fit.verdict") == v).cast("double"), F.lit(0.0)))
    seeds = save(parts.where("host <> ''").groupBy("host").agg(share("allow").alias("trusted"), share("block").alias("blocked")), "seeds")
    trust = propagate(seeds.select("host", F.col("trusted").alias("seed")), edges, damping, rounds)
    distrust = propagate(seeds.select("host", F.col("blocked").alias("seed")), edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "n"), damping, rounds)
    both = trust.select("host", F.col("value").alias("trust"), F.lit(0.0).alias("distrust")).unionByName(distrust.select("host", F.lit(0.0).alias("trust"), F.col("value").alias("distrust")))
    hosts = save(both.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")), "hosts")
    out = parts.drop("html").join(hosts, "host", "left")
    mean = hosts.where("distrust > 0").agg(F.avg("distrust")).collect()[0][0] or 0.0
    # Rounded, so that the order of a sum decides nothing.
    over = F.round(F.coalesce("distrust", F.lit(0.0)) - F.coalesce("trust", F.lit(0.0)) - threshold * mean, 9)
    verdict = F.coalesce("fit.verdict", F.when((over >= 0) & (F.coalesce("distrust", F.lit(0.0)) > 0), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))

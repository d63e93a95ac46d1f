"""URL expressions, all by regular expression, so that any engine with the same dialect agrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that do not change a page (fixed values).
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "fbclid", "gclid", "gclsrc", "dclid", "ref", "source", "mc_cid", "mc_eid"]
#: Hosts that are never fetched (fixed values).
BLOCKED = ["localhost", "127.0.0.1", "[::1]", "0.0.0.0", "metadata.google.internal"]
PRIVATE = r"^(10\.\d+\.\d+\.\d+|172\.(1[6-9]|2\d|3[01])\.\d+\.\d+|192\.168\.\d+\.\d+|169\.254\.\d+\.\d+|0\.\d+\.\d+\.\d+)$"
WHOLE = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+"
#: Job boards by host (fixed values), in the order of their reliability.
JOB_HOSTS = [("seek", r"^([^.]+\.)*seek\.(com\.au|co\.nz|com)$"), ("indeed", r"^([^.]+\.)*indeed\.com$"), ("jora", r"^([^.]+\.)*jora\.com$")]
RELIABILITY = {"seek": 0, "indeed": 1, "jora": 2, "other": 3}


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def host(url: Column) -> Column:
    """Lower case, without user and port."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))


def domain(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def normalized(url: Column) -> Column:
    """For dedup: host in lower case without www., no default port, no trailing slash but the root's, no fragment, no
    tracking parameter. A malformed URL is lower-cased without trailing slashes; null or empty is empty."""
    port = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(?:\[[^\]]*\]|[^/?#:]*):(\d+)", 1)
    plain = (port == "") | ((scheme(url) == "http") & (port == "80")) | ((scheme(url) == "https") & (port == "443"))
    way = path(url)
    way = F.when(way == "", F.lit("/")).when((way != "/") & way.endswith("/"), F.regexp_replace(way, r"/$", "")).otherwise(way)
    kept = F.array_join(F.filter(F.split(query(url), "&"), lambda p: (p != "") & ~F.lower(F.regexp_extract(p, r"^([^=]*)", 1)).isin(TRACKING)), "&")
    whole = F.concat(scheme(url), F.lit("://"), domain(url), F.when(plain, F.lit("")).otherwise(F.concat(F.lit(":"), port)), way, F.when(kept == "", F.lit("")).otherwise(F.concat(F.lit("?"), kept)))
    return F.when(url.isNull() | (url == ""), F.lit("")).when(url.rlike(WHOLE), whole).otherwise(F.regexp_replace(F.lower(url), r"/+$", ""))


def is_safe(url: Column) -> Column:
    """http or https, and no local, private or metadata host."""
    name = host(url)
    inner = F.regexp_replace(name, r"[\[\]]", "")
    private6 = name.startswith("[") & (inner.startswith("fe80") | inner.startswith("fc00") | inner.startswith("fd00"))
    return F.coalesce(url.rlike(WHOLE) & scheme(url).isin("http", "https") & (name != "") & ~name.isin(BLOCKED) & ~name.rlike(PRIVATE) & ~private6, F.lit(False))


def under(url: Column, seed: str) -> Column:
    """On the seed's host, at the seed's path or directly below it."""
    import re

    at = re.match(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)[^/?#]*([^?#]*)", seed)
    if not at:
        return F.lit(False)
    base = at[2].rstrip("/")
    way = F.regexp_replace(path(url), r"/+$", "")
    rest = F.substring(way, F.lit(len(base) + 2), F.length(way))
    child = way.startswith(base + "/") & ~rest.contains("/") & (rest != "")
    return (host(url) == at[1].lower()) & ((way == base) | child)


def video_id(text: Column) -> Column:
    """The eleven characters of a video id, alone or in any of the usual URLs; else null."""
    found = F.regexp_extract(text, r"^(?:https?://)?(?:www\.|m\.)?(?:youtube\.com/(?:watch\?(?:[^#]*&)?v=|shorts/|embed/|live/|v/)|youtu\.be/)([A-Za-z0-9_-]{11})(?![A-Za-z0-9_-])", 1)
    return F.when(text.rlike(r"^[A-Za-z0-9_-]{11}$"), text).when(found != "", found)


def absolute(link: Column, base: str | None) -> Column:
    """``link`` under ``base`` unless it is absolute already."""
    if base is None:
        return F.coalesce(link, F.lit(""))
    return F.when(link.isNull(), F.lit(base)).when(link.rlike(r"^https?://"), link).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(link, r"^/+", "")))


def job_source(url: Column) -> Column:
    out = F.lit("other")
    for name, pattern in reversed(JOB_HOSTS):
        out = F.when(host(url).rlike(pattern), F.lit(name)).otherwise(out)
    return out


def job_id(url: Column) -> Column:
    """The path segment after job or viewjob, else null."""
    found = F.regexp_extract(path(url), r"(?i)/(?:job|viewjob)/([^/]+)", 1)
    return F.when(found != "", F.try_url_decode(found))

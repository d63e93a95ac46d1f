"""Page hygiene: banners, quality, boilerplate, shared lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragspark.functions.text import trimmed
from ragspark.functions.vectors import let

#: Phrases of consent banners (fixed values), matched without regard to case.
BANNER_EXACT = [
    "OneTrust",
    "Cookiebot",
    "cookie consent",
    "Your Privacy Choices",
    "Manage Cookies",
    "Accept All Cookies",
    "We use cookies to",
    "By continuing to use this site",
    "Cookie-Einstellungen",
    "Alle Cookies akzeptieren",
    "Accepter les cookies",
    "Paramètres de cookies",
    "Aceptar cookies",
    "Configuraci[oó]n de cookies",
]
#: Words of a banner's lines and of its buttons (fixed values).
BANNER_WORDS = r"(?i)\b(cookie|cookies|consent|privacy|tracking|gdpr|ccpa)\b|datenschutz|confidentialit[eé]|privacidad"
BANNER_BUTTONS = r"(?i)\b(accept|reject|manage)\b|akzeptieren|accepter|aceptar|param[eè]tres|configuraci[oó]n|einstellungen"
#: Texts of pages that are still loading (fixed values).
PLACEHOLDERS = r"(?i)^(loading\.?\.?\.?|please wait|just a moment|enable javascript|you need to enable javascript|this page requires javascript|loading content)$"
LINK = r"\[([^\]]+)\]\(([^)]+)\)"


def banner_ratio(pages: DataFrame, key: str, text: str) -> DataFrame:
    """(key, lines, banner_lines, ratio): exact lines, and the other lines of runs of three or more keyword lines
    that hold a button word. Blank lines do not count. One fold over each page's own lines, without a shuffle; pages
    without lines have no row."""
    exact = lambda x: x.rlike("(?i)" + "|".join(BANNER_EXACT))
    flags = F.transform(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"\S")), lambda x: F.struct(exact(x).alias("exact"), x.rlike(BANNER_WORDS).alias("word"), x.rlike(BANNER_BUTTONS).alias("button")))
    zero = F.struct(F.lit(0).alias("done"), F.lit(0).alias("n"), F.lit(0).alias("exact"), F.lit(False).alias("button"))
    total = lambda a: a["done"] + F.when((a["n"] >= 3) & a["button"], a["n"]).otherwise(a["exact"])

    def step(a: Column, x: Column) -> Column:
        more = F.struct(a["done"].alias("done"), (a["n"] + 1).alias("n"), (a["exact"] + x["exact"].cast("int")).alias("exact"), (a["button"] | x["button"]).alias("button"))
        return F.when(x["exact"] | x["word"], more).otherwise(F.struct(total(a).alias("done"), F.lit(0).alias("n"), F.lit(0).alias("exact"), F.lit(False).alias("button")))

    count = lambda n, hits: F.struct(n.cast("long").alias("lines"), hits.cast("long").alias("banner_lines"))
    some = F.col(text).rlike("(?i)" + "|".join([*BANNER_EXACT, BANNER_WORDS.removeprefix("(?i)")]))  # most pages have no such word at all
    folded = let(flags, lambda f: count(F.size(f), F.aggregate(f, zero, step, total)))
    found = F.when(some, folded).otherwise(count(F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"\S"))), F.lit(0)))
    out = pages.select(key, found.alias("_b")).where("_b.lines > 0").select(key, "_b.lines", "_b.banner_lines")
    return out.withColumn("ratio", F.col("banner_lines") / F.col("lines"))


def quality(text: Column) -> Column:
    """meaningful, empty, placeholder or little."""
    plain = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    shaped = text.rlike(r"(^|\n)#{1,6}\s|(^|\n)([-*+]\s|\d+\.\s)|\|.*\|")
    return F.when(plain == "", "empty").when(plain.rlike(PLACEHOLDERS), "placeholder").when((F.length(plain) < 40) & ~F.coalesce(shaped, F.lit(False)), "little").otherwise("meaningful")


def _words(lines: Column) -> Column:
    return F.aggregate(lines, F.lit(0), lambda n, x: n + F.size(F.regexp_extract_all(x, F.lit(r"\S+"), F.lit(0))))


def link_chars(text: Column) -> Column:
    return F.aggregate(F.regexp_extract_all(text, F.lit(f"({LINK})"), F.lit(1)), F.lit(0), lambda n, x: n + F.length(x))


def is_list_line(line: Column) -> Column:
    """A dash, star or plus, or a number with a dot, then a space."""
    return line.rlike(r"^\s*[-*+]\s|^\s*\d+\.\s")


def is_breadcrumb(line: Column) -> Column:
    plain = trimmed(line)
    return (F.length(plain) > 0) & (link_chars(plain) / F.greatest(F.length(plain), F.lit(1)) > 0.8) & plain.contains(">")


def is_pure_link(line: Column) -> Column:
    plain = trimmed(line)
    return (F.length(plain) > 0) & (F.length(F.regexp_extract(plain, f"({LINK})", 1)) / F.greatest(F.length(plain), F.lit(1)) > 0.8)


def line_stats(text: Column, context: bool = False) -> Column:
    """Struct of the densities that the boilerplate rules use; divisions by zero give null. With ``context`` those of
    breadcrumbs and of lines that are links only, too. Text and lines are made once and gone through once."""

    def count(test) -> Column:
        return lambda lines: F.size(F.filter(lines, test))

    def stats(p: Column) -> Column:
        plain, lines, n = p["plain"], p["lines"], F.nullif(F.size(p["lines"]), F.lit(0))
        links = lambda x: x.contains("](")  # noqa: E731  so that most lines need no search
        more = [(count(lambda x: links(x) & is_breadcrumb(x))(lines) / n).alias("breadcrumb_density"), (count(lambda x: links(x) & is_pure_link(x))(lines) / n).alias("pure_link_density")] if context else []
        return F.struct(
            F.size(lines).alias("lines"),
            (F.when(links(plain), link_chars(plain)).otherwise(F.lit(0)) / F.nullif(F.length(plain), F.lit(0))).alias("link_density"),
            (count(is_list_line)(lines) / n).alias("list_density"),
            (count(lambda x: F.length(x) < 40)(lines) / n).alias("short_density"),
            (_words(lines) / n).alias("words_per_line"),
            *more,
            plain.contains("```").alias("code"),
        )

    plain = trimmed(F.coalesce(text, F.lit("")))
    return let(plain, lambda t: let(F.struct(t.alias("plain"), F.filter(F.split(t, "\n"), lambda x: x.rlike(r"\S")).alias("lines")), stats))


def is_boilerplate(s: Column) -> Column:
    """By ``line_stats``: no text, mostly links, or a menu; code never."""
    menu = (s["list_density"] > 0.6) & (s["short_density"] > 0.7) & (s["link_density"] > 0.2)
    bare = (s["list_density"] > 0.7) & (s["short_density"] > 0.8) & (s["words_per_line"] < 3)
    return (s["lines"] == 0) | (~s["code"] & ((s["link_density"] > 0.5) | menu | bare))


def is_boilerplate_in_context(s: Column) -> Column:
    return is_boilerplate(s) | (s["breadcrumb_density"] > 0.5) | ((s["words_per_line"] < 3) & (s["pure_link_density"] > 0.3))


def is_borderline(s: Column) -> Column:
    return F.coalesce(((s["link_density"] >= 0.2) & (s["link_density"] < 0.4)) | ((s["words_per_line"] >= 3) & (s["words_per_line"] < 5)), F.lit(False))


def line_key(line: Column) -> Column:
    """The form in which lines are compared; null for blank and for long lines."""
    key = F.lower(trimmed(line))
    return F.when((F.length(key) > 0) & (F.length(key) <= 200), key)


def shared_lines(parts: DataFrame, page: str, part: str, text: str, least: int = 2) -> DataFrame:
    """(page, line, n): short lines in ``least`` parts of a page or more. A part sends each line once."""
    each = parts.select(page, F.explode(F.array_distinct(F.filter(F.transform(F.split(text, "\n"), line_key), lambda x: x.isNotNull()))).alias("line"))
    return each.groupBy(page, "line").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def without_shared(parts: DataFrame, page: str, part: str, text: str) -> DataFrame:
    """``parts`` with their shared lines removed."""
    drop = shared_lines(parts, page, part, text).groupBy(page).agg(F.collect_set("line").alias("_drop"))
    kept = F.filter(F.split(text, "\n"), lambda x: line_key(x).isNull() | ~F.array_contains(F.coalesce("_drop", F.array().cast("array<string>")), line_key(x)))
    return parts.join(drop, page, "left").withColumn(text, F.array_join(kept, "\n")).drop("_drop")


#: Patterns for entities in text.
ENTITY_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "ipv4": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "phone": r"\+\d[\d -]{7,}\d",
    "hex": r"\b[0-9a-f]{32,}\b",
    "url": r"https?://[^\s<>\"']+",
    "uuid": r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b",
    "iso_date": r"\b\d{4}-\d{2}-\d{2}\b",
    "us_date": r"\b\d{1,2}/\d{1,2}/\d{2,4}\b",
    "time": r"\b\d{1,2}:\d{2}(?::\d{2})?\b",
    "currency": r"[$€£]\s?\d[\d,]*(?:\.\d+)?",
    "percent": r"\b\d+(?:\.\d+)?%",
    "number": r"\b\d+(?:\.\d+)?\b",
    "hashtag": r"#[A-Za-z]\w*",
    "handle": r"@[A-Za-z]\w+",
    "mac": r"\b(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}\b",
    "hex_colour": r"#[0-9a-fA-F]{6}\b",
    "postcode_us": r"\b\d{5}(?:-\d{4})?\b",
    "iban": r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b",
    "card": r"\b(?:\d{4}[ -]?){3}\d{4}\b",
    "ipv6": r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b",
    "phone_us": r"\b\d{3}-\d{3}-\d{4}\b",
}


def entities(df: DataFrame, key: str, text: str, kinds: list[str] | None = None, custom: dict[str, str] | None = None) -> DataFrame:
    """(key, kind, value, n) for the built-in kinds (all by default) and custom patterns."""
    chosen = {k: ENTITY_PATTERNS[k] for k in kinds or (ENTITY_PATTERNS if custom is None else [])} | (custom or {})
    found = F.explode(F.flatten(F.array(*[_tagged(text, k, p) for k, p in chosen.items()]))).alias("e")
    return df.select(key, found).groupBy(key, F.col("e.kind").alias("kind"), F.col("e.value").alias("value")).agg(F.count("*").alias("n"))


def _tagged(text: str, kind: str, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({pattern})"), F.lit(1)), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

"""Text expressions."""

from __future__ import annotations

import html
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

TRUNCATED = "... [truncated]"
#: Named entities that are decoded besides numeric ones (fixed values).
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")]
#: Endings that separate a page title from its site's name (fixed values).
SITE_SEPARATORS = [" - ", " | ", " — ", " – "]


def tokens(text: Column) -> Column:
    """ASCII word runs, lower-cased."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\w+"), F.lit(0)), F.lower)


def trimmed(text: Column) -> Column:
    """Without white space (of any kind) at either end."""
    return F.regexp_replace(F.regexp_replace(text, r"^\s+", ""), r"\s+$", "")


def collapsed(text: Column) -> Column:
    """White space runs as one space, trimmed; null when nothing is left."""
    out = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(out != "", out)


def token_estimate(text: Column) -> Column:
    """A token per four characters, rounded up."""
    return F.ceil(F.length(text) / 4)


def truncated(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(TRUNCATED))).otherwise(text)


def decoded(text: Column) -> Column:
    """Named entities decoded; the ampersand last, so nothing is decoded twice."""
    for entity, value in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(value))
    return text


def by_arrow(f):
    """A function of one string as an Arrow-batched expression; nulls stay."""
    return F.pandas_udf(lambda s: s.map(lambda x: None if x is None else f(x)), StringType(), F.PandasUDFType.SCALAR)


def decoded_numeric(text: Column) -> Column:
    """All entities decoded, numeric ones too; Python runs only on rows that hold ``&#``."""
    return F.when(text.contains("&#"), by_arrow(html.unescape)(F.when(text.contains("&#"), text))).otherwise(decoded(text))


def stripped_html(page: Column) -> Column:
    """Tags as spaces, scripts and styles gone, entities decoded, white space collapsed."""
    bare = F.regexp_replace(page, r"(?is)<(script|style|noscript)\b.*?</\1\s*>", " ")
    return collapsed(decoded(F.regexp_replace(bare, r"(?s)<[^>]*>", " ")))


def without_site(title: Column) -> Column:
    """The title before the last separator of the first kind it holds."""
    text = collapsed(title)
    out = text
    for mark in reversed(SITE_SEPARATORS):
        before = F.length(text) - F.length(F.substring_index(text, mark, -1)) - len(mark)
        out = F.when(text.contains(mark) & (before > 0), F.trim(F.substring(text, F.lit(1), before))).otherwise(out)
    return out


def normalized_title(title: Column) -> Column:
    """Lower case, LaTeX commands reduced to their argument, math and punctuation gone, spaces collapsed."""
    text = F.regexp_replace(F.lower(title), r"\\[a-zA-Z]+\{([^}]*)\}", "$1")
    text = F.regexp_replace(F.regexp_replace(text, r"\$[^$]*\$", ""), r"[^a-z0-9\s]", "")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def composed(text: Column) -> Column:
    """Unicode NFC, which Spark has no expression for."""
    return by_arrow(lambda x: unicodedata.normalize("NFC", x))(text)


def first_author(author: Column) -> Column:
    """The surname: before the comma, or the last word."""
    text = F.trim(F.lower(author))
    return F.when(text.contains(","), F.trim(F.split_part(text, F.lit(","), F.lit(1)))).otherwise(F.regexp_extract(text, r"(\S*)$", 1))


def paper_identity(doi: Column, title: Column, author: Column) -> Column:
    """The DOI in lower case, else title and surname."""
    return F.coalesce(F.lower(F.when(doi != "", doi)), F.concat_ws("|", normalized_title(title), first_author(F.coalesce(author, F.lit("")))))


def megabytes(size: Column) -> Column:
    """Bytes as 3MB or 2.5MB."""
    mb = size / 1_000_000
    return F.when(mb == F.floor(mb), F.concat(F.floor(mb).cast("string"), F.lit("MB"))).otherwise(F.concat(F.format_number(mb, "0.0"), F.lit("MB")))

"""Content elements of HTML and Markdown: headings, texts, tables, images, code, lists, in document order."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ragspark.operators import markup

MOST, MOST_RAW, MOST_TEXT = 50, 1000, 10_000
MARK = "... [truncated]"
IGNORED = {"script", "style", "noscript", "svg", "nav", "header", "footer"}
BLOCKS = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "table", "ul", "ol", "pre", "blockquote"}
SCHEMA = (
    "position int, type string, level int, text string, element_id string, markdown string, caption string, n_rows int, n_cols int, src string, alt string, title string, "
    "language string, content string, ordered boolean, items array<string>, truncated boolean, original_length int"
)
FIELDS = [f.split()[0] for f in SCHEMA.split(", ")]
#: Ranks of the types when a page has too many elements; a heading's level counts too (fixed values).
RANKS = {"heading": 100, "table": 90, "code": 85, "list": 75, "image": 65, "text": 50}


def limited(made: list[dict], most: int | None, most_text: int | None) -> list[dict]:
    """At most ``most`` elements, and texts of at most ``most_text`` characters; an element that was cut says so."""
    made = made[:most]
    if most_text is None:
        return made
    out = []
    for e in made:
        texts = {f: v for f, v in e.items() if f in ("text", "markdown", "caption", "alt", "title", "content", "items") and v is not None}
        long = [v for f, t in texts.items() for v in (t if f == "items" else [t]) if len(v) > most_text]
        cut = lambda t: t if len(t) <= most_text else t[:most_text] + MARK
        out.append(e | {f: list(map(cut, t)) if f == "items" else cut(t) for f, t in texts.items()} | {"truncated": True, "original_length": max(map(len, long))} if long else e)
    return out


def _heading(n: markup.Node) -> dict | None:
    text = n.text().strip()
    anchor = n.first("a[id]")
    return {"type": "heading", "level": int(n.tag[1]), "text": text, "id": n.attrs.get("id") or (anchor.attrs.get("id") if anchor else None)} if text else None


def _table(n: markup.Node) -> dict:
    rows = [[c.text().strip() for c in r.walk() if c.tag in ("th", "td")] for r in n.walk() if r.tag == "tr"]
    cols = max(map(len, rows), default=0)
    lines = [f"| {' | '.join(r)} |" for r in rows]
    if lines:
        lines.insert(1, "|" + " --- |" * cols)
    caption, md = n.first("caption"), "\n".join(lines)
    return dict(type="table", markdown=md, caption=caption.text().strip() if caption else None, n_rows=len(rows), n_cols=cols)


def _image(n: markup.Node) -> dict:
    src = n.attrs.get("src")
    bad = src is not None and src.lower().startswith(("javascript:", "data:", "vbscript:"))
    return {"type": "image", "src": None if bad else src, "alt": n.attrs.get("alt") or "", "title": n.attrs.get("title") or ""}


def _code(n: markup.Node) -> dict:
    code = n.first("code")
    named = re.search(r"(?:language|lang)-(\w+)", (code.attrs.get("class") or "") if code else "")
    content = (code or n).text().strip()
    return dict(type="code", language=named[1] if named else None, content=content)


def _list(n: markup.Node) -> dict | None:
    items = [c.text().strip() for c in n.elements() if c.tag == "li"]
    return {"type": "list", "ordered": n.tag == "ol", "items": items} if items else None


def _text(n: markup.Node) -> dict | None:
    if n.parent.tag == "li" or n.inside({"table", "ul", "ol"}) or any(c.tag in BLOCKS for c in n.elements()):
        return None
    text = n.text().strip()
    return dict(type="text", text=text) if text else None


MAKERS = {f"h{i}": _heading for i in range(1, 7)} | {"table": _table, "img": _image, "pre": _code, "ul": _list, "ol": _list, "p": _text, "div": _text}


def from_html(html: str | None, most: int | None = MOST_RAW, most_text: int | None = MOST_TEXT) -> list[dict]:
    out = []
    for n in markup.parse(html).walk():
        if n.tag in MAKERS and not n.inside(IGNORED) and (made := MAKERS[n.tag](n)):
            out.append(made)
            if len(out) == most:
                break
    return limited(out, most, most_text)


ITEM = re.compile(r"^(?:[-*]|(\d+\.))\s+(.+)$")
ROW = re.compile(r"^\|.*\|$")
IMAGE = re.compile(r"!\[([^\]]*)\]\(\s*([^)\s]+)(?:\s+\"([^\"]*)\")?\s*\)")


def _plain(text: str) -> str:
    return re.sub(r"`([^`]+)`", r"\1", text)


def from_markdown(text: str | None, most: int | None = MOST_RAW, most_text: int | None = MOST_TEXT) -> list[dict]:
    """Line by line; fences, tables and lists take the lines that belong to them."""
    out, lines, at = [], (text or "").split("\n"), 0

    def take(more) -> list[str]:
        nonlocal at
        start = at
        while at < len(lines) and more(lines[at]):
            at += 1
        return lines[start:at]

    while at < len(lines) and (most is None or len(out) < most):
        line = lines[at].strip()
        if m := re.match(r"^(#{1,6})\s+(.+)$", line):
            out.append({"type": "heading", "level": len(m[1]), "text": m[2].strip()})
            at += 1
        elif m := re.match(r"^(`{3,})(\w*)", line):
            at += 1
            body = "\n".join(take(lambda x: not re.fullmatch(m[1] + "`*", x.strip()))).rstrip()
            out.append(dict(type="code", language=m[2], content=body))
            at += 1
        elif ROW.match(line):
            rows = [x.strip() for x in take(lambda x: ROW.match(x.strip()))]
            if len(rows) > 1 and re.fullmatch(r"\|[\s\-:|]+\|", rows[1]):
                del rows[1]
            md = "\n".join(rows)
            out.append(dict(type="table", markdown=md, n_rows=len(rows), n_cols=sum(bool(c.strip()) for c in rows[0].split("|"))))
        elif m := ITEM.match(line):
            items = []
            for x in take(lambda x: x.strip() and (ITEM.match(x.strip()) or x[0].isspace())):
                if i := ITEM.match(x.strip()):
                    items.append(_plain(i[2]))
                else:
                    items[-1] = f"{items[-1]} {_plain(x.strip())}"
            out.append({"type": "list", "ordered": m[1] is not None, "items": items})
        elif IMAGE.search(line):
            out += [{"type": "image", "src": src, "alt": alt, "title": title if title else None} for alt, src, title in IMAGE.findall(line)]
            at += 1
        else:
            if plain := _plain(line):
                out.append(dict(type="text", text=plain))
            at += 1
    return limited(out, most, most_text)


def extract(df: DataFrame, key: str, text: str, kind: str = "html", most: int | None = None, most_text: int | None = None, best: int | None = None) -> DataFrame:
    """A row per element: key, position and SCHEMA's fields. One Arrow pass, no shuffle. Whole, unless limits (a single
    answer's are MOST_RAW and MOST_TEXT) are given. With ``best``, of each row only as many of the highest rank, in document
    order and with ``omitted``, as ``finalized`` has them where a row is a key."""
    make = {"html": from_html, "markdown": from_markdown}[kind]
    fields = FIELDS[1:] if best is None else [*FIELDS[1:], "omitted"]

    def chosen(made: list[dict]):
        if best is None:
            return enumerate(made)
        over = {"omitted": max(len(made) - best, 0)}
        order = sorted(range(len(made)), key=lambda i: -RANKS.get(made[i]["type"], 0) - (7 - (made[i].get("level") or 0) if made[i]["type"] == "heading" else 0))
        return ((i, made[i] | over) for i in sorted(order[:best]))

    def run(batches):
        for b in batches:
            rows = [[k, i, *(e.get("id" if f == "element_id" else f) for f in fields)] for k, t in zip(b[key], b[text], strict=True) for i, e in chosen(make(t, most, most_text))]
            yield pd.DataFrame(rows, columns=[key, "position", *fields], dtype=object)

    return df.select(key, text).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, {SCHEMA}" + ("" if best is None else ", omitted long"))


def rank_of(kind: Column, level: Column) -> Column:
    out = F.lit(0)
    for name, value in RANKS.items():
        out = F.when(kind == name, value + (7 - level if name == "heading" else F.lit(0))).otherwise(out)
    return out


def merged(elements: DataFrame, page: str, group: str, most: int = MOST) -> DataFrame:
    """The elements of several pages (position within each) as one document per ``group``: truncated texts go and count
    as omitted, the others are cut to the ``most`` best in the order of pages and positions."""
    cut = (F.col("type") == "text") & F.coalesce(F.col("truncated"), F.lit(False))
    lost = elements.groupBy(group).agg(F.count_if(cut).alias("_lost"))
    rank = rank_of(F.col("type"), F.coalesce("level", F.lit(0)))
    w = Window.partitionBy(group)
    df = elements.where(~cut).withColumn("_n", F.row_number().over(w.orderBy(F.desc(rank), page, "position"))).withColumn("_over", F.greatest(F.count("*").over(w) - most, F.lit(0)))
    return df.where(F.col("_n") <= most).join(lost, group).withColumn("omitted", F.col("_over") + F.col("_lost")).drop("_n", "_over", "_lost")


def finalized(elements: DataFrame, key: str, most: int = MOST) -> DataFrame:
    """The ``most`` highest-ranked elements of each key in document order, with ``omitted``."""
    rank = rank_of(F.col("type"), F.coalesce("level", F.lit(0)))
    w = Window.partitionBy(key)
    df = elements.withColumn("_n", F.row_number().over(w.orderBy(F.desc(rank), "position"))).withColumn("omitted", F.greatest(F.count("*").over(w) - most, F.lit(0)))
    return df.where(F.col("_n") <= most).drop("_n")

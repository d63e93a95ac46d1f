"""Markdown to chunks: sections by heading, boilerplate out, short ones merged, long ones split with overlap.

Pages are chunked one by one in an Arrow pass; the work on a page is sequential by nature. Positions where a page may
be cut (blank lines, sentence ends, line ends) and the spans that must stay whole are collected once per section
group, and looked up by bisection."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from dataclasses import dataclass, replace
from itertools import pairwise

import pandas as pd
from pyspark.sql import DataFrame

MOST_TOKENS, LEAST_TOKENS, CHARS_PER_TOKEN, OVERLAP = 400, 50, 4, 0.2
SHARED_MOST = 200
LINK = re.compile(r"\[([^\]]+)\]\(([^)]+)\)")
SCHEMA = "chunk_index int, total_chunks int, content string, section string, page_title string, token_estimate int, char_offset int"


def tokens(text: str) -> int:
    return -(-len(text) // CHARS_PER_TOKEN)


@dataclass
class Section:
    path: str
    lines: list[str]
    tokens: int


@dataclass
class Chunk:
    content: str
    section: str
    offset: int


def sections(text: str) -> tuple[list[Section], str | None]:
    """Sections under H1 to H3 (the first H1 is the page's title, others and deeper headings are text)."""
    title, open_, out, fenced = None, None, [], False

    def start(depth: int, heading: str):
        nonlocal open_
        open_ = (depth, heading, [])
        out.append(open_)

    for line in text.split("\n"):
        fenced ^= line.lstrip().startswith("```")
        m = None if fenced else re.match(r"^(#{1,6})\s+(.*)$", line)
        depth = len(m[1]) if m else 0
        if depth == 1 and title is None:
            title = m[2].strip()
            start(2, "")
        elif depth in (2, 3):
            start(depth, m[2].strip())
        else:
            if open_ is None and depth != 1:
                start(2, "")
            if open_ is not None:
                open_[2].append(line)
    above: list[tuple[int, str]] = []
    made = []
    for depth, heading, lines in out:
        above = [a for a in above if a[0] < depth] + [(depth, heading)]
        path = " > ".join([f"# {title}"] * bool(title) + ["#" * d + (f" {h}" if h else "") for d, h in above])
        body = "\n".join(lines).strip()
        made.append(Section(path, body.split("\n") if body else [], tokens(body)))
    return made, title


def _key(line: str) -> str | None:
    key = line.strip().lower()
    return key if 0 < len(key) <= SHARED_MOST else None


def without_shared(parts: list[list[str]]) -> list[list[str]]:
    """Short lines that stand in two parts or more, removed from all."""
    seen = Counter(k for lines in parts for k in {_key(x) for x in lines} if k)
    return [[x for x in lines if seen[_key(x)] < 2] for lines in parts]


def is_breadcrumb(line: str) -> bool:
    plain = line.strip()
    return ">" in plain and sum(len(m[0]) for m in LINK.finditer(plain)) > 0.8 * len(plain)


def is_link_line(line: str) -> bool:
    plain = line.strip()
    m = LINK.search(plain)
    return bool(m) and len(m[0]) > 0.8 * len(plain)


def is_boilerplate(text: str, in_context: bool = False) -> bool:
    plain = text.strip()
    lines = [x for x in plain.split("\n") if x.strip()]
    if not lines:
        return True
    share = lambda test: sum(map(test, lines)) / len(lines)
    words = sum(len(x.split()) for x in lines) / len(lines)
    if "```" not in plain:
        links = sum(len(m[0]) for m in LINK.finditer(plain)) / len(plain)
        listed, short = share(lambda x: bool(re.match(r"\s*[-*+]\s|\s*\d+\.\s", x))), share(lambda x: len(x) < 40)
        if links > 0.5 or (listed > 0.6 and short > 0.7 and links > 0.2) or (listed > 0.7 and short > 0.8 and words < 3):
            return True
    return in_context and (share(is_breadcrumb) > 0.5 or (words < 3 and share(is_link_line) > 0.3))


def merged(found: list[Section]) -> list[list[Section]]:
    """Groups of at least LEAST_TOKENS: a short section joins what follows, the last one what is before."""
    groups, open_ = [], []
    for s in found:
        open_.append(s)
        if sum(x.tokens for x in open_) >= LEAST_TOKENS:
            groups.append(open_)
            open_ = []
    if open_:
        if groups:
            groups[-1] = groups[-1] + open_
        else:
            groups.append(open_)
    return groups


def whole_spans(text: str) -> list[tuple[int, int]]:
    """Fences, tables and indented code, which are not cut."""
    spans, at, lines = [], 0, text.split("\n")
    starts = [0]
    for x in lines:
        starts.append(starts[-1] + len(x) + 1)
    while at < len(lines):
        first, x = at, lines[at]
        if x.lstrip().startswith("```"):
            at += 1
            while at < len(lines) and not lines[at].lstrip().startswith("```"):
                at += 1
            at = min(at + 1, len(lines))
        elif x.lstrip().startswith("|"):
            while at < len(lines) and lines[at].lstrip().startswith("|"):
                at += 1
        elif x.startswith(("    ", "\t")):
            while at < len(lines) and (not lines[at] or lines[at].startswith(("    ", "\t"))):
                at += 1
        else:
            at += 1
            continue
        spans.append((starts[first], starts[at]))
    return spans


class Cuts:
    """Where a text may be cut: sorted places outside the whole spans."""

    def __init__(self, text: str):
        self.text, self.spans = text, whole_spans(text)
        self.begins = [a for a, _ in self.spans]
        free = lambda p: self.span(p) is None
        self.blank = [m.start() for m in re.finditer(r"\n(?=\n)", text) if free(m.start())]
        self.stops = [(m.start(), m.start() + (1 if m[0] == "\n" else 2)) for m in re.finditer(r"[.?!](?= )|\n(?!\n)", text) if free(m.start())]
        self.sentences = [m.start() for m in re.finditer(r"[.?!](?= )", text)]

    def span(self, place: int) -> tuple[int, int] | None:
        i = bisect_right(self.begins, place) - 1
        return self.spans[i] if i >= 0 and place < self.spans[i][1] else None

    def cut(self, start: int, target: int) -> int:
        i = bisect_right(self.blank, target) - 1
        if i >= 0 and self.blank[i] > start:
            return self.blank[i] + 1
        i = bisect_left(self.stops, (target, 0))
        if i < len(self.stops):
            return self.stops[i][1]
        inside = self.span(target)
        return min(inside[1], len(self.text)) if inside else target

    def restart(self, start: int, cut: int, overlap: int) -> int:
        """The sentence start that repeats about ``overlap`` characters before the cut, outside whole spans."""
        want = max(cut - overlap, start)
        reach = cut - want
        near = self.sentences[bisect_left(self.sentences, cut - 2 * reach - 1) : bisect_left(self.sentences, cut)]
        at = min(reversed(near), key=lambda p: abs(cut - (p + 2) - reach), default=want - 2) + 2
        if at >= cut or at <= start:
            return cut
        inside = self.span(at)
        return min(inside[1], cut) if inside else at


def split(text: str, path: str, base: int) -> list[Chunk]:
    if tokens(text) <= MOST_TOKENS:
        return [Chunk(text, path, base)] if text else []
    most, cuts, start, out = MOST_TOKENS * CHARS_PER_TOKEN, Cuts(text), 0, []
    while start < len(text):
        cut = cuts.cut(start, start + most) if len(text) - start > most else len(text)
        if cut <= start:
            cut = min(start + most, len(text))
        part = text[start:cut].strip()
        if part:
            out.append(Chunk(part, path, base + start))
        start = cuts.restart(start, cut, int(len(part) * OVERLAP)) if cut < len(text) else cut
    return out


def without_small(chunks: list[Chunk]) -> list[Chunk]:
    """Chunks below the floor join the one before; a first one joins the next."""
    out: list[Chunk] = []
    joined = -1
    for i, c in enumerate(chunks):
        if i == joined:
            continue
        if len(chunks) == 1 or tokens(c.content) >= LEAST_TOKENS:
            out.append(c)
        elif out:
            out[-1] = replace(out[-1], content=f"{out[-1].content}\n\n{c.content}")
        elif i + 1 < len(chunks):
            out.append(replace(c, content=f"{c.content}\n\n{chunks[i + 1].content}"))
            joined = i + 1
        else:
            out.append(c)
    return out


def in_context(chunks: list[Chunk]) -> list[tuple[Chunk, int]]:
    """(chunk, token estimate before the filter): shared and link lines out, then boilerplate; all as they were if
    nothing would be left."""
    sized = [(c, tokens(c.content)) for c in chunks]
    parts = [c.content.split("\n") for c in chunks]
    if len(parts) > 1:
        parts = [x if y == x else "\n".join(y).strip().split("\n") for x, y in zip(parts, without_shared(parts), strict=True)]
    kept = []
    for (c, n), lines in zip(sized, parts, strict=True):
        body = "\n".join(x for x in lines if not is_breadcrumb(x) and not is_link_line(x)).strip()
        if body and not is_boilerplate(body, in_context=True):
            kept.append((replace(c, content=body), n))
    return kept or sized


def chunk(text: str | None) -> tuple[list[tuple[Chunk, int]], str | None]:
    """The chunks of a page with their token estimates, and its title."""
    found, title = sections(text or "")
    if len(found) > 1:
        found = [replace(s, lines=x) for s, x in zip(found, without_shared([s.lines for s in found]), strict=True)]
    clean = [replace(s, lines=[x for x in s.lines if not is_breadcrumb(x) and not is_link_line(x)]) for s in found]
    kept = [s for s in clean if not is_boilerplate("\n".join(s.lines))] or found
    base, out = 0, []
    for group in merged(kept):
        body = "\n\n".join("\n".join(s.lines) for s in group).strip()
        out += split(body, group[-1].path, base)
        base += len(body) + 2
    return in_context(without_small(out)), title


def chunks(pages: DataFrame, key: str, text: str) -> DataFrame:
    """A row per chunk: key and SCHEMA's columns."""

    def run(batches):
        for b in batches:
            rows = []
            for k, t in zip(b[key], b[text], strict=True):
                made, title = chunk(t)
                rows += [(k, i, len(made), c.content, c.section, title, n, c.offset) for i, (c, n) in enumerate(made)]
            yield pd.DataFrame(rows, columns=[key, "chunk_index", "total_chunks", "content", "section", "page_title", "token_estimate", "char_offset"])

    return pages.select(key, text).mapInPandas(run, f"{key} {pages.schema[key].dataType.simpleString()}, {SCHEMA}")


def covered(text: str, made: list[Chunk]) -> bool:
    """Whether neighbouring chunks touch or overlap, for tests."""
    return all(b.offset <= a.offset + len(a.content) + 2 for a, b in pairwise(made))

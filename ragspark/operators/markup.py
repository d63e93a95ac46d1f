"""A small document tree on the standard library's HTML parser, forgiving about unclosed tags."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from html.parser import HTMLParser

#: Tags whose inside is asked for.
NOTED = {"script", "style", "noscript", "svg", "nav", "header", "footer", "table", "ul", "ol"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: A start tag closes these open ones, up to the given containers.
CLOSES = {"li": ({"li"}, {"ul", "ol"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
ENDS_PARAGRAPH = {"p", "div", "ul", "ol", "table", "pre", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "nav", "header", "footer", "main", "aside", "form", "hr"}


class Node:
    __slots__ = ("attrs", "children", "last", "order", "parent", "place", "tag", "within")

    def __del__(self):
        # Trees are freed level by level: a deep one would overflow the interpreter's stack.
        left = self.children
        self.children = []
        while left:
            n = left.pop()
            if isinstance(n, Node):
                left += n.children
                n.children = []

    def __init__(self, tag: str, attrs: dict[str, str | None] | None = None, parent: Node | None = None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs or {}, parent, []
        # The noted tags among the ancestors, shared with the parent where nothing is added.
        self.within = frozenset() if parent is None else parent.within if parent.tag not in NOTED or parent.tag in parent.within else parent.within | {parent.tag}
        # A tree's nodes are made in document order, so those below one follow it, up to its ``last`` (told by ``parse``).
        self.order = [] if parent is None else parent.order
        self.place = self.last = len(self.order)
        self.order.append(self)

    def walk(self) -> Iterator[Node]:
        """All elements below, in document order, however deep."""
        return iter(self.order[self.place + 1 : self.last + 1])

    def text(self, without: frozenset[str] = frozenset()) -> str:
        if len(self.children) == 1 and isinstance(self.children[0], str):
            return self.children[0]
        out, left = [], self.children[::-1]
        while left:
            c = left.pop()
            if isinstance(c, str):
                out.append(c)
            elif c.tag not in without:
                left += c.children[::-1]
        return "".join(out)

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def inside(self, tags: frozenset[str] | set[str]) -> bool:
        """Whether an ancestor is one of ``tags``, which are among NOTED."""
        return not self.within.isdisjoint(tags)

    def first(self, selector: str) -> Node | None:
        return next(self.select(selector), None)

    def select(self, selector: str) -> Iterator[Node]:
        """A subset of CSS: tag, .class, #id, [attr], [attr=value] (also ^=, $=, *=), joined, with spaces for descent and
        commas."""
        return filter(_test(selector), self.walk())


@lru_cache(1024)
def _test(selector: str) -> Callable[[Node], bool]:
    ways = [[_simple(s) for s in way.split()] for way in selector.split(",")]
    if len(ways) == len(ways[0]) == 1:
        return ways[0][0]
    return lambda n: any(_fits(n, way) for way in ways)


def _simple(text: str):
    tag = re.match(r"[A-Za-z][\w-]*|\*?", text)[0].lower()
    tests = []
    for kind, name, attr, op, value in re.findall(r"([.#])([\w-]+)|\[([\w-]+)(?:([\^$*]?=)[\"']?([^\"'\]]*)[\"']?)?\]", text):
        if kind == ".":
            tests.append(lambda n, c=name: (has := n.attrs.get("class")) == c or (bool(has) and c in has.split()))
        elif kind == "#":
            tests.append(lambda n, c=name: n.attrs.get("id") == c)
        elif op:
            test = {"=": str.__eq__, "^=": str.startswith, "$=": str.endswith, "*=": str.__contains__}[op]
            tests.append(lambda n, a=attr, v=value, t=test: t(n.attrs.get(a) or "", v) and a in n.attrs)
        else:
            tests.append(lambda n, a=attr: a in n.attrs)
    if tag not in ("", "*"):
        tests.insert(0, lambda n: n.tag == tag)
    return tests[0] if len(tests) == 1 else lambda n: all(t(n) for t in tests)


def _fits(node: Node, way: list) -> bool:
    if not way[-1](node):
        return False
    n, left = node.parent, len(way) - 2
    while n is not None and left >= 0:
        left -= way[left](n)
        n = n.parent
    return left < 0


def _opened(at: Node, tag: str) -> Node:
    """Where a start tag goes: what it closes is left."""
    if tag in ENDS_PARAGRAPH and at.tag == "p":
        at = at.parent
    if tag in CLOSES:
        shut, stop = CLOSES[tag]
        n = at
        while n.parent is not None and n.tag not in stop:
            if n.tag in shut:
                at = n.parent
            n = n.parent
    return at


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root")

    def handle_starttag(self, tag, attrs):
        self.at = _opened(self.at, tag)
        node = Node(tag, dict(attrs), self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, dict(attrs), self.at))

    def handle_endtag(self, tag):
        n = self.at
        while n.parent is not None and n.tag != tag:
            n = n.parent
        if n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.children.append(data)


#: Plain markup: a doctype, short comments, tags of letters and digits with values in double quotes that hold no tag. What is between is text.
PLAIN = re.compile(r'<(?:!(?:--[^<>-]*--|[Dd][Oo][Cc][Tt][Yy][Pp][Ee][^<>]*)|/([A-Za-z][A-Za-z0-9]*)|([A-Za-z][A-Za-z0-9]*)((?:[ \n]+[A-Za-z][A-Za-z0-9-]*(?:="[^"<>]*")?)*)[ \n]*(/?))>')
ATTRIBUTE = re.compile(r'([A-Za-z][A-Za-z0-9-]*)(?:="([^"]*)")?')
#: Tags whose inside the standard library reads in ways of its own.
OWN_WAYS = {"script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes", "plaintext"}


@lru_cache(4096)
def _attributes(text: str) -> dict[str, str | None]:
    """Of plain markup; nobody changes the result."""
    return {m[1].lower(): entities.unescape(m[2]) if m[2] else m[2] for m in ATTRIBUTE.finditer(text)}


def _plain(html: str) -> Node | None:
    """The tree of a page of plain markup, as ``_Builder`` makes it and four times as fast; None for other pages."""
    parts = PLAIN.split(html)
    if html.count("<") != len(parts) // 5:
        return None
    root = at = Node("#root")
    if parts[0]:
        root.children.append(entities.unescape(parts[0]) if "&" in parts[0] else parts[0])
    own = None
    for i in range(1, len(parts), 5):
        end, tag, attrs, slash, text = parts[i : i + 5]
        if own is not None and (end is None or end.lower() != own):
            return None  # a tag within script or the like
        if end is not None:
            own, end, n = None, end.lower(), at
            while n.parent is not None and n.tag != end:
                n = n.parent
            if n.parent is not None:
                at = n.parent
        elif tag is not None:
            tag = tag.lower()
            attrs = _attributes(attrs) if attrs else None
            if slash:
                if tag in OWN_WAYS:
                    return None
                at.children.append(Node(tag, attrs, at))
            else:
                at = _opened(at, tag)
                node = Node(tag, attrs, at)
                at.children.append(node)
                if tag not in VOID:
                    at = node
                if tag in OWN_WAYS:
                    own = tag
        if text:
            if "&" in text:
                if own not in (None, "title", "textarea"):
                    return None
                text = entities.unescape(text)
            at.children.append(text)
    return None if own is not None else root


def ended(root: Node) -> None:
    """Tells each node of a whole tree the last one below it."""
    for n in reversed(root.order):
        if n.parent is not None and n.parent.last < n.last:
            n.parent.last = n.last


def parse(html: str | None) -> Node:
    """The tree of a page."""
    root = _plain(html or "")
    if root is None:
        b = _Builder()
        b.feed(html or "")
        b.close()
        root = b.root
    ended(root)
    return root


def collapsed(text: str | None) -> str | None:
    out = " ".join((text or "").split())
    return out or None

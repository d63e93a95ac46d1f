import re
from collections import Counter, defaultdict
from html.parser import HTMLParser

from ragspark.llm import queries as Q
from ragspark.llm import urls as U

SF = "/root/testdata/sf0.001"


class Links(HTMLParser):
    """The links of a page, with relative ones on the host of its first base, by another parser."""

    def __init__(self, html):
        super().__init__()
        self.base, self.hrefs = None, []
        self.feed(html)
        self.close()
        relative = lambda u: u and not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:|//", u)
        self.found = [self.base if relative(u) and self.base else u for u in self.hrefs]

    def handle_starttag(self, tag, attrs):
        href = (dict(reversed(attrs)).get("href") or "").strip()
        if tag in ("a", "area"):
            self.hrefs.append(href)
        elif tag == "base" and self.base is None and re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//", href):
            self.base = href


def split(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")


def brute(pages, rules=U.RULES):
    """pages: (page_id, url, html)."""
    rows, edges, shares = [], Counter(), defaultdict(list)
    for page_id, url, html in pages:
        host, path = split(url)
        fit = [(len(h + p), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fit)[1:] if fit else (None, None)
        rows.append((page_id, host, path, rule[1], rule[0]))
        if host:
            shares[host].append(rule[0])
            for u in Links(html or "").found:
                if not re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//", u):
                    continue
                target = split("x:" + u if u.startswith("//") else u)[0]
                if target and target != host:
                    edges[host, target] += 1

    def walk(kind, flow):
        seed = {h: 0.15 * sum(x == kind for x in v) / len(v) for h, v in shares.items()}
        total = Counter()
        for (a, _), n in flow.items():
            total[a] += n
        value = dict(seed)
        for _ in range(U.ROUNDS):
            new = defaultdict(float, seed)
            for (a, b), n in flow.items():
                new[b] += 0.85 * value.get(a, 0) * n / total[a]
            value = new
        return value

    trust, distrust = walk("allow", edges), walk("block", {(b, a): n for (a, b), n in edges.items()})
    bad = [v for v in distrust.values() if v > 0]
    least = U.THRESHOLD * sum(bad) / max(1, len(bad))
    for page_id, host, path, rule, verdict in rows:
        yield page_id, host, path, rule, verdict or ("block" if distrust.get(host, 0) > 0 and round(distrust[host] - trust.get(host, 0) - least, 9) >= 0 else "allow")


def order(rows):
    return sorted(map(tuple, rows), key=repr)


def test_query_equals_brute_force(spark):
    pages = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    got = Q.op10_link_graph(spark, SF).collect()
    assert order(got) == order(brute(pages))
    assert {r.verdict for r in got} == {"allow", "block"}


def test_edges_and_propagation(spark):
    link = lambda *hosts: " ".join(f'<a href="http://{h}/x">' for h in hosts)
    pages = [
        (1, "http://bad.org/es/1", None),
        (2, "http://Farm.test/a", link("bad.org", "bad.org", "other.test")),
        (3, "http://hub.test/b?x=://y", link("farm.test")),
        (4, "http://good.net/de/1", link("fine.test", "FINE.test")),
        (5, "http://fine.test/c", '<a href="/rel">'),
        (6, None, link("bad.org")),
        (7, "no scheme", "://"),
        (8, "", ""),
        (9, "https://a.example.com/en/7?q", "x"),
        (9, "https://a.example.com/en/7?q", "x"),
        (10, "x://example.net/de/81#f", None),
        (11, "x://notexample.net/de/81", None),
        (12, "x://com/en/", None),
        (13, "a\nb://H.org:80/es/", None),
        (None, "http://fine.test", link("fine.test")),
        (14, "http://far.test", link("farm.test", "fine.test", "fine.test", "fine.test")),
    ]
    df = spark.createDataFrame([(*p, "z", 1.0) for p in pages], "page_id long, url string, html string, host string, trust double")
    out = U.judge(df)
    got = out.select("page_id", "host", "path", "rule", "verdict").collect()
    assert order(got) == order(brute(pages))
    by = {r.page_id: r.verdict for r in got}
    assert by[2] == "block" and by[5] == "allow" and by[9] == "allow" and by[10] == "block" and by[11] == "allow"
    assert U.judge(df.limit(0)).count() == 0


def test_links_without_a_scheme(spark):
    pages = [("a.test", '<a href="//Bad.org/x?y"> <a href=//b.test> <a href="/own//path">'), ("b.test", "<a href='//b.test/'>")]
    # A host named in a query is no link; schemes are case-blind; very long html is searched to its end.
    pages += [("c.test", '<a href="/login?next=http://victim.test/y"> <a href="page?u=//victim.test"> <a href="HTTPS://End.test#x"> <a href="mailto:x//y">')]
    pages += [("d.test", "<p> text //" * 100_000 + "<a href=http://last.test>" * 2)]
    got = U.host_edges(spark.createDataFrame(pages, "host string, html string")).collect()
    assert order(got) == order([("a.test", "bad.org", 1), ("a.test", "b.test", 1), ("c.test", "end.test", 1), ("d.test", "last.test", 2)])


def test_distrust_shared_by_many(spark):
    """A blocked host with ten hosts that link to it: each of them is blocked, however little each one gets."""
    pages = [(0, "http://bad.org/es/1", None)] + [(i, f"http://h{i}.test/", '<a href="http://bad.org/">') for i in range(1, 11)] + [(99, "http://clean.test/", '<a href="http://h1.test/?q=http://bad.org">')]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in U.judge(df).collect()}
    assert got == {r[0]: r[4] for r in brute(pages)}
    assert all(got[i] == "block" for i in range(2, 11))


def test_only_anchors_are_links(spark):
    html = """<a data-href="http://data.test/" title=" href=http://title.test/" HREF = 'http://real.test/x'>t</a><!-- <a href="http://comment.test/"> -->
    href="http://plain.test/" <link rel=stylesheet href="http://cdn.test/c.css"><script>"<a href='http://script.test/'>"</script><a name=x> href=http://after.test/ </a>
    <area/href=//area.test><a href="mailto:x@mail.test"><a href="">e</a><a\nhref=http://line.test>"""
    based = '<base target=_top><base href="http://base.test/d/"><base href="http://second.test/"><a href="rel"><a href="#f"><a href="javascript:x"><a href=\'//own.test/\'>'
    pages = spark.createDataFrame([("own.test", html), ("own.test", based), ("own.test", "<!-- open <a href=http://lost.test/>"), ("", "<a href=http://x.test/>"), ("own.test", None), ("own.test", "<a href=http://real.test/" + " x" * 300_000)], "host string, html string")
    got = {r["target"]: r["n"] for r in U.host_edges(pages).collect()}
    assert got == {"real.test": 2, "area.test": 1, "line.test": 1, "base.test": 2}

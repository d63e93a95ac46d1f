"""The queries of this subpackage in SQL, for comparison with DuckDB. Tokenizing and training have none; they are
tested against brute force."""

from __future__ import annotations

from ragspark.llm.quality import BOILERPLATE
from ragspark.llm.urls import ATTRIBUTE, DAMPING, HIDDEN, OUTWARD, ROUNDS, RULES, SCHEME, THRESHOLD

SQL: dict[str, str] = {}
UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

# Base 32 of a SHA-1: its 160 bits, five at a time.
SQL["op1_warc"] = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
bits AS (SELECT *, list_aggregate(list_transform(string_split(hex, ''), lambda c: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][instr('0123456789abcdef', c)]), 'string_agg', '') AS b FROM p),
d AS (SELECT page_id, payload_bytes, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * substr(b, (5 * i + 1)::INT, 1)::INT + 8 * substr(b, (5 * i + 2)::INT, 1)::INT + 4 * substr(b, (5 * i + 3)::INT, 1)::INT + 2 * substr(b, (5 * i + 4)::INT, 1)::INT + substr(b, (5 * i + 5)::INT, 1)::INT, 1)), 'string_agg', '') AS payload_digest FROM bits),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM m
"""

_KINDS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+))""", "length(v) >= 6"),
    ("access", "((AKIA[A-Z0-9]{16,}))", "true"),
    ("hex", "(([0-9a-f]{24,}))", "true"),
    ("generic", "(([A-Za-z0-9+/_=-]{24,}))", "regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]')"),
]
_FOUND = " UNION ALL ".join(
    f"SELECT doc_id, source, {rank} AS rank, '{kind}' AS kind, unnest(regexp_extract_all(t, '{p}', 1)) AS m, unnest(regexp_extract_all(t, '{p}', 2)) AS v, unnest(list_slice(regexp_split_to_array(t, '{p}'), 1, -2)) AS gap, unnest(range(1, len(regexp_extract_all(t, '{p}', 1)) + 1)) AS i FROM d WHERE regexp_matches(t, '{p}')"
    for rank, (kind, p, _) in enumerate(_KINDS)
)
_OK = " OR ".join(f"(kind = '{k}' AND {c})" for k, _, c in _KINDS)
SQL["op2_secret_ownership"] = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
f AS ({_FOUND}),
p AS (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, rank ORDER BY i) AS stop FROM f),
s AS (SELECT doc_id, source, rank, kind, v, (stop - length(m))::BIGINT AS start, stop::BIGINT AS stop FROM p WHERE {_OK}),
c AS (SELECT * FROM s WHERE kind <> 'generic' OR NOT EXISTS (SELECT 1 FROM s b WHERE b.doc_id = s.doc_id AND b.kind <> 'generic' AND b.start < s.stop AND s.start < b.stop)),
o AS (SELECT v, count(DISTINCT source) AS owners, count(DISTINCT doc_id) AS repositories FROM c GROUP BY v),
k AS (SELECT c.*, kind || ':' || start || ':' || stop AS span FROM c JOIN o USING (v) WHERE kind <> 'generic' OR (owners <= 2 AND repositories <= 10)),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
coalesce(string_agg(span, ',' ORDER BY start, rank) FILTER (kind <> 'generic'), '') AS base, string_agg(span, ',' ORDER BY start, rank) AS spans FROM k GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)
"""

_BARE = r"regexp_replace({x}, '[\x20\x09-\x0D]', '', 'g')"
SQL["op3_line_quality"] = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY doc_id),
l AS (SELECT doc_id, line, length({_BARE.replace("{x}", "line")}) AS chars, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS size, len(regexp_extract_all(line, '[|>»·•]')) AS marks FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)),
b AS (SELECT *, (marks >= 3 AND marks >= 0.2 * size) OR regexp_matches(lower(line), '{"|".join(BOILERPLATE)}') OR (size >= 4 AND NOT regexp_matches(line, '[.!?:;,…。！？][)\]}}"''”’»›]*[\x20\x09-\x0D]*$') AND NOT regexp_matches(line, '[.!?:;,…|>][^\x20\x09-\x0D]*[\x20\x09-\x0D]*$')) AS fails FROM l WHERE chars > 0),
s AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup, sum(CASE WHEN fails THEN 0 ELSE chars END) AS good FROM b GROUP BY doc_id),
a AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length({_BARE.replace("{x}", "t")})::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(good, 0) AS good FROM d LEFT JOIN r USING (doc_id) LEFT JOIN s USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 1 - good / word_chars <= 0.5 AS kept FROM f
"""

# Texts as hexadecimal, two characters a byte; runs of repeated strings are joined where they touch.
SQL["op4_suffix_array"] = """
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
p AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 800)) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 399)) AS i FROM d WHERE n >= 400)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS c FROM p) WHERE c > 1),
g AS (SELECT doc_id, i, sum(CASE WHEN i - before <= 400 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM r)),
s AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS z FROM g GROUP BY doc_id, run),
e AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS last FROM s),
k AS (SELECT doc_id, sum(z - a) AS removed, count(*) AS spans, string_agg(substr(h, 2 * last + 1, 2 * (a - last)), '' ORDER BY a) || substr(any_value(h), 2 * max(z) + 1) AS kept FROM e JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""

SQL["op6_fixed_blocks"] = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
p AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) AS n FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS at FROM p WHERE n > 1),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS at FROM d),
k AS (SELECT x.doc_id, count(g.at) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY x.at) FILTER (g.at IS NULL), '') AS kept FROM x LEFT JOIN g ON g.doc_id = x.doc_id AND g.at = x.at GROUP BY x.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""

SQL["op8_jaccard_join"] = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UP}', '{LOW}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
b AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT b.y, r.root FROM r JOIN b ON b.x = r.doc_id)
SELECT doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""

_ITEM_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UP}', '{LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL["op9_decontaminate"] = f"""
WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents), b AS (SELECT item_id::VARCHAR AS item, {_ITEM_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS t FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
pos AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS t FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hits AS (SELECT doc_id, n, i, item FROM pos JOIN win USING (n, t)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN m USING (doc_id)
"""

_HOST = rf"translate(regexp_extract({{u}}, '(?s)^.*?://([^/?#]*)', 1), '{UP}', '{LOW}')"
_FIT = " UNION ALL ".join(f"SELECT page_id, '{v}' AS verdict, '{h}{p}' AS rule FROM p WHERE (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for v, h, p in RULES)


def _walk(name: str, seed: str, source: str, target: str) -> str:
    """PageRank as one table a round."""
    share = f"{name}_share AS (SELECT {source} AS a, {target} AS b, n / sum(n) OVER (PARTITION BY {source}) AS share FROM e)"
    start = f"{name}_start AS (SELECT host, {1 - DAMPING} * {seed} AS v FROM seeds WHERE {seed} > 0)"
    rounds = [f"{name}0 AS (SELECT * FROM {name}_start)"]
    for i in range(ROUNDS):
        rounds.append(f"{name}{i + 1} AS (SELECT host, sum(v) AS v FROM (SELECT b AS host, {DAMPING} * v * share AS v FROM {name}{i} JOIN {name}_share ON a = host UNION ALL SELECT host, v FROM {name}_start) GROUP BY host)")
    return ", ".join([share, start, *rounds])


_Q = lambda p: p.replace("'", "''")
_HREFS = rf"""list_transform(list_filter(tags, lambda t: regexp_matches(t, '(?i)^({{n}})[\s/]')), lambda t: coalesce(regexp_extract(list_filter(regexp_extract_all(string_split(t, '>')[1], '{_Q(ATTRIBUTE)}'), lambda x: regexp_matches(x, '(?i)^[\s"''/]href\s*='))[1], '=\s*["'']?\s*([^"''\s>]*)', 1), ''))"""
SQL["op10_link_graph"] = rf"""
WITH p AS (SELECT page_id, coalesce({_HOST.replace("{u}", "url")}, '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, html FROM pages),
r AS (SELECT page_id, arg_max(verdict, length(rule)) AS verdict, arg_max(rule, length(rule)) AS rule FROM ({_FIT}) GROUP BY page_id),
h AS (SELECT host, list_slice(string_split(regexp_replace(html, '{HIDDEN}', ' ', 'g'), '<'), 2, NULL) AS tags FROM p WHERE contains(html, '//')),
g AS (SELECT host, {_HREFS.replace("{n}", "a|area")} AS links, list_filter({_HREFS.replace("{n}", "base")}, lambda u: regexp_matches(u, '{OUTWARD}'))[1] AS base FROM h),
l AS (SELECT host AS source, base, unnest(links) AS link FROM g),
e AS (SELECT source, target, count(*)::DOUBLE AS n FROM (SELECT source, {_HOST.replace("{u}", "link")} AS target FROM (SELECT source, CASE WHEN starts_with(link, '//') THEN 'x:' || link ELSE link END AS link FROM (SELECT source, CASE WHEN regexp_matches(link, '{OUTWARD}') THEN link WHEN link = '' OR regexp_matches(link, '{SCHEME}') THEN '' ELSE base END AS link FROM l))) WHERE source <> target AND source <> '' AND target <> '' GROUP BY source, target),
seeds AS (SELECT host, avg(coalesce(verdict = 'allow', false)::INT) AS trusted, avg(coalesce(verdict = 'block', false)::INT) AS blocked FROM p LEFT JOIN r USING (page_id) WHERE host <> '' GROUP BY host),
{_walk("t", "trusted", "source", "target")}, {_walk("d", "blocked", "target", "source")}
SELECT page_id, p.host, path, rule, coalesce(verdict, CASE WHEN d{ROUNDS}.v > 0 AND round(d{ROUNDS}.v - coalesce(t{ROUNDS}.v, 0) - {THRESHOLD} * (SELECT avg(v) FROM d{ROUNDS} WHERE v > 0), 9) >= 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN r USING (page_id) LEFT JOIN t{ROUNDS} ON t{ROUNDS}.host = p.host LEFT JOIN d{ROUNDS} ON d{ROUNDS}.host = p.host
"""

# CRC-32 of the decimal doc_id, bit by bit; a tree is a recursion over its levels.
_FIELD = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
_LEAF = lambda n: "sha256(" + " || ".join(_FIELD(c) for c in ("doc_id", "source", "lang", n, "text")) + ")"
_LEVELS = """
  UNION ALL
  SELECT lvl + 1, grp, idx // 2 AS idx, sha256(string_agg(hash, '' ORDER BY idx)) AS hash, (any_value(n) + 1) // 2 AS n
  FROM {0} WHERE n > 1 GROUP BY lvl, grp, idx // 2"""
_CRC = "list_reduce([4294967295] || list_transform(range(8 * strlen(doc_id::VARCHAR)), lambda i: (ascii(substr(doc_id::VARCHAR, (i // 8 + 1)::INT, 1)) >> (i % 8)::INT) & 1), lambda c, b: CASE WHEN xor(c & 1, b) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
SQL["op11_merkle"] = f"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, coalesce('=' || lang, '') AS grp, {_LEAF('n_chars')} AS leaf,
         CASE WHEN xor({_CRC}, 4294967295) % 7 = 0 THEN {_LEAF('(n_chars + 1)')} ELSE {_LEAF('n_chars')} END AS later
  FROM documents),
leaves AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS n FROM d),
nodes AS (SELECT 0 AS lvl, grp, idx::BIGINT AS idx, leaf AS hash, n::BIGINT AS n FROM leaves {_LEVELS.format('nodes')}),
ends AS MATERIALIZED (SELECT grp, lvl, hash, row_number() OVER (ORDER BY grp) - 1 AS idx FROM nodes WHERE n = 1),
tops AS (SELECT 0 AS lvl, 0 AS grp, idx::BIGINT AS idx, hash, (SELECT count(*) FROM ends)::BIGINT AS n FROM ends {_LEVELS.format('tops')}),
low AS MATERIALIZED (SELECT * FROM nodes), high AS MATERIALIZED (SELECT * FROM tops),
at_node AS (
  SELECT l.doc_id, l.grp, l.idx AS leaf_idx, x.lvl, 0 AS tree, x.idx, x.hash FROM leaves l JOIN low x ON x.grp = l.grp AND x.n > 1 AND xor(x.idx, 1) = l.idx >> x.lvl::INT
  UNION ALL
  SELECT l.doc_id, l.grp, l.idx, x.lvl, 1, x.idx, x.hash FROM leaves l JOIN ends e ON e.grp = l.grp JOIN high x ON x.n > 1 AND xor(x.idx, 1) = e.idx >> x.lvl::INT),
proof AS MATERIALIZED (SELECT grp, leaf_idx, string_agg(hash, '' ORDER BY tree, lvl) AS sibs FROM at_node GROUP BY grp, leaf_idx),
fold AS (
  SELECT l.grp, l.idx AS leaf_idx, 0 AS step, l.later AS hash FROM leaves l
  UNION ALL
  SELECT f.grp, f.leaf_idx, f.step + 1,
         CASE WHEN f.step < e.lvl
              THEN sha256(CASE WHEN a.hash IS NULL THEN f.hash WHEN a.idx % 2 = 0 THEN a.hash || f.hash ELSE f.hash || a.hash END)
              ELSE sha256(CASE WHEN b.hash IS NULL THEN f.hash WHEN b.idx % 2 = 0 THEN b.hash || f.hash ELSE f.hash || b.hash END) END
  FROM fold f JOIN ends e ON e.grp = f.grp
  LEFT JOIN low a ON f.step < e.lvl AND a.grp = f.grp AND a.lvl = f.step AND xor(a.idx, 1) = f.leaf_idx >> f.step::INT
  LEFT JOIN high b ON f.step >= e.lvl AND b.lvl = f.step - e.lvl AND xor(b.idx, 1) = e.idx >> (f.step - e.lvl)::INT
  WHERE f.step < e.lvl + (SELECT max(lvl) FROM high)),
folds AS (SELECT grp, leaf_idx, arg_max(hash, step) AS folded_root FROM fold GROUP BY grp, leaf_idx),
root AS (SELECT hash AS root FROM high WHERE n = 1)
SELECT l.doc_id, l.leaf, e.hash AS subroot, root, sha256(coalesce(p.sibs, '')) AS proof_sha256, f.folded_root, f.folded_root = root AS verified
FROM leaves l JOIN ends e USING (grp) JOIN folds f ON f.grp = l.grp AND f.leaf_idx = l.idx LEFT JOIN proof p ON p.grp = l.grp AND p.leaf_idx = l.idx, root
"""

# Every order is run on the documents' flags, without a cube.
_WORDS12 = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"
SQL["op12_filter_interaction"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS MATERIALIZED (SELECT doc_id, part, t, len({_WORDS12}) AS n, len(list_distinct({_WORDS12})) AS own, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS again FROM d),
lab AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
fl AS MATERIALIZED (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         (n < 200)::INT + 2 * (100 * own < 50 * n)::INT + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t))::INT
         + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * again::INT AS failed
       FROM w LEFT JOIN lab USING (doc_id)),
orders AS (SELECT '' AS o, 0 AS len UNION ALL SELECT o || c, len + 1 FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c) WHERE len < 5 AND NOT contains(o, c)),
steps AS (SELECT o AS filter_order, s AS step, substr(o, s, 1) AS f, (1 << (instr('ABCDE', substr(o, s, 1)) - 1)::INT) AS bit,
                 list_sum(list_transform(range(1, s), lambda i: 1 << (instr('ABCDE', substr(o, i::INT, 1)) - 1)::INT))::INT AS before
          FROM orders, (SELECT unnest(range(1, 6))::INT AS s) WHERE len = 5),
r AS (SELECT part, filter_order, step, f,
        count(*) FILTER ((failed & (coalesce(before, 0) | bit)) = 0) AS kept,
        count(*) FILTER ((failed & coalesce(before, 0)) = 0 AND (failed & bit) > 0) AS removed,
        count(*) FILTER ((failed & coalesce(before, 0)) > 0 AND (failed & bit) > 0) AS redundant,
        count(*) FILTER (failed = bit) AS unique_fails,
        count(*) FILTER ((failed & coalesce(before, 0)) = 0 AND (failed & bit) > 0 AND good = 1) AS good_lost,
        count(*) FILTER ((failed & coalesce(before, 0)) = 0 AND (failed & bit) > 0 AND toxic = 1) AS toxic_lost
      FROM fl, steps GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM r
"""

SQL["op13_multi_index"] = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
ok AS MATERIALIZED (
  SELECT vec_id, e FROM v
  WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(e, lambda x: abs(x))) > 0),
link AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN comp USING (vec_id) LEFT JOIN n USING (vec_id)
"""

"""The named queries over the driver's tables and, where SQL can express one, the same in SQL for comparison.

Scores are rounded to six digits before anything is ordered by them, and ties are settled by id, so two engines cut
off at the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ragspark.functions import numbers as N
from ragspark.functions import text as T
from ragspark.functions import urls as U
from ragspark.functions import vectors as V
from ragspark.operators import dedup, fusion, hygiene, impact, lexical, listings, retrieve, threads
from ragspark.operators.tables import folder, saved, small

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
AS_OF = "2024-02-01 00:00:00"
QUESTION = "the thention of stion and ering"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def one_query(spark: SparkSession, text: str = QUESTION) -> DataFrame:
    return spark.createDataFrame([(0, text)], "query_id long, text string")


TOKENS = r"list_transform(regexp_extract_all(coalesce(text, ''), '\w+'), lambda x: lower(x))"
BM25 = f"""
WITH d AS (SELECT doc_id, {TOKENS} AS t FROM documents),
q AS (SELECT query_id, unnest(list_distinct(list_transform(regexp_extract_all(qtext, '\\w+'), lambda x: lower(x)))) AS term FROM ({{queries}})),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT query_id, doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl)) + 1.0)), 6) AS score
       FROM q JOIN tf USING (term) JOIN df USING (term), st GROUP BY query_id, doc_id)
"""
ONE = f"SELECT 0 AS query_id, '{QUESTION}' AS qtext"
COS = "round(list_reduce(list_prepend(0::DOUBLE, list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), lambda s, x: s + x) / (sqrt(list_reduce(list_prepend(0::DOUBLE, list_transform({a}, lambda x: x::DOUBLE * x::DOUBLE)), lambda s, x: s + x)) * sqrt(list_reduce(list_prepend(0::DOUBLE, list_transform({b}, lambda x: x::DOUBLE * x::DOUBLE)), lambda s, x: s + x))), 6)"


def cos(a: str, b: str) -> str:
    return COS.replace("{a}", a).replace("{b}", b)


# --- lexical ---------------------------------------------------------------------------------------------------------


@query(f"SELECT count(*) AS n, sum(len(t))::BIGINT AS total, round(avg(len(t)), 6) AS avgdl FROM (SELECT {TOKENS} AS t FROM documents)")
def token_stats(spark, sf):
    return lexical.statistics(table(spark, sf, "documents")).select("n", "total", F.round("avgdl", 6).alias("avgdl"))


@query(f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({TOKENS})) AS term FROM documents) GROUP BY term")
def term_df(spark, sf):
    return lexical.document_frequency(table(spark, sf, "documents"))


@query(f"WITH t AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({TOKENS})) AS term FROM documents) GROUP BY term) SELECT term, df, round(ln(((SELECT count(*) FROM documents) - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM t")
def idf_terms(spark, sf):
    return lexical.build_index(table(spark, sf, "documents")).terms.withColumn("idf", F.round("idf", 6))


@query(BM25.replace("{queries}", ONE) + "SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM bm ORDER BY score DESC, doc_id LIMIT 10")
def bm25_topk(spark, sf):
    return lexical.top(lexical.bm25(table(spark, sf, "documents"), one_query(spark)), 10).select("doc_id", "score", "rank")


@query(BM25.replace("{queries}", "SELECT item_id AS query_id, text AS qtext FROM benchmark") + "SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm) WHERE rank <= 5")
def bm25_multi_query(spark, sf):
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return lexical.best(table(spark, sf, "documents"), items, 5)


@query(BM25.replace("{queries}", ONE) + "SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM bm ORDER BY score DESC, doc_id LIMIT 10")
def bm25_index_search(spark, sf):
    return lexical.top(lexical.search(lexical.build_index(table(spark, sf, "documents")), one_query(spark)), 10).select("doc_id", "score", "rank")


@query(BM25.replace("{queries}", "SELECT item_id AS query_id, text AS qtext FROM benchmark") + "SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm) WHERE rank <= 5")
def bm25_block_topk(spark, sf):
    """As ``bm25_multi_query``, from an index in the order of impact, which is built here and could be kept."""
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    index = impact.build(table(spark, sf, "documents"), f"{folder(spark)}/impact-{uuid.uuid4().hex}")
    return impact.search(index, items, 5)


@query(
    BM25.replace("{queries}", "SELECT item_id AS query_id, text AS qtext FROM benchmark")
    + """, r AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm),
hits AS (SELECT b.item_id, coalesce(max((contains(d.text, substr(b.text, 1, 40)))::INT), 0) AS hit FROM benchmark b LEFT JOIN r ON r.query_id = b.item_id AND r.rank <= 5 LEFT JOIN documents d USING (doc_id) GROUP BY b.item_id)
SELECT count(*) AS n, round(avg(hit), 6) AS recall FROM hits"""
)
def recall_at_5(spark, sf):
    """The share of benchmark items whose first 40 characters stand in one of their five best documents."""
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("item"))
    best = small(saved(lexical.best(docs, items, 5, query_text="item").select("query_id", "doc_id"), "best"))  # so that no text is shuffled
    hit = docs.select("doc_id", "text").join(best, "doc_id").join(items, "query_id").groupBy("query_id").agg(F.max(F.col("text").contains(F.substring("item", 1, 40)).cast("int")).alias("hit"))
    return items.join(hit, "query_id", "left").agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("recall"))


def _constraint_sql(words: list[str], need: int) -> str:
    has = " + ".join(f"list_contains(t, '{w}')::INT" for w in words)
    n = "(SELECT count(*) FROM d)"
    ranked = " UNION ALL ".join(f"SELECT {i} AS i, '{w}' AS w, ln(({n} - c + 0.5) / (c + 0.5) + 1) AS idf FROM (SELECT count(*) AS c FROM d WHERE list_contains(t, '{w}'))" for i, w in enumerate(words))
    return f"""WITH d AS (SELECT doc_id, {TOKENS} AS t FROM documents),
top AS (SELECT w FROM ({ranked}) ORDER BY idf DESC, i LIMIT 3),
m AS (SELECT doc_id, (SELECT count(*) FROM top WHERE list_contains(t, w)) >= {need} AS ok FROM d)
SELECT doc_id FROM m WHERE ok OR (SELECT count(*) FROM m WHERE ok) = 0 -- {has}"""


@query(_constraint_sql(["thention", "stion", "ering"], 2))
def lexical_constraint(spark, sf):
    docs = table(spark, sf, "documents")
    return lexical.soft_constraint(docs, docs, QUESTION)[0].select("doc_id")


@query("SELECT doc_id FROM documents")
def lexical_fallback(spark, sf):
    """No document has the words, so all stay."""
    docs = table(spark, sf, "documents")
    return lexical.soft_constraint(docs, docs, "zzzqx zzzqy the")[0].select("doc_id")


# --- vectors ---------------------------------------------------------------------------------------------------------


def vector_zero(spark, sf) -> list[float]:
    return table(spark, sf, "embeddings").where("vec_id = 0").collect()[0]["embedding"]


QV = "qv AS (SELECT embedding AS qe FROM embeddings WHERE vec_id = 0)"
VEC = f"{QV}, v AS (SELECT vec_id AS doc_id, {cos('embedding', 'qe')} AS score FROM embeddings, qv)"


@query(f"WITH {VEC} SELECT doc_id AS vec_id, score FROM v WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 10")
def cosine_topk(spark, sf):
    scored = retrieve.vector_list(table(spark, sf, "embeddings"), vector_zero(spark, sf), "vec_id", "embedding")
    return lexical.top(scored, 10, key="vec_id", score="vector_score").select("vec_id", F.col("vector_score").alias("score"))


@query(f"WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, {cos('e.embedding', 'q.embedding')} AS score FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id) SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5")
def cosine_multi_query(spark, sf):
    """The stated query set, ids divisible by 50, against all vectors; the queries go round in blocks."""
    e = table(spark, sf, "embeddings")
    return retrieve.nearest(e, e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 5)


@query("WITH m AS (SELECT label, i, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, unnest(range(64)) AS i FROM embeddings) GROUP BY label, i), n AS (SELECT label, sqrt(sum(m * m)) AS n FROM m GROUP BY label) SELECT label, i::BIGINT AS i, round(m / n, 6) AS x FROM m JOIN n USING (label)")
def label_centroids(spark, sf):
    c = V.centroid(table(spark, sf, "embeddings"), "embedding", "label")
    return c.select("label", F.posexplode("centroid").alias("i", "x")).select("label", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


@query("WITH s AS (SELECT vec_id, embedding[1:16] AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM s) SELECT vec_id, round(v[1]::DOUBLE / n, 6) AS first, round(list_sum(list_transform(v, lambda x: (x::DOUBLE / n) * (x::DOUBLE / n))), 6) AS size FROM n")
def shortened_vectors(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", V.shortened(F.col("embedding"), 16).alias("v"))
    return v.select("vec_id", F.round(F.col("v")[0], 6).alias("first"), F.round(V.dot(F.col("v"), F.col("v")), 6).alias("size"))


# --- fusion ----------------------------------------------------------------------------------------------------------

HYBRID = (
    BM25.replace("{queries}", ONE)
    + f""", {VEC},
l AS (SELECT doc_id, score, 1 AS ranking, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM bm WHERE score > 0),
w AS (SELECT doc_id, score, 0 AS ranking, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM v WHERE score > 0),
u AS (SELECT * FROM l WHERE r <= {{words}} UNION ALL SELECT * FROM w WHERE r <= {{vectors}}),
f AS (SELECT doc_id, max(score) FILTER (ranking = 0) AS vector_score, max(score) FILTER (ranking = 1) AS lexical_score, round(sum(1.0::DOUBLE / (60 + r)), 6) AS fused_score FROM u GROUP BY doc_id),
g AS (SELECT *, row_number() OVER (ORDER BY fused_score DESC, doc_id) AS rank FROM f)
"""
)
WHOLE = HYBRID.replace("{words}", "1000000000").replace("{vectors}", "1000000000")
POOLS = HYBRID.replace("{words}", "10").replace("{vectors}", "30")


def lists(spark, sf) -> tuple[DataFrame, DataFrame]:
    words = retrieve.word_list(table(spark, sf, "documents"), one_query(spark), "doc_id")
    vectors = retrieve.vector_list(table(spark, sf, "embeddings"), vector_zero(spark, sf), "vec_id", "embedding").withColumnRenamed("vec_id", "doc_id")
    return vectors, words


def hybrid(spark, sf, **pools) -> DataFrame:
    return retrieve.fuse(*lists(spark, sf), "doc_id", **pools)


@query(WHOLE + "SELECT doc_id, vector_score, lexical_score, fused_score, rank FROM g WHERE rank <= 10")
def hybrid_topk(spark, sf):
    return retrieve.fuse_top(*lists(spark, sf), 10, "doc_id").select("doc_id", "vector_score", "lexical_score", "fused_score", "rank")


@query(WHOLE + "SELECT count(vector_score) AS vector, count(lexical_score) AS lexical, count(*) AS fused FROM g")
def hybrid_trace(spark, sf):
    return retrieve.trace(retrieve.merged(*lists(spark, sf), "doc_id"))


@query(WHOLE + "SELECT doc_id, fused_score, rank FROM g WHERE rank <= 20")
def profile_recall(spark, sf):
    own = retrieve.profile("recall")
    return retrieve.fuse_top(*lists(spark, sf), own.top_k, "doc_id", own.rrf_k).select("doc_id", "fused_score", "rank")


@query(POOLS + "SELECT doc_id, vector_score, lexical_score, fused_score, rank FROM g WHERE rank <= 10")
def restricted_pools(spark, sf):
    """Pools of max(3k, 30) vectors and k lexical hits before fusion."""
    return hybrid(spark, sf, pool_vectors=30, pool_words=10).where("rank <= 10").select("doc_id", "vector_score", "lexical_score", "fused_score", "rank")


RANKINGS = """SELECT 0 AS ranking, row_number() OVER (ORDER BY ts, event_id) AS position, user_id AS key, event_type AS label FROM events WHERE event_type = 'purchase'
UNION ALL SELECT 1 AS ranking, row_number() OVER (ORDER BY value DESC, event_id) AS position, user_id AS key, event_type AS label FROM events WHERE event_type = 'click'"""
RRF = f"""WITH a AS ({RANKINGS}), o AS (SELECT *, row_number() OVER (PARTITION BY ranking, key ORDER BY position) AS n FROM a),
r AS (SELECT *, row_number() OVER (PARTITION BY ranking ORDER BY position) AS rank FROM o WHERE n = 1)
"""


def rankings(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    number = lambda *o: F.row_number().over(Window.orderBy(*o)).cast("long")
    a = e.where("event_type = 'purchase'").select(F.lit(0).alias("ranking"), number("ts", "event_id").alias("position"), F.col("user_id").alias("key"), F.col("event_type").alias("label"))
    b = e.where("event_type = 'click'").select(F.lit(1).alias("ranking"), number(F.desc("value"), "event_id").alias("position"), F.col("user_id").alias("key"), F.col("event_type").alias("label"))
    return a.unionByName(b)


@query(RRF + "SELECT key, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS rrf_score FROM r GROUP BY key")
def rrf_two_lists(spark, sf):
    return fusion.rrf(rankings(spark, sf)).select(F.col("identity").alias("key"), F.round("rrf_score", 6).alias("rrf_score"))


@query(RRF + "SELECT key, arg_max(label, ranking) AS label, arg_max(position, ranking) AS position FROM r GROUP BY key")
def rrf_last_wins(spark, sf):
    return fusion.rrf(rankings(spark, sf)).select(F.col("identity").alias("key"), "payload.label", "payload.position")


@query(WHOLE + ", c AS (SELECT doc_id, coalesce(lexical_score, 0) AS s FROM g) SELECT doc_id, round(s, 6) AS raw, round((s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()), 6) AS normalized, round(min(s) OVER (), 6) AS corpus_min, round(max(s) OVER (), 6) AS corpus_max, round(median(s) OVER (), 6) AS median FROM c")
def score_stats(spark, sf):
    d = retrieve.score_stats(retrieve.merged(*lists(spark, sf), "doc_id"), "lexical_score")
    return d.select("doc_id", *[F.round(F.col(f"lexical_score_detail.{c}"), 6).alias(c) for c in ("raw", "normalized", "corpus_min", "corpus_max", "median")])


# --- rescoring -------------------------------------------------------------------------------------------------------


@query(f"WITH d AS (SELECT event_id, exp(-((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts)) / 86400000000.0) / 7) AS s FROM events) SELECT event_id, round((s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()), 6) AS recency FROM d")
def rescore_recency(spark, sf):
    days = (F.unix_micros(F.lit(AS_OF).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 86_400_000_000
    return fusion.recency_signal(table(spark, sf, "events"), days, 7).select("event_id", F.round("recency", 6).alias("recency"))


@query(
    """WITH s AS (SELECT o_orderkey, ln(1 + o_totalprice) AS p, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey)) AS a FROM orders),
n AS (SELECT o_orderkey, round((p - min(p) OVER ()) / (max(p) OVER () - min(p) OVER ()), 6) AS engagement, (a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()) AS anchor FROM s),
c AS (SELECT o_orderkey, engagement, round(0.6 * anchor + 0.4 * engagement, 6) AS combined_score FROM n)
SELECT * FROM c ORDER BY combined_score DESC, o_orderkey LIMIT 100"""
)
def rescore_engagement(spark, sf):
    o = table(spark, sf, "orders").withColumn("rrf_score", 1.0 / (60 + F.row_number().over(Window.orderBy(F.desc("o_orderdate"), "o_orderkey"))))
    df = fusion.log_signal(o, F.col("o_totalprice"), "engagement").withColumn("engagement", F.round("engagement", 6))
    df = fusion.rescore(df, {"rrfAnchor": 0.6, "engagement": 0.4}, ["engagement"])
    return df.select("o_orderkey", "engagement", "combined_score").orderBy(F.desc("combined_score"), "o_orderkey").limit(100)


@query(
    r"""WITH p AS (SELECT p_partkey, lower(p_name) AS name, p_retailprice AS d FROM part),
t AS (SELECT p_partkey, d, CASE WHEN name IN ('red widget', 'red-widget', 'red_widget') THEN 1000 WHEN name IN ('red', 'widget') THEN 800 WHEN starts_with(name, 'red widget') OR starts_with(name, 'red-widget') THEN 500
WHEN contains(name, 'red widget') OR contains(name, 'red-widget') OR contains(name, 'red_widget') THEN 100 WHEN contains(name, 'red') AND contains(name, 'widget') THEN 50 WHEN contains(name, 'red') OR contains(name, 'widget') THEN 10 END AS tier FROM p)
SELECT p_partkey, round(tier + log10(greatest(d, 1)), 6) AS score FROM t WHERE tier IS NOT NULL"""
)
def name_tiers(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", fusion.name_score(F.col("p_name"), F.col("p_retailprice"), "red widget").alias("score"))
    return p.where("score IS NOT NULL").select("p_partkey", F.round("score", 6).alias("score"))


# --- URLs ------------------------------------------------------------------------------------------------------------

HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)', 1))"
PATH = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
TRACKED = ", ".join(f"'{t}'" for t in U.TRACKING)
NORMAL = rf"""WITH u AS (SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, regexp_replace({HOST}, '^www\.', '') AS host,
regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(?:\[[^\]]*\]|[^/?#:]*):(\d+)', 1) AS port, {PATH} AS path,
list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND lower(regexp_extract(p, '^([^=]*)', 1)) NOT IN ({TRACKED})) AS kept FROM pages),
n AS (SELECT page_id, url, scheme || '://' || host || CASE WHEN port = '' OR (scheme = 'http' AND port = '80') OR (scheme = 'https' AND port = '443') THEN '' ELSE ':' || port END
|| CASE WHEN path = '' THEN '/' WHEN path <> '/' AND ends_with(path, '/') THEN regexp_replace(path, '/$', '') ELSE path END || CASE WHEN len(kept) = 0 THEN '' ELSE '?' || array_to_string(kept, '&') END AS normal FROM u)
"""


@query(NORMAL + "SELECT page_id, normal FROM n")
def url_normalize(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.normalized(F.col("url")).alias("normal"))


@query(NORMAL + "SELECT min(page_id) AS page_id FROM n GROUP BY normal")
def url_dedup(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url")
    return dedup.keep_first(p, U.normalized(F.col("url")), "page_id").select("page_id")


@query(rf"SELECT page_id, regexp_replace({HOST}, '^www\.', '') AS domain FROM pages")
def url_domain(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.domain(F.col("url")).alias("domain"))


@query(rf"SELECT page_id, {HOST} NOT IN ('localhost', '127.0.0.1', '[::1]', '0.0.0.0', 'metadata.google.internal') AND regexp_matches(url, '^https?://') AND NOT regexp_matches({HOST}, '{U.PRIVATE}') AS safe FROM pages")
def safe_url(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.is_safe(F.col("url")).alias("safe"))


@query(rf"SELECT page_id FROM pages WHERE {HOST} = 'blog.tionsh.example.net' AND regexp_matches(regexp_replace({PATH}, '/+$', ''), '^/en(/[^/]+)?$')")
def path_prefix(spark, sf):
    return table(spark, sf, "pages").where(U.under(F.col("url"), "https://blog.tionsh.example.net/en/")).select("page_id")


# --- dedup and budgets -----------------------------------------------------------------------------------------------


@query("SELECT min(doc_id) AS doc_id FROM documents WHERE text <> '' GROUP BY sha256(text) UNION ALL SELECT doc_id FROM documents WHERE text = ''")
def content_dedup(spark, sf):
    return dedup.keep_first(table(spark, sf, "documents").select("doc_id", "text"), F.sha2("text", 256), "doc_id").select("doc_id")


@query("WITH k AS (SELECT event_id, CASE WHEN event_type = 'view' THEN '' ELSE event_type || user_id END AS key FROM events) SELECT min(event_id) AS event_id FROM k WHERE key <> '' GROUP BY key UNION ALL SELECT event_id FROM k WHERE key = ''")
def blank_key_dedup(spark, sf):
    key = F.when(F.col("event_type") == "view", "").otherwise(F.concat("event_type", F.col("user_id").cast("string")))
    return dedup.keep_first(table(spark, sf, "events").select("event_id", "event_type", "user_id"), key, "event_id").select("event_id")


@query("WITH c AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents) SELECT md5(line) AS h, min((doc_id, n)).doc_id AS doc_id FROM (SELECT line, {'doc_id': doc_id, 'n': n} AS x, doc_id, n FROM c WHERE line <> '') GROUP BY line".replace("min((doc_id, n)).doc_id", "min(x).doc_id"))
def chunk_hash_dedup(spark, sf):
    """Lines as chunks, the first of equal ones."""
    c = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).where("line <> ''")
    return dedup.keep_first(c, F.sha2("line", 256), "doc_id", "n").select(F.md5("line").alias("h"), "doc_id")


@query("SELECT lang, source, arg_max(doc_id, (quality, -doc_id)) AS doc_id, min(doc_id) AS slot FROM (SELECT d.doc_id, lang, source, quality FROM documents d JOIN labels USING (doc_id)) GROUP BY lang, source".replace("(quality, -doc_id)", "quality * 1000000000 - doc_id"))
def keep_best_dedup(spark, sf):
    """The best-labelled document per language and source, in the place of the first."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "source").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id").withColumn("slot", F.col("doc_id"))
    return dedup.keep_best(d, F.concat_ws("|", "lang", "source"), F.col("quality"), "slot").select("lang", "source", "doc_id", "slot")


@query("SELECT doc_id, used::BIGINT AS used FROM (SELECT doc_id, sum(strlen(text)) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS used FROM documents) WHERE used <= 100000")
def byte_budget(spark, sf):
    return dedup.prefix_budget(table(spark, sf, "documents").select("doc_id", "text"), F.octet_length("text"), 100_000, "doc_id").select("doc_id", "used")


@query("SELECT doc_id, source, used::BIGINT AS used FROM (SELECT doc_id, source, sum(length(text)) OVER w AS used, row_number() OVER w AS n FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)) WHERE used <= 5000 OR n = 1")
def page_budget(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "text")
    return dedup.prefix_budget(d, F.length("text"), 5000, "doc_id", partition=("source",), keep_one=True).select("doc_id", "source", F.col("used").cast("long").alias("used"))


@query("WITH c AS (SELECT user_id::VARCHAR AS corpus_id, epoch_ms(min(ts)) AS created_at, epoch_ms(max(ts)) AS last, (1000000 * count(*))::BIGINT AS b FROM events GROUP BY user_id), r AS (SELECT *, row_number() OVER (ORDER BY last DESC, corpus_id) AS n FROM c WHERE epoch_ms(TIMESTAMP '2024-02-01') - created_at <= 2678400000), s AS (SELECT *, sum(b) OVER (ORDER BY last DESC, corpus_id ROWS UNBOUNDED PRECEDING) AS run FROM r WHERE n <= 50) SELECT corpus_id FROM s WHERE run <= 500000000")
def lru_evict(spark, sf):
    ms = lambda f: F.unix_millis(f(F.col("ts")).cast("timestamp"))
    c = table(spark, sf, "events").groupBy(F.col("user_id").cast("string").alias("corpus_id")).agg(ms(F.min).alias("created_at"), ms(F.max).alias("last_accessed_at"), (F.count("*") * 1_000_000).alias("total_bytes"))
    return dedup.evict(c, 1_706_745_600_000, 31 * 86_400_000).select("corpus_id")


@query("WITH e AS (SELECT doc_id AS n, sha256(text) AS h FROM documents), a AS (SELECT n // 1000 AS b, sha256(string_agg(h, chr(10) ORDER BY n)) AS h FROM e GROUP BY 1), c AS (SELECT b // 1000 AS c, sha256(string_agg(h, chr(10) ORDER BY b)) AS h FROM a GROUP BY 1) SELECT sha256(string_agg(h, chr(10) ORDER BY c)) AS content_hash FROM c")
def content_hash(spark, sf):
    return retrieve.content_hash(table(spark, sf, "documents"), "text", "doc_id")


@query("""SELECT doc_id, sha256('{"lang":"' || lang || '","source":"' || source || '"}|model|64|{"overlap":50,"size":400}') AS corpus_id FROM documents""")
def corpus_id(spark, sf):
    from ragspark.sources import store

    source = F.to_json(F.struct("lang", "source"))
    return table(spark, sf, "documents").select("doc_id", store.corpus_key(source, "model", 64, size=400, overlap=50).alias("corpus_id"))


# --- hygiene ---------------------------------------------------------------------------------------------------------

TRIM = r"regexp_replace(regexp_replace({x}, '^\s+', ''), '\s+$', '')"
KEY = "lower(" + TRIM.replace("{x}", "line") + ")"
LINES = f"l AS (SELECT DISTINCT source, doc_id, {KEY} AS line FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length({KEY}) BETWEEN 1 AND 200), s AS (SELECT source, line, count(*) AS n FROM l GROUP BY source, line HAVING count(*) >= 2)"


@query(f"WITH {LINES} SELECT source, line, n FROM s")
def shared_lines(spark, sf):
    return hygiene.shared_lines(table(spark, sf, "documents"), "source", "doc_id", "text")


@query(
    f"WITH {LINES}, x AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), k AS (SELECT x.*, s.line IS NULL AS keep FROM x LEFT JOIN s ON s.source = x.source AND s.line = lower({TRIM.replace('{x}', 'x.line')})) SELECT doc_id, md5(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (keep), '')) AS h FROM k GROUP BY doc_id"
)
def shared_line_strip(spark, sf):
    return hygiene.without_shared(table(spark, sf, "documents").select("doc_id", "source", "text"), "source", "doc_id", "text").select("doc_id", F.md5("text").alias("h"))


STATS = r"""WITH p AS (SELECT doc_id, regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') AS t FROM documents),
l AS (SELECT doc_id, t, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '\S')) AS ls FROM p),
s AS (SELECT doc_id, t, len(ls) AS lines, coalesce(list_sum(list_transform(regexp_extract_all(t, '\[([^\]]+)\]\(([^)]+)\)'), lambda x: length(x))), 0) / nullif(length(t), 0) AS link_density,
len(list_filter(ls, lambda x: regexp_matches(x, '^\s*[-*+]\s|^\s*\d+\.\s'))) / nullif(len(ls), 0) AS list_density, len(list_filter(ls, lambda x: length(x) < 40)) / nullif(len(ls), 0) AS short_density,
list_sum(list_transform(ls, lambda x: len(list_filter(regexp_split_to_array(x, '\s+'), lambda y: y <> '')))) / nullif(len(ls), 0) AS words_per_line, contains(t, '```') AS code FROM l)
"""


@query(STATS + "SELECT doc_id, lines::BIGINT AS lines, round(link_density, 6) AS link_density, round(list_density, 6) AS list_density, round(short_density, 6) AS short_density, round(words_per_line, 6) AS words_per_line FROM s")
def line_density(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", hygiene.line_stats(F.col("text")).alias("s"))
    return d.select("doc_id", F.col("s.lines").cast("long").alias("lines"), *[F.round(F.col(f"s.{c}"), 6).alias(c) for c in ("link_density", "list_density", "short_density", "words_per_line")])


@query(STATS + "SELECT doc_id, lines = 0 OR (NOT code AND (link_density > 0.5 OR (list_density > 0.6 AND short_density > 0.7 AND link_density > 0.2) OR (list_density > 0.7 AND short_density > 0.8 AND words_per_line < 3))) AS boilerplate FROM s")
def boilerplate_flag(spark, sf):
    return table(spark, sf, "documents").select("doc_id", hygiene.line_stats(F.col("text")).alias("s")).select("doc_id", hygiene.is_boilerplate(F.col("s")).alias("boilerplate"))


@query(STATS + "SELECT doc_id, coalesce((link_density >= 0.2 AND link_density < 0.4) OR (words_per_line >= 3 AND words_per_line < 5), false) AS borderline FROM s")
def borderline_flag(spark, sf):
    return table(spark, sf, "documents").select("doc_id", hygiene.line_stats(F.col("text")).alias("s")).select("doc_id", hygiene.is_borderline(F.col("s")).alias("borderline"))


@query(
    rf"""WITH p AS (SELECT doc_id, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, CASE WHEN t = '' THEN 'empty' WHEN regexp_matches(t, '{hygiene.PLACEHOLDERS}') THEN 'placeholder'
WHEN length(t) < 40 AND NOT regexp_matches(text, '(^|\n)#{{1,6}}\s|(^|\n)([-*+]\s|\d+\.\s)|\|.*\|') THEN 'little' ELSE 'meaningful' END AS quality FROM p"""
)
def quality_flag(spark, sf):
    return table(spark, sf, "documents").select("doc_id", hygiene.quality(F.col("text")).alias("quality"))


BANNER = "(?i)" + "|".join(hygiene.BANNER_EXACT)


@query(
    rf"""WITH e AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
f AS (SELECT doc_id, i, regexp_matches(line, '{BANNER}') AS ex, regexp_matches(line, '{hygiene.BANNER_WORDS}') OR regexp_matches(line, '{BANNER}') AS w, regexp_matches(line, '{hygiene.BANNER_BUTTONS}') AS b FROM e WHERE regexp_matches(line, '\S')),
g AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - sum(w::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS island FROM f),
r AS (SELECT doc_id, island, w, count(*) AS n, count(*) FILTER (ex) AS ex, bool_or(b) AS b FROM g GROUP BY doc_id, island, w)
SELECT doc_id, sum(n)::BIGINT AS lines, sum(CASE WHEN NOT w THEN 0 WHEN n >= 3 AND b THEN n ELSE ex END)::BIGINT AS banner_lines, round(sum(CASE WHEN NOT w THEN 0 WHEN n >= 3 AND b THEN n ELSE ex END) / sum(n), 6) AS ratio FROM r GROUP BY doc_id"""
)
def banner_ratio(spark, sf):
    return hygiene.banner_ratio(table(spark, sf, "documents"), "doc_id", "text").withColumn("ratio", F.round("ratio", 6))


KINDS = ["email", "ipv4", "phone", "hex"]


@query(
    "SELECT doc_id, kind, value, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, unnest(regexp_extract_all(text, '{hygiene.ENTITY_PATTERNS[k]}')) AS value FROM documents" for k in KINDS) + ") GROUP BY ALL"
)
def regex_entities(spark, sf):
    return hygiene.entities(table(spark, sf, "documents"), "doc_id", "text", KINDS)


# --- HTML by expression ----------------------------------------------------------------------------------------------


@query(r"SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM pages")
def html_title(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"))


def _sql_decode(x: str) -> str:
    for e, v in T.ENTITIES:
        x = f"replace({x}, '{e}', '{v.replace(chr(39), chr(39) * 2)}')"
    return x


BARE = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?is)<noscript\b.*?</noscript\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"


@query(rf"SELECT page_id, md5(trim(regexp_replace({_sql_decode(BARE)}, '\s+', ' ', 'g'))) AS h FROM pages")
def html_strip(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(T.stripped_html(F.col("html"))).alias("h"))


@query(f"SELECT page_id, md5({_sql_decode('html')}) AS h FROM pages")
def entity_decode(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(T.decoded(F.col("html"))).alias("h"))


@query("""SELECT page_id, link, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM pages) GROUP BY ALL""")
def html_links(spark, sf):
    links = F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("link")
    return table(spark, sf, "pages").select("page_id", links).groupBy("page_id", "link").agg(F.count("*").alias("n"))


# --- conversations ---------------------------------------------------------------------------------------------------


def comments(spark, sf) -> DataFrame:
    """Every turn answers the one before it."""
    c = table(spark, sf, "conversations")
    up = F.when(F.col("turn") > F.min("turn").over(Window.partitionBy("conv_id")), F.concat(F.lit("t1_"), (F.col("turn") - 1).cast("string")))
    return c.select("conv_id", F.col("turn").cast("string").alias("id"), up.alias("parent_id"), F.col("role").alias("author"), F.col("text").alias("body"), F.lit(None).cast("string").alias("permalink"), F.col("turn").alias("position"))


@query("SELECT conv_id, turn, md5(CASE WHEN a IS NULL THEN text ELSE coalesce(b || chr(10), '') || a || chr(10) || chr(10) || text END) AS h FROM (SELECT conv_id, turn, text, lag(text) OVER w AS a, lag(text, 2) OVER w AS b FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))")
def parent_context(spark, sf):
    return threads.with_parents(comments(spark, sf), thread=("conv_id",)).select("conv_id", F.col("position").alias("turn"), F.md5("text").alias("h"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS depth FROM conversations")
def thread_flatten(spark, sf):
    c = comments(spark, sf).select("conv_id", "id", threads.bare_id(F.col("parent_id")).alias("parent_id"), "position")
    return threads.flattened(c, "conv_id", paths=False).select("conv_id", F.col("position").alias("turn"), F.col("depth").cast("long").alias("depth"))


def _branching(spark, sf) -> DataFrame:
    """Turn t answers turn (t - 1) // 2."""
    c = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("position"))
    return c.select("conv_id", F.col("position").cast("string").alias("id"), F.when(F.col("position") > 0, F.floor((F.col("position") - 1) / 2).cast("string")).alias("parent_id"), "position")


NESTED = """WITH RECURSIVE p AS (SELECT conv_id, turn, CASE WHEN turn > 0 THEN (turn - 1) // 2 END AS up FROM conversations),
t AS (SELECT conv_id, turn, 0 AS depth, [-turn] AS path FROM p WHERE up IS NULL UNION ALL SELECT p.conv_id, p.turn, t.depth + 1, list_append(t.path, -p.turn) FROM p JOIN t ON p.conv_id = t.conv_id AND p.up = t.turn),
n AS (SELECT a.conv_id, a.turn, a.depth, row_number() OVER (PARTITION BY a.conv_id ORDER BY a.path) - 1 AS lo, (SELECT count(*) FROM t b WHERE b.conv_id = a.conv_id AND b.path[1:len(a.path)] = a.path) AS size FROM t a)
"""


@query(NESTED + "SELECT conv_id, turn, depth::BIGINT AS depth, lo, lo + size - 1 AS hi FROM n")
def thread_intervals(spark, sf):
    """Nested intervals, the newest reply first."""
    return threads.nested(_branching(spark, sf), "conv_id", F.desc("position")).select("conv_id", F.col("position").alias("turn"), F.col("depth").cast("long").alias("depth"), "lo", "hi")


@query(NESTED + "SELECT n.conv_id, n.turn, (n.depth - f.depth)::BIGINT AS level, row_number() OVER (PARTITION BY n.conv_id ORDER BY n.lo) AS place FROM n JOIN n f ON f.conv_id = n.conv_id AND f.turn = 1 AND ((n.lo BETWEEN f.lo AND f.lo + f.size - 1 AND n.depth - f.depth < 2) OR (n.lo < f.lo AND n.lo + n.size - 1 >= f.lo AND n.depth >= f.depth - 1))")
def thread_focus(spark, sf):
    """Each conversation's turn 1 with its parent and its replies, not theirs; newest first."""
    tree = threads.nested(_branching(spark, sf), "conv_id", F.desc("position"))
    seen = threads.focused(tree, tree.select("conv_id", F.lit("1").alias("comment")).distinct(), "conv_id", context=1, depth=2)
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("lo"))
    return seen.select("conv_id", F.col("position").alias("turn"), F.col("level").cast("long").alias("level"), place.cast("long").alias("place"))


@query(
    r"""WITH RECURSIVE s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, length(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS c FROM conversations WHERE regexp_matches(text, '\S')),
f AS (SELECT conv_id, i, c AS chars, 1 AS n, 7.0::DOUBLE AS secs, 0 AS g FROM s WHERE i = 1
UNION ALL SELECT s.conv_id, s.i, CASE WHEN x THEN s.c ELSE f.chars + 1 + s.c END, CASE WHEN x THEN 1 ELSE f.n + 1 END, CASE WHEN x THEN 7.0 ELSE f.secs + 7 END, CASE WHEN x THEN f.g + 1 ELSE f.g END
FROM (SELECT f.*, s.c AS nc, s.i AS ni, f.n >= 12 OR f.chars + 1 + s.c > 1200 OR f.secs + 7 > 60 AS x FROM f JOIN s ON s.conv_id = f.conv_id AND s.i = f.i + 1) f JOIN s ON s.conv_id = f.conv_id AND s.i = f.ni)
SELECT conv_id, g::BIGINT AS chunk_index, count(*) AS segments FROM f GROUP BY conv_id, g"""
)
def transcript_groups(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("seg_no"), "text", (F.col("turn") * 7.0).alias("offset"), F.lit(7.0).alias("duration"))
    return threads.transcript_chunks(c, "conv_id").select("conv_id", "chunk_index", "segments")


# --- listings --------------------------------------------------------------------------------------------------------

WANT = listings.Constraints(location=("asia", "europe"), work_mode=("remote", "hybrid"), max_salary=8000.0, exclude_titles=("000000007",))
LISTING = """SELECT s_suppkey AS id, s_name AS title, CASE WHEN s_suppkey % 4 > 0 THEN n_name END AS company, CASE WHEN s_suppkey % 5 > 0 THEN r_name || ', ' || n_name END AS location,
['remote', 'hybrid', 'onsite', 'unknown'][(s_suppkey % 4 + 1)::INT] AS work_mode, CASE WHEN s_suppkey % 3 > 0 THEN '$' || (floor(abs(s_acctbal))::BIGINT // 100)::VARCHAR || ' - ' || (floor(abs(s_acctbal))::BIGINT // 1000)::VARCHAR || 'k' END AS salary_raw,
CASE s_suppkey % 4 WHEN 0 THEN 'Posted 3 days ago' WHEN 1 THEN '2024-01-10' WHEN 2 THEN 'posted today' ELSE '45 days ago' END AS posted_raw, (s_suppkey % 10) / 10.0::DOUBLE AS semantic
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
PASSED = f"""WITH l AS ({LISTING}), m AS (SELECT *, greatest(regexp_extract(salary_raw, '\\$(\\d+)', 1)::DOUBLE, 1000 * regexp_extract(salary_raw, '(\\d+)k', 1)::DOUBLE) AS pay FROM l),
p AS (SELECT * FROM m WHERE (location IS NULL OR contains(lower(location), 'asia') OR contains(lower(location), 'europe')) AND work_mode IN ('remote', 'hybrid', 'unknown') AND coalesce(pay <= 8000, true) AND NOT contains(lower(title), '000000007'))
"""


def listing_rows(spark, sf) -> DataFrame:
    s, n, r = table(spark, sf, "supplier"), table(spark, sf, "nation"), table(spark, sf, "region")
    j = s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    k, pay = F.col("s_suppkey"), F.floor(F.abs("s_acctbal"))
    whole = lambda d: F.floor(pay / d).cast("string")
    return j.select(
        k.alias("id"),
        F.col("s_name").alias("title"),
        F.when(k % 4 > 0, F.col("n_name")).alias("company"),
        F.when(k % 5 > 0, F.concat("r_name", F.lit(", "), "n_name")).alias("location"),
        F.element_at(F.array(*map(F.lit, ("remote", "hybrid", "onsite", "unknown"))), (k % 4 + 1).cast("int")).alias("work_mode"),
        F.when(k % 3 > 0, F.concat(F.lit("$"), whole(100), F.lit(" - "), whole(1000), F.lit("k"))).alias("salary_raw"),
        F.when(k % 4 == 0, "Posted 3 days ago").when(k % 4 == 1, "2024-01-10").when(k % 4 == 2, "posted today").otherwise("45 days ago").alias("posted_raw"),
        ((k % 10) / 10.0).alias("semantic"),
    )


@query(PASSED + "SELECT id FROM p")
def listing_filters(spark, sf):
    return listing_rows(spark, sf).where(listings.passes(WANT)).select("id")


@query(
    PASSED
    + """, c AS (SELECT *, CASE WHEN location IS NULL THEN 0 ELSE 1 END AS l_, CASE WHEN work_mode = 'unknown' THEN 0 ELSE 1 END AS m_, CASE id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.7 WHEN 2 THEN 1.0 ELSE 0.3 END AS r_,
((company IS NOT NULL)::INT + (location IS NOT NULL)::INT + (salary_raw IS NOT NULL)::INT + (work_mode <> 'unknown')::INT) / 4 AS k_ FROM p)
SELECT id, round((semantic * 0.45 + l_ * 0.2 + m_ * 0.15 + r_ * 0.1 + k_ * 0.1)::DOUBLE, 6) AS overall, concat_ws('; ', CASE WHEN contains(lower(location), 'asia') THEN 'location: asia' WHEN contains(lower(location), 'europe') THEN 'location: europe' END,
CASE WHEN work_mode <> 'unknown' THEN 'work mode: ' || work_mode END, CASE WHEN pay <= 8000 THEN 'salary within budget' END) AS matched FROM c"""
)
def listing_rank(spark, sf):
    return listings.rank(listing_rows(spark, sf), WANT, AS_OF).select("id", "overall", F.array_join("matched", "; ").alias("matched"))


# --- Arrow passes, sources and the stream ----------------------------------------------------------------------------


@query()
def html_elements(spark, sf):
    from ragspark.operators import elements

    return elements.extract(table(spark, sf, "pages"), "page_id", "html")


@query()
def element_topn_restore(spark, sf):
    from ragspark.operators import elements

    return elements.finalized(elements.extract(table(spark, sf, "pages"), "page_id", "html"), "page_id", 5)


@query()
def page_article(spark, sf):
    from ragspark.sources import web

    return web.read_pages(table(spark, sf, "pages"))


@query()
def chunk_documents(spark, sf):
    from ragspark.operators import chunking

    return chunking.chunks(table(spark, sf, "documents"), "doc_id", "text")


@query()
def chunk_pages(spark, sf):
    from ragspark.operators import chunking
    from ragspark.sources import web

    return chunking.chunks(web.read_pages(table(spark, sf, "pages")), "page_id", "text")


@query()
def semantic_crawl(spark, sf):
    from ragspark.plans import tools
    from ragspark.sources import web

    pages = web.read_pages(table(spark, sf, "pages"))
    rows, _ = tools.semantic_crawl(pages, QUESTION)
    return rows.select("position", "page_id", "section", "fused_score", "rank")


@query()
def semantic_reddit(spark, sf):
    from ragspark.plans import tools

    rows, _ = tools.semantic_reddit(comments(spark, sf).withColumnRenamed("conv_id", "thread"), QUESTION)
    return rows.select("thread", "id", "fused_score", "rank")


@query("SELECT event_id, json_extract_string(props, '$.k')::VARCHAR AS k FROM events")
def json_props(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_counts(spark, sf):
    """The events as a stream over the file, counted per day and type."""
    from ragspark.operators.tables import folder
    from ragspark.streaming import events

    shape = table(spark, sf, "events").schema
    stream = spark.readStream.schema(shape).option("pathGlobFilter", "events.parquet").parquet(sf)
    out = events.run_available(events.counts(stream, "event_type"), folder(spark))
    return out.select(F.unix_micros("start").alias("start"), "event_type", "n")


@query(
    f"SELECT o_orderkey, CASE WHEN k = 0 THEN n::DOUBLE WHEN k = 1 THEN n * 7.0::DOUBLE WHEN k = 2 THEN round(n / 24.0::DOUBLE, 6) ELSE round((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(o_orderdate::DATE::TIMESTAMP)) / 86400000000.0, 6) END AS days FROM (SELECT *, o_orderkey % 4 AS k, o_orderkey % 50 AS n FROM orders)"
)
def age_days(spark, sf):
    k, n = F.col("o_orderkey") % 4, (F.col("o_orderkey") % 50).cast("string")
    text = F.when(k == 0, F.concat(n, F.lit(" days ago"))).when(k == 1, F.concat(n, F.lit(" weeks ago"))).when(k == 2, F.concat(n, F.lit(" hours ago"))).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, sf, "orders").select("o_orderkey", F.round(N.age_days(text, AS_OF), 6).alias("days"))


@query("SELECT c_custkey, greatest(floor(abs(c_acctbal))::BIGINT % 1000 * 1000, (floor(abs(c_acctbal))::BIGINT // 10))::DOUBLE AS pay FROM customer")
def salary_max(spark, sf):
    whole = F.floor(F.abs("c_acctbal"))
    text = F.concat(F.lit("$"), F.format_string("%,d", F.floor(whole / 10)), F.lit(" to "), (whole % 1000).cast("string"), F.lit("k a year"))
    return table(spark, sf, "customer").select("c_custkey", N.salary_max(text).alias("pay"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'vid' || lpad(o_orderkey::VARCHAR, 8, '0') WHEN o_orderkey % 3 = 1 THEN 'vid' || lpad(o_orderkey::VARCHAR, 8, '0') END AS video FROM orders")
def video_ids(spark, sf):
    own = F.concat(F.lit("vid"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0"))
    text = F.when(F.col("o_orderkey") % 3 == 0, own).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("https://www.youtube.com/watch?list=a&v="), own, F.lit("&t=3"))).otherwise(F.concat(F.lit("https://example.com/"), own))
    return table(spark, sf, "orders").select("o_orderkey", U.video_id(text).alias("video"))


@query("WITH f AS (SELECT p_partkey, ['src', 'docs', 'node_modules', 'lib', 'tests'][(p_partkey % 5 + 1)::INT] || '/' || replace(p_name, ' ', '_') || ['.py', '.md', '.png'][(p_partkey % 3 + 1)::INT] AS path, (p_partkey * 400)::BIGINT AS size FROM part), k AS (SELECT p_partkey, path, round((25.0 * (starts_with(path, 'src/') OR starts_with(path, 'lib/'))::INT - 25.0 * (starts_with(path, 'docs/') OR starts_with(path, 'tests/'))::INT - 4.0 - length(path) / 1000.0)::DOUBLE, 6) AS priority FROM f WHERE NOT starts_with(path, 'node_modules/') AND ((ends_with(path, '.py') AND size <= 100000) OR (ends_with(path, '.md') AND size <= 500000))) SELECT * FROM k ORDER BY priority DESC, path, p_partkey LIMIT 100".replace("priority DESC, path, p_partkey", "priority DESC, path, p_partkey"))
def repository_files(spark, sf):
    from ragspark.sources import records

    p, k = table(spark, sf, "part"), F.col("p_partkey")
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (k % n + 1).cast("int"))
    files = p.select("p_partkey", F.concat(pick(("src", "docs", "node_modules", "lib", "tests"), 5), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_")), pick((".py", ".md", ".png"), 3)).alias("path"), F.lit("file").alias("type"), (k * 400).alias("size"))
    kept = files.where(records.is_corpus_file(F.col("path"), F.col("type"), F.col("size")))
    return kept.select("p_partkey", "path", F.round(records.file_priority(F.col("path")), 6).alias("priority")).orderBy(F.desc("priority"), "path", "p_partkey").limit(100)


@query(POOLS + ", t AS (SELECT doc_id, list_transform(regexp_extract_all(text, '\\w+'), lambda x: lower(x)) AS w FROM documents JOIN g USING (doc_id) WHERE rank <= 30), s AS (SELECT doc_id, round(len(list_intersect(list_distinct(w), ['and', 'ering', 'of', 'stion', 'the', 'thention'])) / 6.0::DOUBLE + 1.0::DOUBLE / (10.0 + len(w)), 6) AS rerank_score FROM t) SELECT doc_id, rerank_score, row_number() OVER (ORDER BY rerank_score DESC, doc_id) AS rerank_rank, round(rerank_score - (SELECT median(rerank_score) FROM s), 6) AS median_delta FROM s ORDER BY rerank_score DESC, doc_id LIMIT 10")
def rerank_topk(spark, sf):
    first = hybrid(spark, sf, pool_vectors=30, pool_words=10).join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return retrieve.rerank(first, retrieve.overlap_scorer(QUESTION), 10, key="doc_id").select("doc_id", "rerank_score", "rerank_rank", "median_delta")


@query(
    STATS
    + f", e AS (SELECT s.doc_id, embedding, coalesce((link_density >= 0.2 AND link_density < 0.4) OR (words_per_line >= 3 AND words_per_line < 5), false) AS b FROM s JOIN embeddings ON vec_id = s.doc_id), m AS (SELECT i, avg(x::DOUBLE) AS m FROM (SELECT unnest(embedding) AS x, unnest(range(64)) AS i FROM e) GROUP BY i), c AS (SELECT list(m ORDER BY i) AS ce FROM m) SELECT doc_id FROM e, c WHERE NOT b OR {cos('embedding', 'ce')} >= 0.2"
)
def coherence_filter(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), "doc_id")
    return retrieve.coherent(d, hygiene.is_borderline(hygiene.line_stats(F.col("text")))).select("doc_id")

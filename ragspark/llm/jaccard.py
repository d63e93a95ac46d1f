"""N-gram Jaccard join with token-combination prefixes.

The tokens of a document are the 64-bit hashes of its distinct word shingles. They are ordered by document frequency
(exact counts over the corpus, on a log scale) and hash. A pair at or above the threshold shares all but a quarter
of either set, so it suffices to look at prefixes of that order:

* a rare token (frequency up to RARE) is a signature of its own; one that no other document has needs none;
* frequent tokens fall into groups by hash, and each pair of a group's tokens in the prefix is a signature;
* a prefix is extended until (rare tokens) + sum over groups (tokens - 1) exceeds what a partner may lack, so that
  two sets without a common signature differ in too many tokens.

The number of groups follows the set size (a level per power of two); a set near the upper end of its level also
sends its signatures for the next one, so partners of different levels meet in the larger one's.

Documents with equal sets are one class. Classes that share a signature form a list, without the classes whose
prefix is too long for every partner there. No list is expanded into all its pairs while its members may still prove
connected: first each list's pivot is compared with its members; then, in rounds, a list that still holds several
components gets fresh pivots, four times as many each round, which are compared with the members of other components
only and then leave the list. It ends when no list holds two components; the last rounds of a list that never becomes
one compare all that its prefixes allow, so no link is lost. Every comparison is exact on the shingle sets; the
components are those of all links. Shingles, classes and signatures are told apart by 64-bit hashes.

Defined results: null or empty text, or one without words, has no shingles and links with nothing; with fewer words
than a shingle the whole sequence is one; a text of any length is taken whole; repeated rows are equal documents; a
null key is never the smallest, and a component of null keys only has a null id; keys are whole numbers (or text that
casts to long); other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.llm import chunked as C
from ragspark.llm import kernel as K
from ragspark.llm.shared import save

SHINGLE, PERCENT, RARE, SMALL_LEVEL = 5, 75, 64, 5


class Sets:
    """The distinct shingles of a chunk's texts: ``tokens`` sorted within each text, ``first`` where it begins."""

    def __init__(self, data: np.ndarray, off: np.ndarray, k: int = SHINGLE):
        data = K.LOWER[data]
        starts, ends, first = K.words(data, off)
        hashes = K.hash_ranges(data, starts, ends)
        hashed = K.windows(hashes, k)
        place = np.flatnonzero(K.inside_text(first, k, len(hashed)))
        doc = np.searchsorted(first, place, "right") - 1
        value = hashed[place]
        size = np.diff(first)
        short = np.flatnonzero((size > 0) & (size < k))
        if len(short):
            whole = np.array([K.windows(hashes[first[d] : first[d + 1]], int(size[d]))[0] ^ K.U64(size[d]) for d in short], K.U64)
            doc, value = np.append(doc, short), np.append(value, K.mix(whole))
        order = np.lexsort((value, doc))
        doc, value = doc[order], value[order]
        new = np.ones(len(doc), bool)
        if len(doc):
            new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
        self.doc, self.tokens = doc[new], value[new]
        self.first = np.searchsorted(self.doc, np.arange(len(off)))
        self.size = np.diff(self.first)
        # The class of equal sets: an order-independent hash and the size.
        total = np.concatenate((np.zeros(1, K.U64), np.cumsum(K.mix(self.tokens ^ K._M3))))
        self.cls = K.mix((total[self.first[1:]] - total[self.first[:-1]]) ^ (self.size.astype(K.U64) * K._M2)).view(np.int64)
        once = np.zeros(len(self.size), bool)
        once[np.unique(self.cls, return_index=True)[1]] = True
        self.once = once & (self.size > 0)  # one text of each class, none of the empty class


def _members(batches):
    for chunk, ids, off, body in C.rows_of(batches, ["chunk", "ids", "off", "body"]):
        s, ids = Sets(*C.unpack(off.as_py(), body.as_py())), ids.as_py()
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(s.size), pa.array(s.cls), pa.array([chunk.as_py()] * len(ids), pa.int64())], names=["key", "n_shingles", "cls", "chunk"])


def _counted(s: Sets, buckets: int):
    """Where the tokens of one text per class are, and C.distinct of them."""
    at = np.flatnonzero(s.once[s.doc])
    return at, *C.distinct(s.tokens[at], buckets)


def _send_tokens(buckets: int):
    """Payloads: the number of tokens, their fingerprints, the bits of those that several texts hold, their counts."""

    def run(batches):
        for chunk, off, body in C.rows_of(batches, ["chunk", "off", "body"]):
            _, values, count, _, spans = _counted(Sets(*C.unpack(off.as_py(), body.as_py())), buckets)
            prints, many = C.fingerprint(values, buckets), count > 1
            parts = []
            for b, i, j in spans:
                parts.append((b, np.array([j - i], "<u4").tobytes() + prints[i:j].tobytes() + np.packbits(many[i:j]).tobytes() + count[i:j][many[i:j]].astype("<u4").tobytes()))
            yield C.sent(chunk.as_py(), parts)

    return run


def _frequency(bucket: int, payloads: list[bytes]) -> list[bytes | None]:
    """For each payload the bits of the tokens that others have too, then their frequencies: 8 * log2, in a byte."""
    sizes = [int(np.frombuffer(p, "<u4", 1)[0]) for p in payloads]
    prints = np.concatenate([np.frombuffer(p, "<u4", n, 4) for p, n in zip(payloads, sizes, strict=True)])
    weight = np.ones(len(prints), np.int64)
    many = np.concatenate([np.unpackbits(np.frombuffer(p, np.uint8, -(-n // 8), 4 + 4 * n), count=n) for p, n in zip(payloads, sizes, strict=True)]).astype(bool)
    weight[many] = np.concatenate([np.frombuffer(p, "<u4", offset=4 + 4 * n + -(-n // 8)) for p, n in zip(payloads, sizes, strict=True)])
    order = np.argsort(prints)
    head = np.flatnonzero(np.concatenate(([True], prints[order][1:] != prints[order][:-1])))
    count = np.add.reduceat(weight[order], head)
    scale = np.zeros(len(prints), np.uint8)
    scale[order] = np.repeat(np.minimum(255, 8 * np.log2(count)).astype(np.uint8), np.diff(np.append(head, len(prints))))
    at = np.cumsum([0, *sizes])
    return [np.packbits(own > 0).tobytes() + own[own > 0].tobytes() if (own := scale[i:j]).any() else None for i, j in zip(at[:-1], at[1:], strict=True)]


def signatures(tokens: np.ndarray, scale: np.ndarray, percent: int = PERCENT, rare: int = RARE) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of one set and what each costs: the prefix that ends with it tells apart sets that lack so many
    tokens. ``scale`` is 8 * log2 of each token's frequency, 0 where no other set has it."""
    n = len(tokens)
    may_lack = n - -(-percent * n // 100)
    order = np.lexsort((tokens, scale))
    tokens, scale = tokens[order], scale[order]
    often = scale > 8 * math.log2(rare)
    level = n.bit_length() - 1
    out, cost = [], []
    for own in (level, level + 1):
        if own > level and 100 * n < percent * (1 << own):
            break
        salt = K.U64(own * int(K._M2) % (1 << 64))
        group = np.where(often, (tokens >> K.U64(7)).astype(np.int64) % (1 << max(0, own - 3)), -1) if own >= SMALL_LEVEL else np.full(n, -1)
        gain = np.ones(n, np.int64)
        frequent = np.flatnonzero(group >= 0)
        if len(frequent):
            gain[frequent[np.unique(group[frequent], return_index=True)[1]]] = 0
        gain = np.cumsum(gain)
        end = int(np.searchsorted(gain, may_lack + 1)) + 1
        one = (group[:end] < 0) & (scale[:end] > 0)
        out.append(K.mix(tokens[:end][one] ^ salt))
        cost.append(gain[:end][one])
        if len(frequent) and frequent[0] < end:
            at = frequent[frequent < end]
            at = at[np.argsort(group[at], kind="stable")]
            for step in range(1, len(at)):  # pairs at this distance within a group
                same = group[at[step:]] == group[at[:-step]]
                if not same.any():
                    break
                a, b = tokens[at[:-step][same]], tokens[at[step:][same]]
                out.append(K.mix(np.minimum(a, b) * K._M1 + np.maximum(a, b) ^ salt))
                cost.append(gain[at[step:][same]])
    return np.concatenate(out), np.concatenate(cost)


def _send_signatures(token_buckets: int, buckets: int, percent: int):
    def run(batches):
        for chunk, off, body, known in C.rows_of(batches, ["chunk", "off", "body", "known"]):
            if not (known := C.payloads(known)):
                continue
            s = Sets(*C.unpack(off.as_py(), body.as_py()))
            at, values, _, own, spans = _counted(s, token_buckets)
            told = np.zeros(len(values), np.uint8)
            for b, p in known.items():
                i, j = spans.at(b)
                n = j - i
                bits = -(-n // 8)
                told[i + np.flatnonzero(np.unpackbits(np.frombuffer(p, np.uint8, bits), count=n))] = np.frombuffer(p, np.uint8, offset=bits)
            scale = np.zeros(len(s.tokens), np.uint8)
            scale[at] = told[own]
            shared = np.add.reduceat(scale > 0, np.minimum(s.first[:-1], len(scale) - 1)) * (s.size > 0) if len(scale) else np.zeros(len(s.size))
            made, costs, owner = [], [], []
            for d in np.flatnonzero(s.once & (shared > 0)).tolist():
                i, j = s.first[d], s.first[d + 1]
                own, cost = signatures(s.tokens[i:j], scale[i:j], percent)
                made.append(own)
                costs.append(cost)
                owner.append(np.full(len(own), d))
            if not made:
                continue
            made, costs, owner = np.concatenate(made), np.concatenate(costs), np.concatenate(owner)
            order, spans = C.bucket_order(made, buckets)
            made, costs, owner = made[order], costs[order].astype("<u4"), owner[order]
            cls, size = s.cls[owner], s.size[owner].astype("<u4")
            yield C.sent(chunk.as_py(), [(b, made[i:j].tobytes() + cls[i:j].tobytes() + size[i:j].tobytes() + costs[i:j].tobytes()) for b, i, j in spans])

    return run


LISTS = "list long, cls long, size int, cost int, pivot long, pivot_size int, pivot_cost int"


def _lists(percent: int):
    """Rows of LISTS for the lists with two classes or more; equal lists of a bucket once, with their least costs."""

    def run(batches):
        now, held = None, []
        for bucket, payload in C.rows_of(batches, ["bucket", "payload"]):
            bucket = bucket.as_py()
            if bucket != now and held:
                yield from _listed(held, percent)
                held = []
            now = bucket
            held.append(payload.as_py())
        if held:
            yield from _listed(held, percent)

    return run


def _listed(held: list[bytes], percent: int):
    sizes = [len(p) // 24 for p in held]
    part = lambda kind, skip: np.concatenate([np.frombuffer(p, kind, n, skip * n) for p, n in zip(held, sizes, strict=True)])
    sig, cls, size, cost = part("<u8", 0), part("<i8", 8), part("<u4", 16), part("<u4", 20)
    order = np.lexsort((cost, cls, sig))
    sig, cls, size, cost = sig[order], cls[order], size[order], cost[order]
    keep = np.concatenate(([True], (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1])))
    sig, cls, size, cost = _alive(sig[keep], cls[keep], size[keep].astype(np.int64), cost[keep].astype(np.int64), percent)
    if not len(sig):
        return
    head = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
    count = np.diff(np.append(head, len(sig)))
    name = np.add.reduceat(K.mix(cls.view(K.U64) ^ K._M1), head)
    _, chosen, same = np.unique(name, return_index=True, return_inverse=True)
    # The least cost of a class in equal lists: their members are in one order.
    owner, at = K.many(count)
    target = head[chosen][same][owner] + at
    least = cost.copy()
    np.minimum.at(least, target, cost)
    out = np.zeros(len(head), bool)
    out[chosen] = True
    every = np.repeat(out & (count > 1), count)
    pivot = np.repeat(_cheapest(least, head), count)
    rows = (np.repeat(name.view(np.int64), count), cls, size.astype(np.int32), least.astype(np.int32), cls[pivot], size[pivot].astype(np.int32), least[pivot].astype(np.int32))
    yield pa.RecordBatch.from_arrays([pa.array(x[every]) for x in rows], names=[f.split()[0] for f in LISTS.split(", ")])


def _alive(sig, cls, size, cost, percent: int):
    """The entries, sorted by list and class, without those whose prefix no partner in their list is short enough
    for: a class of ``size`` may lack ``cost`` - 1 tokens beside one of ``most`` tokens at most."""
    while len(sig):
        most = (100 + percent) * (size + 1 - cost) // percent - size
        order = np.lexsort((size, sig))
        same = np.cumsum(np.concatenate(([0], sig[order][1:] != sig[order][:-1])))
        span = int(max(size.max(), most.max()) - min(0, most.min())) + 2
        # In the order of sizes within a list: the largest bound among the partners small enough for this entry.
        bound = np.maximum.accumulate(same * span + most[order])
        at = np.searchsorted(same * span + size[order], same * span + np.minimum(most[order], span - 1), "right") - 1
        fits = (at >= 0) & (same[at] == same) & (bound[at] - same * span >= size[order])
        fits &= np.bincount(same)[same] > 1
        if fits.all():
            return sig, cls, size, cost
        live = np.sort(order[fits])
        sig, cls, size, cost = sig[live], cls[live], size[live], cost[live]
    return sig, cls, size, cost


def _cheapest(cost: np.ndarray, head: np.ndarray) -> np.ndarray:
    """The first of the entries with the least cost in each list."""
    low = np.repeat(np.minimum.reduceat(cost, head), np.diff(np.append(head, len(cost))))
    at = np.flatnonzero(cost == low)
    return at[np.searchsorted(at, head)]


def _may_link(percent: int) -> str:
    """Whether a shared signature lies in the prefixes that this pair needs: a cost is at most what a set may lack."""
    both = f"ceil({percent} * (sa + sb) / {100 + percent}.0)"
    return f"ka <= sa - {both} + 1 AND kb <= sb - {both} + 1"


def _texts(batches):
    """(cls, body) of the classes that a chunk is asked for."""
    pack = zstandard.ZstdCompressor(level=6)
    for off, body, asked in C.rows_of(batches, ["off", "body", "asked"]):
        asked = set(asked.as_py() or [])
        if not asked:
            continue
        data, at = C.unpack(off.as_py(), body.as_py())
        s = Sets(data, at)
        got = [d for d in np.flatnonzero(s.once).tolist() if int(s.cls[d]) in asked]
        yield pa.RecordBatch.from_arrays([pa.array([int(s.cls[d]) for d in got], pa.int64()), pa.array([pack.compress(data[at[d] : at[d + 1]].tobytes()) for d in got], pa.binary())], names=["cls", "body"])


def _compare(percent: int):
    """Rows come by pivot and salt, the pivot's own first; the links come out."""

    def run(batches):
        key, mine = None, None
        for b in batches:
            out = []
            for pivot, salt, other, body in zip(*(b.column(b.schema.get_field_index(c)) for c in ("pivot", "salt", "other", "body")), strict=True):
                body = zstandard.decompress(body.as_py())
                own = Sets(np.frombuffer(body, np.uint8), np.array([0, len(body)])).tokens
                at = (pivot.as_py(), salt.as_py())
                if other.as_py() is None:
                    key, mine = at, own
                    continue
                assert key == at, "a pivot's text is missing"
                both = len(mine) + len(own) - len(np.unique(np.concatenate((mine, own))))
                if 100 * both >= percent * (len(mine) + len(own) - both):
                    out.append((at[0], other.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([z for _, z in out], pa.int64())], names=["a", "b"])

    return run


def links(pairs: DataFrame, texts: DataFrame, parts: int, percent: int = PERCENT, each: int = 256) -> DataFrame:
    """The pairs (a, b) at or above the threshold. A pivot's text goes once to every ``each`` of its partners."""
    width = pairs.groupBy("a").agg(F.ceil(F.count("*") / each).alias("width"))
    dealt = pairs.join(width, "a").select("a", "b", (F.abs(F.xxhash64("b") % F.col("width"))).alias("salt"))
    partners = dealt.join(texts, dealt["b"] == texts["cls"]).select(F.col("a").alias("pivot"), "salt", F.col("b").alias("other"), "body")
    pivots = width.select("a", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("salt")).join(texts, F.col("a") == texts["cls"]).select(F.col("a").alias("pivot"), "salt", F.lit(None).cast("long").alias("other"), "body")
    both = pivots.unionByName(partners).repartition(parts, "pivot", "salt").sortWithinPartitions("pivot", "salt", F.col("other").asc_nulls_first())
    return both.mapInArrow(_compare(percent), "a long, b long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(cls, comp): the smallest node of each connected component, for the nodes of ``edges`` (a, b).

    Every round hooks each label to the smallest label among the neighbours and then follows labels of labels; the
    edges move up to the labels, so they become few."""
    edges = save(edges.select("a", "b").where("a <> b"), "edges")
    names = save(edges.select(F.col("a").alias("cls")).union(edges.select("b")).distinct().withColumn("comp", F.col("cls")), "names")
    for _ in range(rounds):
        if edges.isEmpty():
            return names
        both = edges.union(edges.select("b", "a"))
        up = save(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("to")), "hooks")
        jump = up.alias("x").join(up.alias("y"), F.col("x.to") == F.col("y.node"), "left").select(F.col("x.node").alias("node"), F.coalesce("y.to", "x.to").alias("to"))
        jump = save(jump, "jumps")
        names = save(names.join(jump, names["comp"] == jump["node"], "left").select("cls", F.coalesce("to", "comp").alias("comp")), "names")
        moved = edges.join(jump.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a").join(jump.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
        edges = save(moved.where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges")
    raise RuntimeError("components did not settle")


def merged(comp: DataFrame, found: DataFrame) -> DataFrame:
    """Components after adding links between classes; ``comp`` may lack single classes."""
    own = lambda df, c: df.join(comp.select(F.col("cls").alias(c), F.col("comp").alias(f"c{c}")), c, "left").withColumn(f"c{c}", F.coalesce(f"c{c}", c))
    new = components(own(own(found, "a"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    named = comp.join(new.select(F.col("cls").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("cls", F.coalesce("to", "comp").alias("comp"))
    fresh = new.join(comp, "cls", "left_anti").select("cls", "comp")
    return save(named.unionByName(fresh), "components")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """A row per document: key, n_shingles, class (equal sets) and component_id (the smallest key reachable)."""
    chunks = C.build(docs, key, text)
    parts = chunks.parts
    members = save(chunks.table.select("chunk", "ids", "off", "body").mapInArrow(_members, "key long, n_shingles long, cls long, chunk long"), "members")
    token_buckets, buckets = chunks.buckets(6 << 20), chunks.buckets(32 << 20)
    tokens = chunks.table.select("chunk", "off", "body").mapInArrow(_send_tokens(token_buckets), C.SENT)
    known = save(C.meet(tokens, parts, _frequency), "frequency")
    sent = C.joined(chunks, known=known).select("chunk", "off", "body", "known").mapInArrow(_send_signatures(token_buckets, buckets, percent), C.SENT)
    lists = sent.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_lists(percent), LISTS)
    same = [F.first(c).alias(c) for c in ("size", "pivot", "pivot_size")] + [F.min(c).alias(c) for c in ("cost", "pivot_cost")]
    lists = save(lists.groupBy("list", "cls").agg(*same), "lists")
    near = _may_link(percent)

    asked = lists.select("cls").distinct().join(members.where("n_shingles > 0").groupBy("cls").agg(F.min("chunk").alias("chunk")), "cls").groupBy("chunk").agg(F.collect_list("cls").alias("asked"))
    texts = save(chunks.table.select("chunk", "off", "body").join(asked.hint("shuffle_hash"), "chunk").select("off", "body", "asked").mapInArrow(_texts, "cls long, body binary"), "texts")

    # 1. Each list's pivot against its members.
    star = lists.where("cls <> pivot").selectExpr("pivot AS a", "cls AS b", "pivot_size AS sa", "size AS sb", "pivot_cost AS ka", "cost AS kb")
    tested = save(star.where(near).selectExpr("least(a, b) AS a", "greatest(a, b) AS b").distinct(), "tested")
    comp = save(components(links(tested, texts, parts, percent)), "components")

    # 2. Fresh pivots for the lists whose classes are not in one component, until there are none.
    left, n = lists.select("list", "cls", "size", "cost"), 1
    while True:
        named = save(left.join(comp, "cls", "left").select("list", "cls", "size", "cost", F.coalesce("comp", "cls").alias("comp")), "named")
        mixed = named.groupBy("list").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("list")
        left = save(named.join(mixed, "list", "left_semi"), "left")
        if left.isEmpty():
            break
        pivots = left.groupBy("list", F.pmod(F.xxhash64("cls"), F.lit(n)).alias("part")).agg(F.min_by(F.struct("cls", "size", "cost", "comp"), F.struct("cost", F.xxhash64("cls", F.lit(n)))).alias("p"))
        pivots = save(pivots.selectExpr("list", "p.cls AS pivot", "p.size AS sa", "p.cost AS ka", "p.comp AS own"), "pivots")
        met = pivots.join(left.selectExpr("list", "cls", "size AS sb", "cost AS kb", "comp"), "list").where("own <> comp AND pivot <> cls").where(near)
        pairs = met.selectExpr("least(pivot, cls) AS a", "greatest(pivot, cls) AS b").distinct().join(tested, ["a", "b"], "left_anti")
        pairs = save(pairs, "pairs")
        if not pairs.isEmpty():
            comp = merged(comp, links(pairs, texts, parts, percent))
            tested = tested.unionByName(pairs)
        left, n = left.drop("comp").join(pivots.select("list", F.col("pivot").alias("cls")), ["list", "cls"], "left_anti"), 4 * n

    lowest = members.groupBy("cls").agg(F.min("key").alias("low")).join(comp, "cls", "left").select("cls", "low", F.coalesce("comp", "cls").alias("comp"))
    lowest = save(lowest, "lowest")
    final = lowest.join(comp.select("comp").distinct(), "comp", "left_semi").groupBy("comp").agg(F.min("low").alias("least"))
    of_class = save(lowest.join(final, "comp", "left").select("cls", F.coalesce("least", "low").alias("component_id")), "classes")
    out = members.join(of_class, "cls").select(F.col("key").alias(key), "n_shingles", F.col("cls").alias("class"), F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("key")).alias("component_id"))
    return out

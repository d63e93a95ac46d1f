"""Benchmark decontamination with training suffix arrays.

Each shard of the training text gets a suffix array over its words: all suffixes of its texts, in the order of their
first ``width`` words, by prefix doubling on word ranks. The suffixes of the test items are binary-searched in it,
which yields all verbatim matches of ``width`` words with their places, and neighbouring ones are joined to the longest
matches. Equal test suffixes are searched once, and only those whose first LEAD words stand together in the shard, a
slice of them at a time. A shard is as large as a quarter of the items' block, 1 MB at least and 8 MB at most, so that
what a block costs is spread over much text, in bounded memory.

The test items are the stated query set: they are dealt into blocks of about ``block_bytes`` of text by a hash. One
block at a time is read and broadcast, and the training table passes by without any shuffle; between two blocks it is
written, so a block's memory is free before the next one is read, and the table written before it is deleted. What
several blocks find in a text is united.

Words are maximal runs of digits, ASCII letters and non-ASCII characters, A-Z lower-cased, told apart by 64-bit
hashes. A test item of fewer than ``width`` words, but not none, has one window, the whole item. Defined results:
null or empty text has no words and no matches; a text of any length is searched whole; items with null or empty text
have no windows; equal items (or repeated rows) each match, each row of the training table is judged by itself; an
empty benchmark matches nothing; other columns of the training table pass through, whatever their names (one named
like an output, or ``hits``, is replaced; ``remove_contaminated`` gives all back).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragspark.llm import kernel as K
from ragspark.llm.shared import noted, remove, save, set_aside, small_batches

WIDTH, BLOCK, LEAD = 13, 16 << 20, 4
#: Least and most bytes of a shard; test suffixes that are searched at a time.
SHARD, SLICE = (1 << 20, 8 << 20), 1 << 16
MATCHES = T.ArrayType(T.StructType([T.StructField("item", T.StringType()), T.StructField("doc_start", T.LongType()), T.StructField("item_start", T.LongType()), T.StructField("n_words", T.LongType())]))
HITS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_HIT = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_MATCH = pa.struct([("item", pa.string()), ("doc_start", pa.int64()), ("item_start", pa.int64()), ("n_words", pa.int64())])


class Shard:
    """The suffix array of a shard: the places of its words in the order of the (up to) ``width`` words from each on,
    texts apart. ``rank`` numbers the words from 1 in the order of their hashes, which are in ``known``."""

    def __init__(self, hashes: np.ndarray, first: np.ndarray, width: int):
        self.known, self.rank = np.unique(hashes, return_inverse=True)
        self.rank = self.rank.astype(np.int64) + 1
        size = np.diff(first)
        self.stop = np.repeat(first[1:], size)
        level, n = self.rank, 1
        while n < width:
            after = np.zeros_like(level)
            after[:-n] = level[n:]
            after[np.arange(len(level)) + n >= self.stop] = 0
            level = np.unique((level << 32) + after, return_inverse=True)[1].astype(np.int64) + 1
            n *= 2
        self.order = np.argsort(level, kind="stable")

    def word(self, place: np.ndarray, k: int) -> np.ndarray:
        """The rank of the word ``k`` after each place, 0 beyond the text."""
        at = place + k
        out = np.zeros(len(at), np.int64)
        within = at < self.stop[place]
        out[within] = self.rank[at[within]]
        return out


class Suffixes:
    """The suffixes of a block of test items, as word hashes; ``kind`` numbers the different ones."""

    def __init__(self, ids: list[str], texts: list[str | None], width: int = WIDTH):
        self.ids, self.width = ids, width
        data, off = K.raw(K.as_bytes(pa.array(texts, pa.string())))
        starts, ends, first = K.words(K.LOWER[data], off, K.NON_WORD)
        self.words = K.hash_ranges(K.LOWER[data], starts, ends)
        size = np.diff(first)
        count = np.where(size >= width, size - width + 1, (size > 0).astype(np.int64))
        self.item, self.item_start = K.many(count)
        start = first[:-1][self.item] + self.item_start
        length = np.minimum(size[self.item], width)  # words to compare
        name = length.astype(K.U64)
        for k in range(width):
            within = length > k
            name[within] = K.mix(name[within] * K._M1 ^ self.words[start[within] + k])
        _, chosen, self.kind = np.unique(name, return_index=True, return_inverse=True)
        self.start, self.length = start[chosen], length[chosen]
        # The suffixes by their first words; those of fewer words are always searched.
        led = np.flatnonzero(self.length >= LEAD)
        self.short = np.flatnonzero(self.length < LEAD)
        self.leads, self.lead = np.unique(K.windows(self.words, LEAD)[self.start[led]], return_inverse=True) if len(led) else (np.zeros(0, K.U64), led)
        self.led = led[np.argsort(self.lead, kind="stable")]
        self.lead_begin = np.searchsorted(np.sort(self.lead), np.arange(len(self.leads) + 1))
        self.bytes = len(data)
        self.by_kind = np.argsort(self.kind, kind="stable")
        self.begin = np.searchsorted(self.kind[self.by_kind], np.arange(len(chosen) + 1))

    def search(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(kind, place) of every occurrence in the texts whose words have these hashes."""
        if not len(hashes) or not len(self.start):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        kinds = np.concatenate((self.short, self._led_by(np.unique(K.windows(hashes, LEAD)))))
        shard = Shard(hashes, first, self.width)
        for i in range(0, len(kinds), SLICE):
            kind = np.sort(kinds[i : i + SLICE])
            mine = np.zeros((self.width, len(kind)), np.int64)
            for k in range(self.width):  # the words' ranks in this shard; a suffix with a word that it lacks is nowhere in it
                within = self.length[kind] > k
                word = self.words[self.start[kind[within]] + k]
                at = np.minimum(np.searchsorted(shard.known, word), len(shard.known) - 1)
                mine[k, within] = at + 1
                there = np.ones(len(kind), bool)
                there[within] = shard.known[at] == word
                kind, mine = kind[there], mine[:, there]
            low, high = (self._bound(shard, mine, self.length[kind], upper) for upper in (False, True))
            own, step = K.many(high - low)
            found.append((kind[own], shard.order[low[own] + step]))
        return np.concatenate([k for k, _ in found]), np.concatenate([p for _, p in found])

    def _led_by(self, windows: np.ndarray) -> np.ndarray:
        """The suffixes whose first words are one of the (sorted) windows."""
        if not len(windows) or not len(self.leads):
            return np.zeros(0, np.int64)
        few, many = (self.leads, windows) if len(self.leads) < len(windows) else (windows, self.leads)
        at = np.minimum(np.searchsorted(many, few), len(many) - 1)
        same = many[at] == few
        lead = np.flatnonzero(same) if few is self.leads else at[same]
        own, step = K.many(self.lead_begin[lead + 1] - self.lead_begin[lead])
        return self.led[self.lead_begin[lead][own] + step]

    def _bound(self, shard: Shard, mine: np.ndarray, length: np.ndarray, upper: bool) -> np.ndarray:
        """Binary search of every test suffix: the first entry of the array that does not come before it, or (upper)
        the first that comes after all that start with it."""
        low, high = np.zeros(mine.shape[1], np.int64), np.full(mine.shape[1], len(shard.order), np.int64)
        while len(open_ := np.flatnonzero(low < high)):
            mid = (low[open_] + high[open_]) // 2
            place, live = shard.order[mid], np.arange(len(open_))
            right, equal = np.zeros(len(open_), bool), np.ones(len(open_), bool)
            for k in range(self.width):
                live = live[length[open_[live]] > k]
                if not len(live):
                    break
                word, sought = shard.word(place[live], k), mine[k, open_[live]]
                right[live[word < sought]] = True
                equal[live[word != sought]] = False
                live = live[word == sought]
            if upper:
                right |= equal
            low[open_[right]] = mid[right] + 1
            high[open_[~right]] = mid[~right]
        return low


def _longest(suffixes: Suffixes, kind: np.ndarray, place: np.ndarray, first: np.ndarray):
    """Windows that follow each other in the text and in the item, joined: text, item, both starts, words."""
    begin = suffixes.begin
    which, at = K.many(begin[kind + 1] - begin[kind])
    window, place, length = suffixes.by_kind[begin[kind][which] + at], place[which], suffixes.length[kind][which]
    item, start = suffixes.item[window], suffixes.item_start[window]
    text = np.searchsorted(first, place, "right") - 1
    order = np.lexsort((place, place - start, item, text))
    text, item, start, place, length = text[order], item[order], start[order], place[order], length[order]
    new = np.ones(len(place), bool)
    if len(place) > 1:
        new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (start[1:] - start[:-1] != 1) | (place[1:] - place[:-1] != 1)
    head = np.flatnonzero(new)
    steps = np.diff(np.append(head, len(place)))
    return text[head], item[head], start[head], place[head] - first[text[head]], length[head] + steps - 1


def _batch_matches(suffixes: Suffixes, data: np.ndarray, off: np.ndarray):
    """Where each text's words begin; text, start and end of the runs of words inside an occurrence; the matches."""
    data = K.LOWER[data]
    starts, ends, first = K.words(data, off, K.NON_WORD)
    kind, place = suffixes.search(K.hash_ranges(data, starts, ends), first)
    edge = np.zeros(len(starts) + 1, np.int64)
    np.add.at(edge, place, 1)
    np.add.at(edge, place + suffixes.length[kind], -1)
    hit = np.cumsum(edge[:-1]) > 0
    cut = np.zeros(len(starts) + 1, bool)
    cut[first] = True
    begins = np.flatnonzero(hit & (cut[:-1] | ~np.concatenate(([False], hit[:-1])))) if len(hit) else np.zeros(0, np.int64)
    stops = np.flatnonzero(hit & (cut[1:] | ~np.concatenate((hit[1:], [False])))) + 1 if len(hit) else begins
    text = np.searchsorted(first, begins, "right") - 1
    return first, (text, begins - first[text], stops - first[text]), _longest(suffixes, kind, place, first)


def blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int):
    """(id, text) lists of one block of items after the other, dealt by a hash; one empty block of an empty table."""
    rows = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 16)).collect()[0][0] or 0
    n = max(1, -(-size // block_bytes))
    for i in range(n):
        own = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == i).collect()  # about block_bytes
        yield i == n - 1, [r["id"] for r in own], [r["text"] for r in own]


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, block_bytes: int = BLOCK) -> DataFrame:
    """``docs`` with ``n_words`` (long), ``n_hit`` (words inside any occurrence of a window) and ``matches``,
    an array of (item, doc_start, item_start, n_words): the longest verbatim matches with their places."""
    small_batches(docs.sparkSession)
    names = ["n_words", "hits", "matches"]
    plain = T.StructType([f for f in docs.schema.fields if f.name not in names])
    schema = T.StructType([*plain.fields, T.StructField("n_words", T.LongType()), T.StructField("hits", HITS), T.StructField("matches", MATCHES)])
    df = docs.select(*[F.col(f"`{f.name}`") for f in plain.fields])
    spark, before = docs.sparkSession, []
    for last, ids, texts in blocks(benchmark, item_id, item_text, block_bytes):
        shared = spark.sparkContext.broadcast((ids, texts))
        df = df.mapInArrow(_matcher(shared, text, width), schema)
        if not last:
            with noted() as made:
                df = save(df, "block")
            shared.destroy()
            remove(spark, before)
            before = made
    union = "aggregate(array_sort(hits), named_struct('n', 0L, 'at', 0L), (a, h) -> named_struct('n', a.n + greatest(0L, h.end - greatest(h.start, a.at)), 'at', greatest(a.at, h.end)), a -> a.n)"
    return df.withColumn("n_hit", F.expr(union)).drop("hits")


def shards(batches, text: str, limit: int):
    """(rows, bytes, offsets) of about ``limit`` bytes of text each, from as many Arrow batches as it takes."""
    held, size = [], 0

    def joined():
        rows = pa.Table.from_batches([r for r, _, _ in held]).combine_chunks().to_batches()[0] if len(held) > 1 else held[0][0]
        return rows, np.concatenate([d for _, d, _ in held]), np.cumsum(np.concatenate([[0], *[np.diff(o) for _, _, o in held]]))

    for rows, data, off in K.chunks(batches, text, limit):
        if held and size + len(data) > limit:
            yield joined()
            held, size = [], 0
        held.append((rows, data, off))
        size += len(data)
    if held:
        yield joined()


def _matcher(block, text: str, width: int):
    def run(batches):
        suffixes = Suffixes(*block.value, width)
        for rows, data, off in shards(batches, text, min(SHARD[1], max(SHARD[0], suffixes.bytes // 4))):
            first, (owner, begins, stops), (doc, item, item_start, doc_start, length) = _batch_matches(suffixes, data, off)
            before = {n: rows.column(rows.schema.get_field_index(n)).to_pylist() if n in rows.schema.names else [] for n in ("hits", "matches")}
            hits, found = ([list(x or []) for x in before[n] or [[]] * rows.num_rows] for n in ("hits", "matches"))
            for d, a, z in zip(owner.tolist(), begins.tolist(), stops.tolist(), strict=True):
                hits[d].append({"start": a, "end": z})
            for d, i, s, p, n in zip(doc.tolist(), item.tolist(), item_start.tolist(), doc_start.tolist(), length.tolist(), strict=True):
                found[d].append({"item": suffixes.ids[i], "doc_start": p, "item_start": s, "n_words": n})
            keep = [i for i, n in enumerate(rows.schema.names) if n not in ("n_words", "hits", "matches")]
            yield pa.RecordBatch.from_arrays(
                [*[rows.column(i) for i in keep], pa.array(np.diff(first)), pa.array(hits, pa.list_(_HIT)), pa.array(found, pa.list_(_MATCH))],
                names=[*[rows.schema.names[i] for i in keep], "n_words", "hits", "matches"],
            )

    return run


def contaminated() -> Column:
    """Any hit, and the hits a twentieth of the words or more."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with the columns of ``docs``."""
    own, restore = set_aside(docs, "n_words", "n_hit", "matches", "hits")
    return restore(matches(own, benchmark, **options).where(~contaminated()))

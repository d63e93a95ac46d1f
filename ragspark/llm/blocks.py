"""Substring dedup with fixed-block anchors.

The index holds every non-overlapping block of ``block`` words (half a window), the probes are all rolling windows
of ``block`` words: any ``window`` words contain a whole block, so a repeat of a window makes a probe of one text hit
a block of the other. All places with a hit meet by their block, with the words around it, and are extended word by
word to both sides: two places share the windows that start up to as many words before the block, and end up to as
many after it, as they have in common there. Of every such window all but the first occurrence are removed;
neighbouring removed windows join to the maximal exact repeats. Words are told apart by 64-bit hashes.

First is the smaller (key, word position). Places with the same words all around are settled inside their chunk, so
what a frequent passage sends on is one entry per chunk.

Defined results: null or empty text has no words; a text of any length is searched whole; keys are whole numbers (or
text that casts to long); rows that repeat a key and a text are one document (neither is
earlier than the other, except at different positions); a null key sorts before all others; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from ragspark.llm import chunked as C
from ragspark.llm import kernel as K
from ragspark.llm.shared import save

WINDOW, SLICE = 20, 1 << 16
NULL_KEY = np.iinfo(np.int64).min


class Words:
    """The words of a chunk with their hashes."""

    def __init__(self, off: bytes, body: bytes):
        self.data, self.off = C.unpack(off, body)
        self.starts, self.ends, self.first = K.words(self.data, self.off)
        self.hashes = K.hash_ranges(self.data, self.starts, self.ends)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the windows of ``k`` words within one text, and their hashes."""
        hashed = K.windows(self.hashes, k)
        place = np.flatnonzero(K.inside_text(self.first, k, len(hashed)))
        return place, hashed[place]

    def position(self, place: np.ndarray) -> np.ndarray:
        return place - self.first[np.searchsorted(self.first, place, "right") - 1]


def _probes(words: Words, block: int, buckets: int):
    """Places of the probes and, for the different ones in bucket order: which one each place has, their hashes, whether
    any is a block, whether there are several, and the buckets' spans."""
    place, hashed = words.windows(block)
    values, count, own, spans = C.distinct(hashed, buckets)
    fixed = np.zeros(len(values), bool)
    fixed[own[words.position(place) % block == 0]] = True
    return place, own, values, fixed, count > 1, spans


def _send_probes(block: int, buckets: int):
    """Payloads: the number of probes, their fingerprints, the bits of blocks, the bits of those that repeat here."""

    def run(batches):
        for chunk, off, body in C.rows_of(batches, ["chunk", "off", "body"]):
            _, _, values, fixed, many, spans = _probes(Words(off.as_py(), body.as_py()), block, buckets)
            prints, parts = C.fingerprint(values, buckets), []
            for b, i, j in spans:
                parts.append((b, np.array([j - i], "<u4").tobytes() + prints[i:j].tobytes() + np.packbits(fixed[i:j]).tobytes() + np.packbits(many[i:j]).tobytes()))
            yield C.sent(chunk.as_py(), parts)

    return run


def _hits(bucket: int, payloads: list[bytes]) -> list[bytes | None]:
    """For each payload the bits of its probes that are there twice or more, one of them a block."""
    sizes = [int(np.frombuffer(p, "<u4", 1)[0]) for p in payloads]
    prints = np.concatenate([np.frombuffer(p, "<u4", n, 4) for p, n in zip(payloads, sizes, strict=True)])
    bits = lambda k: np.concatenate([np.unpackbits(np.frombuffer(p, np.uint8, -(-n // 8), 4 + 4 * n + k * -(-n // 8)), count=n) for p, n in zip(payloads, sizes, strict=True)]).astype(np.int64)
    order = np.argsort(prints)
    head = np.flatnonzero(np.concatenate(([True], prints[order][1:] != prints[order][:-1])))
    size = np.diff(np.append(head, len(prints)))
    good = ((size > 1) | (np.add.reduceat(bits(1)[order], head) > 0)) & (np.add.reduceat(bits(0)[order], head) > 0)
    hit = np.zeros(len(prints), bool)
    hit[order] = np.repeat(good, size)
    at = np.cumsum([0, *sizes])
    return [np.packbits(own).tobytes() if (own := hit[i:j]).any() else None for i, j in zip(at[:-1], at[1:], strict=True)]


class Hits:
    """The places of a chunk whose block was hit, in bucket order, with the words around them. ``sent`` are the first
    of those with equal words, ``same`` maps each place to its one, ``behind`` marks those that come after it."""

    def __init__(self, words: Words, ids, hits: dict[int, bytes], block: int, window: int, buckets: int):
        place, own, values, _, _, spans = _probes(words, block, buckets)
        hit = C.told(hits, spans, len(values))[own]
        place, gram = place[hit], values[own[hit]]
        side = window - block
        text = np.searchsorted(words.first, place, "right") - 1
        left = np.minimum(place - words.first[text], side)
        right = np.minimum(words.first[text + 1] - place - block, side)
        keys = np.array([NULL_KEY if x is None else x for x in ids], np.int64)
        key, position = keys[text], place - words.first[text]
        able = np.flatnonzero(left + right >= side)
        able = able[np.lexsort((position[able], key[able], gram[able]))]
        self.place, self.gram, self.left, self.right, self.key, self.position = (x[able] for x in (place, gram, left, right, key, position))
        self.words, self.block, self.step = words.hashes, block, np.arange(side)
        name, equal = np.empty(len(able), K.U64), np.empty(len(able), bool)
        slices = [np.arange(i, min(i + SLICE, len(able))) for i in range(0, len(able), SLICE)]  # the words around take 160 bytes a place
        for at in slices:
            own = self.gram[at]
            for column in (self.left[at].astype(K.U64), self.right[at].astype(K.U64), *self.around(at).T):
                own = K.mix(own * K._M1 ^ column)
            name[at] = own
        _, first, own = np.unique(name, return_index=True, return_inverse=True)
        first = first[own]  # the earliest, as the places are in order within a block
        for at in slices:
            to = first[at]
            equal[at] = (self.gram[at] == self.gram[to]) & (self.left[at] == self.left[to]) & (self.right[at] == self.right[to]) & (self.around(at) == self.around(to)).all(1)
        first = np.where(equal, first, np.arange(len(first)))
        self.behind = (self.key != self.key[first]) | (self.position != self.position[first])
        self.sent, self.same = np.unique(first, return_inverse=True)
        self.spans = C.Spans.of_sorted(C.bucket_of(self.gram[self.sent], buckets))

    def around(self, at: np.ndarray) -> np.ndarray:
        """The hashes of the words before a place, the nearest first, and of those after its block; 0 beyond the text."""
        place, step = self.place[at][:, None], self.step
        words = np.column_stack((place - 1 - step, place + self.block + step))
        there = np.column_stack((step < self.left[at][:, None], step < self.right[at][:, None]))
        return np.where(there, self.words[np.clip(words, 0, max(0, len(self.words) - 1))], K.U64(0))

    def payload(self, i: int, j: int) -> bytes:
        own = self.sent[i:j]
        parts = (self.gram[own], self.key[own], self.position[own].astype("<u4"), self.left[own].astype(np.uint8), self.right[own].astype(np.uint8), self.around(own))
        return zstandard.compress(np.array([j - i], "<u4").tobytes() + b"".join(x.tobytes() for x in parts), 1)


def _send_hits(block: int, window: int, buckets: int):
    def run(batches):
        for chunk, ids, off, body, hits in C.rows_of(batches, ["chunk", "ids", "off", "body", "hits"]):
            if hits := C.payloads(hits):
                h = Hits(Words(off.as_py(), body.as_py()), ids.as_py(), hits, block, window, buckets)
                yield C.sent(chunk.as_py(), [(b, h.payload(i, j)) for b, i, j in h.spans])

    return run


def extended(gram: np.ndarray, words: np.ndarray) -> list[np.ndarray]:
    """For n = 0, 1, ...: the class of each place among those with the same block and the same first n ``words``."""
    order = np.lexsort((*words.T[::-1], gram))
    new = np.concatenate(([True], gram[order][1:] != gram[order][:-1]))
    out = []
    for n in range(words.shape[1] + 1):
        if n:
            column = words[order, n - 1]
            new[1:] |= column[1:] != column[:-1]
        own = np.empty(len(order), np.int64)
        own[order] = np.cumsum(new)
        out.append(own)
    return out


def _later(side: int):
    def answer(bucket: int, payloads: list[bytes]) -> list[bytes | None]:
        """For each payload a mask per place: bit n is set if the window that starts n words before the block occurs
        earlier elsewhere."""
        held, sizes = [], []
        for p in payloads:
            p = zstandard.decompress(p)
            n = int(np.frombuffer(p, "<u4", 1)[0])
            held.append((np.frombuffer(p, "<u8", n, 4), np.frombuffer(p, "<i8", n, 4 + 8 * n), np.frombuffer(p, "<u4", n, 4 + 16 * n), np.frombuffer(p, np.uint8, n, 4 + 20 * n), np.frombuffer(p, np.uint8, n, 4 + 21 * n), np.frombuffer(p, "<u8", 2 * side * n, 4 + 22 * n).reshape(n, 2 * side)))
            sizes.append(n)
        gram, key, position, left, right, around = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((position, key))
        gram, key, position, left, right, around = (x[order] for x in (gram, key, position, left, right, around))
        before, after = extended(gram, around[:, :side]), extended(gram, around[:, side:])
        mask = np.zeros(len(gram), K.U64)
        for n in range(side + 1):
            able = np.flatnonzero((left >= n) & (right >= side - n))
            _, first, own = np.unique(before[n][able] * (len(gram) + 1) + after[side - n][able], return_index=True, return_inverse=True)
            top = able[first][own]
            late = able[(key[able] != key[top]) | (position[able] != position[top])]
            mask[late] |= K.U64(1 << n)
        back = np.empty_like(mask)
        back[order] = mask
        at = np.cumsum([0, *sizes])
        return [back[i:j].tobytes() if back[i:j].any() else None for i, j in zip(at[:-1], at[1:], strict=True)]

    return answer


def _results(block: int, window: int, buckets: int):
    def run(batches):
        for ids, off, body, hits, later in C.rows_of(batches, ["ids", "off", "body", "hits", "later"]):
            words, ids, later = Words(off.as_py(), body.as_py()), ids.as_py(), C.payloads(later)
            gone = np.zeros(len(words.starts), bool)
            if hits := C.payloads(hits):
                h = Hits(words, ids, hits, block, window, buckets)
                mask = np.zeros(len(h.sent), K.U64)
                for b, bits in later.items():
                    mask[slice(*h.spans.at(b))] = np.frombuffer(bits, "<u8")
                mask, removed = mask[h.same], []
                for n in range(window - block + 1):
                    late = h.behind | ((mask >> K.U64(n)) & K.U64(1)).astype(bool)
                    removed.append(h.place[late & (h.left >= n) & (h.right >= window - block - n)] - n)
                gone = K.cover(np.concatenate(removed), window, len(gone))
            kept = np.flatnonzero(~gone)
            size = words.ends[kept] - words.starts[kept] + 1
            owner, at = K.many(size)
            source = words.starts[kept][owner] + at
            text = np.full(len(source), 0x20, np.uint8)
            inner = at < size[owner] - 1
            text[inner] = words.data[source[inner]]
            cut = np.concatenate(([0], np.cumsum(size)))[np.searchsorted(kept, words.first)]
            body, total = text.tobytes(), np.concatenate(([0], np.cumsum(gone)))
            texts = [body[i : max(i, j - 1)] for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            begins, ends = K.runs(gone)
            doc = np.searchsorted(words.first, begins, "right") - 1
            spans = [[] for _ in ids]
            for d, a, z in zip(doc.tolist(), begins.tolist(), ends.tolist(), strict=True):
                while a < z:  # a run may go on in the next text
                    stop = min(z, int(words.first[d + 1]))
                    if stop > a:
                        spans[d].append({"start": a - int(words.first[d]), "end": stop - int(words.first[d])})
                    a, d = stop, d + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(np.diff(words.first)), pa.array(total[words.first[1:]] - total[words.first[:-1]]), pa.array([hashlib.sha256(t).hexdigest() for t in texts]), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array([t.decode("utf-8", "replace") for t in texts])],
                names=["key", "n_words", "n_removed", "kept_sha256", "spans", "kept"],
            )

    return run


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """A row per document: key, n_words, n_removed, kept_sha256, spans (words removed: start, end) and kept, the
    remaining words joined by one space. ``window`` is 126 words at most."""
    block = window // 2
    chunks = C.build(docs, key, text)
    buckets = chunks.buckets(6 << 20)
    cols = ["chunk", "ids", "off", "body"]
    probes = chunks.table.select("chunk", "off", "body").mapInArrow(_send_probes(block, buckets), C.SENT)
    hits = save(C.meet(probes, chunks.parts, _hits), "hits")
    near = C.joined(chunks, hits=hits).select(*cols, "hits").mapInArrow(_send_hits(block, window, buckets), C.SENT)
    later = save(C.meet(near, chunks.parts, _later(window - block)), "later")
    out = C.joined(chunks, hits=hits, later=later).select(*cols, "hits", "later")
    return out.mapInArrow(_results(block, window, buckets), "key long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept string").withColumnRenamed("key", key)


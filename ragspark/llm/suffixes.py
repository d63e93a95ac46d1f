"""Suffix-array dedup with deep-shallow sorting.

Every byte covered by a string of ``length`` bytes that also starts elsewhere is removed. Sorting a suffix for every
byte of the corpus is not affordable, nor needed: a repeated string of ``length`` bytes contains, at the same offset
in all its copies, the minimum of the hashes of its GRAM-byte grams. So

1. the suffixes to sort are those that start at such minima (about one in 180), and of these the ones whose gram
   occurs twice in the corpus (an exchange of 4 bytes for each);
2. they meet by gram, with the bytes around them (``length`` to the right, the rest of a string to the left), and
   each group's suffixes are sorted deep-shallow: multikey quicksort on 8-byte lanes to a shallow depth, then a blind
   trie for each group that is still equal, which gives the order and the common prefixes of neighbours;
3. as in the induced step of deep-shallow sorting, the suffixes that start before a minimum take their order from it:
   for every offset, two suffixes share ``length`` bytes if they agree up to their minima and these share the rest,
   that is if they lie in one run of the sorted array whose common prefixes are long enough.

Suffixes with the same bytes all around are sent once per chunk, with the note that they repeat. Inside a long
periodic run (equal grams at equal distances, the bytes compared) every byte repeats, so only its ends are sent.

A gram with more than HOT places is not sorted in one task: the strings of ``length`` bytes around its places are
hashed whole, and these hashes, which fall into all buckets, are counted as the grams are. Equal strings hold their
minimum at the same offset, so no repeat is lost between the two ways.

Grams, the bytes before a minimum and the strings around hot grams are told apart by 64-bit hashes.

Defined results: null or empty text has no bytes; a text of any length is judged whole; rows that repeat a key are
documents of their own, and their texts repeat each other; of equal strings none is favoured, all their bytes go;
matches never cross documents; a null key stays null, other keys are whole numbers (or text that casts to long);
other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.llm import chunked as C
from ragspark.llm import kernel as K
from ragspark.llm.shared import save

LENGTH, GRAM, SHALLOW, RUN = 400, 48, 32, 1000
#: Places of a gram whose surroundings one task takes: 12 MB of text.
HOT = 1 << 14


BLOCK = 1 << 17


def sliding(x: np.ndarray, w: int, f) -> np.ndarray:
    """``f`` (minimum or maximum) of every ``w`` neighbours, by doubling."""
    out, n = x, 1
    while 2 * n <= w:
        out = f(out[: len(out) - n], out[n:])
        n *= 2
    return out if n == w else f(out[: len(x) - w + 1], out[w - n : w - n + len(x) - w + 1])


def gram_hashes(view: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the ``n`` grams of GRAM = 48 bytes; ``view``: the eight bytes from each position on."""
    h = np.array(view[: n + 40])
    h ^= h >> K.U64(33)
    h *= K._M1
    two = h[:-8] * K._M2
    two += h[8:]
    two ^= two >> K.U64(29)
    six = two[:-32][:n] * K._M3
    six += two[16:][:n]
    six ^= six >> K.U64(31)
    six *= K._M1
    six += two[32:][:n]
    return K.mix(six)


def minima(data: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the grams that are the minimum of a string of ``length`` bytes within one text."""
    n, w = len(data) - gram + 1, length - gram + 1
    places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, K.U64)]
    view = K.lanes(data)
    for a in range(0, n if len(data) >= length else 0, BLOCK):
        b = min(n, a + BLOCK)
        left, right = max(0, a - w + 1), min(n, b + w - 1)
        hashed = gram_hashes(view[left:], right - left)
        rank = (hashed >> K.U64(32)).astype(np.uint32)
        if len(rank) < w:
            continue
        low = sliding(rank, w, np.minimum)  # of the strings that start from `left` on
        cuts = off[np.searchsorted(off, left, "right") : np.searchsorted(off, left + len(low) + length, "left")]
        for cut in (cuts[cuts < len(data)] - left).tolist():
            low[max(0, cut - length + 1) : max(0, cut)] = 0
        # A gram is chosen if the largest minimum of the strings that hold it is its own.
        reach = np.zeros(len(rank) + w - 1, np.uint32)
        reach[w - 1 : w - 1 + len(low)] = low
        own = np.flatnonzero(sliding(reach, w, np.maximum)[a - left : b - left] == rank[a - left : b - left]) + a
        places.append(own)
        hashes.append(K.mix(hashed[own - left] ^ K._M3))  # minima are small numbers: mixed again, they fill the hash space
    return np.concatenate(places), np.concatenate(hashes)


def string_hashes(view: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the strings of ``length`` bytes from ``starts`` on; ``view``: the eight bytes from each position on."""
    out = np.empty(len(starts), K.U64)
    for a in range(0, len(starts), BLOCK):
        own = starts[a : a + BLOCK]
        h = np.zeros(len(own), K.U64)
        for k in (*range(0, length - 8, 8), length - 8):
            h = (h ^ view[own + k]) * K._M1
            h ^= h >> K.U64(32)
        out[a : a + BLOCK] = K.mix(h)
    return out


def chosen(hits: dict[int, bytes], spans: C.Spans, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Masks over a chunk's distinct hashes, from the answers of ``_twice``: those that repeat, those that are hot."""
    own = C.told({b: p[1:] for b, p in hits.items()}, spans, n)
    hot = {b: p for b, p in hits.items() if p[0]}
    return own, C.told({b: p[1 + -(-(spans.at(b)[1] - spans.at(b)[0]) // 8) :] for b, p in hot.items()}, spans, n)


class Anchors:
    """The minima of a chunk and the contexts of those whose grams repeat."""

    def __init__(self, off: bytes, body: bytes, place: bytes, hashed: bytes, buckets: int, length: int = LENGTH):
        self.data, self.off = C.unpack(off, body)
        self.length = length
        place, hashed = np.frombuffer(place, "<u4").astype(np.int64), np.frombuffer(hashed, "<u8")
        values, _, self.own, self.spans = C.distinct(hashed, buckets)
        self.place, self.hashed, self.n = place, hashed, len(values)

    def repeated(self, hits: dict[int, bytes], buckets: int):
        """Sets the suffixes to send, in bucket order: place, hash, left and right bytes, whether they repeat here;
        ``same`` maps every hit place to its suffix. Returns the periodic runs (begin, end), removed already."""
        hit, hot = (x[self.own] for x in chosen(hits, self.spans, self.n))
        hit &= ~hot
        place, hashed = self.place[hit], self.hashed[hit]
        order = np.argsort(place)
        place, hashed = place[order], hashed[order]
        periodic, inner = self._periodic(place, hashed)
        place, hashed = place[~inner], hashed[~inner]
        order, _ = C.bucket_order(hashed, buckets)
        place, hashed = place[order], hashed[order]
        doc = np.searchsorted(self.off, place, "right") - 1
        left = np.minimum(place - self.off[doc], self.length - GRAM)
        right = np.minimum(self.off[doc + 1] - place, self.length)
        seen: dict[tuple, int] = {}
        self.all_place, self.same, keep, many = place, np.zeros(len(place), np.int64), [], []
        body = self.data.tobytes()
        for i, (p, h, a, z) in enumerate(zip(place.tolist(), hashed.tolist(), left.tolist(), right.tolist(), strict=True)):
            key = (h, a, body[p - a : p + z])
            at = seen.setdefault(key, len(keep))
            self.same[i] = at
            if at == len(keep):
                keep.append(i)
                many.append(False)
            else:
                many[at] = True
        keep = np.array(keep, np.int64)
        self.sent_hash, self.left, self.right, self.many = hashed[keep], left[keep], right[keep], np.array(many, bool)
        self.sent = C.Spans.of_sorted(C.bucket_of(self.sent_hash, buckets))
        self.body, self.sent_place = body, place[keep]
        return periodic

    def strings(self, hits: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Where the strings start that hold a hot gram, and their hashes."""
        place = self.place[chosen(hits, self.spans, self.n)[1][self.own]]
        doc = np.searchsorted(self.off, place, "right") - 1
        low, high = np.maximum(self.off[doc], place - (self.length - GRAM)), np.minimum(self.off[doc + 1] - self.length, place)
        able = low <= high
        change = np.zeros(len(self.data) + 1, np.int64)
        np.add.at(change, low[able], 1)
        np.add.at(change, high[able] + 1, -1)
        starts = np.flatnonzero(np.cumsum(change) > 0)
        return starts, string_hashes(K.lanes(self.data), starts, self.length)

    def _periodic(self, place: np.ndarray, hashed: np.ndarray):
        inner, spans = np.zeros(len(place), bool), []
        if len(place) > 2:
            gap = np.diff(place)
            same = (hashed[1:] == hashed[:-1]) & (gap <= self.length - GRAM)
            step = same[1:] & same[:-1] & (gap[1:] == gap[:-1])
            for a, z in zip(*K.runs(step), strict=True):
                first, last, d = int(place[a]), int(place[z + 1]), int(gap[a])
                if last - first > 2 * RUN + self.length and np.array_equal(self.data[first : last + GRAM - d], self.data[first + d : last + GRAM]) and np.searchsorted(self.off, first, "right") == np.searchsorted(self.off, last, "right"):
                    spans.append((first, last + GRAM))
                    inner |= (place > first + RUN) & (place < last - RUN)
        return spans, inner

    def payload(self, i: int, j: int) -> bytes:
        head = np.array([j - i], "<u4").tobytes() + self.sent_hash[i:j].tobytes() + self.left[i:j].astype("<u2").tobytes() + self.right[i:j].astype("<u2").tobytes() + self.many[i:j].tobytes()
        text = b"".join(self.body[p - a : p + z] for p, a, z in zip(self.sent_place[i:j].tolist(), self.left[i:j].tolist(), self.right[i:j].tolist(), strict=True))
        return zstandard.compress(head + text, 3)


class BlindTrie:
    """A Patricia trie that keeps the places where suffixes part, and orders them."""

    def __init__(self, depth: int):
        self.depth, self.root, self.leaves = depth, None, {}

    def add(self, suffix: bytes, owner: int) -> None:
        if suffix in self.leaves:
            self.leaves[suffix].append(owner)
            return
        self.leaves[suffix] = [owner]
        if self.root is None:
            self.root = suffix
            return
        # Blindly down to a leaf, which shares the most with the suffix or as much as any.
        path, node = [], self.root
        while isinstance(node, tuple):
            path.append(node)
            at, children = node
            c = suffix[at] if at < len(suffix) else -1
            node = children[c] if c in children else next(iter(children.values()))
        common = prefix(suffix, node)
        new = suffix[common] if common < len(suffix) else -1
        old = node[common] if common < len(node) else -1
        above = None
        for step in path:
            if step[0] >= common:
                break
            above = step
        key = (suffix[above[0]] if above[0] < len(suffix) else -1) if above else None
        below = above[1][key] if above else self.root
        if isinstance(below, tuple) and below[0] == common:
            below[1][new] = suffix
            return
        inner = (common, {old: below, new: suffix})
        if above:
            above[1][key] = inner
        else:
            self.root = inner

    def ordered(self):
        """(owner, common prefix with the one before) in order; the first's is ``depth``."""
        stack, common = [(self.root, self.depth)], self.depth
        while stack:
            node, common = stack.pop()
            if isinstance(node, tuple):
                at, children = node
                keys = sorted(children, reverse=True)
                for k in keys[:-1]:
                    stack.append((children[k], at))
                stack.append((children[keys[-1]], common))
                continue
            for owner in self.leaves[node]:
                yield owner, common
                common = len(node)


def prefix(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def multikey(group: np.ndarray, lanes: np.ndarray) -> np.ndarray:
    """The order of rows by group and then lanes, by multikey quicksort: each segment of rows that are equal so far is
    parted at a pivot of its next lane into smaller, equal and larger ones, and only the equal ones go on to the lane
    after it. All segments take a step at the same time."""
    order = np.argsort(group, kind="stable")
    head = np.flatnonzero(np.concatenate(([True], group[order][1:] != group[order][:-1])))
    size = np.diff(np.append(head, len(order)))
    lane = np.zeros(len(head), np.int64)
    while True:
        live = (size > 1) & (lane < lanes.shape[1])
        head, size, lane = head[live], size[live], lane[live]
        if not len(head):
            return order
        owner, at = K.many(size)
        place = head[owner] + at
        row = order[place]
        key = lanes[row, lane[owner]]
        # The pivot is the median of the first, middle and last key.
        three = np.sort(np.stack([lanes[order[head + i], lane] for i in (np.zeros_like(size), size // 2, size - 1)]), axis=0)
        pivot = three[1][owner]
        part = 3 * owner + (key >= pivot) + (key > pivot)
        moved = np.argsort(part, kind="stable")
        order[place] = row[moved]
        count = np.bincount(part, minlength=3 * len(head))
        begin = np.cumsum(count) - count
        head, lane = np.repeat(head - (np.cumsum(size) - size), 3) + begin, np.repeat(lane, 3)
        lane[1::3] += 1
        size = count


def deep_shallow(group: np.ndarray, text: np.ndarray, size: np.ndarray, known: int = GRAM, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes (rows of ``text``, of the given sizes) by group and bytes, and each one's common prefix
    with the one before (0 where a group begins). The first ``known`` bytes are equal within a group.

    Multikey quicksort compares 8-byte lanes from ``known`` to the shallow depth, and the sizes up to there last;
    suffixes that are still equal go to a blind trie."""
    depth = known + shallow
    key = np.ascontiguousarray(text[:, known:depth]).view(">u8").astype(K.U64)
    order = multikey(group, np.column_stack((key, np.minimum(size, depth).astype(K.U64))))
    g, k, s = group[order], key[order], size[order]
    common = np.zeros(len(order), np.int64)
    if not len(order):
        return order, common
    near = np.flatnonzero(g[1:] == g[:-1]) + 1
    lanes_equal = k[near] == k[near - 1]
    lane = np.where(lanes_equal.all(1), key.shape[1], lanes_equal.argmin(1))
    same = np.zeros(len(near), np.int64)
    part = lane < key.shape[1]
    differ = k[near[part], lane[part]] ^ k[near[part] - 1, lane[part]]
    lead = np.zeros(len(differ), np.int64)
    for shift in (56, 48, 40, 32, 24, 16, 8):
        lead += (differ >> K.U64(shift)) == 0
    same[part] = lead
    common[near] = np.minimum(known + 8 * lane + same, np.minimum(s[near], s[near - 1]))
    equal = np.zeros(len(order), bool)
    equal[near] = lanes_equal.all(1) & (np.minimum(s[near], depth) == np.minimum(s[near - 1], depth)) & (s[near] >= depth)
    begins, ends = K.runs(equal)
    for a, z in zip((begins - 1).tolist(), ends.tolist(), strict=True):
        trie = BlindTrie(int(common[a]))
        rows = order[a:z]
        for r in rows.tolist():
            trie.add(text[r, : size[r]].tobytes(), r)
        out = list(trie.ordered())
        order[a:z] = [r for r, _ in out]
        common[a:z] = [c for _, c in out]
    return order, common


def repeats(hashes, left, right, many, contexts, length: int = LENGTH) -> np.ndarray:
    """For every suffix (column) and offset (row): whether the string of ``length`` bytes that starts ``offset``
    before it also starts elsewhere. ``contexts``: the bytes from ``left`` before to ``right`` after each."""
    n, most = len(hashes), length - GRAM
    body = np.frombuffer(b"".join(contexts), np.uint8)
    at = np.concatenate(([0], np.cumsum(left + right)))[:-1] + left
    padded = np.concatenate((np.zeros(most, np.uint8), body, np.zeros(length, np.uint8)))
    after = np.lib.stride_tricks.sliding_window_view(padded, length)[most + at]
    after[np.arange(length)[None, :] >= right[:, None]] = 0
    order, common = deep_shallow(np.unique(hashes, return_inverse=True)[1], after, right)
    left, right, at, many = left[order], right[order], at[order], many[order]
    out = np.zeros((most + 1, n), bool)
    before = np.zeros(n, K.U64)
    for offset in range(most + 1):
        if offset:
            before = (before * K._M1 + padded[most + at - offset].astype(K.U64) + K.U64(1)) * K._M3
        able = np.flatnonzero((left >= offset) & (right >= length - offset))
        if not len(able):
            continue
        run = np.cumsum(common < length - offset)[able].astype(K.U64)
        key = K.mix(before[able] ^ (run * K._M2))
        rank = np.argsort(key)
        same = key[rank[1:]] == key[rank[:-1]]
        out[offset, able[rank[1:][same]]] = True
        out[offset, able[rank[:-1][same]]] = True
        out[offset, able[many[able]]] = True
    back = np.empty_like(order)
    back[order] = np.arange(n)
    return out[:, back]


def _minima(batches):
    for chunk, off, body in C.rows_of(batches, ["chunk", "off", "body"]):
        place, hashed = minima(*C.unpack(off.as_py(), body.as_py()))
        yield pa.RecordBatch.from_arrays([pa.array([chunk.as_py()], pa.int64()), pa.array([place.astype("<u4").tobytes()], pa.binary()), pa.array([hashed.tobytes()], pa.binary())], names=["chunk", "place", "hash"])


def _asked(hashes: np.ndarray, buckets: int, whole: bool) -> list[tuple[int, bytes]]:
    """Payloads: the number of distinct hashes, their fingerprints (or the ``whole`` hashes, where nothing is compared
    later), the bits of those that repeat in the chunk, and how often these do."""
    values, count, _, spans = C.distinct(hashes, buckets)
    prints, many = values if whole else C.fingerprint(values, buckets), count > 1
    return [(b, np.array([j - i], "<u4").tobytes() + prints[i:j].tobytes() + np.packbits(many[i:j]).tobytes() + count[i:j][many[i:j]].astype("<u4").tobytes()) for b, i, j in spans]


def _send_minima(buckets: int):
    def run(batches):
        for chunk, hashed in C.rows_of(batches, ["chunk", "hash"]):
            yield C.sent(chunk.as_py(), _asked(np.frombuffer(hashed.as_py(), "<u8"), buckets, False))

    return run


def _send_strings(buckets: int):
    def run(batches):
        for chunk, off, body, place, hashed, hits in C.rows_of(batches, ["chunk", "off", "body", "place", "hash", "hits"]):
            hits = C.payloads(hits)
            if any(p[0] for p in hits.values()):
                a = Anchors(off.as_py(), body.as_py(), place.as_py(), hashed.as_py(), buckets)
                yield C.sent(chunk.as_py(), _asked(a.strings(hits)[1], buckets, True))

    return run


def _twice(most: int, width: int):
    """For each payload whether it has hot hashes (one byte), the bits of its hashes that are there twice or more, and
    those of the hot ones, which are there more than ``most`` times. ``width``: bytes of a hash sent."""

    def answer(bucket: int, payloads: list[bytes]) -> list[bytes | None]:
        sizes = [int(np.frombuffer(p, "<u4", 1)[0]) for p in payloads]
        prints = np.concatenate([np.frombuffer(p, f"<u{width}", n, 4) for p, n in zip(payloads, sizes, strict=True)])
        many = np.concatenate([np.unpackbits(np.frombuffer(p, np.uint8, -(-n // 8), 4 + width * n), count=n) for p, n in zip(payloads, sizes, strict=True)]).astype(bool)
        weight = np.ones(len(prints), np.int64)
        weight[many] = np.concatenate([np.frombuffer(p, "<u4", offset=4 + width * n + -(-n // 8)) for p, n in zip(payloads, sizes, strict=True)])
        order = np.argsort(prints)
        head = np.flatnonzero(np.concatenate(([True], prints[order][1:] != prints[order][:-1])))
        total = np.empty(len(prints), np.int64)
        total[order] = np.repeat(np.add.reduceat(weight[order], head), np.diff(np.append(head, len(prints))))
        out, at = [], np.cumsum([0, *sizes])
        for i, j in zip(at[:-1], at[1:], strict=True):
            hot = total[i:j] > most
            out.append(bytes([int(hot.any())]) + np.packbits(total[i:j] > 1).tobytes() + (np.packbits(hot).tobytes() if hot.any() else b"") if (total[i:j] > 1).any() else None)
        return out

    return answer


def _send_suffixes(buckets: int):
    def run(batches):
        for chunk, off, body, place, hashed, hits in C.rows_of(batches, ["chunk", "off", "body", "place", "hash", "hits"]):
            if hits := C.payloads(hits):
                a = Anchors(off.as_py(), body.as_py(), place.as_py(), hashed.as_py(), buckets)
                a.repeated(hits, buckets)
                yield C.sent(chunk.as_py(), [(b, a.payload(i, j)) for b, i, j in a.sent])

    return run


def _sort(bucket: int, payloads: list[bytes]) -> list[bytes | None]:
    """For each payload the (suffix, first and last offset) of its repeated strings."""
    parts, sizes = [[], [], [], [], []], []
    for p in payloads:
        p = zstandard.decompress(p)
        n = int(np.frombuffer(p, "<u4", 1)[0])
        left, right = np.frombuffer(p, "<u2", n, 4 + 8 * n).astype(np.int64), np.frombuffer(p, "<u2", n, 4 + 10 * n).astype(np.int64)
        cut = 4 + 13 * n + np.concatenate(([0], np.cumsum(left + right)))
        for held, x in zip(parts, (np.frombuffer(p, "<u8", n, 4), left, right, np.frombuffer(p, bool, n, 4 + 12 * n), [p[i:j] for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]), strict=True):
            held.append(x)
        sizes.append(n)
    found = repeats(*[np.concatenate(x) for x in parts[:4]], [c for x in parts[4] for c in x])
    at = np.cumsum([0, *sizes])
    out = []
    for i, j in zip(at[:-1], at[1:], strict=True):
        rows = [(s, a, z) for s in range(i, j) for a, z in zip(*K.runs(found[:, s]), strict=True)] if found[:, i:j].any() else []
        out.append(np.array([(s - i, a, z - 1) for s, a, z in rows], "<u4").tobytes() if rows else None)
    return out


def _results(buckets: int, length: int = LENGTH):
    def run(batches):
        for ids, off, body, place, hashed, hits, found, wide in C.rows_of(batches, ["ids", "off", "body", "place", "hash", "hits", "found", "wide"]):
            ids, off = ids.as_py(), off.as_py()
            data, at = C.unpack(off, body.as_py())
            delta = np.zeros(len(data) + 1, np.int64)
            if hits := C.payloads(hits):
                a = Anchors(off, body.as_py(), place.as_py(), hashed.as_py(), buckets)
                for begin, end in a.repeated(hits, buckets):
                    delta[begin] += 1
                    delta[end] -= 1
                runs = [(np.frombuffer(p, "<u4").reshape(-1, 3).astype(np.int64), a.sent.at(b)[0]) for b, p in C.payloads(found).items()]
                if runs:
                    owner = np.concatenate([r[:, 0] + b for r, b in runs])
                    low, high = (np.concatenate([r[:, c] for r, _ in runs]) for c in (1, 2))
                    order = np.argsort(owner, kind="stable")
                    owner, low, high = owner[order], low[order], high[order]
                    first = np.searchsorted(owner, a.same)
                    which, k = K.many(np.searchsorted(owner, a.same, "right") - first)
                    r = first[which] + k
                    np.add.at(delta, a.all_place[which] - high[r], 1)
                    np.add.at(delta, a.all_place[which] - low[r] + length, -1)
                if wide := C.payloads(wide):
                    starts, strings = a.strings(hits)
                    values, _, own, spans = C.distinct(strings, buckets)
                    starts = starts[chosen(wide, spans, len(values))[0][own]]
                    np.add.at(delta, starts, 1)
                    np.add.at(delta, starts + length, -1)
            gone = np.cumsum(delta[:-1]) > 0
            total = np.concatenate(([0], np.cumsum(gone)))[at]
            kept, cut = data[~gone].tobytes(), at - total
            texts = [kept[i:j] for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            spans = [[] for _ in ids]
            n_removed = np.diff(total)
            for d in np.flatnonzero(n_removed).tolist():
                begins, ends = K.runs(gone[at[d] : at[d + 1]])
                spans[d] = [{"start": x, "end": y} for x, y in zip(begins.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(np.diff(at)), pa.array(n_removed), pa.array([len(s) for s in spans], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts]), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(texts, pa.binary())],
                names=["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"],
            )

    return run


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """A row per document: key, n_bytes, n_removed, n_spans, kept_sha256, spans (bytes removed: start, end) and kept,
    the remaining bytes."""
    chunks = C.build(docs, key, text)
    buckets, never = chunks.buckets(4 << 20), 1 << 62
    cols = ["chunk", "ids", "off", "body", "place", "hash"]
    least = save(chunks.table.select("chunk", "off", "body").mapInArrow(_minima, "chunk long, place binary, hash binary"), "minima")
    hits = save(C.meet(least.select("chunk", "hash").mapInArrow(_send_minima(buckets), C.SENT), chunks.parts, _twice(hot, 4)), "hits")
    asked = C.joined(chunks, hits=hits).join(least.hint("shuffle_hash"), "chunk").select(*cols, "hits")
    answers = {"hits": hits, "found": save(C.meet(asked.mapInArrow(_send_suffixes(buckets), C.SENT), chunks.parts, _sort), "found")}
    if not hits.where(F.substring("payload", 1, 1) == F.lit(b"\x01")).isEmpty():
        answers["wide"] = save(C.meet(asked.mapInArrow(_send_strings(buckets), C.SENT), chunks.parts, _twice(never, 8)), "wide")
    out = C.joined(chunks, **answers).join(least.hint("shuffle_hash"), "chunk")
    if "wide" not in answers:
        out = out.withColumn("wide", F.lit(None).cast("array<struct<bucket:int,payload:binary>>"))
    schema = "key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept binary"
    return out.select(*cols, "hits", "found", "wide").mapInArrow(_results(buckets), schema).withColumnRenamed("key", key)

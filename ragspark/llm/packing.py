"""Best-fit packing with swap-based local search, on the histogram of piece lengths.

A sequence is a multiset of lengths, so the packing is planned on the number of pieces of each length: at most
``capacity`` counters reach the driver, whatever the input. The plan is a list of bin patterns with multiplicities:

1. Best-fit decreasing: lengths from the longest to the shortest, each piece into the open bin with the least room
   that it fits, or else into a new one; bins with equal contents are filled together.
2. Local search: of the underfull bins, pairs exchange pieces one-for-one, two-for-one, or one moves, as long as the
   sum of squared fills increases; a bin that runs empty is gone. It ends when the open bins are as few as their
   pieces allow or no exchange is left; ``rounds`` and ``givers`` end it earlier where they are given.

The pieces then learn their places with one join on (task, length): each task numbers its own pieces of a length, the
counts per task and length are summed up to offsets, and the number of a piece within its length finds its bin.

Defined results: null or empty text is the end token alone; a text of any length is encoded whole and only cut into
pieces of ``capacity``; pieces of equal length are alike, whichever of their places each gets; repeated rows are
packed each by itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.llm import kernel as K
from ragspark.llm.shared import save, small_batches

CAPACITY, END = 1024, 2


@lru_cache(maxsize=2)
def encoder(path: str):
    """Texts to id lists, as the byte-level BPE file ``path`` of the tokenizers library has them.

    A byte-level BPE vocabulary whose ids are in the order of its merges is run by tiktoken, which gives the same
    ids faster; any other file, and a text whose runs of spaces are too long for tiktoken, is run by tokenizers.
    """
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if (ranks := _ranks(spec)) is not None:
        import public_tokenizers
        import tiktoken

        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        ranks = {k: v for k, v in ranks.items() if v not in special.values()}
        own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        held: list[Tokenizer] = []

        def ids(text: str) -> list[int]:
            try:
                return own.encode(text, allowed_special="all")
            except ValueError:
                if not held:
                    held.append(Tokenizer.from_file(path))
                return held[0].encode(text, add_special_tokens=False).ids

        return lambda texts: [ids(t) for t in texts]
    whole = Tokenizer.from_file(path)
    return lambda texts: [x.ids for x in whole.encode_batch_fast(texts, add_special_tokens=False)]


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """The vocabulary as bytes, if it is byte-level BPE without normaliser and its ids follow its merges."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    if model.get("type") != "BPE" or not plain or spec.get("normalizer") or model.get("dropout") or model.get("ignore_merges"):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    special = {x["content"] for x in spec["added_tokens"]}
    vocab = model["vocab"]
    last = -1
    for m in model["merges"]:
        at = vocab["".join(m.split(" ") if isinstance(m, str) else m)]
        if at <= last:
            return None
        last = at
    return {bytes(table[c] for c in k): v for k, v in vocab.items() if k not in special}


def pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """A row per piece: key, piece, start, length, ids_crc32, and for numbering: task, local (place among the task's
    pieces of this length)."""

    def run(batches):
        encode, task, seen = encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for rows, data, off in K.chunks(batches, text, 1 << 20):
            body = data.tobytes()
            texts = [body[a:b].decode("utf-8", "replace") for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            doc, piece, start, length, crc, local = [], [], [], [], [], []
            for d, ids in enumerate(encode(texts)):
                ids = np.array([*ids, end], "<u4")
                cut = len(ids) % capacity or capacity
                for n, (a, b) in enumerate(zip([0, *range(cut, len(ids), capacity)], [*range(cut, len(ids) + 1, capacity)], strict=True)):
                    doc.append(d)
                    piece.append(n)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].tobytes()))
                    local.append(seen[b - a])
                    seen[b - a] += 1
            yield pa.RecordBatch.from_arrays(
                [rows.column(rows.schema.get_field_index(key)).take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc, [task] * len(doc), local)]],
                names=[key, "piece", "start", "length", "ids_crc32", "task", "local"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, task long, local long")


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> Counter:
    """Patterns (lengths, longest first) with the number of bins of each, by best-fit decreasing."""
    rooms: list[int] = []  # of the open bins, ascending
    bins: dict[int, Counter] = {}  # by room
    full = Counter()

    def put(pattern: tuple, room: int, times: int) -> None:
        if not room:
            full[pattern] += times
            return
        if room not in bins:
            bisect.insort(rooms, room)
            bins[room] = Counter()
        bins[room][pattern] += times

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            # A bin that has taken one piece has the least room of all that fit, so it takes as many as it holds.
            room = rooms[at] if at < len(rooms) else capacity
            each = min(left, room // length)
            times = left // each
            pattern = ()
            if at < len(rooms):
                pattern, there = next(iter(bins[room].items()))
                times = min(times, there)
                bins[room] -= Counter({pattern: times})
                if not bins[room]:
                    del bins[room], rooms[at]
            put(pattern + (length,) * each, room - each * length, times)
            left -= each * times
    for found in bins.values():
        full += found
    return full


def plan(counts: dict[int, int], capacity: int = CAPACITY, rounds: int | None = None, givers: int | None = None) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, longest first) with the number of bins of each."""
    return sorted(search(best_fit(counts, capacity), capacity, rounds, givers).items(), reverse=True)


def search(patterns: Counter, capacity: int, rounds: int | None = None, givers: int | None = None) -> Counter:
    """Exchanges between underfull bins, each increasing the sum of squared fills; equal pairs move together.

    The emptiest bin gives until it is empty or nothing fits; then the next ones. It ends when no exchange is left or
    when the open bins are as few as their pieces allow; ``rounds`` bounds the exchanges and ``givers`` the patterns
    that may give, for a driver that must be done sooner (the packing is whole after every exchange).
    """
    full = Counter({p: n for p, n in patterns.items() if sum(p) == capacity})
    open_ = Counter({p: n for p, n in patterns.items() if sum(p) < capacity})
    fill = sum(sum(p) * n for p, n in open_.items())
    count, ranked, known = sum(open_.values()), sorted((sum(p), p) for p in open_), {}
    # The takers that each giver has still to look at, the fullest last; what comes later is looked at first.
    takers = [p for _, p in ranked]
    waiting = {p: list(takers) for p in takers}
    done = 0

    def found():
        for _, g in ranked[:givers]:
            mine = waiting[g]
            while mine:
                t = mine[-1]
                if open_[t] > (t == g) and (step := _known(known, g, t, capacity)):
                    return step
                mine.pop()
        return None

    while count > -(-fill // capacity) and (rounds is None or done < rounds) and (step := found()):
        done += 1
        giver, taker, less, more = step
        times = open_[giver] // 2 if giver == taker else min(open_[giver], open_[taker])
        for p, n in ((giver, -times), (taker, -times), (less, times), (more, times)):
            if not p:
                continue
            size = sum(p)
            if size == capacity:
                full[p] += n
                fill -= n * size
                continue
            before, now = open_[p], open_[p] + n
            count += n
            open_[p] = now
            if not now:
                del open_[p], waiting[p]
                ranked.pop(bisect.bisect_left(ranked, (size, p)))
                continue
            if not before:
                waiting[p] = [t for _, t in ranked]
                bisect.insort(ranked, (size, p))
            if before < 2:  # new for all, or a pair of its own for the first time
                for mine in waiting.values():
                    mine.append(p)
    return full + open_


def _known(known: dict, giver: tuple, taker: tuple, capacity: int):
    if (giver, taker) not in known:
        found = exchange(giver, taker, capacity)
        known[giver, taker] = found and (giver, *found)
    return known[giver, taker]


def exchange(giver: tuple, taker: tuple, capacity: int):
    """(taker, giver after, taker after) for the move, one-for-one or two-for-one (either way) between the emptier
    and the fuller bin that fills the fuller most; None if no exchange increases the sum of squared fills."""
    if sum(giver) > sum(taker):
        return None
    room, best = capacity - sum(taker), (0, (), ())
    ones = sorted(set(taker))
    twos = sorted((sum(p), p) for p in _pairs(taker))
    for give in [(x,) for x in sorted(set(giver))] + sorted(_pairs(giver)):
        size = sum(give)
        if len(give) == 1:
            if best[0] < size <= room:
                best = size, give, ()
            at = bisect.bisect_left(twos, (size - room,))
            if at < len(twos) and size - twos[at][0] > best[0]:
                best = size - twos[at][0], give, twos[at][1]
        at = bisect.bisect_left(ones, size - room)  # the smallest piece back that makes it fit
        if at < len(ones) and size - ones[at] > best[0]:
            best = size - ones[at], give, (ones[at],)
        if best[0] == room:
            break
    gain, give, back = best
    if not gain:
        return None
    less, more = Counter(giver), Counter(taker)
    less.subtract(give)
    more.subtract(back)
    less.update(back)
    more.update(give)
    return taker, tuple(sorted(less.elements(), reverse=True)), tuple(sorted(more.elements(), reverse=True))


def _pairs(p: tuple) -> set:
    kinds = sorted(set(p))
    return {(a, b) for i, a in enumerate(kinds) for b in kinds[i + 1 :]} | {(a, a) for a, n in Counter(p).items() if n > 1}


class Places:
    """For each length, runs of numbers that go to consecutive bins at one offset."""

    def __init__(self, bins: list[tuple[tuple[int, ...], int]]):
        base, runs = 0, {}
        for lengths, times in bins:
            offset = 0
            for n in lengths:
                runs.setdefault(n, []).append((times, base, offset))
                offset += n
            base += times
        self.n_bins, self.runs = base, {}
        for n, rows in runs.items():
            times, first, offset = np.array(rows, np.int64).T
            self.runs[n] = np.concatenate(([0], np.cumsum(times)[:-1])), first, offset

    def find(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for n in np.unique(length):
            mine = length == n
            start, first, place = self.runs[int(n)]
            run = np.searchsorted(start, number[mine], "right") - 1
            sequence[mine] = first[run] + number[mine] - start[run]
            offset[mine] = place[run]
        return sequence, offset


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END, rounds: int | None = None, givers: int | None = None) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; ``rounds`` and ``givers`` as for search()."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = save(pieces(docs, tokenizer, key, text, capacity, end), "pieces")
    counts = parts.groupBy("length", "task").agg(F.count("*").alias("n"))
    counts = save(counts, "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    places = spark.sparkContext.broadcast(Places(plan(histogram, capacity, rounds, givers)))
    before = counts.selectExpr("length", "task", "sum(n) OVER (PARTITION BY length ORDER BY task ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS before")
    # The counts grow with the tasks, so they are merged in and never broadcast.
    numbered = parts.join(before.hint("merge"), ["length", "task"]).selectExpr(f"`{key}`", "piece", "start", "length", "ids_crc32", "before + local AS number")

    def run(batches):
        for b in batches:
            col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            sequence, offset = places.value.find(col["length"].to_numpy(), col["number"].to_numpy())
            yield pa.RecordBatch.from_arrays([*[col[n] for n in (key, "piece", "start", "length", "ids_crc32")], pa.array(sequence), pa.array(offset)], names=[key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = docs.schema[key].dataType.simpleString()
    return numbered.mapInArrow(run, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

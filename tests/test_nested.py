"""Nested intervals of comment trees against a walk."""

import random

import pytest
from pyspark.sql import functions as F

from ragspark.errors import ValidationError
from ragspark.operators import threads

KIND = "thread string, id string, parent_id string, position int, lo string, _n int"


def walk(rows, newest=False):
    """{(thread, id): (depth, lo, hi)}."""
    below = {}
    for t, i, up, at in sorted(rows, key=lambda r: -r[3] if newest else r[3]):
        below.setdefault((t, up), []).append(i)
    out = {}
    for t in sorted({r[0] for r in rows}):
        n, stack = 0, [(i, 0, False) for i in reversed(below.get((t, None), []))]
        while stack:
            i, depth, done = stack.pop()
            if done:
                out[t, i] = (*out[t, i][:2], n - 1)
                continue
            out[t, i] = (depth, n, None)
            n += 1
            stack += [(i, depth, True), *((c, depth + 1, False) for c in reversed(below.get((t, i), [])))]
    return out


def places(df):
    return {(r.thread, r.id): (r.depth, r.lo, r.hi) for r in df.collect()}


def frame(spark, rows):
    return spark.createDataFrame([(*r, "extra", 7) for r in rows], KIND)


@pytest.mark.parametrize("newest", [False, True])
def test_intervals_of_trees_chains_and_wide_threads(spark, newest):
    draw = random.Random(5)
    rows = [("tree", str(i), str(draw.randrange(i)) if i > 2 else None, i) for i in range(200)]
    rows += [("chain", str(i), str(i - 1) if i else None, i) for i in range(90)] + [("wide", str(i), "0" if i else None, i) for i in range(300)]
    tree = threads.nested(frame(spark, rows).select("thread", "id", "parent_id", "position"), "thread", F.desc("position") if newest else F.asc("position"))
    assert places(tree) == walk(rows, newest)


def test_orphans_cycles_nulls_repeats_and_no_rows(spark):
    rows = [("a", "1", None, 0), ("a", "2", "t1_1", 1), ("a", "2", "1", 5), ("a", "2", "9", 6), ("a", "3", "8", 2), ("a", "4", "5", 3), ("a", "5", "4", 4)]
    rows += [(None, "1", None, 0), ("a", None, "1", 7), ("b", "1", None, 0)]
    assert places(threads.nested(frame(spark, rows), "thread")) == {("a", "1"): (0, 0, 1), ("a", "2"): (1, 1, 1), ("b", "1"): (0, 0, 0)}
    assert places(threads.nested(frame(spark, []), "thread")) == {}


def test_focus_with_context_and_depth(spark):
    rows = [("a", str(i), str((i - 1) // 2) if i else None, i) for i in range(31)] + [("b", str(i), str(i - 1) if i else None, i) for i in range(20)]
    tree = threads.nested(frame(spark, rows), "thread")
    foci = spark.createDataFrame([("a", "4"), ("b", "15"), ("b", "99"), ("none", "1")], "thread string, comment string")

    def seen(**options):
        got = threads.focused(tree, foci, "thread", **options).orderBy("thread", "lo").collect()
        return [(r.id, r.level) for r in got if r.thread == "a"], [(r.id, r.level) for r in got if r.thread == "b"]

    assert seen() == ([("4", 0), ("9", 1), ("19", 2), ("20", 2), ("10", 1), ("21", 2), ("22", 2)], [(str(i), i - 15) for i in range(15, 20)])
    assert seen(context=8, depth=2) == ([("0", -2), ("1", -1), ("4", 0), ("9", 1), ("10", 1)], [(str(i), i - 15) for i in range(7, 17)])
    assert seen(context=1, depth=1) == ([("1", -1), ("4", 0)], [("14", -1), ("15", 0)])
    for wrong in ({"context": 9}, {"context": -1}, {"depth": 0}, {"depth": 11}):
        with pytest.raises(ValidationError):
            threads.focused(tree, foci, "thread", **wrong)

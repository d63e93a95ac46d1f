import numpy as np
import pytest

from ragspark.llm import multiindex as M
from ragspark.llm import queries as Q

SF = "/root/testdata/sf0.001"


def brute(rows, threshold=0.95):
    lengths = [len(v) for _, v in rows if v]
    dims = max(sorted(set(lengths), reverse=True), key=lengths.count) if lengths else 0
    able = {}
    for i, (_, v) in enumerate(rows):
        if v and len(v) == dims and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, float) / np.abs(v).max()
            able[i] = x / np.linalg.norm(x)
    near = {i: {j for j in able if j != i and able[i] @ able[j] >= threshold} for i in able}
    out = []
    for i, (key, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        low = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((key, len(near.get(i, ())), low, key == low))
    return sorted(out, key=repr)


def run(spark, rows, kind="float", **more):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    return sorted(map(tuple, M.near_copies(df, **more).select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)


def narrow(rows):
    return [(k, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for k, v in rows]


def test_query_equals_brute_force(spark):
    rows = [(r[0], list(r[1])) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert sorted(map(tuple, Q.op13_multi_index(spark, SF).collect()), key=repr) == brute(rows)


def groups(seed, n, dims, copies, noise):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dims))
    for size in copies:
        centre = rng.normal(size=dims)
        base = np.vstack((base, centre + noise * rng.normal(size=(size, dims))))
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(len(base)), base, strict=True)]
    return narrow(rows)


@pytest.mark.parametrize(("seed", "n", "dims", "copies", "noise"), [(1, 300, 16, [40, 5, 2, 2, 2], 0.1), (2, 200, 7, [120, 80], 0.12), (3, 100, 1, [], 0), (4, 150, 32, [100], 0.2), (5, 0, 24, [200, 200], 0.1)])
def test_random_groups(spark, monkeypatch, seed, n, dims, copies, noise):
    monkeypatch.setattr(M, "SPLIT", 50)
    monkeypatch.setattr(M, "REGION", 64)
    monkeypatch.setattr(M, "BLOCK", 16)
    rows = groups(seed, n, dims, copies, noise)
    assert run(spark, rows) == brute(rows)


def test_recall_of_far_copies(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(1500, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    turn = rng.normal(size=x.shape)
    turn -= (turn * x).sum(1, keepdims=True) * x
    turn /= np.linalg.norm(turn, axis=1, keepdims=True)
    far = 0.951 * x + (1 - 0.951**2) ** 0.5 * turn
    rows = narrow([(i, v.tolist()) for i, v in enumerate(np.vstack((x, far)))])
    found, there = sum(r[1] for r in run(spark, rows)), sum(r[1] for r in brute(rows))
    assert there >= 3000 and found >= 0.99 * there


def test_recall_of_wide_groups(spark):
    rows = groups(5, 0, 24, [200, 200], 0.16)
    got, want = run(spark, rows), brute(rows)
    assert all(a[1] <= b[1] for a, b in zip(got, want, strict=True))
    assert sum(r[1] for r in got) >= 0.995 * sum(r[1] for r in want)


def test_large_groups_become_balls():
    rng = np.random.default_rng(3)
    x = M.unit(np.vstack((rng.normal(size=(2000, 32)), rng.normal(size=32) + 0.05 * rng.normal(size=(900, 32)))))
    index = M.fit(x, len(x))
    own, row, _ = index.balls(x)
    assert (own[2000:] >= 0).all() and (own[:2000] < 0).all() and not len(row)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    a, b = [1.0, 2.0, 3.0, 4.0], [4.0, -3.0, 2.0, -1.0]
    rows = [(1, a), (1, a), (2, [2.0, 4.0, 6.0, 8.0]), (None, a), (3, None), (4, []), (5, [0.0] * 4), (6, [1.0, 2.0, None, 4.0]), (7, [1.0, 2.0, nan, 4.0]), (8, [1.0, 2.0, inf, 4.0]), (9, b), (None, b), (10, [1.0, 2.0]), (11, [1.0, 2.0]), (12, [1e-30, 2e-30, 3e-30, 4e-30]), (13, [1e30, 2e30, 3e30, 4e30]), (None, [0.0, 0.0, 0.0, 1.0]), (14, [0.0, 1.0, -0.0, 0.0]), (15, [-0.0, 1.0, 0.0, 0.0])]
    assert run(spark, narrow(rows)) == brute(narrow(rows))
    assert run(spark, rows, "double") == brute(rows)


def test_empty_and_other_columns(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None), (None, None)]) == [(1, 0, 1, True), (None, 0, None, True)]
    df = spark.createDataFrame([(1, [1.0, 0.0], "x", 5, 6), (2, [1.0, 0.1], "y", 5, 6)], "vec_id long, embedding array<float>, label string, key int, ball int")
    assert sorted(map(tuple, M.near_copies(df).collect())) == [(1, 1, 1, True), (2, 1, 1, False)]
    with pytest.raises(ValueError, match="threshold"):
        M.near_copies(df, threshold=1.0)

import numpy as np
import pytest

from methyloom.llm import neighbours as nb

SCHEMA = "cell STRING, x ARRAY<FLOAT>, id STRING, v INT"


def data(n=600, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(8, dim))
    x = centre[rng.integers(0, 8, n)] + rng.normal(size=(n, dim)) * 0.3
    twin = x[: n // 5] + rng.normal(size=(n // 5, dim)) * 0.05
    return np.vstack([x, twin]).astype(np.float32)


def frame(spark, x, extra=()):
    rows = [(f"c{i:05d}", [float(a) for a in v], "clash", 1) for i, v in enumerate(x)]
    return spark.createDataFrame(rows + list(extra), SCHEMA).repartition(4)


def brute(x, k, least):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    return {(f"c{i:05d}", f"c{j:05d}") for i in range(len(x)) for j in np.lexsort((np.arange(len(x)), -s[i]))[:k] if s[i, j] >= least}


def test_near_twins_are_found(spark):
    x = data()
    bad = [("n1", None, "", 0), ("n2", [1.0] * 3, "", 0), ("n3", [0.0] * 16, "", 0), ("n4", [float("nan")] + [1.0] * 15, "", 0), (None, [1.0] * 16, "", 0), ("n5", [], "", 0), ("n6", [float("inf")] * 16, "", 0)]
    again = [("c00003", [float(a) for a in x[3]], "", 0)]
    got = {(r.id, r.other) for r in nb.neighbours(frame(spark, x, bad + again), "cell", "x", 16, least=0.95).collect()}
    want = brute(x, 5, 0.95)
    assert len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(want)


def test_recall_without_a_limit(spark):
    x = data()
    queries = spark.createDataFrame([(f"c{i:05d}",) for i in range(0, len(x), 20)], "id STRING")
    got = {(r.id, r.other) for r in nb.neighbours(frame(spark, x), "cell", "x", 16, post=8, length=16, keep=256, queries=queries).collect()}
    want = {p for p in brute(x, 5, -2) if int(p[0][1:]) % 20 == 0}
    assert len(got & want) >= 0.9 * len(want) and len(got) == len(want)
    exact = {(r.id, r.other) for r in nb.exact_neighbours(frame(spark, x), "cell", "x", 16, [r.id for r in queries.collect()], 5).collect()}
    assert len(exact & want) >= 0.99 * len(want)


def test_copies_and_ties(spark):
    x = np.vstack([np.repeat(data(1)[:1], 40, 0), data(30, seed=4)])
    got = {(r.id, r.other) for r in nb.neighbours(frame(spark, x), "cell", "x", 16, least=0.999).collect()}
    for i in range(40):
        mine = sorted(o for a, o in got if a == f"c{i:05d}")
        assert mine == [f"c{j:05d}" for j in range(7) if j != i][:5]


def test_long_lists_in_blocks_lose_nothing(spark, monkeypatch):
    x = data(300)
    whole = {(r.id, r.other) for r in nb.neighbours(frame(spark, x), "cell", "x", 16, least=0.9, keep=10**6).collect()}
    monkeypatch.setattr(nb, "LIST_ROWS", 25)
    split = {(r.id, r.other) for r in nb.neighbours(frame(spark, x), "cell", "x", 16, least=0.9, keep=10**6).collect()}
    assert split == whole


def test_hot_lists_get_pivots_of_their_own(spark, monkeypatch):
    x = data(1500)
    for name, value in (("LIST_ROWS", 200), ("SPLIT_ROWS", 300), ("SUB_ROWS", 60)):
        monkeypatch.setattr(nb, name, value)
    got = {(r.id, r.other) for r in nb.neighbours(frame(spark, x), "cell", "x", 16, least=0.95, pivots=4).collect()}
    want = brute(x, 5, 0.95)
    assert len(got & want) >= 0.97 * len(want)
    queries = spark.createDataFrame([(f"c{i:05d}",) for i in range(0, len(x), 20)], "id STRING")
    got = {(r.id, r.other) for r in nb.neighbours(frame(spark, x), "cell", "x", 16, pivots=4, post=4, probe=4, keep=256, queries=queries).collect()}
    want = {p for p in brute(x, 5, -2) if int(p[0][1:]) % 20 == 0}
    assert len(got & want) >= 0.9 * len(want) and len(got) == len(want)


@pytest.mark.parametrize("n", [0, 1, 2])
def test_tiny(spark, n):
    got = nb.neighbours(frame(spark, data()[:n]) if n else spark.createDataFrame([], SCHEMA), "cell", "x", 16).collect()
    assert len(got) == (2 if n == 2 else 0)


def test_footrule_gain_is_the_footrule():
    rng = np.random.default_rng(0)
    perm = np.array([rng.permutation(12)[:5] for _ in range(30)])
    weight = np.zeros((12, 30), np.uint8)
    weight[perm.ravel(), np.repeat(np.arange(30), 5)] = np.tile(np.arange(5, 0, -1), 30)
    gain = nb.footrule_gain(perm, weight)
    for i in range(30):
        for j in range(30):
            a, b = ({p: k for k, p in enumerate(perm[t])} for t in (i, j))
            foot = sum(abs(a.get(p, 5) - b.get(p, 5)) for p in set(a) | set(b))
            assert foot == 5 * 6 - 2 * int(gain[i, j])


@pytest.mark.parametrize("length", [48, 300])
def test_long_pivot_lists_do_not_wrap(length):
    x = nb.unit(data(500, dim=32))
    pivots = x[np.random.default_rng(1).permutation(len(x))[: length + 20]]
    perm = nb.permutations(x, pivots, length)
    rank = np.zeros((len(x), len(pivots)), int)
    np.put_along_axis(rank, perm.astype(int), np.arange(length, 0, -1)[None], 1)
    gain = np.minimum(rank[:, None], rank[None]).sum(2)
    np.fill_diagonal(gain, 0)
    rows, others, _ = nb.search_list(x, perm, np.arange(40), np.arange(len(x)), 50, 50, -1.0)
    for i in range(40):
        mine, rest = gain[i, others[rows == i]], np.delete(gain[i], others[rows == i])
        assert len(mine) == 50 and mine.min() >= rest.max()

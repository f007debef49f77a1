import numpy as np
from pyspark.sql import functions as F

from methyloom.llm import mixture as mx

SCHEMA = "cell STRING, x ARRAY<FLOAT>, label STRING, cluster INT"


def blobs(seed=0, sizes=(300, 200, 60, 30), dim=20):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(len(sizes), dim))
    own = np.repeat(np.arange(len(sizes)), sizes)
    return centre[own] + rng.normal(size=(len(own), dim)) * 0.15, own


def test_wrong_and_absent_labels_are_named(spark):
    x, own = blobs()
    rows, wrong = [], set()
    for i, (v, c) in enumerate(zip(x, own)):
        label = None if i % 50 == 7 else f"l{(c + 1) % 4}" if i % 50 == 9 else f"l{c}"
        if i % 50 in (7, 9):
            wrong.add((f"c{i:04d}", f"l{c}"))
        rows.append((f"c{i:04d}", [float(a) for a in v], label, 1))
    rows += [("bad1", None, "l0", 1), ("bad2", [1.0], "l0", 1), ("bad3", [float("nan")] * 20, "l0", 1), (None, [1.0] * 20, "l0", 1), rows[5], rows[6]]
    members = mx.mixture_members(spark.createDataFrame(rows, SCHEMA).repartition(3), "cell", "x", 20, F.col("label"), components=(1, 2, 3, 4, 5, 6))
    assert members.count() == len(x)
    assert {tuple(r) for r in mx.doubtful_labels(members).collect()} == wrong
    named = {r.cluster: r for r in mx.cluster_labels(members).collect()}
    assert sum(r.n for r in named.values()) == len(x) and {r.label for r in named.values()} == {"l0", "l1", "l2", "l3"}
    typical = mx.typical_members(members, 3).collect()
    assert len(typical) == 3 * len(named) and {r["rank"] for r in typical} == {1, 2, 3}


def test_empty_and_tiny(spark):
    assert mx.mixture_members(spark.createDataFrame([], SCHEMA), "cell", "x", 20, F.col("label")).collect() == []
    rows = [("a", [1.0] * 20, "l", 1), ("b", [1.0] * 20, None, 1)]
    members = mx.mixture_members(spark.createDataFrame(rows, SCHEMA), "cell", "x", 20, F.col("label"))
    assert [tuple(r) for r in mx.doubtful_labels(members).collect()] == [("b", "l")]


def test_density_is_that_of_the_normal_distribution():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(3, 4, 4))
    model = mx.Mixture(np.array([0.2, 0.3, 0.5]), rng.normal(size=(3, 4)), a @ a.transpose(0, 2, 1) + 0.1 * np.eye(4))
    z = rng.normal(size=(9, 4))
    for i in range(3):
        y = z - model.mean[i]
        want = np.log(model.weight[i]) - 0.5 * (4 * np.log(2 * np.pi) + np.linalg.slogdet(model.cov[i])[1] + (y @ np.linalg.inv(model.cov[i]) * y).sum(1))
        assert np.allclose(model.log_density(z)[:, i], want)
    r, like = mx.soft(model.log_density(z))
    s = mx.sufficient(model, z)
    assert np.isclose(s[0], like) and np.allclose(s[1:4], r.sum(0)) and np.allclose(s[4:16].reshape(3, 4), r.T @ z)
    assert np.allclose(s[16:].reshape(3, 4, 4), np.einsum("nk,ni,nj->kij", r, z, z))


def test_likelihood_grows(spark):
    x, _ = blobs(3)
    z = x[:, :6]
    for model in mx.starts(spark, z, [3], 1e-3, steps=0)[3]:
        last = -np.inf
        for _ in range(8):
            s = mx.sufficient(model, z)
            assert s[0] >= last - 1e-3 * abs(s[0])
            last, model = s[0], mx.updated(s, 3, 6, len(z), 1e-3, model.tied)


def test_more_labels_than_any_list_of_numbers(spark):
    x, own = blobs(5, sizes=(30,) * 40)
    wrong = {(f"c{i:04d}", f"l{c}") for i, c in enumerate(own) if i % 30 == 9}
    rows = [(f"c{i:04d}", [float(a) for a in v], f"l{(c + 1) % 40}" if i % 30 == 9 else f"l{c}", 1) for i, (v, c) in enumerate(zip(x, own))]
    members = mx.mixture_members(spark.createDataFrame(rows, SCHEMA).repartition(3), "cell", "x", 20, F.col("label"))
    assert {tuple(r) for r in mx.doubtful_labels(members).collect()} == wrong
    assert {r.label for r in mx.cluster_labels(members).collect()} == {f"l{c}" for c in range(40)}


def test_best_count_has_no_upper_end():
    for want in (1, 2, 3, 13, 19, 22, 100, 777):
        assert mx.best_count(lambda ks: [abs(k - want) for k in ks], 10_000) == want
    assert mx.best_count(lambda ks: [-k for k in ks], 50) == 50 and mx.best_count(lambda ks: [-k for k in ks], 1) == 1

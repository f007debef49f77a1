import numpy as np
from pyspark.sql import functions as F

from methyloom.operators import diff, doublets, embed, matrix


def test_permutation_is_calibrated():
    rng = np.random.default_rng(0)
    p = []
    for i in range(120):
        cov = rng.integers(10, 40, 4)
        mc = rng.binomial(cov, 0.7)
        p.append(diff.permutation_p(np.stack([mc, cov - mc], 1), 400, 1.0, np.random.default_rng(i)))
    assert 0.3 < np.mean(p) < 0.7 and np.mean(np.array(p) < 0.1) < 0.2
    far = np.array([[30, 2], [2, 30], [15, 15]])
    assert diff.permutation_p(far, 1000, 0.034, rng) <= 0.002
    assert diff.permutation_p(np.zeros((3, 2), int), 10, 0.1, rng) == 1.0


def chain(rows, max_dist, cutoff):
    out, n, before = {}, {}, None
    for chrom, pos, frac in sorted(rows):
        f = np.array([1.0 if x is None else x for x in frac])
        go = before is not None and before[0] == chrom and pos - before[1] < max_dist
        if go:
            a, b = before[2] - before[2].mean(), f - f.mean()
            d = np.sqrt((a * a).sum() * (b * b).sum())
            go = d > 0 and (a * b).sum() / d > cutoff
        if not go:
            n[chrom] = n.get(chrom, -1) + 1
        out[chrom, pos] = n[chrom]
        before = (chrom, pos, f)
    return out


def test_chains_over_partitions(spark):
    rng = np.random.default_rng(3)
    rows = [(f"chr{c}", int(p), [None if rng.random() < 0.1 else float(x) for x in rng.random(4)]) for c in range(1, 4) for p in np.unique(rng.integers(0, 4000, 150))]
    df = spark.createDataFrame(rows, "chrom STRING, pos BIGINT, frac ARRAY<DOUBLE>").repartition(6)
    got = {(r.chrom, r.pos): r.island for r in diff.chain_sites(df, 40, -0.2).collect()}
    assert got == chain(rows, 40, -0.2)


def test_scores_against_exact_sums(spark):
    from math import comb

    rows = [("c", f"r{i}", "CGN", m, n) for i, (m, n) in enumerate([(0, 5), (3, 9), (9, 9), (2, 0 + 2), (0, 0)])]
    c = spark.createDataFrame(rows, "cell STRING, region STRING, mc_type STRING, mc BIGINT, cov BIGINT")
    p = sum(r[3] for r in rows) / (sum(r[4] for r in rows) + 1e-6)
    got = {r.region: r.score for r in matrix.scores(c, cutoff=0.0).collect()}
    for _, region, _, m, n in rows:
        if n:
            assert abs(got[region] - sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(m + 1, n + 1))) < 1e-9
    assert "r4" not in got


def test_graph_and_doublets(spark):
    e = spark.createDataFrame([("b", "a"), ("c", "b"), ("y", "x"), ("z", "z")], "a STRING, b STRING")
    assert {r.id: r.component for r in embed.connected_components(e).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x", "z": "z"}
    s = spark.createDataFrame([("c1", "chr1", i * 100, 3) for i in range(5)] + [("c2", "chr1", 0, 4), ("c3", "chr1", 0, 1)], "cell STRING, chrom STRING, pos BIGINT, cov BIGINT")
    assert {r.cell: (r.bins, r.total) for r in doublets.cell_bins(s).collect()} == {"c1": (5, 5), "c2": (1, 1), "c3": (0, 1)}
    assert doublets.coverage_doublets(s).count() == 3
    counts = spark.createDataFrame([(f"c{i}", "r", "CGN", 1, 2) for i in range(4)], "cell STRING, region STRING, mc_type STRING, mc BIGINT, cov BIGINT")
    assert doublets.simulate_doublets(counts).agg(F.count("*"), F.min("cov")).first()[0] == 8


def test_pca_and_components(spark):
    x = np.random.default_rng(0).normal(size=(200, 5)) * [5, 3, 1, 1, 1]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id BIGINT, v ARRAY<DOUBLE>")
    p = embed.Pca(df, 5, 2)
    assert np.allclose(p.variance, np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1][:2])
    z = np.array([r.v for r in p.transform(df).orderBy("id").collect()])
    assert np.allclose(z, (x - x.mean(0)) @ p.axes)
    a, b, s = embed.cca(df.where("id < 80"), df.where("id >= 80"), 5, 2)
    u, v = (np.array([r.v for r in d.orderBy("id").collect()]) for d in (a, b))
    xs, ys = ((m - m.mean(0)) / m.std(0) for m in (x[:80], x[80:]))
    assert np.allclose(s, np.linalg.svd(xs @ ys.T)[1][:2]) and np.allclose(u.T @ u, np.eye(2), atol=1e-8) and np.allclose(v.T @ v, np.eye(2), atol=1e-8)


def test_called_sites_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for pos in range(1, 60):
        for s in ("a", "b", "c"):
            if rng.random() < 0.8:
                cov = int(rng.integers(1, 90))
                rows.append(("chr1", pos * 40, s, int(rng.binomial(cov, 0.9 if pos % 9 == 0 and s == "a" else 0.3)), cov))
    rows += [("chr1", 5000, "a", 4, 9), ("chr1", 5001, "a", 0, 9), ("chr1", 5001, "b", 0, 3)]
    df = spark.createDataFrame(rows, "chrom STRING, pos BIGINT, sample STRING, mc BIGINT, cov BIGINT").repartition(3)
    seeds = {r.pos: r.s for r in df.select("pos", F.xxhash64("chrom", "pos").alias("s")).distinct().collect()}
    names, most = ["a", "b", "c"], 50.0
    want = {}
    for pos in {r[1] for r in rows}:
        t = np.zeros((3, 2), np.int64)
        for _, p, s, m, c in rows:
            if p == pos:
                pair = (m, c - m) if c <= most else (int(most * (m / c)), int(most * ((c - m) / c)))
                t[names.index(s)] = pair
        want[pos] = diff.permutation_p(t, 300, 0.034, np.random.default_rng(seeds[pos] & 0xFFFFFFFFFFFFFFFF))
    got = {r.pos: (r.p_value, r.q_value) for r in diff.call_dms(df, names, n_permute=300, p_cutoff=None).collect()}
    assert {p: v[0] for p, v in got.items()} == want and got[5000][0] == got[5001][0] == 1.0
    order = sorted(want, key=lambda p: want[p])
    q, run = {}, 1.0
    for i in range(len(order) - 1, -1, -1):
        run = min(run, want[order[i]] * len(order) / (i + 1))
        q[order[i]] = run
    assert all(np.isclose(got[p][1], q[p]) for p in want)
    dms = diff.call_dms(df, names, n_permute=300, p_cutoff=None)
    found = diff.call_dmr(dms, names, p_cutoff=0.05).collect()
    use = [p for p in want if want[p] <= 0.05]
    assert found and sum(r.ndms for r in found if r.sample == "a") <= len(use) and all(r.end - r.start >= 2 for r in found)


def test_normal_estimate_goes_below_the_permutations():
    far = np.array([[40, 2], [2, 40], [20, 20]])
    p = diff.permutation_p(far, 500, 0.034, np.random.default_rng(0), normal=True)
    assert 1e-14 <= p < 1e-4
    near = diff.permutation_p(np.array([[10, 10], [11, 9]]), 500, 0.9, np.random.default_rng(0), normal=True)
    assert near > 0.1

from collections import Counter, defaultdict

import numpy as np

from methyloom.operators import contact as ct

TSS, ENHANCERS, MATRIX = "tss STRING, chrom STRING, pos BIGINT", "enhancer STRING, chrom STRING, pos BIGINT, activity DOUBLE", "chrom STRING, bin1 BIGINT, bin2 BIGINT, value DOUBLE"


def pair_by_pair(spark, tss, enhancers, matrix, cutoff):
    pixels = {(r.chrom, r.bin1, r.bin2): r.value for r in ct.diagonal_filled(spark.createDataFrame(matrix, MATRIX)).collect()}
    pixels |= {(c, b, a): v for (c, a, b), v in pixels.items()}
    raw, total = [], defaultdict(float)
    for t, c, p in tss:
        for e, d, q, activity in enhancers:
            if c == d and activity is not None and (c, p // 1000, q // 1000) in pixels and abs(p // 1000 - q // 1000) < 10:
                raw.append((e, t, activity * pixels[c, p // 1000, q // 1000]))
                total[t] += raw[-1][2]
    return Counter((e, t, round(r / (total[t] + 1e-9), 9)) for e, t, r in raw if r / (total[t] + 1e-9) > cutoff)


def scores(spark, tss, enhancers, matrix, cutoff):
    return ct.abc_scores(spark.createDataFrame(tss, TSS), spark.createDataFrame(enhancers, ENHANCERS), spark.createDataFrame(matrix, MATRIX), 1000, 10_000, cutoff)


def test_abc_scores_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(0)
    matrix = [(f"chr{c}", a, b, float(rng.integers(1, 9))) for c in (1, 2) for a in range(30) for b in range(a, 30) if rng.random() < 0.4]
    one = [(f"t{i}", f"chr{rng.integers(1, 3)}", int(rng.integers(0, 30_000))) for i in range(60)]
    several = [*one, *[(t, f"chr{rng.integers(1, 3)}", int(rng.integers(0, 30_000))) for t, _, _ in one[:9] for _ in range(3)], one[20], *[(None, "chr1", p) for p in (500, 9500, 9600)]]
    positive = [(f"e{i}", f"chr{rng.integers(1, 3)}", int(rng.integers(0, 30_000)), float(rng.gamma(0.3))) for i in range(80)]
    signed = [*[(e, c, p, float(rng.normal(0.3))) for e, c, p, _ in positive], ("e0", "chr1", 500, None), ("e0", "chr1", 500, 2.0)]
    for tss, enhancers, cutoff in ((one, positive, 0.02), (several, positive, 0.02), (several, positive, -0.1), (several, signed, 0.02), (one, signed, 0.2)):
        got = Counter((r.enhancer, r.tss, round(r.abc, 9)) for r in scores(spark, tss, enhancers, matrix, cutoff).collect())
        assert got and got == pair_by_pair(spark, tss, enhancers, matrix, cutoff)


def written(spark):
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty(30_000)
    return context.statusStore().executorList(False).head().totalShuffleWrite()


def test_abc_scores_shuffle_no_pairs(spark):
    n = 1500
    tss = [(f"t{i}", "chr1", i % 4 * 1000) for i in range(n)]
    enhancers = [(f"e{i}", "chr1", i % 4 * 1000, 1000.0 if i < 8 else 1.0) for i in range(n)]
    matrix = [("chr1", a, b, 1.0) for a in range(4) for b in range(a + 1, 4)]
    before = written(spark)
    assert scores(spark, tss, enhancers, matrix, 0.02).count() > n
    assert written(spark) - before < 500_000

import math

import numpy as np
from pyspark.sql import functions as F

from methyloom.functions import sequence as sq
from methyloom.functions import stats as st
from methyloom.operators.ranking import exact_quantiles, global_rank


def test_log_gamma_and_beta():
    x = np.array([0.1, 0.5, 1, 2.5, 10, 1234.5])
    assert np.allclose(st.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)
    for n, k, p in [(10, 3, 0.2), (500, 100, 0.25), (3, 0, 0.9), (9999, 9000, 0.91)]:
        exact = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p)) for i in range(k + 1, n + 1))
        assert abs(float(st.incomplete_beta(k + 1, n - k, p)) - exact) < 1e-9


def test_tails_in_spark(spark):
    df = spark.createDataFrame([(10, 3, 0.2, 2.0), (5, 5, 0.5, 0.5), (None, 1, 0.5, None), (4, -1, 0.5, 3.0)], "n INT, k INT, p DOUBLE, m DOUBLE")
    r = df.select(st.binomial_tail(F.col("n"), F.col("k"), F.col("p")).alias("b"), st.poisson_tail(F.col("k"), F.col("m")).alias("o"), st.normal_tail(F.col("m")).alias("z")).collect()
    assert abs(r[0].b - 0.1208738816) < 1e-9 and r[1].b == 0 and r[2].b is None and r[3].b == 1
    assert abs(r[0].o - (1 - math.exp(-2) * (1 + 2 + 2 + 8 / 6))) < 1e-12 and r[2].o is None and r[3].o == 1
    assert abs(r[0].z - 0.02275013194817921) < 1e-12


def test_fisher(spark):
    r = spark.createDataFrame([(8, 2, 1, 5)], "a INT, b INT, c INT, d INT").select(st.fisher_exact(*[F.col(c) for c in "abcd"]).alias("p")).first()
    assert abs(r.p - 0.03496503496503495) < 1e-10


def bh(p):
    p = np.asarray(p)
    o = np.argsort(p)
    q = np.minimum.accumulate((p[o] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1]
    out = np.empty(len(p))
    out[o] = np.minimum(q, 1)
    return out


def test_benjamini_hochberg(spark):
    rng = np.random.default_rng(0)
    p = np.round(rng.random(400) ** 3, 3)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)] + [(999, None)], "i INT, p DOUBLE")
    want = bh(p)
    got = {r.i: r.q for r in st.benjamini_hochberg(df, "p").collect()}
    assert got.pop(999) is None and len(got) == 400
    # ties share the smallest value of their run
    assert all(abs(got[i] - want[i]) < 1e-9 or p.tolist().count(p[i]) > 1 for i in got)
    small = {r.i: r.q for r in df.withColumn("q", st.bh_within(F.col("p"), [F.lit(1)])).collect() if r.i != 999}
    tied = {v: min(want[p == v]) for v in set(p.tolist())}
    assert all(abs(small[i] - tied[p[i]]) < 1e-9 for i in small)


def test_ranks_and_quantiles(spark):
    rng = np.random.default_rng(1)
    rows = [(k, float(v)) for k in ("a", "b", None) for v in rng.random(101).round(2)]
    df = spark.createDataFrame(rows, "k STRING, v DOUBLE").repartition(7)
    ranks = sorted((str(r.k), r["rank"]) for r in global_rank(df, "k", [F.col("v")]).collect())
    assert ranks == sorted((k, i) for k in ("a", "b", "None") for i in range(101))
    q = {r.k: r for r in exact_quantiles(df, "v", [0.1, 0.5, 0.93], "k").collect()}
    for k in ("a", "b"):
        v = [x for n, x in rows if n == k]
        assert np.allclose(q[k][1:], np.quantile(v, [0.1, 0.5, 0.93]))
    assert global_rank(df.limit(0), None, [F.col("v")]).collect() == []


def test_sequences(spark):
    assert sq.expand_pattern("CG") == ["CG"] and len(sq.expand_pattern("CHN")) == 15
    assert "CAN" in sq.expand_pattern("CHN") and "ACAN" in sq.expand_pattern("HCHN")
    assert "CNN" not in sq.expand_pattern("CHN") and "CHN" not in sq.expand_pattern("CHN")
    assert sq.expand_pattern("ch") == ["CA", "CC", "CH", "CT"] and len(sq.expand_pattern("CNN")) == 25
    r = spark.createDataFrame([("AcgTN", "HC"), ("", None)], "s STRING, c STRING").select(sq.reverse_complement(F.col("s")).alias("r"), F.size(sq.kmers(F.col("s"), 3)).alias("k")).collect()
    assert [tuple(x) for x in r] == [("NAcgT", 3), ("", 0)]

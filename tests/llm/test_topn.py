import random

import pytest
from pyspark.sql import functions as F

from methyloom.llm.topn import order_code, ranked, refine, top_n_per_group

SCHEMA = "g STRING, s DOUBLE, name STRING, id BIGINT, extra STRING"


def brute(rows, n):
    seen = {}
    for g, s, name, i, extra in rows:
        if g is not None and s is not None and s == s and i is not None:
            key = (g, s, name, extra)
            seen[key] = min(seen.get(key, i), i)
    out, by = set(), {}
    for (g, s, name, _), i in seen.items():
        by.setdefault(g, []).append((-s, name is None, name or "", i))
    for g, items in by.items():
        out |= {(g, i) for *_, i in sorted(items)[:n]}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(1500):
        g = rng.choice(["hot"] * 6 + [f"g{rng.randrange(60)}", None])
        s = rng.choice([round(rng.random(), 1 + seed), 0.5, None, float("nan"), -0.0, 0.0, -3.5, 1e300])
        rows.append((g, s, rng.choice(["a", "ab", "ab\0", "zz" * 9, "", None, "é"]), i if rng.random() > 0.02 else None, rng.choice(["x", "x", None])))
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = top_n_per_group(df, "g", F.col("s"), "name", "id", 7).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute(rows, 7)


def test_all_tied_repeats_and_small_groups(spark):
    rows = [("a", 1.0, "n", i, str(i)) for i in range(300)] + [("b", 1.0, "n", 500 + i, "same") for i in range(40)] + [("c", 0.1, None, 900, None)]
    got = {tuple(r) for r in top_n_per_group(spark.createDataFrame(rows, SCHEMA), "g", F.col("s"), "name", "id", 10).collect()}
    assert got == {("a", i) for i in range(10)} | {("b", 500), ("c", 900)}


def test_empty_and_clashing_names(spark):
    assert top_n_per_group(spark.createDataFrame([], SCHEMA), "g", F.col("s"), "name", "id").collect() == []
    df = spark.createDataFrame([("x", 1.0, "n", 1, 7, 8, 9)], "g STRING, w DOUBLE, name STRING, id BIGINT, need INT, cut INT, h1 INT")
    assert [tuple(r) for r in top_n_per_group(df, "g", F.col("w"), "name", "id").collect()] == [("x", 1)]


def test_codes_keep_the_order(spark):
    v = [-1e308, -2.5, -1e-320, -0.0, 0.0, 1e-320, 0.5, 0.5000000001, 3.0, float("inf")]
    codes = [r.c for r in spark.createDataFrame([(x,) for x in v], "x DOUBLE").select(order_code(F.col("x")).alias("c")).collect()]
    assert codes == sorted(codes) and codes[3] == codes[4] and len(set(codes)) == len(v) - 1


def test_refine_and_rank(spark):
    df = spark.range(1000).select(F.lit("g").alias("g"), (F.col("id") * 7919 % 1000 - 500).alias("w"), F.lit(10).cast("long").alias("need"))
    assert [tuple(r) for r in refine(df).collect()] == [("g", 490, 1, 1)]
    held, total = ranked(df, [F.col("w")], 4)
    assert total == 1000 and held.where("rank <> w + 500").count() == 0

import random

import pytest

from methyloom.operators.intervals import periods_and_gaps, prefix_combine


def brute(rows):
    out, by = [], {}
    for sample, chrom, a, z in rows:
        if a is not None and z is not None and z > a:
            by.setdefault((sample, chrom), []).append((a, z))
    for key, spans in by.items():
        merged = []
        for a, z in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], z)
            else:
                merged.append([a, z])
        out += [(*key, "period", a, z) for a, z in merged]
        out += [(*key, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:])]
    return sorted(out, key=str)


def run(spark, rows, partitions=None):
    df = spark.createDataFrame(rows, "sample STRING, chrom STRING, start BIGINT, end BIGINT")
    return sorted((tuple(r) for r in periods_and_gaps(df, ["sample", "chrom"], partitions=partitions).collect()), key=str)


@pytest.mark.parametrize("seed,partitions", [(1, 1), (2, 4), (3, 13)])
def test_random_intervals(spark, seed, partitions):
    rng = random.Random(seed)
    rows = []
    for _ in range(600):
        a = rng.randrange(0, 4000)
        rows.append((rng.choice(["s1", "s2", None]), rng.choice(["chr1", "chr2"]), rng.choice([a, a, a, None]), rng.choice([a + rng.randrange(-3, 30), None, a + 1])))
    assert run(spark, rows, partitions) == brute(rows)


def test_one_hot_entity_with_a_long_interval_over_all_partitions(spark):
    rows = [("s", "chr1", i * 10, i * 10 + 5) for i in range(500)] + [("s", "chr1", 100, 4000)] + [("s", "chr1", 7, 9)] * 300
    assert run(spark, rows, 9) == brute(rows)


def test_empty_touching_and_repeated(spark):
    assert run(spark, []) == []
    assert run(spark, [("s", "c", 0, 5), ("s", "c", 5, 9), ("s", "c", 5, 9), ("s", "c", 9, 9)]) == [("s", "c", "period", 0, 9)]


def test_clashing_columns(spark):
    df = spark.createDataFrame([("a", 1, 3, "x", 9, 1), ("a", 5, 8, "y", 9, 2)], "key STRING, start BIGINT, end BIGINT, kind STRING, tie INT, part INT")
    assert sorted(tuple(r) for r in periods_and_gaps(df, ["key"]).collect()) == [("a", "gap", 3, 5), ("a", "period", 1, 3), ("a", "period", 5, 8)]


def test_prefix_combine():
    carry, left = prefix_combine([(0, "a", "b", 5, 9), (2, "b", "b", 7, 8), (3, "b", "c", 1, 2)])
    assert carry == {2: ("b", 5, 9), 3: ("b", 5, 9)} and left == {0, 2}

from pyspark.sql import functions as F

from methyloom.operators.tree_agg import heavy_keys, tree_aggregate

AGG = {"n": ("count", "*"), "nv": ("count", "v"), "total": ("sum", "v"), "lo": ("min", "v"), "hi": ("max", "v"), "mean": ("avg", "v"), "var": ("var_pop", "v")}


def test_same_as_group_by_with_a_hot_key(spark):
    df = spark.range(0, 5000, 1, 37).select(F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.col("id").cast("string")).alias("k"), F.when(F.col("id") % 11 > 0, F.col("id")).alias("v"))
    got = tree_aggregate(df, ["k"], AGG, fan_in=3, chunk_rows=64)
    want = df.groupBy("k").agg(F.count("*").alias("n"), F.count("v").alias("nv"), F.sum("v").alias("total"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("mean"), F.var_pop("v").alias("var"))
    a, b = ({r.k: r for r in x.collect()} for x in (got, want))
    assert a.keys() == b.keys()
    for k, r in b.items():
        assert a[k][:6] == r[:6]
        assert (a[k].mean is None) == (r.mean is None) and (r.mean is None or abs(a[k].mean - r.mean) < 1e-9 and abs(a[k]["var"] - r["var"]) < 1e-4)


def test_empty_and_clashing_names(spark):
    empty = spark.createDataFrame([], "k STRING, v BIGINT, __leaf INT, key STRING")
    assert tree_aggregate(empty, ["k"], AGG).collect() == []
    df = spark.createDataFrame([("a", 1, 5, "z"), ("a", 2, 6, "z")], "k STRING, v BIGINT, __leaf INT, n STRING")
    assert tree_aggregate(df, ["k"], {"n": ("count", "*"), "total": ("sum", "v")}).collect() == [("a", 2, 3)]


def test_heavy_keys(spark):
    df = spark.createDataFrame([(None,)] * 5 + [("a",)] * 2 + [("b",)] * 3 + [("",)] * 10, "g STRING")
    assert sorted(tuple(r) for r in heavy_keys(df, F.col("g"), 0.15).collect()) == [("", 10), ("b", 3)]
    assert heavy_keys(df.limit(0), F.col("g")).collect() == []

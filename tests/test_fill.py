from pyspark.sql import functions as F

from methyloom.operators.fill import Field, fill_counts, fill_from_groups

MCDS = "row_id BIGINT, cell STRING, region STRING, mc_type STRING, strand_type STRING, mc BIGINT, cov BIGINT"
ADATA = "cell STRING, groups STRING"


def run(spark, rows, cells=(), schema=MCDS, **options):
    return {r.row_id: r for r in fill_counts(spark.createDataFrame(rows, schema), spark.createDataFrame(list(cells), ADATA), **options).collect()}


def test_cases_and_levels(spark):
    rows = [(i, f"c{i}", "chr1_1", "CGN", "both", 5, 10) for i in range(6)]
    rows += [(10, "c0", "chr1_1", "CGN", "both", None, 20), (11, "c1", "chr1_1", "CGN", "both", 7, None), (12, "c2", "chr1_1", "CGN", "both", -999, 99999), (13, "c3", "chr1_1", "CGN", "both", 30, 10), (14, "x", "chr9_9", "CGN", "both", None, None), (15, None, None, None, None, None, None)]
    out = run(spark, rows, [(f"c{i}", "A ") for i in range(6)] + [("c0", "a")], min_support=3)
    assert len(out) == len(rows)
    assert all(0 <= r.mc <= r.cov for r in out.values())
    assert (out[10].mc, out[10].mc_filled, out[10].cov_filled, out[10].mc_level) == (10, True, False, 0)
    assert (out[11].mc, out[11].cov, out[11].mc_filled, out[11].cov_filled) == (7, 10, False, True)
    assert (out[12].mc_filled, out[12].cov_filled) == (True, True)
    assert (out[13].mc, out[13].cov, out[13].mc_filled, out[13].cov_filled) == (30, 30, False, True)
    assert out[14].cov_level == 3 and out[15].cov_level == 4
    assert out[0].mc_filled is False and out[0].mc_level is None


def test_nothing_usable_and_empty(spark):
    out = run(spark, [(1, "a", "r", "CGN", "+", None, None)])
    assert (out[1].mc, out[1].cov, out[1].mc_level, out[1].cov_level) == (0, 0, -1, -1)
    assert run(spark, []) == {}


def test_clashing_names_stay(spark):
    rows = [(1, "a", "r", "CGN", "+", 1, 2, "keep"), (2, "b", "r", "CGN", "+", None, 4, "too")]
    out = run(spark, rows, schema=MCDS + ", MC_filled STRING")
    assert out[2]["MC_filled_in"] == "too" and out[2]["mc_filled"] is True


def test_general_median_and_mode(spark):
    df = spark.createDataFrame([("g", 1, "x"), ("g", 3, "x"), ("g", 5, "y"), ("g", None, None), ("h", None, "z"), (None, None, None)], "k STRING, n BIGINT, c STRING")
    out = fill_from_groups(df, [Field("n", F.col("n")), Field("c", F.col("c"), "mode")], [["k"], []], min_support=2).collect()
    got = sorted((str(r.k), r.n, r.c, r.n_filled, r.n_level, r.c_level) for r in out if r.n_filled)
    assert got == [("None", 3, "x", True, 1, 1), ("g", 3, "x", True, 0, 0), ("h", 3, "z", True, 1, None)]

"""Plans are the ones wanted: filters and columns reach the scan, partial aggregates come before exchanges."""

import re

from pyspark.sql import functions as F

from methyloom.operators import matrix, sites
from methyloom.operators.tree_agg import tree_aggregate
from methyloom.sources.writers import write_site_store


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_region_reads_prune(spark, tmp_path):
    rows = [(f"chr{c}", p, "+", "CGA", 1, 2) for c in (1, 2) for p in range(1, 50)]
    write_site_store(spark.createDataFrame(rows, "chrom STRING, pos BIGINT, strand STRING, context STRING, mc BIGINT, cov BIGINT"), str(tmp_path / "s"))
    read = spark.read.parquet(str(tmp_path / "s"))
    got = sites.fetch(read, "chr1", 10, 20).select("mc")
    text = plan(got)
    assert got.count() == 10
    assert re.search(r"PartitionFilters: \[isnotnull\(chrom.*chr1", text)
    assert re.search(r"PushedFilters: \[.*GreaterThan\(pos,10\).*LessThanOrEqual\(pos,20\)", text)
    assert re.search(r"ReadSchema: struct<pos:bigint,mc:bigint>", text)


def test_partial_aggregates_come_first(spark):
    df = spark.range(10).select(F.lit("c").alias("cell"), F.lit("chr1").alias("chrom"), F.col("id").alias("pos"), F.lit("+").alias("strand"), F.lit("CGA").alias("context"), F.col("id").alias("mc"), F.col("id").alias("cov"))
    for made in (sites.merge_sites(df), sites.profile(df), matrix.count_bins(df, spark.createDataFrame([("chr1", 100)], "chrom STRING, size BIGINT"), 10, ["CGN"]), tree_aggregate(df, ["chrom"], {"n": ("count", "*")})):
        assert "partial_" in plan(made)


def test_no_broadcast_hints_in_sources():
    import pathlib

    root = pathlib.Path(__file__).parent.parent / "methyloom"
    assert not [p for p in root.rglob("*.py") if "broadcast(" in p.read_text().replace("sparkContext.broadcast(", "").replace("SparkContext.broadcast(", "")]

"""The clean views that the reference's operators are queried on, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.fill import NO_LABEL, usable_counts
from ..schema import label_key, spell_chrom


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def chrom_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chrom_sizes")


def sites(spark: SparkSession, sf: str) -> DataFrame:
    """Usable base-level rows: cell, chrom, pos, strand, context, mc, cov."""
    rows = table(spark, sf, "allc").where("cell IS NOT NULL AND pos IS NOT NULL AND strand IS NOT NULL AND context IS NOT NULL AND mc >= 0 AND mc <= cov")
    return spell_chrom(rows.select("cell", "chrom", "pos", "strand", "context", "mc", "cov"), chrom_sizes(spark, sf))


def regions(spark: SparkSession, sf: str) -> DataFrame:
    """Usable regions: region, sample, chrom, start, end."""
    bed = table(spark, sf, "bed").where("start IS NOT NULL AND end > start").select(F.col("region_id").alias("region"), "sample", "chrom", "start", "end")
    return spell_chrom(bed, chrom_sizes(spark, sf))


def counts(spark: SparkSession, sf: str) -> DataFrame:
    """Usable rows of both strands, each cell, region and mc_type once: cell, region, mc_type, mc, cov."""
    mc, cov = usable_counts(F.col("mc"), F.col("cov"))
    rows = table(spark, sf, "mcds").where((F.col("strand_type") == "both") & mc.isNotNull() & cov.isNotNull())
    return rows.groupBy("cell", "region", "mc_type").agg(F.min_by("mc", "row_id").alias("mc"), F.min_by("cov", "row_id").alias("cov"))


def clusters(spark: SparkSession, sf: str) -> DataFrame:
    """cell, cluster: each labelled cell once."""
    label = label_key(F.col("groups"))
    rows = table(spark, sf, "adata").where(F.col("cell").isNotNull() & label.isNotNull() & ~label.isin(*NO_LABEL))
    return rows.groupBy("cell").agg(F.min(label).alias("cluster"))


_K = "regexp_replace(lower(trim({})), '^chr', '')"
SPELL = f"spell AS (SELECT {_K.format('chrom')} AS ck, min(chrom) AS spelt, min(size) AS size, min(chrom_order) AS chrom_order FROM chrom_sizes GROUP BY 1)"
SITES = f"""{SPELL}, sites AS (SELECT cell, spelt AS chrom, pos, strand, context, mc, cov FROM allc JOIN spell ON {_K.format('allc.chrom')} = ck
  WHERE cell IS NOT NULL AND pos IS NOT NULL AND strand IS NOT NULL AND context IS NOT NULL AND mc >= 0 AND mc <= cov)"""
REGIONS = f"""regions AS (SELECT region_id AS region, sample, spelt AS chrom, start, "end" FROM bed JOIN spell ON {_K.format('bed.chrom')} = ck
  WHERE start IS NOT NULL AND "end" > start)"""
COUNTS = """counts AS (SELECT cell, region, mc_type, arg_min(mc, row_id) AS mc, arg_min(cov, row_id) AS cov FROM mcds
  WHERE strand_type = 'both' AND mc BETWEEN 0 AND 9999 AND cov BETWEEN 0 AND 9999 AND mc <= cov GROUP BY 1, 2, 3)"""
CLUSTERS = """clusters AS (SELECT cell, min(lower(trim(groups))) AS cluster FROM adata
  WHERE cell IS NOT NULL AND lower(trim(groups)) NOT IN ('', 'na', 'nan', 'none', 'unassigned') GROUP BY 1)"""

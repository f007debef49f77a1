"""Doublet detection: positions covered more often than one cell allows, and simulated doublets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import benjamini_hochberg, poisson_tail
from .ranking import global_rank


def _high(sites: DataFrame, resolution: int, cov_cutoff: int) -> DataFrame:
    high = sites.where((F.col("cov") > cov_cutoff) & (F.col("cov") <= 2 * cov_cutoff))
    return high.select("cell", "chrom", F.floor(F.col("pos") / resolution).alias("bin")).distinct()


def cell_bins(sites: DataFrame, resolution: int = 100, cov_cutoff: int = 2) -> DataFrame:
    """cell, bins, total: distinct bins with a site covered more than ``cov_cutoff`` and at most twice as often, and
    the number of sites. The bin of a site is its 1-based position div ``resolution``."""
    total = sites.groupBy("cell").agg(F.count("*").alias("total"))
    bins = _high(sites, resolution, cov_cutoff).groupBy("cell").agg(F.count("*").alias("bins"))
    return total.join(bins, "cell", "left").select("cell", F.coalesce("bins", F.lit(0)).cast("long").alias("bins"), "total")


def region_blacklist(sites: DataFrame, resolution: int = 100, cov_cutoff: int = 2, alpha: float = 0.01) -> DataFrame:
    """chrom, bin, cells, p: bins with more cells than a Poisson of the mean allows, with p strictly under the largest
    p that is significant after Benjamini-Hochberg correction."""
    cells = _high(sites, resolution, cov_cutoff).groupBy("chrom", "bin").agg(F.count("*").alias("cells"))
    mean = cells.agg(F.avg("cells").alias("mean"))
    tested = benjamini_hochberg(cells.crossJoin(mean).withColumn("p", poisson_tail(F.col("cells"), F.col("mean"))).drop("mean"), "p")
    most = tested.where(F.col("q") < alpha).agg(F.max("p").alias("__most"))
    return tested.crossJoin(most).where(F.col("p") < F.col("__most")).select("chrom", "bin", "cells", "p")


def coverage_doublets(sites: DataFrame, resolution: int = 100, cov_cutoff: int = 2, alpha: float = 0.01) -> DataFrame:
    """cell, bins, total, ratio: high-coverage bins outside the blacklist per site of each cell."""
    black = region_blacklist(sites, resolution, cov_cutoff, alpha)
    bins = _high(sites, resolution, cov_cutoff).join(black, ["chrom", "bin"], "left_anti").groupBy("cell").agg(F.count("*").alias("bins"))
    total = sites.groupBy("cell").agg(F.count("*").alias("total"))
    return total.join(bins, "cell", "left").select("cell", F.coalesce("bins", F.lit(0)).cast("long").alias("bins"), "total", (F.coalesce("bins", F.lit(0)) / F.col("total")).alias("ratio"))


def simulate_doublets(counts: DataFrame, ratio: float = 2.0, seed: int = 0) -> DataFrame:
    """cell (``sim_`` names), region, mc_type, mc, cov: sums of random pairs of cells, ``ratio`` times as many as cells.
    Partners are drawn by seeded ranks; ranks come from a global range sort of cell names, not of counts."""
    ranked = global_rank(counts.select("cell").distinct(), None, [F.col("cell")], "k").select("cell", "k")
    n = ranked.count()
    sims = counts.sparkSession.range(int(n * ratio)).select("id", F.explode(F.array(*[F.pmod(F.xxhash64(F.lit(seed), F.lit(part), "id"), F.lit(n)) for part in (1, 2)])).alias("k"))
    picked = sims.join(ranked, "k").select("id", "cell")
    return counts.join(picked, "cell").groupBy(F.concat(F.lit("sim_"), F.col("id").cast("string")).alias("cell"), "region", "mc_type").agg(F.sum("mc").alias("mc"), F.sum("cov").alias("cov"))


def doublet_likelihood(simulated_share: DataFrame, n_neighbours: int, ratio: float = 2.0, expected: float = 0.1) -> DataFrame:
    """``id``, ``score``: Bayesian likelihood that a cell is a doublet from ``n_sim``, how many of its ``n_neighbours``
    neighbours are simulated."""
    q = (F.col("n_sim") + 1) / (n_neighbours + 2)
    return simulated_share.select("id", (q * expected / ratio / (1 - expected - q * (1 - expected - expected / ratio))).alias("score"))

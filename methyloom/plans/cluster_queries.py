"""Queries of clusterings, trees and doublets. Where SQL cannot say one, tests hold its parts against known answers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import clustering as cl
from ..operators import doublets as db
from ..operators import embed as em
from ..operators import matrix as mx
from ..schema import few_values
from .base import SITES, counts, sites
from .cell_queries import labels, vectors

QUERIES, SQL = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


_BLACK = f"""{SITES}, hb AS (SELECT DISTINCT cell, chrom, pos // 100000 AS bin FROM sites WHERE cov > 2 AND cov <= 4), n AS (SELECT chrom, bin, count(*) AS cells FROM hb GROUP BY 1, 2), m AS (SELECT avg(cells) AS m FROM n),
  pk AS (SELECT cells, 1 - sum(exp(-m + k * ln(m) - lgamma(k + 1))) AS p FROM (SELECT cells, m, unnest(range(0, cells + 1)) AS k FROM (SELECT DISTINCT cells FROM n), m) GROUP BY cells),
  t AS (SELECT chrom, bin, n.cells, greatest(p, 0) AS p FROM n JOIN pk USING (cells)), r AS (SELECT *, p * (SELECT count(*) FROM t) / rank() OVER (ORDER BY p) AS raw, count(*) OVER (ORDER BY p) AS upto FROM t),
  s AS (SELECT max(p) AS most FROM r WHERE p * (SELECT count(*) FROM t) / upto < 0.01), black AS (SELECT chrom, bin, cells, p FROM t, s WHERE p < most)"""
SQL["region_blacklist"] = f"WITH {_BLACK} SELECT chrom, bin, cells, round(p, 9) AS p FROM black"
SQL["coverage_doublets"] = f"""WITH {_BLACK.replace("// 100000", "// 100")}, b AS (SELECT cell, count(*) AS bins FROM hb ANTI JOIN black USING (chrom, bin) GROUP BY 1), a AS (SELECT cell, count(*) AS total FROM sites GROUP BY 1)
  SELECT cell, coalesce(bins, 0) AS bins, total, round(coalesce(bins, 0) / total, 8) AS ratio FROM a LEFT JOIN b USING (cell)"""
SQL["pair_similarity"] = """WITH u AS (SELECT cell, min(lower(trim(groups))) AS label, any_value(X_pca) AS v FROM adata WHERE cell IS NOT NULL AND len(X_pca) = 64 AND len(list_filter(X_pca, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(X_pca, lambda x: x <> 0)) > 0 GROUP BY 1),
  x AS (SELECT label, unnest(range(0, 64)) AS i, unnest(v)::DOUBLE AS x FROM u WHERE label IS NOT NULL), m AS (SELECT label, i, median(x) AS m FROM x GROUP BY 1, 2),
  d AS (SELECT a.label AS l, b.label AS r, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS d FROM m a JOIN m b USING (i) GROUP BY 1, 2) SELECT l || '-' || r AS left_right, round(1 - d / (SELECT max(d) FROM d), 6) AS similarity FROM d"""


@query
def region_blacklist(spark, sf):
    return db.region_blacklist(sites(spark, sf), 100_000).select("chrom", "bin", "cells", F.round("p", 9).alias("p"))


@query
def coverage_doublets(spark, sf):
    return db.coverage_doublets(sites(spark, sf)).withColumn("ratio", F.round("ratio", 8))


@query
def scrublet(spark, sf):
    return cl.scrublet(counts(spark, sf).where("mc_type = 'CGN'")).withColumn("score", F.round("score", 8))


@query
def consensus_clustering(spark, sf):
    v = em.Pca(em_vectors(spark, sf), 64, 16).transform(em_vectors(spark, sf))
    return cl.consensus_clustering(v).groupBy("cluster").agg(F.count("*").alias("n"))


def em_vectors(spark, sf):
    return vectors(spark, sf).select("id", "v")


def profiles(spark, sf):
    """Few rows: one per cluster label, as a frame of labels by components."""
    few_values(vectors(spark, sf), "label", 10_000)
    c = em.centres(vectors(spark, sf)).orderBy("label").toPandas()
    import pandas as pd

    return pd.DataFrame(np.array(c["centre"].tolist(), float), index=c["label"])


@query
def cluster_tree(spark, sf):
    t = cl.bootstrap_tree(profiles(spark, sf), 50, spark)
    return spark.createDataFrame(t[["members", "size", "height", "support"]])


@query
def merge_clusters(spark, sf):
    """Siblings stay apart where their centres are further than the median distance."""
    p = profiles(spark, sf)
    x = p.to_numpy()
    centres = {k: v.to_numpy() for k, v in p.iterrows()}
    far = float(np.median(np.linalg.norm(x[:, None] - x[None], axis=2)))
    merged = cl.merge_clusters(centres, lambda a, b: float(np.linalg.norm(_mean(centres, a) - _mean(centres, b))) > far)
    return spark.createDataFrame(sorted(merged.items()), "label STRING, merged STRING")


def _mean(centres, name):
    return np.mean([centres[c] for c in name.split("::")], axis=0)


@query
def overlap_communities(spark, sf):
    c = labels(spark, sf).select(F.col("d").alias("cluster"), F.col("g").alias("co_cluster"))
    groups, q = cl.overlap_communities(em.overlap_scores(c, c))
    return spark.createDataFrame(groups).withColumn("modularity", F.lit(round(q, 8)))


@query
def kernel_dispersion(spark, sf):
    c = counts(spark, sf)
    f = mx.mean_dispersion(mx.posterior_frac(c, normalize_per_cell=False).where("mc_type = 'CHN' AND frac IS NOT NULL"))
    return cl.kernel_dispersion(f.join(mx.feature_cov_mean(c).withColumnRenamed("cov_mean", "cov"), "region"), 100).withColumn("residual", F.round("residual", 6))


@query
def pair_similarity(spark, sf):
    from ..operators.enrich import pair_similarity as similarity

    return similarity(em.centres(vectors(spark, sf)).select(F.col("label").alias("cluster"), "centre")).withColumn("similarity", F.round("similarity", 6))

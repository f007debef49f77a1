"""Queries of rank tests, enrichment and correlation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import enrich as en
from ..operators import matrix as mx
from .base import CLUSTERS, COUNTS, clusters, counts, table
from .matrix_queries import _PRIOR

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def covs(spark, sf):
    return counts(spark, sf).where("mc_type = 'CHN'").select("cell", "region", F.col("cov").cast("double").alias("value"))


_CV = f"{COUNTS}, {CLUSTERS}, v AS (SELECT cell, region, CAST(cov AS DOUBLE) AS value FROM counts WHERE mc_type = 'CHN')"


@query(f"""WITH {_CV}, x AS (SELECT region, value, cluster = 'exc-upper' AS i FROM v JOIN clusters USING (cell)),
  r AS (SELECT region, i, rank() OVER (PARTITION BY region ORDER BY value) + (count(*) OVER (PARTITION BY region, value) - 1) / 2 AS r, count(*) OVER (PARTITION BY region, value) AS t FROM x),
  s AS (SELECT region, count(*) FILTER (i) AS n1, count(*) FILTER (NOT i) AS n2, sum(r) FILTER (i) AS w, sum(t * t - 1) AS ties FROM r GROUP BY 1)
  SELECT region, n1, n2, round((w - n1 * (n1 + 1) / 2) / nullif(n1 * n2, 0), 6) AS auroc,
    round((w - n1 * (n1 + 1) / 2 - n1 * n2 / 2) / nullif(sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / nullif((n1 + n2) * (n1 + n2 - 1), 0))), 0), 5) AS z FROM s""")
def rank_sum_test(spark, sf):
    x = covs(spark, sf).join(clusters(spark, sf), "cell").withColumn("inside", F.col("cluster") == "exc-upper")
    return en.rank_sums(x, ["region"]).select("region", "n1", "n2", F.round("auroc", 6).alias("auroc"), F.round("z", 5).alias("z"))


@query(f"""WITH {_CV}, x AS (SELECT region, value, cluster FROM v JOIN clusters USING (cell)),
  r AS (SELECT region, cluster, value, rank() OVER (PARTITION BY region ORDER BY value) + (count(*) OVER (PARTITION BY region, value) - 1) / 2 AS r FROM x),
  w AS (SELECT region, count(*) AS n, sum(value) AS s FROM x GROUP BY 1), s AS (SELECT region, cluster, count(*) AS n1, sum(r) AS w, sum(value) AS s1 FROM r GROUP BY 1, 2)
  SELECT cluster, region AS names, round((s1 / n1) / nullif((w.s - s1) / nullif(n - n1, 0), 0), 5) AS fc, round(abs((s.w - n1 * (n1 + 1) / 2) / nullif(n1 * (n - n1), 0) - 0.5) + 0.5, 6) AS AUROC FROM s JOIN w USING (region)
  WHERE (s1 / n1) / nullif((w.s - s1) / nullif(n - n1, 0), 0) < 0.7 AND abs((s.w - n1 * (n1 + 1) / 2) / nullif(n1 * (n - n1), 0) - 0.5) + 0.5 > 0.8""")
def one_vs_rest_dmg(spark, sf):
    d = en.one_vs_rest(covs(spark, sf), clusters(spark, sf), adj_p_cutoff=1.1, fc_cutoff=0.7, auroc_cutoff=0.8, top_n=10**9)
    return d.select("cluster", "names", F.round("fc", 5).alias("fc"), F.round("AUROC", 6).alias("AUROC"))


@query(f"""WITH {_CV}, x AS (SELECT region, value, cluster FROM v JOIN clusters USING (cell)), p AS (SELECT a.cluster AS l, b.cluster AS r FROM (SELECT DISTINCT cluster FROM clusters) a JOIN (SELECT DISTINCT cluster FROM clusters) b ON a.cluster < b.cluster),
  y AS (SELECT region, l, r, value, x.cluster = l AS i FROM x JOIN p ON x.cluster = p.l OR x.cluster = p.r),
  k AS (SELECT *, rank() OVER (PARTITION BY region, l, r ORDER BY value) + (count(*) OVER (PARTITION BY region, l, r, value) - 1) / 2 AS k FROM y),
  s AS (SELECT region, l, r, count(*) FILTER (i) AS n1, count(*) FILTER (NOT i) AS n2, sum(k) FILTER (i) AS w, avg(value) FILTER (i) - avg(value) FILTER (NOT i) AS delta FROM k GROUP BY 1, 2, 3),
  a AS (SELECT *, abs((w - n1 * (n1 + 1) / 2) / (n1 * n2) - 0.5) + 0.5 AS auroc FROM s WHERE n1 > 0 AND n2 > 0)
  SELECT region AS names, l || '-' || r AS left_right, round(delta, 5) AS delta, CASE WHEN delta < 0 THEN l ELSE r END AS hypo_in, round(auroc, 6) AS AUROC FROM a WHERE abs(delta) > 0.3 AND auroc > 0.8""")
def pairwise_dmg(spark, sf):
    d = en.pairwise_dmg(covs(spark, sf), clusters(spark, sf), max_cells=10**9, adj_p_cutoff=1.1, auroc_cutoff=0.8, top_n=10**9)
    return d.select("names", "left_right", F.round("delta", 5).alias("delta"), "hypo_in", F.round("AUROC", 6).alias("AUROC"))


_D = "d AS (SELECT * FROM dmg_table WHERE hypo_in IS NOT NULL AND AUROC BETWEEN 0 AND 1 AND similarity BETWEEN 0 AND 1 AND NOT isnan(AUROC) AND NOT isnan(similarity))"


@query(f"WITH {_D} SELECT hypo_in, names, round(sum(AUROC * similarity), 9) AS score FROM d GROUP BY 1, 2")
def aggregate_pairwise_dmg(spark, sf):
    real = F.col("AUROC").between(0, 1) & F.col("similarity").between(0, 1)
    return en.aggregate_dmg(table(spark, sf, "dmg_table").where(F.col("hypo_in").isNotNull() & real)).select("hypo_in", "names", F.round("score", 9).alias("score"))


_EN = f"""{COUNTS}, {CLUSTERS}, {_PRIOR}, f AS (SELECT cell, region, least(raw / pm, 10) AS value FROM post WHERE mc_type = 'CHN' AND raw / pm IS NOT NULL),
  t AS (SELECT cluster, region, count(*) FILTER (value < 1) AS h, sum(value - 1) AS s FROM f JOIN clusters USING (cell) GROUP BY 1, 2),
  w AS (SELECT region, sum(h) AS HH, sum(s) AS SS FROM t GROUP BY 1), z AS (SELECT cluster, count(*) AS n, (SELECT count(*) FROM clusters) AS nn FROM clusters GROUP BY 1 HAVING count(*) > 1)"""


def fracs(spark, sf):
    return mx.posterior_frac(counts(spark, sf)).where("mc_type = 'CHN' AND frac IS NOT NULL").select("cell", "region", F.col("frac").alias("value"))


@query(f"""WITH {_EN}, g AS (SELECT z.*, w.*, coalesce(h, 0) AS h, coalesce(s, 0) AS s FROM z CROSS JOIN w LEFT JOIN t USING (cluster, region))
  SELECT cluster, region, round((h / n + 0.1) / ((HH - h) / (nn - n) + 0.1) * ((SS - s) / (nn - n) + 1.01) / (s / n + 1.01), 5) AS enrichment FROM g""")
def enrichment_score(spark, sf):
    return en.cluster_enrichment(fracs(spark, sf), clusters(spark, sf)).withColumn("enrichment", F.round("enrichment", 5))


@query(f"""WITH {_EN}, dealt AS (SELECT x.cell, y.cluster FROM (SELECT cell, row_number() OVER (ORDER BY md5('0:' || cell), cell) AS k FROM clusters) x JOIN (SELECT cluster, row_number() OVER (ORDER BY cell) AS k FROM clusters) y USING (k)),
  tn AS (SELECT cluster, region, count(*) FILTER (value < 1) AS h, sum(value - 1) AS s FROM f JOIN dealt USING (cell) GROUP BY 1, 2),
  g AS (SELECT 0 AS shuffled, z.*, w.*, coalesce(h, 0) AS h, coalesce(s, 0) AS s FROM z CROSS JOIN w LEFT JOIN t USING (cluster, region)
    UNION ALL SELECT 1, z.*, w.*, coalesce(h, 0), coalesce(s, 0) FROM z CROSS JOIN w LEFT JOIN tn USING (cluster, region)),
  e AS (SELECT shuffled, cluster, region, (h / n + 0.1) / ((HH - h) / (nn - n) + 0.1) * ((SS - s) / (nn - n) + 1.01) / (s / n + 1.01) AS e FROM g),
  p AS (SELECT *, sum(shuffled) OVER (PARTITION BY cluster ORDER BY e DESC RANGE UNBOUNDED PRECEDING) / sum(shuffled) OVER (PARTITION BY cluster) AS p FROM e),
  r AS (SELECT cluster, region, e, p, p * count(*) OVER (PARTITION BY cluster) / count(*) OVER (PARTITION BY cluster ORDER BY p) AS raw FROM p WHERE shuffled = 0),
  q AS (SELECT *, least(1.0, min(raw) OVER (PARTITION BY cluster ORDER BY p DESC)) AS q, row_number() OVER (PARTITION BY cluster ORDER BY e DESC, region) AS rank FROM r)
  SELECT cluster, region, round(e, 6) AS enrichment, round(p, 6) AS p_value, round(q, 6) AS q_value, CAST(rank AS INT) AS rank FROM q WHERE rank <= 200""")
def cluster_enriched_features(spark, sf):
    """Null scores come from labels dealt in the order of a seeded digest."""
    e = en.enriched_features(fracs(spark, sf), clusters(spark, sf), alpha=1.0)
    return e.withColumns({c: F.round(c, 6) for c in ("enrichment", "p_value", "q_value")})


_HITS = "hits AS (SELECT DISTINCT names AS region, hyper_in AS motif FROM dmg_table WHERE names IS NOT NULL AND hyper_in IS NOT NULL), ins AS (SELECT DISTINCT names AS region FROM dmg_table WHERE hypo_in = 'c0'), bg AS (SELECT DISTINCT names AS region FROM dmg_table WHERE names IS NOT NULL AND names NOT IN (SELECT region FROM ins WHERE region IS NOT NULL))"


@query(f"""WITH {_HITS}, c AS (SELECT motif, count(*) FILTER (region IN (SELECT region FROM ins)) AS hi, count(*) FILTER (region IN (SELECT region FROM bg)) AS hb FROM hits GROUP BY 1),
  n AS (SELECT (SELECT count(*) FROM ins WHERE region IS NOT NULL) AS ni, (SELECT count(*) FROM bg) AS nb)
  SELECT motif, hi + 1 AS tp, hb + 1 AS fp, ni - hi + 1 AS fn, nb - hb + 1 AS tn, round(log2((hi + 1) * (nb - hb + 1) / ((hb + 1) * (ni - hi + 1))), 5) AS log2_or FROM c, n""")
def motif_enrichment(spark, sf):
    d = table(spark, sf, "dmg_table").where("names IS NOT NULL")
    inside = d.where("hypo_in = 'c0'").select(F.col("names").alias("region")).distinct()
    background = d.select(F.col("names").alias("region")).distinct().join(inside, "region", "left_anti")
    hits = d.where("hyper_in IS NOT NULL").select(F.col("names").alias("region"), F.col("hyper_in").alias("motif"))
    return en.motif_enrichment(hits, inside, background).select("motif", "tp", "fp", "fn", "tn", F.round("log2_or", 5).alias("log2_or"))


@query(f"""WITH {_D}, x AS (SELECT hyper_in, delta > 0.4 AS i, round(AUROC, 2) AS s FROM d WHERE hyper_in IS NOT NULL AND delta IS NOT NULL AND NOT isnan(delta)),
  c AS (SELECT hyper_in, s, count(*) FILTER (i) AS a, count(*) FILTER (NOT i) AS b FROM x GROUP BY 1, 2),
  j AS (SELECT hyper_in, s, sum(a) OVER w / nullif(sum(a) OVER (PARTITION BY hyper_in), 0) - sum(b) OVER w / nullif(sum(b) OVER (PARTITION BY hyper_in), 0) AS j FROM c WINDOW w AS (PARTITION BY hyper_in ORDER BY s DESC))
  SELECT hyper_in, s AS threshold, round(j, 6) AS youden FROM j WHERE j IS NOT NULL QUALIFY row_number() OVER (PARTITION BY hyper_in ORDER BY j DESC, s DESC) = 1""")
def optimal_threshold(spark, sf):
    real = F.col("AUROC").between(0, 1) & F.col("similarity").between(0, 1)
    d = table(spark, sf, "dmg_table").where(F.col("hypo_in").isNotNull() & real & F.col("hyper_in").isNotNull() & F.col("delta").isNotNull() & ~F.isnan("delta"))
    x = d.select("hyper_in", (F.col("delta") > 0.4).alias("inside"), F.round("AUROC", 2).alias("score"))
    return en.optimal_threshold(x, ["hyper_in"]).where("youden IS NOT NULL").select("hyper_in", "threshold", F.round("youden", 6).alias("youden"))


@query(f"""WITH {_D}, r AS (SELECT hyper_in AS motif, row_number() OVER (PARTITION BY hyper_in ORDER BY AUROC DESC, dmg_id) - 1 AS rank, hypo_in FROM d WHERE hyper_in IS NOT NULL),
  a AS (SELECT motif, sum(CASE WHEN rank < 50 THEN 50 - rank ELSE 0 END) / (50 * count(*)) AS auc FROM r GROUP BY 1)
  SELECT motif, round(auc, 6) AS auc, round((auc - (SELECT avg(auc) FROM a)) / nullif((SELECT stddev_pop(auc) FROM a), 0), 5) AS nes FROM a WHERE (auc - (SELECT avg(auc) FROM a)) / nullif((SELECT stddev_pop(auc) FROM a), 0) >= 0.5""")
def recovery_enrichment(spark, sf):
    from pyspark.sql import Window

    real = F.col("AUROC").between(0, 1) & F.col("similarity").between(0, 1)
    d = table(spark, sf, "dmg_table").where(F.col("hypo_in").isNotNull() & real & F.col("hyper_in").isNotNull())
    r = d.select(F.col("hyper_in").alias("motif"), "hypo_in", (F.row_number().over(Window.partitionBy("hyper_in").orderBy(F.desc("AUROC"), "dmg_id")) - 1).alias("rank"))
    e = en.recovery_enrichment(r, 10_000, 0.005, 0.5)
    return e.select("motif", F.round("auc", 6).alias("auc"), F.round("nes", 5).alias("nes"))


_PS = f"""{COUNTS}, {CLUSTERS}, ps AS (SELECT region, mc_type, cluster AS sample, sum(mc) / nullif(sum(cov), 0) AS value FROM counts JOIN clusters USING (cell) GROUP BY 1, 2, 3),
  a AS (SELECT region AS a, sample, value AS x FROM ps WHERE mc_type = 'CGN'), b AS (SELECT region AS b, sample, value AS y FROM ps WHERE mc_type = 'CHN'),
  ra AS (SELECT DISTINCT region AS a, split_part(region, '_', 1) AS chrom, CAST(split_part(region, '_', 2) AS BIGINT) AS i FROM ps),
  pr AS (SELECT p.a, q.a AS b, q.i - p.i AS d FROM ra p JOIN ra q ON p.chrom = q.chrom AND abs(p.i - q.i) < 100)"""


def sample_fracs(spark, sf, kind):
    c = counts(spark, sf).where(F.col("mc_type") == kind).join(clusters(spark, sf), "cell")
    return c.groupBy("region", F.col("cluster").alias("sample")).agg(F.try_divide(F.sum("mc"), F.sum("cov")).alias("value"))


def near_regions(spark, sf):
    from ..operators.rangejoin import near_pairs

    r = counts(spark, sf).select("region").distinct()
    at = F.split("region", "_")
    x = r.select("region", at[0].alias("chrom"), at[1].cast("long").alias("pos"))
    return near_pairs(x.withColumnRenamed("region", "a"), x.withColumnRenamed("region", "b"), "a", "b", 100)


@query(f"""WITH {_PS} SELECT pr.a, pr.b, d AS dist, round(CASE WHEN NOT isnan(corr(x, y)) THEN corr(x, y) END, 5) AS corr FROM pr LEFT JOIN (SELECT a, sample, x, b, y FROM a JOIN b USING (sample)) j ON j.a = pr.a AND j.b = pr.b GROUP BY 1, 2, 3""")
def region_correlation(spark, sf):
    p = near_regions(spark, sf)
    a, b = sample_fracs(spark, sf, "CGN").withColumnRenamed("region", "a"), sample_fracs(spark, sf, "CHN").withColumnRenamed("region", "b")
    return en.pair_correlations(a, b, p, "a", "b").select("a", "b", "dist", F.round("corr", 5).alias("corr"))


def _spearman(name, right):
    return f"""{name} AS (SELECT pr.a, pr.b, corr(x, y) AS c FROM pr JOIN ka ON ka.a = pr.a JOIN {right} kb ON kb.b = pr.b AND kb.sample = ka.sample GROUP BY 1, 2)"""


@query(f"""WITH {_PS}, ka AS (SELECT a, sample, rank() OVER (PARTITION BY a ORDER BY x) + (count(*) OVER (PARTITION BY a, x) - 1) / 2 AS x FROM a WHERE x IS NOT NULL),
  kr AS (SELECT b, sample, rank() OVER (PARTITION BY b ORDER BY y) + (count(*) OVER (PARTITION BY b, y) - 1) / 2 AS y FROM b WHERE y IS NOT NULL),
  nm AS (SELECT x.sample, y.sample AS other FROM (SELECT sample, row_number() OVER (ORDER BY sample) AS k FROM (SELECT DISTINCT sample FROM b)) x JOIN (SELECT sample, row_number() OVER (ORDER BY md5(sample)) AS k FROM (SELECT DISTINCT sample FROM b)) y USING (k)),
  kn AS (SELECT b, other AS sample, y FROM kr JOIN nm USING (sample)), {_spearman("re", "kr")}, {_spearman("nu", "kn")},
  lv AS (SELECT k, count(*) FILTER (t = 0) AS r, count(*) FILTER (t = 1) AS n FROM (SELECT 0 AS t, least(floor(-c * 100 + 1e-9), 80) AS k FROM re WHERE -c > 0.2 AND NOT isnan(c) UNION ALL SELECT 1, least(floor(-c * 100 + 1e-9), 80) FROM nu WHERE -c > 0.2 AND NOT isnan(c)) GROUP BY 1),
  gr AS (SELECT i AS k, coalesce(r, 0) AS r, coalesce(n, 0) AS n FROM range(20, 81) t(i) LEFT JOIN lv ON lv.k = i),
  dn AS (SELECT k, sum(r) OVER w AS r, (sum(n) OVER w / (SELECT count(c) FROM nu WHERE NOT isnan(c))) / nullif(sum(r) OVER w / (SELECT count(c) FROM re WHERE NOT isnan(c)), 0) AS fdr FROM gr WINDOW w AS (ORDER BY k DESC)),
  bd AS (SELECT *, sum(CASE WHEN fdr >= 0.9 THEN 1 ELSE 0 END) OVER (ORDER BY k DESC) AS bad FROM dn)
  SELECT k / 100 AS cutoff, fdr, CAST(r AS BIGINT) AS n FROM bd WHERE bad = 0 AND r > 0 ORDER BY k LIMIT 1""")
def correlation_cutoff(spark, sf):
    """Null pairs are those of samples dealt by a digest of their names."""
    p = near_regions(spark, sf)
    a, b = sample_fracs(spark, sf, "CGN").withColumnRenamed("region", "a"), sample_fracs(spark, sf, "CHN").withColumnRenamed("region", "b")
    names = b.select("sample").distinct().withColumn("k", F.row_number().over(_order("sample"))).join(b.select("sample").distinct().select(F.col("sample").alias("other"), F.row_number().over(_order("h", F.md5("sample"))).alias("k")), "k").drop("k")
    shuffled = b.join(names, "sample").drop("sample").withColumnRenamed("other", "sample")
    real, null = en.pair_correlations(a, b, p, "a", "b", "spearman"), en.pair_correlations(a, shuffled, p, "a", "b", "spearman")
    return en.correlation_cutoff(real, null, "-", 0.9)


def _order(name, column=None):
    from pyspark.sql import Window

    return Window.orderBy(column if column is not None else F.col(name))


@query(f"""WITH {_PS}, f AS (SELECT region, sample, value FROM ps WHERE mc_type = 'CGN' AND value IS NOT NULL),
  c AS (SELECT sample, avg(value) AS u, avg(value * value) AS v FROM f GROUP BY 1), j AS (SELECT region, sample, value - avg(value) OVER w AS y, u - avg(u) OVER w AS u, v - avg(v) OVER w AS v FROM f JOIN c USING (sample) WINDOW w AS (PARTITION BY region)),
  s AS (SELECT region, sum(u*u) AS uu, sum(v*v) AS vv, sum(u*v) AS uv, sum(u*y) AS uy, sum(v*y) AS vy FROM j GROUP BY 1)
  SELECT region, count(*) AS n, round(sum(value * value), 3) AS q FROM (SELECT region, r / nullif(stddev_pop(r) OVER w, 0) - avg(r) OVER w / nullif(stddev_pop(r) OVER w, 0) AS value
    FROM (SELECT j.region, y - coalesce((uy * vv - vy * uv) / nullif(uu * vv - uv * uv, 0) * u + (vy * uu - uy * uv) / nullif(uu * vv - uv * uv, 0) * v, 0) AS r FROM j JOIN s USING (region)) WINDOW w AS (PARTITION BY region)) GROUP BY 1""")
def regress_out(spark, sf):
    f = sample_fracs(spark, sf, "CGN").where("value IS NOT NULL")
    c = f.groupBy("sample").agg(F.avg("value").alias("u"), F.avg(F.col("value") * F.col("value")).alias("v"))
    return en.regressed(f, c, "region").groupBy("region").agg(F.count("*").alias("n"), F.round(F.sum(F.col("value") * F.col("value")), 3).alias("q"))


@query()
def gene_panel(spark, sf):
    """Greedy cover of all pairs, many genes a pass."""
    d = table(spark, sf, "dmg_table").where("names IS NOT NULL AND left_right IS NOT NULL")
    genes = en.greedy_panel(d.select(F.col("left_right").alias("pair"), F.col("names").alias("gene")))
    return spark.createDataFrame(list(enumerate(genes)), "round INT, gene STRING")

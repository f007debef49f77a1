"""Queries on cell by region matrices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats as st
from ..operators import matrix as mx
from ..session import small_table
from .base import CLUSTERS, COUNTS, REGIONS, SITES, SPELL, chrom_sizes, clusters, counts, regions, sites
from .site_queries import CGN, CHN

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_BINS = f"""bins AS (SELECT cell, chrom, b, t AS mc_type, sum(mc) AS mc, sum(cov) AS cov FROM (
  SELECT cell, chrom, (pos - 1) // 100000 AS b, 'CGN' AS t, mc, cov FROM sites WHERE context IN {CGN}
  UNION ALL SELECT cell, chrom, (pos - 1) // 100000, 'CHN', mc, cov FROM sites WHERE context IN {CHN}) GROUP BY ALL HAVING sum(cov) > 0)"""


def bins(spark, sf):
    return mx.count_bins(sites(spark, sf), chrom_sizes(spark, sf), 100_000, ["CGN", "CHN"])


@query(f"""WITH {SITES}, {_BINS} SELECT cell, bins.chrom, b * 100000 AS start, least((b + 1) * 100000, size) AS "end", mc_type, CAST(mc AS BIGINT) AS mc, CAST(cov AS BIGINT) AS cov FROM bins JOIN spell ON spelt = bins.chrom""")
def generate_dataset_bins(spark, sf):
    return bins(spark, sf)


@query(f"""WITH {SITES} SELECT cell, chrom, (pos - 1) // 100000 * 100000 AS start, strand AS strand_type, CAST(sum(mc) AS BIGINT) AS mc, CAST(sum(cov) AS BIGINT) AS cov
  FROM sites WHERE context IN {CGN} GROUP BY 1, 2, 3, 4 HAVING sum(cov) > 0""")
def generate_mcds_stranded(spark, sf):
    return mx.count_bins(sites(spark, sf), chrom_sizes(spark, sf), 100_000, ["CGN"], split_strand=True).select("cell", "chrom", "start", "strand_type", "mc", "cov")


_RC = f"""rc AS (SELECT s.cell, r.region, t.mc_type, CAST(sum(mc) AS BIGINT) AS mc, CAST(sum(cov) AS BIGINT) AS cov FROM sites s JOIN regions r ON s.chrom = r.chrom AND s.pos > r.start AND s.pos <= r."end"
  JOIN (SELECT 'CGN' AS mc_type, unnest({CGN.replace("(", "[").replace(")", "]")}) AS context UNION ALL
        SELECT 'CHN', unnest({CHN.replace("(", "[").replace(")", "]")})) t ON t.context = s.context GROUP BY 1, 2, 3)"""


def region_counts(spark, sf):
    return mx.count_regions(sites(spark, sf), regions(spark, sf), ["CGN", "CHN"])


@query(f"WITH {SITES}, {REGIONS}, {_RC} SELECT * FROM rc")
def generate_dataset_regions(spark, sf):
    return region_counts(spark, sf)


@query(f"""WITH {SITES}, {REGIONS}, {_RC} SELECT region, mc_type, CAST(coalesce(sum(mc), 0) AS BIGINT) AS mc, CAST(coalesce(sum(cov), 0) AS BIGINT) AS cov FROM
  (SELECT DISTINCT region FROM regions) CROSS JOIN (SELECT unnest(['CGN', 'CHN']) AS mc_type) LEFT JOIN rc USING (region, mc_type) GROUP BY 1, 2""")
def region_totals_with_zeros(spark, sf):
    types = small_table(spark, mc_type=["CGN", "CHN"])
    grid = regions(spark, sf).select("region").distinct().crossJoin(types)
    totals = region_counts(spark, sf).groupBy("region", "mc_type").agg(F.sum("mc").alias("mc"), F.sum("cov").alias("cov"))
    return grid.join(totals, ["region", "mc_type"], "left").fillna(0, ["mc", "cov"])


_PRIOR = """m AS (SELECT cell, mc_type, avg(CASE WHEN cov > 0 THEN mc / cov END) AS m, var_pop(CASE WHEN cov > 0 THEN mc / cov END) AS v FROM counts GROUP BY 1, 2),
  ab AS (SELECT cell, mc_type, a, a * (1 / nullif(m, 0) - 1) AS b FROM (SELECT *, (1 - m) * m * m / nullif(v, 0) - m AS a FROM m)),
  post AS (SELECT c.*, (c.mc + a) / nullif(c.cov + a + b, 0) AS raw, a / nullif(a + b, 0) AS pm FROM counts c JOIN ab USING (cell, mc_type))"""


@query(f"""WITH {COUNTS}, {_PRIOR} SELECT cell, region, mc_type, round(CASE WHEN raw / nullif(pm, 0) IS NOT NULL THEN least(raw / nullif(pm, 0), 10) END, 5) AS frac, round(raw, 5) AS post FROM post""")
def posterior_frac(spark, sf):
    c = counts(spark, sf)
    plain = mx.posterior_frac(c, normalize_per_cell=False).select("cell", "region", "mc_type", F.round("frac", 5).alias("post"))
    return mx.posterior_frac(c).select("cell", "region", "mc_type", F.round("frac", 5).alias("frac")).join(plain, ["cell", "region", "mc_type"])


@query(f"""WITH {COUNTS}, {_PRIOR} SELECT cell, region, mc_type, round(log2((raw + 0.01) / (1 - raw + 0.01)), 5) AS m_value, round(log2((mc + 0.1) / (cov - mc + 0.1)), 5) AS count_m_value FROM post WHERE raw BETWEEN 0 AND 1""")
def m_values(spark, sf):
    f = mx.posterior_frac(counts(spark, sf), normalize_per_cell=False).where("frac BETWEEN 0 AND 1")
    return mx.add_m_value(f).select("cell", "region", "mc_type", F.round("m_value", 5).alias("m_value"), F.round(st.count_m_value(F.col("mc"), F.col("cov")), 5).alias("count_m_value"))


@query(f"WITH {COUNTS} SELECT region, round(sum(cov) / (SELECT count(DISTINCT cell) FROM counts), 6) AS cov_mean FROM counts GROUP BY 1")
def feature_cov_mean(spark, sf):
    return mx.feature_cov_mean(counts(spark, sf)).withColumn("cov_mean", F.round("cov_mean", 6))


@query(f"""WITH {COUNTS}, cm AS (SELECT region, sum(cov) / (SELECT count(DISTINCT cell) FROM counts) AS c FROM counts GROUP BY 1)
  SELECT region, count(*) AS n FROM counts WHERE region IN (SELECT region FROM cm WHERE c > 0.5 AND c < 100) GROUP BY 1""")
def filter_feature_by_cov_mean(spark, sf):
    return mx.filter_feature_by_cov_mean(counts(spark, sf), 0.5, 100).groupBy("region").agg(F.count("*").alias("n"))


@query(f"""WITH {COUNTS}, a AS (SELECT * FROM counts WHERE mc_type = 'CGN' AND cov > 20), b AS (SELECT * FROM counts WHERE mc_type = 'CHN' AND mc > 100)
  SELECT region, 'a' AS side, count(*) AS n FROM a WHERE region IN (SELECT region FROM b) GROUP BY 1 UNION ALL SELECT region, 'b', count(*) FROM b WHERE region IN (SELECT region FROM a) GROUP BY 1""")
def common_features(spark, sf):
    from ..operators.embed import common_features as common

    c = counts(spark, sf)
    both = zip("ab", common(c.where("mc_type = 'CGN' AND cov > 20"), c.where("mc_type = 'CHN' AND mc > 100")))
    a, b = (d.groupBy("region").agg(F.count("*").alias("n")).withColumn("side", F.lit(k)) for k, d in both)
    return a.unionByName(b)


@query(f"WITH {COUNTS} SELECT region, CAST(sum(least(mc, 127)) AS BIGINT) AS mc, CAST(sum(least(cov, 127)) AS BIGINT) AS cov FROM counts GROUP BY 1")
def clipped_counts(spark, sf):
    return mx.clipped(counts(spark, sf), "int8").groupBy("region").agg(F.sum("mc").alias("mc"), F.sum("cov").alias("cov"))


@query(f"WITH {SPELL}, {REGIONS} SELECT region FROM regions WHERE chrom NOT IN ('chrX', 'chrY', 'chrM')")
def remove_chromosome(spark, sf):
    return mx.remove_chromosomes(regions(spark, sf), exclude=["chrX", "chrY", "chrM"]).select("region")


_FRACS = "fr AS (SELECT region, raw AS frac FROM post WHERE mc_type = 'CHN' AND raw IS NOT NULL)"
_HVF = f"""{_FRACS}, cm AS (SELECT region, sum(cov) / (SELECT count(DISTINCT cell) FROM counts) AS cov FROM counts GROUP BY 1),
  d AS (SELECT region, mean, ln(v / nullif(abs(mean), 0) + 1e-12) AS dispersion, cov FROM (SELECT region, avg(frac) AS mean, var_samp(frac) AS v FROM fr GROUP BY 1) JOIN cm USING (region)),
  f AS (SELECT *, floor(mean / 0.01) AS mb, floor(cov / 20) AS cb FROM d),
  b AS (SELECT mb, cb, count(*) AS n FROM f GROUP BY 1, 2),
  nb AS (SELECT * FROM (SELECT b.mb, b.cb, l.mb AS umb, l.cb AS ucb, row_number() OVER (PARTITION BY b.mb, b.cb ORDER BY abs(b.mb - l.mb) + abs(b.cb - l.cb), l.mb, l.cb) AS k
     FROM b, (SELECT * FROM b WHERE n > 5) l) WHERE k = 1),
  u AS (SELECT f.*, umb, ucb FROM f JOIN nb ON f.mb IS NOT DISTINCT FROM nb.mb AND f.cb IS NOT DISTINCT FROM nb.cb),
  s AS (SELECT umb, ucb, avg(dispersion) AS m, stddev_samp(dispersion) AS s FROM u GROUP BY 1, 2),
  z AS (SELECT region, mean, dispersion, cov, (dispersion - m) / nullif(s, 0) AS norm FROM u JOIN s USING (umb, ucb))"""


@query(f"""WITH {COUNTS}, {_PRIOR}, {_HVF} SELECT region, round(mean, 5) AS mean, round(dispersion, 5) AS dispersion, round(norm, 4) AS dispersion_norm,
  (mean > 0 AND mean < 5 AND coalesce(norm, 0) > 0.5) AS feature_select FROM z""")
def highly_variable_features(spark, sf):
    c = counts(spark, sf)
    fracs = mx.posterior_frac(c, normalize_per_cell=False).where("mc_type = 'CHN' AND frac IS NOT NULL")
    h = mx.highly_variable_features(fracs, mx.feature_cov_mean(c), mean_binsize=0.01, cov_binsize=20)
    return h.select("region", F.round("mean", 5).alias("mean"), F.round("dispersion", 5).alias("dispersion"), F.round("dispersion_norm", 4).alias("dispersion_norm"), "feature_select")


@query(f"""WITH {COUNTS}, {CLUSTERS} SELECT cluster, region, mc_type, CAST(sum(mc) AS BIGINT) AS mc, CAST(sum(cov) AS BIGINT) AS cov, round(sum(mc) / nullif(sum(cov), 0), 6) AS frac
  FROM counts JOIN clusters USING (cell) GROUP BY GROUPING SETS ((cluster, region, mc_type), (cluster, mc_type))""")
def merge_cluster(spark, sf):
    return mx.merge_cluster(counts(spark, sf), clusters(spark, sf)).withColumn("frac", F.round("frac", 6))


@query(f"""WITH {COUNTS}, g AS (SELECT cell, region, sum(mc) FILTER (mc_type = 'CHN') / nullif(sum(cov) FILTER (mc_type = 'CHN'), 0) AS g, sum(mc) FILTER (mc_type = 'CGN') / nullif(sum(cov) FILTER (mc_type = 'CGN'), 0) AS h FROM counts GROUP BY 1, 2),
  o AS (SELECT cell, (g - h) / nullif(1 - h, 0) AS o FROM (SELECT cell, sum(mc) FILTER (mc_type = 'CHN') / nullif(sum(cov) FILTER (mc_type = 'CHN'), 0) AS g, sum(mc) FILTER (mc_type = 'CGN') / nullif(sum(cov) FILTER (mc_type = 'CGN'), 0) AS h FROM counts GROUP BY 1))
  SELECT cell, region, round(CASE WHEN g IS NULL OR h IS NULL OR h = 1 THEN 0 ELSE greatest((g - h) / (1 - h), 0) END / nullif(o, 0), 5) AS rate FROM g JOIN o USING (cell)""")
def gch_rate(spark, sf):
    return mx.gch_rate(counts(spark, sf), "CHN", "CGN").withColumn("rate", F.round("rate", 5))


@query(f"""WITH {SITES}, {_BINS} SELECT cell, chrom, mc_type, w * 200000 AS start, CAST(sum(mc) AS BIGINT) AS mc, CAST(sum(cov) AS BIGINT) AS cov FROM
  (SELECT cell, chrom, mc_type, mc, cov, unnest(range(CAST(greatest(ceil((b - 9) / 2), 0) AS BIGINT), CAST(b // 2 + 1 AS BIGINT))) AS w FROM bins) GROUP BY 1, 2, 3, 4""")
def rebin_sliding(spark, sf):
    return mx.rebin(bins(spark, sf), 100_000, 10, 2)


@query(f"""WITH {COUNTS}, v AS (SELECT cell, region, CAST(cov AS DOUBLE) AS value FROM counts WHERE mc_type = 'CGN' AND cov > 0),
  r AS (SELECT cell, sum(value) AS r FROM v GROUP BY 1), c AS (SELECT region, sum(value) AS c FROM v GROUP BY 1)
  SELECT cell, region, round(ln(1 + value / r * 100000) * ln(1 + (SELECT count(DISTINCT cell) FROM v) / c), 5) AS tfidf FROM v JOIN r USING (cell) JOIN c USING (region)""")
def tf_idf(spark, sf):
    v = values(spark, sf).where("value > 0")
    return mx.tf_idf(v).select("cell", "region", F.round("tfidf", 5).alias("tfidf"))


def values(spark, sf):
    return counts(spark, sf).where("mc_type = 'CGN'").select("cell", "region", F.col("cov").cast("double").alias("value"))


_V = "v AS (SELECT cell, region, CAST(cov AS DOUBLE) AS value FROM counts WHERE mc_type = 'CGN')"


@query(f"WITH {COUNTS}, {_V} SELECT cell, region, round(value / ((sum(value) OVER (PARTITION BY cell) + 1) / 1e6), 4) AS cpm FROM v")
def cpm(spark, sf):
    return mx.cpm(values(spark, sf)).select("cell", "region", F.round("cpm", 4).alias("cpm"))


@query(f"WITH {COUNTS}, {_V} SELECT region, CAST(sum(CASE WHEN value > 30 THEN 1 ELSE 0 END) AS BIGINT) AS n FROM v GROUP BY 1")
def binarize_matrix(spark, sf):
    return mx.binarize(values(spark, sf), 30).groupBy("region").agg(F.sum("value").alias("n"))


@query(f"""WITH {COUNTS}, {_V}, n AS (SELECT region, count(*) FILTER (value > 0) AS nnz FROM v GROUP BY 1), s AS (SELECT avg(log2(nnz)) AS m, stddev_pop(log2(nnz)) AS s FROM n WHERE nnz > 0)
  SELECT region, nnz FROM n, s WHERE nnz > 200 * 0.5 / 100 AND abs((log2(nnz) - m) / nullif(s, 0)) < 1.5""")
def filter_regions(spark, sf):
    return mx.filter_regions(values(spark, sf), 200, 0.5, 1.5)


@query(f"""WITH {COUNTS}, {_V}, d AS (SELECT region, var_pop(value) / greatest(avg(value), 1e-10) AS d FROM v GROUP BY 1)
  SELECT region, round(d, 6) AS dispersion FROM d QUALIFY row_number() OVER (ORDER BY d DESC, region) <= (SELECT count(*) FROM d) // 2""")
def filter_by_dispersion(spark, sf):
    return mx.filter_by_dispersion(values(spark, sf)).withColumn("dispersion", F.round("dispersion", 6))


@query(f"""WITH {COUNTS}, {_V}, s AS (SELECT region, stddev_pop(ln(value)) AS s FROM v WHERE value > 0 GROUP BY 1)
  SELECT cell, region, round(greatest(least(ln(value) / CASE WHEN s = 0 THEN 1.0 ELSE s END, 10), -10), 5) AS scaled FROM v JOIN s USING (region) WHERE value > 0""")
def log_scale(spark, sf):
    return mx.log_scale(values(spark, sf).where("value > 0")).select("cell", "region", F.round("scaled", 5).alias("scaled"))


@query(f"""WITH {COUNTS}, {_V}, q AS (SELECT quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.9) AS hi FROM v)
  SELECT cell, region, round(greatest(least((value - lo) / nullif(hi - lo, 0), 1), 0), 6) AS scaled FROM v, q""")
def min_max(spark, sf):
    return mx.min_max(values(spark, sf)).select("cell", "region", F.round("scaled", 6).alias("scaled"))


@query(f"""WITH {COUNTS}, {_V}, {CLUSTERS} SELECT cluster AS pseudo, region, round(avg(value), 6) AS mean, median(value) AS median, sum(value) AS total FROM v JOIN clusters USING (cell) GROUP BY 1, 2""")
def pseudo_cells(spark, sf):
    v, g = values(spark, sf), clusters(spark, sf).withColumnRenamed("cluster", "pseudo")
    out = {k: mx.pseudo_bulk(v, g, k).withColumnRenamed("value", n) for k, n in (("mean", "mean"), ("median", "median"), ("sum", "total"))}
    return out["mean"].withColumn("mean", F.round("mean", 6)).join(out["median"], ["pseudo", "region"]).join(out["sum"], ["pseudo", "region"])


_TAIL = """, p AS (SELECT cell, mc_type, sum(mc) / (sum(cov) + 1e-6) AS p FROM counts GROUP BY 1, 2),
  k AS (SELECT cell, region, mc_type, mc, cov, p, unnest(range(mc + 1, cov + 1)) AS k FROM counts JOIN p USING (cell, mc_type) WHERE cov > 0 AND p > 0 AND p < 1),
  t AS (SELECT cell, region, mc_type, sum(exp(lgamma(cov + 1) - lgamma(k + 1) - lgamma(cov - k + 1) + k * ln(p) + (cov - k) * ln(1 - p))) AS t FROM k GROUP BY ALL),
  s AS (SELECT c.cell, c.region, c.mc_type, CASE WHEN mc >= cov THEN 0 ELSE coalesce(t, 0) END AS t FROM counts c LEFT JOIN t USING (cell, region, mc_type) WHERE cov > 0)"""


@query(f"WITH {COUNTS}{_TAIL} SELECT cell, region, mc_type, round(t, 6) AS score FROM s WHERE t >= 0.9")
def hypo_scores(spark, sf):
    return mx.scores(counts(spark, sf)).select("cell", "region", "mc_type", F.round("score", 6).alias("score"))


@query(f"WITH {COUNTS}{_TAIL} SELECT cell, region, mc_type, round(1 - t, 6) AS score FROM s WHERE 1 - t >= 0.9")
def hyper_scores(spark, sf):
    return mx.scores(counts(spark, sf), "hyper").select("cell", "region", "mc_type", F.round("score", 6).alias("score"))

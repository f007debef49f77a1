"""Queries on regions, their annotation and differential sites."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diff as df_
from ..operators import rangejoin as rj
from ..operators import sites as so
from ..schema import few_values
from .base import CLUSTERS, REGIONS, SITES, SPELL, chrom_sizes, clusters, regions, sites, table
from .site_queries import CGN

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_R = f"WITH {SPELL}, {REGIONS}"


def places(spark, sf):
    return regions(spark, sf).select("region", "chrom", "start", "end")


@query(f"""{_R} SELECT a.region AS region_a, b.region AS region_b, least(a."end", b."end") - greatest(a.start, b.start) AS overlap
  FROM regions a JOIN regions b ON a.chrom = b.chrom AND a.start < b."end" AND b.start < a."end" AND a.region < b.region""")
def region_overlaps(spark, sf):
    """All regions against all."""
    r = places(spark, sf)
    return rj.overlaps(r, r, "region", "region").where("region_a < region_b").select("region_a", "region_b", "overlap")


@query(f"""{_R} SELECT DISTINCT a.region, b.sample AS track FROM regions a JOIN regions b ON a.chrom = b.chrom AND a.start < b."end" AND b.start < a."end"
  AND least(a."end", b."end") - greatest(a.start, b.start) >= 0.2 * (a."end" - a.start)""")
def annotate_by_beds(spark, sf):
    """Every region by every sample's regions as a track."""
    r = regions(spark, sf)
    return rj.annotate_by_beds(places(spark, sf), r.select(F.col("sample").alias("track"), "chrom", "start", "end"))


@query(f"""{_R}, b AS (SELECT * FROM regions WHERE sample = (SELECT min(sample) FROM bed)) SELECT region FROM regions a WHERE sample IS DISTINCT FROM (SELECT min(sample) FROM bed)
  AND NOT EXISTS (SELECT 1 FROM b WHERE a.chrom = b.chrom AND a.start < b."end" AND b.start < a."end" AND least(a."end", b."end") - greatest(a.start, b.start) >= 0.2 * (a."end" - a.start))""")
def remove_black_list(spark, sf):
    """The regions of the first sample are the blacklist of all others."""
    r = regions(spark, sf)
    first = F.col("sample").eqNullSafe(F.lit(table(spark, sf, "bed").agg(F.min("sample")).first()[0]))
    return rj.without_blacklist(r.where(~first).select("region", "chrom", "start", "end"), r.where(first).select("chrom", "start", "end")).select("region")


@query(f"""WITH {SITES}, {REGIONS}, t AS (SELECT chrom, pos - 1 AS start, pos + 99 AS "end", sum(cov) AS value FROM sites GROUP BY 1, 2, 3)
  SELECT region, round(sum(value * (least(r."end", t."end") - greatest(r.start, t.start))) / sum(least(r."end", t."end") - greatest(r.start, t.start)), 6) AS mean, max(value)::DOUBLE AS most
  FROM regions r JOIN t ON r.chrom = t.chrom AND r.start < t."end" AND t.start < r."end" GROUP BY 1""")
def annotate_by_tracks(spark, sf):
    t = sites(spark, sf).groupBy("chrom", (F.col("pos") - 1).alias("start"), (F.col("pos") + 99).alias("end")).agg(F.sum("cov").cast("double").alias("value")).withColumn("track", F.lit("cov"))
    r = regions(spark, sf).select("region", "chrom", "start", "end")
    mean = rj.annotate_by_tracks(r, t).select("region", F.round("value", 6).alias("mean"))
    return mean.join(rj.annotate_by_tracks(r, t, kind="max").select("region", F.col("value").alias("most")), "region")


@query(f"""WITH {SPELL}, {REGIONS} SELECT region, greatest(start - 500, 0) AS start, least("end" + 500, size) AS "end" FROM regions JOIN spell ON spelt = chrom""")
def slop_regions(spark, sf):
    return rj.slopped(regions(spark, sf), chrom_sizes(spark, sf), 500).select("region", "start", "end")


@query(f"""WITH {SPELL}, {REGIONS} SELECT region, greatest(m - 250, 0) AS start, least(m + 250, size) AS "end" FROM (SELECT *, start + ("end" - start) // 2 AS m FROM regions) JOIN spell ON spelt = chrom""")
def centre_regions(spark, sf):
    return rj.centred(regions(spark, sf), chrom_sizes(spark, sf), 500).select("region", "start", "end")


@query("""SELECT chrom, start, least(start + 1000000, size) AS "end" FROM (SELECT chrom, size, unnest(range(0, size, 500000)) AS start FROM chrom_sizes)""")
def genome_windows(spark, sf):
    return rj.windows(chrom_sizes(spark, sf), 1_000_000, 500_000)


@query(f"""{_R} SELECT chrom, start, "end" FROM (SELECT chrom, start, lead(start) OVER (PARTITION BY chrom ORDER BY start) AS "end" FROM (SELECT DISTINCT chrom, start FROM regions)) WHERE "end" IS NOT NULL""")
def chunk_intervals(spark, sf):
    return rj.chunk_intervals(regions(spark, sf).select("chrom", F.col("start").alias("pos")).distinct())


@query(f"""{_R} SELECT chrom, round(lo - (hi - lo) * 0.1::DOUBLE, 6) AS low, round(hi + (hi - lo) * 0.1::DOUBLE, 6) AS high FROM (SELECT chrom, min(start) AS lo, max("end") AS hi FROM regions GROUP BY 1)""")
def zoomed_ranges(spark, sf):
    from ..functions.sequence import zoomed_range

    r = regions(spark, sf).groupBy("chrom").agg(F.min("start").alias("lo"), F.max("end").alias("hi"))
    low, high = zoomed_range(F.col("lo"), F.col("hi"), 1.2)
    return r.select("chrom", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("""SELECT chrom, CAST(coalesce(sum(size // 100000 + 1) OVER (ORDER BY chrom_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM chrom_sizes""")
def genome_bin_ids(spark, sf):
    return rj.genome_bin_ids(chrom_sizes(spark, sf), 100_000)


@query(f"""{_R} SELECT a.region AS region_a, b.region AS region_b, b.start - a.start AS dist FROM regions a JOIN regions b ON a.chrom = b.chrom AND abs(a.start - b.start) < 50000 AND a.region < b.region""")
def near_pairs(spark, sf):
    a, b = (regions(spark, sf).select(F.col("region").alias(f"region_{n}"), "chrom", F.col("start").alias("pos")) for n in "ab")
    return rj.near_pairs(a, b, "region_a", "region_b", 50_000).where("region_a < region_b")


@query(f"""WITH {SPELL}, {REGIONS}, m AS (SELECT *, max("end") OVER (PARTITION BY chrom ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM regions),
  i AS (SELECT *, sum(CASE WHEN top IS NULL OR start > top THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM m)
  SELECT chrom, min(start) AS start, max("end") AS "end", string_agg(region, ',' ORDER BY region) AS ids FROM i GROUP BY chrom, island""")
def merge_regions(spark, sf):
    return rj.merged_with_ids(regions(spark, sf))


@query(f"WITH {SPELL}, {REGIONS} SELECT chrom, sample, count(*) AS n, CAST(sum(\"end\" - start) AS BIGINT) AS bases FROM regions GROUP BY GROUPING SETS ((chrom), (sample))")
def region_rollup(spark, sf):
    return regions(spark, sf).groupingSets([["chrom"], ["sample"]], "chrom", "sample").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("bases"))


_DS = f"""{SITES}, {CLUSTERS}, ds AS (SELECT chrom, CASE WHEN strand = '-' THEN pos - 1 ELSE pos END AS pos, cluster AS sample, CAST(sum(mc) AS BIGINT) AS mc, CAST(sum(cov) AS BIGINT) AS cov
  FROM sites JOIN clusters USING (cell) WHERE context IN {CGN} GROUP BY 1, 2, 3)"""


def samples(spark, sf):
    """Pseudo-bulk samples: the CpG sites of the base-level table, strands added up, clusters as samples."""
    s = so.merge_strands(so.select_contexts(sites(spark, sf), ["CGN"]).join(clusters(spark, sf), "cell"), ["cluster"])
    return s.select("chrom", "pos", F.col("cluster").alias("sample"), "mc", "cov")


@query(f"""WITH {_DS}, t AS (SELECT *, sum(mc) OVER w AS c, sum(cov) OVER w AS a FROM ds WINDOW w AS (PARTITION BY chrom, pos)), e AS (SELECT *, cov * c / nullif(a, 0) AS e FROM t)
  SELECT chrom, pos, sample, round(CASE WHEN e > 0 AND cov < a AND c < a THEN (mc - e) / sqrt(e * (1 - cov / a) * (1 - c / a)) END, 5) AS residual FROM e""")
def site_residuals(spark, sf):
    return df_.residuals(samples(spark, sf)).where("cov >= 0").select("chrom", "pos", "sample", F.round("residual", 5).alias("residual"))


@query(f"""WITH {_DS}, t AS (SELECT *, sum(mc) OVER w AS c, sum(cov) OVER w AS a, count(*) OVER w AS n FROM ds WINDOW w AS (PARTITION BY chrom, pos))
  SELECT chrom, pos, n, CAST(a AS BIGINT) AS m, round(sqrt(sum((mc - cov * c / nullif(a, 0)) * (mc - cov * c / nullif(a, 0)) * 2) / 2 / n), 6) AS s FROM t GROUP BY chrom, pos, n, a""")
def rms_statistic(spark, sf):
    return df_.goodness_of_fit(samples(spark, sf)).withColumn("s", F.round("s", 6))


@query(f"""WITH {_DS}, t AS (SELECT *, cov - mc AS uc, count(*) OVER (PARTITION BY chrom, pos) AS n FROM ds), k AS (SELECT *, greatest(10, least(3000 / n, 50)) AS k FROM t)
  SELECT chrom, pos, sample, CAST(CASE WHEN cov > k THEN floor(k * (mc / cov)) ELSE mc END AS BIGINT) AS mc, CAST(CASE WHEN cov > k THEN floor(k * (uc / cov)) ELSE uc END AS BIGINT) AS uc FROM k""")
def downsample_table(spark, sf):
    from pyspark.sql import Window

    s = samples(spark, sf).withColumn("n", F.count("*").over(Window.partitionBy("chrom", "pos")))
    mc, uc = df_.downsampled(F.col("mc"), F.col("cov") - F.col("mc"), F.col("n"))
    return s.select("chrom", "pos", "sample", mc.alias("mc"), uc.alias("uc"))


def sample_names(spark, sf):
    return few_values(clusters(spark, sf), "cluster")


@query()
def call_dms(spark, sf):
    """Permutation p-values; SQL cannot draw them, tests hold them against a brute-force version."""
    d = df_.call_dms(samples(spark, sf), sample_names(spark, sf), n_permute=1000, p_cutoff=0.05)
    return d.select("chrom", "pos", F.round("p_value", 9).alias("p_value"), F.round("q_value", 9).alias("q_value"))


@query()
def call_dmr_significant(spark, sf):
    """Regions of the sites that pass the test; what follows the test is held by ``call_dmr``, the test by tests."""
    names = sample_names(spark, sf)
    d = df_.call_dmr(df_.call_dms(samples(spark, sf), names, n_permute=1000, p_cutoff=None), names, p_cutoff=0.05)
    return d.select("dmr", "start", "end", "ndms", "sample", "mc", "cov", "state")


_DMR = f"""{_DS}, names AS (SELECT DISTINCT cluster AS sample FROM clusters), full_ AS (SELECT chrom, pos, sample, coalesce(mc, 0) AS mc, coalesce(cov, 0) AS cov FROM (SELECT DISTINCT chrom, pos FROM ds) CROSS JOIN names LEFT JOIN ds USING (chrom, pos, sample)),
  r AS (SELECT *, CASE WHEN e > 0 AND cov < a AND c < a AND cov IS NOT NULL THEN (mc - e) / sqrt(e * (1 - cov / a) * (1 - c / a)) END AS residual FROM
    (SELECT f.*, cov * c / a AS e, c, a FROM full_ f JOIN (SELECT chrom, pos, sum(mc) AS c, sum(cov) AS a FROM ds GROUP BY 1, 2) USING (chrom, pos) WHERE a > 0)),
  p AS (SELECT chrom, pos, list(CASE WHEN cov > 0 THEN mc / cov END ORDER BY sample) AS frac, max(CASE WHEN cov > 0 THEN mc / cov END) - min(CASE WHEN cov > 0 THEN mc / cov END) AS delta FROM r GROUP BY 1, 2),
  u AS (SELECT *, list_transform(frac, lambda x: coalesce(x, 1.0)) AS f1 FROM p WHERE delta >= 0.2),
  l AS (SELECT *, lag(pos) OVER w AS pp, lag(f1) OVER w AS pf FROM u WINDOW w AS (PARTITION BY chrom ORDER BY pos)),
  c AS (SELECT chrom, pos, pp, any_value(d) AS d, corr(x, y) AS corr FROM (SELECT chrom, pos, pp, pos - pp AS d, unnest(f1) AS x, unnest(pf) AS y FROM l WHERE pp IS NOT NULL) GROUP BY 1, 2, 3),
  k AS (SELECT l.chrom, l.pos, CASE WHEN l.pp IS NULL OR c.d >= 250 OR c.corr IS NULL OR isnan(c.corr) OR NOT (c.corr > 0.3) THEN 1 ELSE 0 END AS new FROM l LEFT JOIN c USING (chrom, pos)),
  i AS (SELECT chrom, pos, sum(new) OVER (PARTITION BY chrom ORDER BY pos) - 1 AS island FROM k)"""


@query(f"""WITH {_DMR}, rr AS (SELECT r.chrom, r.pos, r.sample, r.mc, r.cov, CASE WHEN ds.cov IS NOT NULL THEN residual END AS residual, island FROM r JOIN i USING (chrom, pos) LEFT JOIN ds USING (chrom, pos, sample)),
  q AS (SELECT chrom, quantile_cont(residual, 0.4) AS q0, quantile_cont(residual, 0.6) AS q1 FROM rr WHERE residual IS NOT NULL GROUP BY 1),
  s AS (SELECT rr.*, CASE WHEN residual < q0 THEN -1 WHEN residual > q1 THEN 1 ELSE 0 END AS st FROM rr JOIN q USING (chrom))
  SELECT chrom || '-' || CAST(island AS BIGINT) AS dmr, min(pos) - 1 AS start, max(pos) + 1 AS "end", count(*) AS ndms, sample, CAST(sum(mc) AS BIGINT) AS mc, CAST(sum(cov) AS BIGINT) AS cov,
    CAST(CASE WHEN abs(avg(st)) >= 0.8 THEN sign(avg(st)) ELSE 0 END AS TINYINT) AS state FROM s GROUP BY chrom, island, sample""")
def call_dmr(spark, sf):
    """With every tested site let in, since SQL has no p-values; all other settings are the operator's own."""
    names = sample_names(spark, sf)
    d = df_.call_dmr(df_.call_dms(samples(spark, sf), names, n_permute=200, p_cutoff=None), names, p_cutoff=1.0)
    return d.select("dmr", "start", "end", "ndms", "sample", "mc", "cov", "state")


def states(spark, sf):
    return df_.residuals(samples(spark, sf)).select(F.concat_ws("-", "chrom", F.col("pos").cast("string")).alias("dmr"), "sample", F.when(F.col("residual") < -1, -1).when(F.col("residual") > 1, 1).otherwise(0).alias("state"))


_ST = f"""{_DS}, st AS (SELECT chrom || '-' || pos AS dmr, sample, CASE WHEN residual < -1 THEN -1 WHEN residual > 1 THEN 1 ELSE 0 END AS state FROM
  (SELECT *, CASE WHEN e > 0 AND cov < a AND c < a THEN (mc - e) / sqrt(e * (1 - cov / a) * (1 - c / a)) END AS residual FROM
   (SELECT *, cov * c / nullif(a, 0) AS e FROM (SELECT *, sum(mc) OVER w AS c, sum(cov) OVER w AS a FROM ds WINDOW w AS (PARTITION BY chrom, pos)))))"""


@query(f"""WITH {_ST} SELECT dmr, split_part(sample, '-', 1) AS sample, CAST(CASE WHEN min(state) = max(state) THEN min(state) ELSE 0 END AS TINYINT) AS state FROM st GROUP BY 1, 2""")
def collapse_replicates(spark, sf):
    s = states(spark, sf)
    groups = s.select("sample").distinct().withColumn("group", F.split("sample", "-")[0])
    return df_.collapse_replicates(s, groups)


@query(f"""WITH {_ST}, a AS (SELECT dmr FROM st WHERE sample = 'exc-upper' AND state = -1), b AS (SELECT dmr FROM st WHERE sample = 'inh-vip' AND state = -1)
  SELECT dmr, 'a_and_b' AS "where" FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT dmr, 'a_not_b' FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT dmr, 'b_not_a' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def pairwise_differential(spark, sf):
    return df_.pairwise_differential(states(spark, sf), "exc-upper", "inh-vip")


@query(f"""WITH {_DS}, m AS (SELECT *, log2((mc + 0.1) / (cov - mc + 0.1)) AS m FROM ds)
  SELECT chrom, pos, sample, round((m - avg(m) OVER w) / nullif(stddev_pop(m) OVER w, 0), 4) AS m_scaled FROM m WINDOW w AS (PARTITION BY chrom, pos)""")
def scaled_m_values(spark, sf):
    return df_.scaled_m_values(samples(spark, sf)).select("chrom", "pos", "sample", F.round("m_scaled", 4).alias("m_scaled"))

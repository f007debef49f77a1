"""Queries on base-level tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequence as sq
from ..functions import stats as st
from ..operators import rangejoin as rj
from ..operators import sites as so
from .base import REGIONS, SITES, SPELL, chrom_sizes, regions, sites, table

CGN = "('CGA','CGC','CGG','CGT','CGN')"
CHN = "('CAA','CAC','CAG','CAT','CAN','CCA','CCC','CCG','CCT','CCN','CTA','CTC','CTG','CTT','CTN')"
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {SITES} SELECT chrom, count(*) AS n FROM sites GROUP BY 1")
def allc_chroms(spark, sf):
    return sites(spark, sf).groupBy("chrom").agg(F.count("*").alias("n"))


@query(f"""WITH {SPELL}, c AS (SELECT size, pos, written_at FROM allc LEFT JOIN chrom_sizes USING (chrom) LEFT JOIN allc_table USING (file_uid) WHERE pos IS NOT NULL)
  SELECT bool_and(size IS NOT NULL) AS known, bool_and(pos BETWEEN 1 AND size) AS within, coalesce(bool_and(written_at >= TIMESTAMP '2024-01-01'), true) AS fresh FROM c""")
def check_chroms(spark, sf):
    """Whether the table as delivered names only known chromosomes, in their spelling."""
    a = table(spark, sf, "allc").where("pos IS NOT NULL").join(table(spark, sf, "allc_table").select("file_uid", "written_at"), "file_uid", "left")
    return so.check_chroms(a.withColumn("since", F.lit("2024-01-01").cast("timestamp")), chrom_sizes(spark, sf), "since", "written_at")


@query(f"WITH {SITES} SELECT cell, pos, mc, cov FROM sites WHERE chrom = 'chr1' AND pos > 10000000 AND pos <= 60000000")
def fetch_region(spark, sf):
    return so.fetch(sites(spark, sf), "chr1", 10_000_000, 60_000_000).select("cell", "pos", "mc", "cov")


@query(f"WITH {SITES} SELECT s.cell, s.chrom, s.pos, s.mc, s.cov FROM sites s WHERE EXISTS (SELECT 1 FROM sites t WHERE t.chrom = s.chrom AND t.pos = s.pos AND t.cell = 'bulk-000-pool')")
def fetch_positions(spark, sf):
    s = sites(spark, sf)
    return so.fetch_positions(s, s.where("cell = 'bulk-000-pool'")).select("cell", "chrom", "pos", "mc", "cov")


@query(f"""WITH {SITES} SELECT pattern, cell, chrom, pos, mc, cov FROM (
  SELECT 'CGN' AS pattern, * FROM sites WHERE context IN {CGN} UNION ALL SELECT 'CHN' AS pattern, * FROM sites WHERE context IN {CHN}) WHERE cov <= 50""")
def extract_both(spark, sf):
    return so.extract_contexts(sites(spark, sf), ["CGN", "CHN"], cov_cutoff=50).select("pattern", "cell", "chrom", "pos", "mc", "cov")


@query(f"WITH {SITES} SELECT strand AS strand_type, count(*) AS n, CAST(sum(mc) AS BIGINT) AS mc, CAST(sum(cov) AS BIGINT) AS cov FROM sites WHERE context IN {CGN} AND cov <= 9999 GROUP BY 1")
def extract_split(spark, sf):
    e = so.extract_contexts(sites(spark, sf), ["CGN"], "split")
    return e.groupBy("strand_type").agg(F.count("*").alias("n"), F.sum("mc").alias("mc"), F.sum("cov").alias("cov"))


@query(f"""WITH {SITES} SELECT cell, chrom, CASE WHEN strand = '-' THEN pos - 1 ELSE pos END AS pos, CAST(sum(mc) AS BIGINT) AS mc, CAST(sum(cov) AS BIGINT) AS cov
  FROM sites WHERE context IN {CGN} AND cov <= 9999 GROUP BY 1, 2, 3""")
def extract_merge_strands(spark, sf):
    return so.extract_contexts(sites(spark, sf), ["CGN"], "merge").select("cell", "chrom", "pos", "mc", "cov")


@query(f"""WITH {SITES} SELECT cell, CAST(sum(CASE WHEN mc = cov AND mc > 0 THEN 1 ELSE 0 END) AS BIGINT) AS mc, CAST(sum(CASE WHEN mc = 0 OR mc = cov THEN 1 ELSE 0 END) AS BIGINT) AS cov
  FROM sites WHERE context IN {CGN} AND cov <= 9999 AND (mc = 0 OR mc = cov) GROUP BY 1""")
def extract_binarized(spark, sf):
    return so.extract_contexts(sites(spark, sf), ["CGN"], binarize=True).groupBy("cell").agg(F.sum("mc").alias("mc"), F.sum("cov").alias("cov"))


@query(f"""WITH {SITES} SELECT chrom, start, "end" FROM (SELECT chrom, pos - 1 AS start, pos AS "end", sum(cov) AS c FROM sites WHERE context IN {CGN} GROUP BY ALL)""")
def extract_bed5(spark, sf):
    m = so.merge_sites(so.select_contexts(sites(spark, sf), ["CGN"]))
    return m.select("chrom", (F.col("pos") - 1).alias("start"), F.col("pos").alias("end"))


@query(f"""WITH {SITES} SELECT chrom, pos, min(strand) AS strand, min(context) AS context, CAST(sum(mc) AS BIGINT) AS mc, CAST(sum(cov) AS BIGINT) AS cov FROM sites GROUP BY 1, 2""")
def merge_allc(spark, sf):
    return so.merge_sites(sites(spark, sf))


@query(f"""WITH {SITES} SELECT chrom, pos, CAST(sum(mc) AS BIGINT) AS mc, [CAST(sum(mc) AS BIGINT), CAST(sum(cov - mc) AS BIGINT), CAST(sum(cov) AS BIGINT)] AS snp_match FROM sites GROUP BY 1, 2""")
def merge_allc_snp(spark, sf):
    s = sites(spark, sf).withColumns({"snp_match": F.array("mc", F.col("cov") - F.col("mc"), "cov"), "snp_mismatch": F.array(*[F.lit(0).cast("long")] * 3)})
    return so.merge_snp_sites(s).select("chrom", "pos", "mc", "snp_match")


@query(f"""WITH {SITES}, g AS (SELECT context, sum(mc) AS mc, sum(cov) AS cov, count(*) AS n, avg(cov) AS cm, stddev_pop(cov) AS cs,
    avg(CASE WHEN cov > 0 THEN mc / cov END) AS m, var_pop(CASE WHEN cov > 0 THEN mc / cov END) AS v FROM sites WHERE context NOT LIKE '%N%' GROUP BY 1),
  b AS (SELECT *, (1 - m) * m * m / nullif(v, 0) - m AS a FROM g)
  SELECT context, CAST(mc AS BIGINT) AS mc, CAST(cov AS BIGINT) AS cov, n AS n_base, round(cm, 6) AS base_cov_mean, round(cs, 6) AS base_cov_std, round(m, 6) AS base_beta_mean,
    round(v, 6) AS base_beta_var, round(mc / cov, 6) AS mc_rate, round(a, 5) AS base_beta_a, round(a * (1 / m - 1), 5) AS base_beta_b FROM b""")
def profile_allc(spark, sf):
    p = so.profile(sites(spark, sf))
    digits = {"base_cov_mean": 6, "base_cov_std": 6, "base_beta_mean": 6, "base_beta_var": 6, "mc_rate": 6, "base_beta_a": 5, "base_beta_b": 5}
    return p.withColumns({c: F.round(c, d) for c, d in digits.items()})


@query(f"""WITH {SPELL} SELECT chrom, count(*) AS n FROM (SELECT CASE WHEN starts_with(chrom, 'chr') THEN chrom ELSE 'chr' || chrom END AS chrom FROM allc WHERE pos IS NOT NULL)
  WHERE chrom IN (SELECT chrom FROM chrom_sizes) GROUP BY 1""")
def standardize_allc(spark, sf):
    return so.standardize(table(spark, sf, "allc").select("chrom", "pos"), chrom_sizes(spark, sf)).groupBy("chrom").agg(F.count("*").alias("n"))


@query(f"""WITH {SITES} SELECT pattern, chrom, b * 10000 AS start, least((b + 1) * 10000, size) AS "end", round(sum(mc) / sum(cov), 6) AS frac, CAST(sum(cov) AS BIGINT) AS cov FROM
  (SELECT 'CGN' AS pattern, sites.chrom, (pos - 1) // 10000 AS b, mc, cov, size FROM sites JOIN spell ON spelt = sites.chrom WHERE context IN {CGN}
   UNION ALL SELECT 'CHN', sites.chrom, (pos - 1) // 10000, mc, cov, size FROM sites JOIN spell ON spelt = sites.chrom WHERE context IN {CHN}) GROUP BY pattern, chrom, b, size HAVING sum(cov) > 0""")
def allc_to_tracks(spark, sf):
    return so.binned_tracks(sites(spark, sf), chrom_sizes(spark, sf), 10_000, ["CGN", "CHN"]).withColumn("frac", F.round("frac", 6))


@query(f"""WITH {SITES} SELECT strand, chrom, b * 100000 AS start, CAST(sum(cov) AS BIGINT) AS cov FROM (SELECT strand, chrom, (pos - 1) // 100000 AS b, cov FROM sites WHERE context IN {CGN}) GROUP BY strand, chrom, b HAVING sum(cov) > 0""")
def allc_to_stranded_tracks(spark, sf):
    return so.binned_tracks(sites(spark, sf), chrom_sizes(spark, sf), 100_000, ["CGN"], stranded=True).select("strand", "chrom", "start", "cov")


@query(f"""WITH {SITES}, t AS (SELECT *, mc / cov AS f, cov - mc AS uc FROM sites WHERE cov > 0)
  SELECT CAST(sum(cov) AS BIGINT) AS a, CAST(sum(mc + uc) AS BIGINT) AS b, CAST(sum(cov - uc) AS BIGINT) AS c, CAST(sum(round_even(f * cov, 0)) AS BIGINT) AS d,
    CAST(sum(CASE WHEN f > 0 THEN round_even(mc / f, 0) END) AS BIGINT) AS e, CAST(sum(round_even(f * 20, 0)) AS BIGINT) AS g, CAST(sum(CASE WHEN f < 1 THEN round_even(uc / (1 - f), 0) - uc END) AS BIGINT) AS h FROM t""")
def table_to_allc(spark, sf):
    t = sites(spark, sf).where("cov > 0").withColumns({"f": F.col("mc") / F.col("cov"), "uc": F.col("cov") - F.col("mc")})
    c = F.col
    s = lambda x, n: F.sum(x).alias(n)
    return t.agg(
        s(so.counts_from("mc+cov", mc=c("mc"), cov=c("cov"))[1], "a"),
        s(so.counts_from("mc+uc", mc=c("mc"), uc=c("uc"))[1], "b"),
        s(so.counts_from("uc+cov", uc=c("uc"), cov=c("cov"))[0], "c"),
        s(so.counts_from("mc_frac+cov", mc_frac=c("f"), cov=c("cov"))[0], "d"),
        s(so.counts_from("mc_frac+mc", mc_frac=c("f"), mc=c("mc"))[1], "e"),
        s(so.counts_from("mc_frac+pseudo_count", mc_frac=c("f"), pseudo_count=F.lit(20))[0], "g"),
        s(so.counts_from("mc_frac+uc", mc_frac=c("f"), uc=c("uc"))[0], "h"),
    )


@query(f"WITH {SITES} SELECT cell, chrom, pos, CASE WHEN cov > 20 THEN greatest(0, CAST(floor(mc / (cov / 20.0::DOUBLE) - 1) AS BIGINT)) ELSE mc END AS mc, CASE WHEN cov > 20 THEN CAST(floor(cov / (cov / 20.0::DOUBLE) - 1) AS BIGINT) ELSE cov END AS cov FROM sites")
def clip_large_cov(spark, sf):
    mc, cov = st.clip_ratio(F.col("mc"), F.col("cov"), 20)
    return sites(spark, sf).select("cell", "chrom", "pos", mc.alias("mc"), cov.alias("cov"))


@query(f"""WITH {SITES}, {REGIONS} SELECT DISTINCT s.cell, s.chrom, s.pos, s.context, s.strand, s.mc, s.cov FROM sites s JOIN regions r ON s.chrom = r.chrom AND s.pos > r.start AND s.pos <= r."end" """)
def fetch_regions(spark, sf):
    return rj.fetch_regions(sites(spark, sf), regions(spark, sf)).select("cell", "chrom", "pos", "context", "strand", "mc", "cov").distinct()


@query("""SELECT doc_id, translate(array_to_string(list_reverse(string_split(text, '')), ''), 'ACGTacgtNn', 'TGCAtgcaNn') AS rc FROM documents WHERE text IS NOT NULL""")
def reverse_complement(spark, sf):
    """Every text, whatever its letters: what is no base stays. Code points are reversed, as in SQL's split."""
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", sq.reverse_complement(F.col("text")).alias("rc"))


@query(f"""WITH {SITES} SELECT context, regexp_matches(context, '^C[ACT][ATCGN]$') AS ch, regexp_matches(context, '^[AT]C[GC]$') AS wcs FROM (SELECT DISTINCT context FROM sites)""")
def iupac_match(spark, sf):
    return sites(spark, sf).select("context").distinct().select("context", F.col("context").rlike(sq.pattern_regex("CHN")).alias("ch"), F.col("context").rlike(sq.pattern_regex("WCS")).alias("wcs"))


@query("""WITH code(c, b) AS (VALUES ('A','A'),('C','C'),('G','G'),('T','T'),('R','AG'),('Y','CT'),('S','GC'),('W','AT'),('K','GT'),('M','AC'),('B','CGT'),('D','AGT'),('H','ATC'),('V','ACG'),('N','ATCGN')),
  base AS (SELECT c, unnest(string_split(b, '')) AS b FROM code), p(pattern) AS (VALUES ('CGN'),('CY'),('CHN'),('CNN'),('CH'),('HCHN'))
  SELECT pattern, x.b || y.b || coalesce(z.b, '') || coalesce(u.b, '') AS context FROM p JOIN base x ON x.c = pattern[1] JOIN base y ON y.c = pattern[2]
    LEFT JOIN base z ON z.c = pattern[3] LEFT JOIN base u ON u.c = pattern[4] UNION ALL SELECT 'CH', 'CH'""")
def parse_mc_pattern(spark, sf):
    return sq.pattern_table(spark, ["CGN", "CY", "CHN", "CNN", "CH", "HCHN"])


@query("""SELECT size, CASE WHEN size >= 1000000 AND size % 1000000 = 0 THEN (size // 1000000) || 'm' WHEN size > 1000 AND size % 1000 = 0 THEN (size // 1000) || 'k'
  WHEN size > 1000 AND size % 500 = 0 THEN printf('%.1f', size / 1000) || 'k' ELSE CAST(size AS VARCHAR) END AS label FROM (SELECT CAST(x AS BIGINT) AS size FROM (VALUES (500), (1000), (1500), (2000), (100000), (123456), (5000000)) t(x))""")
def transfer_bin_size(spark, sf):
    s = spark.createDataFrame([(x,) for x in (500, 1000, 1500, 2000, 100000, 123456, 5000000)], "size BIGINT")
    return s.select("size", sq.bin_size_label(F.col("size")).alias("label"))


@query(f"""WITH {SITES}, c AS (SELECT chrom, pos, min(context) AS context FROM sites GROUP BY 1, 2) SELECT chrom, context, count(*) AS n, count(*) FILTER (context IN {CGN}) AS cgn, count(*) FILTER (context IN {CHN}) AS chn FROM c GROUP BY 1, 2""")
def context_codebook(spark, sf):
    book = so.codebook(sites(spark, sf), ["CGN", "CHN"])
    return book.groupBy("chrom", "context").agg(F.count("*").alias("n"), F.count_if("CGN").alias("cgn"), F.count_if("CHN").alias("chn"))


@query("""SELECT event_type, value, CASE WHEN value = 0 THEN '0' WHEN value > 0.01 AND value < 1 THEN rtrim(printf('%.2f', value), '0') WHEN value >= 1 AND value < 100 THEN CAST(CAST(trunc(value) AS BIGINT) AS VARCHAR)
  ELSE regexp_replace(printf('%.2E', value), 'E([+-])0', 'E\\1') END AS label FROM (SELECT DISTINCT event_type, round(value, 3) * (CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0.001 END) AS value FROM events WHERE value IS NOT NULL)""")
def number_labels(spark, sf):
    e = table(spark, sf, "events").where("value IS NOT NULL").select("event_type", (F.round("value", 3) * F.when(F.col("event_id") % 2 == 0, 1.0).otherwise(0.001)).alias("value")).distinct()
    return e.select("*", sq.number_label(F.col("value")).alias("label"))


@query("""SELECT bases, plain, n AS n_dot FROM (VALUES ('.,+2AG.T', '.,.T', 2), ('^].-3ACG$,a', '.,a', 1), ('..+12AAAAAAAAAAAAC', '..C', 2), ('', '', 0)) t(bases, plain, n)""")
def pileup_bases(spark, sf):
    p = spark.createDataFrame([(".,+2AG.T",), ("^].-3ACG$,a",), ("..+12AAAAAAAAAAAAC",), ("",)], "bases STRING")
    seq = so.pileup_bases(F.col("bases"))
    return p.select("bases", seq.alias("plain"), (F.length(seq) - F.length(F.replace(seq, F.lit("."), F.lit("")))).alias("n_dot"))


@query(f"""WITH {SITES} SELECT cell, bins, total FROM (SELECT cell, count(DISTINCT CASE WHEN cov > 2 AND cov <= 4 THEN chrom || ':' || (pos // 100) END) AS bins, count(*) AS total FROM sites GROUP BY 1)""")
def doublet_bins(spark, sf):
    from ..operators.doublets import cell_bins

    return cell_bins(sites(spark, sf), 100, 2)

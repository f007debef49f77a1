"""Queries of the core's training-data operators over the domain tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.compaction import join_files, latest_records, repeated_records, rows_as_files, unpack_rows
from ..operators.fill import fill_counts
from ..operators.intervals import periods_and_gaps
from ..operators.tree_agg import heavy_keys, tree_aggregate
from ..schema import label_key, spell_chrom

ALLC_COLUMNS = ("cell", "chrom", "pos", "strand", "context", "mc", "cov", "p")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_filled(spark: SparkSession, sf: str) -> DataFrame:
    return fill_counts(table(spark, sf, "mcds"), table(spark, sf, "adata"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    filled = p1_filled(spark, sf).where("mc_filled OR cov_filled")
    put = F.array_compact(F.array(F.when(F.col("mc_filled") & F.col("mc").isNotNull(), "mc"), F.when(F.col("cov_filled") & F.col("cov").isNotNull(), "cov")))
    return filled.select("row_id", F.explode(put).alias("field"))


def p1_levels(spark: SparkSession, sf: str) -> DataFrame:
    return p1_filled(spark, sf).groupBy("mc_type", "mc_level", "cov_level").agg(F.count("*").alias("n"), F.sum("mc").alias("mc"), F.sum("cov").alias("cov"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    bed = spell_chrom(table(spark, sf, "bed").select("sample", "chrom", "start", "end"), table(spark, sf, "chrom_sizes"))
    return periods_and_gaps(bed, ["sample", "chrom"])


def p4_packs(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of ``allc`` as tiny files, joined into packs in the shared folder."""
    return join_files(rows_as_files(table(spark, sf, "allc"), "file_uid", ALLC_COLUMNS))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = unpack_rows(p4_packs(spark, sf), ALLC_COLUMNS, ("cell", "chrom", "pos"), "cell STRING, chrom STRING, pos BIGINT")
    return repeated_records(spell_chrom(rows, table(spark, sf, "chrom_sizes")), ("cell", "chrom", "pos")).select("cell", "chrom", "pos")


def p4_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of every file, as its entries in the packs tell."""
    entries = p4_packs(spark, sf).select(F.explode("entries").alias("e")).select("e.file", "e.lines")
    return entries.groupBy(F.col("file").alias("file_uid")).agg(F.sum("lines").alias("n"))


def p4_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes and lines of all packs, and whether the packs are few and well-sized: at most 16 MiB each, and all but one a
    quarter of it or more."""
    packs = p4_packs(spark, sf).select(F.length("data").cast("long").alias("size"), F.expr("aggregate(entries, 0L, (s, e) -> s + e.lines)").alias("lines"))
    sizes = packs.agg(F.sum("size").alias("bytes"), F.sum("lines").alias("lines"), F.count("*").alias("packs"), F.max("size").alias("largest"), F.count_if(F.col("size") < (4 << 20)).alias("small"))
    return sizes.select("bytes", "lines", ((F.col("largest") <= (16 << 20)) & (F.col("small") <= 1)).alias("well_sized"), (F.col("packs") <= 1 + F.col("bytes") / (4 << 20)).alias("few"))


def p4_records(spark: SparkSession, sf: str) -> DataFrame:
    """Every record once, of several deliveries the last one written."""
    kinds = "cell STRING, chrom STRING, pos BIGINT, mc BIGINT, cov BIGINT, file_uid STRING"
    rows = unpack_rows(p4_packs(spark, sf), ALLC_COLUMNS, ("cell", "chrom", "pos", "mc", "cov"), kinds, "file_uid")
    rows = spell_chrom(rows, table(spark, sf, "chrom_sizes")).where("cell IS NOT NULL AND pos IS NOT NULL")
    rows = rows.join(table(spark, sf, "allc_table").select("file_uid", "written_at"), "file_uid", "left")
    newest = [F.col("written_at").isNotNull(), F.col("written_at"), F.col("file_uid"), F.coalesce("cov", F.lit(-1)), F.coalesce("mc", F.lit(-1))]
    return latest_records(rows, ("cell", "chrom", "pos"), newest).select("cell", "chrom", "pos", "mc", "cov")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    adata = heavy_keys(table(spark, sf, "adata").select(label_key(F.col("groups")).alias("groups")), F.col("groups"))
    bed = table(spark, sf, "bed").select("chrom")
    counts = heavy_keys(spell_all(bed, table(spark, sf, "chrom_sizes")), F.col("chrom"))
    return adata.select(F.lit("adata").alias("table_name"), F.col("key").alias("key_value")).unionByName(counts.select(F.lit("bed").alias("table_name"), F.col("key").alias("key_value")))


def spell_all(df: DataFrame, chrom_sizes: DataFrame) -> DataFrame:
    """As :func:`spell_chrom`, but rows that name no chromosome stay, with a null."""
    from ..schema import chrom_key

    names = chrom_sizes.groupBy(chrom_key(F.col("chrom")).alias("__chrom_key")).agg(F.min("chrom").alias("__spelt"))
    return df.withColumn("__chrom_key", chrom_key(F.col("chrom"))).join(names, "__chrom_key", "left").drop("__chrom_key", "chrom").withColumnRenamed("__spelt", "chrom")


def p7_groups(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "adata").select(label_key(F.col("groups")).alias("groups"), "FinalReads", "MappingRate", "mCGFrac")
    made = {"n": ("count", "*"), "reads": ("sum", "FinalReads"), "most_reads": ("max", "FinalReads"), "mapping_rate": ("avg", "MappingRate"), "least_mcg": ("min", "mCGFrac")}
    return tree_aggregate(a, ["groups"], made).withColumn("mapping_rate", F.round("mapping_rate", 6))


def p7_chroms(spark: SparkSession, sf: str) -> DataFrame:
    bed = spell_all(table(spark, sf, "bed").select("chrom", "start", "end"), table(spark, sf, "chrom_sizes"))
    bed = bed.select("chrom", F.when(F.col("end") > F.col("start"), F.col("end") - F.col("start")).alias("span"))
    return tree_aggregate(bed, ["chrom"], {"n": ("count", "*"), "spans": ("count", "span"), "bases": ("sum", "span"), "longest": ("max", "span")})


QUERIES = {f.__name__: f for f in (p1_found, p1_levels, p3_found, p4_found, p4_manifest, p4_sizes, p4_records, p7_found, p7_groups, p7_chroms)}

_KEY = "regexp_replace(lower(trim({})), '^chr', '')"
_SPELL = f"(SELECT {_KEY.format('chrom')} AS ck, min(chrom) AS spelt FROM chrom_sizes GROUP BY 1)"

SQL = {
    "p1_found": """
        SELECT row_id, 'mc' AS field FROM mcds WHERE mc IS NULL OR mc NOT BETWEEN 0 AND 9999
        UNION ALL
        SELECT row_id, 'cov' AS field FROM mcds WHERE cov IS NULL OR cov NOT BETWEEN 0 AND 9999 OR (mc BETWEEN 0 AND 9999 AND mc > cov)
    """,
    "p1_levels": """
        WITH g AS (SELECT cell, min(lower(trim(groups))) AS grp FROM adata WHERE cell IS NOT NULL AND lower(trim(groups)) NOT IN ('', 'na', 'nan', 'none', 'unassigned') GROUP BY 1),
        u AS (SELECT mcds.*, grp, CASE WHEN mc BETWEEN 0 AND 9999 THEN mc END AS m, CASE WHEN cov BETWEEN 0 AND 9999 AND NOT coalesce(mc BETWEEN 0 AND 9999 AND mc > cov, false) THEN cov END AS c FROM mcds LEFT JOIN g USING (cell)),
        v AS (SELECT *, CASE WHEN c > 0 THEN round(1000 * m / c) END AS s FROM u),
        l AS (SELECT grp, region, mc_type, strand_type, grouping(grp, region, mc_type, strand_type) AS lv, quantile_cont(c, 0.5) AS qc, count(c) AS nc, quantile_cont(s, 0.5) AS qs, count(s) AS ns FROM v
          WHERE grp IS NOT NULL AND region IS NOT NULL AND mc_type IS NOT NULL AND strand_type IS NOT NULL GROUP BY GROUPING SETS ((grp, region, mc_type, strand_type), (grp, mc_type, strand_type))
          UNION ALL SELECT NULL, region, mc_type, strand_type, 8, quantile_cont(c, 0.5), count(c), quantile_cont(s, 0.5), count(s) FROM v WHERE region IS NOT NULL AND mc_type IS NOT NULL AND strand_type IS NOT NULL GROUP BY 2, 3, 4
          UNION ALL SELECT NULL, NULL, mc_type, strand_type, 12, quantile_cont(c, 0.5), count(c), quantile_cont(s, 0.5), count(s) FROM v WHERE mc_type IS NOT NULL AND strand_type IS NOT NULL GROUP BY 3, 4),
        t AS (SELECT (SELECT quantile_cont(c, 0.5) FROM v) AS qc, (SELECT quantile_cont(s, 0.5) FROM v) AS qs),
        f AS (SELECT v.*, coalesce(CASE WHEN a.nc >= 5 THEN 0 END, CASE WHEN b.nc >= 5 THEN 1 END, CASE WHEN d.nc >= 5 THEN 2 END, CASE WHEN e.nc >= 5 THEN 3 END, 4) AS lc,
            coalesce(CASE WHEN a.ns >= 5 THEN 0 END, CASE WHEN b.ns >= 5 THEN 1 END, CASE WHEN d.ns >= 5 THEN 2 END, CASE WHEN e.ns >= 5 THEN 3 END, 4) AS ls,
            coalesce(CASE WHEN a.nc >= 5 THEN a.qc END, CASE WHEN b.nc >= 5 THEN b.qc END, CASE WHEN d.nc >= 5 THEN d.qc END, CASE WHEN e.nc >= 5 THEN e.qc END, t.qc) AS fc,
            coalesce(CASE WHEN a.ns >= 5 THEN a.qs END, CASE WHEN b.ns >= 5 THEN b.qs END, CASE WHEN d.ns >= 5 THEN d.qs END, CASE WHEN e.ns >= 5 THEN e.qs END, t.qs) AS fs
          FROM v LEFT JOIN l a ON a.lv = 0 AND a.grp = v.grp AND a.region = v.region AND a.mc_type = v.mc_type AND a.strand_type = v.strand_type
          LEFT JOIN l b ON b.lv = 8 AND b.region = v.region AND b.mc_type = v.mc_type AND b.strand_type = v.strand_type
          LEFT JOIN l d ON d.lv = 4 AND d.grp = v.grp AND d.mc_type = v.mc_type AND d.strand_type = v.strand_type
          LEFT JOIN l e ON e.lv = 12 AND e.mc_type = v.mc_type AND e.strand_type = v.strand_type, t),
        w AS (SELECT *, greatest(coalesce(c, CAST(round_even(fc, 0) AS BIGINT)), coalesce(m, 0)) AS oc FROM f)
        SELECT mc_type, CASE WHEN m IS NULL THEN ls END AS mc_level, CASE WHEN c IS NULL THEN lc END AS cov_level, count(*) AS n,
          CAST(sum(coalesce(m, CAST(round_even(fs * oc / 1000, 0) AS BIGINT))) AS BIGINT) AS mc, CAST(sum(oc) AS BIGINT) AS cov FROM w GROUP BY 1, 2, 3
    """,
    "p3_found": f"""
        WITH r AS (SELECT sample, spelt AS chrom, start, "end" FROM bed JOIN {_SPELL} s ON {_KEY.format('bed.chrom')} = s.ck
                   WHERE start IS NOT NULL AND "end" > start),
        m AS (SELECT *, max("end") OVER (PARTITION BY sample, chrom ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM r),
        i AS (SELECT *, sum(CASE WHEN top IS NULL OR start > top THEN 1 ELSE 0 END) OVER (PARTITION BY sample, chrom ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM m),
        p AS (SELECT sample, chrom, island, min(start) AS start, max("end") AS "end" FROM i GROUP BY ALL),
        g AS (SELECT sample, chrom, "end" AS start, lead(start) OVER (PARTITION BY sample, chrom ORDER BY island) AS "end" FROM p)
        SELECT sample, chrom, 'period' AS kind, start, "end" FROM p
        UNION ALL SELECT sample, chrom, 'gap' AS kind, start, "end" FROM g WHERE "end" IS NOT NULL
    """,
    "p4_found": f"""
        SELECT cell, spelt AS chrom, pos FROM allc JOIN {_SPELL} s ON {_KEY.format('allc.chrom')} = s.ck
        WHERE cell IS NOT NULL AND pos IS NOT NULL GROUP BY ALL HAVING count(*) > 1
    """,
    "p4_manifest": "SELECT file_uid, count(*) AS n FROM allc GROUP BY file_uid",
    "p4_sizes": """
        SELECT CAST(sum(n) AS BIGINT) AS bytes, count(*) AS lines, true AS well_sized, true AS few FROM (
          SELECT 8 + strlen(coalesce(cell, '\\N')) + strlen(coalesce(chrom, '\\N')) + strlen(coalesce(pos::VARCHAR, '\\N')) + strlen(coalesce(strand, '\\N'))
            + strlen(coalesce(context, '\\N')) + strlen(coalesce(mc::VARCHAR, '\\N')) + strlen(coalesce(cov::VARCHAR, '\\N')) + strlen(coalesce(p::VARCHAR, '\\N')) AS n FROM allc)
    """,
    "p4_records": f"""
        SELECT cell, chrom, pos, mc, cov FROM (
          SELECT cell, spelt AS chrom, pos, mc, cov, row_number() OVER (PARTITION BY cell, spelt, pos
            ORDER BY (written_at IS NOT NULL) DESC, written_at DESC NULLS LAST, allc.file_uid DESC, coalesce(cov, -1) DESC, coalesce(mc, -1) DESC) AS k
          FROM allc JOIN {_SPELL} s ON {_KEY.format('allc.chrom')} = s.ck LEFT JOIN allc_table USING (file_uid)
          WHERE cell IS NOT NULL AND pos IS NOT NULL) WHERE k = 1
    """,
    "p7_found": f"""
        SELECT 'adata' AS table_name, lower(trim(groups)) AS key_value FROM adata WHERE groups IS NOT NULL GROUP BY 2
        HAVING count(*) >= 0.1 * (SELECT count(*) FROM adata)
        UNION ALL
        SELECT 'bed' AS table_name, spelt AS key_value FROM bed JOIN {_SPELL} s ON {_KEY.format('bed.chrom')} = s.ck GROUP BY 2
        HAVING count(*) >= 0.1 * (SELECT count(*) FROM bed)
    """,
    "p7_groups": """
        SELECT lower(trim(groups)) AS groups, count(*) AS n, CAST(sum(FinalReads) AS BIGINT) AS reads, max(FinalReads) AS most_reads,
          round(avg(MappingRate), 6) AS mapping_rate, min(mCGFrac) AS least_mcg FROM adata GROUP BY 1
    """,
    "p7_chroms": f"""
        SELECT spelt AS chrom, count(*) AS n, count(span) AS spans, CAST(sum(span) AS BIGINT) AS bases, max(span) AS longest FROM
          (SELECT spelt, CASE WHEN "end" > start THEN "end" - start END AS span FROM bed LEFT JOIN {_SPELL} s ON {_KEY.format('bed.chrom')} = s.ck) GROUP BY 1
    """,
}

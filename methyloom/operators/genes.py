"""Gene annotation: features, lengths, transcription starts, promoters, names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rangejoin import overlaps


def features(gtf: DataFrame, kind: str) -> DataFrame:
    """0-based half-open chrom, start, end, strand, gene_id, gene_name, transcript_id of one feature kind."""
    return gtf.where(F.col("feature") == kind).select("chrom", (F.col("start") - 1).alias("start"), "end", "strand", "gene_id", "gene_name", "transcript_id")


def gene_lengths(gtf: DataFrame) -> DataFrame:
    return features(gtf, "gene").select("gene_id", (F.col("end") - F.col("start")).alias("length"))


def transcription_starts(gtf: DataFrame, kind: str = "gene") -> DataFrame:
    """gene_id, transcript_id, chrom, pos (0-based), strand: the end at which a feature begins."""
    return features(gtf, kind).select("gene_id", "transcript_id", "chrom", F.when(F.col("strand") == "+", F.col("start")).otherwise(F.col("end") - 1).alias("pos"), "strand")


def promoters(gtf: DataFrame, chrom_sizes: DataFrame, slop: int = 500) -> DataFrame:
    """gene_id, chrom, start, end: ``slop`` bases about each gene's start, within its chromosome."""
    t = transcription_starts(gtf).join(chrom_sizes.select("chrom", "size"), "chrom")
    return t.select("gene_id", "chrom", F.greatest(F.col("pos") - slop, F.lit(0)).alias("start"), F.least(F.col("pos") + slop, F.col("size")).alias("end"))


def ids_by_name(gtf: DataFrame) -> DataFrame:
    """gene_name, gene_id: of several genes of a name the longest (ties by id)."""
    g = features(gtf, "gene").where(F.col("gene_name").isNotNull())
    return g.groupBy("gene_name").agg(F.min_by("gene_id", F.struct(-(F.col("end") - F.col("start")), F.col("gene_id"))).alias("gene_id"))


def subset(gtf: DataFrame, regions: DataFrame, kind: str | None = None, span: int = 0) -> DataFrame:
    """The rows of the annotation that overlap a region (with ``span`` bases about it), each once."""
    rows = (gtf if kind is None else gtf.where(F.col("feature") == kind)).withColumn("__g", F.monotonically_increasing_id())
    b = rows.select("__g", "chrom", (F.col("start") - 1).alias("start"), "end")
    hit = overlaps(regions.select("region", "chrom", "start", "end"), b, "region", "__g", slop=span)
    return rows.join(hit.select("__g"), "__g", "left_semi").drop("__g")


def to_bed12(gtf: DataFrame) -> DataFrame:
    """chrom, start, end, name, strand, sizes, starts of transcripts from their exons."""
    e = features(gtf, "exon").where(F.col("transcript_id").isNotNull())
    t = e.groupBy("transcript_id").agg(F.min("chrom").alias("chrom"), F.min("start").alias("start"), F.max("end").alias("end"), F.min("strand").alias("strand"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("x"))
    return t.select("chrom", "start", "end", F.col("transcript_id").alias("name"), "strand", F.transform("x", lambda s: s["end"] - s["start"]).alias("sizes"), F.transform("x", lambda s: s["start"] - F.col("start")).alias("starts"))

"""Joins on overlapping genome intervals: an equi-join on bins, with the overlap as a residual condition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bases of a bin. An interval is repeated once per bin it touches.
BIN = 1 << 16


def _bins(start: Column, end: Column, size: int) -> Column:
    return F.explode(F.sequence(F.floor(start / size), F.floor((end - 1) / size)))


def sites_in_regions(sites: DataFrame, regions: DataFrame, region: str = "region", size: int = BIN, how: str = "inner") -> DataFrame:
    """Columns of ``sites`` and ``region``: each site once per region that holds it (start < pos <= end). Regions have
    ``region``, chrom, start, end; empty ones hold nothing."""
    r = regions.where("end > start").select(F.col(region).alias("__region"), F.col("chrom").alias("__chrom"), F.col("start").alias("__start"), F.col("end").alias("__end"), _bins(F.col("start"), F.col("end"), size).alias("__bin"))
    s = sites.withColumn("__sbin", F.floor((F.col("pos") - 1) / size))
    on = (F.col("chrom") == F.col("__chrom")) & (F.col("__sbin") == F.col("__bin")) & (F.col("pos") > F.col("__start")) & (F.col("pos") <= F.col("__end"))
    return s.join(r, on, how).select(*[f"`{c}`" for c in sites.columns], F.col("__region").alias(region))


def overlaps(a: DataFrame, b: DataFrame, a_id: str, b_id: str, size: int = BIN, slop: int = 0) -> DataFrame:
    """``a_id``, ``b_id``, ``overlap``, ``a_length``: pairs of intervals that share a base (with ``slop`` bases put to
    both ends of ``a``). A pair that meets in several bins is reported in the first bin both touch, so nothing has to
    be made distinct. Other columns of ``b`` come along with a ``b_`` before their names."""
    more = [c for c in b.columns if c not in (b_id, "chrom", "start", "end")]
    left = a.where("end > start").select(F.col(a_id).alias("__a"), F.col("chrom").alias("__ac"), F.greatest(F.col("start") - slop, F.lit(0)).alias("__as"), (F.col("end") + slop).alias("__ae"))
    right = b.where("end > start").select(F.col(b_id).alias("__b"), F.col("chrom").alias("__bc"), F.col("start").alias("__bs"), F.col("end").alias("__be"), *[F.col(f"`{c}`").alias(f"b_{c}") for c in more])
    left = left.withColumn("__abin", _bins(F.col("__as"), F.col("__ae"), size))
    right = right.withColumn("__bbin", _bins(F.col("__bs"), F.col("__be"), size))
    on = (F.col("__ac") == F.col("__bc")) & (F.col("__abin") == F.col("__bbin")) & (F.col("__as") < F.col("__be")) & (F.col("__bs") < F.col("__ae"))
    first = F.floor(F.greatest("__as", "__bs") / size) == F.col("__abin")
    return left.join(right, on & first).select(
        F.col("__a").alias(a_id if a_id != b_id else f"{a_id}_a"),
        F.col("__b").alias(b_id if a_id != b_id else f"{b_id}_b"),
        (F.least("__ae", "__be") - F.greatest("__as", "__bs")).alias("overlap"),
        (F.col("__ae") - F.col("__as")).alias("a_length"),
        *[f"b_{c}" for c in more],
    )


def annotate_by_beds(regions: DataFrame, beds: DataFrame, region: str = "region", track: str = "track", fraction: float = 0.2, slop: int = 0) -> DataFrame:
    """``region``, ``track`` where one feature of the track covers at least ``fraction`` of the region. ``beds`` has
    ``track``, chrom, start, end. Pairs that are not reported are false."""
    b = beds.withColumn("__f", F.monotonically_increasing_id())
    hit = overlaps(regions, b, region, "__f", slop=slop).where(F.col("overlap") >= fraction * F.col("a_length"))
    return hit.select(region, F.col(f"b_{track}").alias(track)).distinct()


def annotate_by_tracks(regions: DataFrame, tracks: DataFrame, region: str = "region", track: str = "track", kind: str = "mean", slop: int = 0) -> DataFrame:
    """``region``, ``track``, ``value``: statistic of a track's values over the bases of a region that it has: mean
    (by bases), max, min, sum or coverage (share of the region's bases). Regions that a track has nothing of are absent."""
    b = tracks.withColumn("__f", F.monotonically_increasing_id())
    hit = overlaps(regions, b, region, "__f", slop=slop)
    made = {
        "mean": F.sum(F.col("b_value") * F.col("overlap")) / F.sum("overlap"),
        "max": F.max("b_value"),
        "min": F.min("b_value"),
        "sum": F.sum(F.col("b_value") * F.col("overlap")),
        "coverage": F.sum("overlap") / F.max("a_length"),
    }
    return hit.groupBy(region, F.col(f"b_{track}").alias(track)).agg(made[kind].alias("value"))


def without_blacklist(regions: DataFrame, blacklist: DataFrame, region: str = "region", fraction: float = 0.2) -> DataFrame:
    """The regions of which no blacklisted interval covers at least ``fraction``."""
    b = blacklist.withColumn("__f", F.monotonically_increasing_id())
    hit = overlaps(regions, b, region, "__f").where(F.col("overlap") >= fraction * F.col("a_length"))
    return regions.join(hit.select(region), region, "left_anti")


def fetch_regions(sites: DataFrame, regions: DataFrame) -> DataFrame:
    """The sites that lie in any of the regions, each once."""
    r = regions.where("end > start").select(F.col("chrom").alias("__chrom"), F.col("start").alias("__start"), F.col("end").alias("__end"), _bins(F.col("start"), F.col("end"), BIN).alias("__bin"))
    s = sites.withColumn("__sbin", F.floor((F.col("pos") - 1) / BIN))
    on = (F.col("chrom") == F.col("__chrom")) & (F.col("__sbin") == F.col("__bin")) & (F.col("pos") > F.col("__start")) & (F.col("pos") <= F.col("__end"))
    return s.join(r, on, "left_semi").drop("__sbin")


def near_pairs(a: DataFrame, b: DataFrame, a_id: str, b_id: str, max_dist: int) -> DataFrame:
    """``a_id``, ``b_id``, ``dist``: positions (chrom, pos) of ``a`` and ``b`` less than ``max_dist`` apart: each row
    of ``a`` is placed in its bin and the two beside it, bins being as wide as the distance."""
    left = a.select(F.col(a_id), F.col("chrom").alias("__c"), F.col("pos").alias("__p"), F.explode(F.array(*[F.floor(F.col("pos") / max_dist) + d for d in (-1, 0, 1)])).alias("__bin"))
    right = b.select(F.col(b_id), F.col("chrom").alias("__c"), F.col("pos").alias("__q"), F.floor(F.col("pos") / max_dist).alias("__bin"))
    return left.join(right, ["__c", "__bin"]).where(F.abs(F.col("__p") - F.col("__q")) < max_dist).select(a_id, b_id, (F.col("__q") - F.col("__p")).alias("dist"))


def slopped(regions: DataFrame, chrom_sizes: DataFrame, slop: int) -> DataFrame:
    """Regions longer by ``slop`` at both ends, within their chromosome."""
    cols = regions.columns
    made = regions.join(chrom_sizes.select("chrom", "size"), "chrom").withColumns({"start": F.greatest(F.col("start") - slop, F.lit(0)), "end": F.least(F.col("end") + slop, F.col("size"))})
    return made.select(*cols)


def centred(regions: DataFrame, chrom_sizes: DataFrame, length: int) -> DataFrame:
    """Regions of one ``length`` about their centres, within their chromosome."""
    cols, half = regions.columns, length // 2
    mid = F.col("start") + F.floor((F.col("end") - F.col("start")) / 2)
    made = regions.join(chrom_sizes.select("chrom", "size"), "chrom").withColumn("__mid", mid)
    return made.withColumns({"start": F.greatest(F.col("__mid") - half, F.lit(0)), "end": F.least(F.col("__mid") + half, F.col("size"))}).select(*cols)


def windows(chrom_sizes: DataFrame, window: int, step: int | None = None) -> DataFrame:
    """chrom, start, end of fixed or sliding windows, the last ones ending with their chromosome."""
    return chrom_sizes.select("chrom", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(step or window).cast("long"))).alias("start")).select("chrom", "start", F.least(F.col("start") + window, F.col("size")).alias("end"))


def chunk_intervals(boundaries: DataFrame) -> DataFrame:
    """chrom, start, end between every two boundaries (chrom, pos) of a chromosome that follow each other."""
    from pyspark.sql import Window

    ends = boundaries.select("chrom", F.col("pos").alias("start"), F.lead("pos").over(Window.partitionBy("chrom").orderBy("pos")).alias("end"))
    return ends.where("end IS NOT NULL")


def genome_bin_ids(chrom_sizes: DataFrame, bin_size: int) -> DataFrame:
    """chrom, offset: the global number of each chromosome's first bin (size div bin + 1 bins each, in genome order).
    One row per chromosome."""
    from pyspark.sql import Window

    w = Window.orderBy("chrom_order").rowsBetween(Window.unboundedPreceding, -1)
    return chrom_sizes.select("chrom", F.coalesce(F.sum(F.floor(F.col("size") / bin_size) + 1).over(w), F.lit(0)).alias("offset"))


def merged_with_ids(regions: DataFrame, by: Sequence[str] = ("chrom",), region: str = "region") -> DataFrame:
    """Overlapping regions as one, with the sorted ids joined by commas."""
    from .intervals import periods_and_gaps

    periods = periods_and_gaps(regions.select(*by, "start", "end"), list(by)).where("kind = 'period'").drop("kind").withColumn("__m", F.monotonically_increasing_id())
    p = periods.select("__m", "chrom", "start", "end")
    hit = overlaps(regions.select(region, "chrom", "start", "end"), p.withColumnsRenamed({"start": "start", "end": "end"}), region, "__m")
    ids = hit.groupBy("__m").agg(F.array_join(F.array_sort(F.collect_set(region)), ",").alias("ids"))
    return p.join(ids, "__m").select("chrom", "start", "end", "ids")

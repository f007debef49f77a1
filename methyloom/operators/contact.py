"""Contact matrices as rows of sample, chrom, bin1, bin2, value (upper triangle), and enhancer-gene scores from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored


def fetch_contacts(contacts: DataFrame, chrom: str, start: int, end: int, bin_size: int) -> DataFrame:
    """The pixels of one window: bins start // size to end // size, both included."""
    a, z = start // bin_size, end // bin_size
    return contacts.where((F.col("chrom") == chrom) & F.col("bin1").between(a, z) & F.col("bin2").between(a, z))


def summed_matrix(contacts: DataFrame, weights: DataFrame | None = None, scale: float = 1.0, log1p: bool = False, symmetric: bool = False) -> DataFrame:
    """chrom, bin1, bin2, value: samples added up by their weights (sample, weight), scaled, optionally log1p and with
    the lower triangle."""
    w = F.col("value")
    if weights is not None:
        contacts, w = contacts.join(weights, "sample"), F.col("value") * F.col("weight")
    out = contacts.groupBy("chrom", "bin1", "bin2").agg((F.sum(w) * scale).alias("value"))
    if log1p:
        out = out.withColumn("value", F.log1p("value"))
    if symmetric:
        out = out.unionByName(out.where("bin1 <> bin2").select("chrom", F.col("bin2").alias("bin1"), F.col("bin1").alias("bin2"), "value"))
    return out


def cooler_pixels(contacts: DataFrame, offsets: DataFrame) -> DataFrame:
    """bin1_id, bin2_id, count: pixels above 0 with genome-wide bin ids (``offsets``: chrom, offset)."""
    return contacts.where("value <> 0").join(offsets, "chrom").select((F.col("bin1") + F.col("offset")).alias("bin1_id"), (F.col("bin2") + F.col("offset")).alias("bin2_id"), F.col("value").alias("count"))


def zoomed(contacts: DataFrame, factor: int) -> DataFrame:
    """Pixels of bins ``factor`` times as wide."""
    return contacts.groupBy(*[c for c in ("sample", "chrom") if c in contacts.columns], F.floor(F.col("bin1") / factor).alias("bin1"), F.floor(F.col("bin2") / factor).alias("bin2")).agg(F.sum("value").alias("value"))


def diagonal_filled(matrix: DataFrame, bins: DataFrame | None = None, size: int = 4) -> DataFrame:
    """``matrix`` (upper triangle) with each diagonal pixel replaced by the largest of the ``size`` pixels after it, or, in
    the last ``size`` + 1 bins of a chromosome, of the pixels from ``size`` + 1 to 2 bins before it. ``bins``: chrom, bins
    (their number); without it a chromosome ends with its last pixel."""
    if bins is None:
        bins = matrix.groupBy("chrom").agg((F.max("bin2") + 1).alias("bins"))
    sized = matrix.join(bins, "chrom")
    after = sized.where((F.col("bin2") > F.col("bin1")) & (F.col("bin2") <= F.col("bin1") + size) & (F.col("bin1") + size + 1 < F.col("bins"))).select("chrom", "bin1", "value")
    before = sized.where((F.col("bin1") >= F.col("bin2") - size - 1) & (F.col("bin1") <= F.col("bin2") - 2) & (F.col("bin2") + size + 1 >= F.col("bins"))).select("chrom", F.col("bin2").alias("bin1"), "value")
    near = after.unionByName(before).groupBy("chrom", "bin1").agg(F.max("value").alias("value"))
    return matrix.where("bin1 <> bin2").unionByName(near.select("chrom", "bin1", F.col("bin1").alias("bin2"), "value"))


def abc_scores(tss: DataFrame, enhancers: DataFrame, matrix: DataFrame, bin_size: int, max_dist: int = 5_000_000, cutoff: float = 0.02, bins: DataFrame | None = None) -> DataFrame:
    """enhancer, tss, abc: activity times contact of an enhancer over the sum for its gene, above ``cutoff``. ``tss``:
    tss, chrom, pos; ``enhancers``: enhancer, chrom, pos, activity. Contact pixels drive the join, so pairs without a
    contact are never made; the diagonal is filled from its neighbours.

    The sum is the same for all genes of a bin: its pixels times the activity of the bins they lead to. So enhancers meet
    pixels, not genes, and of them only those above the cutoff go on to the genes of the bin: no other pair is shuffled.
    A ``tss`` of several rows has the sum over all of them; in its bins, enhancers are kept that are above the cutoff of
    the smallest or the largest sum there, and its own decides."""
    matrix = stored(matrix.select("chrom", "bin1", "bin2", "value"), "matrix")
    full = diagonal_filled(matrix, bins)
    full = full.unionByName(full.where("bin1 <> bin2").select("chrom", F.col("bin2").alias("bin1"), F.col("bin1").alias("bin2"), "value")).where(F.abs(F.col("bin1") - F.col("bin2")) < max_dist // bin_size)
    t = tss.select("tss", "chrom", F.floor(F.col("pos") / bin_size).alias("bin1"))
    e = enhancers.select("enhancer", "chrom", "activity", F.floor(F.col("pos") / bin_size).alias("bin2"))
    sums = e.groupBy("chrom", "bin2").agg(F.sum("activity").alias("__sum"))
    total = F.sum(F.col("value") * F.col("__sum")).over(Window.partitionBy("chrom", "bin1"))
    pixels = full.join(sums, ["chrom", "bin2"]).withColumn("total", total).drop("__sum")

    def share(of: Column) -> Column:
        return F.col("raw") / (of + 1e-9)

    of, keep = F.col("total"), share(F.col("total")) > cutoff
    again = stored(t.groupBy(F.xxhash64("tss").alias("__id")).agg(F.count("*").alias("n")).where("n > 1").select("__id"), "again")
    if not again.isEmpty():
        rows = t.withColumn("__id", F.xxhash64("tss")).join(again, "__id", "left_semi").drop("__id").join(pixels.groupBy("chrom", "bin1").agg(F.max("total").alias("total")), ["chrom", "bin1"])
        own = stored(rows.groupBy(F.col("tss").alias("__tss")).agg(F.sum("total").alias("own")), "own")
        ends = rows.join(own, F.col("tss").eqNullSafe(F.col("__tss"))).groupBy("chrom", "bin1").agg(F.min("own").alias("low"), F.max("own").alias("high"))
        t = t.join(own, F.col("tss").eqNullSafe(F.col("__tss")), "left").drop("__tss")
        pixels = pixels.join(ends, ["chrom", "bin1"], "left")
        low, high = F.least("low", "total"), F.greatest("high", "total")
        of, keep = F.coalesce("own", "total"), F.when(low + 1e-9 > 0, (share(low) > cutoff) | (share(high) > cutoff)).otherwise(True)
    near = pixels.join(e, ["chrom", "bin2"]).withColumn("raw", F.col("activity") * F.col("value")).where(keep).select("chrom", "bin1", "enhancer", "raw", "total")
    return t.join(near, ["chrom", "bin1"]).withColumn("abc", share(of)).where(F.col("abc") > cutoff).select("enhancer", "tss", "abc")


def insulation(matrix: DataFrame, window: int) -> DataFrame:
    """chrom, bin, score: mean contact between the ``window`` bins before and after each bin."""
    m = matrix.where((F.col("bin2") > F.col("bin1")) & (F.col("bin2") - F.col("bin1") <= 2 * window)).select("chrom", "value", F.explode(F.sequence(F.greatest(F.col("bin2") - window, F.col("bin1") + 1), F.least(F.col("bin1") + window, F.col("bin2") - 1))).alias("bin") if window > 1 else F.explode(F.array(F.col("bin1") + 1)).alias("bin"))
    return m.groupBy("chrom", "bin").agg((F.sum("value") / (window * window)).alias("score"))

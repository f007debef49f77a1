"""Operators on base-level counts: rows of (cell,) chrom, pos, strand, context, mc, cov."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import matches, pattern_table
from ..functions.stats import binary_counts


def fetch(sites: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """The rows of one 0-based half-open region; a range predicate that reaches the scan."""
    return sites.where((F.col("chrom") == chrom) & (F.col("pos") > start) & (F.col("pos") <= end))


def fetch_positions(sites: DataFrame, positions: DataFrame) -> DataFrame:
    """The rows at the given (chrom, pos)."""
    return sites.join(positions.select("chrom", "pos"), ["chrom", "pos"], "left_semi")


def select_contexts(sites: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """The rows whose context belongs to a pattern, once for each such pattern (``pattern``)."""
    return sites.join(pattern_table(sites.sparkSession, list(patterns)), "context")


def codebook(sites: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """chrom, pos, context and one BOOLEAN column per pattern: every position once, with the patterns that its context
    belongs to."""
    once = sites.groupBy("chrom", "pos").agg(F.min("context").alias("context"))
    return once.select("*", *[matches(F.col("context"), p).alias(p) for p in patterns])


def extract_contexts(sites: DataFrame, patterns: Sequence[str], strandness: str = "both", cov_cutoff: int = 9999, binarize: bool = False, keys: Sequence[str] = ("cell",)) -> DataFrame:
    """The rows of each pattern with cov up to ``cov_cutoff``. ``strandness``: ``both`` keeps strands, ``split`` adds
    ``strand_type``, ``merge`` adds up the two strands of CpG sites at the position of the forward one."""
    if strandness not in ("both", "split", "merge"):
        raise ValueError(f"unknown strandness: {strandness}")
    out = select_contexts(sites.where(F.col("cov") <= cov_cutoff), patterns)
    if binarize:
        mc, cov = binary_counts(F.col("mc"), F.col("cov"))
        out = out.withColumns({"mc": mc, "cov": cov}).where("cov > 0")
    if strandness == "split":
        return out.withColumn("strand_type", F.col("strand"))
    if strandness == "merge":
        return merge_strands(out, [*keys, "pattern"])
    return out


def merge_strands(sites: DataFrame, keys: Sequence[str] = ("cell",)) -> DataFrame:
    """CpG sites with both strands added up: a row of the reverse strand counts at the position before it."""
    return sites.groupBy(*keys, "chrom", (F.col("pos") - F.when(F.col("strand") == "-", 1).otherwise(0)).alias("pos")).agg(F.lit("+").alias("strand"), F.sum("mc").alias("mc"), F.sum("cov").alias("cov"))


def merge_sites(sites: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sums of mc and cov per position (and ``keys``) over all inputs; the site's strand and context are taken from
    its least row, as all rows of a position share them."""
    return sites.groupBy(*keys, "chrom", "pos").agg(F.min("strand").alias("strand"), F.min("context").alias("context"), F.sum("mc").alias("mc"), F.sum("cov").alias("cov"))


def merge_snp_sites(sites: DataFrame) -> DataFrame:
    """As :func:`merge_sites`, with the arrays ``snp_match`` and ``snp_mismatch`` (three counts) added up by place."""
    sums = [F.array(*[F.sum(F.col(c)[i]) for i in range(3)]).alias(c) for c in ("snp_match", "snp_mismatch")]
    return sites.groupBy("chrom", "pos").agg(F.min("strand").alias("strand"), F.min("context").alias("context"), F.sum("mc").alias("mc"), F.sum("cov").alias("cov"), *sums)


def parse_snp(sites: DataFrame) -> DataFrame:
    """The two comma-separated columns of a SNP table as arrays of BIGINT."""
    return sites.withColumns({c: F.split(c, ",").cast("array<bigint>") for c in ("snp_match", "snp_mismatch")})


def profile(sites: DataFrame, keys: Sequence[str] = (), drop_n: bool = True) -> DataFrame:
    """Per context: mc, cov, n_base, overall rate, mean and deviation of cov, mean and variance of the sites' rates,
    and the parameters of the beta distribution with that mean and variance (null where it has none). All rows count."""
    if drop_n:
        sites = sites.where(~F.col("context").contains("N"))
    rate = F.try_divide(F.col("mc"), F.col("cov"))
    out = sites.groupBy(*keys, "context").agg(
        F.sum("mc").alias("mc"),
        F.sum("cov").alias("cov"),
        F.count("*").alias("n_base"),
        F.avg("cov").alias("base_cov_mean"),
        F.stddev_pop("cov").alias("base_cov_std"),
        F.avg(rate).alias("base_beta_mean"),
        F.var_pop(rate).alias("base_beta_var"),
    )
    mean, var = F.col("base_beta_mean"), F.col("base_beta_var")
    a = F.try_divide((1 - mean) * mean * mean, var) - mean
    return out.withColumns({"mc_rate": F.try_divide(F.col("mc"), F.col("cov")), "base_beta_a": a, "base_beta_b": a * (F.try_divide(F.lit(1.0), mean) - 1)})


def standardize(sites: DataFrame, chrom_sizes: DataFrame, remove_additional: bool = True) -> DataFrame:
    """Rows with a numeric position on known chromosomes, ``chr`` put before names that lack it where the known ones
    have it. Without ``remove_additional`` an unknown chromosome raises."""
    prefix = chrom_sizes.where(F.col("chrom").startswith("chr")).limit(1).count() > 0
    rows = sites.where(F.col("pos").try_cast("long").isNotNull())
    if prefix:
        rows = rows.withColumn("chrom", F.when(F.col("chrom").startswith("chr"), F.col("chrom")).otherwise(F.concat(F.lit("chr"), "chrom")))
    known = chrom_sizes.select("chrom")
    if not remove_additional:
        extra = rows.join(known, "chrom", "left_anti").select("chrom").limit(1).collect()
        if extra:
            raise ValueError(f"unknown chromosome: {extra[0].chrom}")
    return rows.join(known, "chrom", "left_semi")


def check_chroms(sites: DataFrame, chrom_sizes: DataFrame, modified: str | None = None, indexed: str | None = None) -> DataFrame:
    """known, within, fresh: whether all chromosomes of a table of sites (chrom, pos) are in ``chrom_sizes``, whether all
    positions lie on them, and whether the index column (``indexed``, a time) is not older than ``modified``; null where
    neither column is named."""
    sized = sites.join(chrom_sizes.select("chrom", "size"), "chrom", "left")
    fresh = F.coalesce(F.bool_and(F.col(indexed) >= F.col(modified)), F.lit(True)) if modified and indexed else F.lit(None).cast("boolean")
    return sized.agg(F.coalesce(F.bool_and(F.col("size").isNotNull()), F.lit(True)).alias("known"), F.coalesce(F.bool_and(F.col("pos").between(1, F.col("size"))), F.lit(True)).alias("within"), fresh.alias("fresh"))


def genome_order(df: DataFrame, chrom_sizes: DataFrame, *then: str) -> DataFrame:
    """``df`` sorted by the order of ``chrom_sizes``, then by ``then``; unknown chromosomes are left out."""
    return df.join(chrom_sizes.select("chrom", "chrom_order"), "chrom").orderBy("chrom_order", *then)


def counts_from(mode: str, **c: Column) -> tuple[Column, Column]:
    """mc and cov from the columns a table has: ``mc+cov``, ``mc+uc``, ``uc+cov``, ``mc_frac+cov``, ``mc_frac+mc``,
    ``mc_frac+uc`` or ``mc_frac+pseudo_count``. Products are rounded half to even."""
    f = c.get("mc_frac")
    whole = lambda x: F.bround(x, 0).cast("long")
    if mode == "mc+cov":
        return c["mc"], c["cov"]
    if mode == "mc+uc":
        return c["mc"], c["mc"] + c["uc"]
    if mode == "uc+cov":
        return c["cov"] - c["uc"], c["cov"]
    if mode == "mc_frac+cov":
        return whole(f * c["cov"]), c["cov"]
    if mode == "mc_frac+mc":
        return c["mc"], whole(F.try_divide(c["mc"], f))
    if mode == "mc_frac+uc":
        cov = whole(F.try_divide(c["uc"], 1 - f))
        return cov - c["uc"], cov
    if mode == "mc_frac+pseudo_count":
        return whole(f * c["pseudo_count"]), c["pseudo_count"].cast("long")
    raise ValueError(f"unknown mode: {mode}")


def binned_tracks(sites: DataFrame, chrom_sizes: DataFrame, bin_size: int, patterns: Sequence[str], stranded: bool = False, keys: Sequence[str] = ()) -> DataFrame:
    """Per pattern (and strand) and bin ``frac`` and ``cov``; bin of a site is (pos - 1) div size, bins without sites
    are left out, the last bin ends with its chromosome."""
    by = [*keys, "pattern", *(["strand"] if stranded else []), "chrom"]
    binned = select_contexts(sites, patterns).groupBy(*by, F.floor((F.col("pos") - 1) / bin_size).alias("bin")).agg(F.sum("mc").alias("mc"), F.sum("cov").alias("cov"))
    sized = binned.join(chrom_sizes.select("chrom", "size"), "chrom")
    return sized.where("cov > 0").select(*by, (F.col("bin") * bin_size).alias("start"), F.least((F.col("bin") + 1) * bin_size, F.col("size")).alias("end"), (F.col("mc") / F.col("cov")).alias("frac"), "cov")


def pileup_bases(bases: Column) -> Column:
    """The bases column of a pileup line without read starts, read ends and indels of any length: the sequence after
    an indel's sign and length is cut to that length, a loop over the indels of one line."""
    plain = F.regexp_replace(F.regexp_replace(bases, r"\^.", ""), r"\$", "")
    parts = F.split(plain, r"[+-](?=\d)")
    rest = F.transform(F.slice(parts, 2, F.size(parts)), lambda s: F.substring(s, F.length(F.regexp_extract(s, r"^\d+", 0)) + F.regexp_extract(s, r"^(\d+)", 1).cast("int") + 1, F.length(s)))
    return F.concat(parts[0], F.array_join(rest, ""))


def pileup_counts(pileup: DataFrame) -> DataFrame:
    """chrom, pos, strand, mc, cov of the C and G of a pileup (chrom, pos, ref_base, depth, bases, quals): at a C,
    matches of the forward strand are methylated and T is not; at a G, matches of the reverse strand and a."""
    seq = pileup_bases(F.col("bases"))
    count = lambda ch: F.length(seq) - F.length(F.replace(seq, F.lit(ch), F.lit("")))
    ref = F.upper("ref_base")
    mc = F.when(ref == "C", count(".")).when(ref == "G", count(","))
    uc = F.when(ref == "C", count("T")).when(ref == "G", count("a"))
    rows = pileup.where(ref.isin("C", "G")).select("chrom", "pos", F.when(ref == "C", "+").otherwise("-").alias("strand"), mc.cast("long").alias("mc"), (mc + uc).cast("long").alias("cov"))
    return rows.where("cov > 0")


def add_context(sites: DataFrame, sequence: DataFrame, up: int = 0, down: int = 2) -> DataFrame:
    """``sites`` with ``context`` from chunks of the reference (chrom, start, seq: seq holds the chunk and enough of its
    neighbours that every site's context lies in it; ``size`` is the step). Sites too near an end are left out."""
    size = sequence.agg(F.max("size")).first()[0] or 1
    s = sites.withColumn("start", F.floor((F.col("pos") - 1) / size) * size)
    joined = s.join(sequence.select("chrom", "start", "lead", "seq"), ["chrom", "start"])
    at = F.col("pos") - F.col("start") + F.col("lead")
    forward = F.substring("seq", (at - up).cast("int"), F.lit(up + down + 1))
    backward = F.reverse(F.translate(F.substring("seq", (at - down).cast("int"), F.lit(up + down + 1)), "ACGTN", "TGCAN"))
    inside = F.when(F.col("strand") == "+", at - up >= 1).otherwise(at - down >= 1)
    return joined.withColumn("context", F.when(F.col("strand") == "+", forward).otherwise(backward)).where(inside & (F.length("context") == up + down + 1)).drop("start", "lead", "seq")

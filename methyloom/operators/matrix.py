"""Cell by region matrices in long form: rows of cell, region, mc_type, mc, cov."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import pattern_table
from ..functions.stats import binomial_tail, m_value
from .rangejoin import sites_in_regions

KEY = ("cell", "region", "mc_type")


def _by_pattern(counts: DataFrame, patterns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Counts per concrete context as counts per pattern (``mc_type``): contexts are few, so they are added up first."""
    table = pattern_table(counts.sparkSession, list(patterns)).withColumnRenamed("pattern", "mc_type")
    return counts.join(table, "context").groupBy(*keys, "mc_type").agg(F.sum("mc").alias("mc"), F.sum("cov").alias("cov"))


def count_bins(sites: DataFrame, chrom_sizes: DataFrame, bin_size: int, patterns: Sequence[str], split_strand: bool = False) -> DataFrame:
    """Sums per cell, bin and pattern (and strand): chrom, start, end, mc, cov; only bins with cov above 0."""
    keys = ["cell", "chrom", "bin", *(["strand"] if split_strand else [])]
    by_context = sites.groupBy("cell", "chrom", F.floor((F.col("pos") - 1) / bin_size).alias("bin"), *(["strand"] if split_strand else []), "context").agg(F.sum("mc").alias("mc"), F.sum("cov").alias("cov"))
    out = _by_pattern(by_context, patterns, keys).where("cov > 0").join(chrom_sizes.select("chrom", "size"), "chrom")
    extra = [F.col("strand").alias("strand_type")] if split_strand else []
    return out.select("cell", "chrom", (F.col("bin") * bin_size).alias("start"), F.least((F.col("bin") + 1) * bin_size, F.col("size")).alias("end"), "mc_type", *extra, "mc", "cov")


def count_regions(sites: DataFrame, regions: DataFrame, patterns: Sequence[str], region: str = "region") -> DataFrame:
    """Sums per cell, region and pattern over the sites in the region; only pairs with a site."""
    held = sites_in_regions(sites, regions, region)
    by_context = held.groupBy("cell", region, "context").agg(F.sum("mc").alias("mc"), F.sum("cov").alias("cov"))
    return _by_pattern(by_context, patterns, ["cell", region])


def dense(counts: DataFrame, cells: DataFrame, regions: DataFrame, mc_types: DataFrame) -> DataFrame:
    """Every cell, region and mc_type, 0 where ``counts`` has no row: as large as the dense matrix."""
    grid = cells.select("cell").crossJoin(regions.select("region")).crossJoin(mc_types.select("mc_type"))
    return grid.join(counts, list(KEY), "left").fillna(0, ["mc", "cov"])


def scores(counts: DataFrame, kind: str = "hypo", cutoff: float = 0.9) -> DataFrame:
    """``score``: binomial tail P(X > mc) of cov draws at the cell's overall rate, or for hyper 1 minus it; rows with
    cov above 0 and a score of at least ``cutoff``. A fully methylated region has hypo score 0."""
    totals = counts.groupBy("cell", "mc_type").agg(F.sum("mc").alias("__m"), F.sum("cov").alias("__c"))
    p = F.col("__m") / (F.col("__c") + 1e-6)
    scored = counts.where("cov > 0").join(totals, ["cell", "mc_type"]).withColumn("__t", binomial_tail(F.col("cov"), F.col("mc"), p))
    score = F.col("__t") if kind == "hypo" else 1 - F.col("__t")
    return scored.withColumn("score", score).where(F.col("score") >= cutoff).drop("__m", "__c", "__t")


def prior(counts: DataFrame, keys: Sequence[str] = ("cell", "mc_type")) -> DataFrame:
    """Per cell and mc_type: parameters a, b of the beta distribution with mean and variance of the raw fractions."""
    frac = F.try_divide(F.col("mc"), F.col("cov"))
    m, v = F.col("__mean"), F.col("__var")
    moments = counts.groupBy(*keys).agg(F.avg(frac).alias("__mean"), F.var_pop(frac).alias("__var"))
    a = F.try_divide((1 - m) * m * m, v) - m
    return moments.select(*keys, a.alias("prior_a"), (a * (F.try_divide(F.lit(1.0), m) - 1)).alias("prior_b"))


def posterior_frac(counts: DataFrame, normalize_per_cell: bool = True, clip: float | None = 10.0, keys: Sequence[str] = ("cell", "mc_type")) -> DataFrame:
    """``counts`` with ``frac``: posterior fraction under the cell's prior, divided by the prior's mean and clipped.
    Null where a cell has no prior (no covered region, or fractions without variance)."""
    a, b = F.col("prior_a"), F.col("prior_b")
    post = F.try_divide(F.col("mc") + a, F.col("cov") + a + b)
    if normalize_per_cell:
        post = F.try_divide(post, F.try_divide(a, a + b))
        if clip is not None:
            post = F.when(post.isNotNull(), F.least(post, F.lit(float(clip))))
    return counts.join(prior(counts, keys), list(keys)).withColumn("frac", post).drop("prior_a", "prior_b")


def add_m_value(fracs: DataFrame, alpha: float = 0.01) -> DataFrame:
    return fracs.withColumn("m_value", m_value(F.col("frac"), alpha))


def gch_rate(counts: DataFrame, gch: str = "GCHN", hch: str = "HCHN") -> DataFrame:
    """cell, region, ``rate``: (GCH - HCH) / (1 - HCH) of each region, at least 0, over the same of the whole cell."""
    two = counts.where(F.col("mc_type").isin(gch, hch))

    def corrected(keys: Sequence[str], name: str) -> DataFrame:
        s = {(t, c): F.sum(F.when(F.col("mc_type") == t, F.col(c))) for t in (gch, hch) for c in ("mc", "cov")}
        g, h = F.try_divide(s[gch, "mc"], s[gch, "cov"]), F.try_divide(s[hch, "mc"], s[hch, "cov"])
        return two.groupBy(*keys).agg(F.try_divide(g - h, 1 - h).alias(name))

    return corrected(["cell", "region"], "__r").join(corrected(["cell"], "__o"), "cell").select("cell", "region", F.try_divide(F.greatest("__r", F.lit(0.0)), F.col("__o")).alias("rate"))


def feature_cov_mean(counts: DataFrame, n_cells: int | None = None) -> DataFrame:
    """region, ``cov_mean``: mean over all cells of the cov of a region summed over mc_types; absent rows count as 0."""
    n = F.lit(n_cells) if n_cells is not None else F.col("__n")
    out = counts.groupBy("region").agg(F.sum("cov").alias("__cov"))
    if n_cells is None:
        out = out.crossJoin(counts.agg(F.count_distinct("cell").alias("__n")))
    return out.select("region", (F.col("__cov") / n).alias("cov_mean"))


def filter_feature_by_cov_mean(counts: DataFrame, min_cov: float = 0, max_cov: float = 999999) -> DataFrame:
    use = feature_cov_mean(counts).where((F.col("cov_mean") > min_cov) & (F.col("cov_mean") < max_cov))
    return counts.join(use.select("region"), "region", "left_semi")


def remove_chromosomes(regions: DataFrame, exclude: Sequence[str] | None = None, include: Sequence[str] | None = None) -> DataFrame:
    """Regions that are not on an excluded and, if given, on an included chromosome."""
    if exclude:
        regions = regions.where(~F.col("chrom").isin(*exclude))
    return regions.where(F.col("chrom").isin(*include)) if include else regions


def mean_dispersion(fracs: DataFrame) -> DataFrame:
    """region, mean, dispersion (unbiased variance over the absolute mean) of ``frac`` over the cells that have one."""
    return fracs.groupBy("region").agg(F.avg("frac").alias("mean"), F.var_samp("frac").alias("__v")).select("region", "mean", F.try_divide(F.col("__v"), F.abs("mean")).alias("dispersion"))


def highly_variable_features(fracs: DataFrame, cov_mean: DataFrame, n_top: int | None = None, min_disp: float = 0.5, max_disp: float | None = None, min_mean: float = 0, max_mean: float = 5, bin_min_features: int = 5, mean_binsize: float = 0.05, cov_binsize: float = 100) -> DataFrame:
    """region, mean, dispersion (log), cov, dispersion_norm, feature_select. Dispersions are standardised within bins of
    mean and mean coverage; bins of ``bin_min_features`` or fewer join the nearest larger bin (Manhattan distance, then
    the smaller mean bin, then the smaller cov bin). ``n_top``: the features of highest standardised dispersion (ties by
    region); else by the cutoffs. Regions are far fewer than cells, and bins far fewer than regions."""
    f = mean_dispersion(fracs).join(cov_mean, "region").select("region", "mean", F.ln(F.col("dispersion") + 1e-12).alias("dispersion"), F.col("cov_mean").alias("cov"))
    f = f.withColumns({"mb": F.floor(F.col("mean") / mean_binsize), "cb": F.floor(F.col("cov") / cov_binsize)})
    bins = f.groupBy("mb", "cb").agg(F.count("*").alias("__n"))
    large = bins.where(F.col("__n") > bin_min_features).select(F.col("mb").alias("use_mb"), F.col("cb").alias("use_cb"))
    near = bins.crossJoin(large).groupBy("mb", "cb").agg(F.min(F.struct((F.abs(F.col("mb") - F.col("use_mb")) + F.abs(F.col("cb") - F.col("use_cb"))).alias("d"), "use_mb", "use_cb")).alias("m")).select("mb", "cb", "m.use_mb", "m.use_cb")
    f = f.join(near, ["mb", "cb"])
    spread = f.groupBy("use_mb", "use_cb").agg(F.avg("dispersion").alias("__m"), F.stddev_samp("dispersion").alias("__s"))
    f = f.join(spread, ["use_mb", "use_cb"]).withColumn("dispersion_norm", F.try_divide(F.col("dispersion") - F.col("__m"), F.col("__s")))
    cols = ["region", "mean", "dispersion", "cov", "dispersion_norm"]
    if n_top is not None:
        top = f.orderBy(F.desc_nulls_last("dispersion_norm"), "region").limit(n_top).select("region", F.lit(True).alias("__top"))
        return f.join(top, "region", "left").select(*cols, F.coalesce("__top", F.lit(False)).alias("feature_select"))
    d = F.coalesce("dispersion_norm", F.lit(0.0))
    ok = (F.col("mean") > min_mean) & (F.col("mean") < max_mean) & (d > min_disp) & (d < (float("inf") if max_disp is None else max_disp))
    return f.select(*cols, ok.alias("feature_select"))


def merge_cluster(counts: DataFrame, clusters: DataFrame) -> DataFrame:
    """cluster, region, mc_type, mc, cov, frac: cells added up by cluster; region null is the cluster's overall row
    (one pass by grouping sets). ``clusters`` has cell, cluster; cells without one are left out."""
    joined = counts.join(clusters.select("cell", "cluster"), "cell")
    out = joined.groupingSets([["cluster", "region", "mc_type"], ["cluster", "mc_type"]], "cluster", "region", "mc_type").agg(F.sum("mc").alias("mc"), F.sum("cov").alias("cov"))
    return out.withColumn("frac", F.try_divide(F.col("mc"), F.col("cov")))


# The largest count of each kind of integer a table may be stored with.
LARGEST = {"bool": 1, "int8": 127, "uint8": 255, "int16": 32767, "uint16": 65535, "int32": 2147483647, "uint32": 4294967295, "int64": 9223372036854775807}


def clipped(counts: DataFrame, kind: str, columns: Sequence[str] = ("mc", "cov")) -> DataFrame:
    """``counts`` whose ``columns`` are at most what an integer of ``kind`` holds; they stay BIGINT."""
    if kind not in LARGEST:
        raise ValueError(f"unknown kind: {kind}")
    return counts.withColumns({c: F.least(F.col(c), F.lit(LARGEST[kind])) for c in columns})


def rebin(bins: DataFrame, bin_size: int, window: int, step: int) -> DataFrame:
    """Sums over sliding windows of ``window`` bins, every ``step`` bins, from rows of cell, chrom, start, mc_type, mc, cov."""
    i = F.floor(F.col("start") / bin_size)
    low = F.greatest(F.ceil((i - window + 1) / step), F.lit(0))
    out = bins.withColumn("w", F.explode(F.sequence(low, F.floor(i / step))))
    return out.groupBy("cell", "chrom", "mc_type", (F.col("w") * step * bin_size).alias("start")).agg(F.sum("mc").alias("mc"), F.sum("cov").alias("cov"))


def cpm(values: DataFrame, cell: str = "cell", value: str = "value") -> DataFrame:
    """``value`` per million of its cell's sum plus one."""
    total = values.groupBy(cell).agg(F.sum(value).alias("__s"))
    return values.join(total, cell).withColumn("cpm", F.col(value) / ((F.col("__s") + 1) / 1e6)).drop("__s")


def tf_idf(values: DataFrame, scale: float = 100000, row: str = "cell", col: str = "region", value: str = "value") -> DataFrame:
    """``tfidf`` of the non-zero values: log1p(x / row sum * scale) * log(1 + rows / column sum)."""
    v = values.where(F.col(value) != 0)
    rows, cols, n = v.groupBy(row).agg(F.sum(value).alias("__r")), v.groupBy(col).agg(F.sum(value).alias("__c")), values.agg(F.count_distinct(row).alias("__n"))
    return v.join(rows, row).join(cols, col).crossJoin(n).withColumn("tfidf", F.log1p(F.col(value) / F.col("__r") * scale) * F.ln(1 + F.col("__n") / F.col("__c"))).drop("__r", "__c", "__n")


def binarize(values: DataFrame, cutoff: float = 0.95, value: str = "value") -> DataFrame:
    return values.withColumn(value, (F.col(value) > cutoff).cast("tinyint"))


def filter_regions(values: DataFrame, n_cells: int, hypo_percent: float = 0.5, zscore_cutoff: float | None = None) -> DataFrame:
    """Regions with a non-zero value in more than ``hypo_percent`` per cent of the cells and, if asked, whose log2 count
    is within ``zscore_cutoff`` deviations of the mean of all."""
    nnz = values.groupBy("region").agg(F.count_if(F.col("value") > 0).alias("nnz"))
    use = nnz.where(F.col("nnz") > n_cells * hypo_percent / 100)
    if zscore_cutoff is not None:
        lg = F.log2("nnz")
        s = nnz.where("nnz > 0").agg(F.avg(lg).alias("__m"), F.stddev_pop(lg).alias("__s"))
        use = use.crossJoin(s).where(F.abs(F.try_divide(lg - F.col("__m"), F.col("__s"))) < zscore_cutoff)
    return use.select("region", "nnz")


def filter_by_dispersion(values: DataFrame, top: float = 0.5, n_cells: int | None = None) -> DataFrame:
    """The ``top`` share of regions by variance over mean of ``value`` (mean 0 as 1e-10), ties by region."""
    d = values.groupBy("region").agg((F.var_pop("value") / F.greatest(F.avg("value"), F.lit(1e-10))).alias("dispersion"))
    n = d.count()
    return d.orderBy(F.desc("dispersion"), "region").limit(int(n * top) if top < 1 else int(top)).select("region", "dispersion")


def log_scale(values: DataFrame, max_value: float = 10, with_mean: bool = False, value: str = "value", by: str = "region") -> DataFrame:
    """ln of ``value`` over its deviation per region (less its mean if asked), clipped to +-``max_value``."""
    lg = F.ln(value)
    s = values.groupBy(by).agg(F.avg(lg).alias("__m"), F.stddev_pop(lg).alias("__s"))
    v = F.try_divide(lg - (F.col("__m") if with_mean else 0), F.when(F.col("__s") == 0, 1.0).otherwise(F.col("__s")))
    return values.join(s, by).withColumn("scaled", F.greatest(F.least(v, F.lit(float(max_value))), F.lit(float(-max_value)))).drop("__m", "__s")


def min_max(values: DataFrame, low: float = 0.01, high: float = 0.9, value: str = "value") -> DataFrame:
    """``value`` scaled to 0..1 between two quantiles of all rows and clipped."""
    q = values.agg(F.percentile(value, low).alias("__lo"), F.percentile(value, high).alias("__hi"))
    return values.crossJoin(q).withColumn("scaled", F.greatest(F.least(F.try_divide(F.col(value) - F.col("__lo"), F.col("__hi") - F.col("__lo")), F.lit(1.0)), F.lit(0.0))).drop("__lo", "__hi")


def feature_order(matrix: DataFrame, partitions: int) -> DataFrame:
    """The matrix laid out by feature: range partitions of regions, sorted within."""
    return matrix.repartitionByRange(partitions, "region").sortWithinPartitions("region", "cell")


def sparse_vectors(values: DataFrame, index: DataFrame, value: str = "value") -> DataFrame:
    """cell, idx, val: each cell's row as sorted arrays, for spark.ml vectors. ``index`` has region, idx."""
    pairs = values.join(index, "region").groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("idx", F.col(value).alias("val")))).alias("p"))
    return pairs.select("cell", F.col("p.idx").alias("idx"), F.col("p.val").alias("val"))


def pseudo_bulk(values: DataFrame, groups: DataFrame, how: str = "sum", seed: int = 0) -> DataFrame:
    """Cells of a group as one: sum, mean, median, or downsample (one cell of the group, by a seeded hash)."""
    j = values.join(groups.select("cell", "pseudo"), "cell")
    if how == "downsample":
        pick = groups.groupBy("pseudo").agg(F.min_by("cell", F.struct(F.xxhash64(F.lit(seed), "cell"), "cell")).alias("cell"))
        return values.join(pick, "cell").select("pseudo", "region", "value")
    made: dict[str, Column] = {"sum": F.sum("value"), "mean": F.avg("value"), "median": F.median("value")}
    return j.groupBy("pseudo", "region").agg(made[how].alias("value"))

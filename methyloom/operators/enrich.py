"""Rank tests, enrichment and correlation per feature."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import bh_within, fisher_exact, normal_tail
from ..schema import few_values
from ..session import cut, small_table


def rank_sums(values: DataFrame, by: Sequence[str], label: str = "inside", value: str = "value") -> DataFrame:
    """``by``, n1, n2, auroc, z, p_value of the two-sided rank-sum test of ``value`` between rows with ``label`` true and
    false: average ranks, variance corrected for ties. Values are counted first, so a group's window runs over its
    distinct values."""
    counts = values.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count_if(F.col(label)).alias("__a"), F.count_if(~F.col(label)).alias("__b"))
    w = Window.partitionBy(*by).orderBy(value)
    t = F.col("__a") + F.col("__b")
    upto = F.sum(t).over(w)
    c = counts.select(*by, "__a", "__b", t.alias("__t"), (upto - (t - 1) / 2).alias("__r"))
    s = c.groupBy(*by).agg(F.sum("__a").alias("n1"), F.sum("__b").alias("n2"), F.sum(F.col("__a") * F.col("__r")).alias("__w"), F.sum(F.col("__t") * F.col("__t") * F.col("__t") - F.col("__t")).cast("double").alias("__ties"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u = F.col("__w") - n1 * (n1 + 1) / 2
    var = n1 * n2 / 12 * (n + 1 - F.try_divide(F.col("__ties"), n * (n - 1)))
    z = F.try_divide(u - n1 * n2 / 2, F.sqrt(var))
    return s.select(*by, "n1", "n2", F.try_divide(u, n1 * n2).alias("auroc"), z.alias("z")).withColumn("p_value", F.least(F.lit(1.0), 2 * normal_tail(F.abs("z"))))


def _capped(cells: DataFrame, most: int, seed: int) -> DataFrame:
    """At most ``most`` cells of each cluster, by a seeded hash; the ranking is limited in every task first."""
    w = Window.partitionBy("cluster").orderBy(F.xxhash64(F.lit(seed), "cell"), "cell")
    return cells.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= most).drop("__k")


def pairwise_dmg(values: DataFrame, cells: DataFrame, max_cells: int = 1000, adj_p_cutoff: float = 0.001, delta_cutoff: float = 0.3, auroc_cutoff: float = 0.9, top_n: int = 10000, seed: int = 0) -> DataFrame:
    """names, left_right, pvals_adj, delta, hypo_in, hyper_in, AUROC: features that differ between two clusters, for
    every pair of clusters. ``values``: cell, region, value; ``cells``: cell, cluster. Each cluster counts with at most
    ``max_cells`` cells. Values are counted per cluster and value before pairs are made, so what pairs multiply is
    counts, not cells."""
    use = values.join(_capped(cells, max_cells, seed), "cell").groupBy("region", "cluster", "value").agg(F.count("*").alias("n"))
    names = few_values(cells, "cluster", 10_000)
    both = [(a, b, c) for i, a in enumerate(names) for b in names[i + 1 :] for c in (a, b)]
    pairs = small_table(cells.sparkSession, **{k: pa.array([x[i] for x in both], pa.string()) for i, k in enumerate(("l", "r", "cluster"))})
    v = use.join(pairs, "cluster").withColumn("inside", F.col("cluster") == F.col("l"))
    by = ["region", "l", "r"]
    w = Window.partitionBy(*by).orderBy("value")
    c = v.groupBy(*by, "value").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("inside"), 0).otherwise(F.col("n"))).alias("b"))
    t = F.col("a") + F.col("b")
    c = c.select(*by, "value", "a", "b", t.alias("t"), (F.sum(t).over(w) - (t - 1) / 2).alias("rk"))
    s = c.groupBy(*by).agg(
        F.sum("a").cast("double").alias("n1"), F.sum("b").cast("double").alias("n2"), F.sum(F.col("a") * F.col("rk")).alias("w"), F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).cast("double").alias("ties"),
        F.sum(F.col("a") * F.col("value")).alias("s1"), F.sum(F.col("b") * F.col("value")).alias("s2"),
    ).where("n1 > 0 AND n2 > 0")
    n1, n2 = F.col("n1"), F.col("n2")
    u, n = F.col("w") - n1 * (n1 + 1) / 2, n1 + n2
    z = F.try_divide(u - n1 * n2 / 2, F.sqrt(n1 * n2 / 12 * (n + 1 - F.try_divide(F.col("ties"), n * (n - 1)))))
    s = s.select(*by, (F.col("s1") / n1 - F.col("s2") / n2).alias("delta"), (u / (n1 * n2)).alias("auc"), z.alias("z"))
    s = s.withColumn("p", F.coalesce(F.least(F.lit(1.0), 2 * normal_tail(F.abs("z"))), F.lit(1.0)))
    s = s.withColumn("pvals_adj", bh_within(F.col("p"), [F.col("l"), F.col("r")])).withColumn("AUROC", F.abs(F.col("auc") - 0.5) + 0.5)
    rank = F.row_number().over(Window.partitionBy("l", "r").orderBy(F.desc(F.abs("z")), "region"))
    s = s.withColumn("__k", rank).where((F.col("__k") <= top_n) & (F.col("pvals_adj") < adj_p_cutoff) & (F.abs("delta") > delta_cutoff) & (F.col("AUROC") > auroc_cutoff))
    low, high = F.when(F.col("delta") < 0, F.col("l")).otherwise(F.col("r")), F.when(F.col("delta") < 0, F.col("r")).otherwise(F.col("l"))
    return s.select(F.col("region").alias("names"), F.concat_ws("-", "l", "r").alias("left_right"), "pvals_adj", "delta", low.alias("hypo_in"), high.alias("hyper_in"), "AUROC")


def one_vs_rest(values: DataFrame, cells: DataFrame, adj_p_cutoff: float = 0.01, fc_cutoff: float = 0.8, auroc_cutoff: float = 0.8, top_n: int = 1000) -> DataFrame:
    """cluster, names, pvals_adj, fc, AUROC: features lower in a cluster than in all other cells. Counts per cluster and
    value are made once; the rest of a cluster is the total less its own."""
    own = values.join(cells, "cell").groupBy("region", "value", "cluster").agg(F.count("*").alias("a"))
    w = Window.partitionBy("region").orderBy("value")
    totals = own.groupBy("region", "value").agg(F.sum("a").alias("t"))
    ranked = totals.select("region", "value", "t", (F.sum("t").over(w) - (F.col("t") - 1) / 2).alias("rk"))
    whole = totals.groupBy("region").agg(F.sum("t").cast("double").alias("n"), F.sum(F.col("t") * F.col("value")).alias("sum"), F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).cast("double").alias("ties"))
    s = own.join(ranked, ["region", "value"]).groupBy("region", "cluster").agg(F.sum("a").cast("double").alias("n1"), F.sum(F.col("a") * F.col("rk")).alias("w"), F.sum(F.col("a") * F.col("value")).alias("s1")).join(whole, "region")
    n1, n = F.col("n1"), F.col("n")
    n2 = n - n1
    u = F.col("w") - n1 * (n1 + 1) / 2
    z = F.try_divide(u - n1 * n2 / 2, F.sqrt(n1 * n2 / 12 * (n + 1 - F.try_divide(F.col("ties"), n * (n - 1)))))
    fc = F.try_divide(F.col("s1") / n1, F.try_divide(F.col("sum") - F.col("s1"), n2))
    s = s.select("cluster", F.col("region").alias("names"), fc.alias("fc"), F.try_divide(u, n1 * n2).alias("auc"), z.alias("z"))
    s = s.withColumn("p", F.coalesce(F.least(F.lit(1.0), 2 * normal_tail(F.abs("z"))), F.lit(1.0))).withColumn("pvals_adj", bh_within(F.col("p"), [F.col("cluster")])).withColumn("AUROC", F.abs(F.col("auc") - 0.5) + 0.5)
    s = s.withColumn("__k", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("z"), "names")))
    return s.where((F.col("__k") <= top_n) & (F.col("pvals_adj") < adj_p_cutoff) & (F.col("fc") < fc_cutoff) & (F.col("AUROC") > auroc_cutoff)).select("cluster", "names", "pvals_adj", "fc", "AUROC")


def aggregate_dmg(dmg: DataFrame) -> DataFrame:
    """hypo_in, names, score, rank: features of a cluster by the sum of AUROC times the pair's similarity (ties by name)."""
    s = dmg.groupBy("hypo_in", "names").agg(F.sum(F.col("AUROC") * F.col("similarity")).alias("score"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("hypo_in").orderBy(F.desc("score"), "names")))


def pair_similarity(centres: DataFrame) -> DataFrame:
    """left_right, similarity: 1 - distance / largest distance of every ordered pair of cluster centres. One row per
    cluster goes in; pairs of clusters, not of cells."""
    a, b = centres.select(F.col("cluster").alias("l"), F.col("centre").alias("x")), centres.select(F.col("cluster").alias("r"), F.col("centre").alias("y"))
    d = a.crossJoin(b).select("l", "r", F.sqrt(F.aggregate(F.zip_with("x", "y", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)).alias("d"))
    return d.crossJoin(d.agg(F.max("d").alias("most"))).select(F.concat_ws("-", "l", "r").alias("left_right"), (1 - F.try_divide(F.col("d"), F.col("most"))).alias("similarity"))


def cluster_enrichment(values: DataFrame, cells: DataFrame, counts: bool = False) -> DataFrame:
    """cluster, region, enrichment of ``value`` in a cluster against all other cells. Fractions: share of cells with a
    value below 1, inside over outside, times mean outside over inside. ``counts``: share of non-zero cells, times mean
    inside over outside. Absent values count as 1 (fractions) or 0 (counts). Clusters of one cell are left out."""
    base = 0.0 if counts else 1.0
    hit = F.count_if(F.col("value") > 0) if counts else F.count_if(F.col("value") < 1)
    s = values.join(cells, "cell").groupBy("cluster", "region").agg(hit.cast("double").alias("hits"), F.sum(F.col("value") - base).alias("part"))
    whole = s.groupBy("region").agg(F.sum("hits").alias("all_hits"), F.sum("part").alias("all_part"))
    sizes = cells.groupBy("cluster").agg(F.count("*").cast("double").alias("size")).crossJoin(cells.agg(F.count("*").cast("double").alias("cells"))).where("size > 1")
    grid = sizes.crossJoin(whole).join(s, ["cluster", "region"], "left").fillna(0.0, ["hits", "part"])
    n, m = F.col("size"), F.col("cells") - F.col("size")
    inside, outside = F.col("part") / n + base, F.try_divide(F.col("all_part") - F.col("part"), m) + base
    share = (F.col("hits") / n + 0.1) / (F.try_divide(F.col("all_hits") - F.col("hits"), m) + 0.1)
    ratio = (inside + 0.01) / (outside + 0.01) if counts else (outside + 0.01) / (inside + 0.01)
    return grid.select("cluster", "region", (share * ratio).alias("enrichment"))


def enriched_features(values: DataFrame, cells: DataFrame, top_n: int = 200, alpha: float = 0.1, seed: int = 0) -> DataFrame:
    """cluster, region, enrichment, p_value, q_value, rank: features whose enrichment exceeds that under shuffled
    labels (p = share of the cluster's null scores that are larger, q by Benjamini-Hochberg in the cluster), the
    ``top_n`` of each cluster by enrichment with q up to ``alpha``, ties by region."""
    real = cluster_enrichment(values, cells)
    # labels are dealt again to the cells in the order of a seeded digest
    from .ranking import global_rank

    dealt = global_rank(cells.select("cell", F.md5(F.concat(F.lit(f"{seed}:"), "cell")).alias("h")), None, [F.col("h"), F.col("cell")]).select("cell", "rank")
    labels = global_rank(cells.select("cluster", "cell"), None, [F.col("cell")]).select("cluster", "rank")
    null = cluster_enrichment(values, dealt.join(labels, "rank").select("cell", "cluster")).select("cluster", F.col("enrichment").alias("e"), F.lit(1).alias("shuffled"))
    both = real.select("cluster", "region", F.col("enrichment").alias("e"), F.lit(0).alias("shuffled")).unionByName(null.withColumn("region", F.lit(None).cast("string")))
    w = Window.partitionBy("cluster").orderBy(F.desc("e")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    p = F.try_divide(F.sum("shuffled").over(w), F.sum("shuffled").over(Window.partitionBy("cluster")))
    tested = both.withColumn("p_value", p).where("shuffled = 0").withColumn("q_value", bh_within(F.col("p_value"), [F.col("cluster")]))
    ok = tested.where(F.col("q_value") <= alpha).withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("e"), "region")))
    return ok.where(F.col("rank") <= top_n).select("cluster", "region", F.col("e").alias("enrichment"), "p_value", "q_value", "rank")


def motif_enrichment(hits: DataFrame, inside: DataFrame, background: DataFrame) -> DataFrame:
    """motif, tp, fp, fn, tn, log2_or, p_value, q_value: Fisher's exact test of motif hits (region, motif) in ``inside``
    against ``background`` regions; counts are one higher than seen."""
    i, b = inside.select("region", F.lit(1).alias("__in")), background.select("region", F.lit(0).alias("__in"))
    both = i.unionByName(b)
    total = both.agg(F.sum("__in").alias("ni"), (F.count("*") - F.sum("__in")).alias("nb"))
    c = hits.select("region", "motif").distinct().join(both, "region").groupBy("motif").agg(F.sum("__in").alias("hi"), (F.count("*") - F.sum("__in")).alias("hb")).crossJoin(total)
    c = c.select("motif", (F.col("hi") + 1).alias("tp"), (F.col("hb") + 1).alias("fp"), (F.col("ni") - F.col("hi") + 1).alias("fn"), (F.col("nb") - F.col("hb") + 1).alias("tn"))
    c = c.withColumn("log2_or", F.log2((F.col("tp") * F.col("tn")) / (F.col("fp") * F.col("fn")))).withColumn("p_value", fisher_exact(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")))
    return c.withColumn("q_value", bh_within(F.col("p_value"), [F.lit(1)]))


def optimal_threshold(values: DataFrame, by: Sequence[str], label: str = "inside", value: str = "score") -> DataFrame:
    """``by``, threshold, youden: the value at which true less false positive rate is largest (the highest such)."""
    c = values.groupBy(*by, value).agg(F.count_if(F.col(label)).alias("a"), F.count_if(~F.col(label)).alias("b"))
    down, whole = Window.partitionBy(*by).orderBy(F.desc(value)), Window.partitionBy(*by)
    j = F.try_divide(F.sum("a").over(down), F.sum("a").over(whole)) - F.try_divide(F.sum("b").over(down), F.sum("b").over(whole))
    return c.withColumn("j", j).groupBy(*by).agg(F.max(F.struct("j", value)).alias("m")).select(*by, F.col("m")[value].alias("threshold"), F.col("m.j").alias("youden"))


def holm_sidak(p: str, by: Sequence[str]) -> Column:
    """Holm-Sidak corrected p-values within small groups."""
    w = Window.partitionBy(*by).orderBy(p)
    n, k = F.count("*").over(Window.partitionBy(*by)), F.row_number().over(w)
    return F.least(F.lit(1.0), F.max(1 - F.pow(1 - F.col(p), n - k + 1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def recovery_enrichment(ranks: DataFrame, total_regions: int, auc_threshold: float = 0.005, nes_threshold: float = 3.0) -> DataFrame:
    """motif, auc, nes of recovery curves: ``ranks`` has motif and the rank (from 0) of each region of interest. The
    area counts, over the first ``auc_threshold`` of all regions, how many regions of interest were found; nes is the
    area's z-score over motifs."""
    most = int(round(auc_threshold * total_regions))
    n = F.count("*")
    area = F.sum(F.when(F.col("rank") < most, most - F.col("rank")).otherwise(0)) / (most * n)
    a = ranks.groupBy("motif").agg(area.alias("auc"))
    s = a.agg(F.avg("auc").alias("__m"), F.stddev_pop("auc").alias("__s"))
    return a.crossJoin(s).select("motif", "auc", F.try_divide(F.col("auc") - F.col("__m"), F.col("__s")).alias("nes")).where(F.col("nes") >= nes_threshold)


def pair_correlations(a: DataFrame, b: DataFrame, pairs: DataFrame, a_id: str, b_id: str, method: str = "pearson", average_ranks: bool = True) -> DataFrame:
    """``pairs`` with ``corr``: correlation over the samples both have. ``a``: ``a_id``, sample, value; ``b`` alike.
    Spearman ranks share the mean rank of ties, or, without ``average_ranks``, break them by sample."""
    if method == "spearman":
        a, b = (_ranked(x, i, average_ranks) for x, i in ((a, a_id), (b, b_id)))
    j = pairs.join(a.withColumnRenamed("value", "__x"), a_id).join(b.withColumnRenamed("value", "__y"), [b_id, "sample"])
    j = j.where("__x IS NOT NULL AND __y IS NOT NULL")
    r = j.groupBy(a_id, b_id).agg(F.try_divide(F.covar_pop("__x", "__y"), F.stddev_pop("__x") * F.stddev_pop("__y")).alias("corr"))
    return pairs.join(r, [a_id, b_id], "left")


def _ranked(x: DataFrame, ident: str, average: bool) -> DataFrame:
    x = x.where("value IS NOT NULL")
    w = Window.partitionBy(ident).orderBy("value", *([] if average else ["sample"]))
    if not average:
        return x.withColumn("value", F.row_number().over(w).cast("double"))
    ties = F.count("*").over(Window.partitionBy(ident, "value"))
    return x.withColumn("value", F.rank().over(w) + (ties - 1) / 2)


def regressed(values: DataFrame, covariates: DataFrame, ident: str) -> DataFrame:
    """``value`` less its least-squares fit on two covariates of the sample (sample, u, v), standardised per ``ident``.
    Missing values take the mean of their row first. Normal equations from sums, no matrix per row."""
    j = values.join(covariates, "sample")
    w = Window.partitionBy(ident)
    j = j.withColumn("value", F.coalesce("value", F.avg("value").over(w)))
    c = {k: F.col(k) - F.avg(k).over(w) for k in ("value", "u", "v")}
    j = j.select(ident, "sample", *[x.alias(k) for k, x in c.items()])
    s = {f"s{p}{q}": F.sum(F.col(x) * F.col(y)).over(w) for p, x in zip("yuv", ("value", "u", "v")) for q, y in zip("yuv", ("value", "u", "v"))}
    det = s["suu"] * s["svv"] - s["suv"] * s["suv"]
    bu, bv = F.try_divide(s["suy"] * s["svv"] - s["svy"] * s["suv"], det), F.try_divide(s["svy"] * s["suu"] - s["suy"] * s["suv"], det)
    r = j.select(ident, "sample", (F.col("value") - F.coalesce(bu * F.col("u") + bv * F.col("v"), F.lit(0.0))).alias("value"))
    return r.withColumn("value", F.try_divide(F.col("value") - F.avg("value").over(w), F.stddev_pop("value").over(w)))


def correlation_cutoff(real: DataFrame, null: DataFrame, direction: str = "-", alpha: float = 0.05) -> DataFrame:
    """cutoff, fdr, n: of the thresholds 0.80, 0.79, ..., 0.20 the loosest whose share of null over real pairs beyond it
    stays under ``alpha`` down from the strictest. Pairs are counted per hundredth, then compared."""
    sign = -1 if direction == "-" else 1

    def tally(x: DataFrame, name: str) -> DataFrame:
        level = F.least(F.floor(F.col("corr") * sign * 100 + 1e-9), F.lit(80))
        return x.where((F.col("corr") * sign) > 0.2).groupBy(level.cast("int").alias("k")).agg(F.count("*").alias(name))

    sizes = real.agg(F.count("corr").alias("nr")).crossJoin(null.agg(F.count("corr").alias("nn")))
    grid = real.sparkSession.range(20, 81).select(F.col("id").cast("int").alias("k")).join(tally(real, "r"), "k", "left").join(tally(null, "n"), "k", "left").fillna(0)
    down = Window.orderBy(F.desc("k"))
    grid = grid.crossJoin(sizes).select("k", F.sum("r").over(down).alias("n"), F.try_divide(F.try_divide(F.sum("n").over(down), F.col("nn")), F.try_divide(F.sum("r").over(down), F.col("nr"))).alias("fdr"))
    grid = grid.withColumn("bad", F.sum(F.when((F.col("fdr") >= alpha) & F.col("fdr").isNotNull(), 1).otherwise(0)).over(down))
    return grid.where((F.col("bad") == 0) & (F.col("n") > 0)).orderBy("k").limit(1).select((F.col("k") / 100).alias("cutoff"), "fdr", "n")


def greedy_panel(votes: DataFrame, min_support: int = 2) -> list[str]:
    """Genes so that every pair has ``min_support`` chosen ones, or all its genes if it has no more. ``votes``: pair,
    gene. Genes of the pairs that need all theirs come first, as every panel holds them; then each time the gene that
    helps most open pairs (ties by name). A pass chooses every gene that comes before all others of each open pair it is
    in: what helps less, or shares no open pair, can't change its turn. Passes end when no pair is open. Only the panel
    comes to the driver."""
    chosen: list[str] = []
    open_ = cut(votes.where("pair IS NOT NULL AND gene IS NOT NULL").select("pair", "gene", F.lit(min_support).alias("need")).distinct())
    few = open_.groupBy("pair").agg(F.count("*").alias("n")).where(F.col("n") <= min_support).select("pair")
    picked = cut(open_.join(few, "pair", "left_semi").groupBy("gene").agg(F.count("*").alias("n")))
    while True:
        chosen += [r.gene for r in picked.orderBy(F.desc("n"), "gene").collect()]
        hits = open_.join(picked.select("gene"), "gene", "left_semi").groupBy("pair").agg(F.count("*").cast("int").alias("hits"))
        left = open_.join(hits, "pair", "left").withColumn("need", F.col("need") - F.coalesce("hits", F.lit(0))).where("need > 0")
        open_ = cut(left.join(picked.select("gene"), "gene", "left_anti").select("pair", "gene", "need"))
        if open_.isEmpty():
            return chosen
        helps = open_.groupBy("gene").agg(F.count("*").alias("n"))
        first = open_.join(helps, "gene").groupBy("pair").agg(F.min(F.struct((-F.col("n")).alias("n"), "gene")).alias("f")).groupBy("f").agg(F.count("*").alias("pairs"))
        picked = cut(first.where("pairs = -f.n").select("f.gene", F.col("pairs").alias("n")))

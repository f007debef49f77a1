"""Differential sites and regions between samples."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import benjamini_hochberg
from ..session import cut
from .ranking import exact_quantiles


def downsampled(mc: Column, uc: Column, n_samples: Column, max_row: int = 50, max_total: int = 3000) -> tuple[Column, Column]:
    """Counts of a sample with more reads than max(10, min(max_total / samples, max_row)) at that many, cut to whole."""
    most = F.greatest(F.lit(10.0), F.least(max_total / n_samples, F.lit(float(max_row))))
    total = mc + uc
    return tuple(F.when(total > most, F.floor(most * (x / total))).otherwise(x).cast("long") for x in (mc, uc))  # type: ignore[return-value]


def residuals(sites: DataFrame) -> DataFrame:
    """``residual`` of each sample's methylated count at its site under independence, adjusted for both margins; null
    where a margin is empty or full."""
    w = Window.partitionBy("chrom", "pos")
    row, col, all_ = F.col("cov"), F.sum("mc").over(w), F.sum("cov").over(w)
    e = F.try_divide(row * col, all_)
    spread = e * (1 - F.try_divide(row, all_)) * (1 - F.try_divide(col, all_))
    return sites.withColumn("residual", F.when(spread > 0, F.try_divide(F.col("mc") - e, F.sqrt(spread))))


def goodness_of_fit(sites: DataFrame) -> DataFrame:
    """chrom, pos, n, m, s: root mean square distance of the samples' (mc, uc) from independence."""
    w = Window.partitionBy("chrom", "pos")
    row, col, all_, n = F.col("cov"), F.sum("mc").over(w), F.sum("cov").over(w), F.count("*").over(w)
    e = F.try_divide(row * col, all_)
    d = (F.col("mc") - e) * (F.col("mc") - e) * 2  # the two columns of a row differ by the same amount
    return sites.select("chrom", "pos", d.alias("d"), n.alias("n"), all_.alias("m")).groupBy("chrom", "pos").agg(F.max("n").alias("n"), F.max("m").alias("m"), F.sqrt(F.sum("d") / 2 / F.max("n")).alias("s"))


def permutation_p(table: np.ndarray, n_permute: int, min_p: float, rng: np.random.Generator, uniform: bool = False, normal: bool = False) -> float:
    """p-value of the root mean square test of a (samples x 2) table: counts start at 1; once more permuted tables than
    ``n_permute * min_p`` fit worse, the share so far is returned. Samples without reads are never drawn and fit in every
    table, so they are left out; draws come in runs that grow, as most sites are decided early. With ``normal`` the result is the upper tail of the
    normal distribution with the moments of the permuted statistics so far, at least 1e-14."""
    if not uniform:
        table = table[table.sum(1) > 0]
    n, m = len(table), int(table.sum())
    if m == 0 or n < 2:
        return 1.0

    def fit(t: np.ndarray) -> np.ndarray:
        # both columns of a row are as far from what is expected
        first = t[:, :, 0]
        d = first - (first + t[:, :, 1]) * (first.sum(1, keepdims=True) / m)
        return np.sqrt(np.einsum("ij,ij->i", d, d) / n)

    real = fit(table[None].astype(float))[0]
    if real <= 1e-12:  # no table fits better, as where one sample alone has reads
        return 1.0
    e = table.sum(1, keepdims=True) * table.sum(0, keepdims=True) / m
    p = np.full(2 * n, 0.5 / n) if uniform else np.maximum((e / m).ravel(), 0)
    p = p / p.sum()
    worse, done, size, seen = 1, 0, 64, []
    while done < n_permute:
        size = min(2 * size, 1024, n_permute - done)
        s = fit(rng.multinomial(m, p, size).reshape(size, n, 2).astype(float))
        run = worse + np.cumsum(s >= real - 1e-12)
        over = np.flatnonzero(run > n_permute * min_p)
        if len(over):
            i = done + int(over[0])
            if normal:
                return _normal_p(np.concatenate([*seen, s[: over[0]]]), real)
            return float(run[over[0]] / (i + 2))
        worse, done = int(run[-1]), done + size
        seen.append(s)
    return _normal_p(np.concatenate(seen), real) if normal else min(1.0, worse / n_permute)


def _normal_p(statistics: np.ndarray, real: float) -> float:
    sd = statistics.std() if len(statistics) else 0.0
    return 1.0 if sd == 0 else max(0.5 * math.erfc((real - statistics.mean()) / sd / math.sqrt(2)), 1e-14)


def rms_test(mc: Column, cov: Column, seed: Column, n_permute: int = 3000, min_p: float = 0.034, uniform: bool = False, normal: bool = False) -> Column:
    """The permutation test of one site from its samples' arrays of mc and cov. Draws come from ``seed`` (a BIGINT of the
    site), so a row gives the same p-value wherever it runs. Null arrays give null; the arrays of a row are of one length."""

    @F.arrow_udf("double")
    def test(mc: pa.Array, cov: pa.Array, seed: pa.Array) -> pa.Array:
        null = np.asarray(mc.is_null()) | np.asarray(cov.is_null())
        begins = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(cov), 0).to_numpy(zero_copy_only=False))]
        a, b = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (mc, cov))
        seeds = seed.fill_null(0).to_numpy(zero_copy_only=False)
        out = np.ones(len(null))
        # sites with reads in one sample, or whose reads are all alike, fit perfectly
        some = np.r_[0, np.cumsum(b > 0)][begins]
        low, all_ = (np.r_[0, np.cumsum(v)][begins] for v in (a, b))
        open_ = ~null & (uniform | (np.diff(some) > 1) & (np.diff(low) > 0) & (np.diff(low) < np.diff(all_)))
        for i in np.flatnonzero(open_):
            m, c = a[begins[i] : begins[i + 1]], b[begins[i] : begins[i + 1]]
            out[i] = permutation_p(np.stack([m, c - m], 1), n_permute, min_p, np.random.default_rng(int(seeds[i]) & 0xFFFFFFFFFFFFFFFF), uniform, normal)
        return pa.array(out, mask=null)

    return test(mc, cov, seed)


def call_dms(sites: DataFrame, samples: Sequence[str], n_permute: int = 3000, min_p: float = 0.034, p_cutoff: float | None = 0.01, max_row: int = 50, max_total: int = 3000, estimate_p: bool = False) -> DataFrame:
    """chrom, pos, p_value, q_value and the arrays mc, cov, frac, residual in the order of ``samples`` (absent samples
    as 0, their frac and residual null). One row per site: the samples of a site, not its reads, meet in a row. Sites
    with p above ``p_cutoff`` are left out after q-values were taken over all. ``estimate_p``: p-values from a normal
    distribution fitted to the permuted statistics, which go below one in ``n_permute``."""
    at = F.create_map(*[F.lit(x) for i, s in enumerate(samples) for x in (s, i)])
    long = residuals(sites.where(F.col("sample").isin(*samples)).groupBy("chrom", "pos", "sample").agg(F.sum("mc").alias("mc"), F.sum("cov").alias("cov")))
    packed = long.groupBy("chrom", "pos").agg(F.map_from_entries(F.collect_list(F.struct(F.element_at(at, F.col("sample")), F.struct("mc", "cov", "residual")))).alias("m"))
    places = F.array(*[F.lit(i) for i in range(len(samples))])
    packed = packed.select(
        "chrom",
        "pos",
        F.transform(places, lambda i: F.coalesce(F.try_element_at("m", i)["mc"], F.lit(0))).alias("mc"),
        F.transform(places, lambda i: F.coalesce(F.try_element_at("m", i)["cov"], F.lit(0))).alias("cov"),
        F.transform(places, lambda i: F.try_element_at("m", i)["residual"]).alias("residual"),
    )
    packed = packed.withColumn("frac", F.zip_with("mc", "cov", lambda m, c: F.try_divide(m, c)))
    small = F.zip_with("mc", "cov", lambda m, c: F.struct(*[x.alias(k) for x, k in zip(downsampled(m, c - m, F.lit(len(samples)), max_row, max_total), ("m", "u"))]))
    packed = packed.withColumn("__s", small)
    test = rms_test(F.transform("__s", lambda s: s["m"]), F.transform("__s", lambda s: s["m"] + s["u"]), F.xxhash64("chrom", "pos"), n_permute, min_p, normal=estimate_p)
    # kept, because a range sort reads its input twice and the draws are the dear part
    tested = benjamini_hochberg(cut(packed.withColumn("p_value", test).drop("__s")), "p_value", "q_value")
    return tested.where(F.col("p_value") <= p_cutoff) if p_cutoff is not None else tested


class _Chain:
    """Breaks between sites that follow each other."""

    def __init__(self, before: tuple | None, max_dist: int, corr_cutoff: float | None):
        self.before, self.max_dist, self.corr_cutoff = before, max_dist, corr_cutoff

    def breaks(self, chrom: np.ndarray, pos: np.ndarray, frac: np.ndarray) -> np.ndarray:
        """True where a site does not go on with the one before it."""
        if self.before is not None:
            chrom, pos, frac = np.r_[np.array([self.before[0]], dtype=object), chrom], np.r_[self.before[1], pos], np.vstack([self.before[2], frac])
        new = np.ones(len(chrom), bool)
        new[1:] = (chrom[1:] != chrom[:-1]) | (pos[1:] - pos[:-1] >= self.max_dist)
        if self.corr_cutoff is not None and len(chrom) > 1:
            a, b = frac[:-1], frac[1:]
            a, b = a - a.mean(1, keepdims=True), b - b.mean(1, keepdims=True)
            with np.errstate(invalid="ignore", divide="ignore"):
                r = (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1))
            new[1:] |= ~(r > self.corr_cutoff)
        out = new[1:] if self.before is not None else new
        self.before = (chrom[-1], int(pos[-1]), frac[-1])
        return out


def chain_sites(sites: DataFrame, max_dist: int = 250, corr_cutoff: float | None = 0.3) -> DataFrame:
    """``sites`` (chrom, pos, frac ARRAY<DOUBLE>, ...) with ``island``, counted from 0 in each chromosome: a new one
    begins where the distance to the site before is ``max_dist`` or more, or the correlation of the two sites' fractions
    (nulls as 1) is not above ``corr_cutoff``.

    A global range sort by chrom and pos kept in the shared folder; the driver gets the last site and the number of
    breaks per chromosome of each partition, from which each partition's start follows; so a chromosome is not one task.
    """
    parts = int(sites.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = cut(sites.repartitionByRange(parts, "chrom", "pos").sortWithinPartitions("chrom", "pos"))
    ci, pi, fi = (held.columns.index(c) for c in ("chrom", "pos", "frac"))

    def arrays(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return b.column(ci).to_pandas().to_numpy(dtype=object), b.column(pi).to_numpy(zero_copy_only=False), np.array([[1.0 if v is None else v for v in f] for f in b.column(fi).to_pylist()], dtype=np.float64).reshape(b.num_rows, -1)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            if b.num_rows:
                c, p, f = arrays(b.slice(b.num_rows - 1))
                last = (str(c[0]), int(p[0]), f[0].tolist())
        if last:
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "chrom": [last[0]], "pos": [last[1]], "frac": [last[2]]})

    last = sorted((r.part, (r.chrom, r.pos, np.array(r.frac))) for r in held.mapInArrow(ends, "part INT, chrom STRING, pos BIGINT, frac ARRAY<DOUBLE>").collect())
    entering = {p: last[i - 1][1] for i, (p, _) in enumerate(last) if i}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        chain, found = _Chain(entering.get(part), max_dist, corr_cutoff), {}
        for b in batches:
            if b.num_rows:
                c, p, f = arrays(b)
                new = chain.breaks(c, p, f)
                for name in dict.fromkeys(c):
                    found[name] = found.get(name, 0) + int(new[c == name].sum())
        yield pa.RecordBatch.from_pydict({"part": pa.array([part] * len(found), pa.int32()), "chrom": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.int64())})

    before: dict[tuple[int, str], int] = {}
    seen: dict[str, int] = {}
    for part, chrom, n in sorted((r.part, r.chrom, r.n) for r in held.mapInArrow(count, "part INT, chrom STRING, n BIGINT").collect()):
        before[part, chrom] = seen.get(chrom, 0)
        seen[chrom] = seen.get(chrom, 0) + n

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        chain, run = _Chain(entering.get(part), max_dist, corr_cutoff), {}
        for b in batches:
            if not b.num_rows:
                continue
            c, p, f = arrays(b)
            new, island = chain.breaks(c, p, f), np.zeros(b.num_rows, np.int64)
            for name in dict.fromkeys(c):
                sel = c == name
                at = run.get(name, before[part, name]) + np.cumsum(new[sel])
                island[sel], run[name] = at - 1, int(at[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(island)], names=[*b.schema.names, "island"])

    from pyspark.sql.types import LongType, StructField, StructType

    return held.mapInArrow(label, StructType([*held.schema.fields, StructField("island", LongType())]))


def call_dmr(dms: DataFrame, samples: Sequence[str], p_cutoff: float = 0.001, frac_delta: float = 0.2, max_dist: int = 250, residual_quantile: float = 0.6, corr_cutoff: float | None = 0.3, dms_ratio: float = 0.8) -> DataFrame:
    """dmr (chrom-island), chrom, start, end, length, ndms, sample, mc, cov, frac, state: regions of sites with
    p <= ``p_cutoff`` and a range of fractions of at least ``frac_delta``, one row per region and sample. A sample's
    state is -1 (low) or 1 (high residuals) where the mean of its sites' states reaches ``dms_ratio``, else 0; a site's
    state comes from the chromosome's quantiles of all residuals."""
    use = dms.where((F.col("p_value") <= p_cutoff) & (F.array_max(F.filter("frac", lambda x: x.isNotNull())) - F.array_min(F.filter("frac", lambda x: x.isNotNull())) >= frac_delta))
    chained = cut(chain_sites(use.select("chrom", "pos", "mc", "cov", "frac", "residual"), max_dist, corr_cutoff))
    q = max(residual_quantile, 1 - residual_quantile)
    long = chained.select("chrom", "pos", "island", F.posexplode(F.arrays_zip("mc", "cov", "residual")).alias("i", "v")).select("chrom", "pos", "island", "i", "v.mc", "v.cov", "v.residual")
    cuts = exact_quantiles(long.select("chrom", "residual"), "residual", [1 - q, q], by="chrom")
    state = F.when(F.col("residual") < F.col("q0"), -1).when(F.col("residual") > F.col("q1"), 1).otherwise(0)
    mean = F.avg(state)
    out = long.join(cuts, "chrom", "left").groupBy("chrom", "island", "i").agg(
        (F.min("pos") - 1).alias("start"), (F.max("pos") + 1).alias("end"), F.count("*").alias("ndms"), F.sum("mc").alias("mc"), F.sum("cov").alias("cov"),
        F.when(F.abs(mean) >= dms_ratio, F.signum(mean)).otherwise(0).cast("tinyint").alias("state"),
    )
    names = F.array(*[F.lit(s) for s in samples])
    return out.select(F.concat_ws("-", "chrom", F.col("island").cast("string")).alias("dmr"), "chrom", "start", "end", (F.col("end") - F.col("start")).alias("length"), "ndms", names[F.col("i")].alias("sample"), "mc", "cov", F.try_divide("mc", "cov").alias("frac"), "state")


def collapse_replicates(states: DataFrame, groups: DataFrame) -> DataFrame:
    """dmr, sample (the group), state: the state all replicates of a group share, else 0. ``groups`` has sample, group."""
    same = F.when(F.min("state") == F.max("state"), F.min("state")).otherwise(0).cast("tinyint")
    return states.join(groups, "sample").groupBy("dmr", "group").agg(same.alias("state")).withColumnRenamed("group", "sample")


def hypo_hyper(states: DataFrame, sample: str, kind: str = "hypo") -> DataFrame:
    """dmr of the regions with state -1 (hypo) or 1 (hyper) in a sample."""
    return states.where((F.col("sample") == sample) & (F.col("state") == (-1 if kind == "hypo" else 1))).select("dmr")


def pairwise_differential(states: DataFrame, a: str, b: str, kind: str = "hypo") -> DataFrame:
    """dmr, ``where`` (a_not_b, a_and_b or b_not_a) of the regions that are hypo (hyper) in either sample; one pass."""
    wanted = -1 if kind == "hypo" else 1
    hit = states.where(F.col("sample").isin(a, b) & (F.col("state") == wanted)).groupBy("dmr").agg(F.bool_or(F.col("sample") == a).alias("__a"), F.bool_or(F.col("sample") == b).alias("__b"))
    return hit.select("dmr", F.when(F.col("__a") & F.col("__b"), "a_and_b").when(F.col("__a"), "a_not_b").otherwise("b_not_a").alias("where"))


def scaled_m_values(sites: DataFrame) -> DataFrame:
    """``m_scaled``: log2((mc + 0.1) / (uc + 0.1)) of each sample, standardised over the samples of its site."""
    w = Window.partitionBy("chrom", "pos")
    m = F.log2((F.col("mc") + 0.1) / (F.col("cov") - F.col("mc") + 0.1))
    return sites.withColumn("__m", m).withColumn("m_scaled", F.try_divide(F.col("__m") - F.avg("__m").over(w), F.stddev_pop("__m").over(w))).drop("__m")



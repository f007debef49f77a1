"""Statistics that Spark SQL lacks: tail probabilities on Arrow batches, and distributed multiple-test correction."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

# Coefficients of the Lanczos approximation of the gamma function (g = 7, n = 9).
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for positive numbers."""
    x = np.asarray(x, np.float64)
    small = x < 0.5
    y = np.where(small, 1 - x, x) - 1
    s = _LANCZOS[0] + sum(c / (y + i) for i, c in enumerate(_LANCZOS[1:], 1))
    t = y + 7.5
    out = 0.5 * math.log(2 * math.pi) + (y + 0.5) * np.log(t) - t + np.log(s)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(small, np.log(math.pi / np.abs(np.sin(math.pi * x))) - out, out)


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction."""
    a, b, x = np.broadcast_arrays(np.asarray(a, np.float64), np.asarray(b, np.float64), np.asarray(x, np.float64))
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
    tiny = 1e-300
    c, d = np.ones_like(p), 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * c * d
        if np.nanmax(np.abs(c * d - 1), initial=0.0) < 1e-15:
            break
    part = np.where(z <= 0, 0.0, front * h)
    return np.clip(np.where(swap, 1 - part, part), 0, 1)


def _columns(*arrays: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    null = np.zeros(len(arrays[0]), bool)
    out = []
    for a in arrays:
        null |= np.asarray(a.is_null())
        out.append(a.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64))
    return null, out


def binomial_tail(n: Column, k: Column, p: Column) -> Column:
    """P(X > k) for X binomial with ``n`` trials of probability ``p``; null where an argument is."""

    @F.arrow_udf("double")
    def tail(n: pa.Array, k: pa.Array, p: pa.Array) -> pa.Array:
        null, (n, k, p) = _columns(n, k, p)
        inside = (k >= 0) & (k < n)
        out = np.where(k < 0, 1.0, 0.0)
        out[inside] = incomplete_beta(k[inside] + 1, n[inside] - k[inside], np.clip(p[inside], 0, 1))
        return pa.array(out, mask=null)

    return tail(n.cast("double"), k.cast("double"), p.cast("double"))


def poisson_tail(k: Column, mean: Column) -> Column:
    """P(X > k) for X Poisson of ``mean``."""

    @F.arrow_udf("double")
    def tail(k: pa.Array, mean: pa.Array) -> pa.Array:
        null, (k, m) = _columns(k, mean)
        k = np.floor(k)
        below = np.zeros(len(k))
        for at in np.unique(k[k >= 0]):
            sel = k == at
            i = np.arange(int(at) + 1)
            with np.errstate(divide="ignore"):
                below[sel] = np.exp(-m[sel][:, None] + i * np.log(np.maximum(m[sel], 1e-300))[:, None] - log_gamma(i + 1.0)).sum(1)
        return pa.array(np.clip(1 - below, 0, 1), mask=null)

    return tail(k.cast("double"), mean.cast("double"))


def erfc(x: np.ndarray) -> np.ndarray:
    """Complementary error function of numbers of 0 or more: its series near 0, its continued fraction from 2 on, so that
    far tails keep their digits."""
    x = np.asarray(x, np.float64)
    near, far = np.minimum(x, 2.0), np.maximum(x, 2.0)
    term, total = near.copy(), near.copy()
    for n in range(1, 48):
        term = -term * near * near / n
        total = total + term / (2 * n + 1)
    tail = far
    for k in range(80, 0, -1):
        tail = far + k / 2 / tail
    return np.where(x < 2, 1 - 2 / math.sqrt(math.pi) * total, np.exp(-far * far) / math.sqrt(math.pi) / tail)


def normal_tail(z: Column) -> Column:
    """P(X > z) for X standard normal."""

    @F.arrow_udf("double")
    def tail(z: pa.Array) -> pa.Array:
        null, (v,) = _columns(z)
        half = 0.5 * erfc(np.abs(v) / math.sqrt(2))
        return pa.array(np.where(v < 0, 1 - half, half), mask=null)

    return tail(z.cast("double"))


#: Tables of Fisher's test whose terms are worked on together.
_TERMS = 1 << 21


def fisher_p(w: np.ndarray, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Two-sided p-values of the tables ((w, x), (y, z)), all terms of many tables at once; equal tables once."""
    tables, back = np.unique(np.stack([w, x, y, z], 1).astype(np.int64), axis=0, return_inverse=True)
    w, x, y, z = tables.T
    n, row, col = w + x + y + z, w + x, w + y
    low = np.maximum(0, row + col - n)
    size = np.minimum(row, col) - low + 1
    out = np.ones(len(tables))
    ends = np.cumsum(size)
    first = 0
    while first < len(tables):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + _TERMS, side="right")))
        at = slice(first, last)
        begin = np.r_[0, np.cumsum(size[at])[:-1]]
        own = np.repeat(np.arange(last - first), size[at])
        k = np.arange(len(own)) - begin[own] + low[at][own]
        r, c, m = row[at][own], col[at][own], n[at][own]
        logs = -(log_gamma(k + 1.0) + log_gamma(r - k + 1.0) + log_gamma(c - k + 1.0) + log_gamma(m - r - c + k + 1.0))
        p = np.exp(logs - np.maximum.reduceat(logs, begin)[own])
        p /= np.add.reduceat(p, begin)[own]
        seen = p[begin + w[at] - low[at]]
        out[at] = np.minimum(1.0, np.add.reduceat(np.where(p <= seen[own] * (1 + 1e-7), p, 0.0), begin))
        first = last
    return out[back.ravel()]


def fisher_exact(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Two-sided p-value of Fisher's exact test of the table ((a, b), (c, d)); null where a count is."""

    @F.arrow_udf("double")
    def test(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
        null, cols = _columns(a, b, c, d)
        return pa.array(fisher_p(*cols) if len(null) else np.zeros(0), mask=null)

    return test(*(x.cast("double") for x in (a, b, c, d)))


def bh_within(p: Column, by: Sequence[Column]) -> Column:
    """Benjamini-Hochberg q-value of ``p`` within small groups ``by`` (one window task per group)."""
    n = F.count(p).over(Window.partitionBy(*by))
    last = F.count(p).over(Window.partitionBy(*by).orderBy(p.asc_nulls_last()).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    raw = p * n / last
    return F.least(F.lit(1.0), F.min(raw).over(Window.partitionBy(*by).orderBy(p.desc_nulls_last()).rangeBetween(Window.unboundedPreceding, Window.currentRow)))


def benjamini_hochberg(df: DataFrame, p: str, out: str = "q") -> DataFrame:
    """``df`` with the Benjamini-Hochberg q-value of ``p`` over all its rows; null where ``p`` is null or not a number.

    A global range sort by falling p, kept in the shared folder; equal p-values, often most of them, are spread over
    partitions by a hash. The driver gets one row per partition (size and smallest p * n / rank), from which follow each
    partition's ranks and the minimum over all larger p; one more scan carries that minimum on, batch by batch.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    value = F.col(f"`{p}`").cast("double")
    rows = df.withColumns({"__p": F.when(~F.isnan(value), value), "__tie": F.xxhash64(F.monotonically_increasing_id())})
    order = [F.col("__p").desc_nulls_last(), F.col("__tie")]
    held = cut(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("__tie"))
    counts = sorted((r.p, r.n) for r in held.groupBy(F.spark_partition_id().alias("p")).agg(F.count("__p").alias("n")).collect())
    total, ranks = sum(n for _, n in counts), {}
    at = total
    for k, n in counts:
        ranks[k] = at
        at -= n

    def raws(values: pa.Array, rank: int) -> np.ndarray:
        """p * n / rank of a batch's numbers, which come before its nulls."""
        v = values.drop_null().to_numpy(zero_copy_only=False)
        return v * total / (rank - np.arange(len(v)))

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, low = TaskContext.get().partitionId(), np.inf
        rank = ranks.get(part, 0)
        for b in batches:
            raw = raws(b.column(0), rank)
            low, rank = min(low, float(raw.min(initial=np.inf))), rank - len(raw)
        if np.isfinite(low):
            yield pa.RecordBatch.from_pydict({"p": pa.array([part], pa.int32()), "low": [low]})

    entering, run = {}, 1.0
    for part, low in sorted((r.p, r.low) for r in held.select("__p").mapInArrow(least, "p INT, low DOUBLE").collect()):
        entering[part] = run
        run = min(run, low)
    from pyspark.sql.types import DoubleType, StructField, StructType

    col = held.columns.index("__p")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        rank, run = ranks.get(part, 0), entering.get(part, 1.0)
        for b in batches:
            raw = raws(b.column(col), rank)
            q = np.minimum.accumulate(np.r_[run, raw])
            rank, run = rank - len(raw), q[-1]
            q = pa.array(np.r_[q[1:], np.zeros(b.num_rows - len(raw))], mask=np.arange(b.num_rows) >= len(raw))
            yield pa.RecordBatch.from_arrays([*b.columns[:col], *b.columns[col + 1 :], q], names=[*b.schema.names[:col], *b.schema.names[col + 1 :], out])

    return held.mapInArrow(scan, StructType([*df.schema.fields, StructField(out, DoubleType())]))


def m_value(frac: Column, alpha: float = 0.01) -> Column:
    return F.log2((frac + alpha) / (1 - frac + alpha))


def count_m_value(mc: Column, cov: Column) -> Column:
    return F.log2((mc + 0.1) / (cov - mc + 0.1))


def binary_counts(mc: Column, cov: Column) -> tuple[Column, Column]:
    """A site counts as (0, 1) without and (1, 1) with full methylation, else as (0, 0)."""
    return F.when((mc == cov) & (mc > 0), 1).otherwise(0).cast("long"), F.when((mc == 0) | (mc == cov), 1).otherwise(0).cast("long")


def clip_ratio(mc: Column, cov: Column, most: int) -> tuple[Column, Column]:
    """Counts whose cov exceeds ``most`` brought under it at the same ratio."""
    rate = cov / F.lit(float(most))
    return F.when(cov > most, F.greatest(F.lit(0), F.floor(mc / rate - 1))).otherwise(mc).cast("long"), F.when(cov > most, F.floor(cov / rate - 1)).otherwise(cov).cast("long")

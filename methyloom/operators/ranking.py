"""Ranks and exact quantiles of whole tables by a global range sort, without a window over all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, small_table


def global_rank(df: DataFrame, by: str | None, order: Sequence[Column], out: str = "rank") -> DataFrame:
    """``df`` with ``out``: each row's place from 0 within its ``by`` value (a key of few values, such as chrom; a null
    is a value of its own), by ``order``. The sorted table is kept in the shared folder; the driver gets one number per
    partition and value of ``by`` in it."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = [F.col(by)] if by else []
    held = cut(df.repartitionByRange(parts, *key, *order).sortWithinPartitions(*key, *order))
    pid, row = F.spark_partition_id(), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    group = F.coalesce(F.col(by).cast("string"), F.lit("\0")) if by else F.lit("")
    marked = held.select("*", pid.alias("__p"), row.alias("__r"), group.alias("__g"))
    sizes = sorted((r["__p"], r["lo"], r["__g"], r["n"]) for r in marked.groupBy("__p", "__g").agg(F.min("__r").alias("lo"), F.count("*").alias("n")).collect())
    seen: dict[str, int] = {}
    shift = []
    for p, lo, g, n in sizes:
        shift.append((p, g, seen.get(g, 0) - lo))
        seen[g] = seen.get(g, 0) + n
    if not shift:
        return held.withColumn(out, F.lit(0).cast("long"))
    p, g, by_ = zip(*shift)
    table = small_table(df.sparkSession, __p=list(p), __g=list(g), __shift=list(by_))
    return marked.join(table, ["__p", "__g"]).withColumn(out, F.col("__r") + F.col("__shift")).drop("__p", "__g", "__r", "__shift")


def exact_quantiles(df: DataFrame, value: str, qs: Sequence[float], by: str | None = None) -> DataFrame:
    """``by`` and ``q0``, ``q1``, ...: quantiles of the non-null values with linear interpolation between neighbours."""
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    # equal values are spread over partitions by a hash
    tied = rows.select(*([by] if by else []), F.col(value).cast("double").alias("__v"), F.xxhash64(F.monotonically_increasing_id()).alias("__t"))
    ranked = global_rank(tied, by, [F.col("__v"), F.col("__t")])
    on = [by] if by else []
    total = ranked.groupBy(*on).agg(F.count("*").alias("__n"))
    joined = ranked.join(total, by) if by else ranked.crossJoin(total)
    made = []
    for i, q in enumerate(qs):
        at = q * (F.col("__n") - 1)
        low, high = F.floor(at), F.ceil(at)
        a, b = F.max(F.when(F.col("rank") == low, F.col("__v"))), F.max(F.when(F.col("rank") == high, F.col("__v")))
        made.append((a + (b - a) * F.max(at - low)).alias(f"q{i}"))
    return joined.groupBy(*on).agg(*made)

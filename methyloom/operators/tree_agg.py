"""Per-key aggregates by a tree of merges, for keys that hold most rows."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: State columns of each aggregate and how two states merge.
_STATES = {
    "count": lambda c: {"n": (F.count(c), F.sum)},
    "sum": lambda c: {"s": (F.sum(c), F.sum)},
    "min": lambda c: {"lo": (F.min(c), F.min)},
    "max": lambda c: {"hi": (F.max(c), F.max)},
    "avg": lambda c: {"n": (F.count(c), F.sum), "s": (F.sum(c.cast("double")), F.sum)},
    "var_pop": lambda c: {"n": (F.count(c), F.sum), "s": (F.sum(c.cast("double")), F.sum), "q": (F.sum(c.cast("double") * c.cast("double")), F.sum)},
}


def _result(kind: str, at) -> Column:
    if kind == "avg":
        return F.try_divide(at("s"), at("n"))
    if kind == "var_pop":
        mean = F.try_divide(at("s"), at("n"))
        return F.greatest(F.try_divide(at("q"), at("n")) - mean * mean, F.lit(0.0))
    return at({"count": "n", "sum": "s", "min": "lo", "max": "hi"}[kind])


def leaves_for(df: DataFrame, fan_in: int) -> int:
    """A power of ``fan_in`` of leaves for the planner's estimate of the largest table that ``df`` reads; nothing is run
    for it."""
    tables = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = max(int(tables.apply(i).stats().sizeInBytes()) for i in range(tables.size()))
    return fan_in ** min(6, max(1, math.ceil(math.log(max(size / (1 << 16), 2), fan_in))))


def tree_aggregate(df: DataFrame, keys: Sequence[str | Column], aggregates: Mapping[str, tuple[str, str]], fan_in: int = 16, chunk_rows: int = 1 << 16, leaves: int | None = None) -> DataFrame:
    """``groupBy(keys).agg(...)`` whose work per key is spread over a tree of merges.

    ``aggregates`` maps an output name to (kind, column), kind one of count, sum, min, max, avg, var_pop; the column
    ``*`` with ``count`` counts rows. Every input chunk of ``chunk_rows`` rows belongs to one of ``leaves`` leaves, as
    many as the planner's estimate of the input's size gives chunks (one a 64 KiB, as columns are packed), so that a leaf
    has few chunks however large the input is. A task combines its own chunks before anything is shuffled, so what moves is one state per key, leaf and task; then
    each round merges ``fan_in`` neighbouring leaves per key, until one state per key is left: as many rounds as the
    logarithm of ``leaves``. However many rows a key has, a reducer merges about ``fan_in`` of its states, and in the
    first round those of the chunks of one leaf.

    Nulls: a null key is a key of its own; null values are skipped as in SQL. An empty table gives an empty result.
    Other columns are not read.
    """
    taken = {c.lower() for c in df.columns}
    keyed = [(F.col(f"`{k}`"), k) if isinstance(k, str) else (k, f"key{i}" if len(keys) > 1 else "key") for i, k in enumerate(keys)]
    names = [k for _, k in keyed]
    states = {out: _STATES[kind](F.lit(1) if column == "*" else F.col(f"`{column}`")) for out, (kind, column) in aggregates.items()}
    inputs = list(dict.fromkeys(c for _, c in aggregates.values() if c != "*"))
    assert not [c for c in inputs if c.lower() not in taken], "unknown column"
    at = "__leaf"
    leaves = leaves or leaves_for(df, fan_in)
    rounds = max(1, math.ceil(math.log(leaves, fan_in) - 1e-9))
    row = F.monotonically_increasing_id()
    # the upper bits of the id are the partition, the lower 33 the row in it
    leaf = F.pmod(F.shiftright(row, 33) + F.shiftright(row.bitwiseAND((1 << 33) - 1), int(math.log2(chunk_rows))), F.lit(leaves))
    level = df.select(*[c.alias(f"__k{i}") for i, (c, _) in enumerate(keyed)], *[F.col(f"`{c}`") for c in inputs], leaf.alias(at))
    group = [f"__k{i}" for i in range(len(keyed))]
    level = level.groupBy(*group, at).agg(*[first.alias(f"__{out}_{part}") for out, parts in states.items() for part, (first, _) in parts.items()])
    for _ in range(rounds):
        level = level.withColumn(at, F.floor(F.col(at) / fan_in)).groupBy(*group, at).agg(*[merge(F.col(f"__{out}_{part}")).alias(f"__{out}_{part}") for out, parts in states.items() for part, (_, merge) in parts.items()])
    return level.select(*[F.col(g).alias(n) for g, n in zip(group, names)], *[_result(aggregates[out][0], lambda p, out=out: F.col(f"__{out}_{p}")).alias(out) for out in aggregates])


def heavy_keys(df: DataFrame, key: Column, share: float = 0.1, **tree: int) -> DataFrame:
    """``key`` and ``n`` of every non-null key that at least ``share`` of all rows of ``df`` hold.

    The rows of null keys count in the total. Counts come from :func:`tree_aggregate`; the one-row total is joined to
    them.
    """
    counts = tree_aggregate(df, [key], {"n": ("count", "*")}, **tree)
    total = counts.agg(F.sum("n").alias("__total"))
    return counts.crossJoin(total).where((F.col("key").isNotNull()) & (F.col("n") >= share * F.col("__total"))).select("key", "n")

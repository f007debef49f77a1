"""Missing values from the finest group of similar rows that has enough of them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import label_key, make_room
from ..session import stored


@dataclass(frozen=True)
class Field:
    """What to fill: ``name``, its usable values (``valid``; null where not usable) and ``how``: median or mode."""

    name: str
    valid: Column
    how: str = "median"


def group_statistics(df: DataFrame, fields: Sequence[Field], keys: Sequence[str], min_support: int, weight: Column | None = None) -> DataFrame:
    """``keys`` and for each field ``__v_<name>``: its statistic in the group, null under ``min_support`` usable values.

    A row stands for ``weight`` rows (medians only). Groups with a null key are left out.
    """
    made = []
    for f in fields:
        times = F.lit(1) if weight is None else weight
        v = F.percentile(f.valid, 0.5, times) if f.how == "median" else F.mode(f.valid, True)
        made.append(F.when(F.sum(F.when(f.valid.isNotNull(), times)) >= min_support, v).alias(f"__v_{f.name}"))
    for k in keys:
        df = df.where(F.col(f"`{k}`").isNotNull())
    return df.groupBy(*[f"`{k}`" for k in keys]).agg(*made)


def back_off(rows: DataFrame, cases: DataFrame, fields: Sequence[Field], levels: Sequence[Sequence[str]], min_support: int, weight: Column | None = None) -> DataFrame:
    """``cases`` with ``__v_<name>``, the statistic of the finest level of ``rows`` that has one, and ``__l_<name>``,
    the number of that level (-1 and a null value where none has).

    Statistics are aggregates with a partial step in every task, so a hot group ships one buffer of distinct values
    per task; only the cases are joined with them.
    """
    names = [f.name for f in fields]
    for i, keys in enumerate(levels):
        if keys:
            stats = group_statistics(rows, fields, keys, min_support, weight)
        else:
            stats = group_statistics(rows.withColumn("__all", F.lit(1)), fields, ["__all"], 1, weight)
        on = list(keys) or ["__all"]
        stats = stats.select(*[F.col(f"`{k}`").alias(f"__j{j}") for j, k in enumerate(on)], *[F.col(f"__v_{n}").alias(f"__v{i}_{n}") for n in names])
        left = [F.col(f"`{k}`") if keys else F.lit(1) for k in on]
        cond = F.lit(True)
        for j, k in enumerate(left):
            cond = cond & (k == F.col(f"__j{j}"))
        cases = cases.join(stats, cond, "left").drop(*[f"__j{j}" for j in range(len(on))])
    found = {n: [F.col(f"__v{i}_{n}") for i in range(len(levels))] for n in names}
    cases = cases.select(
        "*",
        *[F.coalesce(*v).alias(f"__v_{n}") for n, v in found.items()],
        *[F.coalesce(*[F.when(x.isNotNull(), F.lit(i)) for i, x in enumerate(v)], F.lit(-1)).alias(f"__l_{n}") for n, v in found.items()],
    )
    return cases.drop(*[f"__v{i}_{n}" for n in names for i in range(len(levels))])


def fill_from_groups(df: DataFrame, fields: Sequence[Field], levels: Sequence[Sequence[str]], min_support: int = 5) -> DataFrame:
    """Fills each field from the group statistics of the finest level with enough support.

    ``levels`` goes from finest to coarsest; an empty level means all rows. Adds for each field ``<name>_filled``
    (BOOLEAN) and ``<name>_level`` (the number of the level that gave the value, -1 where none had one; null where
    nothing was filled). The field holds its usable or the put-in value, null only where no level had a value; medians
    of whole-number fields are rounded half to even. A null in a key skips the levels that use it. Repeated rows count
    as often as they occur. An empty table comes out empty. Input columns that carry an added name are renamed to
    ``<name>_in``.
    """
    df = make_room(df, *[x for f in fields for x in (f"{f.name}_filled", f"{f.name}_level")])
    order = df.columns
    marked = df.select("*", *[f.valid.alias(f"__ok_{f.name}") for f in fields])
    own = [Field(f.name, F.col(f"__ok_{f.name}"), f.how) for f in fields]
    lacking = F.lit(False)
    for f in own:
        lacking = lacking | f.valid.isNull()
    kinds = {f.name: df.schema[f.name].dataType for f in fields}

    def out(frame: DataFrame, cases: bool) -> DataFrame:
        value, extra = {}, []
        for f in own:
            put = F.col(f"__v_{f.name}") if cases else F.lit(None)
            if f.how == "median" and kinds[f.name].typeName() in ("long", "integer", "short", "byte"):
                put = F.bround(put.cast("double"), 0)
            value[f.name] = F.coalesce(f.valid, put.cast(kinds[f.name])).cast(kinds[f.name]).alias(f.name)
            level = F.when(f.valid.isNull(), F.col(f"__l_{f.name}")) if cases else F.lit(None).cast("int")
            extra += [f.valid.isNull().alias(f"{f.name}_filled"), level.alias(f"{f.name}_level")]
        return frame.select(*[value.get(c, F.col(f"`{c}`")) for c in order], *extra)

    return out(marked.where(~lacking), False).unionByName(out(back_off(marked, marked.where(lacking), own, levels, min_support), True))


def usable_counts(mc: Column, cov: Column, most: int = 9999) -> tuple[Column, Column]:
    """The usable ``mc`` and ``cov``: in 0..``most``; where both are but mc exceeds cov, cov is not usable."""
    m, c = F.when(mc.between(0, most), mc), F.when(cov.between(0, most), cov)
    return m, F.when(F.coalesce(m <= c, F.lit(True)), c)


#: Levels for count matrices, finest first.
COUNT_LEVELS = (("__group", "region", "mc_type", "strand_type"), ("region", "mc_type", "strand_type"), ("__group", "mc_type", "strand_type"), ("mc_type", "strand_type"), ())
#: Written labels that mean that there is none.
NO_LABEL = ("", "na", "nan", "none", "unassigned")


def cell_groups(adata: DataFrame) -> DataFrame:
    """``__cell``, ``__group``: one row per cell, its label in lower case without blanks; cells without one are left out."""
    label = label_key(F.col("groups"))
    return adata.where(F.col("cell").isNotNull() & label.isNotNull() & ~label.isin(*NO_LABEL)).groupBy(F.col("cell").alias("__cell")).agg(F.min(label).alias("__group"))


def fill_counts(mcds: DataFrame, adata: DataFrame, levels: Sequence[Sequence[str]] = COUNT_LEVELS, min_support: int = 5, most: int = 9999) -> DataFrame:
    """Every row of a count matrix with both counts: ``mc`` and ``cov`` put in where they are not usable.

    ``cov`` is put in as the median of the finest group of rows with at least ``min_support`` usable ones (cells of the
    same label in the same region, the region, the label, the kind of count, all), and not under a usable ``mc``.
    ``mc`` is put in as the median share mc/cov of such a group, in thousandths, times the row's own cov, so that
    0 <= mc <= cov. Adds mc_filled, cov_filled (BOOLEAN), mc_level, cov_level (see :func:`fill_from_groups`). Where the
    table has no usable value at all, 0 is put in at level -1. Every row comes out once; other columns stay; columns
    with an added name are renamed to ``<name>_in``. A null in a key, or a cell without a label, skips to the levels
    without it.

    Values are counted once per group of the finest level and kept in the shared folder; every level's medians come from
    those counts.
    """
    added = ("mc_filled", "cov_filled", "mc_level", "cov_level")
    df = make_room(mcds, *added)
    order = df.columns
    mc, cov = usable_counts(F.col("mc"), F.col("cov"), most)
    df = df.select("*", mc.alias("__mc"), cov.alias("__cov"))
    fields = [Field("span", F.col("__cov")), Field("share", F.when(F.col("__cov") > 0, F.round(1000 * F.col("__mc") / F.col("__cov")).cast("long")))]
    lacking = F.col("__mc").isNull() | F.col("__cov").isNull()
    whole = df.where(~lacking).select(*[f"`{c}`" for c in order], F.lit(False).alias(added[0]), F.lit(False).alias(added[1]), F.lit(None).cast("int").alias(added[2]), F.lit(None).cast("int").alias(added[3]))
    df = df.join(cell_groups(adata), F.col("cell") == F.col("__cell"), "left").drop("__cell")
    keys = list(dict.fromkeys(k for level in levels for k in level))
    values = df.select(*[f"`{k}`" for k in keys], *[f.valid.alias(f.name) for f in fields]).where("span IS NOT NULL OR share IS NOT NULL")
    counted = stored(values.groupBy(*[f"`{k}`" for k in keys], "span", "share").agg(F.count("*").alias("times")), "counted")
    cases = back_off(counted, df.where(lacking), [Field(f.name, F.col(f.name)) for f in fields], levels, min_support, F.col("times"))
    span = F.greatest(F.coalesce(F.col("__cov"), F.bround(F.col("__v_span"), 0).cast("long"), F.lit(0)), F.coalesce(F.col("__mc"), F.lit(0)))
    value = {"cov": span, "mc": F.coalesce(F.col("__mc"), F.bround(F.coalesce(F.col("__v_share"), F.lit(0.0)) * span / 1000, 0).cast("long"))}
    filled = cases.select(
        *[value[c].cast(mcds.schema[c].dataType).alias(c) if c in value else F.col(f"`{c}`") for c in order],
        F.col("__mc").isNull().alias(added[0]),
        F.col("__cov").isNull().alias(added[1]),
        F.when(F.col("__mc").isNull(), F.col("__l_share")).alias(added[2]),
        F.when(F.col("__cov").isNull(), F.col("__l_span")).alias(added[3]),
    )
    return whole.unionByName(filled)

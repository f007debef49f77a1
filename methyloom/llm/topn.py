"""The N best rows of every group by bisection on an order-preserving code, for all groups at once."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Bits decided in one pass: each pass counts the rows of a group between 2**BITS - 1 midpoints, as BITS halvings do.
BITS = 16
_LOW = -(1 << 63)


def order_code(score: Column) -> Column:
    """A BIGINT in the order of the double ``score`` (-0.0 as 0.0); null for null."""

    @F.arrow_udf("bigint")
    def code(x: pa.Array) -> pa.Array:
        v = x.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
        bits = v.view(np.int64)
        return pa.array(bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF)), mask=np.asarray(x.is_null()))

    return code(score.cast("double"))


def refine(rows: DataFrame, bits: int = 64) -> DataFrame:
    """``g``, ``cut``, ``need``, ``ties``: per group the largest cutoff with at least ``need`` rows at or above it, how
    many rows at the cutoff itself are still needed, and how many there are. Groups that hold no more rows than they
    need have no row here. ``rows`` has ``g``, ``w`` (the code) and ``need`` (the same in a group).

    Starts from the whole range of codes (``bits`` < 64: of codes from 0 to 2**bits - 1); every pass counts the rows of
    each group's bracket between midpoints and takes the bracket that holds the boundary, for all groups at once.
    Counting has a partial step in every task; per group and pass at most 2**BITS counts meet in the window.
    """
    flip = _LOW if bits == 64 else 0
    live = rows.select("g", "need", F.col("w").bitwiseXOR(F.lit(flip)).alias("u"))
    own, state = live.drop("need"), None
    top = -(-bits // BITS) * BITS - BITS
    for shift in range(top, -1, -BITS):
        if state is not None:
            live = own.join(state, (own["g"] == state["sg"]) & (F.shiftrightunsigned(own["u"], shift + BITS) == state["at"])).drop("sg", "at")
        counts = live.groupBy("g", "need", F.shiftrightunsigned("u", shift).alias("d")).agg(F.count("*").alias("ties"))
        above = F.sum("ties").over(Window.partitionBy("g").orderBy(F.desc("d"))) - F.col("ties")
        counts = counts.withColumn("above", above).where("above < need AND above + ties >= need")
        state = counts.select(F.col("g").alias("sg"), (F.col("need") - F.col("above")).alias("need"), F.col("d").alias("at"), "ties")
        last, state = state, state.drop("ties")
    return last.select(F.col("sg").alias("g"), F.col("at").bitwiseXOR(F.lit(flip)).alias("cut"), "need", "ties")


def ranked(rows: DataFrame, order: Sequence[Column], partitions: int) -> tuple[DataFrame, int]:
    """``rows`` with ``rank``, their place from 0 in the total order ``order``, and how many there are: a global range
    sort, kept in the shared folder, and the sizes of its partitions (as many numbers as partitions)."""
    held = cut(rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order))
    part = F.spark_partition_id()
    sizes = sorted((r.p, r.n) for r in held.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    before, total = {}, 0
    for p, n in sizes:
        before[p] = total
        total += n
    if not total:
        return held.withColumn("rank", F.lit(0).cast("long")), 0
    offset = F.element_at(F.create_map(*[F.lit(x) for item in before.items() for x in item]), part).cast("long")
    return held.withColumn("rank", offset + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), total


def top_n_per_group(df: DataFrame, group: str, score: Column, name: str, ident: str, n: int = 10, valid: Column | None = None) -> DataFrame:
    """``group``, ``ident`` of the first ``n`` rows of every group by ``score`` descending, ``name`` and ``ident``
    ascending (null names last). Of rows equal in all columns but ``ident`` only the one with the smallest ``ident``
    counts. A group of fewer rows gives them all.

    Left out are rows with a null group or ``ident``, a score that is null or not a number, and rows that are not
    ``valid``. ``ident`` is a unique BIGINT. Columns are read by their names in ``df``, whatever else it has. An empty
    table gives an empty result.

    1. Rows that cannot be among the first are dropped: distinct scores of a group are counted between midpoints; rows
       under the bracket with the n-th distinct score have n different rows above them, whatever repeats.
    2. The remaining rows lose their repeats (equal by 128 bits over all columns).
    3. Bisection (see :func:`refine`) on the score's code. Only for rows at the cutoff of a group that has more of them
       than it needs, name and identifier become a second code, their rank in a global range sort, and the bisection
       goes on with it until each group holds exactly ``n``.
    """
    spark = df.sparkSession
    others = [c for c in df.columns if c != ident]
    use = df.where(F.col(f"`{group}`").isNotNull() & F.col(f"`{ident}`").isNotNull())
    if valid is not None:
        use = use.where(valid)
    s = score.cast("double")
    use = use.where(s.isNotNull() & ~F.isnan(s))
    cols = [F.col(f"`{c}`") for c in others]
    same = [F.xxhash64(F.lit(salt), *cols, *[c.isNull() for c in cols]) for salt in (1, 2)]
    rows = use.select(F.col(f"`{group}`").alias("g"), order_code(s).alias("w"), F.col(f"`{name}`").cast("string").alias("name"), F.col(f"`{ident}`").cast("long").alias("id"), same[0].alias("h1"), same[1].alias("h2"))
    head = F.shiftright("w", 64 - BITS)
    distinct = rows.select("g", "w").distinct().groupBy("g", head.alias("d")).agg(F.count("*").alias("k"))
    reach = F.sum("k").over(Window.partitionBy("g").orderBy(F.desc("d")))
    floor = distinct.withColumn("reach", reach).where(F.col("reach") >= n).groupBy("g").agg(F.max("d").alias("floor"))
    near = rows.join(floor, "g", "left").where(F.col("floor").isNull() | (head >= F.col("floor")))
    kept = cut(near.groupBy("g", "w", "name", "h1", "h2").agg(F.min("id").alias("id")).drop("h1", "h2"))
    cuts = cut(refine(kept.withColumn("need", F.lit(n).cast("long"))))
    marked = kept.join(cuts, "g", "left")
    tied = (F.col("w") == F.col("cut")) & (F.col("need") < F.col("ties"))
    best = marked.where(F.col("cut").isNull() | (F.col("w") > F.col("cut")) | ((F.col("w") == F.col("cut")) & (F.col("need") == F.col("ties")))).select("g", "id")
    if not cuts.where("need < ties").isEmpty():
        ties, total = ranked(marked.where(tied).select("g", "name", "id", "need"), [F.asc_nulls_last("name"), F.asc("id")], int(spark.conf.get("spark.sql.shuffle.partitions")))
        coded = ties.withColumn("w", F.lit(total - 1) - F.col("rank"))
        last = refine(coded, max(1, (total - 1).bit_length())).select(F.col("g").alias("cg"), "cut")
        best = best.unionByName(coded.join(last, F.col("g") == F.col("cg")).where(F.col("w") >= F.col("cut")).select("g", "id"))
    return best.select(F.col("g").alias(group), F.col("id").alias(ident))

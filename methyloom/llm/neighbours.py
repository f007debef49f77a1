"""Most similar vectors for every vector, by a permutation index."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import small_table, stored

#: Rows of one posting list that are worked on together; longer lists are split into blocks, each pair of which meets.
LIST_ROWS = 8192
#: A longer list is split by pivots of its own, about one per SUB_ROWS rows and at most MOST_SUB, level by level.
SPLIT_ROWS, SUB_ROWS, MOST_SUB, LEVELS = 1 << 15, 512, 4096, 3
#: Postings that a task searches, about.
TASK_ROWS = 1 << 16
#: Most pivots: bounds what is shipped to the tasks (MOST_PIVOTS vectors).
MOST_PIVOTS = 16384


def usable_matrix(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows that hold ``dim`` finite components, not all zero, as a matrix, and their places."""
    size = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(size == dim)
    flat = vectors.take(pa.array(at)).flatten()
    x = flat.cast(pa.float32()).to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float32)
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    return x[good], at[good]


def usable_vectors(df: DataFrame, ident: str, vector: str, dim: int) -> DataFrame:
    """``id``, ``v``: the usable vectors as the bytes of their float32 components. Null ids are left out."""
    kind = df.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, at = usable_matrix(b.column(1), dim)
            raw = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * 4 * dim).astype(np.int32)), pa.py_buffer((x + 0.0).tobytes())])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), raw], names=["id", "v"])

    return df.where(F.col(f"`{ident}`").isNotNull()).select(F.col(f"`{ident}`"), F.col(f"`{vector}`")).mapInArrow(run, f"id {kind}, v BINARY")


def matrix(raw: pa.Array, dim: int) -> np.ndarray:
    """Vectors of :func:`usable_vectors` as a matrix."""
    raw = pa.concat_arrays(raw.chunks) if isinstance(raw, pa.ChunkedArray) else raw
    begin = np.frombuffer(raw.buffers()[1], np.int32, len(raw) + 1, raw.offset * 4)[0] if len(raw) else 0
    return np.frombuffer(raw.buffers()[2], np.float32, len(raw) * dim, int(begin)).reshape(-1, dim) if len(raw) else np.zeros((0, dim), np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x.astype(np.float64) ** 2).sum(1, keepdims=True)).astype(np.float32)


def permutations(x: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """For each unit vector its ``length`` nearest pivots in order (int16)."""
    out = np.empty((len(x), min(length, len(pivots))), np.int16)
    for a in range(0, len(x), 4096):
        s = x[a : a + 4096] @ pivots.T
        near = np.argpartition(-s, out.shape[1] - 1, axis=1)[:, : out.shape[1]] if out.shape[1] < len(pivots) else np.tile(np.arange(len(pivots)), (len(s), 1))
        order = np.argsort(-np.take_along_axis(s, near, 1), axis=1, kind="stable")
        out[a : a + 4096] = np.take_along_axis(near, order, 1)
    return out


def footrule_gain(query: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """How much nearer the permutations are than ones without a common pivot: half of the induced footrule's saving.

    With positions 0..L-1, and L for a pivot not in the list, the footrule of two lists is L(L+1) minus twice the sum
    over common pivots of min(L - position in one, L - position in the other). ``query`` has the lists of the queries,
    ``weight`` one row per pivot with L - position of each vector (0 where the vector doesn't list the pivot). The sum
    reaches L(L+1)/2, so the integers are as wide as that needs.
    """
    length = query.shape[1]
    total = np.zeros((len(query), weight.shape[1]), np.min_scalar_type(length * (length + 1) // 2))
    for place in range(length):
        total += np.minimum(weight[query[:, place]], weight.dtype.type(length - place))
    return total


def search_list(x: np.ndarray, perm: np.ndarray, left: np.ndarray, right: np.ndarray, keep: int, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every row of ``left``: of the ``keep`` rows of ``right`` nearest by footrule the ``k`` most similar by cosine,
    if at least ``least``. Rows are places in ``x`` (unit vectors) and ``perm``. Gives (row, other row, cosine)."""
    used, local = np.unique(perm, return_inverse=True)
    local = local.reshape(perm.shape)
    length = perm.shape[1]
    weight = np.zeros((len(used), len(right)), np.min_scalar_type(length))
    weight[local[right].ravel(), np.repeat(np.arange(len(right)), length)] = np.tile(np.arange(length, 0, -1, dtype=weight.dtype), len(right))
    at = np.full(len(x), -1)
    at[right] = np.arange(len(right))
    rows, others, sims = [], [], []
    step = max(1, min(512, (1 << 21) // max(1, min(keep, len(right)))))
    for a in range(0, len(left), step):
        q = left[a : a + step]
        own = at[q] >= 0
        if keep < len(right):
            gain = footrule_gain(local[q], weight)
            gain[np.flatnonzero(own), at[q][own]] = 0
            near = np.argpartition(gain, gain.shape[1] - keep, axis=1)[:, gain.shape[1] - keep :]
            sim = np.einsum("ijk,ik->ij", x[right[near]], x[q], optimize=True)
            sim[np.take_along_axis(gain, near, 1) == 0] = -2
        else:  # the list is short enough to be ranked by cosine as a whole
            near = np.broadcast_to(np.arange(len(right)), (len(q), len(right)))
            sim = x[q] @ x[right].T
            sim[np.flatnonzero(own), at[q][own]] = -2
        if k < sim.shape[1]:
            best = np.argpartition(-sim, k - 1, axis=1)[:, :k]
            near, sim = np.take_along_axis(near, best, 1), np.take_along_axis(sim, best, 1)
        i, j = np.nonzero(sim >= max(least, -1.5))
        rows.append(q[i])
        others.append(right[near[i, j]])
        sims.append(sim[i, j])
    return np.concatenate(rows), np.concatenate(others), np.concatenate(sims)


def low_by_hash(df: DataFrame, key: str, count: int, n: int) -> DataFrame:
    """The rows of ``n`` whose hash of ``key`` lies where about four times ``count`` lie."""
    limit = -(1 << 63) + int((1 << 64) * min(1.0, (4 * count + 64) / max(n, 1)))
    return df if limit >= 1 << 63 else df.where(F.xxhash64(F.col(f"`{key}`")) < F.lit(limit))


def first_by_hash(df: DataFrame, key: str, count: int, n: int) -> DataFrame:
    """The first ``count`` of ``n`` rows by a hash of ``key``. Rows with a higher hash are dropped in the scan, so what
    tasks send to the driver is bounded together, not each by ``count``."""
    rows = low_by_hash(df, key, count, n)
    return rows.orderBy(F.xxhash64(key), key).limit(count)


def choose_pivots(df: DataFrame, ident: str, vector: str, count: int, dim: int, n: int) -> np.ndarray:
    """Up to ``count`` distinct usable vectors by hash: a bounded sample, fixed by the data. Most rows are dropped by the
    hash of their array before any is parsed."""
    some = usable_vectors(low_by_hash(df, vector, 2 * count, n), ident, vector, dim).select("v")
    raw = list(dict.fromkeys(bytes(r.v) for r in some.orderBy(F.xxhash64("v"), "v").limit(2 * count).collect()))[:count]
    return unit(np.frombuffer(b"".join(raw), np.float32).reshape(-1, dim)) if raw else np.zeros((0, dim), np.float32)


def _deepened(postings: DataFrame, dim: int, post: int, probe: int) -> tuple[DataFrame, dict[int, int]]:
    """``postings`` with each list of more than SPLIT_ROWS rows replaced by lists of pivots of its own, and the sizes of
    the lists that are still longer than LIST_ROWS.

    A list's pivots are members by hash. Its members meet them in blocks of about LIST_ROWS, which all have all of the
    list's pivots, and are posted again in the lists of their nearest: no block grows with the list.
    """
    spark, columns = postings.sparkSession, postings.columns
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in postings.schema.fields)
    sizes: dict[int, int] = {}
    for level in range(LEVELS + 1):
        sizes = {r.list: r.n for r in postings.groupBy("list").agg(F.count("*").alias("n")).where(F.col("n") > LIST_ROWS).collect()}
        deep = [(x, n, min(MOST_SUB, -(-n // SUB_ROWS)), -(-n // LIST_ROWS)) for x, n in sizes.items() if n > SPLIT_ROWS]
        if not deep or level == LEVELS:
            break
        table = small_table(spark, **dict(zip(("list", "rows", "subs", "blocks"), map(list, zip(*deep)))))
        members = postings.join(table, "list")
        chosen = F.col("held") & (F.pmod(F.xxhash64("rep", "list"), "rows") < F.col("subs"))
        pivots = members.where(chosen).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*columns, "block", F.lit(True).alias("pivot"))
        members = members.select(*columns, F.pmod(F.xxhash64("rep"), "blocks").cast("int").alias("block"), F.lit(False).alias("pivot"))

        def assign(key: tuple, t: pa.Table) -> pa.Table:
            own, rest = t.filter(t["pivot"]).sort_by("v"), t.filter(pc.invert(t["pivot"])).select(columns)
            if not rest.num_rows or not own.num_rows:
                return rest
            near = permutations(unit(matrix(rest["v"], dim)), unit(matrix(own["v"], dim)), max(post, probe)).astype(np.int64)
            place = np.tile(np.arange(near.shape[1]), len(near))
            row = np.repeat(np.arange(len(near)), near.shape[1])
            held, asked = np.asarray(rest["held"])[row] & (place < post), np.asarray(rest["asked"])[row] & (place < probe)
            use = np.flatnonzero(held | asked)
            out = rest.take(pa.array(row[use]))
            # the new list's number: that of the old one, mixed with the pivot's
            number = pa.array(((key[0].as_py() + 1) * 1_000_003 + near.ravel()[use]) & 0x7FFFFFFFFFFFFFFF)
            made = {"list": number, "held": pa.array(held[use]), "asked": pa.array(asked[use])}
            return pa.table([made.get(c, out[c]) for c in columns], names=columns)

        deeper = members.unionByName(pivots).groupBy("list", "block").applyInArrow(assign, kinds)
        postings = stored(postings.join(table.select("list"), "list", "left_anti").select(*columns).unionByName(deeper), "postings", compression="zstd")
    return postings, sizes


def neighbours(df: DataFrame, ident: str, vector: str, dim: int, k: int = 5, least: float = -1.0, post: int = 3, length: int = 12, keep: int = 96, pivots: int | None = None, queries: DataFrame | None = None, probe: int | None = None) -> DataFrame:
    """``id``, ``other``, ``cosine``: for every row its ``k`` most similar other rows by cosine, among those of at
    least ``least`` similarity; equal similarities by ``other`` ascending.

    Rows with the same id count once (their vectors are taken to be equal). Left out are null ids and vectors that are
    null, of another size than ``dim``, not finite or all zero. ``queries`` (one column ``id``) restricts whose
    neighbours are given, never among whom they are searched. An empty table gives an empty result.

    Index: ``pivots`` vectors (the root of twice the number of vectors, at most MOST_PIVOTS, so that posting lists stay
    of the order of the root) are taken by hash. Every vector is written as the list of its ``length`` nearest pivots
    in order, and posted in the lists of its first ``post`` pivots; it is looked for in those of its first ``probe``
    (as many unless told). Within a list of more than ``keep`` vectors they are ranked by the footrule distance of their
    pivot lists, and the ``keep`` nearest are ranked again by cosine. Results of a row's lists are merged by a bounded
    ranking.

    Equal vectors are one class with a representative, so copies, however many, are posted once. Lists of more than
    SPLIT_ROWS rows are split by pivots of their own; those of more than LIST_ROWS into blocks, every pair of which
    meets in a group of its own: no group is unbounded, nothing is dropped, and the groups of a task are about
    TASK_ROWS rows however large the table is.
    """
    spark = df.sparkSession
    kind = df.schema[ident].dataType.simpleString()
    vectors = usable_vectors(df, ident, vector, dim)
    n = df.count()
    chosen = choose_pivots(df, ident, vector, pivots or min(MOST_PIVOTS, max(32, math.isqrt(2 * n))), dim, n)
    shared = spark.sparkContext.broadcast(chosen)
    probe = min(probe or post, len(chosen))
    length, post = min(max(length, probe), len(chosen)), min(post, len(chosen))
    most = max(post, probe)
    if not len(chosen):
        return spark.createDataFrame([], f"id {kind}, other {kind}, cosine DOUBLE")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                perm = permutations(unit(matrix(b.column(1), dim)), shared.value, length)
                raw = pa.array([p.tobytes() for p in perm], pa.binary())
                lists = pa.FixedSizeListArray.from_arrays(pa.array(perm[:, :most].ravel().astype(np.int32)), most).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*b.columns, raw, lists], names=["rep", "v", "top", "asked", "perm", "lists"])

    asked, marked = F.bool_or(F.lit(True)), vectors
    if queries is not None:
        marked = vectors.join(queries.select(F.col("id").alias("asked")).distinct(), F.col("id") == F.col("asked"), "left")
        asked = F.bool_or(F.col("asked").isNotNull())
    classes = marked.groupBy("v").agg(F.min("id").alias("rep"), F.max("id").alias("top"), asked.alias("asked"))
    posted = stored(classes.select("rep", "v", "top", "asked").mapInArrow(listed, f"rep {kind}, v BINARY, top {kind}, asked BOOLEAN, perm BINARY, lists ARRAY<INT>"), "postings", compression="zstd")
    held = F.col("place") < post
    postings = posted.select("rep", "v", "asked", "perm", F.posexplode("lists").alias("place", "list"))
    postings = postings.withColumns({"asked": F.col("asked") & (F.col("place") < probe), "held": held}).where("asked OR held").drop("place")
    postings, sizes = _deepened(postings.withColumn("list", F.col("list").cast("bigint")), dim, post, probe)
    if sizes:
        blocks = small_table(spark, list=list(sizes), blocks=[-(-n // LIST_ROWS) for n in sizes.values()])
        postings = postings.join(blocks, "list", "left").fillna(1, ["blocks"])
        postings = postings.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        postings = postings.select("rep", "v", "asked", "held", "perm", "list", "own", F.least("own", "with").alias("b0"), F.greatest("own", "with").alias("b1"))
    else:
        postings = postings.select("*", *[F.lit(0).alias(c) for c in ("own", "b0", "b1")])
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * most // TASK_ROWS))

    def search(key: tuple, t: pa.Table) -> pa.Table:
        x, perm = unit(matrix(t["v"], dim)), np.frombuffer(b"".join(t["perm"].to_pylist()), np.int16).reshape(-1, length)
        own, b0, b1 = t["own"].to_numpy(), key[1].as_py(), key[2].as_py()
        ask, held = np.asarray(t["asked"]), np.asarray(t["held"])
        sides = [(b0, b0)] if b0 == b1 else [(b0, b1), (b1, b0)]
        pairs = [(np.flatnonzero(ask & (own == a)), np.flatnonzero(held & (own == z))) for a, z in sides]
        parts = [search_list(x, perm, a, z, keep, k, least) for a, z in pairs if len(a) and len(z)]
        i, j, s = (np.concatenate(p) for p in zip(*parts)) if parts else (np.zeros(0, int),) * 3
        rep = t["rep"].combine_chunks()
        return pa.table({"x": rep.take(pa.array(i)), "y": rep.take(pa.array(j)), "cosine": pa.array(np.minimum(s.astype(np.float64), 1.0))})

    edges = postings.repartition(tasks, "list", "b0", "b1").groupBy("list", "b0", "b1").applyInArrow(search, f"x {kind}, y {kind}, cosine DOUBLE")
    edges = edges.groupBy("x", "y").agg(F.max("cosine").alias("cosine"))
    return _members(vectors, posted, edges, k, least, queries).select("id", "other", "cosine")


def _members(vectors: DataFrame, classes: DataFrame, edges: DataFrame, k: int, least: float, queries: DataFrame | None) -> DataFrame:
    """Neighbours of rows from the neighbours of classes of equal vectors."""
    # of a class with several members few are ever neighbours: the first k + 1 by id. Vectors meet by 128 bits of them
    plural = classes.where("rep < top").select(F.md5("v").alias("h"), "rep")
    members = vectors.select("id", F.md5("v").alias("h")).join(plural, "h").select("rep", "id").distinct()
    first = _first_members(members, k + 1)
    edges = edges.withColumn("rank", F.row_number().over(Window.partitionBy("x").orderBy(F.desc("cosine"), "y"))).where(F.col("rank") <= k).drop("rank")
    x_members = members.withColumnRenamed("rep", "x")
    out = edges.join(x_members, "x", "left").select(F.coalesce("id", "x").alias("id"), "y", "cosine")
    out = out.join(first.withColumnRenamed("rep", "y").withColumnRenamed("id", "mate"), "y", "left").select("id", F.coalesce("mate", "y").alias("other"), "cosine").where("id <> other")
    if least <= 1:
        mates = members.join(first.withColumnRenamed("id", "mate"), "rep").where("id <> mate").select("id", F.col("mate").alias("other"), F.lit(1.0).alias("cosine"))
        out = out.unionByName(mates)
    if queries is not None:
        out = out.join(queries.select("id"), "id", "left_semi")
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "other")))
    return ranked.where(F.col("rank") <= k)


def _first_members(members: DataFrame, n: int) -> DataFrame:
    """The first ``n`` ids of each class: of every salted part first, then of the parts' firsts, so that a class of
    very many copies is never in one task."""
    salted = members.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    near = salted.withColumn("rank", F.row_number().over(Window.partitionBy("rep", "salt").orderBy("id"))).where(F.col("rank") <= n)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("rank") <= n).select("rep", "id")


def similar_pairs(found: DataFrame) -> DataFrame:
    """``id_a``, ``id_b``: each pair of neighbours once, the smaller id first."""
    return found.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


def exact_neighbours(df: DataFrame, ident: str, vector: str, dim: int, queries: Sequence, k: int) -> DataFrame:
    """``id``, ``other``, ``cosine`` of the listed ids by comparison with every row: the measure of the index's recall."""
    vectors = usable_vectors(df, ident, vector, dim).dropDuplicates(["id"])
    wanted = vectors.where(F.col("id").isin(list(queries))).collect()
    ids, q = [r.id for r in wanted], unit(np.frombuffer(b"".join(bytes(r.v) for r in wanted), np.float32).reshape(-1, dim))
    kind = df.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = q @ unit(matrix(b.column(1), dim)).T
                near = np.argsort(-s, axis=1)[:, : k + 1]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(ids, dtype=object), near.shape[1])), b.column(0).take(pa.array(near.ravel())), pa.array(np.take_along_axis(s, near, 1).ravel().astype(np.float64))], names=["id", "other", "cosine"])

    near = vectors.mapInArrow(run, f"id {kind}, other {kind}, cosine DOUBLE").where("id <> other")
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "other"))).where(F.col("rank") <= k).drop("rank")

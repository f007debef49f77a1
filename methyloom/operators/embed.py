"""Vectors, labels and graphs of cells: reduction, neighbours, integration and agreement scores."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import log_gamma
from ..schema import few_values
from ..session import cut
from .ranking import global_rank

#: Query vectors that are compared with all rows at once.
BLOCK = 8192


def usable(df: DataFrame, ident: str, vector: str, dim: int, *more: str) -> DataFrame:
    """``id``, ``v`` (ARRAY<DOUBLE>), ``more``: rows with ``dim`` finite components, not all zero; equal ids count once."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | F.forall(v, lambda x: x == 0)
    return df.where(F.col(ident).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) == dim)).where(~bad).groupBy(F.col(ident).alias("id")).agg(F.min(v).alias("v"), *[F.min(c).alias(c) for c in more])


def centres(vectors: DataFrame, label: str = "label", how: str = "median") -> DataFrame:
    """label, centre: median (or mean) of each component per label."""
    long = vectors.where(F.col(label).isNotNull()).select(label, F.posexplode("v").alias("i", "x"))
    made = F.median("x") if how == "median" else F.avg("x")
    return long.groupBy(label, "i").agg(made.alias("m")).groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centre"))


def capped_per_group(cells: DataFrame, group: str, prop: float = 0.1, least: int = 50, seed: int = 0) -> DataFrame:
    """At most max(n * ``prop``, ``least``) rows of each group, n being all rows, chosen by a seeded hash of ``id``."""
    n = cells.agg((F.greatest(F.count("*") * prop, F.lit(float(least)))).alias("__cap"))
    w = Window.partitionBy(group).orderBy(F.xxhash64(F.lit(seed), "id"), "id")
    return cells.crossJoin(n).withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= F.col("__cap")).drop("__k", "__cap")


def _matrix(b: pa.Array) -> np.ndarray:
    return np.asarray(b.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(b), -1) if len(b) else np.zeros((0, 0))


def moments(vectors: DataFrame, dim: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Number, sum and sum of outer products of all vectors: added up in the tasks, then per place by Spark."""
    size = 1 + dim + dim * dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0))
                total += np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["i", "s"])

    out = np.zeros(size)
    for r in vectors.select("v").mapInArrow(run, "i INT, s DOUBLE").groupBy("i").agg(F.sum("s").alias("s")).collect():
        out[r.i] = r.s
    return out[0], out[1 : 1 + dim], out[1 + dim :].reshape(dim, dim)


class Pca:
    """Reusable scaler and loadings. Signs: the largest loading of each component is positive."""

    def __init__(self, vectors: DataFrame, dim: int, k: int, scale: bool = False, centre: bool = True):
        n, s, q = moments(vectors, dim)
        self.mean = s / max(n, 1) if centre else np.zeros(dim)
        cov = q / max(n, 1) - np.outer(self.mean, self.mean)
        self.scale = np.sqrt(np.maximum(np.diag(cov), 1e-12)) if scale else np.ones(dim)
        value, axes = np.linalg.eigh(cov / np.outer(self.scale, self.scale))
        order = np.argsort(-value)[:k]
        axes = axes[:, order]
        self.axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
        self.variance = value[order]
        self.share = self.variance / max(value.sum(), 1e-300)

    def transform(self, vectors: DataFrame) -> DataFrame:
        """``vectors`` with ``v`` replaced by its components."""
        mean, scale, axes = self.mean, self.scale, self.axes

        @F.arrow_udf("array<double>")
        def project(v: pa.Array) -> pa.Array:
            x = ((_matrix(v) - mean) / scale) @ axes if len(v) else np.zeros((0, axes.shape[1]))
            return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * axes.shape[1]), pa.array(x.ravel()))

        return vectors.withColumn("v", project("v"))


def balanced_pca(vectors: DataFrame, dim: int, k: int, group: str, max_prop: float = 0.1, scale: bool = False) -> tuple[Pca, DataFrame]:
    """Components fitted on at most a share of each group, and all vectors projected on them."""
    fit = Pca(capped_per_group(vectors, group, max_prop), dim, k, scale)
    return fit, fit.transform(vectors)


def lsi(tfidf: DataFrame, k: int, row: str = "cell", col: str = "region", value: str = "tfidf") -> tuple[DataFrame, list[float]]:
    """cell, v: left singular vectors of the (sparse) matrix, by Spark's distributed SVD; and the singular values."""
    from pyspark.mllib.linalg import Vectors
    from pyspark.mllib.linalg.distributed import IndexedRow, IndexedRowMatrix

    cols = global_rank(tfidf.select(col).distinct(), None, [F.col(col)], "j")
    rows = global_rank(tfidf.select(row).distinct(), None, [F.col(row)], "i")
    n = cols.count()
    packed = tfidf.join(cols, col).join(rows, row).groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", F.col(value).alias("x")))).alias("p"))
    matrix = IndexedRowMatrix(packed.rdd.map(lambda r: IndexedRow(r.i, Vectors.sparse(n, [e.j for e in r.p], [e.x for e in r.p]))))
    svd = matrix.computeSVD(min(k, n), computeU=True)
    u = svd.U.rows.map(lambda r: (r.index, [float(x) for x in r.vector])).toDF("i BIGINT, v ARRAY<DOUBLE>")
    return u.join(rows, "i").select(row, "v"), list(svd.s)


class Gram:
    """A dataset's standardisation and the axes and lengths of its features' Gram matrix, from one pass."""

    def __init__(self, vectors: DataFrame, dim: int):
        n, s, q = moments(vectors, dim)
        self.mean = s / max(n, 1)
        cov = q - n * np.outer(self.mean, self.mean)
        self.scale = np.sqrt(np.maximum(np.diag(cov) / max(n, 1), 1e-12))
        value, self.axes = np.linalg.eigh(cov / np.outer(self.scale, self.scale))
        self.length = np.sqrt(np.maximum(value, 0))


def canonical(x: Gram, y: Gram) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Singular vectors and values of X Y', from the two Gram matrices, never forming the cells by cells product."""
    u, s, vt = np.linalg.svd((x.axes * x.length).T @ (y.axes * y.length))
    return u, s, vt.T


def cca(x: DataFrame, y: DataFrame, dim: int, k: int) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """Canonical vectors of two datasets over the same features: both datasets' ``id``, ``v`` and the values."""
    grams, out = (Gram(x, dim), Gram(y, dim)), []
    u, s, v = canonical(*grams)
    for d, g, side in zip((x, y), grams, (u, v)):
        p = Pca.__new__(Pca)
        p.mean, p.scale, p.axes = g.mean, g.scale, g.axes @ (side / np.where(g.length > 1e-9, g.length, np.inf)[:, None])[:, :k]
        out.append(p.transform(d))
    return out[0], out[1], s[:k]


def top_features(loadings: np.ndarray, n: int) -> np.ndarray:
    """The places of the features (rows of ``loadings``) that are among the first i by absolute loading of any component
    (column), for the least i, from n / components on, that gives more than ``n`` of them; at most ten times as many a
    component are looked at."""
    rows, parts = loadings.shape
    most = min(n * 10 // parts, rows - 1)
    place = np.argsort(np.argsort(-np.abs(loadings), axis=0, kind="stable"), axis=0, kind="stable").min(1)
    enough = [i for i in range(n // parts + 1, most) if (place < i).sum() > n]
    return np.flatnonzero(place < (enough[0] if enough else most))


def density_sample(vectors: DataFrame, size: int | None = None, portion: float | None = None, k: int = 20, seed: int = 0) -> DataFrame:
    """``size`` rows (or ``portion`` of all) of ``vectors`` (id, v), fewer where they lie dense: a row is drawn, without
    putting back, with the root of its scaled local outlier factor among its ``k`` nearest as weight. Neighbours are
    exact (:func:`knn`); draws come from a seeded hash, so they are the same wherever they run."""
    if (size is None) == (portion is None):
        raise ValueError("give size or portion")
    near = cut(knn(vectors, vectors, k))
    far = near.groupBy("id").agg(F.max("dist").alias("far"))
    reach = near.join(far.select(F.col("id").alias("other"), "far"), "other").groupBy("id").agg((1 / (F.avg(F.greatest("dist", "far")) + 1e-10)).alias("density"))
    factor = near.join(reach.select(F.col("id").alias("other"), F.col("density").alias("theirs")), "other").groupBy("id").agg(F.avg("theirs").alias("theirs")).join(reach, "id").select("id", (F.col("theirs") / F.col("density")).alias("factor"))
    span = factor.agg(F.min("factor").alias("lo"), F.max("factor").alias("hi"), F.count("*").alias("n")).first()
    most = size if size is not None else int(span.n * portion)
    weight = F.sqrt((F.col("factor") - F.lit(span.lo)) / F.lit((span.hi or 0) - (span.lo or 0))) if span.n and span.hi > span.lo else F.lit(1.0)
    uniform = (F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)
    drawn = factor.select("id", weight.alias("w")).orderBy(F.try_divide(-F.ln(uniform), "w").asc_nulls_last(), "id").limit(most)
    return vectors.join(drawn.select("id"), "id", "left_semi")


def common_features(left: DataFrame, right: DataFrame, feature: str = "region") -> tuple[DataFrame, DataFrame]:
    """The rows of two datasets whose feature both have."""
    a, b = (d.select(feature).distinct() for d in (left, right))
    return left.join(b, feature, "left_semi"), right.join(a, feature, "left_semi")


def knn(queries: DataFrame, data: DataFrame, k: int, metric: str = "euclidean") -> DataFrame:
    """id, other, rank (from 1), dist: for each query its ``k`` nearest other rows of ``data``, ties by id. Exact: queries
    go to the tasks in blocks of BLOCK, and each task keeps ``k`` per query of what it scans."""
    found = None
    kind = data.schema["id"].dataType.simpleString()

    def blocks() -> Iterator[tuple[list, np.ndarray]]:
        ids, rows = [], []
        for r in queries.select("id", "v").toLocalIterator():
            ids.append(r.id)
            rows.append(r.v)
            if len(ids) == BLOCK:
                yield ids, np.array(rows)
                ids, rows = [], []
        if ids:
            yield ids, np.array(rows)

    for ids, q in blocks():
        names = np.array(ids, dtype=object)

        def run(batches: Iterator[pa.RecordBatch], names: np.ndarray = names, q: np.ndarray = q) -> Iterator[pa.RecordBatch]:
            u = q / np.linalg.norm(q, axis=1, keepdims=True) if metric == "cosine" else q
            for b in batches:
                if not b.num_rows:
                    continue
                x = _matrix(b.column(1))
                if metric == "cosine":
                    d = 1 - u @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
                else:
                    d = np.sqrt(np.maximum((u * u).sum(1)[:, None] - 2 * u @ x.T + (x * x).sum(1), 0))
                m = min(k + 1, d.shape[1])
                near = np.argpartition(d, m - 1, axis=1)[:, :m] if m < d.shape[1] else np.tile(np.arange(m), (len(d), 1))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, m)), b.column(0).take(pa.array(near.ravel())), pa.array(np.take_along_axis(d, near, 1).ravel())], names=["id", "other", "dist"])

        part = data.select("id", "v").mapInArrow(run, f"id {kind}, other {kind}, dist DOUBLE")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return data.sparkSession.createDataFrame([], f"id {kind}, other {kind}, rank INT, dist DOUBLE")
    w = Window.partitionBy("id").orderBy("dist", "other")
    return found.where("id <> other").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("id", "other", "rank", "dist")


def mutual_neighbours(g12: DataFrame, g21: DataFrame, k: int) -> DataFrame:
    """x1, x2: pairs within each other's first ``k`` neighbours."""
    a = g12.where(F.col("rank") <= k).select(F.col("id").alias("x1"), F.col("other").alias("x2"))
    b = g21.where(F.col("rank") <= k).select(F.col("other").alias("x1"), F.col("id").alias("x2"))
    return a.join(b, ["x1", "x2"])


def _scaled(df: DataFrame, c: str) -> DataFrame:
    q = df.agg(F.percentile(c, 0.01).alias("__lo"), F.percentile(c, 0.9).alias("__hi"))
    return df.crossJoin(q).withColumn(c, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.try_divide(F.col(c) - F.col("__lo"), F.col("__hi") - F.col("__lo")), F.lit(0.0))))).drop("__lo", "__hi")


def score_anchors(anchors: DataFrame, g11: DataFrame, g12: DataFrame, g21: DataFrame, g22: DataFrame, k: int = 30) -> DataFrame:
    """x1, x2, score: how many of the first ``k`` neighbours the two cells share in both datasets, scaled between the
    1st and 90th percentile of all anchors."""

    def near(g: DataFrame, name: str) -> DataFrame:
        return g.where(F.col("rank") <= k).groupBy("id").agg(F.collect_set("other").alias(name))

    j = anchors.join(near(g11, "n11").withColumnRenamed("id", "x1"), "x1").join(near(g12, "n12").withColumnRenamed("id", "x1"), "x1").join(near(g21, "n21").withColumnRenamed("id", "x2"), "x2").join(near(g22, "n22").withColumnRenamed("id", "x2"), "x2")
    s = j.select("x1", "x2", (F.size(F.array_intersect("n11", "n21")) + F.size(F.array_intersect("n12", "n22"))).cast("double").alias("score"))
    return _scaled(s, "score")


def filter_anchors(anchors: DataFrame, neighbours: DataFrame, k: int = 200) -> DataFrame:
    """The anchors whose cells are still within ``k`` neighbours in another feature space (id, other, rank)."""
    near = neighbours.where(F.col("rank") <= k).select(F.col("id").alias("x2"), F.col("other").alias("x1"))
    return anchors.join(near, ["x1", "x2"], "left_semi")


def anchor_weights(anchors: DataFrame, query: DataFrame, k: int = 100, sd: float = 1.0) -> DataFrame:
    """id, x1, x2, weight: the ``k`` anchors nearest to each query cell with weights 1 - exp(-d sd^2 / 4) of the scored,
    scaled distance, normalised per cell. ``anchors``: x1 (reference), x2 (query), score."""
    at = anchors.join(query.select(F.col("id").alias("x2"), "v"), "x2").select(F.concat_ws("\1", "x1", "x2").alias("id"), "v", "x1", "x2", "score")
    near = knn(query.withColumn("id", F.concat(F.lit("\2"), "id")), at.select("id", "v"), k).join(at.select(F.col("id").alias("other"), "x1", "x2", "score"), "other")
    w = Window.partitionBy("id")
    far = F.max("dist").over(w)
    d = F.when(far == 0, F.col("score")).otherwise((1 - F.try_divide(F.col("dist"), far)) * F.col("score"))
    near = near.withColumn("weight", 1 - F.exp(-d * sd * sd / 4))
    return near.select(F.substring("id", 2, 1 << 30).alias("id"), "x1", "x2", (F.col("weight") / (F.sum("weight").over(w) + 1e-6)).alias("weight"))


def transfer_labels(weights: DataFrame, labels: DataFrame) -> DataFrame:
    """id, label, score: the reference label with the largest weight of each query cell (ties by label)."""
    s = weights.join(labels.select(F.col("id").alias("x1"), "label"), "x1").groupBy("id", "label").agg(F.sum("weight").alias("score"))
    return s.withColumn("__k", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "label"))).where("__k = 1").drop("__k")


def corrected(weights: DataFrame, query: DataFrame, reference: DataFrame) -> DataFrame:
    """id, v: query vectors moved by the weighted differences of their anchors."""
    a = weights.join(reference.select(F.col("id").alias("x1"), F.col("v").alias("rv")), "x1").join(query.select(F.col("id").alias("x2"), F.col("v").alias("qv")), "x2")
    long = a.select("id", "weight", F.posexplode(F.zip_with("rv", "qv", lambda r, q: r - q)).alias("i", "d"))
    shift = long.groupBy("id", "i").agg(F.sum(F.col("weight") * F.col("d")).alias("d")).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "d"))), lambda s: s["d"]).alias("shift"))
    return query.join(shift, "id", "left").select("id", F.when(F.col("shift").isNull(), F.col("v")).otherwise(F.zip_with("v", "shift", lambda x, s: x + s)).alias("v"))


def alignment(neighbours: DataFrame, datasets: DataFrame, k: int) -> DataFrame:
    """dataset, alignment: 1 - (same - k / n) / (k - k / n), same being the mean number of neighbours of the own dataset
    and n the number of datasets (which are taken to be of equal size)."""
    own = datasets.select("id", F.col("dataset").alias("dataset"))
    j = neighbours.join(own, "id").join(own.select(F.col("id").alias("other"), F.col("dataset").alias("theirs")), "other")
    n = own.agg(F.count_distinct("dataset").alias("n"))
    same = j.groupBy("dataset", "id").agg(F.count_if(F.col("dataset") == F.col("theirs")).alias("same")).groupBy("dataset").agg(F.avg("same").alias("same")).crossJoin(n)
    return same.select("dataset", (1 - F.try_divide(F.col("same") - k / F.col("n"), k - k / F.col("n"))).alias("alignment"))


def gamma_tail(a: float, x: np.ndarray) -> np.ndarray:
    """Regularised upper incomplete gamma function."""
    x = np.asarray(x, np.float64)
    term, total = np.full_like(x, 1 / a), np.full_like(x, 1 / a)
    for n in range(1, 500):
        term = term * x / (a + n)
        total += term
    with np.errstate(divide="ignore"):
        low = np.where(x > 0, total * np.exp(-x + a * np.log(np.maximum(x, 1e-300)) - log_gamma(np.array([a]))[0]), 0)
    return np.clip(1 - low, 0, 1)


def kbet(neighbours: DataFrame, datasets: DataFrame, alpha: float = 0.05) -> DataFrame:
    """accept_rate: share of cells whose neighbours' datasets agree with the overall shares (chi-square test)."""
    total = datasets.where("dataset IS NOT NULL").agg(F.count("*").alias("total"), F.count_distinct("dataset").alias("sets"))
    share = datasets.where("dataset IS NOT NULL").groupBy("dataset").agg(F.count("*").alias("n")).crossJoin(total).select("dataset", (F.col("n") / F.col("total")).alias("share"), "sets")
    seen = neighbours.join(datasets.select(F.col("id").alias("other"), "dataset"), "other").groupBy("id", "dataset").agg(F.count("*").alias("seen")).join(share, "dataset")
    # datasets without a neighbour are in the sum too: that of (seen - k share)^2 / (k share) is that of seen^2 / (k share) less k
    k = F.sum("seen")
    stat = seen.groupBy("id").agg(F.greatest(F.sum(F.col("seen") * F.col("seen") / F.col("share")) / k - k, F.lit(0.0)).alias("x"), F.max(F.greatest(F.col("sets") - 1, F.lit(1))).cast("double").alias("df"))

    @F.arrow_udf("double")
    def tail(x: pa.Array, df: pa.Array) -> pa.Array:
        v, out = x.to_numpy(zero_copy_only=False), np.ones(len(x))
        free = df.to_numpy(zero_copy_only=False)
        for d in np.unique(free):
            out[free == d] = gamma_tail(d / 2, v[free == d] / 2)
        return pa.array(out)

    return stat.select(tail("x", "df").alias("p")).agg(F.avg((F.col("p") >= alpha).cast("double")).alias("accept_rate"))


def plate_pivot(labels: DataFrame, row: str, column: str, aggregate: Column | None = None) -> DataFrame:
    """One row per ``row`` and one column per value of ``column`` (few: see :func:`few_values`), which holds ``aggregate``
    of their rows (the number of rows unless told); 0 where there are none."""
    names = few_values(labels, column, 10_000)
    return labels.groupBy(row).pivot(column, names).agg(aggregate if aggregate is not None else F.count(F.lit(1))).fillna(0)


def confusion(labels: DataFrame, a: str, b: str) -> DataFrame:
    return labels.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))


def purity(labels: DataFrame, a: str, b: str) -> DataFrame:
    """purity: share of rows with the most common ``b`` of their ``a``."""
    return confusion(labels, a, b).groupBy(a).agg(F.max("n").alias("m"), F.sum("n").alias("n")).agg(F.try_divide(F.sum("m"), F.sum("n")).alias("purity"))


def adjusted_rand(labels: DataFrame, a: str, b: str) -> DataFrame:
    """ari: adjusted Rand index from counts of pairs of labels."""
    c = confusion(labels, a, b).select(a, b, F.col("n").cast("double").alias("n"))
    two = lambda x: x * (x - 1) / 2
    cell = c.agg(F.sum(two(F.col("n"))).alias("ab"), F.sum("n").alias("n"))
    rows = c.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("a"))
    cols = c.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("b"))
    e = F.try_divide(F.col("a") * F.col("b"), two(F.col("n")))
    return cell.crossJoin(rows).crossJoin(cols).select(F.try_divide(F.col("ab") - e, (F.col("a") + F.col("b")) / 2 - e).alias("ari"))


def shannon(labels: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """sdi: Shannon diversity of ``label`` per ``by``."""
    c = labels.where(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1)))
    return c.select(*by, (-p * F.ln(p)).alias("t")).groupBy(*by).agg(F.sum("t").alias("sdi"))


def overlap_scores(left: DataFrame, right: DataFrame) -> DataFrame:
    """left, right, overlap: sum over common co-clusters of the smaller share. Both have cluster, co_cluster."""

    def shares(d: DataFrame, name: str) -> DataFrame:
        c = d.groupBy("cluster", "co_cluster").agg(F.count("*").alias("n"))
        total = c.groupBy("cluster").agg(F.sum("n").alias("t"))
        return c.join(total, "cluster").select(F.col("cluster").alias(name), "co_cluster", (F.col("n") / F.col("t")).alias(f"s_{name}"))

    return shares(left, "left").join(shares(right, "right"), "co_cluster").groupBy("left", "right").agg(F.sum(F.least("s_left", "s_right")).alias("overlap"))


def diagonal_score(overlaps: DataFrame, groups_left: DataFrame, groups_right: DataFrame) -> DataFrame:
    """score: sum of mean overlaps of equal groups over that of different groups."""
    j = overlaps.join(groups_left.select("left", "gl"), "left").join(groups_right.select("right", "gr"), "right").groupBy("gl", "gr").agg(F.avg("overlap").alias("m"))
    same = F.col("gl") == F.col("gr")
    return j.agg(F.try_divide(F.sum(F.when(same, F.col("m")).otherwise(0.0)), F.sum(F.when(same, 0.0).otherwise(F.col("m")))).alias("score"))


def confusion_pairs(labels: DataFrame, true: str, predicted: str, cutoff: float = 0.001) -> DataFrame:
    """a, b: unordered pairs of different labels whose confusion, as a share of the row or column, exceeds ``cutoff``."""
    c = confusion(labels, true, predicted)
    r = F.col("n") / F.sum("n").over(Window.partitionBy(true))
    k = F.col("n") / F.sum("n").over(Window.partitionBy(predicted))
    hit = c.withColumns({"__r": r, "__c": k}).where(((F.col("__r") > cutoff) | (F.col("__c") > cutoff)) & (F.col(true) != F.col(predicted)))
    return hit.select(F.least(true, predicted).alias("a"), F.greatest(true, predicted).alias("b")).distinct()


def normalised_confusion(labels: DataFrame, true: str, predicted: str) -> DataFrame:
    """true, predicted, n, r1, r2: confusions of two labels relative to the larger (r1) and to the geometric mean (r2) of
    their own diagonal counts, the larger of both directions."""
    c = confusion(labels, true, predicted)
    d = c.where(F.col(true) == F.col(predicted)).select(F.col(true).alias("l"), F.col("n").alias("d"))
    j = c.where(F.col(true) != F.col(predicted)).join(d.select(F.col("l").alias(true), F.col("d").alias("d1")), true, "left").join(d.select(F.col("l").alias(predicted), F.col("d").alias("d2")), predicted, "left").fillna(0, ["d1", "d2"])
    r1 = F.try_divide(F.col("n"), F.col("n") + F.col("d1"))
    r2 = F.try_divide(F.col("n"), F.sqrt((F.col("d1") + F.col("n")) * (F.col("d2") + F.col("n"))))
    return j.select(F.least(true, predicted).alias("a"), F.greatest(true, predicted).alias("b"), "n", r1.alias("r1"), r2.alias("r2")).groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("r1").alias("r1"), F.max("r2").alias("r2"))


def connected_components(edges: DataFrame) -> DataFrame:
    """id, component (its least id) of the graph of edges (a, b): least labels spread along edges and are then shortened,
    until none changes; each round's labels are kept in the shared folder."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.least("a", F.min("b")).alias("c")))
    while True:
        near = both.join(labels.select(F.col("a").alias("b"), F.col("c").alias("cb")), "b").groupBy("a").agg(F.min("cb").alias("m"))
        step = labels.join(near, "a", "left").select("a", F.least("c", F.coalesce("m", "c")).alias("c"), F.col("c").alias("old"))
        jump = step.join(step.select(F.col("a").alias("c"), F.col("c").alias("cc")), "c", "left").select("a", F.least("c", F.coalesce("cc", "c")).alias("c"), "old")
        new = cut(jump)
        labels = new.select("a", "c")
        if new.where("c <> old").isEmpty():
            break
    return labels.select(F.col("a").alias("id"), F.col("c").alias("component"))


def pseudo_groups(vectors: DataFrame, cluster: str, max_size: int = 25, axes: int = 6) -> DataFrame:
    """id, pseudo: each cluster's cells in groups of at most ``max_size`` near ones: cells are ordered along a Z-curve of
    their first ``axes`` components and the order is cut. One global sort; no cluster is one task."""
    spans = vectors.select(*[F.stddev_pop(F.col("v")[i]).alias(f"s{i}") for i in range(axes)])
    bits = 6
    j = vectors.crossJoin(spans)
    code: Column = F.lit(0).cast("long")
    for i in range(axes):
        level = F.greatest(F.lit(0), F.least(F.lit(2**bits - 1), F.floor((F.coalesce(F.try_divide(F.col("v")[i], F.col(f"s{i}")), F.lit(0.0)) + 3) / 6 * 2**bits))).cast("long")
        for b in range(bits):
            code = code.bitwiseOR(F.shiftleft(F.shiftright(level, b).bitwiseAND(F.lit(1).cast("long")), b * axes + i))
    ranked = global_rank(j.select("id", cluster, code.alias("z")), cluster, [F.col("z"), F.col("id")])
    return ranked.select("id", F.concat_ws("::", F.col(cluster), F.floor(F.col("rank") / max_size).cast("string")).alias("pseudo"))


def ks_statistics(vectors: DataFrame, components: int) -> DataFrame:
    """i, d, p: Kolmogorov-Smirnov distance of component i and i + 1 over all rows, and its asymptotic p-value."""
    long = vectors.select(F.posexplode("v").alias("i", "x")).where(F.col("i") < components)
    two = long.select("i", "x", F.lit(1).alias("first")).unionByName(long.where("i > 0").select((F.col("i") - 1).alias("i"), "x", F.lit(0).alias("first"))).where(F.col("i") < components - 1)
    c = two.groupBy("i", "x").agg(F.sum("first").alias("a"), F.sum(1 - F.col("first")).alias("b"))
    n = c.groupBy("i").agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    w = Window.partitionBy("i").orderBy("x")
    d = c.join(n, "i").select("i", "na", F.abs(F.sum("a").over(w) / F.col("na") - F.sum("b").over(w) / F.col("nb")).alias("d")).groupBy("i").agg(F.max("d").alias("d"), F.max("na").alias("n"))
    t = F.col("d") * F.sqrt(F.col("n") / 2)
    series = sum(((-1) ** (j - 1)) * 2 * F.exp(-2.0 * j * j * t * t) for j in range(1, 51))
    return d.select("i", "d", F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)).alias("p"))


def tight_range(values: DataFrame, value: str, portion: float, steps: int = 100) -> DataFrame:
    """low, high: the narrowest of the quantile windows that hold ``portion`` of the values."""
    n = int(round((1 - portion) * steps))
    q = [i / steps for i in range(n + 1)] + [i / steps + portion for i in range(n + 1)]
    p = values.agg(F.percentile(value, F.array(*[F.lit(min(x, 1.0)) for x in q])).alias("q"))
    pairs = F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.struct((F.col("q")[i + n + 1] - F.col("q")[i]).alias("w"), F.col("q")[i].alias("low"), F.col("q")[i + n + 1].alias("high")))
    best = F.array_min(pairs)
    return p.select(best["low"].alias("low"), best["high"].alias("high"))


def survival(values: DataFrame, value: str, thresholds: Sequence[float]) -> DataFrame:
    """threshold, share: share of the rows above each threshold; one aggregate."""
    made = [F.struct(F.lit(float(t)).alias("threshold"), F.try_divide(F.count_if(F.col(value) > t), F.count(value)).alias("share")) for t in thresholds]
    return values.agg(F.array(*made).alias("a")).select(F.inline("a"))

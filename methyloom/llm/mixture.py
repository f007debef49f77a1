"""Clusters of vectors as a Gaussian mixture, fitted to all rows by expectation-maximisation."""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut
from .neighbours import first_by_hash, matrix, usable_vectors

#: Least number of rows, by hash of the id, from which starting points are drawn, and rows drawn for each component if
#: that is more. Models start from these rows alone; all rows give the criterion that picks one and then refine it. A
#: cluster gets a start of its own only if the sample holds some of its rows: of 8,192 rows it holds at least one from a
#: cluster of a share of 0.06 % with a probability of 99 %, and needs several to tell them from stray rows.
SAMPLE, SAMPLE_EACH = 8192, 64


@dataclass
class Mixture:
    """Weights (k), means (k x d) and covariances (k x d x d); ``tied``: all components have the same covariance."""

    weight: np.ndarray
    mean: np.ndarray
    cov: np.ndarray
    tied: bool = False

    def log_density(self, z: np.ndarray, zz: np.ndarray | None = None) -> np.ndarray:
        """Log of weight times density of each row under each component; ``zz``: :func:`products` of ``z``."""
        k, d = self.mean.shape
        root = np.linalg.cholesky(self.cov)
        inverse = np.linalg.inv(root)
        precision = np.einsum("kji,kjl->kil", inverse, inverse)
        slope = np.einsum("kij,kj->ki", precision, self.mean)
        first, second = np.triu_indices(d)
        twice = precision[:, first, second] * np.where(first == second, 1.0, 2.0)
        square = (products(z) if zz is None else zz) @ twice.T - 2 * (z @ slope.T) + (slope * self.mean).sum(1)
        half = np.log(np.diagonal(root, axis1=1, axis2=2)).sum(1)
        return np.log(self.weight) - 0.5 * d * math.log(2 * math.pi) - half - 0.5 * np.maximum(square, 0)

    def free_parameters(self) -> int:
        k, d = self.mean.shape
        return k * (1 + d) - 1 + (1 if self.tied else k) * (d * (d + 1) // 2)


def products(z: np.ndarray) -> np.ndarray:
    """The products of every two features of each row, each pair once."""
    first, second = np.triu_indices(z.shape[1])
    return z[:, first] * z[:, second]


def soft(logs: np.ndarray) -> tuple[np.ndarray, float]:
    """Responsibilities and the log-likelihood."""
    top = logs.max(1, keepdims=True)
    p = np.exp(logs - top)
    s = p.sum(1, keepdims=True)
    return p / s, float((top + np.log(s)).sum())


def sufficient(model: Mixture, z: np.ndarray, zz: np.ndarray | None = None) -> np.ndarray:
    """Log-likelihood, then for each component its sum of responsibilities, of rows and of outer products."""
    zz = products(z) if zz is None else zz
    r, like = soft(model.log_density(z, zz))
    return np.concatenate([[like], _sums(r, z, zz)])


def _sums(r: np.ndarray, z: np.ndarray, zz: np.ndarray) -> np.ndarray:
    d = z.shape[1]
    place = np.zeros((d, d), np.int64)
    place[np.triu_indices(d)] = np.arange(zz.shape[1])
    place = np.maximum(place, place.T)
    return np.concatenate([r.sum(0), (r.T @ z).ravel(), (r.T @ zz)[:, place.ravel()].ravel()])


def updated(stats: np.ndarray, k: int, d: int, n: float, ridge: float, tied: bool = False) -> Mixture:
    """The mixture of the sums; covariances are regularised by ``ridge`` and, with few rows, drawn to the identity."""
    n_k, first, second = stats[1 : 1 + k], stats[1 + k : 1 + k + k * d].reshape(k, d), stats[1 + k + k * d :].reshape(k, d, d)
    live = np.maximum(n_k, 1e-9)
    mean = first / live[:, None]
    cov = second / live[:, None, None] - mean[:, :, None] * mean[:, None, :]
    if tied:
        cov = np.broadcast_to(np.einsum("k,kij->ij", n_k, cov) / max(n, 1.0), cov.shape)
        cov = (cov + cov.transpose(0, 2, 1)) / 2 + ridge * np.eye(d)
        return Mixture(np.maximum(n_k / n, 1e-12), mean, cov, True)
    prior = d + 2.0
    cov = (cov * live[:, None, None] + prior * np.eye(d) * ridge * 10) / (live[:, None, None] + prior)
    cov = (cov + cov.transpose(0, 2, 1)) / 2 + ridge * np.eye(d)
    return Mixture(np.maximum(n_k / n, 1e-12), mean, cov)


#: Sets of seeds that are tried for a number of components.
TRIES = 4


def seeded(z: np.ndarray, k: int, trial: int) -> tuple[float, np.ndarray]:
    """Cost and clusters of k-means from spread-out seeds."""
    rng = np.random.default_rng([k, trial])
    length = (z * z).sum(1)

    def far(points: np.ndarray) -> np.ndarray:
        return np.maximum(length - 2 * points @ z.T + (points * points).sum(1)[:, None], 0)

    centre = z[[rng.integers(len(z))]]
    near = far(centre)[0]
    for _ in range(k - 1):
        # of some draws by squared distance the one that helps most
        draw = np.searchsorted(np.cumsum(near), rng.random(8) * near.sum()).clip(0, len(z) - 1) if near.sum() > 0 else rng.integers(len(z), size=8)
        options = np.minimum(near, far(z[draw]))
        pick = options.sum(1).argmin()
        centre, near = np.vstack([centre, z[draw[pick]]]), options[pick]
    for _ in range(6):
        own = far(centre).argmin(0)
        size = np.bincount(own, minlength=k)
        sums = np.stack([np.bincount(own, z[:, j], k) for j in range(z.shape[1])], 1)
        centre = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centre)
    return float(((z - centre[own]) ** 2).sum()), own


def fitted(z: np.ndarray, own: np.ndarray, k: int, tied: bool, ridge: float, steps: int = 10) -> Mixture:
    """A mixture of the given clusters after a few steps of expectation-maximisation on the sample."""
    zz = products(z)
    model = updated(np.r_[0.0, _sums(np.eye(k)[own], z, zz)], k, z.shape[1], len(z), ridge, tied)
    for _ in range(steps):
        model = updated(sufficient(model, z, zz), k, z.shape[1], len(z), ridge, tied)
    return model


def starts(spark: SparkSession, z: np.ndarray, numbers: Sequence[int], ridge: float, steps: int = 10) -> dict[int, list[Mixture]]:
    """For each number of components a mixture with own covariances and one with a common covariance, fitted to the
    sample ``z`` (broadcast) from the best of TRIES sets of seeds: one task a set of seeds, then one a mixture."""
    shared = spark.sparkContext.broadcast(z)

    def spread(jobs: list[tuple], work: Callable) -> list:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for job in b.column(1).to_pylist():
                    yield pa.RecordBatch.from_pydict({"made": [pickle.dumps(work(*pickle.loads(job)))]})

        # the dearest first, one a partition
        jobs = sorted(jobs, key=lambda j: -j[0])
        rows = spark.createDataFrame([(i, bytearray(pickle.dumps(j))) for i, j in enumerate(jobs)], "i INT, job BINARY").repartitionByRange(len(jobs), "i")
        return [pickle.loads(r.made) for r in rows.mapInArrow(run, "made BINARY").collect()]

    tried = spread([(k, t) for k in numbers for t in range(TRIES)], lambda k, t: (k, *seeded(shared.value, k, t)))
    best = {k: min(((cost, own) for j, cost, own in tried if j == k), key=lambda x: x[0])[1] for k in numbers}
    done = spread([(k, tied, best[k]) for k in numbers for tied in (False, True)], lambda k, tied, own: (k, fitted(shared.value, own, k, tied, ridge, steps)))
    shared.unpersist()
    return {k: sorted((m for j, m in done if j == k), key=lambda m: m.tied) for k in numbers}


def best_count(rate: Callable[[list[int]], Sequence[float]], most: int) -> int:
    """The number from 1 to ``most`` of least ``rate``: doubled from 1 until the best is followed by two that are worse,
    then searched around the best by steps that are halved down to one. ``rate`` gives the values of several numbers."""
    seen: dict[int, float] = {}

    def look(numbers: list[int]) -> int:
        new = [k for k in numbers if 1 <= k <= most and k not in seen]
        seen.update(zip(new, rate(new) if new else []))
        return min(seen, key=lambda k: (seen[k], k))

    top = 32
    best = look([1, 2, 4, 8, 16, top])
    while top < 4 * best and 2 * top <= most:
        top *= 2
        best = look([top])
    step = max(best // 2, 1)
    while True:
        last, best = best, look([best - step, best + step])
        if best == last:
            if step == 1:
                return best
            step = (step + 1) // 2


def summed(df: DataFrame, make: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum over all rows of the vector that ``make`` gives for a batch: added up in each task, then by Spark per
    place. Only ``size`` numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += make(b)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["i", "s"])

    out = np.zeros(size)
    for r in df.mapInArrow(run, "i INT, s DOUBLE").groupBy("i").agg(F.sum("s").alias("s")).collect():
        out[r.i] = r.s
    return out


@dataclass
class Reducer:
    """Standardises vectors and projects them on their first principal axes, each scaled to variance one of noise."""

    mean: np.ndarray
    scale: np.ndarray
    axes: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.axes


def fit_reducer(vectors: DataFrame, dim: int, reduced: int) -> tuple[Reducer, int]:
    """The reducer from the moments of all rows, and how many rows there are."""

    def moments(b: pa.RecordBatch) -> np.ndarray:
        x = matrix(b.column(0), dim).astype(np.float64)
        return np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])

    m = summed(vectors.select("v"), moments, 1 + dim + dim * dim)
    n = max(m[0], 1.0)
    mean = m[1 : 1 + dim] / n
    cov = m[1 + dim :].reshape(dim, dim) / n - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    _, axes = np.linalg.eigh(cov / np.outer(scale, scale))
    return Reducer(mean, scale, axes[:, ::-1][:, :reduced]), int(m[0])


def mixture_members(df: DataFrame, ident: str, vector: str, dim: int, label: Column, components: Sequence[int] | None = None, reduced: int = 16, rounds: int = 6, ridge: float = 1e-3, sample: int = SAMPLE) -> DataFrame:
    """``id``, ``label``, ``cluster``, ``density``: each row with a usable vector, its most probable component and the
    log density of its features there.

    Rows with the same id count once (of several labels the smallest). Left out are null ids and vectors that are null,
    of another size than ``dim``, not finite or all zero. Equal vectors fall in the same cluster. With an empty table
    the result is empty; fewer rows than components leave out those numbers of components.

    Vectors are standardised and reduced to their first principal axes (moments of all rows, one pass). Starting points
    come from a sample of ``sample`` rows, more for many components (see SAMPLE); passes over all rows give every
    competing number of components, with own and with one common covariance, its likelihood and sums, the Bayesian
    information criterion over all rows picks one, and up to ``rounds`` passes of expectation-maximisation over all rows
    refine it. Unless ``components`` lists them, the competing numbers are those of :func:`best_count`, without an upper
    end but four rows a component. A pass adds up sums in the tasks: what moves grows with components times features
    squared, not with rows.
    """
    spark = df.sparkSession
    kind = df.schema[ident].dataType.simpleString()
    wanted = df.select(F.col(f"`{ident}`").alias("id"), F.col(f"`{vector}`").alias("vector"), label.alias("label"))
    labels = wanted.where("id IS NOT NULL").groupBy("id").agg(F.min("label").alias("label"))
    vectors = cut(usable_vectors(wanted, "id", "vector", dim).groupBy("id").agg(F.min("v").alias("v")))
    reducer, n = fit_reducer(vectors, dim, min(reduced, dim))
    if not n:
        return spark.createDataFrame([], f"id {kind}, label STRING, cluster INT, density DOUBLE")
    d = reducer.axes.shape[1]

    def features(b: pa.Array) -> np.ndarray:
        return reducer(matrix(b, dim).astype(np.float64))

    drawn: dict[int, np.ndarray] = {}

    def draw(rows: int) -> np.ndarray:
        if rows not in drawn:
            first = first_by_hash(vectors, "id", rows, n).select("v").collect()
            drawn.clear()
            drawn[rows] = reducer(np.frombuffer(b"".join(bytes(r.v) for r in first), np.float32).reshape(-1, dim).astype(np.float64))
        return drawn[rows]

    def one_pass(models: Sequence[Mixture]) -> list[np.ndarray]:
        sizes = [1 + len(m.weight) * (1 + d + d * d) for m in models]

        def add(b: pa.RecordBatch) -> np.ndarray:
            z = features(b.column(0))
            zz = products(z)
            return np.concatenate([sufficient(m, z, zz) for m in models])

        total = summed(vectors.select("v"), add, sum(sizes))
        return np.split(total, np.cumsum(sizes)[:-1])

    best: list = [math.inf, None, None]

    def rate(numbers: list[int]) -> list[float]:
        """The criterion of each number of components; the best model of all is kept."""
        rows = [min(n, max(sample, SAMPLE_EACH * k)) for k in numbers]
        made: dict[int, list[Mixture]] = {}
        for size in dict.fromkeys(rows):
            made |= starts(spark, draw(size), [k for k, r in zip(numbers, rows) if r == size], ridge)
        models = [m for k in numbers for m in made[k]]
        stats = one_pass(models)
        criterion = [m.free_parameters() * math.log(n) - 2 * s[0] for m, s in zip(models, stats)]
        pick = int(np.argmin(criterion))
        if best[1] is None or criterion[pick] < best[0]:
            best[:] = criterion[pick], models[pick], stats[pick]
        return [min(pair) for pair in zip(criterion[::2], criterion[1::2])]

    if components is None:
        best_count(rate, max(1, n // 4))
    else:
        rate([k for k in components if 4 * k <= n] or [1])
    _, picked, stats = best
    tied, like = picked.tied, stats[0]
    model = updated(stats, len(picked.weight), d, n, ridge, tied)
    for _ in range(rounds):
        (s,) = one_pass([model])
        model = updated(s, len(model.weight), d, n, ridge, tied)
        if abs(s[0] - like) < 1e-5 * abs(like):
            break
        like = s[0]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                logs = model.log_density(features(b.column(1)))
                own = logs.argmax(1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own.astype(np.int32)), pa.array(logs[np.arange(len(own)), own])], names=["id", "cluster", "density"])

    members = vectors.select("id", "v").mapInArrow(assign, f"id {kind}, cluster INT, density DOUBLE")
    return members.join(labels, "id").select("id", "label", "cluster", "density")


def cluster_labels(members: DataFrame) -> DataFrame:
    """``cluster``, ``n``, ``label``, ``n_label``: each cluster's size and the label most of its rows have (of equal
    counts the first by name; null where no row has one)."""
    counts = members.groupBy("cluster", "label").agg(F.count("*").alias("n"))
    tops = counts.groupBy("cluster").agg(F.max(F.when(F.col("label").isNotNull(), F.col("n"))).alias("n_label"), F.sum("n").alias("size"))
    named = counts.join(tops, "cluster").where("label IS NOT NULL AND n = n_label").groupBy("cluster").agg(F.min("label").alias("label"))
    return tops.join(named, "cluster", "left").select("cluster", F.col("size").alias("n"), "label", "n_label")


def typical_members(members: DataFrame, n: int = 5) -> DataFrame:
    """``cluster``, ``rank``, ``id``: the ``n`` rows of highest density of each cluster, ties by id. The ranking is
    limited in every task before rows move."""
    order = Window.partitionBy("cluster").orderBy(F.desc("density"), "id")
    return members.select("cluster", "id", F.row_number().over(order).alias("rank"), "density").where(F.col("rank") <= n).select("cluster", "rank", "id")


def doubtful_labels(members: DataFrame) -> DataFrame:
    """``id``, ``label``: rows whose label is null or not the one of their cluster, with the cluster's label."""
    own = cluster_labels(members).where("label IS NOT NULL").select("cluster", F.col("label").alias("cluster_label"))
    return members.join(own, "cluster").where("label IS NULL OR label <> cluster_label").select("id", F.col("cluster_label").alias("label"))

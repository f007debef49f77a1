"""Clusterings and trees: consensus of repeated runs, merging of clusters, linkage trees, graph communities, layouts.

Cells stay distributed; what the driver handles is as large as clusters, runs of clusters or a stated number of rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .doublets import doublet_likelihood, simulate_doublets
from .embed import Pca, capped_per_group, connected_components, knn, normalised_confusion
from .matrix import posterior_frac
from .ranking import global_rank

#: Most choices of runs of a consensus, rows of a layout and clusters of a side of an overlap graph; more raise.
MOST_CHOICES, MOST_ROWS, MOST_CLUSTERS = 10_000, 5_000, 2_000


def average_linkage(dist: np.ndarray) -> list[tuple[int, int, float, int]]:
    """Merges (left, right, height, size) of the average-linkage tree of a small distance matrix; new nodes are numbered
    on from the leaves. Ties go to the first pair."""
    n = len(dist)
    d = {(i, j): float(dist[i, j]) for i in range(n) for j in range(i + 1, n)}
    size = dict.fromkeys(range(n), 1)
    out = []
    for new in range(n, 2 * n - 1):
        (a, b), h = min(d.items(), key=lambda x: (x[1], x[0]))
        out.append((a, b, h, size[a] + size[b]))
        for c in [c for c in size if c not in (a, b)]:
            da, db = d.pop((min(a, c), max(a, c))), d.pop((min(b, c), max(b, c)))
            d[c, new] = (size[a] * da + size[b] * db) / (size[a] + size[b])
        d.pop((a, b))
        size[new] = size.pop(a) + size.pop(b)
    return out


def leaves_of(merges: Sequence[tuple[int, int, float, int]], n: int) -> list[frozenset[int]]:
    """The leaves under each merge."""
    under = {i: frozenset([i]) for i in range(n)}
    for i, (a, b, _, _) in enumerate(merges):
        under[n + i] = under[a] | under[b]
    return [under[n + i] for i in range(len(merges))]


def _correlation_distance(x: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore"):
        return 1 - np.nan_to_num(np.corrcoef(x))


def bootstrap_tree(centres: pd.DataFrame, n_boot: int, spark, seed: int = 0) -> pd.DataFrame:
    """left, right, height, size, members, support of the average-linkage tree of cluster profiles (one row per
    cluster): share of resamplings of the features that give a node with the same members. Resamplings are spread over
    tasks, each with its own seed."""
    x, names = centres.to_numpy(float), list(centres.index)
    merges = average_linkage(_correlation_distance(x))
    nodes = leaves_of(merges, len(x))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            hits = np.zeros(len(nodes), np.int64)
            for i in f["id"]:
                pick = np.random.default_rng([seed, int(i)]).integers(0, x.shape[1], x.shape[1])
                found = set(leaves_of(average_linkage(_correlation_distance(x[:, pick])), len(x)))
                hits += [n in found for n in nodes]
            yield pd.DataFrame({"node": np.arange(len(nodes)), "hits": hits})

    hits = spark.range(n_boot).mapInPandas(run, "node INT, hits BIGINT").groupBy("node").agg(F.sum("hits").alias("hits")).toPandas().set_index("node")["hits"]
    out = pd.DataFrame(merges, columns=["left", "right", "height", "size"])
    out["members"] = [",".join(sorted(str(names[i]) for i in n)) for n in nodes]
    out["support"] = [float(hits.get(i, 0)) / n_boot for i in range(len(nodes))]
    return out


def merge_clusters(centres: dict[str, np.ndarray], keep_apart: Callable[[str, str], bool], concat: str = "::") -> dict[str, str]:
    """Old to new labels: sibling leaves of the tree of centres are merged while ``keep_apart`` does not hold for them;
    a merged cluster has the mean of its parts as centre. ``keep_apart`` may count differential features with Spark."""
    parts = {c: [c] for c in centres}
    centres = dict(centres)
    asked: set[tuple[str, str]] = set()
    while len(centres) > 1:
        names = sorted(centres)
        x = np.array([centres[c] for c in names])
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        for a, b, _, _ in average_linkage(d):
            if a < len(names) and b < len(names):
                pair = (names[a], names[b])
                if pair in asked:
                    continue
                asked.add(pair)
                if not keep_apart(*pair):
                    new = concat.join(pair)
                    parts[new] = parts.pop(pair[0]) + parts.pop(pair[1])
                    centres[new] = (centres.pop(pair[0]) + centres.pop(pair[1])) / 2
                    break
        else:
            break
    return {old: new for new, olds in parts.items() for old in olds}


def repeated_kmeans(vectors: DataFrame, ks: Sequence[int], seed: int = 0) -> DataFrame:
    """id, v, runs: the cluster of each cell in every run of Spark's k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    out = cut(vectors.select("id", "v", array_to_vector("v").alias("features")))
    columns = []
    for i, k in enumerate(ks):
        model = KMeans(k=k, seed=seed + i, maxIter=10).setPredictionCol(f"r{i}").fit(out)
        out = model.transform(out)
        columns.append(f"r{i}")
    return out.select("id", "v", F.array(*columns).alias("runs"))


def consensus(runs: DataFrame, rate: float = 0.7, min_size: int = 10) -> DataFrame:
    """id, v, cluster: cells with the same clusters in all runs form a signature; signatures that agree in at least
    ``rate`` of the runs are linked, and linked ones are one cluster, however many there are; clusters are numbered by
    size, cells of those under ``min_size`` get -1.

    Two signatures agree in m runs if they are equal on one of the choices of m runs. All signatures with the same
    clusters on a choice agree, so each is linked with the least of them: links are as many as signatures times choices,
    and the clusters are the connected components.
    """
    first = runs.select(F.size("runs").alias("n")).first()
    if first is None:
        return runs.select("id", "v", F.lit(-1).alias("cluster"))
    m = max(1, math.ceil(rate * first.n - 1e-9))
    choices = list(itertools.combinations(range(first.n), m))
    if len(choices) > MOST_CHOICES:
        raise ValueError(f"{len(choices)} choices of {m} of {first.n} runs")
    name = F.array_join(F.col("runs").cast("array<string>"), ",")
    signatures = cut(runs.groupBy(name.alias("a")).agg(F.count("*").alias("n"), F.first("runs").alias("runs")))
    keys = F.array(*[F.concat_ws(",", F.lit(f"{i}:"), *[F.col("runs")[j].cast("string") for j in c]) for i, c in enumerate(choices)])
    keyed = signatures.select("a", F.explode(keys).alias("key"))
    edges = keyed.join(keyed.groupBy("key").agg(F.min("a").alias("b")), "key").select("a", "b").distinct()
    component = connected_components(edges)
    sized = signatures.join(component.withColumnRenamed("id", "a"), "a").groupBy("component").agg(F.sum("n").alias("n")).where(F.col("n") >= min_size)
    number = global_rank(sized, None, [F.desc("n"), F.col("component")], "cluster").select("component", F.col("cluster").cast("int").alias("cluster"))
    table = component.join(number, "component").select(F.col("id").alias("__s"), "cluster")
    return runs.withColumn("__s", name).join(table, "__s", "left").select("id", "v", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def supervised(cells: DataFrame, max_train: int = 500, seed: int = 0, classifier=None) -> tuple[DataFrame, DataFrame, float]:
    """Assigns the cells of cluster -1 by a classifier (an estimator of Spark ML with ``features`` and ``cluster``; a random
    forest unless given) trained on at most ``max_train`` cells of each cluster; gives
    all cells (id, v, cluster), the normalised confusions of the cells not trained on, and their accuracy."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    known = cells.where("cluster >= 0")
    train = capped_per_group(known, "cluster", 0.0, max_train, seed)
    if train.select("cluster").distinct().count() < 2:
        return cells.withColumn("cluster", F.lit(0)), cells.sparkSession.createDataFrame([], "a INT, b INT, n BIGINT, r1 DOUBLE, r2 DOUBLE"), 1.0
    vec = lambda d: d.withColumn("features", array_to_vector("v"))
    estimator = classifier if classifier is not None else RandomForestClassifier(labelCol="cluster", numTrees=50, seed=seed)
    model = estimator.fit(vec(train).withColumn("cluster", F.col("cluster").cast("double")))
    predicted = model.transform(vec(cells)).select("id", "v", "cluster", F.col("prediction").cast("int").alias("predicted"))
    test = predicted.where("cluster >= 0").join(train.select("id"), "id", "left_anti")
    accuracy = test.agg(F.avg((F.col("cluster") == F.col("predicted")).cast("double"))).first()[0]
    done = predicted.select("id", "v", F.when(F.col("cluster") < 0, F.col("predicted")).otherwise(F.col("cluster")).alias("cluster"))
    return done, normalised_confusion(test, "cluster", "predicted"), 1.0 if accuracy is None else float(accuracy)


def consensus_clustering(vectors: DataFrame, ks: Sequence[int] = (8, 12, 16, 20), rate: float = 0.7, min_size: int = 10, target: float = 0.95, seed: int = 0, classifier=None) -> DataFrame:
    """id, cluster: consensus of repeated k-means; clusters that a classifier confuses most are merged until it reaches
    ``target`` accuracy on cells it was not trained on. A pass merges two clusters, so it ends with one at the latest."""
    cells = cut(consensus(repeated_kmeans(vectors, ks, seed), rate, min_size))
    while True:
        done, confused, accuracy = supervised(cells, seed=seed, classifier=classifier)
        worst = confused.orderBy(F.desc("r2"), "a", "b").limit(1).collect() if accuracy < target else []
        if not worst:
            return done.select("id", "cluster")
        cells = cells.withColumn("cluster", F.when(F.col("cluster") == worst[0].b, worst[0].a).otherwise(F.col("cluster")))


def communities(weights: np.ndarray, resolution: float = 1.0, seed: int = 0) -> tuple[np.ndarray, float]:
    """Groups of a small weighted graph by local moves that raise modularity, repeated on the groups' graph; and the
    modularity."""
    w = np.asarray(weights, float)
    w = (w + w.T) / 2
    total = w.sum()
    if total == 0:
        return np.arange(len(w)), 0.0
    member, graph = np.arange(len(w)), w
    rng = np.random.default_rng(seed)
    while True:
        own, degree, moved = np.arange(len(graph)), graph.sum(1), False
        for _ in range(50):
            changed = False
            for i in rng.permutation(len(graph)):
                links = np.bincount(own, graph[i], len(graph))
                links[own[i]] -= graph[i, i]
                mass = np.bincount(own, degree, len(graph))
                mass[own[i]] -= degree[i]
                gain = links - resolution * degree[i] * mass / total
                best = int(np.argmax(gain))
                if gain[best] > gain[own[i]] + 1e-12:
                    own[i], changed, moved = best, True, True
            if not changed:
                break
        _, own = np.unique(own, return_inverse=True)
        member = own[member]
        if not moved:
            break
        k = own.max() + 1
        hot = np.eye(k)[own]
        graph = hot.T @ graph @ hot
    same = member[:, None] == member[None]
    degree = w.sum(1)
    return member, float(((w / total - np.outer(degree, degree) / total**2) * same).sum())


def overlap_communities(overlaps: DataFrame, least: float = 0.1, most: float = 0.9, resolution: float = 1.0) -> tuple[pd.DataFrame, float]:
    """side, name, group of the clusters of two datasets from their overlap scores (left, right, overlap; one row per
    pair of clusters): scores under ``least`` are no link, those above ``most`` count as it. Clusters without a link
    have group -1."""
    most = MOST_CLUSTERS**2
    t = overlaps.limit(most + 1).toPandas()
    if len(t) > most:
        raise ValueError(f"more than {most} pairs of clusters")
    left, right = sorted(set(t["left"])), sorted(set(t["right"]))
    m = t.pivot_table(index="left", columns="right", values="overlap", fill_value=0.0).reindex(index=left, columns=right, fill_value=0.0).to_numpy()
    m = np.where(m < least, 0, np.minimum(m, most))
    n = len(left) + len(right)
    w = np.zeros((n, n))
    w[: len(left), len(left) :] = m
    w[len(left) :, : len(left)] = m.T
    group, q = communities(w, resolution)
    group = np.where(w.sum(1) > 0, group, -1)
    return pd.DataFrame({"side": ["left"] * len(left) + ["right"] * len(right), "name": left + right, "group": group}), q


def sketched(values: DataFrame, buckets: int) -> DataFrame:
    """id, v: each row's sparse values (id, region, value; absent ones 0) as ``buckets`` sums: every region counts in the
    bucket and with the sign that its hash gives. Inner products are kept in expectation, however many regions there are."""
    place, sign = F.pmod(F.xxhash64("region"), F.lit(buckets)).cast("int"), F.when(F.pmod(F.xxhash64("region", F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    sums = values.groupBy("id", place.alias("i")).agg(F.sum(F.col("value") * sign).alias("x"))
    packed = sums.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("i", "x"))).alias("m"))
    return packed.select("id", F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("v"))


def scrublet(counts: DataFrame, components: int = 10, ratio: float = 2.0, expected: float = 0.1, k: int | None = None, seed: int = 0, buckets: int = 1024) -> DataFrame:
    """cell, n_sim, score: share of simulated doublets among each cell's neighbours as the likelihood of a doublet.
    ``counts``: cell, region, mc_type, mc, cov of one kind of count. Features are posterior fractions of all regions, as
    a signed sketch of ``buckets`` sums (see :func:`sketched`), reduced by principal components fitted on the observed
    cells; neighbours are exact, in blocks of queries."""
    observed = counts.select("cell").distinct()
    n = observed.count()
    k = k or max(3, int(round(0.5 * np.sqrt(max(n, 1)))))
    both = counts.select("cell", "region", "mc_type", "mc", "cov").unionByName(simulate_doublets(counts, ratio, seed))
    frac = posterior_frac(both).where("frac IS NOT NULL")
    rows = sketched(frac.select(F.col("cell").alias("id"), "region", (F.col("frac") - 1).alias("value")), buckets)
    real = F.col("id").startswith("sim_")
    reduced = cut(Pca(rows.where(~real), buckets, min(components, buckets)).transform(rows))
    k_adj = int(round(k * (1 + ratio)))
    near = knn(reduced.where(~real), reduced, k_adj)
    share = near.groupBy("id").agg(F.count_if(F.col("other").startswith("sim_")).alias("n_sim"), F.count("*").alias("n"))
    scored = doublet_likelihood(share, k_adj, ratio, expected)
    return share.join(scored, "id").select(F.col("id").alias("cell"), "n_sim", "score")


def kernel_dispersion(features: DataFrame, n_top: int = 5000, ridge: float = 0.1, waves: int = 256) -> DataFrame:
    """region, residual, feature_select: log2 dispersion less its smooth fit on log2 mean and log2 cov, and the ``n_top``
    largest residuals (ties by region). ``features``: region, mean, cov, dispersion, all above 0.

    The fit is kernel ridge regression with a Gaussian kernel over all regions: the kernel is the product of ``waves``
    seeded cosine features, whose sums are added up in the tasks."""
    f = features.where("mean > 0 AND cov > 0 AND dispersion > 0").select("region", F.log2("mean").alias("m"), F.log2("cov").alias("c"), F.log2("dispersion").alias("d"))
    s = f.agg(F.count("*").alias("n"), *[g(x).alias(f"{k}{x}") for x in "mcd" for k, g in (("a", F.avg), ("s", F.stddev_pop))]).first()
    if not s.n:
        return f.select("region", F.lit(None).cast("double").alias("residual"), F.lit(False).alias("feature_select"))
    mean, sd, base = np.array([s.am, s.ac]), np.array([s.sm or 1.0, s.sc or 1.0]), float(s.ad)
    rng = np.random.default_rng(0)
    turn, shift = rng.normal(size=(2, waves)), rng.uniform(0, 2 * np.pi, waves)

    def wave(m: pa.Array, c: pa.Array) -> np.ndarray:
        z = (np.stack([m.to_numpy(zero_copy_only=False), c.to_numpy(zero_copy_only=False)], 1) - mean) / sd
        return np.sqrt(2 / waves) * np.cos(z @ turn + shift)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(waves * (waves + 1))
        for b in batches:
            if b.num_rows:
                x = wave(b.column(0), b.column(1))
                total += np.r_[(x.T @ x).ravel(), x.T @ (b.column(2).to_numpy(zero_copy_only=False) - base)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["i", "s"])

    total = np.zeros(waves * (waves + 1))
    for r in f.select("m", "c", "d").mapInArrow(sums, "i INT, s DOUBLE").groupBy("i").agg(F.sum("s").alias("s")).collect():
        total[r.i] = r.s
    weight = np.linalg.solve(total[: waves * waves].reshape(waves, waves) + ridge * np.eye(waves), total[waves * waves :])

    @F.arrow_udf("double")
    def fit(m: pa.Array, c: pa.Array) -> pa.Array:
        return pa.array(wave(m, c) @ weight + base)

    r = f.select("region", (F.col("d") - fit("m", "c")).alias("residual"))
    top = r.orderBy(F.desc("residual"), "region").limit(n_top).select("region", F.lit(True).alias("__t"))
    return r.join(top, "region", "left").select("region", "residual", F.coalesce("__t", F.lit(False)).alias("feature_select"))


def tsne(vectors: DataFrame, perplexity: float = 30.0, steps: int = 300, seed: int = 0) -> pd.DataFrame:
    """id, x, y: exact t-SNE on the driver, for a picture. More than MOST_ROWS rows raise: sample them first."""
    t = vectors.orderBy("id").limit(MOST_ROWS + 1).toPandas()
    if len(t) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows")
    x = np.array(t["v"].tolist(), float)
    n = len(x)
    if n < 3:
        return pd.DataFrame({"id": t["id"], "x": np.zeros(n), "y": np.zeros(n)})
    d = ((x[:, None] - x[None]) ** 2).sum(2) if n <= 1500 else np.maximum((x * x).sum(1)[:, None] - 2 * x @ x.T + (x * x).sum(1), 0)
    lo, hi, beta = np.zeros(n), np.full(n, np.inf), np.ones(n) / max(d.mean(), 1e-12)
    goal = np.log(min(perplexity, (n - 1) / 3))
    for _ in range(60):
        p = np.exp(-d * beta[:, None])
        np.fill_diagonal(p, 0)
        s = np.maximum(p.sum(1), 1e-300)
        h = np.log(s) + beta * (d * p).sum(1) / s
        lo, hi = np.where(h > goal, beta, lo), np.where(h > goal, hi, beta)
        beta = np.where(np.isinf(hi), beta * 2, (lo + hi) / 2)
    p = p / s[:, None]
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    y = (x - x.mean(0)) @ np.linalg.svd(x - x.mean(0), full_matrices=False)[2][:2].T
    y = y / max(y[:, 0].std(), 1e-12) * 1e-4
    speed = np.zeros_like(y)
    for i in range(steps):
        q = 1 / (1 + ((y[:, None] - y[None]) ** 2).sum(2))
        np.fill_diagonal(q, 0)
        g = (p * (12 if i < steps // 4 else 1) - q / q.sum()) * q
        grad = 4 * (g.sum(1)[:, None] * y - g @ y)
        speed = (0.5 if i < steps // 4 else 0.8) * speed - max(n / 12, 5) * grad
        y = y + speed
    return pd.DataFrame({"id": t["id"], "x": y[:, 0], "y": y[:, 1]})


def dataset_order(distances: np.ndarray, sizes: Sequence[int]) -> list[tuple[list[int], list[int]]]:
    """The order in which datasets are integrated: sides of each merge of the average-linkage tree, the side of more
    cells first (it is the reference)."""
    n = len(distances)
    merges = average_linkage(np.asarray(distances, float))
    under = {i: [i] for i in range(n)}
    out = []
    for i, (a, b, _, _) in enumerate(merges):
        x, y = under[a], under[b]
        if sum(sizes[j] for j in x) < sum(sizes[j] for j in y):
            x, y = y, x
        out.append((x, y))
        under[n + i] = x + y
    return out

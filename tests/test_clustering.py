import numpy as np
import pandas as pd

from methyloom.operators import clustering as cl
from methyloom.sources import readers


def frame(spark, x):
    return spark.createDataFrame([(f"c{i:04d}", [float(v) for v in r]) for i, r in enumerate(x)], "id STRING, v ARRAY<DOUBLE>")


def blobs(sizes=(60, 40, 30), dim=5, seed=0):
    rng = np.random.default_rng(seed)
    own = np.repeat(np.arange(len(sizes)), sizes)
    return (rng.normal(size=(len(sizes), dim)) * 6)[own] + rng.normal(size=(len(own), dim)) * 0.5, own


def test_average_linkage():
    x = np.array([0.0, 1.0, 5.0, 5.5, 20.0])
    merges = cl.average_linkage(np.abs(x[:, None] - x[None]))
    assert [m[:2] for m in merges] == [(2, 3), (0, 1), (5, 6), (4, 7)]
    assert [round(m[2], 6) for m in merges] == [0.5, 1.0, 4.75, 17.125]
    assert cl.leaves_of(merges, 5)[2] == {0, 1, 2, 3}
    assert cl.average_linkage(np.zeros((1, 1))) == []
    assert cl.dataset_order(np.abs(x[:3, None] - x[None, :3]), [1, 9, 5]) == [([1], [0]), ([1, 0], [2])]


def test_bootstrap_and_merging(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(2, 40))
    p = pd.DataFrame(np.vstack([base[0] + 0.05 * rng.normal(size=40), base[0], base[1], base[1] + 0.05 * rng.normal(size=40)]), index=list("abcd"))
    t = cl.bootstrap_tree(p, 20, spark)
    assert set(t["members"]) == {"a,b", "c,d", "a,b,c,d"} and t["support"].min() == 1.0
    centres = {"a": np.array([0.0]), "b": np.array([1.0]), "c": np.array([9.0])}
    assert cl.merge_clusters(centres, lambda x, y: "c" in x + y) == {"a": "a::b", "b": "a::b", "c": "c"}


def test_communities():
    w = np.zeros((6, 6))
    for g in ((0, 1, 2), (3, 4, 5)):
        for i in g:
            for j in g:
                w[i, j] = i != j
    w[2, 3] = w[3, 2] = 0.1
    member, q = cl.communities(w)
    assert len(set(member[:3])) == len(set(member[3:])) == 1 and member[0] != member[5] and q > 0.4
    assert cl.communities(np.zeros((2, 2)))[1] == 0.0


def test_consensus(spark):
    x, own = blobs()
    got = {r.id: r.cluster for r in cl.consensus_clustering(frame(spark, x), ks=(3, 3, 3), min_size=5).collect()}
    table = pd.crosstab(own, [got[f"c{i:04d}"] for i in range(len(x))])
    assert len(got) == len(x) and (table.max(0) == table.sum(0)).all()


def test_layout_and_kernel(spark):
    x, own = blobs((20, 20))
    t = cl.tsne(frame(spark, x), 5, 200).sort_values("id")
    y = t[["x", "y"]].to_numpy()
    a, b = y[own == 0], y[own == 1]
    assert np.linalg.norm(a.mean(0) - b.mean(0)) > a.std() + b.std()
    rows = [(f"r{i}", 0.1 + i / 100, 10.0 + i, 1.0 if i != 7 else 9.0) for i in range(60)]
    f = spark.createDataFrame(rows, "region STRING, mean DOUBLE, cov DOUBLE, dispersion DOUBLE")
    assert [r.region for r in cl.kernel_dispersion(f, 1).where("feature_select").collect()] == ["r7"]
    assert cl.kernel_dispersion(f.limit(0)).collect() == []


def test_doublets_score_higher(spark):
    rng = np.random.default_rng(1)
    rows = []
    for c in range(40):
        kind = c % 2
        for r in range(30):
            p = (0.9 if (r < 15) == (kind == 0) else 0.1) if c < 36 else 0.5
            rows.append((f"c{c:02d}", f"r{r}", "CGN", int(rng.binomial(40, p)), 40))
    s = {r.cell: r.score for r in cl.scrublet(spark.createDataFrame(rows, "cell STRING, region STRING, mc_type STRING, mc BIGINT, cov BIGINT"), 5).collect()}
    assert np.mean([s[f"c{i}"] for i in range(36, 40)]) > np.mean([s[f"c{i:02d}"] for i in range(36)])


def test_dmr_table_and_project(spark, tmp_path):
    (tmp_path / "d").write_text("chr\tstart\tend\tnumber_of_dms\thyper\thypo\tl_a\nchr1\t5\t9\t2\ta,b\tc\t0.5\nchr1\t20\t30\t1\t\ta\t0.1\n")
    regions, states = readers.read_dmr_table(spark, str(tmp_path / "d"))
    assert sorted(tuple(r) for r in regions.collect()) == [("chr1-20-30", "chr1", 20, 32, 1), ("chr1-5-9", "chr1", 5, 11, 2)]
    assert sorted(tuple(r) for r in states.collect()) == [("chr1-20-30", "a", -1), ("chr1-5-9", "a", 1), ("chr1-5-9", "b", 1), ("chr1-5-9", "c", -1)]
    (tmp_path / "p.json").write_text('{"metadata": "m.csv", "matrices": {"x": "/abs/*"}}')
    assert readers.read_project(str(tmp_path / "p.json")) == {"metadata": str(tmp_path / "m.csv"), "matrices": {"x": "/abs/*"}}


def test_features_and_samples(spark):
    from methyloom.operators import embed as em

    load = np.array([[9, 0], [8, 1], [0, 7], [1, 6], [5, 5]], float)
    assert em.top_features(load, 2).tolist() == [0, 1, 2, 3]
    rng = np.random.default_rng(2)
    dense, thin = rng.normal(size=(150, 2)) * 0.1, rng.normal(size=(50, 2)) * 3 + 20
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(np.vstack([dense, thin, [[300.0, 300.0]]]))]
    v = spark.createDataFrame(rows, "id BIGINT, v ARRAY<DOUBLE>").repartition(3)
    got = [r.id for r in em.density_sample(v, size=60, k=10).collect()]
    assert len(got) == len(set(got)) == 60 and got == [r.id for r in em.density_sample(v, portion=0.3, k=10).collect()]
    assert 200 in got


def test_a_classifier_can_be_given(spark):
    from pyspark.ml.classification import LogisticRegression

    from methyloom.operators import clustering as cl

    rng = np.random.default_rng(0)
    rows = [(i, [float(i % 2 * 9 + a) for a in rng.normal(size=3)], -1 if i < 6 else i % 2) for i in range(120)]
    df = spark.createDataFrame(rows, "id BIGINT, v ARRAY<DOUBLE>, cluster INT")
    done, _, accuracy = cl.supervised(df, max_train=20, classifier=LogisticRegression(labelCol="cluster"))
    assert accuracy == 1.0 and {r.id: r.cluster for r in done.collect()} == {i: i % 2 for i in range(120)}


def test_signatures_are_linked_without_a_cap(spark):
    from methyloom.operators import clustering as cl

    sigs = [[0, 0, 0, 0], [0, 0, 0, 1], [0, 0, 1, 1], [5, 5, 5, 5], [5, 5, 5, 6], [9, 8, 7, 6]]
    rows = [(f"{i}-{j}", [0.0], s) for i, s in enumerate(sigs) for j in range(4)]
    got = {r.id: r.cluster for r in cl.consensus(spark.createDataFrame(rows, "id STRING, v ARRAY<DOUBLE>, runs ARRAY<INT>"), 0.7, 5).collect()}
    assert got == {i: 0 if i[0] in "012" else 1 if i[0] in "34" else -1 for i, _, _ in rows}

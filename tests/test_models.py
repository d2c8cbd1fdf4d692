"""Trees, rules, clusterings, composed learners."""

import numpy as np
import pytest
from tessera.operators import clustering, learners, models, trees

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def monks(spark):
    rows = [(str(a), str(b), str(c), "1" if a == 0 and b != 1 or c == 0 else "0") for a in range(3) for b in range(3) for c in range(4)]
    return spark.createDataFrame(rows, "a string, b string, c string, y string").withColumn("id", F.monotonically_increasing_id())


def test_tree(monks):
    tree = trees.grow(monks, ["a", "b", "c"], "y", min_rows=1)
    assert monks.withColumn("p", trees.predict(tree)).where("p != y").isEmpty()
    before = tree.size()
    trees.prune_same_majority(tree)
    assert tree.size() <= before and monks.withColumn("p", trees.predict(tree)).where("p != y").isEmpty()
    missing = monks.withColumn("c", F.lit(None).cast("string")).withColumn("p", trees.predict(tree, "common"))
    assert missing.where("p IS NULL").isEmpty()
    trees.prune(tree, 1000.0)
    assert tree.leaf and "{" in trees.dump(tree)


def test_rules(monks):
    found = trees.induce_rules(monks, ["a", "b", "c"], "y")
    assert found[0].conditions == {"c": "0"} and found[0].cls == "1"
    assert monks.withColumn("p", trees.first_rule(found)).where("p != y").isEmpty()


def test_hierarchies():
    x = np.array([0.0, 1.0, 10.0, 11.0, 30.0])
    d = np.abs(x[:, None] - x[None])
    for linkage, top in (("single", 19.0), ("complete", 30.0), ("average", 24.5)):
        merges = clustering.hierarchy(d, linkage)
        assert merges[-1][2] == pytest.approx(top)
        assert clustering.cut_tree(merges, 5, 3) == [0, 0, 1, 1, 2]
    assert clustering.cut_tree(clustering.hierarchy(d, "ward"), 5, 2) in ([0, 0, 0, 0, 1], [0, 0, 1, 1, 1])
    y = clustering.mds(d, 1)
    assert np.allclose(np.abs(y - y.T), d, atol=1e-6)


def test_clusters_of_rows(spark):
    m = spark.createDataFrame([(i, j, float(abs(a - b))) for i, a in enumerate([0, 1, 10, 11]) for j, b in enumerate([0, 1, 10, 11]) if i > j], "i long, j long, d double")
    c = clustering.hierarchical(m, 2)
    assert sorted(map(tuple, c.collect())) == [(0, 0), (1, 0), (2, 1), (3, 1)]
    assert all(r.s > 0.8 for r in clustering.silhouette(m, c).collect())


def test_pca(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i) for i in range(10)], "a double, b double")
    values, parts = clustering.pca(df, ["a", "b"], 2)
    assert values[1] == pytest.approx(0, abs=1e-9) and np.allclose(parts[0], np.array([1, 2]) / np.sqrt(5))


def test_cross_validation(monks):
    tree = lambda train, rows: rows.withColumn("predicted", trees.predict(trees.grow(train, ["a", "b", "c"], "y")))
    major = lambda train, rows: learners.majority(train, rows, "y")
    ca = lambda p: p.agg(F.avg((F.col("predicted") == F.col("y")).cast("double"))).first()[0]
    out = models.cross_validated(monks, tree, 4, ["id"], "y")
    assert out.count() == 36
    assert models.tuned(monks, {"majority": major, "tree": tree}, ca, 4, ["id"]) == "tree"
    assert [s for s, _ in models.learning_curve(monks, major, ca, [0.5, 1.0], ["id"])] == [0.5, 1.0]


def test_boosting_and_bagging(monks):
    weighted = lambda w: lambda train, rows: rows.withColumn("predicted", F.when(F.col("c") == "0", "1").otherwise("0"))
    assert models.boosted(weighted, "y", "id", 3)(monks, monks).count() == 36
    tree = lambda train, rows: rows.withColumn("predicted", trees.predict(trees.grow(train, ["a", "b", "c"], "y")))
    assert models.bagged(tree, "id", 3)(monks, monks).count() == 36


def test_mllib_learner(spark):
    df = spark.createDataFrame([(float(i), float(i >= 10)) for i in range(20)], "x double, y double")
    assert models.logistic_regression(["x"], "y")(df, df).where("predicted != y").isEmpty()


def test_neighbours_of_all_rows_in_blocks(spark, monkeypatch):
    """Every row is asked, in several blocks, as by brute force."""
    import numpy as np
    from tessera.operators import distances

    rng = np.random.default_rng(4)
    points = rng.normal(size=(60, 3))
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, v array<double>").cache()
    monkeypatch.setattr(distances, "BLOCK_QUERIES", 25, raising=False)
    monkeypatch.setattr(distances, "MOST_BROADCAST", 50)
    got = {(r.query, r["rank"]): r.neighbour for r in distances.nearest(df, df, "id", "v", 4).collect()}
    d = np.linalg.norm(points[:, None] - points[None], axis=2)
    np.fill_diagonal(d, np.inf)
    assert got == {(i, k + 1): int(j) for i in range(60) for k, j in enumerate(np.argsort(d[i])[:4])}


def test_knn_classify_has_every_row(spark):
    from tessera.plans import catalogue

    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert catalogue.QUERIES["knn_classify"](spark, sf).select("query").distinct().count() == rows

"""Steps that had a bound on their rows, or gathered too much in one place."""

import math
import random

import numpy as np
import pytest
from tessera.operators import clustering


@pytest.mark.parametrize("linkage", ["average", "single", "complete"])
def test_hierarchies_on_a_line_are_those_of_the_matrix(spark, linkage):
    rng = random.Random(5)
    rows = [(i, rng.random() * 100) for i in range(120)]
    rows += [(200 + i, rows[i][1]) for i in range(30)]
    for k in (2, 4, 9):
        got = {r.item: r.cluster for r in clustering.hierarchical_on_line(spark.createDataFrame(rows, "i long, x double"), "i", "x", k, linkage).collect()}
        x = np.array([v for _, v in rows])
        expected = clustering.cut_tree(clustering.hierarchy(np.abs(x[:, None] - x[None]), linkage), len(x), k)
        assert got == {i: c for (i, _), c in zip(rows, expected, strict=True)}


def suppliers(spark, folder, n):
    """A folder with a table of so many suppliers."""
    rng = random.Random(n)
    rows = [(i, f"s{i}", i % 25, round(rng.uniform(-999, 9999), 2)) for i in range(1, n + 1)]
    spark.createDataFrame(rows, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{folder}/supplier.parquet")
    return rows


@pytest.mark.parametrize("name", ["cluster_hierarchical", "cluster_single_linkage"])
def test_hierarchies_of_more_rows_than_a_matrix_may_have(spark, tmp_path, name):
    from tessera.plans import catalogue

    suppliers(spark, tmp_path, clustering.MOST_ITEMS + 2_000)
    sizes = catalogue.QUERIES[name](spark, str(tmp_path)).groupBy("cluster").count().collect()
    assert sum(r["count"] for r in sizes) == clustering.MOST_ITEMS + 2_000 and len(sizes) == 4


def plain_distance(a, b, how):
    """By the definitions: what is missing on a side counts half; the correlations have no value then."""
    n = max(len(a), len(b))
    at = lambda v, k: v[k] if k < len(v) else None
    if how == "hamming":
        return float(sum(at(a, k) != at(b, k) for k in range(n)))
    if how in ("pearson", "spearman"):
        if len(a) != len(b) or how == "pearson" and None in a + b:
            return None
        if how == "spearman":
            a, b = ([sum(y is not None and x is not None and y < x for y in v) + (sum(x is not None and y == x for y in v) + 1) / 2 for x in v] for v in (a, b))
        with np.errstate(all="ignore"):
            return float((1 - np.corrcoef(a, b)[0, 1]) / 2)
    d = [0.5 if at(a, k) is None or at(b, k) is None else abs(at(a, k) - at(b, k)) for k in range(n)]
    return {"euclidean": lambda: math.sqrt(sum(x * x for x in d)), "manhattan": lambda: sum(d), "maximal": lambda: max(d), "lp": lambda: sum(x**3 for x in d) ** (1 / 3), "relief": lambda: sum(min(x, 1.0) for x in d)}[how]()


@pytest.mark.parametrize("how", ["euclidean", "manhattan", "maximal", "lp", "relief", "hamming", "pearson", "spearman"])
def test_matrices_of_any_number_of_rows(spark, monkeypatch, how):
    from tessera.operators import distances

    monkeypatch.setattr(distances, "MOST_BROADCAST", 50)
    monkeypatch.setattr(distances, "BLOCK_ROWS", (20, 30), raising=False)
    rng = random.Random(8)
    rows = [(i, [rng.choice([None, 0.0, 1.0, 2.5, rng.random() * 9]) for _ in range(rng.choice([3, 3, 4]))]) for i in range(80)] + [(99, None)]
    options = {"p": 3.0} if how == "lp" else {}
    got = {(r.i, r.j): r.d for r in distances.matrix(spark.createDataFrame(rows, "i long, v array<double>"), "i", "v", how, **options).collect()}
    assert set(got) == {(i, j) for i, _ in rows for j, _ in rows if i > j}
    for i, a in rows:
        for j, b in rows:
            if i > j:
                d = None if a is None or b is None else plain_distance(a, b, how)
                assert got[i, j] is None if d is None else math.isnan(d) and math.isnan(got[i, j]) or abs(got[i, j] - d) < 1e-7


def test_matrix_of_texts(spark, monkeypatch):
    from tessera.operators import distances

    monkeypatch.setattr(distances, "MOST_BROADCAST", 5)
    rows = [(f"k{i:02}", [str(i % 2), str(i % 3)]) for i in range(12)]
    got = {(r.i, r.j): r.d for r in distances.matrix(spark.createDataFrame(rows, "i string, v array<string>"), "i", "v", "hamming").collect()}
    assert got == {(i, j): float((a[0] != b[0]) + (a[1] != b[1])) for i, a in rows for j, b in rows if i > j}


def test_edges_between_near_rows(spark, monkeypatch):
    from tessera.operators import distances, graphs

    monkeypatch.setattr(distances, "MOST_BROADCAST", 50)
    monkeypatch.setattr(distances, "BLOCK_ROWS", (20, 30), raising=False)
    rng = random.Random(9)
    rows = [(i, float(rng.randrange(60))) for i in range(90)]
    df = spark.createDataFrame(rows, "i long, x double")
    from pyspark.sql import functions as F

    edges = graphs.between_rows(df.withColumn("v", F.array("x")), "i", "v", 0, 9, "manhattan").cache()
    expected = {(i, j, abs(x - y)) for i, x in rows for j, y in rows if i > j and abs(x - y) <= 9}
    assert {tuple(r) for r in edges.collect()} == expected
    # no detour of two steps: as the search over all edges says
    assert sorted(map(tuple, graphs.pathfinder_on_line(df, "i", "x", 9).collect())) == sorted(map(tuple, graphs.pathfinder(edges).collect()))


@pytest.mark.parametrize("name", ["graph_pathfinder", "graph_degrees"])
def test_graphs_of_more_rows_than_may_be_broadcast(spark, tmp_path, monkeypatch, name):
    from tessera.operators import distances
    from tessera.plans import catalogue

    monkeypatch.setattr(distances, "MOST_BROADCAST", 50)
    suppliers(spark, tmp_path, 120)
    assert catalogue.QUERIES[name](spark, str(tmp_path)).count() > 0


def test_numpy_of_any_number_of_rows(spark, monkeypatch):
    from tessera.operators import tables
    from tessera.schema import Variable, with_roles

    monkeypatch.setattr(tables, "MOST_NATIVE", 10)
    df = with_roles(spark.range(50).selectExpr("CAST(id AS double) AS x"), [Variable("x")])
    (x,) = tables.to_numpy(df, "a")
    assert sorted(x[:, 0]) == list(range(50))
    x[7, 0] = np.nan
    back = tables.from_numpy(spark, x, [Variable("x")])
    assert back.count() == 50 and back.where("x IS NULL").count() == 1


def test_parts_of_an_order_by_halves(spark):
    from tessera.operators import ordered

    for n in (1, 2, 7, 64):
        for r in ordered.parted(spark.range(300).selectExpr("CAST(id * 37 % 300 AS double) AS x", "id"), "x", n).groupBy("_part").agg({"x": "min", "id": "count"}).collect():
            assert 0 <= r["_part"] < max(n, 2)
    cut = ordered.parted(spark.range(300).selectExpr("CAST(id * 37 % 300 AS double) AS x"), "x", 64).distinct().collect()
    assert len({r["_part"] for r in cut}) == 64
    assert all(a["_part"] <= b["_part"] for a in cut for b in cut if a.x <= b.x)
    # no bound is looked at one by one
    assert "filter(" not in ordered.parted(spark.range(9), "id", 8)._jdf.queryExecution().analyzed().toString()


def test_folds_of_a_cross_validation_are_dealt_once(spark):
    from tessera.operators import learners, models

    df = spark.createDataFrame([(i, "ab"[i % 3 == 0]) for i in range(40)], "id long, c string")
    out = models.cross_validated(df, lambda train, rows: learners.majority(train, rows, "c"), 4, ["id"], "c")
    assert out.count() == 40 and "row_number" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_every_row_is_a_reference_of_relief(spark, tmp_path):
    """More suppliers than 1,000: as a plain search says."""
    from tessera.plans import catalogue

    rows = suppliers(spark, tmp_path, 1_200)
    x = np.array([[r[3], r[2]] for r in rows])
    x = (x - x.min(0)) / (x.max(0) - x.min(0))
    cls = np.array([r[0] % 3 for r in rows])
    share = np.bincount(cls) / len(cls)
    sums = np.zeros(2)
    for q in range(len(x)):
        d = np.abs(x - x[q])
        total = d.sum(1)
        total[q] = np.inf
        for c in range(3):
            own = np.nonzero(cls == c)[0]
            near = own[np.lexsort((own, total[own]))[:5]]
            sums += d[near].sum(0) * (-1 if c == cls[q] else share[c] / (1 - share[cls[q]]))
    got = {r.variable: r.relieff for r in catalogue.QUERIES["score_relief_all_rows"](spark, str(tmp_path)).collect()}
    for name, s in zip(("s_acctbal", "s_nationkey"), sums / (len(x) * 5), strict=True):
        assert abs(got[name] - s) < 2e-6


def test_nearest_by_products_are_the_nearest_by_differences(spark):
    """Far from the origin, with copies; the rows are dealt over all cores."""
    from tessera.operators import distances

    rng = np.random.default_rng(6)
    points = np.round(rng.normal(size=(150, 4)), 2) + 1000
    points = np.vstack([points, points[:30]])
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, v array<double>").coalesce(1)
    found = distances.nearest(df, df, "id", "v", 5)
    assert found.rdd.getNumPartitions() >= 1 and "mapInArrow" in str(found._jdf.queryExecution().optimizedPlan().toString()).replace("MapInArrow", "mapInArrow")
    got = {(r.query, r["rank"]): r.neighbour for r in found.collect()}
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    assert got == {(i, k + 1): int(j) for i in range(len(points)) for k, j in enumerate(np.lexsort((np.arange(len(points)), d[i]))[:5])}
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "RepartitionByExpression" in plan


def test_rows_of_a_matrix_follow_each_other_by_key(spark):
    """Runs of the greater key, each with the lesser keys in order."""
    from tessera.operators import distances

    rows = [(i * 37 % 101, [float(i % 7)]) for i in range(101)]
    got = [(r.i, r.j) for r in distances.matrix(spark.createDataFrame(rows, "i long, v array<double>"), "i", "v", "manhattan").collect()]
    assert got == [(i, j) for i in range(101) for j in range(i)]


def test_decimals_are_those_of_round(spark):
    from pyspark.sql import functions as F
    from tessera.plans.catalogue import nearest_decimal

    rng = random.Random(3)
    values = [0.0, -0.0, 0.5, 2.5, 1.00005, -1.00005, 0.12345, 1e300, -1e18, 5e-324, float("nan"), float("inf"), float("-inf"), None]
    values += [rng.randrange(-(10**9), 10**9) / 10**5 for _ in range(3000)] + [rng.uniform(-1, 1) * 10 ** rng.randrange(-6, 18) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for places in (2, 4, 5, 6):
        assert df.where(~(nearest_decimal(F.col("x"), places) + 0.0).eqNullSafe(F.round("x", places) + 0.0)).count() == 0


def test_itemsets_of_equal_baskets_counted_first(spark, monkeypatch):
    """As counting all sets says; no basket is kept by itself, as the library's search does."""
    from itertools import combinations

    import pyspark.ml.fpm
    from tessera.operators import rules

    monkeypatch.delattr(pyspark.ml.fpm, "FPGrowth")
    rng = random.Random(4)
    baskets = [rng.sample("abcdefg", rng.randrange(6)) + rng.choice([[], ["a", "a"]]) for _ in range(60)] * 3 + [None]
    df = spark.createDataFrame([(b,) for b in baskets], "items array<string>")
    for support in (0.0, 0.05, 0.2, 1.0):
        counts = {}
        for b in baskets[:-1]:
            for k in range(1, 8):
                for s in combinations(sorted(set(b)), k):
                    counts[s] = counts.get(s, 0) + 1
        got = [(tuple(r["items"]), r["n"]) for r in rules.itemsets(df, support).collect()]
        assert sorted(got) == sorted((s, n) for s, n in counts.items() if n >= support * 180)
    assert rules.itemsets(df.where("items IS NULL"), 0.5).count() == 0


def test_relief_by_leaves_is_that_of_all_pairs(spark, monkeypatch):
    """With missing values, copies and few rows of a class; leaves smaller than the k nearest and larger."""
    from tessera.operators import scoring

    rng = random.Random(2)
    rows = [(i, rng.choice([None, rng.random(), 0.5, 0.25]), float(rng.randrange(4)), "aab"[rng.randrange(3)] if i else "c") for i in range(260)]
    df = spark.createDataFrame(rows, "id long, x double, y double, c string")
    one = {r.variable: r.relieff for r in scoring.relief(df, ["x", "y"], "c", "id", m=None).collect()}
    monkeypatch.setattr(scoring, "RELIEF_PLAIN", 0)
    for leaf in (3, 16):
        monkeypatch.setattr(scoring, "RELIEF_LEAF", leaf)
        two = {r.variable: r.relieff for r in scoring.relief(df, ["x", "y"], "c", "id", m=None).collect()}
        assert one.keys() == two.keys() and all(abs(one[v] - two[v]) < 1e-9 for v in one)


def test_relief_by_cells_is_that_of_a_plain_search(spark, monkeypatch):
    """Many cells and blocks, a class of few rows, missing values, more copies of a row than are kept; all rows or some as references."""
    from tessera.operators import sampling, scoring

    rng = random.Random(5)
    value = lambda: rng.choice([None, rng.random(), rng.random(), rng.random()])
    rows = [(i, value(), float(rng.randrange(5)), "ab"[i % 2]) for i in range(300)]
    rows += [(300 + i, 0.5, 2.0, "ab"[i % 3 > 0]) for i in range(40)] + [(340 + i, rng.random(), 1.0, "c") for i in range(4)]
    df = spark.createDataFrame(rows, "id long, x double, y double, c string").repartition(3)
    x = np.array([[np.nan if v is None else v for v in r[1:3]] for r in rows])
    x = (x - np.nanmin(x, 0)) / (np.nanmax(x, 0) - np.nanmin(x, 0))
    names, cls = np.unique([r[3] for r in rows], return_inverse=True)
    share = np.bincount(cls) / len(cls)
    for name, n in {"RELIEF_FEW": 0, "RELIEF_CELL": 20, "RELIEF_BLOCK": 16, "RELIEF_LEAF": 8, "RELIEF_PLAIN": 50}.items():
        monkeypatch.setattr(scoring, name, n)
    for m in (None, 60):
        asked = range(len(rows)) if m is None else [r.id for r in df.orderBy(sampling.order_key(["id"]), "id").limit(m).collect()]
        sums = np.zeros(2)
        for q in asked:
            d = np.abs(x - x[q])
            d[np.isnan(d)] = 0.5
            total = d[:, 0] + d[:, 1]
            for c in range(len(names)):
                own = np.array([i for i in np.nonzero(cls == c)[0] if i != q])
                sums += d[own[np.lexsort((own, total[own]))[:5]]].sum(0) * (-1 if c == cls[q] else share[c] / (1 - share[cls[q]]))
        got = {r.variable: r.relieff for r in scoring.relief(df, ["x", "y"], "c", "id", m=m).collect()}
        assert all(abs(got[v] - s / (len(asked) * 5)) < 1e-9 for v, s in zip("xy", sums, strict=True))


def test_cells_of_relief_part_evenly(spark):
    """Values that occur often are not cut, and every row lies in one cell."""
    from tessera.operators import scoring

    x = np.random.default_rng(1).random((4_000, 2))
    x[:1_000, 0] = 0.5
    tree, n = scoring._laid_out(x, 16, 3)
    sizes, todo = {}, [(tree, x)]
    while todo:
        node, own = todo.pop()
        if len(node) == 3:
            sizes[node[2]] = len(own)
            assert (own >= node[0]).all() and (own <= node[1]).all()
        else:
            side = own[:, node[2]] < node[3]
            todo += [(node[4], own[side]), (node[5], own[~side])]
    assert n == 19 and sorted(sizes) == list(range(3, 19)) and sum(sizes.values()) == 4_000 and max(sizes.values()) < 1_000
    assert scoring._laid_out(np.ones((50, 2)), 8, 0)[1] == 1


def test_rows_stay_where_they_are_for_few_references_of_relief(spark, monkeypatch):
    """Read in parts of any size with the same result; only the nearest are shuffled."""
    from tessera.operators import scoring

    rng = random.Random(8)
    rows = [(i, rng.choice([None, rng.random(), 0.25]), rng.random(), "abc"[rng.randrange(3)]) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, x double, y double, c string")
    found = {}
    for part in (7, 100_000):
        monkeypatch.setattr(scoring, "RELIEF_PART", part)
        out = scoring.relief(df, ["x", "y"], "c", "id")
        assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()
        found[part] = {r.variable: r.relieff for r in out.collect()}
    assert all(abs(found[7][v] - found[100_000][v]) < 1e-12 for v in "xy")
    assert scoring.relief(df.selectExpr("id", "x", "y", "CAST(NULL AS string) AS c"), ["x", "y"], "c", "id").count() == 0

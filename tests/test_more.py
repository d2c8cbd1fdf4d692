"""Readers of quoted text, trees and rules with their options, clusterings, variables, exchange, preprocessors, user code."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera.functions import comparisons, special
from tessera.operators import clustering, evaluation, extension, models, ordered, rules, tables, trees
from tessera.plans import preprocess as pre, transforms as tr
from tessera.schema import ATTRIBUTE, CLASS, CONTINUOUS, DISCRETE, META, STRING, WEIGHT, Variable, domain, with_roles
from tessera.sources import readers, writers


# --- readers ---------------------------------------------------------------------------------------


def test_quoted_cells_comments_and_repeated_headers(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('C#x,"D#name, long",m#note\n# said\n1.5,"a, b","q ""uoted"""\n\n,,\nC#x,"D#name, long",m#note\n2,c,?\n')
    df = readers.read_prefixed(spark, str(path), ",", comment="#")
    rows = [tuple(r) for r in df.collect()]
    assert df.columns == ["x", "name, long", "note"]
    # a data line that equals the header is data: its cell is no number
    assert rows[0][:2] == (1.5, "a, b") and "uoted" in rows[0][2]
    assert rows[1] == (None, "D#name, long", "m#note") and rows[2] == (2.0, "c", None) and len(rows) == 3
    bad = tmp_path / "b.csv"
    bad.write_text("a,b\n1,2,3\n")
    with pytest.raises(Exception, match="invalid length"):
        readers.read_prefixed(spark, str(bad), ",").collect()


def test_tab_with_equal_lines_and_several_classes(spark, tmp_path):
    path = tmp_path / "a.tab"
    path.write_text("x\ty\tz\nc\td\td\n\tclass\tclass\nx\ty\tz\n1\ta\tb\n")
    with pytest.raises(ValueError, match="more than one class"):
        readers.read_tab(spark, str(path))
    df = readers.read_tab(spark, str(path), classes=True)
    assert [tuple(r) for r in df.collect()] == [(None, "y", "z"), (1.0, "a", "b")]
    assert readers.why_not_tab(path.read_text().splitlines()) is None
    assert "number" in readers.why_not_tab(["a\tb", "1\t2", "3\t4"]) and "flag" in readers.why_not_tab(["a", "c", "odd"])
    assert readers.find_file(spark, "a", (str(tmp_path),)) == str(path)
    with pytest.raises(FileNotFoundError):
        readers.find_file(spark, "none", (str(tmp_path),))


def test_kinds_by_exact_counts(spark):
    rows = [(str(i % 10), f"{i},5", f"t{i}", f"v{i % 5}", None) for i in range(60)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string")
    assert readers.infer_kinds(df, list("abcde")) == {"a": DISCRETE, "b": CONTINUOUS, "c": STRING, "d": DISCRETE, "e": DISCRETE}


def test_networks_sql_files_and_kept_tables(spark, tmp_path):
    v, e = readers.parse_pajek(spark, '*Vertices 2\n1 "a"\n2 "b"\n*Edges\n1 2 0.5\n')
    assert [tuple(r) for r in v.collect()] == [(1, "a"), (2, "b")] and [tuple(r) for r in e.collect()] == [(1, 2, 0.5, False)]
    spark.range(3).select("id", F.lit("x").alias("kind")).createOrReplaceTempView("some")
    (tmp_path / "q.sql").write_text("--orng discrete ['kind']\n--orng class 'kind'\n-- a comment\nSELECT * FROM some;\n")
    df = readers.read_sql_file(spark, str(tmp_path / "q.sql"))
    assert [(x.name, x.kind, x.role) for x in domain(df)] == [("id", CONTINUOUS, ATTRIBUTE), ("kind", DISCRETE, CLASS)]
    assert readers.read_sql_table(spark, "some").count() == 3
    writers.keep(df, str(tmp_path / "kept"))
    assert domain(readers.restored(spark, str(tmp_path / "kept"))) == domain(df)
    source = writers.r_source(tables.from_rows(spark, [(1, "a"), (None, 'q"')], [Variable("x"), Variable("y", DISCRETE, values=("a", 'q"'))]))
    assert "`x` = c(1.0, NA)" in source and 'factor(c("a", "q\\""), levels = c("a", "q\\""))' in source


# --- trees and rules ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(5)
    rows = []
    for i in range(600):
        x, s = round(rng.uniform(0, 10), 2), rng.choice("pqr")
        y = "yes" if (x > 4 and s != "p") or x > 8 else "no"
        rows.append((i, x if i % 11 else None, s if i % 13 else None, y))
    return spark.createDataFrame(rows, "i long, x double, s string, y string").cache()


def accuracy(df, p):
    return df.withColumn("_p", p).agg(F.avg((F.col("_p") == F.col("y")).cast("int"))).first()[0]


@pytest.mark.parametrize("split", ["multiway", "one_against_others", "binary"])
@pytest.mark.parametrize("unknown", ["ignore", "common", "all", "sizes", "random", "branch"])
def test_trees_on_numbers_and_values(mixed, split, unknown):
    tree = trees.grow(mixed, ["s"], "y", "gain", min_rows=5, depth=4, continuous=["x"], split=split, unknown=unknown, key=["i"])
    known = mixed.where("x IS NOT NULL AND s IS NOT NULL")
    assert accuracy(known, trees.predict(tree, "sizes")) > 0.97
    for descend in ("node", "common", "sizes", "all", "branch"):
        assert accuracy(mixed, trees.predict(tree, descend)) > 0.85
    if unknown == "ignore":
        assert tree.column == "x" and abs(tree.threshold - 4) < 0.3


def test_a_cut_is_the_best_of_all(spark):
    rng = random.Random(2)
    values = [(rng.randint(0, 30), rng.choice("ab")) for _ in range(200)]
    df = spark.createDataFrame(values, "x int, y string")
    tree = trees.grow(df, [], "y", "gini", min_rows=3, depth=1, continuous=["x"])

    def impurity(part):
        return sum((sum(c == k for _, c in part) / len(part)) ** 2 for k in "ab") * len(part)

    ways = {}
    for a, b in itertools.pairwise(sorted({x for x, _ in values})):
        low, high = [v for v in values if v[0] <= a], [v for v in values if v[0] > a]
        if min(len(low), len(high)) >= 3:
            ways[(a + b) / 2] = impurity(low) + impurity(high)
    assert math.isclose(ways[tree.threshold], max(ways.values()))


def test_branches_merge_by_their_sizes(spark):
    node = trees.Node({"a": 6.0, "b": 4.0}, "s", {"p": trees.Node({"a": 6.0, "b": 1.0}), "q": trees.Node({"b": 3.0})})
    p = spark.createDataFrame([("p",), ("q",), (None,), ("new",)], "s string").select(*[c.alias(k) for k, c in trees.probabilities(node, "sizes").items()]).collect()
    assert [round(r.a, 6) for r in p] == [round(6 / 7, 6), 0, 0.6, 0.6]
    q = spark.createDataFrame([(None,)], "s string").select(trees.predict(node, "node").alias("n"), trees.predict(node, "common").alias("c"), trees.predict(node, "sizes").alias("m")).first()
    assert (q.n, q.c, q.m) == ("a", "a", "a")


def test_deep_trees_stay_small_expressions(spark):
    """The common branch stands once a level, so that depth doesn't double the work."""
    node = trees.Node({"a": 1.0, "b": 1.0})
    for k in range(14):
        node = trees.Node({"a": 2.0, "b": 2.0}, f"c{k}", {"0": trees.Node({"a": 1.0}), "1": node})
    df = spark.createDataFrame([("1",) * 14], ", ".join(f"c{k} string" for k in range(14)))
    assert df.select(trees.predict(node, "common").alias("p")).first().p == "a"


def test_user_measure_and_stop(mixed):
    seen = []
    tree = trees.grow(mixed, ["s"], "y", lambda table: float(len(table)), stop=lambda counts, level: seen.append(level) or level >= 1, depth=3)
    assert tree.column == "s" and all(b.leaf for b in tree.branches.values()) and 1 in seen


def test_unordered_rules_and_their_tests(mixed):
    df = mixed.withColumn("high", F.when(F.col("x") > 8, "top").when(F.col("x") > 4, "mid").otherwise("low")).where("s IS NOT NULL AND x IS NOT NULL")
    found = trees.induce_unordered(df, ["s", "high"], "y", least_significance=3.84)
    assert accuracy(df, trees.voted(found)) == 1.0
    assert all(trees.significance(r.counts, found[-1].counts) >= 3.84 for r in found[:-1])
    for evaluator in (trees.entropy_quality, trees.m_quality(2.0), trees.weighted_accuracy):
        assert accuracy(df, trees.first_rule(trees.induce_rules(df, ["s", "high"], "y", evaluator=evaluator))) > 0.75
    assert trees.significance({"a": 5.0}, {"a": 5.0, "b": 5.0}) == pytest.approx(2 * 5 * math.log(2))
    assert trees.induce_rules(df, ["s"], "y", least_rows=10**6)[0].conditions == {}


def test_rule_filters(spark):
    baskets = spark.createDataFrame([(["a", "b", "c"],)] * 6 + [(["a", "b"],)] * 3 + [(["c"],)], "items array<string>")
    found = rules.rules(baskets, 0.3, 0.1)
    assert {tuple(r.antecedent) for r in rules.having(found, "antecedent", ["a", "b"], 2).collect()} == {("a", "b")}
    assert rules.selected(found, confidence=0.9, right=["a"]).count() > 0
    assert rules.shown(found, ["confidence"], 1)[0].endswith("confidence=1.000")


# --- clusterings and projections ------------------------------------------------------------------------


def plain_hierarchy(d, linkage):
    """The nearest two clusters merge, again and again."""
    clusters = {i: [i] for i in range(len(d))}
    heights = []
    size = lambda c: len(clusters[c])
    dist = {frozenset((i, j)): d[i, j] for i in range(len(d)) for j in range(i)}
    while len(clusters) > 1:
        pair = min((frozenset(p) for p in itertools.combinations(clusters, 2)), key=lambda p: dist[p])
        i, j = pair
        low, new = dist[pair], max(clusters) + 1
        for k in clusters:
            if k not in pair:
                a, b = dist[frozenset((i, k))], dist[frozenset((j, k))]
                dist[frozenset((new, k))] = {"single": min(a, b), "complete": max(a, b), "average": (a * size(i) + b * size(j)) / (size(i) + size(j)), "ward": (a * (size(i) + size(k)) + b * (size(j) + size(k)) - low * size(k)) / (size(i) + size(j) + size(k))}[linkage]
        clusters[new] = clusters.pop(i) + clusters.pop(j)
        heights.append((low, sorted(clusters[new])))
    return heights


@pytest.mark.parametrize("linkage", ["single", "complete", "average", "ward"])
def test_chains_of_neighbours_give_the_plain_hierarchy(linkage):
    x = np.random.default_rng(1).normal(0, 1, (40, 3))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    merges = clustering.hierarchy(d, linkage)
    got = [(h, sorted(clustering.subtree(merges, 40, 40 + k))) for k, (_, _, h) in enumerate(merges)]
    expected = plain_hierarchy(d, linkage)
    assert [c for _, c in got] == [c for _, c in expected] and np.allclose([h for h, _ in got], [h for h, _ in expected])


def test_large_hierarchies_take_little_time():
    import time

    x = np.random.default_rng(1).normal(0, 1, (3000, 2))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    start = time.monotonic()
    merges = clustering.hierarchy(d)
    assert time.monotonic() - start < 10 and len(merges) == 2999
    assert all(a[2] <= b[2] + 1e-9 for a, b in itertools.pairwise(merges))


def test_leaf_order_is_the_best_of_all():
    x = np.random.default_rng(3).normal(0, 1, (7, 2))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    merges = clustering.hierarchy(d)

    def orders(c):
        if c < 7:
            return [[c]]
        a, b, _ = merges[c - 7]
        return [p + q for s, t in ((a, b), (b, a)) for p in orders(s) for q in orders(t)]

    length = lambda o: sum(d[i, j] for i, j in itertools.pairwise(o))
    assert length(clustering.leaf_order(d, merges)) == pytest.approx(min(length(o) for o in orders(7 + len(merges) - 1)))


def test_medoids_fuzzy_centres_and_maps(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.3, (30, 2)) for c in ((0, 0), (5, 5), (0, 5))])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    found = clustering.medoids(d, 3)
    assert [len(set(found[k : k + 30])) for k in (0, 30, 60)] == [1, 1, 1] and len(set(found)) == 3
    df = spark.createDataFrame([(i, float(a), float(b), "pqr"[i // 30]) for i, (a, b) in enumerate(x)], "i long, a double, b double, s string")
    centres, members = clustering.fuzzy(df, ["a", "b"], 3)
    assert sorted((round(a), round(b)) for a, b in centres) == [(0, 0), (0, 5), (5, 5)]
    assert all(abs(sum(r.u) - 1) < 1e-9 for r in df.select(members.alias("u")).collect())
    weights = clustering.som(df, ["a", "b"], 2, 2)
    units = df.withColumn("u", clustering.winner(["a", "b"], weights)).groupBy("s").agg(F.count_distinct("u").alias("n"), F.min("u").alias("u")).collect()
    assert len({r.u for r in units}) == 3 and clustering.u_matrix(weights, 2, 2).shape == (2, 2)
    assert clustering.bic(df, ["a", "b"], "s") > clustering.bic(df.withColumn("s", F.lit("one")), ["a", "b"], "s")
    ratios, directions = clustering.fda(df, ["a", "b"], "s", 2)
    assert ratios[0] > 10 and directions.shape == (2, 2)
    matrix = spark.createDataFrame([(i, j, float(d[i, j])) for i in range(90) for j in range(i)], "i long, j long, d double")
    places = {r.item: r.x for r in clustering.pivot_mds(matrix, [0, 30, 60, 89]).collect()}
    y = np.array([places[i] for i in range(90)])
    assert clustering.stress(d, y) < 0.05 and clustering.stress(d, x) < 1e-9


# --- models ------------------------------------------------------------------------------------------------


def test_partial_least_squares_and_selection(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (300, 3))
    y = 2 * x[:, 0] - x[:, 1] + 0.5
    df = spark.createDataFrame([(i, *map(float, r), float(v), float(v > 0.5)) for i, (r, v) in enumerate(zip(x, y, strict=True))], "i long, a double, b double, c double, y double, k double")
    intercept, beta = models.pls(df, ["a", "b", "c"], "y", 3)
    assert intercept == pytest.approx(0.5, abs=1e-6) and [beta[c] for c in "abc"] == pytest.approx([2, -1, 0], abs=1e-6)
    weights = models.svm_weights(df, ["a", "b", "c"], "k")
    assert weights["a"] > weights["b"] > weights["c"] and models.eliminated(df, ["a", "b", "c"], "k", 2) == ["a", "b"]
    importance = models.forest_importance(df, ["a", "b", "c"], "k")
    assert importance["a"] > importance["c"]
    fit = lambda cols: models.linear_regression(cols, "y")
    error = lambda p: -(p.agg(F.avg(F.pow(F.col("predicted") - F.col("y"), 2))).first()[0])
    assert models.stepwise(df, ["a", "c"], fit, error, 3, ["i"], least=0.01) == ["a"]


def majority(cls):
    from tessera.operators import learners

    return lambda train, rows: learners.majority(train, rows, cls)


def test_ways_of_testing(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else "b", i % 4) for i in range(60)], "i long, y string, f int")
    out = models.leave_one_out(df.limit(12), majority("y"), ["i"])
    assert out.count() == 12
    p = models.proportion_test(df, majority("y"), 0.7, 2, ["i"], "y")
    assert {r["round"]: r["count"] for r in p.groupBy("round").count().collect()} == {0: 18, 1: 18}
    t = models.tested_by(df, majority("y"), "f", "y")
    assert t.count() == 60 and t.where("y IS NULL").isEmpty()
    both = models.with_predictions(df, df, {"m": majority("y")}, "i")
    assert both.columns == ["i", "y", "f", "m"]
    draws = models.random_classifier("y", ["i"])(df, spark.range(3000).withColumnRenamed("id", "i"))
    shares = {r.predicted: r["count"] for r in draws.groupBy("predicted").count().collect()}
    assert sum(shares.values()) == 3000 and abs(shares["a"] / 3000 - 2 / 3) < 0.05
    many = models.multi_target(majority, ["y"], "i")(df, df)
    assert "predicted_y" in many.columns
    with pytest.raises(ValueError, match="cross-validate"):
        models.leave_one_out(spark.range(models.MOST_LEFT_OUT + 1), majority("id"), ["id"])
    assert evaluation.critical_difference(2, 10) == pytest.approx(0.6198, abs=1e-3)


# --- variables, tables, exchange ----------------------------------------------------------------------------------


def test_variables_found_or_made():
    known = [Variable("x"), Variable("s", DISCRETE, values=("a", "b"))]
    assert tables.find_variable(known, "s", DISCRETE, ("a", "b")) == (known[1], tables.OK)
    assert tables.find_variable(known, "s", DISCRETE, values=("a", "c"))[1] == tables.MISSING_VALUES
    assert tables.find_variable(known, "s", DISCRETE, values=("z",))[1] == tables.NO_RECOGNIZED_VALUES
    assert tables.find_variable(known, "s", DISCRETE, ("b", "a")) == (None, tables.INCOMPATIBLE)
    assert tables.find_variable(known, "t", DISCRETE)[1] == tables.NOT_FOUND
    v, how = tables.find_or_make(known, "s", DISCRETE, values=("c",), create_new_on=tables.INCOMPATIBLE)
    assert (v.values, how) == (("a", "b", "c"), tables.NO_RECOGNIZED_VALUES)
    assert tables.find_or_make(known, "new", DISCRETE, ("u",), ("w", "v"))[0].values == ("u", "v", "w")


def test_numpy_and_rows(spark):
    v = [Variable("x"), Variable("s", DISCRETE, values=("a", "b")), Variable("k", DISCRETE, CLASS, ("n", "y")), Variable("w", CONTINUOUS, WEIGHT)]
    df = tables.from_rows(spark, [(1, "b", "y", 2.0), (None, "a", "n", 1.0)], v)
    x, y = tables.to_numpy(df.coalesce(1), "a1/cw")
    assert np.allclose(x, [[1, 1, 1], [np.nan, 0, 1]], equal_nan=True) and y.tolist() == [[1, 2], [0, 1]]
    back = tables.from_numpy(spark, np.array([[0.0, 1.5], [2.0, np.nan]]))
    assert [q.kind for q in domain(back)] == [DISCRETE, CONTINUOUS] and sorted(map(tuple, back.collect()), key=str) == [("v0", 1.5), ("v2", None)]
    assert tables.native(df.coalesce(1))[0] == [1.0, "b", "y", 2.0]
    assert tables.info(df) == {"rows": 2, ATTRIBUTE: 2, CLASS: 1, META: 0, WEIGHT: 1}
    assert "w" not in tables.without_weights(df).columns
    assert [q.role for q in domain(tables.restated(df, {"k": ATTRIBUTE}))][2] == ATTRIBUTE
    assert tables.chosen(df, ["s"], "k").columns == ["s", "k"] and tables.by_kind(df, DISCRETE).columns == ["s", "k", "w"]
    blobs = tables.painted(spark, [(0, 0, 1, 50, "a"), (9, 9, 1, 50, "b")])
    assert blobs.groupBy("class").count().count() == 2


def test_rows_cells_and_metas(spark):
    df = ordered.numbered(spark.range(10).select((F.col("id") * 2).alias("x"), (-F.col("id")).alias("y")), ["x"])
    assert [r.x for r in tables.subscript(df, "row_id", [3, 1]).collect()] == [6, 2]
    assert tables.subscript(df, "row_id", 4, "y").first().y == -4
    assert tables.subscript(df, "row_id", F.col("x") > 15, slice(0, 1)).columns == ["x"]
    assert [r.x for r in tables.subscript(df, "row_id", slice(7, None)).orderBy("x").collect()] == [14, 16, 18]
    assert tables.cell(df, "row_id", 2, "x") == 4
    with pytest.raises(IndexError):
        tables.cell(df, "row_id", 99, "x")
    assert tables.cleared(df).count() == 0 and tables.random_row(df, ["x"]).count() == 1
    swapped = tables.reordered(df, "row_id", spark.createDataFrame([(i, 9 - i) for i in range(10)], "old long, new long"))
    assert swapped.first().x == 18
    m = spark.range(1).select(F.create_map(F.lit("a"), F.lit(1.0)).alias("m"))
    assert m.select(tables.map_set(F.col("m"), "b", 2.0).alias("m"), tables.map_remove(F.col("m"), "a").alias("n"), tables.map_has(F.col("m"), "a").alias("h")).first() == ({"a": 1.0, "b": 2.0}, {}, True)
    assert tables.remove_meta(tables.add_meta(df, "t"), "t", F.col("x") > 4).where("t IS NULL").count() == 7
    flow = tables.dataflow({"a": df}, [("c", ["b"], lambda b: b.limit(2)), ("b", ["a"], lambda a: a.where("x > 4"))])
    assert flow["c"].count() == 2
    with pytest.raises(ValueError, match="nothing gives"):
        tables.dataflow({}, [("c", ["b"], lambda b: b)])


# --- preprocessors and user code ---------------------------------------------------------------------------------------


def test_preprocessors(spark):
    v = [Variable("i", CONTINUOUS, META), Variable("x"), Variable("z"), Variable("s", DISCRETE, values=("a", "b", "c")), Variable("k", DISCRETE, CLASS, ("n", "y"))]
    rows = [(i, float(i % 10) if i % 7 else None, float(i), "abc"[i % 3] if i % 5 else None, "ny"[i % 10 > 4]) for i in range(200)]
    df = tables.from_rows(spark, rows, v)
    entropy = pre.discretized("entropy", columns=["x", "z"])(df)(df)
    assert "z" not in entropy.columns and {r.x for r in entropy.select("x").distinct().collect()} == {"<=4", ">4", None}
    assert pre.drop_kind(CONTINUOUS)(df)(df).columns == ["i", "s", "k"]
    assert pre.continuized("ignore", None)(df)(df).columns == ["i", "x", "z", "k"]
    with pytest.raises(ValueError, match="more than two"):
        pre.continuized("error")(df)
    assert pre.class_continuized("y")(df)(df).select("k").distinct().count() == 2
    each = pre.impute_each({"x": ("value", -1.0), "s": ("remove",)})(df)(df)
    assert each.where("x = -1").count() > 0 and each.where("s IS NULL").isEmpty()
    model = pre.impute_by_model({"s": majority("s")}, "i")(df)(df)
    assert model.where("s IS NULL").isEmpty() and model.count() == 200
    power, column = pre.box_cox(spark.range(1, 400).select(F.exp(F.col("id") / 100).alias("v")), "v")
    assert power == 0
    scores = pre.gaussianizer(df, "z").agg(F.avg("z").alias("m"), F.stddev_pop("z").alias("s")).first()
    assert abs(scores.m) < 1e-9 and abs(scores.s - 1) < 0.05
    best = pre.kept_best(lambda t, names, cls: spark.createDataFrame([(n, 1.0) for n in names], "variable string, w double"), "w", 0)(df)(df)
    assert "s" not in best.columns
    assert pre.width_labels(0, 2.5, 4) == ["<2.5", "[2.5, 5)", "[5, 7.5)", ">=7.5"]
    assert df.select(pre.same_value(F.lit(1.0), F.lit(1.0 + 1e-9)).alias("a"), pre.same_value(F.lit(None).cast("double"), F.lit(1.0)).alias("b")).first() == (True, False)
    enc = pre.translated({"x": lambda t, c: pre.standardizer(t, c), "s": lambda t, c: pre.ordinalizer(F.col(c), ["a", "b", "c"])})(df)(df)
    assert {r.s for r in enc.select("s").distinct().collect()} == {0.0, 0.5, 1.0, None}
    scaled = pre.plot_scaled(df, ["x", "s"]).agg(F.max("x").alias("x"), F.min("s").alias("s")).first()
    assert scaled.x == 1 and scaled.s == pytest.approx(1 / 6)
    learner = pre.learnt_behind([pre.imputed("average")], majority("k"))
    assert learner(df, df).count() == 200


def test_user_code(spark):
    df = spark.createDataFrame([(float(i), float(i % 3), float(i > 5)) for i in range(12)], "a double, b double, y double")
    assert extension.logistic_by(lambda t, c, y: [-5.5, 1.0], ["a"], "y")(df, df).where("predicted <> y").isEmpty()
    heard = []
    out = extension.with_progress([("half", lambda t: t.limit(6)), ("none", lambda t: t.limit(0))], df, lambda n, s: heard.append((n, s)))
    assert out.count() == 0 and heard == [("half", 0.5), ("none", 1.0)]
    assert extension.script("out = data.where('a > 3')", {"data": df})["out"].count() == 8
    assert extension.sql("SELECT count(*) AS n FROM data", {"data": df}).first().n == 12
    d = extension.distances_by(lambda x, y: (x - y).abs(), F.col("a"), F.col("b"))
    assert df.select(d.alias("d")).agg(F.sum("d")).first()[0] == sum(abs(i - i % 3) for i in range(12))
    k = extension.kernel_matrix(df.select("a", F.array("b").alias("v")), "a", "v", lambda x, y: F.get(x, 0) * F.get(y, 0))
    assert k.count() == 78
    assert extension.sorted_by(df, lambda t: [F.desc("a")]).first().a == 11
    assert extension.imputed_by(lambda t: lambda r: r.fillna(0.0), df).count() == 12


def test_comparisons_by_hand(spark):
    rng = random.Random(1)
    values = [(rng.randint(0, 9), rng.randint(0, 6)) for _ in range(80)]
    df = spark.createDataFrame(values, "x int, y int")
    p = comparisons.pair_counts(df, "x", "y").first()
    pairs = list(itertools.combinations(values, 2))
    assert p.concordant == sum((a[0] - b[0]) * (a[1] - b[1]) > 0 for a, b in pairs) and p.discordant == sum((a[0] - b[0]) * (a[1] - b[1]) < 0 for a, b in pairs)
    assert (p.ties_x, p.ties_y, p.pairs) == (sum(a[0] == b[0] for a, b in pairs), sum(a[1] == b[1] for a, b in pairs), len(pairs))
    dist = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "value string, w double")
    n = {r.value: r["count"] for r in comparisons.draws(dist, 4000).groupBy("value").count().collect()}
    assert sum(n.values()) == 4000 and abs(n["b"] / 4000 - 0.75) < 0.03
    assert spark.range(1).select(comparisons.gaussian_density(F.lit(1.0), 1.0, 2.0).alias("d")).first().d == pytest.approx(0.1994711)
    assert spark.range(1).select(special.erfc(F.lit(0.5)).alias("e")).first().e == pytest.approx(math.erfc(0.5))
    p = spark.createDataFrame([(i / 100, int(rng.random() < i / 100)) for i in range(101)], "p double, y int")
    curve = {r.point: r.y for r in evaluation.calibration(p, "p", F.col("y") == 1, 5).collect()}
    assert curve[1.0] > 0.7 and curve[0.0] < 0.3


def test_intervals_keep_their_metadata(spark):
    df = with_roles(spark.createDataFrame([(1.0, "a"), (2.0, None)], "x double, s string"), [Variable("x"), Variable("s", DISCRETE, values=("a",))])
    out = pre.chain([pre.imputed("average")])(df)(df)
    assert [v.kind for v in domain(out)] == [CONTINUOUS, DISCRETE] and tr.interval_labels([]) == [""]


def test_entropy_cuts_equal_a_plain_recursion(spark):
    rng = random.Random(7)
    for values in ([(rng.randint(0, 40), rng.choice("abc")) for _ in range(200)], [(x, "a" if x < 10 or 20 <= x < 30 else "b") for x in range(60)] * 2, [(1, "a")] * 5):

        def h(part):
            return -sum(p * math.log2(p) for c in "abc" if (p := sum(k == c for _, k in part) / len(part)))

        def cut(part):
            best = None
            for at in sorted({x for x, _ in part})[:-1]:
                low, high = [v for v in part if v[0] <= at], [v for v in part if v[0] > at]
                e = (len(low) * h(low) + len(high) * h(high)) / len(part)
                if best is None or e < best[0] - 1e-12:
                    best = e, at, low, high
            if best is None:
                return []
            e, at, low, high = best
            k, k1, k2 = (len({c for _, c in p}) for p in (part, low, high))
            need = (math.log2(len(part) - 1) + math.log2(3**k - 2) - (k * h(part) - k1 * h(low) - k2 * h(high))) / len(part)
            return cut(low) + [at] + cut(high) if h(part) - e > need else []

        df = spark.createDataFrame(values, "x int, y string")
        assert tr.entropy_cuts(df, "x", "y") == cut(values)


def test_graphs_and_heat_maps(spark):
    from tessera.operators import graphs, learners, sampling, scoring

    rng = random.Random(3)
    edges = [(i, j, rng.randint(1, 9)) for i in range(9) for j in range(i) if rng.random() < 0.6]
    df = spark.createDataFrame(edges, "a long, b long, d long")
    for q in (2, 3, 8):
        far = {(x, y): min([d for a, b, d in edges if {a, b} == {x, y}], default=99) for x in range(9) for y in range(9) if x != y}
        best = dict(far)
        for _ in range(q - 1):
            best = {(x, y): min([best[x, y], *(max(best[x, m], far[m, y]) for m in range(9) if m not in (x, y))]) for x, y in best}
        assert {(r.a, r.b) for r in graphs.pathfinder(df, q).collect()} == {(a, b) for a, b, d in edges if d <= best[a, b]}
    vertices = spark.range(9).withColumnRenamed("id", "vertex")
    ring = graphs.circular(vertices).collect()
    assert all(abs(r.x**2 + r.y**2 - 1) < 1e-9 for r in ring)
    assert graphs.force_directed(vertices, df).count() == 9 and graphs.in_rectangle(graphs.spread_out(vertices), 0, 0, 1, 1).count() == 9
    groups = vertices.withColumn("grp", F.col("vertex") % 3)
    assert graphs.grouped(df.select("a", "b"), [groups])[0].count() == 3
    assert graphs.expanded(df, groups, 0).where("a % 3 <> 0 OR b % 3 <> 0").isEmpty()
    assert graphs.with_items(vertices, spark.createDataFrame([(0, "x")], "k long, t string"), "k").where("t = 'x'").count() == 1
    heat = clustering.heat_map(spark.range(100).withColumn("x", F.col("id") * 1.0), ["id"], ["x"], 4).orderBy("row").collect()
    assert [(r.n, r.x) for r in heat] == [(25, 12.0), (25, 37.0), (25, 62.0), (25, 87.0)]
    assert scoring.best_on_the_fly(spark.createDataFrame([("a", 1.0), ("b", 3.0)], "n string, s double"), "s", "n").first().n == "b"
    some = spark.createDataFrame([(i, "ab"[i % 2] if i else None) for i in range(9)], "i long, c string")
    assert sampling.strata(some, "c") is None and sampling.strata(some.where("i > 0"), "c") == "c" and sampling.strata(some, "c", "not") is None
    with pytest.raises(ValueError, match="known in every row"):
        sampling.strata(some, "c", "always")
    r = spark.range(2000).select(sampling.random_double(["id"]).alias("d"), sampling.random_int(["id"], 3).alias("n"), sampling.random_bool(["id"], 1).alias("b")).agg(F.avg("d").alias("d"), F.max("n").alias("n"), F.avg(F.col("b").cast("int")).alias("b")).first()
    assert abs(r.d - 0.5) < 0.03 and r.n == 2 and abs(r.b - 0.5) < 0.05
    train = spark.createDataFrame([(x / 10, "hi" if x > 50 else "lo") for x in range(101)], "x double, y string")
    p = learners.loess_bayes(train, ["x"], "y")
    out = train.select("y", p["hi"].alias("p")).collect()
    assert sum((r.p > 0.5) == (r.y == "hi") for r in out) > 95


def test_hinges_binarization_and_starts(spark):
    from tessera.operators import scoring, splines

    rng = np.random.default_rng(3)
    x = rng.uniform(0, 10, (800, 2))
    y = 3 + 2 * np.maximum(x[:, 0] - 5, 0) - np.maximum(4 - x[:, 1], 0)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], "a double, b double, y double")
    terms, p = splines.earth(df, ["a", "b"], "y", knots=19)
    error = df.withColumn("p", p).agg(F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("e"), F.var_pop("y").alias("v")).first()
    assert error.e < 0.01 * error.v and terms[0][0] is None and {h.column for h, _ in terms[1:]} == {"a", "b"}
    flat, p = splines.earth(df.withColumn("y", F.lit(7.0)), ["a"], "y", knots=3)
    assert [b for _, b in flat] == pytest.approx([7.0])
    values = spark.createDataFrame([("p", "n"), ("p", "n"), ("q", "y"), ("r", "n"), ("s", "y"), ("s", "y")], "s string, y string")
    assert scoring.best_binarization(values, "s", "y")[1:] == (["p", "r"], ["q", "s"])
    three = np.concatenate([rng.normal(c, 0.2, (40, 2)) for c in ((0, 0), (6, 6), (0, 6))])
    t = spark.createDataFrame([tuple(map(float, r)) for r in three], "a double, b double")
    for how in ("diversity", "hierarchical"):
        centres, member = clustering.k_means(t, ["a", "b"], clustering.k_means_start(t, ["a", "b"], 3, how))
        assert sorted((round(a), round(b)) for a, b in centres) == [(0, 0), (0, 6), (6, 6)]
        assert sorted(r["count"] for r in t.groupBy(member).count().collect()) == [40, 40, 40]
    assert len(clustering.k_means_start(t, ["a", "b"], 3)) == 3
    c = df.withColumn("a2", F.col("a") * 2 + F.col("b") * 0.01)
    found = {r.item: r.cluster for r in clustering.column_clusters(c, ["a", "b", "a2"], 2).collect()}
    assert found["a"] == found["a2"] != found["b"]
    one = tables.row_merged(spark, [{"x": None, "y": 2.0}, {"x": 1.0, "y": 3.0}], [Variable("x"), Variable("y"), Variable("z")]).first()
    assert tuple(one) == (1.0, 2.0, None)


def test_nearest_rows_with_missing_places(spark):
    """By batches as by expressions: missing places count half, shorter rows too, ties go to the least key."""
    from tessera.operators import distances

    rng = random.Random(12)
    rows = [(i, [rng.choice([None, 0.0, 1.0, 2.5]) for _ in range(rng.choice([3, 3, 4]))]) for i in range(60)] + [(99, None)]
    df = spark.createDataFrame(rows, "i long, v array<double>")
    known = {i: v for i, v in rows if v is not None}
    at = lambda v, k: v[k] if k < len(v) else None
    for how, norm in (("euclidean", lambda d: math.sqrt(sum(x * x for x in d))), ("manhattan", sum), ("maximal", max)):
        for same in (True, False):
            got = {}
            for r in distances.nearest(df, df.where("i % 7 = 0"), "i", "v", 4, how, include_same=same).collect():
                got.setdefault(r.query, []).append((r["rank"], r.neighbour, round(r.d, 9)))
            for q in (i for i in known if i % 7 == 0):
                far = []
                for i, v in known.items():
                    d = norm([0.5 if at(v, k) is None or at(known[q], k) is None else abs(at(v, k) - at(known[q], k)) for k in range(max(len(v), len(known[q])))])
                    if i != q and (same or d > 0):
                        far.append((round(d, 9), i))
                assert sorted(got[q]) == [(k, i, d) for k, (d, i) in enumerate(sorted(far)[:4], 1)]

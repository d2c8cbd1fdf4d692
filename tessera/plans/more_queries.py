"""Further queries: tests of samples, interactions, measures of predictions, trees on numbers, access to tables, preprocessors, user code."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import comparisons, stats
from ..operators import distances, evaluation, extension, filters as fl, interactions, relational as rel, rules, sampling, scoring, tables, trees
from ..schema import ATTRIBUTE, CLASS, CONTINUOUS, DISCRETE, META, STRING, Variable, with_roles
from ..sources import readers, writers
from . import preprocess as pre
from .catalogue import _COUNTS, _ITEMS, _LONG, _PF, _RULE_COLS, HOLED, _is_f, _orders_with_year, _scored, holed, query, rounded, table

# --- samples -----------------------------------------------------------------------------------


@query("SELECT round(corr(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END, l_quantity), 6) + 0.0 AS r FROM lineitem")
def stat_pointbiserial(spark, d):
    return rounded(comparisons.point_biserial(table(spark, d, "lineitem"), F.col("l_returnflag") == "R", "l_quantity"))


@query("WITH c AS (SELECT l_linenumber AS x, l_quantity AS y, count(*)::HUGEINT AS w FROM lineitem GROUP BY 1, 2), p AS (SELECT sum(CASE WHEN a.y < b.y THEN a.w * b.w ELSE 0 END)::DOUBLE AS c, sum(CASE WHEN a.y > b.y THEN a.w * b.w ELSE 0 END)::DOUBLE AS d FROM c a JOIN c b ON a.x < b.x), n AS (SELECT count(*)::DOUBLE AS n FROM lineitem), tx AS (SELECT sum(k * (k - 1) / 2) AS t FROM (SELECT count(*)::DOUBLE AS k FROM lineitem GROUP BY l_linenumber)), ty AS (SELECT sum(k * (k - 1) / 2) AS t FROM (SELECT count(*)::DOUBLE AS k FROM lineitem GROUP BY l_quantity)) SELECT c::BIGINT AS concordant, d::BIGINT AS discordant, round((c - d) / sqrt((n * (n - 1) / 2 - tx.t) * (n * (n - 1) / 2 - ty.t)), 6) + 0.0 AS tau, round((c - d) / sqrt((n * (n - 1) / 2 - tx.t) * (n * (n - 1) / 2 - ty.t)) / sqrt((4 * n + 10) / (9 * n * (n - 1))), 4) + 0.0 AS z FROM p, n, tx, ty")
def stat_kendall(spark, d):
    k = comparisons.kendall(table(spark, d, "lineitem"), "l_linenumber", "l_quantity")
    return k.select("concordant", "discordant", (F.round("tau", 6) + 0.0).alias("tau"), (F.round("z", 4) + 0.0).alias("z"))


@query("WITH c AS (SELECT count(*)::DOUBLE AS n FROM orders GROUP BY o_orderpriority) SELECT round(sum((n - m) * (n - m) / m), 6) AS chi2, (count(*) - 1) AS df FROM c, (SELECT avg(n) AS m FROM c)")
def stat_chisquare_one_way(spark, d):
    return rounded(comparisons.chi_square_one_way(table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).cast("double").alias("n")), "n"))


_TREATED = "(SELECT l_quantity AS a, l_discount * 500 AS b, l_tax * 600 AS c FROM lineitem)"


def _treated(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_quantity").alias("a"), (F.col("l_discount") * 500).alias("b"), (F.col("l_tax") * 600).alias("c"))


def _rank_sql(v: str) -> str:
    return "(" + " + ".join(f"(CASE WHEN {u} < {v} THEN 1.0 WHEN {u} = {v} THEN 0.5 ELSE 0.0 END)" for u in "abc") + " + 0.5)"


@query(f"WITH r AS (SELECT count(*)::DOUBLE AS n, " + ", ".join(f"sum({_rank_sql(v)})::DOUBLE AS r{v}" for v in "abc") + f" FROM {_TREATED}), x AS (SELECT n, 12 * (ra * ra + rb * rb + rc * rc) / (n * 12) - 3 * n * 4 AS chi2 FROM r) SELECT round(chi2, 4) AS chi2, 2 AS df, round((n - 1) * chi2 / (n * 2 - chi2), 4) AS f FROM x")
def stat_friedman(spark, d):
    return rounded(comparisons.friedman(_treated(spark, d), ["a", "b", "c"]), 4)


@query(f"WITH s AS (SELECT count(*)::DOUBLE AS n, sum((a + b + c) * (a + b + c) / 3) AS rows, sum(a * a + b * b + c * c) AS q, sum(a) AS sa, sum(b) AS sb, sum(c) AS sc FROM {_TREATED}), t AS (SELECT *, (sa + sb + sc) * (sa + sb + sc) / (3 * n) AS m FROM s), u AS (SELECT *, (sa * sa + sb * sb + sc * sc) / n - m AS between_ FROM t) SELECT round(between_ / 2 / ((q - rows - between_) / ((n - 1) * 2)), 3) AS f, 2 AS df1, ((n - 1) * 2)::BIGINT AS df2 FROM u")
def stat_anova_repeated(spark, d):
    return rounded(comparisons.anova_repeated(_treated(spark, d), ["a", "b", "c"]), 3)


@query(f"WITH x AS (SELECT round(a - b, 6) AS d FROM {_TREATED} WHERE round(a - b, 6) <> 0), g AS (SELECT abs(d) AS v, count(*)::DOUBLE AS n FROM x GROUP BY 1), r AS (SELECT v, sum(n) OVER (ORDER BY v) - n + (n + 1) / 2 AS r FROM g), s AS (SELECT sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS up, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS down, count(*)::DOUBLE AS n FROM x JOIN r ON abs(x.d) = r.v) SELECT least(up, down) AS t, round((least(up, down) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24), 4) AS z FROM s")
def stat_signed_ranks(spark, d):
    x = _treated(spark, d).select(F.round(F.col("a") - F.col("b"), 6).alias("x"), F.lit(0.0).alias("y"))
    return rounded(comparisons.signed_ranks(x, "x", "y"), 4)


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS i, count(*) OVER () AS n FROM orders) WHERE i <= n - CAST(floor(0.1 * n) AS BIGINT)")
def stat_trim_one(spark, d):
    return comparisons.trim_one(table(spark, d, "orders").select("o_totalprice", "o_orderkey"), ["o_totalprice", "o_orderkey"], 0.1).select("o_orderkey")


@query("WITH p AS (SELECT min(o_totalprice) AS a, max(o_totalprice) AS b FROM orders) SELECT round(a + i * (b - a) / 4, 4) AS point FROM p, (SELECT unnest(range(5)) AS i)")
def stat_grid_points(spark, d):
    return rounded(comparisons.grid_points(table(spark, d, "orders"), "o_totalprice", 5), 4)


@query("WITH v AS (SELECT DISTINCT l_linenumber::DOUBLE AS v FROM lineitem), s AS (SELECT v, lead(v) OVER (ORDER BY v) AS nx FROM v) SELECT round(v + i * (nx - v) / 3, 6) AS point FROM s, (SELECT unnest(range(3)) AS i) WHERE nx IS NOT NULL UNION ALL SELECT round(max(v), 6) FROM v")
def stat_between_points(spark, d):
    return rounded(comparisons.between_points(table(spark, d, "lineitem"), "l_linenumber", 3))


_LINE_AT = "WITH w AS (SELECT p AS point, x - p AS dx, y, {w} AS w FROM {src}), s AS (SELECT point, sum(w) AS s, sum(w * dx) AS sx, sum(w * y) AS sy, sum(w * dx * dx) AS sxx, sum(w * dx * y) AS sxy FROM w GROUP BY point) SELECT point, round((sxx * sy - sx * sxy) / (s * sxx - sx * sx), 2) + 0.0 AS y FROM s"


@query(_LINE_AT.format(w="exp(-(x - p) * (x - p) / (2 * 4 * 4))", src="(SELECT l_quantity AS x, l_extendedprice AS y, p FROM lineitem, (SELECT unnest([5.0, 20.0, 45.0])::DOUBLE AS p))"))
def stat_lwr(spark, d):
    points = spark.createDataFrame([(5.0,), (20.0,), (45.0,)], "point double")
    return rounded(comparisons.lwr(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", points, 4.0), 2)


@query("""WITH c AS (SELECT l_quantity AS x, count(*)::DOUBLE AS n, avg(l_extendedprice) AS y FROM lineitem GROUP BY 1), q AS (SELECT x, n, y, p, abs(x - p) AS d FROM c, (SELECT unnest([5.0, 20.0, 45.0])::DOUBLE AS p)),
h AS (SELECT p, min(d) * 1.0000001 AS h FROM (SELECT p, d, sum(n) OVER (PARTITION BY p ORDER BY d) AS u, sum(n) OVER (PARTITION BY p) AS t FROM q) WHERE u >= 0.4 * t GROUP BY p),
w AS (SELECT q.p AS point, x - q.p AS dx, y, n * (1 - (d / h) ** 3) ** 3 AS w FROM q JOIN h ON h.p = q.p WHERE d < h), s AS (SELECT point, sum(w) AS s, sum(w * dx) AS sx, sum(w * y) AS sy, sum(w * dx * dx) AS sxx, sum(w * dx * y) AS sxy FROM w GROUP BY point)
SELECT point, round((sxx * sy - sx * sxy) / (s * sxx - sx * sx), 2) + 0.0 AS y FROM s""")
def stat_loess(spark, d):
    points = spark.createDataFrame([(5.0,), (20.0,), (45.0,)], "point double")
    return rounded(comparisons.loess(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", points, 0.4), 2)


# --- interactions and scores -------------------------------------------------------------------------


def _h(cols: str, name: str, src: str = "lineitem") -> str:
    return f"{name} AS (SELECT log2(sum(w)) - sum(w * log2(w)) / sum(w) AS h FROM (SELECT count(*)::DOUBLE AS w FROM {src} GROUP BY {cols}))"


_ABC = {"a": "l_returnflag", "b": "l_linestatus", "c": "l_linenumber"}
_HS = ", ".join(_h(", ".join(_ABC[x] for x in k), f"h{k}") for k in ("a", "b", "c", "ab", "ac", "bc", "abc"))


@query(f"WITH {_HS} SELECT round(-ha.h - hb.h - hc.h + hab.h + hac.h + hbc.h - habc.h, 6) + 0.0 AS interaction, round(hac.h + hbc.h - hc.h - habc.h, 6) + 0.0 AS conditional, round(ha.h + hc.h - hac.h, 6) + 0.0 AS gain_a, round(hb.h + hc.h - hbc.h, 6) + 0.0 AS gain_b, round(hab.h + hc.h - habc.h, 6) + 0.0 AS total FROM ha, hb, hc, hab, hac, hbc, habc")
def interaction_three_way(spark, d):
    return rounded(interactions.three_way(table(spark, d, "lineitem"), *_ABC.values()))


@query(f"WITH {_HS}, t AS (SELECT outer_, inner_, n::DOUBLE AS n FROM (SELECT l_returnflag AS outer_, l_linestatus AS inner_, count(*) AS n FROM lineitem GROUP BY 1, 2)), m AS (SELECT *, sum(n) OVER (PARTITION BY outer_) AS r, sum(n) OVER (PARTITION BY inner_) AS c, sum(n) OVER () AS al FROM t) SELECT round(sum(n * n * al / (r * c)) - max(al), 4) AS chi2, (count(DISTINCT outer_) - 1) * (count(DISTINCT inner_) - 1) AS df, round(max(ha.h + hb.h - hab.h), 6) + 0.0 AS mutual, round(max((ha.h + hb.h - hab.h) / hab.h), 6) + 0.0 AS jaccard FROM m, ha, hb, hab")
def interaction_two_way(spark, d):
    t = interactions.two_way(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus")
    return t.select(F.round("chi2", 4).alias("chi2"), "df", (F.round("mutual", 6) + 0.0).alias("mutual"), (F.round("jaccard", 6) + 0.0).alias("jaccard"))


_HM = ", ".join(_h(c, n) for n, c in (("h1", "l_returnflag"), ("h2", "l_linestatus"), ("h3", "l_shipdate"), ("hc", "l_linenumber"), ("h1c", "l_returnflag, l_linenumber"), ("h2c", "l_linestatus, l_linenumber"), ("h3c", "l_shipdate, l_linenumber"), ("h12", "l_returnflag, l_linestatus"), ("h13", "l_returnflag, l_shipdate"), ("h23", "l_linestatus, l_shipdate"), ("h12c", "l_returnflag, l_linestatus, l_linenumber"), ("h13c", "l_returnflag, l_shipdate, l_linenumber"), ("h23c", "l_linestatus, l_shipdate, l_linenumber")))
_NAMES = {"1": "l_returnflag", "2": "l_linestatus", "3": "l_shipdate"}


@query(f"WITH {_HM} " + " UNION ALL ".join(f"SELECT '{_NAMES[i]}' AS a, '{_NAMES[j]}' AS b, round(h{i}.h + hc.h - h{i}c.h, 5) + 0.0 AS gain_a, round(h{j}.h + hc.h - h{j}c.h, 5) + 0.0 AS gain_b, round(-h{i}.h - h{j}.h - hc.h + h{i}{j}.h + h{i}c.h + h{j}c.h - h{i}{j}c.h, 5) + 0.0 AS interaction FROM h{i}, h{j}, hc, h{i}c, h{j}c, h{i}{j}, h{i}{j}c" for i, j in ("12", "13", "23")))
def interaction_matrix(spark, d):
    return rounded(interactions.matrix(table(spark, d, "lineitem"), list(_NAMES.values()), "l_linenumber"), 5)


@query("SELECT 'l_discount' AS i, 'l_quantity' AS j, round((1 - corr(l_discount, l_quantity)) / 2, 6) AS d FROM lineitem UNION ALL SELECT 'l_tax', 'l_quantity', round((1 - corr(l_tax, l_quantity)) / 2, 6) FROM lineitem UNION ALL SELECT 'l_tax', 'l_discount', round((1 - corr(l_tax, l_discount)) / 2, 6) FROM lineitem")
def dist_columns_pearson(spark, d):
    return rounded(interactions.column_distances(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"]))


@query("WITH q AS (SELECT l_quantity AS v, sum(count(*)) OVER (ORDER BY l_quantity) - count(*) + (count(*) + 1) / 2 AS r FROM lineitem GROUP BY 1), t AS (SELECT l_discount AS v, sum(count(*)) OVER (ORDER BY l_discount) - count(*) + (count(*) + 1) / 2 AS r FROM lineitem GROUP BY 1) SELECT 'l_discount' AS i, 'l_quantity' AS j, round((1 - corr(q.r, t.r)) / 2, 6) AS d FROM lineitem l JOIN q ON q.v = l.l_quantity JOIN t ON t.v = l.l_discount")
def dist_columns_spearman(spark, d):
    return rounded(interactions.column_distances(table(spark, d, "lineitem"), ["l_quantity", "l_discount"], "spearman"))


@query(f"WITH {_HS} SELECT 'l_linestatus' AS i, 'l_returnflag' AS j, round(1 - (ha.h + hb.h - hab.h) / hab.h, 6) AS d FROM ha, hb, hab UNION ALL SELECT 'l_linenumber', 'l_returnflag', round(1 - (ha.h + hc.h - hac.h) / hac.h, 6) FROM ha, hc, hac UNION ALL SELECT 'l_linenumber', 'l_linestatus', round(1 - (hb.h + hc.h - hbc.h) / hbc.h, 6) FROM hb, hc, hbc")
def dist_columns_dependence(spark, d):
    return rounded(interactions.column_dependencies(table(spark, d, "lineitem"), list(_ABC.values())))


_RANKED = "list_transform(v, lambda x: len(list_filter(v, lambda y: y < x)) + (len(list_filter(v, lambda y: y = x)) + 1) / 2.0)"


@query(f"WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), r AS (SELECT vec_id, {_RANKED} AS v FROM e) SELECT a.vec_id AS i, b.vec_id AS j, round((1 - (list_dot_product(a.v, b.v) / len(a.v) - list_avg(a.v) * list_avg(b.v)) / sqrt((list_dot_product(a.v, a.v) / len(a.v) - list_avg(a.v) ** 2) * (list_dot_product(b.v, b.v) / len(b.v) - list_avg(b.v) ** 2))) / 2, 5) AS d FROM r a JOIN r b ON a.vec_id > b.vec_id")
def dist_matrix_spearman(spark, d):
    # ranks once a row: the distance of ranks is Pearson's
    rank = lambda v: F.transform(v, lambda x: F.size(F.filter(v, lambda y: y < x)) + (F.size(F.filter(v, lambda y: y == x)) + 1) / 2)
    e = table(spark, d, "embeddings").select("vec_id", rank(F.transform("embedding", lambda x: x.cast("double"))).alias("v"))
    return rounded(distances.matrix(e, "vec_id", "v", "pearson"), 5)


@query("WITH c AS (SELECT l_returnflag AS v, l_linestatus AS c, count(*)::DOUBLE AS w FROM lineitem GROUP BY 1, 2), t AS (SELECT c, sum(w) AS nc FROM c GROUP BY 1), g AS (SELECT v.v, t.c, coalesce(c.w, 0) AS w, nc FROM (SELECT DISTINCT v FROM c) v CROSS JOIN t LEFT JOIN c ON c.v = v.v AND c.c = t.c), s AS (SELECT v, sum(w) AS n1, sum(nc) AS n FROM g GROUP BY v) SELECT g.v AS value, round(sum(-nc / n * log2(nc / n)) - max(n1 / n) * sum(CASE WHEN w > 0 THEN -w / n1 * log2(w / n1) ELSE 0 END) - max((n - n1) / n) * sum(CASE WHEN nc > w THEN -(nc - w) / (n - n1) * log2((nc - w) / (n - n1)) ELSE 0 END), 6) + 0.0 AS gain FROM g JOIN s ON s.v = g.v GROUP BY g.v")
def score_values(spark, d):
    return rounded(interactions.value_scores(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus"))


_LF = "(lgamma({0} + 1) / ln(2))"


@query(f"WITH t AS ({_COUNTS}), k AS (SELECT count(DISTINCT class)::DOUBLE AS k FROM t), v AS (SELECT variable, value, sum(w) AS n, sum({_LF.format('w')}) AS parts FROM t GROUP BY 1, 2), a AS (SELECT variable, sum({_LF.format('n')} - parts + {_LF.format('(n + k - 1)')} - {_LF.format('n')} - {_LF.format('(k - 1)')}) AS after FROM v, k GROUP BY 1), c AS (SELECT variable, class, sum(w) AS w FROM t GROUP BY 1, 2), b AS (SELECT variable, sum(w) AS n, sum({_LF.format('w')}) AS parts FROM c GROUP BY 1) SELECT b.variable, round(({_LF.format('n')} - parts + {_LF.format('(n + k - 1)')} - {_LF.format('n')} - {_LF.format('(k - 1)')} - after) / n, 6) + 0.0 AS mdl FROM b JOIN a ON a.variable = b.variable, k")
def score_mdl(spark, d):
    return rounded(interactions.mdl_scores(_orders_with_year(spark, d), ["o_orderpriority", "year"], "o_orderstatus"))


_SUPPLIED = "(SELECT s_suppkey AS k, (s_suppkey % 3)::VARCHAR AS cls, (s_acctbal - min(s_acctbal) OVER ()) / (max(s_acctbal) OVER () - min(s_acctbal) OVER ()) AS a, (s_nationkey - min(s_nationkey) OVER ()) / (max(s_nationkey) OVER () - min(s_nationkey) OVER ())::DOUBLE AS b FROM supplier)"


@query(f"WITH x AS {_SUPPLIED}, s AS (SELECT cls, count(*) / sum(count(*)) OVER () AS p FROM x GROUP BY 1), p AS (SELECT q.cls AS c0, n.cls, abs(n.a - q.a) AS da, abs(n.b - q.b) AS db, row_number() OVER (PARTITION BY q.k, n.cls ORDER BY abs(n.a - q.a) + abs(n.b - q.b), n.k) AS rk FROM x q JOIN x n ON n.k <> q.k), w AS (SELECT CASE WHEN p.cls = c0 THEN -1.0 ELSE s.p / (1 - t.p) END AS f, da, db FROM p JOIN s ON s.cls = p.cls JOIN s t ON t.cls = c0 WHERE rk <= 5), m AS (SELECT count(*) * 5 AS m FROM x) SELECT 's_acctbal' AS variable, round(sum(f * da) / max(m), 6) AS relieff FROM w, m UNION ALL SELECT 's_nationkey', round(sum(f * db) / max(m), 6) FROM w, m")
def score_relief_all_rows(spark, d):
    """Every row is a reference."""
    df = table(spark, d, "supplier").withColumn("third", (F.col("s_suppkey") % 3).cast("string"))
    return rounded(scoring.relief(df, ["s_acctbal", "s_nationkey"], "third", "s_suppkey", m=None))


@query("WITH g AS (SELECT s_suppkey, s_acctbal, s_acctbal - lag(s_acctbal) OVER (ORDER BY s_acctbal) AS gap FROM supplier), c AS (SELECT gap AS least FROM g WHERE gap IS NOT NULL ORDER BY gap DESC LIMIT 3), l AS (SELECT min(least) AS least FROM c), n AS (SELECT s_suppkey, sum(CASE WHEN gap >= least THEN 1 ELSE 0 END) OVER (ORDER BY s_acctbal) AS side FROM g, l), f AS (SELECT side, dense_rank() OVER (ORDER BY min(s_suppkey)) - 1 AS cluster FROM n GROUP BY 1) SELECT s_suppkey AS item, cluster::INTEGER AS cluster FROM n JOIN f ON f.side = n.side")
def cluster_single_linkage(spark, d):
    """On a line, single linkage parts the rows at the widest gaps."""
    from ..operators.clustering import hierarchical_on_line

    return hierarchical_on_line(table(spark, d, "supplier"), "s_suppkey", "s_acctbal", 4, "single")


@query("SELECT o_orderkey, CASE WHEN s = m THEN o_orderstatus END AS status FROM (SELECT o_orderkey, o_orderstatus, o_totalprice AS s, max(o_totalprice) OVER () AS m FROM orders) WHERE s = m")
def score_best_on_the_fly(spark, d):
    return scoring.best_on_the_fly(table(spark, d, "orders"), "o_totalprice", "o_orderkey").select("o_orderkey", F.col("o_orderstatus").alias("status"))


# --- measures of predictions ------------------------------------------------------------------------------


@query("WITH t AS (SELECT o_orderstatus AS a, CASE WHEN o_totalprice > 150000 THEN 'F' ELSE 'O' END AS p, count(*)::DOUBLE AS n FROM orders GROUP BY 1, 2), m AS (SELECT *, sum(n) OVER (PARTITION BY a) AS r, sum(n) OVER (PARTITION BY p) AS c, sum(n) OVER () AS al FROM t) SELECT round(sum(n * n * al / (r * c)) - max(al), 4) AS chi2, (count(DISTINCT a) - 1) * (count(DISTINCT p) - 1) AS df FROM m")
def eval_confusion_chi_square(spark, d):
    o = table(spark, d, "orders").withColumn("p", F.when(F.col("o_totalprice") > 150000, "F").otherwise("O"))
    return rounded(evaluation.confusion_chi_square(o, "o_orderstatus", "p"), 4)


@query(f"WITH c AS (SELECT p, count(*) FILTER (y)::DOUBLE pos, count(*) FILTER (NOT y)::DOUBLE neg FROM {_PF} GROUP BY 1) SELECT p, sum(neg) OVER (ORDER BY p DESC) AS neg, sum(pos) OVER (ORDER BY p DESC) AS pos FROM c")
def eval_cumulative_roc(spark, d):
    return evaluation.cumulative_counts(_scored(spark, d), "p", _is_f())


_CLASSES = ["F", "O", "P"]
_WIDE = "SELECT o_orderkey AS k, o_orderstatus AS y, c AS class, round(((o_orderkey * (ascii(c) - 60)) % 97) / 97.0 + CASE WHEN o_orderstatus = c THEN 0.2 ELSE 0 END, 2) AS p FROM orders, (SELECT unnest(['F', 'O', 'P']) AS c)"


def _wide(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("y"), F.explode(F.array(*[F.lit(c) for c in _CLASSES])).alias("class"))
    p = F.round((F.col("k") * (F.ascii("class") - 60)) % 97 / F.lit(97.0) + F.when(F.col("y") == F.col("class"), 0.2).otherwise(0.0), 2)
    return o.withColumn("probability", p)


@query(f"WITH w AS ({_WIDE}), g AS (SELECT class, p, count(*) FILTER (y = class)::DOUBLE AS pos, count(*) FILTER (y <> class)::DOUBLE AS neg FROM w GROUP BY 1, 2), u AS (SELECT *, sum(neg) OVER (PARTITION BY class ORDER BY p) AS below FROM g), a AS (SELECT class, sum(pos * (below - neg / 2)) / (sum(pos) * sum(neg)) AS auc, sum(pos) AS w FROM u GROUP BY 1 HAVING sum(pos) > 0 AND sum(neg) > 0) SELECT round(sum(auc * w) / sum(w), 6) AS auc FROM a")
def eval_auc_one_against_all(spark, d):
    return rounded(evaluation.multiclass_auc(_wide(spark, d), "k", "y", _CLASSES))


@query(f"WITH w AS ({_WIDE}), two AS (SELECT w.class, o.c AS o, p, y FROM w JOIN (SELECT unnest(['F', 'O', 'P']) AS c) o ON o.c <> w.class WHERE y IN (w.class, o.c)), g AS (SELECT class, o, p, count(*) FILTER (y = class)::DOUBLE AS pos, count(*) FILTER (y = o)::DOUBLE AS neg FROM two GROUP BY 1, 2, 3), u AS (SELECT *, sum(neg) OVER (PARTITION BY class, o ORDER BY p) AS below FROM g), a AS (SELECT sum(pos * (below - neg / 2)) / (sum(pos) * sum(neg)) AS auc FROM u GROUP BY class, o HAVING sum(pos) > 0 AND sum(neg) > 0) SELECT round(avg(auc), 6) AS auc FROM a")
def eval_auc_by_pairs(spark, d):
    return rounded(evaluation.multiclass_auc(_wide(spark, d), "k", "y", _CLASSES, "pairs", weighted=False))


def _placed_sql(p: str) -> str:
    return f"(SELECT {p} AS k, (sum(neg) OVER (ORDER BY {p}) - neg / 2) / sum(neg) OVER () AS v1, (sum(pos) OVER () - sum(pos) OVER (ORDER BY {p}) + pos / 2) / sum(pos) OVER () AS v0 FROM (SELECT {p}, count(*) FILTER (y)::DOUBLE AS pos, count(*) FILTER (NOT y)::DOUBLE AS neg FROM s GROUP BY 1))"


@query(f"WITH s AS (SELECT round(o_totalprice / 600000, 2) AS a, round((o_orderkey % 89) / 89.0, 2) AS b, o_orderstatus = 'F' AS y FROM orders), v AS (SELECT y, CASE WHEN y THEN pa.v1 ELSE pa.v0 END AS va, CASE WHEN y THEN pb.v1 ELSE pb.v0 END AS vb FROM s JOIN {_placed_sql('a')} pa ON pa.k = s.a JOIN {_placed_sql('b')} pb ON pb.k = s.b) SELECT round(avg(va) FILTER (y), 6) AS auc_a, round(avg(vb) FILTER (y), 6) AS auc_b, round((avg(va) FILTER (y) - avg(vb) FILTER (y)) / sqrt((var_samp(va - vb) FILTER (y)) / count(*) FILTER (y) + (var_samp(va - vb) FILTER (NOT y)) / count(*) FILTER (NOT y)), 4) + 0.0 AS z FROM v")
def eval_compare_aucs(spark, d):
    s = table(spark, d, "orders").select(F.round(F.col("o_totalprice") / 600000, 2).alias("a"), F.round(F.col("o_orderkey") % 89 / F.lit(89.0), 2).alias("b"), "o_orderstatus")
    t = evaluation.compare_aucs(s, "a", "b", F.col("o_orderstatus") == "F")
    return t.select(F.round("auc_a", 6).alias("auc_a"), F.round("auc_b", 6).alias("auc_b"), (F.round("z", 4) + 0.0).alias("z"))


@query("WITH s AS (SELECT o_orderpriority AS data, o_orderstatus AS learner, round(avg(o_totalprice), 2) AS score FROM orders GROUP BY 1, 2), r AS (SELECT learner, rank() OVER (PARTITION BY data ORDER BY score DESC) + (count(*) OVER (PARTITION BY data, score) - 1) / 2.0 AS r FROM s) SELECT learner, round(avg(r), 6) AS rank FROM r GROUP BY 1")
def eval_average_ranks(spark, d):
    s = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("data"), F.col("o_orderstatus").alias("learner")).agg(F.round(F.avg("o_totalprice"), 2).alias("score"))
    return rounded(evaluation.average_ranks(s, "data", "learner", "score"))


# --- trees and rules -----------------------------------------------------------------------------------------


_GAIN = "(CASE WHEN {0} > 0 THEN -{0} * log2({0}) ELSE 0 END)"


@query("""WITH c AS (SELECT l_quantity AS v, l_linestatus AS k, count(*)::DOUBLE AS w FROM lineitem GROUP BY 1, 2), t AS (SELECT k, sum(w) AS n FROM c GROUP BY 1), n AS (SELECT sum(n) AS n FROM t),
g AS (SELECT x.v, t.k, coalesce(sum(c.w), 0) AS l, max(t.n) AS nk FROM (SELECT DISTINCT v FROM c) x CROSS JOIN t LEFT JOIN c ON c.k = t.k AND c.v <= x.v GROUP BY 1, 2), s AS (SELECT v, sum(l) AS nl FROM g GROUP BY 1),
e AS (SELECT g.v, s.nl, sum(CASE WHEN l > 0 THEN -l / nl * log2(l / nl) ELSE 0 END) AS hl, sum(CASE WHEN nk > l THEN -(nk - l) / (n - nl) * log2((nk - l) / (n - nl)) ELSE 0 END) AS hr, sum(-nk / n * log2(nk / n)) AS h, max(n) AS n FROM g JOIN s ON s.v = g.v, n WHERE nl < n AND nl >= 2 AND n - nl >= 2 GROUP BY 1, 2),
b AS (SELECT v FROM (SELECT v, round(h - nl / n * hl - (n - nl) / n * hr, 12) AS gain FROM e) ORDER BY gain DESC, v LIMIT 1), p AS (SELECT l_quantity <= (SELECT v FROM b) AS side, l_linestatus AS predicted, row_number() OVER (PARTITION BY l_quantity <= (SELECT v FROM b) ORDER BY count(*) DESC, l_linestatus) AS i FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, predicted FROM lineitem JOIN p ON p.side = (l_quantity <= (SELECT v FROM b)) AND i = 1""")
def tree_stump(spark, d):
    li = table(spark, d, "lineitem")
    tree = trees.grow(li, [], "l_linestatus", "gain", depth=1, continuous=["l_quantity"])
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", trees.predict(tree).alias("predicted"))


@query()
def tree_mixed(spark, d):
    """Discrete and continuous columns, missing values into all branches by their sizes."""
    df = holed(spark, d).select("l_orderkey", "l_linenumber", "flag", "qty", "l_discount", "l_linestatus")
    tree = trees.grow(df, ["flag"], "l_linestatus", "gain", min_rows=50, depth=3, continuous=["qty", "l_discount"], split="binary", unknown="sizes")
    return df.select("l_orderkey", "l_linenumber", trees.predict(tree, "sizes").alias("predicted"))


@query()
def rules_unordered(spark, d):
    o = _orders_with_year(spark, d)
    found = trees.induce_unordered(o, ["o_orderpriority", "year"], "o_orderstatus", least_significance=3.84, evaluator=trees.weighted_accuracy)
    return o.select("o_orderkey", trees.voted(found).alias("predicted"))


@query(f"WITH b AS MATERIALIZED {_LONG}, {_ITEMS}, n AS (SELECT count(*)::DOUBLE AS n FROM lineitem), s AS (SELECT item, count(*)::DOUBLE AS k FROM i GROUP BY 1), p AS (SELECT a.item AS x, c.item AS y, count(*)::DOUBLE AS k FROM i a JOIN i c ON a.r = c.r AND a.item <> c.item GROUP BY 1, 2) SELECT x AS antecedent, y AS consequent, round(p.k / n, 6) AS support, round(p.k / a.k, 6) AS confidence FROM p JOIN s a ON a.item = x, n WHERE p.k >= 0.05 * n AND p.k / a.k >= 0.5 AND y LIKE 'l_linestatus=%'")
def classification_rules(spark, d):
    r = rules.rules(rules.items_of(table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber"), _RULE_COLS), 0.05, 0.5, consequent="l_linestatus=")
    one = rules.having(r.where(F.size("antecedent") == 1), "consequent", ["l_linestatus=F", "l_linestatus=O"])
    return rounded(one.select(F.get("antecedent", 0).alias("antecedent"), F.get("consequent", 0).alias("consequent"), "support", "confidence"))


# --- access to tables --------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) WHERE i >= 3 AND i < 700 AND (i - 3) % 4 = 0")
def table_subscript(spark, d):
    o = rel.numbered(table(spark, d, "orders"), ["o_orderkey"])
    return tables.subscript(o, "row_id", slice(3, 700, 4), ["o_orderkey", "o_totalprice"])


@query("SELECT o_orderkey, i AS row_id FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) WHERE i NOT IN (0, 5, 7)")
def table_without_rows(spark, d):
    o = rel.numbered(table(spark, d, "orders"), ["o_orderkey"])
    return tables.without_rows(o, "row_id", [0, 5, 7]).select("o_orderkey", "row_id")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT 99, 'NOWHERE', 3")
def table_append(spark, d):
    return tables.append(table(spark, d, "nation"), {"n_nationkey": 99, "n_name": "NOWHERE", "n_regionkey": 3})


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 0.5 END AS note, coalesce(CASE WHEN n_regionkey = 1 THEN 0.5 END, 2.0) AS copy FROM nation")
def table_metas(spark, d):
    n = tables.add_meta(table(spark, d, "nation"), "note", 0.5, F.col("n_regionkey") == 1)
    return tables.copy_meta(n, "note", "copy", 2.0).select("n_nationkey", "note", "copy")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH') OR o_orderpriority IS NULL")
def filter_quick_select_rest(spark, d):
    return fl.quick_select(table(spark, d, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH"])[1].select("o_orderkey", "o_orderpriority")


@query("SELECT i::BIGINT AS place, d FROM (SELECT row_number() OVER (ORDER BY a.n_nationkey, b.n_nationkey) - 1 AS i, abs(a.n_regionkey - b.n_regionkey)::DOUBLE AS d FROM nation a JOIN nation b ON a.n_nationkey > b.n_nationkey)")
def matrix_flat(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", F.array(F.col("n_regionkey").cast("double")).alias("x"))
    return distances.flat(distances.matrix(n, "n_nationkey", "x", "manhattan"))


@query("SELECT c_nationkey, round(avg(c_acctbal), 4) AS c_acctbal, min(c_mktsegment) FILTER (n = m) AS c_mktsegment FROM (SELECT *, max(n) OVER (PARTITION BY c_nationkey) AS m FROM (SELECT *, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS n FROM customer)) GROUP BY 1")
def cluster_centre(spark, d):
    from ..operators.clustering import centre

    return rounded(centre(table(spark, d, "customer"), ["c_acctbal"], ["c_mktsegment"], ["c_nationkey"]), 4)


# --- files: written into the shared folder and read again ---------------------------------------------------------


def _folder(spark, ending: str) -> str:
    import uuid

    from ..lineage import checkpoint_dir

    return f"{checkpoint_dir(spark)}/io-{uuid.uuid4().hex}{ending}"


def _priced(spark, d):
    o = holed(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "qty", "flag", F.concat_ws(", ", "l_returnflag", "l_linestatus").alias("both"))
    keys = [Variable(c, CONTINUOUS, META) for c in ("l_orderkey", "l_linenumber", "l_partkey")]
    return with_roles(o, [*keys, Variable("qty"), Variable("flag", DISCRETE, CLASS, ("A", "N", "R")), Variable("both", STRING, META)])


_PRICED = f"SELECT l_orderkey::DOUBLE AS l_orderkey, l_linenumber::DOUBLE AS l_linenumber, l_partkey::DOUBLE AS l_partkey, qty, flag, l_returnflag || ', ' || l_linestatus AS both FROM {HOLED}"


@query(_PRICED)
def io_tab(spark, d):
    path = _folder(spark, ".tab")
    writers.write(_priced(spark, d), path)
    return readers.read(spark, path)


@query(_PRICED)
def io_csv(spark, d):
    path = _folder(spark, ".csv")
    writers.write(_priced(spark, d), path)
    return readers.read(spark, path)


@query(_PRICED)
def io_txt(spark, d):
    path = _folder(spark, ".txt")
    writers.write(_priced(spark, d), path)
    return readers.read(spark, path)


@query(_PRICED.replace("::DOUBLE", ""))
def io_kept(spark, d):
    path = _folder(spark, "")
    writers.keep(_priced(spark, d), path)
    return readers.restored(spark, path)


@query(f"SELECT qty, flag FROM {HOLED}")
def io_arff(spark, d):
    path = _folder(spark, ".arff")
    writers.write(with_roles(_priced(spark, d), [Variable("qty"), Variable("flag", DISCRETE, CLASS, ("A", "N", "R"))]), path)
    return readers.read(spark, path)


@query("SELECT o_orderkey::DOUBLE AS label, k::INTEGER AS k, v FROM (SELECT o_orderkey, unnest([1, 2]) AS k, unnest([o_totalprice, (o_orderkey % 3)::DOUBLE]) AS v FROM orders) WHERE v <> 0")
def io_libsvm(spark, d):
    path = _folder(spark, ".svm")
    o = table(spark, d, "orders").withColumn("third", F.col("o_orderkey") % 3)
    writers.write_libsvm(o, path, "o_orderkey", ["o_totalprice", "third"])
    return readers.read(spark, path).select("label", F.explode("features").alias("k", "v"))


@query("SELECT item, w, count(*) AS n FROM (SELECT unnest([o_orderstatus, o_orderpriority]) AS item, unnest([1.0, 2.5])::DOUBLE AS w FROM orders) GROUP BY 1, 2")
def io_basket(spark, d):
    path = _folder(spark, ".basket")
    o = table(spark, d, "orders").select(F.create_map(F.col("o_orderstatus"), F.lit(1.0), F.col("o_orderpriority"), F.lit(2.5)).alias("items"))
    writers.write_basket(o, path)
    return readers.read(spark, path).select(F.explode("items").alias("item", "w")).groupBy("item", "w").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_nationkey::BIGINT AS a, (100 + n_regionkey)::BIGINT AS b, 1.0::DOUBLE AS w, false AS directed FROM nation")
def io_pajek(spark, d):
    path = _folder(spark, ".net")
    n = table(spark, d, "nation")
    vertices = n.select(F.col("n_nationkey").alias("vertex"), F.col("n_name").alias("label")).union(n.select(F.col("n_regionkey") + 100, F.lit("region")).distinct())
    writers.write_pajek(vertices, n.select(F.col("n_nationkey").alias("a"), (F.col("n_regionkey") + 100).alias("b")), path)
    return readers.read_pajek(spark, path)[1]


@query("SELECT o_orderstatus, o_orderpriority, count(*)::DOUBLE AS n FROM orders GROUP BY 1, 2")
def io_sql(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("tessera_orders")
    return readers.read_sql(spark, "SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS DOUBLE) AS n FROM tessera_orders GROUP BY 1, 2", discrete=["o_orderstatus"], cls="o_orderpriority")


@query("SELECT p_size::DOUBLE AS size, p_retailprice AS price, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS class, count(*) AS n FROM part GROUP BY 1, 2, 3")
def io_numpy(spark, d):
    p = table(spark, d, "part").select(F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"), F.when(F.col("p_size") > 25, "big").otherwise("small").alias("class"))
    v = [Variable("size"), Variable("price"), Variable("class", DISCRETE, CLASS, ("big", "small"))]
    (x,) = tables.to_numpy(with_roles(p, v), "ac")
    return tables.from_numpy(spark, x, v).groupBy("size", "price", "class").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT s_nationkey::DOUBLE AS nation, s_name AS name FROM supplier")
def io_rows(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"))
    return tables.from_rows(spark, tables.native(s), [Variable("nation"), Variable("name", STRING, META)])


# --- preprocessors ---------------------------------------------------------------------------------------------------


def _described(spark, d):
    df = holed(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "qty", "l_discount", "flag", "l_linestatus")
    key = [Variable(c, CONTINUOUS, META) for c in ("l_orderkey", "l_linenumber", "l_partkey")]
    return with_roles(df, [*key, Variable("qty"), Variable("l_discount"), Variable("flag", DISCRETE, ATTRIBUTE, ("A", "N", "R")), Variable("l_linestatus", DISCRETE, CLASS, ("F", "O"))])


@query(f"WITH h AS (SELECT * FROM {HOLED}), s AS (SELECT avg(qty) AS q, min(coalesce(qty, 0)) AS z FROM h), m AS (SELECT arg_max(flag, n) AS flag FROM (SELECT flag, count(*) AS n FROM h WHERE flag IS NOT NULL GROUP BY 1)), f AS (SELECT l_orderkey, l_linenumber, l_partkey, coalesce(qty, s.q) AS qty, l_discount, coalesce(h.flag, m.flag) AS flag, l_linestatus FROM h, s, m), r AS (SELECT min(qty) AS a, max(qty) AS b, min(l_discount) AS c, max(l_discount) AS e FROM f) SELECT l_orderkey, l_linenumber, l_partkey, l_linestatus, round((qty - a) / (b - a), 6) AS qty, round((l_discount - c) / (e - c), 6) AS l_discount, (flag = 'A')::INTEGER::DOUBLE AS \"flag=A\", (flag = 'N')::INTEGER::DOUBLE AS \"flag=N\", (flag = 'R')::INTEGER::DOUBLE AS \"flag=R\" FROM f, r")
def preprocess_chain(spark, d):
    df = _described(spark, d)
    return rounded(pre.chain([pre.imputed("average"), pre.continuized("n_values", "span")])(df)(df))


@query("WITH s AS (SELECT min(l_extendedprice) AS a, max(l_extendedprice) AS b FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ((l_extendedprice > a + (b - a) / 4)::INTEGER + (l_extendedprice > a + 2 * (b - a) / 4)::INTEGER + (l_extendedprice > a + 3 * (b - a) / 4)::INTEGER) AS bin FROM lineitem, s")
def preprocess_discretized(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    out = pre.discretized("equal_width", 4, ["l_extendedprice"])(df)(df)
    from ..schema import code

    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", code(out, "l_extendedprice").cast("int").alias("bin"))


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'high' ELSE o_orderpriority END AS priority FROM orders")
def merge_values(spark, d):
    return table(spark, d, "orders").select("o_orderkey", interactions.merged_values(F.col("o_orderpriority"), {"high": ["1-URGENT", "2-HIGH"]}).alias("priority"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, printf('%.2f', l_extendedprice) AS price FROM lineitem")
def format_numbers(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", pre.formatted(F.col("l_extendedprice"), 2).alias("price"))


# --- user code ----------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey FROM orders WHERE o_totalprice % 7 < 3 AND o_orderstatus <> 'P'")
def user_condition(spark, d):
    return extension.accepted(lambda x: (x["o_totalprice"] % 7 < 3) & (x["o_orderstatus"] != "P"), table(spark, d, "orders"), ["o_totalprice", "o_orderstatus"]).select("o_orderkey")


@query("SELECT o_orderkey, round(sqrt(o_totalprice), 6) AS root FROM orders")
def user_transformer(spark, d):
    return rounded(table(spark, d, "orders").select("o_orderkey", extension.transformed(lambda x: x**0.5, F.col("o_totalprice")).alias("root")))


@query(f"SELECT variable, round(max(w) / sum(w), 6) AS score FROM ({_COUNTS}) GROUP BY 1")
def user_score(spark, d):
    return rounded(extension.scored(_orders_with_year(spark, d), ["o_orderpriority", "year"], "o_orderstatus", lambda t: t["w"].max() / t["w"].sum()))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'F' ELSE 'O' END AS predicted FROM orders")
def user_classifier(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return extension.classified(lambda x: (x["o_totalprice"] > 100000).map({True: "F", False: "O"}), o).select("o_orderkey", "predicted")


@query("WITH c AS (SELECT o_orderpriority AS k, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1, 2), b AS (SELECT k, s FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, s) AS i FROM c) WHERE i = 1) SELECT o_orderkey, b.s AS predicted FROM orders JOIN b ON b.k = o_orderpriority")
def user_learner(spark, d):
    def fit(counts):
        best = counts.sort_values(["n", "o_orderstatus"], ascending=[False, True]).groupby("o_orderpriority")["o_orderstatus"].first().to_dict()
        return lambda x: x["o_orderpriority"].map(best)

    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return extension.learnt(fit, ["o_orderpriority"], "o_orderstatus")(o, o).select("o_orderkey", "predicted")


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def sql_node(spark, d):
    return extension.sql("SELECT o_orderstatus, count(*) AS n FROM {o} GROUP BY 1", {"o": table(spark, d, "orders")})


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type AS outer, (user_id % 3)::BIGINT AS inner, count(*)::DOUBLE AS n FROM events GROUP BY ALL")
def events_windowed_contingency(spark, d):
    from ..streaming.online import windowed_contingency

    e = table(spark, d, "events").withColumn("third", F.col("user_id") % 3)
    return windowed_contingency(e, "ts", "event_type", "third", "1 hour", "1 hour")


@query("SELECT o_orderkey, ((row_number() OVER (ORDER BY o_orderstatus, o_orderkey) - 1) % 4)::INTEGER AS fold FROM orders")
def folds_stratified_four(spark, d):
    return sampling.folds(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), 4, ["o_orderkey"], "o_orderstatus").select("o_orderkey", "fold")


@query("SELECT l_linestatus AS value, round(count(*) / sum(count(*)) OVER (), 6) AS w FROM lineitem GROUP BY 1")
def dist_shares(spark, d):
    return rounded(stats.distribution(table(spark, d, "lineitem"), "l_linestatus", normalize=True))

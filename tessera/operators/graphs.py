"""Graphs as tables of edges (a, b)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..lineage import cut
from .ordered import running


def from_matrix(m: DataFrame, low: float, high: float) -> DataFrame:
    """Edges between items whose distance lies between two bounds."""
    return m.where(F.col("d").between(low, high)).select(F.col("i").alias("a"), F.col("j").alias("b"), "d")


def between_rows(df: DataFrame, key: str, x: str, low: float, high: float, how: str = "euclidean") -> DataFrame:
    """Edges (a, b, d) between rows whose distance lies between two bounds; other pairs don't leave the tasks that compare them."""
    from .distances import matrix

    return matrix(df, key, x, how, within=(low, high)).select(F.col("i").alias("a"), F.col("j").alias("b"), "d")


def degrees(edges: DataFrame) -> DataFrame:
    """vertex, degree; a loop counts twice."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("vertex"))
    return ends.groupBy("vertex").agg(F.count(F.lit(1)).alias("degree"))


def hide(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges without those at the given vertices (column `vertex`)."""
    return edges.join(vertices.select(F.col("vertex").alias("a")), "a", "left_anti").join(vertices.select(F.col("vertex").alias("b")), "b", "left_anti").select("a", "b")


def collapse(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """a, b, n: edges between groups (vertex, grp); a vertex without a group is its own."""
    g = lambda c, n: groups.select(F.col("vertex").alias(c), F.col("grp").alias(n))
    t = edges.join(g("a", "ga"), "a", "left").join(g("b", "gb"), "b", "left").select(F.coalesce("ga", "a").alias("a"), F.coalesce("gb", "b").alias("b")).where("a != b")
    return t.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def label_propagation(edges: DataFrame, rounds: int) -> DataFrame:
    """vertex, label: each round, a vertex takes the label most frequent around it, the least of several.

    Each round is cut from the plan by a checkpoint.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = both.select(F.col("a").alias("vertex"), F.col("a").alias("label")).distinct()
    for _ in range(rounds):
        votes = both.join(labels.select(F.col("vertex").alias("b"), "label"), "b").groupBy("a", "label").agg(F.count(F.lit(1)).alias("n"))
        labels = cut(votes.groupBy(F.col("a").alias("vertex")).agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("m")).select("vertex", F.col("m.label").alias("label")))
    return labels


def pathfinder(edges: DataFrame, q: int = 2, r: float = float("inf")) -> DataFrame:
    """Edges (a, b, d) that no detour of up to q steps replaces: PFNET(r, q), lengths of steps joined by the r-norm (their greatest for infinity).

    Each further step joins the best detours so far with the edges; a detour that is
    longer than the longest edge is of no use and goes.
    """
    both = edges.select("a", "b", "d").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
    step = both.groupBy(F.col("a").alias("m"), F.col("b").alias("c")).agg(F.min("d").alias("d2"))
    longest = edges.agg(F.max("d").alias("_longest"))
    joined = F.greatest("d", "d2") if r == float("inf") else F.pow(F.pow("d", F.lit(r)) + F.pow("d2", F.lit(r)), F.lit(1 / r))
    way, best = both, None
    for _ in range(max(q - 1, 0)):
        more = way.withColumnRenamed("b", "m").join(step, "m").where("a <> c").select("a", F.col("c").alias("b"), joined.alias("d"))
        way = cut(more.join(F.broadcast(longest)).where("d <= _longest").groupBy("a", "b").agg(F.min("d").alias("d")))
        best = way if best is None else best.union(way)
    if best is None:
        return edges.select("a", "b", "d")
    detour = best.groupBy("a", "b").agg(F.min("d").alias("way"))
    return edges.join(detour, ["a", "b"], "left").where(F.col("way").isNull() | (F.col("d") <= F.col("way"))).select("a", "b", "d")


def pathfinder_on_line(df: DataFrame, key: str, x: str, high: float) -> DataFrame:
    """Edges (a, b, d) of PFNET(inf, 2) over rows by one number, of those of up to `high`, with a > b.

    A row between two others makes a detour whose longest step is shorter, and no other
    row does: left are edges between values side by side, and between equal ones.
    """
    rows = df.where(F.col(x).isNotNull()).select(F.col(key).alias("_k"), F.col(x).cast("double").alias("_x"))
    follow = running(rows.select("_x").distinct(), "_x", {}, following="_y").where(F.col("_y") - F.col("_x") <= high)
    here, there = rows.select(F.col("_k").alias("_i"), "_x"), rows.select(F.col("_k").alias("_j"), F.col("_x").alias("_y"))
    side = here.join(follow, "_x").join(there, "_y").where("_i <> _j")
    equal = here.withColumn("_y", F.col("_x")).join(there, "_y").where("_i > _j")
    pair = lambda t: t.select(F.greatest("_i", "_j").alias("a"), F.least("_i", "_j").alias("b"), F.abs(F.col("_y") - F.col("_x")).alias("d"))
    return pair(side).unionByName(pair(equal.select("_i", "_j", "_x", "_y")))


def closest(vertices: DataFrame, x: float, y: float) -> DataFrame:
    """The vertex (vertex, x, y) nearest to a point."""
    d = (F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y)
    return vertices.withColumn("d", d).orderBy("d", "vertex").limit(1).drop("d")


def rank_groups(edges: DataFrame) -> DataFrame:
    d = degrees(edges)
    # a rank for each distinct degree, of which there are few for many vertices
    place = running(d.select("degree").distinct(), "degree", {"rank": F.lit(1)}, descending=True)
    return d.join(place, "degree").select("vertex", "degree", F.col("rank").cast("int").alias("rank"))


def in_rectangle(vertices: DataFrame, x1: float, y1: float, x2: float, y2: float) -> DataFrame:
    """Vertices (vertex, x, y) inside a rectangle."""
    return vertices.where(F.col("x").between(min(x1, x2), max(x1, x2)) & F.col("y").between(min(y1, y2), max(y1, y2)))


def with_items(vertices: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """Vertices with the rows of a table that their numbers name."""
    return vertices.join(items, F.col("vertex") == F.col(key), "left")


def grouped(edges: DataFrame, levels: list[DataFrame]) -> list[DataFrame]:
    """A hierarchy of graphs: each level's groups (vertex, grp) collapse the edges of the one before."""
    out = []
    for groups in levels:
        edges = cut(collapse(edges, groups).select("a", "b"))
        out.append(edges)
    return out


def expanded(edges: DataFrame, groups: DataFrame, group) -> DataFrame:
    """Edges of the vertices inside one group."""
    inside = groups.where(F.col("grp") == group).select(F.col("vertex").alias("_v"))
    return edges.join(inside, F.col("a") == F.col("_v"), "left_semi").join(inside, F.col("b") == F.col("_v"), "left_semi")


#: Vertices that a layout may place on the driver.
MOST_PLACED = 2_000


def circular(vertices: DataFrame) -> DataFrame:
    """vertex, x, y: all on a circle, in the order of their numbers."""
    from .ordered import numbered

    total = vertices.agg(F.count(F.lit(1)).alias("_n"))
    angle = 2 * F.pi() * F.col("_i") / F.col("_n")
    return numbered(vertices.select("vertex"), ["vertex"], "_i").crossJoin(F.broadcast(total)).select("vertex", F.cos(angle).alias("x"), F.sin(angle).alias("y"))


def spread_out(vertices: DataFrame, seed: int = 0) -> DataFrame:
    """vertex, x, y: places in the unit square by a hash."""
    at = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "vertex"), F.lit(1 << 30)) / float(1 << 30)
    return vertices.select("vertex", at(0).alias("x"), at(1).alias("y"))


def force_directed(vertices: DataFrame, edges: DataFrame, steps: int = 50, seed: int = 0) -> DataFrame:
    """vertex, x, y after Fruchterman and Reingold (1991): all push each other away, edges pull; on the driver, their number is checked."""
    import numpy as np

    names = [r.vertex for r in vertices.select("vertex").distinct().orderBy("vertex").limit(MOST_PLACED + 1).collect()]
    if len(names) > MOST_PLACED:
        raise ValueError(f"more than {MOST_PLACED} vertices: place groups of them")
    at = {v: i for i, v in enumerate(names)}
    ends = np.array([(at[r.a], at[r.b]) for r in edges.select("a", "b").distinct().collect() if r.a in at and r.b in at], int).reshape(-1, 2)
    x = np.random.default_rng(seed).random((len(names), 2))
    k = 1 / max(len(names), 1) ** 0.5
    for t in range(steps):
        apart = x[:, None] - x[None]
        length = np.maximum(np.sqrt((apart**2).sum(-1)), 1e-6)
        move = (apart * (k * k / length**2)[..., None]).sum(1)
        pull = x[ends[:, 0]] - x[ends[:, 1]]
        pull = pull * (np.sqrt((pull**2).sum(-1)) / k)[:, None]
        np.add.at(move, ends[:, 0], -pull)
        np.add.at(move, ends[:, 1], pull)
        size = np.maximum(np.sqrt((move**2).sum(-1)), 1e-9)
        x = x + move / size[:, None] * np.minimum(size, 0.1 * (1 - t / steps))[:, None]
    return vertices.sparkSession.createDataFrame([(v, float(a), float(b)) for v, (a, b) in zip(names, x, strict=True)], "vertex long, x double, y double")

"""Scores of attributes, all from one table of counts (variable, value, class, w)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.stats import domain_contingency
from .ordered import running


def plogp(w: Column, n: Column) -> Column:
    """-p log2 p of p = w / n, 0 at 0."""
    p = w / n
    return F.when(w > 0, -p * F.log2(p)).otherwise(0.0)


def scores(df: DataFrame, columns: list[str], cls: str) -> DataFrame:
    """variable and info_gain, gain_ratio, gini, relevance, distance; unknown values lower a score by their share."""
    t = domain_contingency(df, columns, cls)
    by_value = Window.partitionBy("variable", "value")
    by_class = Window.partitionBy("variable", "class")
    whole = Window.partitionBy("variable")
    t = t.withColumns({"nv": F.sum("w").over(by_value), "nc": F.sum("w").over(by_class), "n": F.sum("w").over(whole)})
    t = t.withColumn("share", F.col("w") / F.col("nc"))
    first = F.row_number().over(by_value.orderBy(F.desc("share"), "class")) == 1
    t = t.withColumns({"best": first, "v1": F.row_number().over(by_value.orderBy("class")) == 1, "c1": F.row_number().over(by_class.orderBy("value")) == 1})
    w, nv, nc, n = (F.col(c) for c in ("w", "nv", "nc", "n"))
    parts = t.groupBy("variable").agg(
        F.max("n").alias("n"),
        F.sum(F.when(F.col("c1"), plogp(nc, n)).otherwise(0.0)).alias("hc"),
        F.sum(F.when(F.col("v1"), plogp(nv, n)).otherwise(0.0)).alias("ha"),
        F.sum(nv / n * plogp(w, nv)).alias("hca"),
        F.sum(plogp(w, n)).alias("hac"),
        F.sum(F.when(F.col("c1"), nc / n * nc / n).otherwise(0.0)).alias("gc"),
        F.sum(w * w / (nv * n)).alias("gca"),
        F.sum(F.when(~F.col("best"), F.col("share")).otherwise(0.0)).alias("miss"),
        F.count_distinct("class").alias("k"),
    )
    total = df.where(F.col(cls).isNotNull()).agg(F.count(F.lit(1)).alias("total"))
    p = parts.join(F.broadcast(total)).withColumn("known", F.col("n") / F.col("total"))
    tidy = lambda x: F.when(F.abs(x) < 1e-6, 0.0).otherwise(x)
    gain = (F.col("hc") - F.col("hca")) * F.col("known")
    ratio = F.when((F.col("ha") < 1e-20) | (F.col("hc") - F.col("hca") < 1e-20), 0.0).otherwise((F.col("hc") - F.col("hca")) / F.col("ha") * F.col("known"))
    return p.select("variable", tidy(gain).alias("info_gain"), tidy(ratio).alias("gain_ratio"), tidy((F.col("gca") - F.col("gc")) / 2 * F.col("known")).alias("gini"), tidy((1 - F.col("miss") / F.greatest(F.col("k") - 1, F.lit(1))) * F.col("known")).alias("relevance"), tidy((F.col("hc") - F.col("hca")) / F.nullif(F.col("hac"), F.lit(0.0))).alias("distance"))


def mse_score(df: DataFrame, column: str, target: str, m: float = 0.0) -> DataFrame:
    """The share of the target's variance that the column's values explain."""
    known = df.where(F.col(column).isNotNull() & F.col(target).isNotNull())
    g = known.groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.sum(target).alias("s"), F.sum(F.col(target) * F.col(target)).alias("q"))
    n, s, q = F.sum("n"), F.sum("s"), F.sum("q")
    var = q / n - s * s / (n * n)
    inner = F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n"))
    return g.agg(((var - (inner + m * var) / (n + m)) / var).alias("mse_score"))


def best(scored: DataFrame, by: str, n: int | None = None, threshold: float | None = None) -> DataFrame:
    """The first n, or those above a threshold, best first."""
    out = scored if threshold is None else scored.where(F.col(by) > threshold)
    out = out.orderBy(F.desc(by), "variable")
    return out if n is None else out.limit(n)


def threshold_scores(df: DataFrame, column: str, cls: str) -> DataFrame:
    """cut, gain: the information gain of every cut of a continuous column, from running class counts."""
    counts = df.where(F.col(column).isNotNull() & F.col(cls).isNotNull()).groupBy(F.col(column).alias("cut"), F.col(cls).alias("class")).agg(F.count(F.lit(1)).alias("w"))
    totals = counts.groupBy("class").agg(F.sum("w").alias("nc"))
    cuts = counts.select("cut").distinct()
    grid = cuts.join(F.broadcast(totals)).join(counts, ["cut", "class"], "left").fillna(0, ["w"])
    run = running(grid, "cut", {"left": F.col("w")}, ["class"])
    sums = run.groupBy("cut").agg(F.sum("left").alias("l"), F.sum("nc").alias("n"), F.collect_list(F.struct("left", "nc")).alias("c"))
    ent = lambda f, n: F.aggregate(F.transform("c", lambda x: plogp(f(x).cast("double"), n)), F.lit(0.0), lambda a, b: a + b)
    right = F.col("n") - F.col("l")
    h = ent(lambda x: x["nc"], F.col("n")) - F.col("l") / F.col("n") * ent(lambda x: x["left"], F.col("l")) - right / F.col("n") * ent(lambda x: x["nc"] - x["left"], right)
    return sums.where(right > 0).select("cut", h.alias("gain"))


def mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """Entropies of two columns, of both, and their mutual information in bits, with its share of the joint entropy."""
    t = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("w"))
    t = t.withColumns({"na": F.sum("w").over(Window.partitionBy(a)), "nb": F.sum("w").over(Window.partitionBy(b))}).join(F.broadcast(t.agg(F.sum("w").alias("n"))))
    # each row adds its share of the marginal entropies
    h = t.agg(F.sum(-F.col("w") / F.col("n") * F.log2(F.col("na") / F.col("n"))).alias("h_a"), F.sum(-F.col("w") / F.col("n") * F.log2(F.col("nb") / F.col("n"))).alias("h_b"), F.sum(plogp(F.col("w"), F.col("n"))).alias("h_ab"))
    i = F.col("h_a") + F.col("h_b") - F.col("h_ab")
    return h.select("h_a", "h_b", "h_ab", i.alias("mutual"), (i / F.nullif(F.col("h_ab"), F.lit(0.0))).alias("jaccard"))


def relief(df: DataFrame, columns: list[str], cls: str, key: str, m: int | None = 50, k: int = 5) -> DataFrame:
    """variable, relieff: the k nearest hits and misses of m reference rows (a sampling operator), or of all rows for None.

    Few reference rows go to every task. Many are dealt over cells of near rows, and
    meet only the cells that may hold one of their nearest.
    """
    from ..plans.transforms import ranges
    from .sampling import order_key

    r = ranges(df, columns)
    rows = df.where(F.col(cls).isNotNull()).select(F.col(key).alias("key"), F.col(cls).alias("cls"), F.array(*[((F.col(c) - r[c]["min"]) / ((r[c]["max"] - r[c]["min"]) or 1.0)).cast("double") for c in columns]).alias("x"))
    total = rows.count()
    asked = total if m is None else min(m, total)
    refs = (rows if m is None else rows.orderBy(order_key(["key"]), "key").limit(m)).select(F.col("key").alias("k0"), F.col("cls").alias("c0"), F.col("x").alias("x0"))
    sums = _sums_of_few(rows, refs, k) if asked <= RELIEF_FEW else _sums_by_cells(rows, None if m is None else refs, k)
    share = rows.groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
    share = share.join(F.broadcast(share.agg(F.sum("n").alias("t")))).select(F.col("cls"), (F.col("n") / F.col("t")).alias("p"))
    w = sums.join(F.broadcast(share), "cls").join(F.broadcast(share.select(F.col("cls").alias("c0"), F.col("p").alias("p0"))), "c0")
    part = w.select(F.when(F.col("cls") == F.col("c0"), F.lit(-1.0)).otherwise(F.col("p") / (1 - F.col("p0"))).alias("f"), F.posexplode("s").alias("i", "v"))
    names = F.array(*[F.lit(c) for c in columns])
    return part.groupBy("i").agg(F.sum(F.col("f") * F.col("v")).alias("s")).select(F.get(names, "i").alias("variable"), (F.col("s") / F.lit(float(asked * k))).alias("relieff"))


#: Reference rows that every task is given; more of them are dealt over cells.
RELIEF_FEW = 1_000
#: Rows that are compared at a time, of a cell, of a block of reference rows, and of a leaf of either.
RELIEF_PART, RELIEF_CELL, RELIEF_BLOCK, RELIEF_LEAF = 100_000, 5_000, 5_000, 64
#: Pairs of a class and a block that are compared without leaves.
RELIEF_PLAIN = 4_000_000
#: Rows by which the cells are laid out, of a cell and of all.
RELIEF_SAMPLE, RELIEF_SAMPLES = 32, 200_000


def _search(k: int):
    """For the workers: vectors of a column and a column of vectors, and the k nearest rows of each class to each reference row.

    Rows of both kinds are cut into leaves of near rows, and a leaf of reference rows is compared
    with the leaves of a class that may hold one of the k nearest.
    """
    leaf, plain = RELIEF_LEAF, RELIEF_PLAIN

    def vectors(x: pa.Array) -> np.ndarray:
        flat = x.flatten()
        return np.where(flat.is_null().to_numpy(zero_copy_only=False), np.nan, flat.to_numpy(zero_copy_only=False).astype(float)).reshape(len(x), len(flat) // max(1, len(x)))

    def lists(x: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))

    def apart(a, b):
        d = np.abs(a - b)
        return np.where(np.isnan(d), 0.5, d)

    def leaves(x, own):
        """Parts of the rows, halved along the column in which they lie widest apart."""
        out, todo = [], [own]
        while todo:
            i = todo.pop()
            if len(i) <= leaf:
                out.append(i)
                continue
            v = x[i]
            c = int(np.argmax(np.ptp(np.where(np.isnan(v), 0.5, v), axis=0)))
            i = i[np.argpartition(v[:, c], len(i) // 2)]
            todo += [i[: len(i) // 2], i[len(i) // 2 :]]
        return out

    def box(x, i):
        """Bounds of rows by column; none where a value is missing."""
        low, high = x[i].min(0), x[i].max(0)
        return np.where(np.isnan(low), -np.inf, low), np.where(np.isnan(high), np.inf, high)

    def sums(x, own, x0, q):
        d = np.zeros((len(q), len(own)))
        for v in range(x.shape[1]):
            d += apart(x[own, v][None], x0[q, v][:, None])
        return d

    def compared(x, own, x0, asked, names):
        """Reference rows and the rows of a class among which their k nearest are."""
        everyone = np.arange(len(asked))
        if len(own) * len(asked) <= plain:
            step = max(1, 500_000 // len(own))
            for s in range(0, len(asked), step):
                yield everyone[s : s + step], own
            return
        cells = leaves(x, own)
        lows, highs = (np.array(v) for v in zip(*(box(x, i) for i in cells), strict=True))
        for q in leaves(x0, everyone):
            low, high = box(x0, q)
            least = np.maximum(0.0, np.maximum(lows - high[None], low[None] - highs)).sum(1)
            order = np.argsort(least, kind="stable")
            first = np.concatenate([cells[j] for j in order[: 2 + 2 * k // leaf]])
            d = sums(x, first, x0, q)
            d[asked[q][:, None] == names[first][None]] = np.inf
            most = np.partition(d, k - 1, axis=1)[:, k - 1].max() if len(first) > k else np.inf
            own_of = np.concatenate([cells[j] for j in order[: max(1, int((least <= most + 1e-9).sum()))]])
            step = max(1, 500_000 // len(own_of))
            for s in range(0, len(q), step):
                yield q[s : s + step], own_of

    def nearest(names, of_class, x, asked, x0):
        """Places of reference rows and of their nearest, with differences by column, the nearest first."""
        place = np.empty(len(names), int)
        place[np.argsort(names, kind="stable")] = np.arange(len(names))
        for c in np.unique(of_class):
            for refs_of, own in compared(x, np.nonzero(of_class == c)[0], x0, asked, names):
                d = sums(x, own, x0, refs_of)
                d[asked[refs_of][:, None] == names[own][None]] = np.inf
                most = np.partition(d, k - 1, axis=1)[:, k - 1] if len(own) > k else np.full(len(d), np.finfo(float).max)
                q, i = np.nonzero((d <= most[:, None]) & (d < np.inf))
                order = np.lexsort((place[own[i]], d[q, i], q))
                q, i = q[order], own[i[order]]
                first = np.r_[0, np.cumsum(np.bincount(q, minlength=len(d)))[:-1]]
                kept = np.arange(len(q)) - first[q] < k
                q, i = refs_of[q[kept]], i[kept]
                yield q, i, apart(x[i], x0[q])

    return vectors, lists, nearest


def _sums_of_few(rows: DataFrame, refs: DataFrame, k: int) -> DataFrame:
    """c0, cls, s: differences by column of the k nearest of each class to reference rows that every task is given.

    A task reads its rows in parts, of which each keeps its own k nearest, and only these meet.
    """
    vectors, lists, nearest = _search(k)
    part = RELIEF_PART
    kinds = dict(rows.dtypes)
    given = refs.toArrow()
    k0, c0, x0 = (given.column(i).combine_chunks() for i in range(3))
    asked, at = k0.to_numpy(zero_copy_only=False), vectors(x0)

    def near(held):
        t = pa.Table.from_batches(held)
        keys, classes, x = (t.column(i).combine_chunks() for i in range(3))
        codes = classes.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        for q, i, far in nearest(keys.to_numpy(zero_copy_only=False), codes, vectors(x), asked, at):
            yield pa.RecordBatch.from_arrays([k0.take(pa.array(q)), c0.take(pa.array(q)), keys.take(pa.array(i)), classes.take(pa.array(i)), lists(far)], ["k0", "c0", "key", "cls", "d"])

    def run(it):
        held, n = [], 0
        for batch in it:
            held.append(batch)
            n += batch.num_rows
            if n >= part:
                yield from near(held)
                held, n = [], 0
        if n:
            yield from near(held)

    found = rows.mapInArrow(run, f"k0 {kinds['key']}, c0 {kinds['cls']}, key {kinds['key']}, cls {kinds['cls']}, d array<double>")
    return _first_of(found, k).select("c0", "cls", F.col("d").alias("s"))


def _first_of(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each reference row and class; ties to the lesser key."""
    order = Window.partitionBy("k0", "cls").orderBy(F.aggregate("d", F.lit(0.0), lambda s, x: s + x), "key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _laid_out(sample: np.ndarray, cells: int, first: int) -> tuple[tuple, int]:
    """A tree of cells, numbered from `first`, that parts a sample evenly; the number after the last.

    A node is its bounds and either its number or a column, a cut and the nodes below and from it.
    """
    at = first

    def node(v, n, low, high):
        nonlocal at
        wide = np.ptp(v, axis=0) if len(v) else np.zeros(v.shape[1])
        c = int(np.argmax(wide))
        if n > 1 and wide[c] > 0:
            values = np.sort(v[:, c])
            # the gap next to the place of the cut
            edges = np.nonzero(np.diff(values) > 0)[0]
            e = edges[np.argmin(np.abs(edges + 1 - len(values) * (n // 2) / n))]
            cut = float((values[e] + values[e + 1]) / 2)
            if values[e] < cut:
                below, above = high.copy(), low.copy()
                below[c] = above[c] = cut
                side = v[:, c] < cut
                return low, high, c, cut, node(v[side], n // 2, low, below), node(v[~side], n - n // 2, above, high)
        at += 1
        return low, high, at - 1

    d = sample.shape[1]
    return node(sample, cells, np.full(d, -np.inf), np.full(d, np.inf)), at


#: Where rows lie in a column in which they have no value: beyond all others.
_NOWHERE = 2.0


def _sums_by_cells(rows: DataFrame, refs: DataFrame | None, k: int) -> DataFrame:
    """c0, cls, s: differences by column of the k nearest of each class to reference rows, all rows for None.

    Each class has its own cells, laid out by a sample, which changes the work, never
    the result. A reference row meets the cell in which it lies; if one beside it may
    hold nearer rows, it meets all that may, and the nearest of these are ranked. Of
    equal rows of a class only the k + 1 of least keys can be near to any, and the
    others of them ask the same, so that one asks for all. What the workers need is
    defined in functions, so that it travels with the task.
    """
    from ..lineage import cut

    vectors, lists, nearest = _search(k)
    kinds = dict(rows.dtypes)
    key, cls = kinds["key"], kinds["cls"]
    same = Window.partitionBy("cls", "x").orderBy("key")
    kept = cut(rows.withColumn("rank", F.dense_rank().over(same)).where(F.col("rank") <= k + 1).drop("rank"))
    if refs is None:
        one = lambda t, n: t.select("key", "cls", "x", F.lit(n).alias("w"))
        rest = one(rows, 1.0).unionAll(one(kept, -1.0)).groupBy("cls", "x").agg(F.max("key").alias("key"), F.sum("w").alias("w")).where("w > 0")
        refs = one(kept, 1.0).unionByName(rest).select(F.col("key").alias("k0"), F.col("cls").alias("c0"), F.col("x").alias("x0"), "w")
    else:
        refs = refs.withColumn("w", F.lit(1.0))
    refs = cut(refs.withColumn("h", F.xxhash64("k0")))

    counts = kept.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).orderBy("cls").toArrow()
    classes, sizes = counts.column(0).combine_chunks(), counts.column(1).to_pylist()
    wanted = [-(-n // RELIEF_CELL) for n in sizes]
    every = max(1, sum(sizes) // min(RELIEF_SAMPLES, RELIEF_SAMPLE * sum(wanted)))
    sample = kept.where(F.pmod(F.xxhash64(F.lit(1), "key"), F.lit(every)) == 0).select("cls", "x").toArrow()
    code_of = lambda c: pc.index_in(c, value_set=classes).to_numpy(zero_copy_only=False).astype(int)
    known = lambda x: np.where(np.isnan(x), _NOWHERE, x)
    points, codes = known(vectors(sample.column(1).combine_chunks())), code_of(sample.column(0).combine_chunks())
    width = len(kept.select("x").first()[0])
    trees, cells = [], 0
    for c, n in enumerate(wanted):
        own = points[codes == c] if n > 1 else np.zeros((0, width))
        tree, cells = _laid_out(own, n, cells)
        trees.append(tree)
    class_of = np.empty(cells, int)

    def number(node, c):
        if len(node) == 3:
            class_of[node[2]] = c
        else:
            number(node[4], c)
            number(node[5], c)

    for c, tree in enumerate(trees):
        number(tree, c)
    nowhere = _NOWHERE

    def placed(x, c):
        """The cell of a class in which each row lies."""
        out, todo = np.empty(len(x), int), [(trees[c], np.arange(len(x)))]
        while todo:
            node, i = todo.pop()
            if len(node) == 3:
                out[i] = node[2]
            elif len(i):
                side = x[i, node[2]] < node[3]
                todo += [(node[4], i[side]), (node[5], i[~side])]
        return out

    def reached(x, c, bounds):
        """Rows and the cells of a class that may hold a row within their bounds."""
        at, found, todo = [], [], [(trees[c], np.arange(len(x)))]
        while todo:
            node, i = todo.pop()
            low, high = node[0][None], node[1][None]
            gap = np.maximum(0.0, np.maximum(low - x[i], x[i] - high))
            gap = np.where(low > 1.0, 0.5, np.where(high >= nowhere, np.minimum(gap, 0.5), gap))
            i = i[np.where(x[i] == nowhere, 0.5, gap).sum(1) <= bounds[i] + 1e-9]
            if not len(i):
                continue
            if len(node) == 3:
                at.append(i)
                found.append(np.full(len(i), node[2]))
            else:
                todo += [(node[4], i), (node[5], i)]
        return np.concatenate([np.zeros(0, int), *at]), np.concatenate([np.zeros(0, int), *found])

    def counted(it):
        n = np.zeros(cells, int)
        for batch in it:
            x = known(vectors(batch.column(0)))
            for c in range(len(trees)):
                n += np.bincount(placed(x, c), minlength=cells)
        yield pa.RecordBatch.from_arrays([pa.array(np.nonzero(n)[0], pa.int32()), pa.array(n[n > 0])], ["cell", "n"])

    def blocks_of(asked):
        """The number of blocks into which the reference rows of each cell are dealt."""
        out = np.zeros(cells, int)
        for r in asked.collect():
            out[r["cell"]] = -(-r["n"] // RELIEF_BLOCK)
        return out

    def dealt(blocks):
        """Rows go to each block of their cell's reference rows."""

        def run(it):
            for batch in it:
                keys, own, x = (batch.column(i) for i in range(3))
                v, codes = known(vectors(x)), code_of(own)
                at = np.empty(len(v), int)
                for c in np.unique(codes):
                    i = np.nonzero(codes == c)[0]
                    at[i] = placed(v[i], c)
                for s in range(blocks[at].max(initial=0)):
                    i = np.nonzero(blocks[at] > s)[0]
                    yield pa.RecordBatch.from_arrays([pa.array(at[i], pa.int32()), pa.array(np.full(len(i), s), pa.int32()), keys.take(pa.array(i)), x.take(pa.array(i))], ["cell", "block", "key", "x"])

        return kept.select("key", "cls", "x").mapInArrow(run, f"cell int, block int, key {key}, x array<double>")

    def met(asked, blocks, run, schema):
        spread = int(max(1, min(4096, blocks.sum())))
        by = ("cell", "block")
        return asked.repartition(spread, *by).groupBy(*by).cogroup(dealt(blocks).repartition(spread, *by).groupBy(*by)).applyInArrow(run, schema)

    def sides(asked, own):
        col = lambda t, name: t.column(name).combine_chunks()
        keys, x0 = col(own, "key"), vectors(col(asked, "x0"))
        x = vectors(col(own, "x")) if own.num_rows else np.zeros((0, width))
        found = list(nearest(keys.to_numpy(zero_copy_only=False), np.zeros(len(x), int), x, col(asked, "k0").to_numpy(zero_copy_only=False), x0)) if len(x) and len(x0) else []
        q, i = (np.concatenate([np.zeros(0, int), *[f[n] for f in found]]) for n in (0, 1))
        return keys, x0, q, i, np.concatenate([np.zeros((0, width)), *[f[2] for f in found]])

    def at_home(it):
        for batch in it:
            v, h = known(vectors(batch.column(2))), batch.column(4).to_numpy(zero_copy_only=False).astype(np.uint64)
            for c in range(len(trees)):
                at = placed(v, c)
                block = (h % homes[at].astype(np.uint64)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(block), *[batch.column(i) for i in range(4)]], ["cell", "block", "k0", "c0", "x0", "w"])

    def first(asked, own):
        """Sums of the reference rows that are done; the others with the cells that they reach."""
        if not asked.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(out, [asked.schema.field("k0").type, classes.type, pa.list_(pa.float64()), pa.float64(), classes.type, pa.list_(pa.int32()), pa.list_(pa.float64())], strict=True)})
        _, x0, q, _, far = sides(asked, own)
        total = np.zeros(len(q))
        for v in range(width):
            total += far[:, v]
        bounds = np.zeros(len(x0))
        np.maximum.at(bounds, q, total)
        bounds[np.bincount(q, minlength=len(x0)) < k] = np.inf
        c = int(class_of[asked.column("cell")[0].as_py()])
        at, to = reached(known(x0), c, bounds)
        order = np.argsort(at, kind="stable")
        at, to = at[order], to[order]
        n = np.bincount(at, minlength=len(x0))
        done = n <= 1
        w = asked.column("w").to_numpy()
        coded = asked.column("c0").combine_chunks().dictionary_encode()
        of = coded.indices.to_numpy(zero_copy_only=False)
        s = np.zeros((len(coded.dictionary), width))
        np.add.at(s, of[q[done[q]]], far[done[q]] * w[q[done[q]]][:, None])
        left = pa.array(np.nonzero(~done)[0])
        ends = np.r_[0, np.cumsum(n[~done])]
        col = lambda name: pa.concat_arrays([asked.column(name).combine_chunks().take(left), pa.nulls(len(s), asked.schema.field(name).type)])
        reach = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(to[~done[at]], pa.int32()))
        parts = [
            col("k0"), pa.concat_arrays([asked.column("c0").combine_chunks().take(left), coded.dictionary]), col("x0"), col("w"), classes.take(pa.array(np.full(len(left) + len(s), c))),
            pa.concat_arrays([reach, pa.nulls(len(s), reach.type)]), pa.concat_arrays([pa.nulls(len(left), lists(s).type), lists(s)]),
        ]
        return pa.table(dict(zip(out, parts, strict=True)))

    def second(asked, own):
        keys, _, q, i, far = sides(asked, own)
        got = [asked.column(n).combine_chunks().take(pa.array(q)) for n in ("k0", "c0", "cls", "w")]
        return pa.table(dict(zip(("k0", "c0", "cls", "w", "key", "d"), [*got, keys.take(pa.array(i)), lists(far)], strict=True)))

    out = ("k0", "c0", "x0", "w", "cls", "cells", "s")
    homes = blocks_of(refs.select("x0").mapInArrow(counted, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")))
    home = refs.mapInArrow(at_home, f"cell int, block int, k0 {key}, c0 {cls}, x0 array<double>, w double")
    gone = cut(met(home, homes, first, f"k0 {key}, c0 {cls}, x0 array<double>, w double, cls {cls}, cells array<int>, s array<double>"))
    sums = gone.where("s IS NOT NULL").select("c0", "cls", "s")
    further = gone.where("cells IS NOT NULL").select(F.explode("cells").alias("cell"), "k0", "c0", "x0", "w", "cls")
    blocks = blocks_of(further.groupBy("cell").agg(F.count(F.lit(1)).alias("n")))
    if not blocks.any():
        return sums
    listed = rows.sparkSession.createDataFrame([(int(c), int(blocks[c])) for c in np.nonzero(blocks)[0]], "cell int, _blocks int")
    further = further.join(F.broadcast(listed), "cell").withColumn("block", F.pmod(F.xxhash64("k0"), F.col("_blocks")).cast("int")).drop("_blocks")
    found = met(further, blocks, second, f"k0 {key}, c0 {cls}, cls {cls}, w double, key {key}, d array<double>")
    return sums.unionByName(_first_of(found, k).select("c0", "cls", F.transform("d", lambda x: x * F.col("w")).alias("s")))


def best_on_the_fly(items: DataFrame, score: str, name: str, seed: int = 0) -> DataFrame:
    """The row of greatest score in one pass; ties by a repeatable draw."""
    return items.groupBy().agg(F.max_by(F.struct(*items.columns), F.struct(score, F.xxhash64(F.lit(seed), name), name)).alias("b")).where("b IS NOT NULL").select("b.*")


def best_binarization(df: DataFrame, column: str, cls: str, measure: str = "gain") -> tuple[float, list[str], list[str]]:
    """The best way of parting a column's values in two: score and both sides, from its table of counts."""
    from .trees import _groupings, _score

    counts: dict[str, dict[str, float]] = {}
    for r in domain_contingency(df, [column], cls).collect():
        counts.setdefault(r["value"], {})[r["class"]] = r["w"]
    best: tuple[float, list[str], list[str]] = (0.0, sorted(counts), [])
    for group in _groupings(sorted(counts), "binary") if len(counts) > 1 else ():
        table = {k: {c: sum(counts[v].get(c, 0.0) for v in own) for c in {c for v in own for c in counts[v]}} for k, own in group.items()}
        score = _score(table, measure)
        if score > best[0] + 1e-12:
            left, right = group.values()
            best = score, sorted(left), sorted(right)
    return best

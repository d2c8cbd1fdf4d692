"""Distances between rows as arrays, nearest neighbours, matrices (i, j, d), outliers."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType
from pyspark.sql.window import Window

#: Rows that may stand on the broadcast side of all pairs.
MOST_BROADCAST = 20_000
#: Queries of a block that is broadcast.
BLOCK_QUERIES = MOST_BROADCAST // 2


def vector(columns: list[str], stats: dict[str, dict[str, float]] | None = None) -> Column:
    """The columns as an array, scaled to their ranges if these are given."""
    return F.array(*[((F.col(c) - stats[c]["min"]) / ((stats[c]["max"] - stats[c]["min"]) or 1.0) if stats else F.col(c)).cast("double") for c in columns])


def _fold(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def distance(a: Column, b: Column, how: str = "euclidean", p: float = 2.0, unknown: float = 0.5) -> Column:
    """Of two arrays; a difference with a missing side counts as `unknown`."""
    d = F.zip_with(a, b, lambda x, y: F.coalesce(F.abs(x - y), F.lit(unknown)))
    if how == "manhattan":
        return _fold(d)
    if how == "euclidean":
        return F.sqrt(_fold(F.transform(d, lambda v: v * v)))
    if how == "maximal":
        return F.array_max(d)
    if how == "lp":
        return F.pow(_fold(F.transform(d, lambda v: F.pow(v, F.lit(p)))), F.lit(1 / p))
    if how == "relief":
        return _fold(F.transform(d, lambda v: F.least(v, F.lit(1.0))))
    if how == "hamming":
        return _fold(F.zip_with(a, b, lambda x, y: F.when(x.eqNullSafe(y), 0.0).otherwise(1.0)))
    if how == "spearman":
        rank = lambda v: F.transform(v, lambda x: F.size(F.filter(v, lambda y: y < x)) + (F.size(F.filter(v, lambda y: y == x)) + 1) / 2)
        return distance(rank(a), rank(b), "pearson")
    if how == "pearson":
        n = F.size(a)
        ma, mb = _fold(a) / n, _fold(b) / n
        sxy = _fold(F.zip_with(a, b, lambda x, y: x * y)) - n * ma * mb
        sxx = _fold(F.transform(a, lambda x: x * x)) - n * ma * ma
        syy = _fold(F.transform(b, lambda x: x * x)) - n * mb * mb
        return (1 - sxy / F.sqrt(sxx * syy)) / 2
    raise ValueError(how)


def kernel(a: Column, b: Column, how: str = "linear", gamma: float = 1.0, degree: float = 3.0, c: float = 0.0) -> Column:
    dot = _fold(F.zip_with(a, b, lambda x, y: x * y))
    if how == "linear":
        return dot
    if how == "polynomial":
        return F.pow(dot + c, F.lit(degree))
    return F.exp(-gamma * _fold(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def matrix(df: DataFrame, key: str, x: str, how: str = "euclidean", within: tuple[float, float] | None = None, **options) -> DataFrame:
    """i, j, d of all pairs with i > j, of any number of rows; `within`: only pairs whose distance lies between two bounds.

    Rows are dealt into blocks by a hash of their key, and every two blocks meet in
    one task, which holds no more than these. Arrays of numbers are compared in Arrow
    batches, others by expressions.
    """
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("i"), F.col(x).alias("_a"))
    element = df.select(F.get(F.col(x), 0).alias("e")).schema["e"].dataType
    if how in ALL_NUMERIC and isinstance(element, NumericType) and set(options) <= {"unknown", "p"}:
        return _matrix_in_blocks(rows, how, within, options.get("p", 2.0), options.get("unknown", 0.5))
    other = rows.select(F.col("i").alias("j"), F.col("_a").alias("_b"))
    small = rows.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    m = rows.join(F.broadcast(other) if small else other.hint("shuffle_replicate_nl"), F.col("i") > F.col("j")).select("i", "j", distance(F.col("_a"), F.col("_b"), how, **options).alias("d"))
    return m if within is None else m.where(F.col("d").between(*within))


#: Distances of arrays of numbers that are worked out in Arrow batches.
ALL_NUMERIC = ("euclidean", "manhattan", "maximal", "lp", "relief", "hamming", "pearson", "spearman")
#: Rows of a block, at least and at most.
BLOCK_ROWS = (250, 2_000)


def blocks(rows: DataFrame, key: str) -> tuple[DataFrame, int]:
    """Rows packed into blocks of like size (_block, rows), and the number of blocks."""
    total = rows.count()
    n = max(1, -(-total // min(max(total // 64, BLOCK_ROWS[0]), BLOCK_ROWS[1])))
    return rows.groupBy(F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("_block")).agg(F.collect_list(F.struct(*rows.columns)).alias("rows")), n


def parts_of_pairs(spark, pairs: int) -> int:
    """Tasks for pairs of blocks: several for each core, and few pairs in each."""
    return max(1, min(pairs, max(4 * spark.sparkContext.defaultParallelism, pairs // 8)))


def _matrix_in_blocks(rows: DataFrame, how: str, within: tuple[float, float] | None, p: float, unknown: float) -> DataFrame:
    """The matrix of arrays of numbers. What the workers need is defined in here, so that it travels with the task."""
    kind = rows.schema["i"].dataType.simpleString()
    packed, n = blocks(rows.withColumn("_a", F.col("_a").cast("array<double>")), "i")
    spread = parts_of_pairs(rows.sparkSession, n * (n + 1) // 2)
    one = packed.select(F.col("_block").alias("_p"), F.explode(F.sequence(F.lit(0), F.col("_block"))).alias("_q"), F.col("rows").alias("_one"))
    two = packed.select(F.explode(F.sequence(F.col("_block"), F.lit(n - 1))).alias("_p"), F.col("_block").alias("_q"), F.col("rows").alias("_two"))
    met = one.repartition(spread, "_p", "_q").join(two.repartition(spread, "_p", "_q"), ["_p", "_q"]).select((F.col("_p") == F.col("_q")).alias("_same"), "_one", "_two")
    batch_rows = 1 << 16

    def block_of(side: pa.ListArray, k: int) -> pa.StructArray:
        start, end = side.offsets[k].as_py(), side.offsets[k + 1].as_py()
        return side.values.slice(start, end - start)

    def unpacked(block: pa.StructArray):
        """Keys, and of their arrays: values, what is missing or beyond the end, sizes (-1: no array)."""
        keys, lists = block.field(0), block.field(1)
        held = np.asarray(lists.is_valid().to_numpy(zero_copy_only=False), bool)
        sizes = np.where(held, np.diff(lists.offsets.to_numpy()), 0)
        flat = lists.flatten()
        width = int(sizes.max()) if len(sizes) else 0
        there = np.arange(width)[None] < sizes[:, None]
        values, gone = np.zeros(there.shape), ~there
        values[there] = flat.fill_null(0.0).to_numpy(zero_copy_only=False)
        gone[there] = flat.is_null().to_numpy(zero_copy_only=False)
        return keys.to_numpy(zero_copy_only=False), values, gone, np.where(held, sizes, -1)

    def widened(side, width: int):
        keys, values, gone, sizes = side
        more = ((0, 0), (0, width - values.shape[1]))
        return keys, np.pad(values, more), np.pad(gone, more, constant_values=True), sizes

    def ranks(values, gone):
        """Ranks within each row, means of those of equal values; 0.5 for what is missing."""
        codes = np.unique(values, return_inverse=True)[1].reshape(values.shape)
        known = ~gone
        out = np.empty(values.shape)
        for c in range(values.shape[1]):
            x = codes[:, c : c + 1]
            out[:, c] = np.where(known[:, c], ((codes < x) & known).sum(1) + (((codes == x) & known).sum(1) + 1) / 2, 0.5)
        return out

    def directions(side):
        """Rows less their mean, of length 1: the dot product of two is Pearson's r."""
        keys, values, gone, sizes = side
        beyond = np.arange(values.shape[1])[None] >= sizes[:, None]
        if how == "spearman":
            values, gone = ranks(values, gone), beyond
        size = sizes[:, None].astype(float)
        x = np.where(beyond, 0.0, values - np.where(beyond, 0.0, values).sum(1, keepdims=True) / size)
        x = x / np.sqrt((x * x).sum(1, keepdims=True))
        return x, (sizes < 0) | (gone & ~beyond).any(1)

    def far(a, b):
        """Distances of all pairs, and which of them are unknown."""
        x, gx, nx = a
        y, gy, ny = b
        no = (nx < 0)[:, None] | (ny < 0)[None]
        total = np.zeros((len(x), len(y)))
        last = np.maximum(nx[:, None], ny[None])
        holes = gx.any() or gy.any()
        for c in range(x.shape[1]):
            u, v = x[:, c][:, None], y[:, c][None]
            if how == "hamming":
                d = ((u != v) & ~(np.isnan(u) & np.isnan(v))).astype(float)
            else:
                d = np.abs(u - v)
            if holes:
                m, o = gx[:, c][:, None], gy[:, c][None]
                d = np.where(m | o, (m != o).astype(float) if how == "hamming" else unknown, d)
                d = np.where(c < last, d, 0.0)
            total = np.maximum(total, d) if how == "maximal" else total + (d * d if how == "euclidean" else d**p if how == "lp" else np.minimum(d, 1.0) if how == "relief" else d)
        if how == "maximal":
            no = no | (last == 0)
        return (np.sqrt(total) if how == "euclidean" else total ** (1 / p) if how == "lp" else total), no

    def by_key(side):
        order = np.argsort(side[0], kind="stable")
        return tuple(v[order] for v in side)

    def pairs(same: bool, one, two):
        """Row by row of the greater keys, each with the lesser keys in order."""
        width = max(one[1].shape[1], two[1].shape[1])
        one, two = by_key(widened(one, width)), by_key(widened(two, width))
        correlated = how in ("pearson", "spearman")
        ways = [(one, two)] if same else [(one, two), (two, one)]
        turned = {id(side[0]): directions(side) for side in (one, two)} if correlated else {}
        for up, low in ways:
            step = max(1, batch_rows // max(1, len(low[0])))
            for s in range(0, len(up[0]), step):
                e = slice(s, s + step)
                n = int(np.searchsorted(low[0], up[0][e][-1], side="left"))  # keys below the greatest of these rows
                if not n:
                    continue
                if correlated:
                    (x, nx), (y, ny) = turned[id(up[0])], turned[id(low[0])]
                    d = np.clip((1 - x[e] @ y[:n].T) / 2, 0.0, 1.0)
                    no = nx[e][:, None] | ny[None, :n] | (up[3][e][:, None] != low[3][None, :n])
                else:
                    d, no = far(tuple(v[e] for v in up[1:]), tuple(v[:n] for v in low[1:]))
                use = np.asarray(up[0][e][:, None] > low[0][None, :n], bool)
                if within is not None:
                    use = use & (d >= within[0]) & (d <= within[1]) & ~no
                r, c = np.nonzero(use)
                yield up[0][e][r], low[0][c], d[r, c], no[r, c]

    def run(it):
        with np.errstate(all="ignore"):
            for batch in it:
                ones, twos = batch.column(1), batch.column(2)
                of_key = ones.type.value_type.field(0).type
                for k in range(batch.num_rows):
                    one, two = (unpacked(block_of(side, k)) for side in (ones, twos))
                    for i, j, d, no in pairs(batch.column(0)[k].as_py(), one, two):
                        yield pa.RecordBatch.from_arrays([pa.array(i, of_key), pa.array(j, of_key), pa.array(d, pa.float64(), mask=no)], ["i", "j", "d"])

    return met.mapInArrow(run, f"i {kind}, j {kind}, d double")


def symmetric(m: DataFrame) -> DataFrame:
    return m.select("i", "j", "d").unionByName(m.where("i != j").select(F.col("j").alias("i"), F.col("i").alias("j"), "d"))


def transform_matrix(m: DataFrame, how: str) -> DataFrame:
    """negate, one_minus, max_minus, invert, bounds (to 0..1) or sigmoid."""
    d = F.col("d")
    if how in ("max_minus", "bounds"):
        m = m.join(F.broadcast(m.agg(F.min("d").alias("_a"), F.max("d").alias("_b"))))
    out = {"negate": lambda: -d, "one_minus": lambda: 1 - d, "max_minus": lambda: F.col("_b") - d, "invert": lambda: 1 / d, "bounds": lambda: (d - F.col("_a")) / (F.col("_b") - F.col("_a")), "sigmoid": lambda: 1 / (1 + F.exp(-d))}[how]()
    return m.select("i", "j", out.alias("d"))


def sub_matrix(m: DataFrame, items: DataFrame) -> DataFrame:
    """Only pairs of the given items (column `item`)."""
    return m.join(items.select(F.col("item").alias("i")), "i", "left_semi").join(items.select(F.col("item").alias("j")), "j", "left_semi").select("i", "j", "d")


def nearest(df: DataFrame, queries: DataFrame, key: str, x: str, k: int, how: str = "euclidean", include_same: bool = True, **options) -> DataFrame:
    """query, rank, neighbour, d: the k nearest rows of each query, ties to the least key; k = 0: all.

    Queries are broadcast; more of them than may be are walked in blocks by a hash
    of their key. Before neighbours meet, every partition keeps its own k best.
    """
    blocks = -(-queries.count() // BLOCK_QUERIES)
    if blocks > 1:
        # blocks are of half the size that may be broadcast, as hashes don't deal evenly
        block = F.pmod(F.xxhash64(key), F.lit(blocks))
        return reduce(DataFrame.unionByName, [_nearest(df, queries.where(block == b), key, x, k, how, include_same, **options) for b in range(blocks)])
    return _nearest(df, queries, key, x, k, how, include_same, **options)


def _nearest(df: DataFrame, queries: DataFrame, key: str, x: str, k: int, how: str, include_same: bool, **options) -> DataFrame:
    """The same for queries that may be broadcast."""
    if k > 0 and how in NORMS and set(options) <= {"unknown"}:
        found = _nearest_in_batches(df, queries, key, x, k, how, include_same, options.get("unknown", 0.5))
        best = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("d", "neighbour")))
        return best.where(F.col("rank") <= k).select("query", "rank", "neighbour", "d")
    q = queries.select(F.col(key).alias("query"), F.col(x).alias("_q"))
    pairs = df.select(F.col(key).alias("neighbour"), F.col(x).alias("_x")).join(F.broadcast(q), F.col("neighbour") != F.col("query")).select("query", "neighbour", distance(F.col("_x"), F.col("_q"), how, **options).alias("d"))
    if not include_same:
        pairs = pairs.where("d > 0")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("d", "neighbour"))
    if k > 0:
        local = Window.partitionBy("_part", "query").orderBy("d", "neighbour")
        pairs = pairs.withColumn("_part", F.pmod(F.xxhash64("neighbour"), F.lit(32))).withColumn("_r", F.row_number().over(local)).where(F.col("_r") <= k).drop("_part", "_r")
    out = pairs.withColumn("rank", rank)
    return (out.where(F.col("rank") <= k) if k > 0 else out).select("query", "rank", "neighbour", "d")


#: Distances that are worked out in Arrow batches, from the absolute differences.
NORMS = ("euclidean", "manhattan", "maximal")


def _nearest_in_batches(df: DataFrame, queries: DataFrame, key: str, x: str, k: int, how: str, include_same: bool, unknown: float) -> DataFrame:
    """query, neighbour, d: of each batch of rows the k nearest to each query; rows without an array take no part.

    What the workers need is defined in here, so that it travels with the task.
    """
    norm = {"euclidean": lambda d: np.sqrt((d * d).sum(1)), "manhattan": lambda d: d.sum(1), "maximal": lambda d: d.max(1)}[how]

    def as_matrix(lists: list, width: int = 0) -> np.ndarray:
        """A matrix; what is missing, or beyond a shorter row's end, is NaN."""
        out = np.full((len(lists), max([width, *map(len, lists)])), np.nan)
        for i, v in enumerate(lists):
            out[i, : len(v)] = np.array(v, float)
        return out

    asked = queries.where(F.col(x).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("q"), F.col(x).cast("array<double>").alias("v")).toArrow()
    held = df.sparkSession.sparkContext.broadcast((asked.column(0).to_pylist(), asked.column(1).combine_chunks()))
    kind = df.schema[key].dataType.simpleString()

    def regular(lists) -> np.ndarray | None:
        """The arrays as a matrix, if all have one length and finite places of moderate size."""
        sizes = np.diff(lists.offsets.to_numpy())
        if not len(sizes) or sizes[0] == 0 or (sizes != sizes[0]).any() or lists.flatten().null_count:
            return None
        m = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(sizes), -1)
        return m if np.abs(m).max() < 1e15 else None

    def by_products(ids, asked, own, rows, place, k):
        """The k nearest by straight lines: products of single precision leave few rows, with room for their error; of these the distances are worked out."""
        names = np.array(own)
        ids = np.array(ids)
        x, q = rows.astype(np.float32), asked.astype(np.float32)
        xx, qq = (rows * rows).sum(1), (asked * asked).sum(1)
        room = (rows.shape[1] + 16) * 2.0**-22 * (xx.max() + qq)
        step = max(1, 4_000_000 // len(rows))
        for s in range(0, len(ids), step):
            e = slice(s, s + step)
            near = (qq[e, None] + xx[None]).astype(np.float32) - 2 * (q[e] @ x.T)
            if len(rows) > k + 1:
                most = np.partition(near, k, axis=1)[:, k] + 2 * room[e]
                r, c = np.nonzero(near <= most[:, None])
            else:
                r, c = (v.ravel() for v in np.indices(near.shape))
            other = names[c] != ids[e][r]
            r, c = r[other], c[other]
            d = np.empty(len(r))
            for t in range(0, len(r), 100_000):
                far = np.abs(rows[c[t : t + 100_000]] - asked[e][r[t : t + 100_000]])
                d[t : t + 100_000] = np.sqrt((far * far).sum(1))
            order = np.lexsort((place[c], d, r))
            r, c, d = r[order], c[order], d[order]
            first = np.r_[0, np.cumsum(np.bincount(r, minlength=len(near)))[:-1]]
            kept = np.arange(len(r)) - first[r] < k
            yield ids[e][r[kept]], names[c[kept]], d[kept]

    def run(it):
        ids, lists = held.value
        known = regular(lists) if how == "euclidean" and include_same else None
        points = lists.to_pylist() if known is None else None
        longest = max(map(len, points), default=0) if known is None else 0
        for batch in it:
            own = batch.column(0).to_pylist()
            rows = regular(batch.column(1)) if known is not None else None
            if rows is not None and rows.shape[1] == known.shape[1]:
                place = np.empty(len(own), int)
                place[np.argsort(np.array(own), kind="stable")] = np.arange(len(own))
                for q, n, d in by_products(ids, known, own, rows, place, k):
                    yield pa.RecordBatch.from_arrays([pa.array(q.tolist(), batch.column(0).type), pa.array(n.tolist(), batch.column(0).type), pa.array(d, pa.float64())], ["query", "neighbour", "d"])
                continue
            if points is None:
                points = lists.to_pylist()
                longest = max(map(len, points), default=0)
            table = as_matrix(batch.column(1).to_pylist(), longest)
            sizes = np.array([len(v) for v in batch.column(1).to_pylist()], int)
            order = np.argsort(np.array(own), kind="stable")  # so that ties go to the least key
            place = np.empty(len(own), int)
            place[order] = np.arange(len(own))
            found: tuple[list, list, list] = ([], [], [])
            for q, v in zip(ids, points, strict=True):
                wide = np.full(table.shape[1], np.nan)
                wide[: len(v)] = np.array(v, float)
                far = np.abs(table - wide)
                if np.isnan(far).any():  # places beyond both ends count nothing
                    beyond = np.arange(table.shape[1])[None] >= np.maximum(sizes, len(v))[:, None]
                    far = np.where(np.isnan(far), np.where(beyond, 0.0, unknown), far)
                d = norm(far)
                near = np.lexsort((place, d))[: k + 1]
                kept = [i for i in near.tolist() if own[i] != q and (include_same or d[i] > 0)]
                if not include_same and len(kept) < k:
                    kept = [i for i in np.lexsort((place, d)).tolist() if own[i] != q and d[i] > 0]
                for i in kept[:k]:
                    found[0].append(q)
                    found[1].append(own[i])
                    found[2].append(float(d[i]))
            yield pa.RecordBatch.from_arrays([pa.array(found[0], batch.column(0).type), pa.array(found[1], batch.column(0).type), pa.array(found[2], pa.float64())], ["query", "neighbour", "d"])

    rows = df.where(F.col(x).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("n"), F.col(x).cast("array<double>").alias("v"))
    # a small file is one task: rows are dealt over all cores
    rows = rows.repartition(df.sparkSession.sparkContext.defaultParallelism, "n") if rows.rdd.getNumPartitions() < df.sparkSession.sparkContext.defaultParallelism else rows
    return rows.mapInArrow(run, f"query {kind}, neighbour {kind}, d double")


def outliers(m: DataFrame, k: int = 0) -> DataFrame:
    """item, z: mean distance to the k nearest (0: all) others, standardised."""
    s = symmetric(m)
    if k:
        s = s.withColumn("_r", F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))).where(F.col("_r") <= k)
    mean = s.groupBy(F.col("i").alias("item")).agg(F.avg("d").alias("mean"))
    return mean.join(F.broadcast(mean.agg(F.avg("mean").alias("_m"), F.stddev_pop("mean").alias("_s")))).select("item", ((F.col("mean") - F.col("_m")) / F.col("_s")).alias("z"))


def average_linkage(m: DataFrame, groups: DataFrame) -> DataFrame:
    """a, b, d: mean distance between groups (item, grp), a < b."""
    g = lambda c, n: F.broadcast(groups.select(F.col("item").alias(c), F.col("grp").alias(n)))
    t = m.join(g("i", "g1"), "i").join(g("j", "g2"), "j").where("g1 != g2")
    return t.groupBy(F.least("g1", "g2").alias("a"), F.greatest("g1", "g2").alias("b")).agg(F.avg("d").alias("d"))


def element(m: DataFrame, i, j):
    """d of a pair, whichever way round; None where there is none."""
    found = m.where((F.col("i") == F.greatest(F.lit(i), F.lit(j))) & (F.col("j") == F.least(F.lit(i), F.lit(j))) | (F.col("i") == i) & (F.col("j") == j)).select("d").limit(1).collect()
    return found[0][0] if found else None


def with_element(m: DataFrame, i, j, d: float) -> DataFrame:
    """The matrix with another value for a pair."""
    here = (F.col("i") == i) & (F.col("j") == j) | (F.col("i") == j) & (F.col("j") == i)
    return m.withColumn("d", F.when(here, F.lit(float(d))).otherwise(F.col("d")))


def flat(m: DataFrame) -> DataFrame:
    """place, d of the lower triangle, row by row."""
    from .ordered import numbered

    return numbered(m.where("i > j"), ["i", "j"], "place").select("place", "d")

"""Exact top-k inner products by norm-bucketed retrieval (after LEMP, Teflioudi et al.).

Vectors become whole numbers, floor(64 * x). Candidates are grouped by length
(a geometric grid of norms), and each group is dealt by hash into buckets. Blocks
of queries meet the few longest buckets first, which gives every query a k-th best
score, and with it the least length that a candidate must have. Queries are then
dealt anew, into blocks of like need, and only rows that are long enough for some
query of a block travel to it.

With a query's k-th best score so far, the longest norm of a bucket gives a local
cosine threshold: above 1 the bucket is skipped; if high, candidates must lie in
the ranges that the threshold leaves for the query's two largest coordinates; if
low, only rows long enough, a prefix of the bucket, are looked at. Products of
what is left are verified exactly.

Vectors that are null, or hold null or non-finite components, take no part. Only
vectors of one dimension meet. A query's own row is told by vec_id: no row with
the query's id is its answer. Queries that repeat in id and vector are answered
once; rows without an id take no part. Candidates that repeat are answers each.
Components and scores beyond 64 bits count as the greatest or least number that
64 bits hold. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..operators.ordered import numbered
from ._dist import cut, partitions

K = 20
EVERY = 20
BUCKET_ROWS = 2048
QUERY_ROWS = 16384
#: Numbers that a bucket or block holds at most, so that those of long vectors have fewer rows.
NUMBERS = 1 << 22
#: Full buckets' worth of rows that the first round meets, and buckets that a block of queries meets in one go in the second.
FIRST = 4
GROUP = 16
#: Blocks of queries whose needs may be broadcast; more of them meet the buckets by a shuffle.
MOST_BLOCKS = 1_000_000
#: Queries that are multiplied with a bucket at a time.
TILE = 256
#: Steps of the norm grid; local threshold from which coordinates prune.
GRID = 1.1
HIGH = 0.75
MOST = (1 << 63) - 1


def whole(vectors: DataFrame) -> DataFrame:
    """vec_id, v, norm of the rows that take part."""
    fine = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = F.transform("embedding", lambda x: F.floor(F.greatest(F.least(64 * x.cast("double"), F.lit(9.2e18)), F.lit(-9.2e18))).cast("long"))
    rows = vectors.where(fine & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    return rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))


class Block:
    """Queries with their best answers so far; `bars` are scores that answers must reach."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, bars: np.ndarray):
        self.ids, self.exact = ids, vectors
        self.q = vectors.astype(np.float64)
        self.norm = np.sqrt((self.q**2).sum(1))
        self.k = k
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)
        self.bar = bars.copy()  # not above the k-th best score

    def add(self, at: int, scores: np.ndarray, ids: np.ndarray) -> None:
        keep = ids != self.ids[at]
        scores, ids = np.concatenate([self.best[at][0], scores[keep]]), np.concatenate([self.best[at][1], ids[keep]])
        order = np.lexsort((ids, ~scores))[: self.k]  # ~: the least number has no negative
        self.best[at] = scores[order], ids[order]
        if len(order) == self.k:
            self.bar[at] = max(self.bar[at], below(scores[order[-1]]))

    def products(self, which: np.ndarray | int, c: np.ndarray, exact: np.ndarray, longest: float) -> np.ndarray:
        if float(np.max(self.norm[which], initial=0)) * longest < 2.0**52:
            return (self.q[which] @ c.T).astype(np.int64)  # exact: no partial sum reaches 2**53
        whole = np.asarray(self.exact[which].astype(object) @ exact.astype(object).T)
        return np.minimum(np.maximum(whole, -MOST - 1), MOST).astype(np.int64)

    def meet(self, ids: np.ndarray, exact: np.ndarray) -> None:
        """The rows of a bucket."""
        c = exact.astype(np.float64)
        norms = np.sqrt((c**2).sum(1))
        order = np.argsort(-norms, kind="stable")  # longest first
        ids, exact, c, norms = ids[order], exact[order], c[order], norms[order]
        longest = float(norms[0]) if len(norms) else 0.0
        most = self.norm * longest * (1 + 1e-9)
        open_ = np.flatnonzero(most >= self.bar)
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.where(most[open_] > 0, self.bar[open_] / most[open_], -np.inf)
        coordinate = open_[local >= HIGH]
        if len(coordinate):
            unit = c / np.maximum(norms, 1e-300)[:, None]
            for at, t in zip(coordinate.tolist(), local[local >= HIGH].tolist(), strict=True):
                u = self.q[at] / self.norm[at]
                near = np.ones(len(ids), bool)
                for f in np.argsort(-np.abs(u))[:2].tolist():
                    slack = np.sqrt(max(0.0, (1 - t * t) * (1 - u[f] * u[f]))) + 1e-7
                    # a vector with cosine t or more: its coordinate is at least so large in the query's direction
                    near &= unit[:, f] * np.sign(u[f]) >= abs(u[f]) * t - slack
                near = np.flatnonzero(near)
                if len(near):
                    s = self.products(at, c[near], exact[near], longest)
                    hit = s >= self.bar[at]
                    self.add(at, s[hit], ids[near][hit])
        length = open_[local < HIGH]
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where((self.bar[length] > 0) & (self.norm[length] > 0), self.bar[length] / self.norm[length], 0.0) * (1 - 1e-9)
        by_need = np.argsort(-need, kind="stable")  # queries of like need share a prefix of the bucket
        for a in range(0, len(by_need), TILE):
            tile = length[by_need[a : a + TILE]]
            prefix = int(np.searchsorted(-norms, -need[by_need[a : a + TILE]].min(), "right"))
            s = self.products(tile, c[:prefix], exact[:prefix], longest)
            hits = s >= self.bar[tile][:, None]
            for row in np.flatnonzero(hits.any(1)).tolist():
                self.add(int(tile[row]), s[row][hits[row]], ids[:prefix][hits[row]])


def below(score: int) -> float:
    """The score as a double that is not above it."""
    out = float(score)
    return out if abs(out) < 2.0**52 else float(np.nextafter(out, -np.inf))


def dealt(df: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """`df` with `part`, a hash of the row, so that parts of a dimension and class have about `size` rows or fewer; and the parts of each."""
    rows = F.greatest(F.least(F.lit(size), F.floor(F.lit(NUMBERS) / F.greatest("dim", F.lit(1)))), F.lit(1))
    # a row for each dimension and step of the grid, of which doubles have few thousand
    counts = cut(df.groupBy("dim", "cls").agg(F.count(F.lit(1)).alias("n"), (F.floor((F.count(F.lit(1)) - 1) / rows.cast("double")) + 1).cast("int").alias("parts")))
    return df.join(F.broadcast(counts.drop("n")), ["dim", "cls"]).withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), F.col("parts")).cast("int")).drop("parts"), counts


def _met(left: DataFrame, right: DataFrame, n: int, k: int) -> DataFrame:
    """query_id, vec_id, score from queries (kind 0) and the rows that they meet, both by dim, block and g; `ord` is a row's bucket."""
    key = ["dim", "block", "g"]
    columns = [*key, "kind", "ord", "vec_id", "v", "bar"]

    def run(it):
        block = None

        def out():
            n = [len(x[0]) for x in block.best]
            return pa.record_batch({"query_id": pa.array(np.repeat(block.ids, n)), "vec_id": pa.array(np.concatenate([x[1] for x in block.best])), "score": pa.array(np.concatenate([x[0] for x in block.best]))})

        def lots():
            """(place, ids, vectors, bars) of each block's queries and of each bucket, put together from batches."""
            now, held = None, []
            join = lambda: (now, *(np.concatenate(x) for x in zip(*held, strict=True)))
            for batch in it:
                places = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(5)], 1) if batch.num_rows else np.zeros((0, 5), np.int64)
                edge = [0, *(np.flatnonzero((places[1:] != places[:-1]).any(1)) + 1).tolist(), len(places)]
                for a, b in zip(edge, edge[1:], strict=False):
                    if a == b:
                        continue
                    place = tuple(places[a].tolist())
                    if held and place != now:
                        yield join()
                        held = []
                    now = place
                    ids, v, bars = (batch.column(c).slice(a, b - a) for c in (5, 6, 7))
                    held.append((ids.to_numpy(), v.flatten().to_numpy(zero_copy_only=False).reshape(b - a, place[0]), bars.to_numpy(zero_copy_only=False).astype(np.float64)))
            if held:
                yield join()

        mine = None
        for (*where, kind, _), ids, v, bars in lots():
            if kind == 0:
                if block:
                    yield out()
                mine, block = where, Block(ids, v, k, np.where(np.isnan(bars), -np.inf, bars))
            elif where == mine:
                block.meet(ids, v)
        if block:
            yield out()

    met = left.select(*columns).unionByName(right.select(*columns)).repartition(n, *key).sortWithinPartitions(*key, "kind", "ord")
    return met.mapInArrow(run, "query_id long, vec_id long, score long")


def search(vectors: DataFrame, k: int = K, every: int = EVERY, bucket_rows: int = BUCKET_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best answers of every row whose id is divisible by `every`."""
    n = partitions(vectors.sparkSession)
    step = float(np.log(GRID))
    grid = lambda x: F.floor(F.log(F.greatest(x, F.lit(1.0))) / step).cast("int")
    rows = cut(whole(vectors).withColumns({"dim": F.size("v"), "cls": grid(F.col("norm"))}))
    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "v", "dim", "norm").distinct()

    # the rank of a bucket, longest class first
    bucketed, classes = dealt(rows, bucket_rows)
    longer = Window.partitionBy("dim").orderBy(F.desc("cls"))
    ranks = classes.select("dim", "cls", (F.sum("parts").over(longer) - F.col("parts")).alias("_before"), F.sum("parts").over(Window.partitionBy("dim")).alias("_total"), (F.sum("n").over(longer) - F.col("n")).alias("_rows"), (F.col("n") / F.col("parts")).alias("_each"))
    ranked = bucketed.join(F.broadcast(ranks), ["dim", "cls"]).withColumn("rank", (F.col("_before") + F.col("part")).cast("int"))
    # the first round has the buckets before which there are fewer rows
    early = F.col("_rows") + F.col("part") * F.col("_each") < FIRST * bucket_rows
    groups = F.greatest(F.ceil(F.col("_total") / GROUP), F.lit(1)).cast("int")
    held = F.greatest(F.least(F.lit(query_rows), F.floor(F.lit(NUMBERS) / F.greatest("dim", F.lit(1)))), F.lit(1)).cast("int")

    def blocks(df: DataFrame, order: str, bar: Column) -> tuple[DataFrame, DataFrame]:
        """Queries with the block of their place in an order, and of each block its least need."""
        placed = numbered(df, [order, "vec_id"], "place", ["dim"]).withColumn("block", F.floor(F.col("place") / held).cast("int"))
        return placed.select("dim", "block", "vec_id", "v", bar.alias("bar"), F.lit(0).alias("kind"), F.lit(-1).alias("ord")), placed.groupBy("dim", "block").agg(F.min("need").alias("least"))

    def near(df: DataFrame, least: DataFrame) -> DataFrame:
        """Rows, once for each block that has a query which they are long enough for."""
        least = cut(least)
        if least.count() <= MOST_BLOCKS:
            least = F.broadcast(least)
        long_enough = df.join(least, "dim").where(F.col("norm") * (1 + 1e-9) >= F.col("least"))
        return long_enough.select("dim", "block", "vec_id", "v", F.lit(None).cast("double").alias("bar"), F.lit(1).alias("kind"), F.col("rank").alias("ord"), groups.alias("groups"))

    # first round: every block, the longest buckets
    left, least = blocks(queries.withColumn("need", F.lit(0.0)), "vec_id", F.lit(None).cast("double"))
    right = near(ranked.where(early), least).withColumn("g", F.lit(0))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = cut(_met(left.withColumn("g", F.lit(0)), right, n, k).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k))
    bars = found.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("_score"))

    # second round: blocks of queries with like need, the buckets that are long enough for one of them
    score = F.col("_score").cast("double")
    bar = score - F.abs(score) * 2.0**-52  # a double not above the score, wherever scores need more than 53 bits
    need = F.coalesce(F.when((F.col("_score") > 0) & (F.col("norm") > 0), bar / F.col("norm")), F.lit(0.0))
    needy = cut(queries.join(bars, "vec_id", "left").withColumns({"bar": F.when(F.col("_score").isNotNull(), F.when(F.abs(score) < 2.0**52, score).otherwise(bar)), "need": need}))
    left, least = blocks(needy, "need", F.col("bar"))
    # a row for each dimension
    spread = ranks.groupBy("dim").agg(F.max(groups).alias("groups"))
    left = left.join(F.broadcast(spread), "dim").withColumn("g", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    right = near(ranked.where(~early), least).withColumn("g", F.pmod(F.col("ord"), F.col("groups")))
    more = _met(left, right, n, k)
    return found.drop("rank").unionByName(more).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def oracle(k: int = K, every: int = EVERY) -> str:
    """DuckDB SQL for `search` over `embeddings` with unique ids."""
    return f"""
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % {every} = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {k}
"""

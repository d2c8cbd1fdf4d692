"""Balanced shards by Karmarkar-Karp differencing over groups of equal texts.

A group is indivisible, and all groups take part: each starts as a partial
partition (its weight in one shard, nothing in the others), and the two partial
partitions with the largest spread are combined, the heaviest shard of one with
the lightest of the other, until one is left.

That is done twice. Tasks difference their groups, block by block, into subsets of
near equal weight; the driver then differences the subsets of all tasks (a bounded
number a task) together with the groups that weigh much or have many rows, which
are items of their own and of which there are at most 2 * SUBSETS. Where all groups
weigh much, as in a small table, the result is that of plain differencing.

A null text weighs as an empty one and belongs to its group. Repeated rows count
each. Other columns are not read. No rows give no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ._dist import cut, dense_ranks, partitions

SHARDS = 16
#: Subsets that all tasks make, about (16 a task at least); a group with more than one part in so many of all bytes, or rows, is an item of its own.
SUBSETS = 4096
LEAST_SUBSETS = 16
#: Groups that a task differences at a time.
BLOCK = 1 << 16


def differencing(weights: list[int], shards: int) -> list[int]:
    """The shard of each item; ties go to the earlier item."""
    n = len(weights)
    heap = [(-w, i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    sums: dict[int, np.ndarray] = {}
    made: list[tuple[int, int, np.ndarray]] = []  # what was combined, and where each place of the first went

    def vector(i: int) -> np.ndarray:
        if i < n:
            out = np.zeros(shards, np.int64)
            out[-1] = weights[i]
            return out
        return sums.pop(i)

    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        both = vector(a) + vector(b)[::-1]
        order = np.argsort(both, kind="stable")
        went = np.empty(shards, np.int32)
        went[order] = np.arange(shards)
        key = n + len(made)
        made.append((a, b, went))
        sums[key] = both[order] - both[order[0]]
        heapq.heappush(heap, (-int(sums[key][-1]), key))
    # back from the last to the items: the place of each partition's places in the end
    out = [shards - 1] * n
    ends = {heap[0][1]: np.arange(shards)} if heap else {}
    for k in range(len(made) - 1, -1, -1):
        a, b, went = made[k]
        end = ends.pop(n + k)[went]
        for child, places in ((a, end), (b, end[::-1])):
            if child < n:
                out[child] = int(places[-1])
            else:
                ends[child] = places
    return out


def subsets(groups: DataFrame, count: int) -> DataFrame:
    """_group, part, subset of every group (_group, weight); and, without a group, the weight of every subset.

    The subsets of a task's blocks are put together as they come, the lightest of a
    block to the heaviest of those before.
    """
    schema = pa.schema([("_group", pa.binary()), ("part", pa.int32()), ("subset", pa.int32()), ("weight", pa.int64())])

    def run(it):
        part, total = TaskContext.get().partitionId(), np.zeros(count, np.int64)
        for batch in it:
            for a in range(0, batch.num_rows, BLOCK):
                names, weight = batch.column(0).slice(a, BLOCK), batch.column(1).slice(a, BLOCK).to_numpy()
                own = np.array(differencing(weight.tolist(), count))
                sums = np.zeros(count, np.int64)
                np.add.at(sums, own, weight)
                to = np.empty(count, np.int64)
                to[np.argsort(sums, kind="stable")] = np.argsort(-total, kind="stable")
                np.add.at(total, to, sums)
                yield pa.RecordBatch.from_arrays([names, pa.array(np.full(len(own), part, np.int32)), pa.array(to[own].astype(np.int32)), pa.array(weight)], schema=schema)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.nulls(count, pa.binary()), pa.array(np.full(count, part, np.int32)), pa.array(np.arange(count, dtype=np.int32)), pa.array(total)], schema=schema)

    return groups.select("_group", "weight").mapInArrow(run, "_group binary, part int, subset int, weight long")


def shard(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row; law is `bytes`."""
    spark = documents.sparkSession
    n = partitions(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = cut(documents.select(F.col("doc_id").cast("long"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("_group")))
    groups = cut(rows.groupBy("_group").agg(F.sum("size").alias("weight"), F.count(F.lit(1)).alias("_rows")))
    total = groups.agg(F.sum("weight").alias("weight"), F.sum("_rows").alias("rows")).first()
    much = (F.col("weight") * SUBSETS > (total.weight or 0)) | (F.col("_rows") * SUBSETS > (total.rows or 0))
    heavy = {bytes(r[0]): r.weight for r in groups.where(much).select("_group", "weight").collect()}
    light = cut(subsets(groups.where(~much).repartition(n, "_group"), max(LEAST_SUBSETS, -(-SUBSETS // n))))
    # a bounded number of subsets for each task
    parts = {(r.part, r.subset): r.weight for r in light.where("_group IS NULL").collect()}
    names = [*sorted(heavy), *sorted(parts)]
    where = dict(zip(names, differencing([*(heavy[x] for x in sorted(heavy)), *(parts[x] for x in sorted(parts))], shards), strict=True))
    own = F.broadcast(spark.createDataFrame([(x, where[x]) for x in sorted(heavy)], "_group binary, shard int"))
    dealt = F.broadcast(spark.createDataFrame([(*x, where[x]) for x in sorted(parts)], "part int, subset int, shard int"))
    columns = ["doc_id", "size", "text_crc32", "shard"]
    small = light.where("_group IS NOT NULL").join(dealt, ["part", "subset"]).select("_group", "shard")
    placed = rows.join(own, "_group").select(*columns).unionByName(rows.join(own, "_group", "left_anti").join(small, "_group").select(*columns))
    out = dense_ranks(placed, ["shard"], [F.col("doc_id"), F.col("text_crc32"), F.col("size")], "slot", n)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

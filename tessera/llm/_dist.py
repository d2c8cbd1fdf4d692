"""Distributed helpers: reliable cuts of lineage, dense ranks, components."""

from __future__ import annotations

import gc
import time
from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from ..lineage import checkpoint_dir as checkpoint_dir


def cut(df: DataFrame | Callable[[], DataFrame]) -> DataFrame:
    """Computes `df` once into the reliable checkpoint folder.

    What `df` was computed from is then out of use; collecting garbage on the
    driver lets Spark delete its shuffle files now rather than at some time. That
    needs the last reference to be gone, as a call's argument is not: so `df` may
    be a function that makes it. The scheduler forgets a job a moment after its end;
    so collections go on, a few times at most, until the new shuffles are gone.
    """
    wait = callable(df)
    if wait:
        df = df()
    jvm = df.sparkSession._jvm
    checkpoint_dir(df.sparkSession)
    before = _shuffles(jvm)
    out = df.checkpoint()
    del df
    for k in range(8 if wait else 1):
        gc.collect()
        jvm.System.gc()
        if not wait or k and _shuffles(jvm) <= before:
            break
        time.sleep(0.3)
    return out


def _shuffles(jvm) -> int:
    """How many shuffles the driver knows; 0 where Spark doesn't tell."""
    try:
        return jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    except Py4JError:
        return 0


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dense_ranks(df: DataFrame, keys: list[str], order: list[Column], name: str, salts: int) -> DataFrame:
    """Adds a gapless rank from 0 within `keys`, whatever the size of a key.

    Rows of a key are spread over `salts` parts by a hash of `order`; each part
    is ranked alone and shifted by the counts of the parts before it, of which
    there are `salts` at most for a key.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    parts = salted.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy(*keys, "_salt").orderBy(*order)
    ranked = salted.withColumn("_rank", F.row_number().over(within) - 1)
    out = ranked.join(parts, [*keys, "_salt"])
    return out.withColumn(name, (F.col("_rank") + F.col("_before")).cast("long")).drop("_salt", "_rank", "_before")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of `edges` (a, b): rows (node, root), root the least.

    Alternating large-star and small-star steps (Kiveris et al., 2014): every
    step is a grouping with partial aggregation, so that a node with very many
    links is no bottleneck. Nodes without links don't occur.
    """
    now = cut(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).distinct()
        new = cut(small)
        # a fixed point: every edge leads from a node to its root, which is no node's child
        if new.select("a").join(new.select(F.col("b").alias("a")), "a", "left_semi").isEmpty() and new.count() == new.select("a").distinct().count():
            return new.select(F.col("a").alias("node"), F.col("b").alias("root")).union(new.select("b", "b").distinct())
        now = new

"""Incremental statistics: the algebraic aggregates of basic statistics and distributions over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.stats import basic


def windowed_stats(events: DataFrame, time: str, value: str, by: list[str], window: str, late: str) -> DataFrame:
    """Basic statistics for each window of event time; works on streams and on tables.

    On a stream, rows later than `late` are left out and a window is final when
    the watermark has passed it.
    """
    kept = events.withWatermark(time, late) if events.isStreaming else events
    g = kept.groupBy(F.window(time, window).alias("w"), *by)
    return g.agg(*[c.alias(k) for k, c in basic(F.col(value)).items()]).select(F.col("w.start").alias("start"), *by, "n", "sum", "sum2", "min", "max", "avg", "dev")


def windowed_distribution(events: DataFrame, time: str, value: str, window: str, late: str) -> DataFrame:
    kept = events.withWatermark(time, late) if events.isStreaming else events
    return kept.groupBy(F.window(time, window).alias("w"), F.col(value).alias("value")).agg(F.count(F.lit(1)).cast("double").alias("n")).select(F.col("w.start").alias("start"), "value", "n")


def merged(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Two tables of basic statistics as one: sums add, the rest follows."""
    t = a.unionByName(b).groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("n", "sum", "sum2")], F.min("min").alias("min"), F.max("max").alias("max"))
    avg = F.col("sum") / F.col("n")
    return t.withColumn("avg", avg).withColumn("dev", F.sqrt(F.greatest(F.col("sum2") / F.col("n") - avg * avg, F.lit(0.0))))


def windowed_contingency(events: DataFrame, time: str, outer: str, inner: str, window: str, late: str) -> DataFrame:
    """Counts of pairs of values for each window of event time."""
    kept = events.withWatermark(time, late) if events.isStreaming else events
    g = kept.groupBy(F.window(time, window).alias("w"), F.col(outer).alias("outer"), F.col(inner).alias("inner"))
    return g.agg(F.count(F.lit(1)).cast("double").alias("n")).select(F.col("w.start").alias("start"), "outer", "inner", "n")

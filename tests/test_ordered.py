"""Row numbers, running sums and what rests on them, over many partitions."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tessera.functions import stats
from tessera.operators import evaluation, ordered, sampling
from tessera.plans import transforms


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_a_million_rows_are_numbered_without_gaps(spark, adaptive):
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        df = spark.range(1_000_000, numPartitions=16).select(F.xxhash64("id").alias("x"), (F.col("id") % 3).alias("c"))
        n = ordered.numbered(df, ["x"])
        r = n.agg(F.count_distinct("row_id").alias("d"), F.min("row_id").alias("a"), F.max("row_id").alias("b")).first()
        assert (r.d, r.a, r.b) == (1_000_000, 0, 999_999)
        # the order holds across parts
        ahead = n.select(F.expr("row_id div 1000").alias("g"), "x").groupBy("g").agg(F.min("x").alias("a"), F.max("x").alias("b")).orderBy("g").collect()
        assert all(p.b <= q.a for p, q in zip(ahead, ahead[1:], strict=False))
        sizes = {(q.c, q.m): q.n for q in ordered.numbered(df, ["x"], "place", ["c"]).groupBy("c").agg(F.count_distinct("place").alias("n"), F.max("place").alias("m")).collect()}
        assert sizes == {(0, 333333): 333334, (1, 333332): 333333, (2, 333332): 333333}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_numbering_with_ties_nulls_and_repeated_rows(spark):
    rows = [(None, "a")] * 5 + [(1, "b")] * 7 + [(1, None), (0, "z"), (None, None)]
    got = ordered.numbered(spark.createDataFrame(rows, "x int, y string"), ["x"]).orderBy("row_id").collect()
    assert [r.row_id for r in got] == list(range(len(rows)))
    assert [r.x for r in got] == [0] + [1] * 8 + [None] * 6
    assert ordered.numbered(spark.createDataFrame([], "x int"), ["x"]).collect() == []


def test_running_sums_equal_a_plain_walk(spark):
    rng = random.Random(3)
    rows = sorted((k, rng.randrange(2000), rng.randrange(9)) for k in "aab" for _ in range(700))
    df = spark.createDataFrame(rows, "k string, v long, w long").groupBy("k", "v").agg(F.sum("w").alias("w"))
    flat = {(r.k, r.v): r.w for r in df.collect()}
    for down in (False, True):
        got = {(r.k, r.v): r.cum for r in ordered.running(df, "v", {"cum": F.col("w")}, ["k"], down).collect()}
        assert got == {(k, v): sum(w for (j, u), w in flat.items() if j == k and (u >= v if down else u <= v)) for k, v in flat}
    one = df.where("k = 'b'")
    after = {r.v: r.after for r in ordered.running(one, "v", {"cum": F.col("w")}, following="after").collect()}
    values = sorted(after)
    assert [after[v] for v in values] == [*values[1:], None]


def test_percentiles_ranks_and_curves_by_hand(spark):
    df = spark.createDataFrame([(float(x), i % 2) for i, x in enumerate([1, 2, 2, 3, 5, 8, 8, 8])], "x double, y int")
    got = {r.percentile: r.value for r in stats.percentiles(stats.distribution(df, "x"), [0, 25, 50, 100]).collect()}
    assert got == {0: 1.0, 25: 2.0, 50: 4.0, 100: 8.0}
    assert sorted((r.x, r["rank"]) for r in stats.ranks(df, "x").collect()) == [(1, 1), (2, 2.5), (2, 2.5), (3, 4), (5, 5), (8, 7), (8, 7), (8, 7)]
    a = evaluation.auc(df, "x", F.col("y") == 1).first()
    pairs = [(p, q) for p, j in df.collect() for q, k in df.collect() if j == 1 and k == 0]
    assert (a.concordant, a.tied) == (sum(p > q for p, q in pairs), sum(p == q for p, q in pairs))
    assert [stats.density(stats.distribution(df, "x"), at).first().density for at in (0.5, 1.0, 1.5, 4.0, 9.0)] == [0.0, 1.0, 1.5, 1.0, 0.0]


def by_walk(values, n):
    """Equal frequency as defined: a goal aimed anew after every cut, the nearer side of the value that reaches it."""
    counts = sorted(Counter(values).items())
    cum, total = [], 0
    for _, c in counts:
        total += c
        cum.append(total)
    cuts, done, i = [], 0, 1
    for bins in range(n, 1, -1):
        goal = done + (total - done) / bins
        while i < len(counts) and cum[i] < goal:
            i += 1
        if i == len(counts):
            break
        above = i + 1 < len(counts) and cum[i] - goal < goal - cum[i - 1]
        a, b = (i, i + 1) if above else (i - 1, i)
        cuts.append((counts[a][0] + counts[b][0]) / 2)
        done, i = cum[a], i + 1
    return cuts


@pytest.mark.parametrize("n", [2, 3, 4, 7])
def test_equal_frequency_cuts(spark, n):
    rng = random.Random(n)
    lists = [[rng.randrange(40) for _ in range(300)], [0] * 50 + list(range(20)), [rng.choice([1, 5, 6, 9, 30, 31, 32, 40, 77]) for _ in range(99)], list(range(n))]
    for values in lists:
        df = spark.createDataFrame([(float(v),) for v in [*values]] + [(None,)], "x double")
        expected = by_walk(values, n) if len(set(values)) > n else [v + 0.5 for v in range(n - 1)]
        assert transforms.equal_frequency_cuts(df, "x", n) == expected


def test_random_imputation_draws_known_values(spark):
    df = spark.range(4000).withColumn("x", F.when(F.col("id") % 4 == 0, None).otherwise(F.col("id") % 4))
    out = transforms.impute_random(df, "x", ["id"])
    assert out.count() == 4000 and out.where("x IS NULL").isEmpty()
    share = {r.x: r["count"] for r in out.where("id % 4 = 0").groupBy("x").count().collect()}
    assert set(share) == {1, 2, 3} and min(share.values()) > 250


def test_folds_and_parts_are_even(spark):
    df = spark.range(1003).withColumn("c", F.when(F.col("id") % 10 == 0, "rare").otherwise("often"))
    sizes = {(r.c, r.fold): r["count"] for r in sampling.folds(df, 5, ["id"], "c").groupBy("c", "fold").count().collect()}
    for c in ("rare", "often"):
        own = [v for (k, _), v in sizes.items() if k == c]
        assert len(own) == 5 and max(own) - min(own) <= 1
    parts = {(r.c, r.part): r["count"] for r in sampling.two_parts(df, 0.3, ["id"], "c").groupBy("c", "part").count().collect()}
    assert parts == {("rare", 0): 30, ("rare", 1): 71, ("often", 0): 271, ("often", 1): 631}

"""Running sums and row numbers over a global order, dealt over many tasks.

A window without a partition sorts a whole table in one task. Here a bounded
number of bounds, the order values of least hash, cuts the order into parts.
Bounds depend on nothing but the rows, so every evaluation, whatever its
partitions, puts a row into the same part. Each part is walked alone and shifted
by the sums of the parts before it, of which there are PARTS at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import MapType
from pyspark.sql.window import Window

#: Parts of the order at most.
PARTS = 256


def parted(df: DataFrame, order: str, parts: int | None = None) -> DataFrame:
    """`df` with `_part`: the number of bounds up to its value of `order` (nulls come first)."""
    n = parts or min(PARTS, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    chosen = df.select(F.col(order).alias("_b")).where(F.col("_b").isNotNull()).orderBy(F.xxhash64("_b"), "_b").limit(max(n - 1, 1))
    bounds = chosen.agg(F.sort_array(F.collect_list("_b")).alias("_bounds"))
    # one row, broadcast to all
    # by halves: a step is taken where the bound at its end is not greater; beyond the last there is none
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(n - 1, 1).bit_length()))])
    upto = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get("_bounds", at + step - 1) <= F.col(order), at + step).otherwise(at))
    return df.crossJoin(F.broadcast(bounds)).withColumn("_part", upto).drop("_bounds")


def running(df: DataFrame, order: str, sums: dict[str, Column], by: list[str] = (), descending: bool = False, following: str | None = None) -> DataFrame:
    """`df` with the sum of each of `sums` over the rows up to and with this one's order value.

    Rows of one order value are peers and get the same sums. `by` restarts the
    sums for each of its values; a value that has a third of all rows is dealt
    over parts as any other. `following` names a column for the next order value
    (of distinct ones), null at the last.
    """
    cut = parted(df, order).withColumns({f"_s_{k}": c for k, c in sums.items()})
    ahead = F.desc if descending else F.asc
    totals = cut.groupBy(*by, "_part").agg(*[F.sum(f"_s_{k}").alias(f"_t_{k}") for k in sums], F.min(order).alias("_least"))
    # at most PARTS rows for each value of `by`
    places = Window.partitionBy(*by).orderBy(ahead("_part"))
    before = places.rowsBetween(Window.unboundedPreceding, -1)
    keys = [*by, "_part"]
    offsets = totals.select(*[F.col(k).alias(f"_k_{i}") for i, k in enumerate(keys)], *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in sums], F.lead("_least").over(Window.partitionBy(*by).orderBy("_part")).alias("_after"))
    within = Window.partitionBy(*by, "_part").orderBy(ahead(order))
    walked = cut.select(*df.columns, "_part", *[F.sum(f"_s_{k}").over(within).alias(f"_w_{k}") for k in sums])
    if following:
        walked = walked.withColumn("_next", F.lead(order).over(Window.partitionBy(*by, "_part").orderBy(order)))
    both = walked.join(offsets, [F.col(k).eqNullSafe(F.col(f"_k_{i}")) for i, k in enumerate(keys)])
    out = {k: F.col(f"_w_{k}") + F.col(f"_o_{k}") for k in sums}
    if following:
        out[following] = F.coalesce("_next", "_after")
    return both.select(*[F.col(c) for c in df.columns if c not in out], *[c.alias(k) for k, c in out.items()])


def row_order(df: DataFrame, order: list[str]) -> Column:
    """A struct that sorts as `order` does, missing values last; a hash of the whole row parts ties."""
    fixed = [f.name for f in df.schema.fields if not isinstance(f.dataType, MapType)]
    return F.struct(*[x for i, c in enumerate(order) for x in (F.col(c).isNull().alias(f"n{i}"), F.col(c).alias(f"v{i}"))], F.xxhash64(*fixed).alias("h"))


def numbered(df: DataFrame, order: list[str], name: str = "row_id", by: list[str] = ()) -> DataFrame:
    """Rows numbered from 0 by a global order (inside each value of `by`), without gathering them in one task.

    Rows that are equal in `order` follow a hash of all their columns; rows that are
    equal in everything are interchangeable. An empty table stays empty.
    """
    keyed = parted(df.withColumn("_order", row_order(df, order)), "_order")
    totals = keyed.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    keys = [*by, "_part"]
    offsets = totals.select(*[F.col(k).alias(f"_k_{i}") for i, k in enumerate(keys)], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(*by, "_part").orderBy("_order")) - 1
    walked = keyed.withColumn("_place", place)
    both = walked.join(offsets, [F.col(k).eqNullSafe(F.col(f"_k_{i}")) for i, k in enumerate(keys)])
    return both.select(*[F.col(c) for c in df.columns if c != name], (F.col("_place") + F.col("_before")).cast("long").alias(name))

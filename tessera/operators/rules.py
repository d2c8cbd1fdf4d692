"""Frequent itemsets and association rules."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from ..lineage import cut


#: Items of a set that is parted into rules.
MOST_ITEMS = 24


def items_of(df: DataFrame, columns: list[str]) -> DataFrame:
    """`items`: an array of column=value for each row."""
    return df.select(F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c in columns])).alias("items"))


def itemsets(baskets: DataFrame, support: float) -> DataFrame:
    """items (sorted), n: all itemsets with the support, by parallel FP-growth.

    Equal baskets are counted before they travel, and so are the equal parts of them
    that each task mines; no basket is kept or read again by itself.
    """
    spark = baskets.sparkSession
    whole = baskets.where(F.col("items").isNotNull()).select(F.array_sort(F.array_distinct(F.filter("items", lambda x: x.isNotNull()))).alias("items"))
    equal = cut(whole.groupBy("items").agg(F.count(F.lit(1)).alias("w")))
    least = max(1, math.ceil(support * (equal.agg(F.sum("w")).first()[0] or 0)))
    # ranks: frequent items, the most frequent first
    found = equal.select(F.explode("items").alias("item"), "w").groupBy("item").agg(F.sum("w").alias("n")).where(F.col("n") >= least).collect()
    frequent = [r.item for r in sorted(found, key=lambda r: (-r.n, r.item))]
    item = baskets.schema["items"].dataType.elementType
    if not frequent:
        return spark.createDataFrame([], StructType([StructField("items", ArrayType(item)), StructField("n", LongType())]))
    ranks = spark.sparkContext.broadcast({x: k for k, x in enumerate(frequent)})

    def prefixes(it):
        """last, items, w: for each frequent item of a basket those of lower rank, equal ones of a batch once."""
        rank = ranks.value
        for batch in it:
            counts: dict = {}
            for items, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = sorted(rank[x] for x in items or () if x in rank)
                for k, last in enumerate(own):
                    key = last, tuple(own[:k])
                    counts[key] = counts.get(key, 0) + w
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.int32()), pa.array([list(k[1]) for k in counts], pa.list_(pa.int32())), pa.array(list(counts.values()), pa.int64())], ["last", "items", "w"])

    def grown(group):
        """All frequent sets whose item of highest rank is the group's."""
        out: list = []
        todo = [((group.column("last")[0].as_py(),), dict(zip(map(tuple, group.column("items").to_pylist()), group.column("w").to_pylist(), strict=True)))]
        while todo:
            chosen, base = todo.pop()
            out.append((chosen, sum(base.values())))
            counts: dict = {}
            for items, w in base.items():
                for x in items:
                    counts[x] = counts.get(x, 0) + w
            for x in (x for x, n in counts.items() if n >= least):
                part: dict = {}
                for items, w in base.items():
                    if x in items:
                        key = tuple(y for y in items[: items.index(x)] if counts[y] >= least)
                        part[key] = part.get(key, 0) + w
                todo.append(((*chosen, x), part))
        return pa.table({"ranks": pa.array([list(c) for c, _ in out], pa.list_(pa.int32())), "n": pa.array([n for _, n in out], pa.int64())})

    parts = equal.mapInArrow(prefixes, "last int, items array<int>, w long").groupBy("last", "items").agg(F.sum("w").alias("w"))
    sets = parts.groupBy("last").applyInArrow(grown, "ranks array<int>, n long")
    names = spark.createDataFrame([(frequent,)], StructType([StructField("_names", ArrayType(item))]))
    return sets.crossJoin(F.broadcast(names)).select(F.array_sort(F.transform("ranks", lambda k: F.get("_names", k))).alias("items"), "n")


def measures(n: Column, left: Column, right: Column, both: Column) -> dict[str, Column]:
    return {"support": both / n, "confidence": both / left, "coverage": left / n, "strength": right / left, "lift": n * both / (left * right), "leverage": (both * n - left * right) / (n * n)}


def rules(baskets: DataFrame, support: float = 0.3, confidence: float = 0.5, consequent: str | None = None) -> DataFrame:
    """antecedent, consequent (arrays) and measures of every partition of every itemset.

    With `consequent` (a prefix such as "class="), only single items with it stand on the right.
    """
    n = baskets.count()
    sets = itemsets(baskets, support).where("n > 0")
    # an itemset of s items has 2**s - 2 partitions, each a bit mask of 64 bits; with one item on the right, s of them
    if sets.where(F.size("items") > MOST_ITEMS).limit(1).count():
        raise ValueError(f"itemsets of more than {MOST_ITEMS} items: raise the support")
    masks = sets.where(F.size("items") > 1).withColumn("_m", F.explode(F.sequence(F.lit(1).cast("long"), F.expr("shiftleft(1L, size(items)) - 2"))))
    pick = lambda on: F.filter("items", lambda x, i: F.lit(1).cast("long").bitwiseAND(F.call_function("shiftright", F.col("_m"), i)) == on)
    parts = masks.select(pick(1).alias("antecedent"), pick(0).alias("consequent"), F.col("n").alias("both"))
    if consequent is not None:
        parts = parts.where((F.size("consequent") == 1) & F.get("consequent", 0).startswith(consequent))
    left = sets.select(F.col("items").alias("antecedent"), F.col("n").alias("left"))
    right = sets.select(F.col("items").alias("consequent"), F.col("n").alias("right"))
    all_ = parts.join(left, "antecedent").join(right, "consequent")
    out = all_.select("antecedent", "consequent", *[c.alias(k) for k, c in measures(F.lit(float(n)), F.col("left"), F.col("right"), F.col("both")).items()])
    return out.where(F.col("confidence") >= confidence)


def applies(rule_items: Column, items: Column) -> Column:
    """A row has all items of a side of a rule."""
    return F.size(F.array_except(rule_items, items)) == 0


def sorted_rules(found: DataFrame, by: list[str]) -> DataFrame:
    """Best first by measures, then by items."""
    return found.orderBy(*[F.desc(c) for c in by], F.array_join("antecedent", ","), F.array_join("consequent", ","))


def selected(found: DataFrame, support: float = 0.0, confidence: float = 0.0, left: list[str] = (), right: list[str] = ()) -> DataFrame:
    """Rules with these measures at least, and all of some items on a side."""
    out = found.where((F.col("support") >= support) & (F.col("confidence") >= confidence))
    for side, items in (("antecedent", left), ("consequent", right)):
        if items:
            out = out.where(F.size(F.array_except(F.array(*[F.lit(x) for x in items]), F.col(side))) == 0)
    return out


def having(found: DataFrame, side: str, items: list[str], at_least: int = 1, at_most: int | None = None) -> DataFrame:
    """Rules that have between so many of some items on a side."""
    n = F.size(F.array_intersect(F.col(side), F.array(*[F.lit(x) for x in items])))
    return found.where((n >= at_least) & (n <= at_most) if at_most is not None else n >= at_least)


def shown(found: DataFrame, by: list[str], n: int) -> list[str]:
    """The first n rules as text."""
    return [f"{', '.join(r.antecedent)} -> {', '.join(r.consequent)}  " + "  ".join(f"{c}={r[c]:.3f}" for c in by) for r in sorted_rules(found, by).limit(n).collect()]

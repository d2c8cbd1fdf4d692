"""Row indices for samples and folds, by a deterministic order in place of a random one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .ordered import numbered


def order_key(columns: list[str], seed: int = 0) -> Column:
    """A repeatable random order of rows."""
    return F.xxhash64(F.lit(seed), *columns)


def folds(df: DataFrame, n: int, key: list[str], stratify: str | None = None, name: str = "fold") -> DataFrame:
    """Fold numbers from 0, dealt in turn; stratified: in one walk over all classes, one after the other."""
    order = key if stratify is None else [stratify, *key]
    return numbered(df, order, "_place").withColumn(name, (F.col("_place") % n).cast("int")).drop("_place")


def two_parts(df: DataFrame, p0: float, key: list[str], stratify: str | None = None, name: str = "part") -> DataFrame:
    """0 for a share `p0` of rows (a count above 1), else 1; stratified: of every class."""
    if stratify is None:
        n = df.count()
        first = round(p0 * n) if p0 <= 1 else int(p0)
        return numbered(df, key, "_place").withColumn(name, (F.col("_place") >= first).cast("int")).drop("_place")
    sizes = df.groupBy(F.col(stratify).alias("_class")).agg(F.round(F.count(F.lit(1)) * p0).alias("_first"))
    placed = numbered(df, key, "_place", [stratify]).join(F.broadcast(sizes), F.col(stratify).eqNullSafe(F.col("_class")))
    return placed.withColumn(name, (F.col("_place") >= F.col("_first")).cast("int")).drop("_place", "_class", "_first")


def n_parts(df: DataFrame, shares: list[float], key: list[str], name: str = "part") -> DataFrame:
    """Parts by shares with a sum below 1 (the rest is one part more), or by counts."""
    n = df.count()
    sizes = [round(s * n) if sum(shares) < 1 else int(s) for s in shares]
    out = F.lit(len(sizes))
    for i in range(len(sizes) - 1, -1, -1):
        out = F.when(F.col("_place") < sum(sizes[: i + 1]), F.lit(i)).otherwise(out)
    return numbered(df, key, "_place").withColumn(name, out.cast("int")).drop("_place")


def take_fold(df: DataFrame, select: int, name: str = "fold", others: bool = False) -> DataFrame:
    return df.where(F.col(name) != select if others else F.col(name) == select).drop(name)


def with_replacement(df: DataFrame, n: int, key: list[str], seed: int = 0) -> DataFrame:
    """Exactly `n` draws: random row numbers, joined to the numbered rows."""
    rows = numbered(df, key, "_place")
    size = rows.count()
    draws = df.sparkSession.range(n).select((F.rand(seed) * size).cast("long").alias("_draw"))
    return draws.join(rows, F.col("_draw") == F.col("_place")).drop("_draw", "_place")


def shuffle(df: DataFrame, key: list[str], seed: int = 0) -> DataFrame:
    return df.orderBy(order_key(key, seed))


def strata(df: DataFrame, cls: str | None, policy: str = "if_possible") -> str | None:
    """The column that folds and parts are to be stratified by: `not`, `always` (an error where there is no class, or it has missing values), or where it is possible."""
    if policy == "not":
        return None
    fine = cls is not None and cls in df.columns and df.where(F.col(cls).isNull()).isEmpty()
    if not fine and policy == "always":
        raise ValueError("stratification needs a class that is known in every row")
    return cls if fine else None


def random_double(key: list[str], seed: int = 0) -> Column:
    """A number from 0 up to 1, the same for the same key and seed."""
    return F.pmod(order_key(key, seed), F.lit(1 << 52)) / float(1 << 52)


def random_int(key: list[str], n: int, seed: int = 0) -> Column:
    return F.pmod(order_key(key, seed), F.lit(n)).cast("int")


def random_bool(key: list[str], seed: int = 0) -> Column:
    return random_int(key, 2, seed) == 1

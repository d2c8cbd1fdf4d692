"""Projection, merging, concatenation, sorting, duplicates, pivots."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .ordered import numbered as numbered


def derive(df: DataFrame, definitions: dict[str, Column | str]) -> DataFrame:
    """Computed columns, in order: later ones may use earlier ones."""
    for name, how in definitions.items():
        df = df.withColumn(name, F.expr(how) if isinstance(how, str) else how)
    return df


def convert(df: DataFrame, columns: dict[str, str], computed: dict[str, Column] | None = None) -> DataFrame:
    """The columns of another domain (name -> type): copied, computed, or else missing."""
    computed = computed or {}
    return df.select([(computed[c] if c in computed else F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])


def rows_slice(df: DataFrame, row_id: str, start: int, stop: int, step: int = 1) -> DataFrame:
    i = F.col(row_id)
    return df.where((i >= start) & (i < stop) & ((i - start) % step == 0))


def rows_at(df: DataFrame, row_id: str, indices: list[int]) -> DataFrame:
    """Rows by number, in the order asked and as often as asked."""
    wanted = df.sparkSession.createDataFrame(list(enumerate(indices)), "_ord long, _idx long")
    return df.join(F.broadcast(wanted), F.col(row_id) == F.col("_idx")).orderBy("_ord").drop("_ord", "_idx")


def assign(df: DataFrame, name: str, where: Column, value) -> DataFrame:
    return df.withColumn(name, F.when(where, value if isinstance(value, Column) else F.lit(value)).otherwise(F.col(name)))


def merge_first(left: DataFrame, right: DataFrame, left_key: str, right_key: str, order: list[str]) -> DataFrame:
    """Each left row once, with the first right row of its key, else with nulls.

    Missing and empty keys match nothing; right columns that the left has are
    dropped.
    """
    rank = F.row_number().over(Window.partitionBy(right_key).orderBy(*order))
    key = F.col(right_key)
    first = right.where(key.isNotNull() & (key.cast("string") != "")).withColumn("_rank", rank).where("_rank = 1")
    new = [c for c in right.columns if c not in left.columns]
    first = first.select(key.alias("_key"), *new)
    return left.join(first, F.col(left_key) == F.col("_key"), "left").drop("_key")


def merge_remainder(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Left rows without a partner."""
    return left.join(right.select(F.col(right_key).alias("_key")), F.col(left_key) == F.col("_key"), "left_anti")


def zip_rows(left: DataFrame, right: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """Rows of equal number side by side; right columns that the left has are dropped."""
    new = [c for c in right.columns if c not in left.columns and c != right_id]
    return left.join(right.select(F.col(right_id).alias("_id"), *new), F.col(left_id) == F.col("_id")).drop("_id")


def concatenate(tables: list[DataFrame], how: str = "union", source: str | None = None) -> DataFrame:
    """All rows of all tables, over the union or intersection of columns; `source` numbers tables from 1."""
    if how == "intersection":
        common = [c for c in tables[0].columns if all(c in t.columns for t in tables)]
        tables = [t.select(*common) for t in tables]
    if source:
        tables = [t.withColumn(source, F.lit(i)) for i, t in enumerate(tables, 1)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def extend(df: DataFrame, other: DataFrame) -> DataFrame:
    """`df` and the rows of `other` converted to its columns."""
    return df.unionByName(convert(other, dict(df.dtypes)))


def remove_duplicates(df: DataFrame, columns: list[str], weight: Column | None = None, name: str = "weight", keep: list[str] = ()) -> DataFrame:
    """One row for equal ones, with the sum of weights; `keep` columns get their least value."""
    total = F.sum(F.lit(1.0) if weight is None else weight)
    return df.groupBy(*columns).agg(total.alias(name), *[F.min(c).alias(c) for c in keep])


def sort(df: DataFrame, columns: list[str], values: dict[str, list[str]] | None = None) -> DataFrame:
    """Ascending, missing last; discrete columns by their list of values."""
    values = values or {}
    return df.orderBy(*[(F.array_position(F.array(*[F.lit(v) for v in values[c]]), F.col(c)) if c in values else F.col(c)).asc_nulls_last() for c in columns])


AGGREGATES = {
    "count": lambda c: F.count(F.lit(1)), "sum": F.sum, "average": F.avg, "deviation": F.stddev_pop, "minimum": F.min, "maximum": F.max,
    "most_common": lambda c: F.mode(c, True),
}


def pivot_totals(df: DataFrame, row: str, column: str, value: str, how: list[str]) -> DataFrame:
    """Long form of a pivot: cells, and totals where `row` or `column` (or both) is 'total'.

    Rows with a missing key are left out.
    """
    known = df.where(F.col(row).isNotNull() & F.col(column).isNotNull())
    out = known.cube(row, column).agg(F.grouping(row).alias("_r"), F.grouping(column).alias("_c"), *[AGGREGATES[h](F.col(value)).alias(h) for h in how])
    name = lambda g, c: F.when(F.col(g) == 1, F.lit("total")).otherwise(F.col(c).cast("string")).alias(c)
    return out.select(name("_r", row), name("_c", column), *how)


def purge(df: DataFrame, columns: list[str]) -> DataFrame:
    """Drops those of `columns` that have fewer than two values."""
    counts = df.agg(*[F.count_distinct(F.col(c)).alias(c) for c in columns]).first()
    return df.drop(*[c for c in columns if counts[c] < 2])


def drop_sparse(df: DataFrame, columns: list[str], most: float) -> DataFrame:
    """Drops those of `columns` whose share of missing values exceeds `most`."""
    shares = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns]).first()
    return df.drop(*[c for c in columns if (shares[c] or 0) > most])


def drop_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.where(reduce(and_, (F.col(c).isNotNull() for c in columns)))


def checksum(df: DataFrame) -> DataFrame:
    """One number for a table, whatever the order of its rows."""
    return df.agg(F.bit_xor(F.xxhash64(*df.columns)).alias("checksum"), F.count(F.lit(1)).alias("n"))

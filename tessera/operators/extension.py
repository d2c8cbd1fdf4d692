"""A user's own code: conditions, transformers, scores, distances, classifiers, imputers, nodes of a dataflow.

Functions of columns stay expressions. Python code over values runs in Arrow
batches; what is fitted or scored sees aggregated tables only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType


def accepted(f: Callable[[pd.DataFrame], pd.Series], df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that a vectorised Python condition over some columns accepts."""

    @F.pandas_udf("boolean")
    def holds(x: pd.DataFrame) -> pd.Series:
        return f(x).astype("boolean")

    return df.where(holds(F.struct(*columns)))


def transformed(f: Callable[[pd.Series], pd.Series], x: Column, kind: str = "double") -> Column:
    """A vectorised Python function of a column."""

    @F.pandas_udf(kind)
    def apply(values: pd.Series) -> pd.Series:
        return f(values)

    return apply(x)


def scored(df: DataFrame, columns: list[str], cls: str, measure: Callable[[pd.DataFrame], float]) -> DataFrame:
    """variable, score: a measure of each attribute's table of counts (value, class, w), one group a variable.

    A group holds a row for each value and class, not for each row.
    """
    from ..functions.stats import domain_contingency

    counts = domain_contingency(df, columns, cls)

    def one(table: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"variable": [table["variable"].iloc[0]], "score": [float(measure(table[["value", "class", "w"]]))]})

    return counts.groupBy("variable").applyInPandas(one, "variable string, score double")


def classified(f: Callable[[pd.DataFrame], pd.Series], rows: DataFrame, kind: str = "string") -> DataFrame:
    """`rows` with `predicted` by a Python model, batch by batch."""
    schema = StructType([*rows.schema.fields, *rows.sparkSession.createDataFrame([], f"predicted {kind}").schema.fields])

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in it:
            yield part.assign(predicted=f(part))

    return rows.mapInPandas(run, schema)


def learnt(fit: Callable[[pd.DataFrame], Callable[[pd.DataFrame], pd.Series]], keys: list[str], cls: str, most: int = 1_000_000) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A learner from a Python function of the counts of distinct rows (keys, class, n); their number is checked."""

    def learn(train: DataFrame, rows: DataFrame) -> DataFrame:
        counts = train.where(F.col(cls).isNotNull()).groupBy(*keys, cls).agg(F.count(F.lit(1)).alias("n")).limit(most + 1).toPandas()
        if len(counts) > most:
            raise ValueError(f"more than {most} distinct rows: discretise first")
        model = fit(counts)
        return classified(lambda part: model(part[keys]), rows, train.schema[cls].dataType.simpleString())

    return learn


def distances_by(f: Callable[[pd.Series, pd.Series], pd.Series], a: Column, b: Column) -> Column:
    """A user's distance (or kernel) of two columns."""

    @F.pandas_udf("double")
    def apply(x: pd.Series, y: pd.Series) -> pd.Series:
        return f(x, y)

    return apply(a, b)


def imputed_by(fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]], df: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """A user's imputer: fitted on one table, applied to another."""
    return fit(df)(df if rows is None else rows)


def logistic_by(fitter: Callable[[DataFrame, list[str], str], list[float]], columns: list[str], target: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Logistic regression with a user's fitter, which gives the intercept and a weight for each column."""
    from .learners import logistic

    def learn(train: DataFrame, rows: DataFrame) -> DataFrame:
        beta = fitter(train, columns, target)
        p = logistic([F.col(c) for c in columns], beta)
        return rows.withColumn("p", p).withColumn("predicted", (F.col("p") >= 0.5).cast("double"))

    return learn


def with_progress(steps: list[tuple[str, Callable[[DataFrame], DataFrame]]], df: DataFrame, tell: Callable[[str, float], None]) -> DataFrame:
    """Steps in turn; `tell` hears the name of each and the share that is done."""
    for k, (name, step) in enumerate(steps):
        df = step(df)
        tell(name, (k + 1) / len(steps))
    return df


def script(code: str, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """A Python node: code that reads tables by name; the DataFrames that it leaves come out."""
    names = dict(tables)
    exec(code, {"F": F}, names)  # noqa: S102  the user's own script
    return {k: v for k, v in names.items() if isinstance(v, DataFrame)}


def sql(query: str, tables: dict[str, DataFrame]) -> DataFrame:
    """An SQL node over named tables."""
    first = next(iter(tables.values()))
    return first.sparkSession.sql(query, **tables) if "{" in query else _over_views(query, tables)


def _over_views(query: str, tables: dict[str, DataFrame]) -> DataFrame:
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    out = spark.sql(query)
    out.schema  # noqa: B018  resolved before the views go
    return out


def sorted_by(df: DataFrame, key: Callable[[DataFrame], list[Column]]) -> DataFrame:
    """Rows in the order of a user's key columns."""
    return df.orderBy(*key(df))


def kernel_matrix(df: DataFrame, key: str, x: str, f: Callable[[Column, Column], Column]) -> DataFrame:
    """i, j, k of all pairs with i >= j under a user's kernel as an expression; small tables, the size is checked."""
    from .distances import MOST_BROADCAST

    rows = df.select(F.col(key).alias("i"), F.col(x).alias("_a"))
    if rows.limit(MOST_BROADCAST + 1).count() > MOST_BROADCAST:
        raise ValueError(f"a matrix of more than {MOST_BROADCAST} rows")
    other = rows.select(F.col("i").alias("j"), F.col("_a").alias("_b"))
    return rows.join(F.broadcast(other), F.col("i") >= F.col("j")).select("i", "j", f(F.col("_a"), F.col("_b")).alias("k"))

"""Access to parts of a table, meta columns, variables found or made, exchange with numpy and Python."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..schema import ATTRIBUTE, CLASS, CONTINUOUS, DISCRETE, META, WEIGHT, Variable, domain, with_roles
from .relational import convert, rows_at, rows_slice

#: Rows that may become Python objects on the driver.
MOST_NATIVE = 1_000_000


def subscript(df: DataFrame, row_id: str, rows=None, columns=None) -> DataFrame:
    """Rows by number, slice, list of numbers or condition; columns by name, place or slice."""
    if isinstance(rows, int):
        df = df.where(F.col(row_id) == rows)
    elif isinstance(rows, slice):
        if rows.stop is None:
            df = df.where((F.col(row_id) >= (rows.start or 0)) & ((F.col(row_id) - (rows.start or 0)) % (rows.step or 1) == 0))
        else:
            df = rows_slice(df, row_id, rows.start or 0, rows.stop, rows.step or 1)
    elif isinstance(rows, Column):
        df = df.where(rows)
    elif rows is not None:
        df = rows_at(df, row_id, list(rows))
    if columns is None:
        return df
    names = [c for c in df.columns if c != row_id]
    if isinstance(columns, slice):
        return df.select(*names[columns])
    chosen = [columns] if isinstance(columns, (str, int)) else columns
    return df.select(*[names[c] if isinstance(c, int) else c for c in chosen])


def cell(df: DataFrame, row_id: str, row: int, column: str):
    """One value; an error where there is no such row."""
    found = df.where(F.col(row_id) == row).select(column).limit(1).collect()
    if not found:
        raise IndexError(row)
    return found[0][0]


def without_rows(df: DataFrame, row_id: str, rows: Iterable[int]) -> DataFrame:
    gone = df.sparkSession.createDataFrame([(r,) for r in rows], "_gone long")
    return df.join(F.broadcast(gone), F.col(row_id) == F.col("_gone"), "left_anti")


def append(df: DataFrame, row: dict) -> DataFrame:
    """A row more, converted to the columns of `df`."""
    kinds = dict(df.dtypes)
    one = df.sparkSession.range(1).select(*[F.lit(v).alias(k) for k, v in row.items()])
    return df.unionByName(convert(one, kinds))


def cleared(df: DataFrame) -> DataFrame:
    return df.limit(0)


def random_row(df: DataFrame, key: list[str], seed: int = 0) -> DataFrame:
    """One row, the first in a repeatable random order."""
    from .sampling import order_key

    return df.orderBy(order_key(key, seed), *key).limit(1)


def reordered(df: DataFrame, row_id: str, places: DataFrame) -> DataFrame:
    """Rows in the order of a table (`old`, `new`) of their numbers."""
    return df.join(places.select(F.col("old").alias("_old"), F.col("new").alias("_new")), F.col(row_id) == F.col("_old")).withColumn(row_id, F.col("_new")).drop("_old", "_new").orderBy(row_id)


# --- meta columns and weights -------------------------------------------------------------------


def add_meta(df: DataFrame, name: str, value=1.0, where: Column | None = None) -> DataFrame:
    """A meta column with one value, in the rows that `where` selects."""
    x = F.lit(value)
    return df.withColumn(name, x if where is None else F.when(where, x)).withMetadata(name, Variable(name, CONTINUOUS, META).metadata())


def remove_meta(df: DataFrame, name: str, where: Column | None = None) -> DataFrame:
    """Without a meta column, or without its values in some rows."""
    return df.drop(name) if where is None else df.withColumn(name, F.when(~F.coalesce(where, F.lit(False)), F.col(name)))


def copy_meta(df: DataFrame, source: str, target: str, default=None) -> DataFrame:
    return df.withColumn(target, F.coalesce(F.col(source), F.lit(default)) if default is not None else F.col(source))


def map_set(items: Column, key: str, value: float) -> Column:
    """A map of metas with an entry set."""
    return F.map_concat(F.map_filter(items, lambda k, _: k != key), F.create_map(F.lit(key), F.lit(value)))


def map_remove(items: Column, key: str) -> Column:
    return F.map_filter(items, lambda k, _: k != key)


def map_has(items: Column, key: str) -> Column:
    return F.map_contains_key(items, F.lit(key))


def without_weights(df: DataFrame) -> DataFrame:
    """The table with no column in the role of a weight."""
    return df.drop(*[v.name for v in domain(df) if v.role == WEIGHT])


def restated(df: DataFrame, roles: dict[str, str]) -> DataFrame:
    """The same columns in other roles."""
    return with_roles(df, [Variable(v.name, v.kind, roles.get(v.name, v.role), v.values, v.ordered, v.flags) for v in domain(df)])


def chosen(df: DataFrame, attributes: list[str], cls: str | None = None, metas: list[str] = ()) -> DataFrame:
    """Attributes, a class and metas, in that order."""
    roles = dict.fromkeys(attributes, ATTRIBUTE) | ({cls: CLASS} if cls else {}) | dict.fromkeys(metas, META)
    known = {v.name: v for v in domain(df)}
    return with_roles(df, [Variable(n, known[n].kind, r, known[n].values, known[n].ordered, known[n].flags) for n, r in roles.items()])


def by_kind(df: DataFrame, kind: str) -> DataFrame:
    """The class, metas, and attributes of one kind."""
    return with_roles(df, [v for v in domain(df) if v.role != ATTRIBUTE or v.kind == kind])


def info(df: DataFrame) -> dict[str, int]:
    """Rows, and columns by role."""
    roles = [v.role for v in domain(df)]
    return {"rows": df.count(), **{r: roles.count(r) for r in (ATTRIBUTE, CLASS, META, WEIGHT)}}


# --- variables -------------------------------------------------------------------------------------

OK, MISSING_VALUES, NO_RECOGNIZED_VALUES, INCOMPATIBLE, NOT_FOUND = "ok", "missing_values", "no_recognized_values", "incompatible", "not_found"
_LEVELS = [OK, MISSING_VALUES, NO_RECOGNIZED_VALUES, INCOMPATIBLE, NOT_FOUND]


def find_variable(known: list[Variable], name: str, kind: str, ordered_values: tuple[str, ...] = (), values: tuple[str, ...] = (), fail_on: str = INCOMPATIBLE) -> tuple[Variable | None, str]:
    """The best of the known variables of a name, and how well it fits; none if that is as bad as `fail_on` or worse."""
    best, how = None, NOT_FOUND
    for v in known:
        if v.name != name or v.kind != kind:
            continue
        fits = OK
        if kind == DISCRETE:
            have = v.values
            shared = min(len(have), len(ordered_values))
            wanted = {*ordered_values, *values}
            if have[:shared] != tuple(ordered_values[:shared]):
                fits = INCOMPATIBLE
            elif wanted and have and not wanted & set(have):
                fits = NO_RECOGNIZED_VALUES
            elif wanted - set(have):
                fits = MISSING_VALUES
        if _LEVELS.index(fits) < _LEVELS.index(how):
            best, how = v, fits
    return (best, how) if _LEVELS.index(how) < _LEVELS.index(fail_on) else (None, how)


def find_or_make(known: list[Variable], name: str, kind: str, ordered_values: tuple[str, ...] = (), values: tuple[str, ...] = (), create_new_on: str = INCOMPATIBLE) -> tuple[Variable, str]:
    """A known variable, its values completed, or a new one."""
    v, how = find_variable(known, name, kind, ordered_values, values, create_new_on)
    if v is None:
        return Variable(name, kind, values=(*ordered_values, *sorted(set(values) - set(ordered_values)))), how
    more = [x for x in (*ordered_values, *sorted(values)) if x not in v.values]
    return Variable(v.name, v.kind, v.role, (*v.values, *dict.fromkeys(more)), v.ordered, v.flags), how


# --- numpy and Python ---------------------------------------------------------------------------------


def to_numpy(df: DataFrame, contents: str = "a/c") -> tuple[np.ndarray, ...]:
    """Matrices by letters (a attributes, c class, w weights, 0 and 1 constants; upper case: at least one column), parted by slashes; discrete values as their codes.

    The rows come as Arrow batches of doubles; the driver holds what is asked for, and no other column.
    """
    from ..schema import code, of_role

    known = {v.name: v for v in domain(df)}
    value = lambda n: (code(df, n) if known[n].kind == DISCRETE else F.col(f"`{n}`")).cast("double")
    parts, columns = [], []
    for part in contents.split("/"):
        names = []
        for letter in part:
            role = {"a": ATTRIBUTE, "c": CLASS, "w": WEIGHT}.get(letter.lower())
            found = [value(n) for n in of_role(df, role)] if role else [F.lit(float(letter))]
            if letter.isupper() and not found:
                raise ValueError(f"no column for {letter}")
            names += found
        parts.append(range(len(columns), len(columns) + len(names)))
        columns += names
    rows = df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).toArrow()
    return tuple(np.column_stack([rows.column(i).to_numpy() for i in p]) if p else np.zeros((rows.num_rows, 0)) for p in parts)


def from_numpy(spark: SparkSession, x: np.ndarray, variables: list[Variable] | None = None) -> DataFrame:
    """A matrix as a table; without variables, columns of whole numbers from 0 to 9 are discrete, others continuous."""
    import pyarrow as pa

    names = [v.name for v in variables] if variables else [f"var{i}" for i in range(x.shape[1])]
    made = list(variables or ())
    data = pa.table([pa.array(np.ascontiguousarray(x[:, i], float)) for i in range(len(names))], names)
    if variables is None:
        for i, n in enumerate(names):
            known = x[:, i][~np.isnan(x[:, i].astype(float))]
            few = len(known) and np.isin(known, np.arange(10)).all()
            made.append(Variable(n, DISCRETE if few else CONTINUOUS, values=tuple(f"v{k}" for k in range(int(known.max()) + 1)) if few else ()))
    df = spark.createDataFrame(data)
    text = lambda v: F.get(F.array(*[F.lit(s) for s in v.values]), F.col(v.name).cast("int")).alias(v.name) if v.kind == DISCRETE else F.when(F.isnan(v.name), None).otherwise(F.col(v.name)).alias(v.name)
    return with_roles(df.select(*[text(v) for v in made]), made)


def from_rows(spark: SparkSession, rows: Iterable, variables: list[Variable]) -> DataFrame:
    """Python rows as a table with a domain."""
    kinds = {CONTINUOUS: "double"}
    schema = ", ".join(f"`{v.name}` {kinds.get(v.kind, 'string')}" for v in variables)
    made = [tuple(float(x) if x is not None and v.kind == CONTINUOUS else x for x, v in zip(r, variables, strict=True)) for r in rows]
    return with_roles(spark.createDataFrame(made, schema), variables)


def native(df: DataFrame) -> list[list]:
    """Rows as Python lists; their number is checked."""
    rows = df.limit(MOST_NATIVE + 1).collect()
    if len(rows) > MOST_NATIVE:
        raise ValueError(f"more than {MOST_NATIVE} rows")
    return [list(r) for r in rows]


def painted(spark: SparkSession, blobs: list[tuple[float, float, float, int, str]], seed: int = 0) -> DataFrame:
    """x, y, class: normal blobs of points (x, y, deviation, number, class), made in the cluster."""
    out = None
    for k, (x, y, dev, n, cls) in enumerate(blobs):
        one = spark.range(n).select((x + dev * F.randn(seed + 2 * k)).alias("x"), (y + dev * F.randn(seed + 2 * k + 1)).alias("y"), F.lit(cls).alias("class"))
        out = one if out is None else out.union(one)
    names = tuple(dict.fromkeys(b[4] for b in blobs))
    return with_roles(out, [Variable("x"), Variable("y"), Variable("class", DISCRETE, CLASS, names)])


def dataflow(sources: dict[str, DataFrame], nodes: list[tuple[str, list[str], Callable[..., DataFrame]]]) -> dict[str, DataFrame]:
    """Named tables through named steps (name, inputs, function); a step runs when its inputs are there."""
    done, left = dict(sources), list(nodes)
    while left:
        ready = [n for n in left if all(i in done for i in n[1])]
        if not ready:
            raise ValueError(f"inputs that nothing gives: {sorted({i for n in left for i in n[1] if i not in done})}")
        for name, inputs, f in ready:
            done[name] = f(*[done[i] for i in inputs])
        left = [n for n in left if n not in ready]
    return done


def row_merged(spark: SparkSession, rows: list[dict], variables: list[Variable]) -> DataFrame:
    """One row of a domain from several: each value by the first row that knows it."""
    found = {v.name: next((r[v.name] for r in rows if r.get(v.name) is not None), None) for v in variables}
    return from_rows(spark, [tuple(found[v.name] for v in variables)], variables)

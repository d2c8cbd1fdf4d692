"""Preprocessors as steps: each fits on a table and gives what is applied to any table; encoders for single columns."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.models import Learner, prepared
from ..schema import ATTRIBUTE, CONTINUOUS, DISCRETE, Variable, class_column, domain, of_role
from . import transforms as tr

#: A step: a table to fit on -> what to do with tables.
Step = Callable[[DataFrame], Callable[[DataFrame], DataFrame]]


def described(before: DataFrame, after: DataFrame) -> DataFrame:
    """`after` with the roles and values that columns of the same name had, where a new expression has lost them."""
    known = {f.name: f.metadata for f in before.schema.fields if f.metadata}
    for f in after.schema.fields:
        if not f.metadata and f.name in known:
            after = after.withMetadata(f.name, known[f.name])
    return after


def chain(steps: list[Step]) -> Step:
    """Steps in turn, each fitted on what those before give."""

    def fit(df: DataFrame):
        fitted = []
        for step in steps:
            apply = step(df)
            df = described(df, apply(df))
            fitted.append(apply)

        def run(rows: DataFrame) -> DataFrame:
            for apply in fitted:
                rows = described(rows, apply(rows))
            return rows

        return run

    return fit


def attributes(df: DataFrame, kind: str) -> list[str]:
    return [v.name for v in domain(df) if v.role == ATTRIBUTE and v.kind == kind]


def drop_kind(kind: str) -> Step:
    """Without attributes of a kind."""
    return lambda df: lambda rows, gone=tuple(attributes(df, kind)): rows.drop(*gone)


def discretized(how: str = "equal_frequency", n: int = 4, columns: list[str] | None = None, drop_constant: bool = True) -> Step:
    """All continuous attributes at once: equal_width, equal_frequency or entropy; those without a cut go."""

    def fit(df: DataFrame):
        names = columns or attributes(df, CONTINUOUS)
        cuts: dict[str, list[float]] = {}
        if how == "equal_width":
            s = tr.ranges(df, names)
            cuts = {c: [s[c]["min"] + k * (s[c]["max"] - s[c]["min"]) / n for k in range(1, n)] for c in names}
        for c in names:
            if how == "equal_frequency":
                cuts[c] = tr.equal_frequency_cuts(df, c, n)
            elif how == "entropy":
                cuts[c] = tr.entropy_cuts(df, c, class_column(df))

        def apply(rows: DataFrame) -> DataFrame:
            for c in names:
                if not cuts[c] and drop_constant:
                    rows = rows.drop(c)
                    continue
                labels = tr.interval_labels(cuts[c])
                code = tr.intervals(F.col(c), cuts[c])
                text = F.when(F.col(c).isNotNull(), F.get(F.array(*[F.lit(x) for x in labels]), code))
                rows = rows.withColumn(c, text).withMetadata(c, Variable(c, DISCRETE, values=tuple(labels), ordered=True).metadata())
            return rows

        return apply

    return fit


def continuized(how: str = "n_values", scale: str | None = "span", columns: list[str] | None = None) -> Step:
    """Discrete attributes as indicators (or ordinals), continuous ones by span or variance; `ignore` drops, `error` refuses those of many values."""

    def fit(df: DataFrame):
        known = {v.name: v for v in domain(df)}
        discrete = [c for c in (columns or attributes(df, DISCRETE)) if known[c].kind == DISCRETE]
        numbers = attributes(df, CONTINUOUS)
        many = [c for c in discrete if len(known[c].values) > 2]
        if how == "error" and many:
            raise ValueError(f"columns of more than two values: {many}")
        made = {}
        for c in discrete:
            if how == "ignore" and c in many or how == "ignore_all":
                made[c] = {}
            else:
                made[c] = tr.indicators(df, c, list(known[c].values), "lowest_is_base" if how in ("ignore", "error") else how)
        s = tr.ranges(df, numbers) if scale and numbers else {}

        def apply(rows: DataFrame) -> DataFrame:
            new = {n: x for c in discrete for n, x in made[c].items()}
            new |= {c: tr.normalized(F.col(c), s[c], scale) for c in s}
            keep = [F.col(f"`{c}`") for c in rows.columns if c not in discrete and c not in new]
            return rows.select(*keep, *[x.alias(n) for n, x in new.items()])

        return apply

    return fit


def class_continuized(target: str) -> Step:
    """The class as 1 where it has a value, else 0."""

    def fit(df: DataFrame):
        c = class_column(df)
        return lambda rows: rows.withColumn(c, F.when(F.col(c).isNotNull(), (F.col(c) == target).cast("double")))

    return fit


def imputed(how: str = "average", columns: list[str] | None = None) -> Step:
    """Missing values by a statistic: of discrete columns always the most frequent."""

    def fit(df: DataFrame):
        known = {v.name: v for v in domain(df)}
        names = columns or of_role(df, ATTRIBUTE)
        numbers, texts = [c for c in names if known[c].kind == CONTINUOUS], [c for c in names if known[c].kind == DISCRETE]
        values = (tr.fill_values(df, numbers, how) if numbers else {}) | (tr.fill_values(df, texts, "mode") if texts else {})
        return lambda rows: tr.impute(rows, values)

    return fit


def impute_by_model(learners: dict[str, Learner], key: str) -> Step:
    """Each column's missing values by a learner of it from the rows where it is known."""

    def fit(df: DataFrame):
        def apply(rows: DataFrame) -> DataFrame:
            for c, learner in learners.items():
                told = learner(df.where(F.col(c).isNotNull()), rows.where(F.col(c).isNull())).select(F.col(key).alias("_k"), F.col("predicted").cast(rows.schema[c].dataType).alias("_p"))
                rows = rows.join(told, F.col(key) == F.col("_k"), "left").withColumn(c, F.coalesce(F.col(c), F.col("_p"))).drop("_k", "_p")
            return rows

        return apply

    return fit


def impute_each(how: dict[str, tuple]) -> Step:
    """For each column: ('leave',), ('statistic', name), ('value', v), ('random', key columns) or ('remove',), which removes rows."""

    def fit(df: DataFrame):
        values = {}
        for c, (kind, *rest) in how.items():
            if kind == "statistic":
                values |= tr.fill_values(df, [c], rest[0])
            elif kind == "value":
                values[c] = rest[0]

        def apply(rows: DataFrame) -> DataFrame:
            rows = tr.impute(rows, values)
            for c, (kind, *rest) in how.items():
                if kind == "random":
                    rows = tr.impute_random(rows, c, rest[0])
                elif kind == "remove":
                    rows = rows.where(F.col(c).isNotNull())
            return rows

        return apply

    return fit


def kept_best(scores: Callable[[DataFrame, list[str], str], DataFrame], by: str, n: int | None = None, threshold: float | None = None) -> Step:
    """Only the n best discrete attributes, or those above a threshold, by a table (variable, score)."""

    def fit(df: DataFrame):
        from ..operators.scoring import best

        names, cls = attributes(df, DISCRETE), class_column(df)
        keep = {r.variable for r in best(scores(df, names, cls), by, n, threshold).collect()}
        return lambda rows: rows.drop(*[c for c in names if c not in keep])

    return fit


def learnt_behind(steps: list[Step], learner: Learner) -> Learner:
    """Discretise (or impute, or anything) and then learn: fitted on the training rows only."""
    return prepared(steps, learner)


# --- encoders of one column -----------------------------------------------------------------------------


def standardizer(df: DataFrame, c: str) -> Column:
    return tr.normalized(F.col(c), tr.ranges(df, [c])[c], "variance")


def scalizer(df: DataFrame, c: str) -> Column:
    """To -1..1."""
    return tr.normalized(F.col(c), tr.ranges(df, [c])[c], "span", zero_based=False)


def quadratizer(x: Column) -> Column:
    return x * x


def gaussianizer(df: DataFrame, c: str, name: str | None = None) -> DataFrame:
    """`df` with the normal score of each value's rank."""
    from ..functions.special import normal_quantile
    from ..functions.stats import ranks

    n = F.count(F.col(c)).alias("_n")
    placed = ranks(df, c, name="_rank").crossJoin(F.broadcast(df.agg(n)))
    return placed.withColumn(name or c, F.when(F.col(c).isNotNull(), normal_quantile((F.col("_rank") - 0.5) / F.col("_n")))).drop("_rank", "_n")


def ordinalizer(x: Column, values: list[str]) -> Column:
    """Codes of values spread over 0..1."""
    at = F.nullif(F.array_position(F.array(*[F.lit(v) for v in values]), x), F.lit(0)) - 1
    return at / F.lit(max(len(values) - 1, 1))


def binarizer(x: Column, value) -> Column:
    return F.when(x.isNotNull(), (x == value).cast("double"))


def dummies(c: str, values: list[str]) -> dict[str, Column]:
    """An indicator for each value but the first."""
    return {f"{c}={v}": binarizer(F.col(c), v) for v in values[1:]}


def filled(x: Column, value) -> Column:
    """A missing value as a given one."""
    return F.coalesce(x, F.lit(value))


def composed(x: Column, steps: list[Callable[[Column], Column]]) -> Column:
    """Transformations of a value in turn; a user's own functions of a column are steps like any other."""
    for step in steps:
        x = step(x)
    return x


def translated(encoders: dict[str, Callable[[DataFrame, str], Column]]) -> Step:
    """A set of encoders, fitted together and applied together."""

    def fit(df: DataFrame):
        made = {c: f(df, c) for c, f in encoders.items()}
        return lambda rows: rows.withColumns(made)

    return fit


def box_cox(df: DataFrame, c: str, powers: list[float] | None = None) -> tuple[float, Column]:
    """The power that leaves the least skewness, and the column raised to it (its logarithm at 0); one aggregate tries all powers."""
    powers = powers or [k / 4 for k in range(-8, 9)]
    low = df.agg(F.min(c)).first()[0]
    shift = 0.0 if low is None or low > 0 else 1 - float(low)
    x = F.col(c).cast("double") + shift
    raised = lambda p: F.ln(x) if p == 0 else (F.pow(x, F.lit(p)) - 1) / p
    r = df.agg(*[F.skewness(raised(p)) for p in powers]).first()
    skews = [math.inf if v is None or math.isnan(v) else abs(v) for v in r]
    best = min(range(len(powers)), key=lambda k: (skews[k], abs(powers[k] - 1)))
    return powers[best], raised(powers[best])


def plot_scaled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns scaled to 0..1; discrete ones by their place in the list of values."""
    from ..schema import code

    known = {v.name: v for v in domain(df)}
    s = tr.ranges(df, [c for c in columns if known[c].kind != DISCRETE]) if any(known[c].kind != DISCRETE for c in columns) else {}
    value = lambda c: (2 * code(df, c) + 1) / (2 * max(len(known[c].values), 1)) if known[c].kind == DISCRETE else tr.normalized(F.col(c), s[c])
    return df.withColumns({c: value(c) for c in columns})


def width_labels(low: float, step: float, n: int) -> list[str]:
    """Names of bins of one width."""
    cuts = [low + k * step for k in range(1, n)]
    return [f"<{cuts[0]:g}", *[f"[{a:g}, {b:g})" for a, b in zip(cuts, cuts[1:], strict=False)], f">={cuts[-1]:g}"] if cuts else [""]


def formatted(x: Column, decimals: int, scientific: bool = False) -> Column:
    """A number as text with fixed decimals; missing is a question mark."""
    return F.coalesce(F.format_string(f"%.{decimals}{'e' if scientific else 'f'}", x.cast("double")), F.lit("?"))


def same_value(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    """Whether values are equal: missing equals missing, numbers within a tolerance."""
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(F.abs(a - b) <= tolerance)

"""Discretisation, continuisation, imputation: fit on a table, get column expressions.

What is fitted is small (a few numbers a column); applying it is a projection
that Catalyst can fuse with whatever is around it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..lineage import cut
from ..operators.ordered import numbered, running


def ranges(df: DataFrame, columns: list[str]) -> dict[str, dict[str, float]]:
    """min, max, avg, dev of each column, in one aggregate."""
    row = df.agg(*[f(c).cast("double").alias(f"{c}\0{k}") for c in columns for k, f in (("min", F.min), ("max", F.max), ("avg", F.avg), ("dev", F.stddev_pop))]).first()
    return {c: {k: row[f"{c}\0{k}"] for k in ("min", "max", "avg", "dev")} for c in columns}


# --- discretisation ---------------------------------------------------------------------------


def equal_width(x: Column, low: float, high: float, n: int) -> Column:
    """Codes 0..n-1 of bins of one width."""
    step = (high - low) / n
    if step == 0:
        return F.when(x.isNotNull(), F.lit(0))
    return F.when(x < low + step, F.lit(0)).otherwise(F.least(F.lit(n - 1), F.lit(1) + F.floor((x - (low + step)) / step).cast("int"))).cast("int")


def threshold(x: Column, t: float) -> Column:
    return F.when(x.isNotNull(), (x > t).cast("int"))


def intervals(x: Column, cuts: list[float]) -> Column:
    """The number of cuts below x: bins are closed on the right."""
    code = F.lit(0)
    for c in sorted(cuts):
        code = code + (x > c).cast("int")
    return code


def interval_labels(cuts: list[float]) -> list[str]:
    cuts = sorted(cuts)
    if not cuts:
        return [""]
    return [f"<={cuts[0]:g}", *[f"({a:g}, {b:g}]" for a, b in zip(cuts, cuts[1:], strict=False)], f">{cuts[-1]:g}"]


def equal_frequency_cuts(df: DataFrame, column: str, n: int) -> list[float]:
    """Cuts halfway between distinct values, so that bins hold about the same number of rows.

    Each cut looks up, in the cumulative distribution, where an equal share of the
    rows above the last cut ends, and goes to the nearer side of the value there
    (below it where both are equally near). The distribution stays in the cluster;
    a cut is one aggregate over it.
    """
    from ..functions.stats import distribution

    steps = cut(running(distribution(df, column).select(F.col("value").cast("double").alias("v"), "w"), "v", {"cum": F.col("w")}, following="after"))
    known = steps.agg(F.count(F.lit(1)).alias("k"), F.max("cum").alias("n"), F.min("v").alias("first")).first()
    if known.k <= n:
        return sorted(r.c for r in steps.where(F.col("after").isNotNull()).select(((F.col("v") + F.col("after")) / 2).alias("c")).collect())
    cuts: list[float] = []
    done, seen = 0.0, known.first
    for bins in range(n, 1, -1):
        goal = done + (known.n - done) / bins
        at = steps.where((F.col("cum") >= goal) & (F.col("v") > seen)).agg(F.min(F.struct("v", "cum", "after")).alias("a")).first().a
        if at is None:
            break
        below = steps.where(F.col("v") < at.v).agg(F.max(F.struct("v", "cum")).alias("b")).first().b
        up = at.after is not None and at.cum - goal < goal - below.cum
        cuts.append((at.v + at.after) / 2 if up else (below.v + at.v) / 2)
        done, seen = at.cum if up else below.cum, at.v
    return cuts


def _entropy(counts) -> float:
    n = sum(counts)
    return math.log2(n) - sum(c * math.log2(c) for c in counts if c) / n if n else 0.0


def entropy_cuts(df: DataFrame, column: str, cls: str, force: bool = False) -> list[float]:
    """Cuts by recursive entropy minimisation with the MDL stop (Fayyad and Irani, 1993).

    All intervals of a level are cut by one aggregate: running class counts inside
    the cluster give the best cut of each, and only the class counts on its two sides
    come to the driver, which applies the stop.
    """
    from ..operators.trees import _cuts

    x = F.col(column)
    known = df.where(x.isNotNull() & F.col(cls).isNotNull()).select(x.cast("double").alias(column), F.col(cls).cast("string").alias(cls))
    classes = sorted(r[0] for r in known.select(cls).distinct().collect())
    cuts: list[float] = []
    open_: list[tuple[float, float]] = [(-math.inf, math.inf)]
    first = force
    while open_:
        node = F.lit(None).cast("int")
        for i, (low, high) in enumerate(open_):
            node = F.when((x > low) & (x <= high), F.lit(i)).otherwise(node)
        found = _cuts(known.select("*", node.alias("_node"), F.lit(1.0).alias("_w")).where("_node IS NOT NULL"), [column], cls, classes, 1, "gain")
        new = []
        for i, (low, high) in enumerate(open_):
            if i not in found:
                continue
            at, _, left, right = found[i][column]
            total = {c: left.get(c, 0.0) + right.get(c, 0.0) for c in {*left, *right}}
            n, h = sum(total.values()), _entropy(total.values())
            h1, h2 = _entropy(left.values()), _entropy(right.values())
            gain = h - (sum(left.values()) * h1 + sum(right.values()) * h2) / n
            delta = math.log2(3 ** len(total) - 2) - (len(total) * h - len(left) * h1 - len(right) * h2)
            if (n > 1 and gain > math.log2(n - 1) / n + delta / n) or (first and gain > 0):
                cuts.append(at)
                new += [(low, at), (at, high)]
        open_, first = new, False
    return sorted(cuts)


# --- continuisation ---------------------------------------------------------------------------


def indicators(df: DataFrame, column: str, values: list[str], how: str = "n_values", base: str | None = None, zero_based: bool = True) -> dict[str, Column]:
    """Columns for a discrete one: n_values, lowest_is_base, frequent_is_base, ordinal, normalized_ordinal."""
    c = F.col(column)
    code = F.nullif(F.array_position(F.array(*[F.lit(v) for v in values]), c), F.lit(0)) - 1
    if how == "ordinal":
        return {column: code.cast("double")}
    if how == "normalized_ordinal":
        x = code / F.lit(max(1, len(values) - 1))
        return {column: x if zero_based else 2 * x - 1}
    one = lambda v: F.when(c.isNull(), None).when(c == v, 1.0).otherwise(0.0 if zero_based else -1.0)
    if how == "frequent_is_base":
        base = df.where(c.isNotNull()).groupBy(c).count().orderBy(F.desc("count"), column).first()[0]
    elif how == "lowest_is_base":
        base = base or values[0]
    keep = [v for v in values if v != base] if how != "n_values" or len(values) == 2 and base else values
    return {f"{column}={v}": one(v) for v in keep}


def normalized(x: Column, s: dict[str, float], how: str = "span", zero_based: bool = True) -> Column:
    """By span to 0..1 (or -1..1), or by variance to mean 0 and deviation 1."""
    if how == "span":
        span = s["max"] - s["min"]
        if span < 1e-6:
            span = 1.0
        return (x - s["min"]) / span if zero_based else (x - (s["max"] + s["min"]) / 2) / (span / 2)
    dev = s["dev"] if s["dev"] >= 1e-6 else 1.0
    return (x - s["avg"]) / dev


# --- imputation -------------------------------------------------------------------------------


def fill_values(df: DataFrame, columns: list[str], how: str) -> dict[str, object]:
    """What stands in for missing values: minimal, maximal, average, median (by the weight walk), mode."""
    from ..functions.stats import distribution, modus, percentiles

    if how in ("minimal", "maximal", "average"):
        r = ranges(df, columns)
        return {c: r[c][{"minimal": "min", "maximal": "max", "average": "avg"}[how]] for c in columns}
    if how == "median":
        return {c: percentiles(distribution(df, c), [50.0]).first()["value"] for c in columns}
    return {c: modus(distribution(df, c)).first()["value"] for c in columns}


def impute(df: DataFrame, values: dict[str, object]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items() if v is not None})


def impute_as_value(df: DataFrame, discrete: list[str], continuous: dict[str, float]) -> DataFrame:
    """Discrete: an extra value NA. Continuous: a value, and a column that says where it was known."""
    out = {c: F.coalesce(F.col(c), F.lit("NA")) for c in discrete}
    out |= {f"{c}_defined": F.when(F.col(c).isNull(), "undef").otherwise("def") for c in continuous}
    out |= {c: F.coalesce(F.col(c), F.lit(v)) for c, v in continuous.items()}
    return df.withColumns(out)


def impute_random(df: DataFrame, column: str, key: list[str]) -> DataFrame:
    """Draws from the column's own values, repeatably: a hash of the row picks the place in the running share."""
    from ..functions.stats import distribution

    # places of the running share meet missing rows by bucket, so that nothing is gathered
    d = running(distribution(df, column, normalize=True), "value", {"hi": F.col("w")})
    grid = 1 << 16
    low, high = (F.greatest(F.floor((F.col("hi") - F.col("w")) * grid), F.lit(0)), F.least(F.floor(F.col("hi") * grid), F.lit(grid - 1)))
    steps = d.select(F.explode(F.sequence(low.cast("int"), high.cast("int"))).alias("_b"), F.col("value").alias("_v"), F.col("hi").alias("_hi"), (F.col("hi") - F.col("w")).alias("_lo"))
    u = F.pmod(F.xxhash64(*key), F.lit(1 << 30)) / float(1 << 30)
    missing = df.where(F.col(column).isNull()).withColumn("_u", u).withColumn("_b", F.floor(F.col("_u") * grid).cast("int"))
    drawn = missing.join(steps, "_b").where("_u >= _lo AND _u < _hi")
    return df.where(F.col(column).isNotNull()).unionByName(drawn.select(*[F.col("_v").alias(c) if c == column else F.col(c) for c in df.columns]))


# --- noise and weights --------------------------------------------------------------------------


def class_weights(df: DataFrame, cls: str, factors: dict[str, float] | None = None, equalize: bool = True, name: str = "weight") -> DataFrame:
    """Weights that make classes count alike, times a factor for each class."""
    counts = df.where(F.col(cls).isNotNull()).groupBy(F.col(cls).alias("_c")).agg(F.count(F.lit(1)).alias("_f"))
    total = counts.agg(F.sum("_f").alias("_n"), F.count(F.lit(1)).alias("_k"))
    w = F.col("_n") / (F.col("_k") * F.col("_f")) if equalize else F.lit(1.0)
    for c, f in (factors or {}).items():
        w = F.when(F.col("_c") == c, w * f).otherwise(w)
    table = counts.join(F.broadcast(total)).select("_c", w.alias(name))
    return df.join(F.broadcast(table), F.col(cls) == F.col("_c"), "left").drop("_c").withColumn(name, F.coalesce(name, F.lit(1.0)))


def chosen_rows(df: DataFrame, share: float, key: list[str], name: str) -> DataFrame:
    """Marks an exact share of rows, in a repeatable random order."""
    from ..operators.sampling import order_key

    n = round(share * df.count())
    return numbered(df.withColumn("_o", order_key(key)), ["_o", *key], "_place").withColumn(name, F.col("_place") < n).drop("_place", "_o")


def add_missing(df: DataFrame, column: str, share: float, key: list[str]) -> DataFrame:
    return chosen_rows(df, share, key, "_hit").withColumn(column, F.when(~F.col("_hit"), F.col(column))).drop("_hit")


def add_noise(df: DataFrame, column: str, values: list[str], share: float, key: list[str]) -> DataFrame:
    """A share of rows gets random values of a list, in balance."""
    pick = F.get(F.array(*[F.lit(v) for v in values]), F.pmod(F.xxhash64(F.lit(1), *key), F.lit(len(values))).cast("int"))
    return chosen_rows(df, share, key, "_hit").withColumn(column, F.when(F.col("_hit"), pick).otherwise(F.col(column))).drop("_hit")


def add_gaussian_noise(df: DataFrame, column: str, deviation: float, seed: int = 0) -> DataFrame:
    return df.withColumn(column, F.col(column) + F.randn(seed) * deviation)


def log_transform(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))

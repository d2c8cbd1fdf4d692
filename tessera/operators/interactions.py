"""Associations of two and three columns, from one table of counts of their values."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.stats import contingency, ranks, unpivot


def entropy_of(df: DataFrame, columns: list[str], sets: list[tuple[str, ...]]) -> DataFrame:
    """columns (joined by commas), h: the entropy in bits of each set of columns, over rows without a missing value in them.

    All sets are counted in one pass: a row gives a value for each.
    """
    value = lambda s: F.when(F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in s)), F.to_json(F.struct(*[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(s)])))
    each = F.explode(F.array(*[F.struct(F.lit(",".join(s)).alias("columns"), value(s).alias("v")) for s in sets])).alias("x")
    counts = df.select(*columns).select(each).where("x.v IS NOT NULL").groupBy("x.columns", "x.v").agg(F.count(F.lit(1)).cast("double").alias("w"))
    # H = log2 N - sum(w log2 w) / N
    return counts.groupBy("columns").agg((F.log2(F.sum("w")) - F.sum(F.col("w") * F.log2("w")) / F.sum("w")).alias("h"))


def three_way(df: DataFrame, a: str, b: str, c: str) -> DataFrame:
    """interaction I(A;B;C), conditional I(A;B|C), both mutual informations with C, and their sum with the interaction (total)."""
    known = df.where(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(c).isNotNull())
    names = [a, b, c]
    sets = [s for n in (1, 2, 3) for s in combinations(names, n)]
    h = entropy_of(known, names, sets).groupBy().agg(*[F.max(F.when(F.col("columns") == ",".join(s), F.col("h"))).alias("h" + "".join("abc"[names.index(x)] for x in s)) for s in sets])
    interaction = F.expr("-ha - hb - hc + hab + hac + hbc - habc")
    return h.select(interaction.alias("interaction"), F.expr("hac + hbc - hc - habc").alias("conditional"), F.expr("ha + hc - hac").alias("gain_a"), F.expr("hb + hc - hbc").alias("gain_b"), F.expr("hab + hc - habc").alias("total"))


def two_way(df: DataFrame, a: str, b: str) -> DataFrame:
    """chi2, df, mutual information in bits, Jaccard (its share of the joint entropy) and divergence of two columns."""
    from ..functions.stats import chi_square
    from .scoring import mutual_information

    chi = chi_square(contingency(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()), a, b))
    return chi.crossJoin(F.broadcast(mutual_information(df, a, b))).select("chi2", "df", "mutual", "jaccard")


def matrix(df: DataFrame, columns: list[str], cls: str) -> DataFrame:
    """a, b, gain_a, gain_b, interaction with the class for all pairs of columns; one pass over the rows."""
    known = df.where(F.col(cls).isNotNull())
    pairs = list(combinations(columns, 2))
    sets = [(cls,), *((c,) for c in columns), *((c, cls) for c in columns), *pairs, *((*p, cls) for p in pairs)]
    h = entropy_of(known, [*columns, cls], sets)
    find = lambda name, out: h.select(F.col("columns").alias(f"_{out}"), F.col("h").alias(out))
    t = df.sparkSession.createDataFrame([(a, b, a, b, f"{a},{cls}", f"{b},{cls}", f"{a},{b}", f"{a},{b},{cls}", cls) for a, b in pairs], "a string, b string, _ha string, _hb string, _hac string, _hbc string, _hab string, _habc string, _hc string")
    for k in ("ha", "hb", "hac", "hbc", "hab", "habc", "hc"):
        # a row for each set of columns
        t = t.join(F.broadcast(find(k, k)), f"_{k}").drop(f"_{k}")
    return t.select("a", "b", F.expr("ha + hc - hac").alias("gain_a"), F.expr("hb + hc - hbc").alias("gain_b"), F.expr("-ha - hb - hc + hab + hac + hbc - habc").alias("interaction"))


def column_distances(df: DataFrame, columns: list[str], how: str = "pearson") -> DataFrame:
    """i, j, d = (1 - r) / 2 of all pairs of continuous columns; missing values count as the mean."""
    if how == "spearman":
        for c in columns:
            df = ranks(df, c, name=f"_r_{c}")
        name = lambda c: f"_r_{c}"
    else:
        name = lambda c: c
    means = df.agg(*[F.avg(name(c)).alias(f"_m_{c}") for c in columns])
    filled = df.crossJoin(F.broadcast(means)).select(*[F.coalesce(F.col(name(c)).cast("double"), F.col(f"_m_{c}")).alias(c) for c in columns])
    pairs = list(combinations(range(len(columns)), 2))
    r = filled.agg(*[F.corr(columns[i], columns[j]).alias(f"r_{i}_{j}") for i, j in pairs])
    each = F.explode(F.array(*[F.struct(F.lit(columns[j]).alias("i"), F.lit(columns[i]).alias("j"), ((1 - F.col(f"r_{i}_{j}")) / 2).alias("d")) for i, j in pairs])).alias("x")
    return r.select(each).select("x.i", "x.j", "x.d")


def column_dependencies(df: DataFrame, columns: list[str]) -> DataFrame:
    """i, j, d = 1 - I(A;B) / H(A,B) of all pairs of discrete columns."""
    pairs = list(combinations(columns, 2))
    out = None
    h = entropy_of(df, columns, [*((c,) for c in columns), *pairs])
    for a, b in pairs:
        one = h.groupBy().agg(*[F.max(F.when(F.col("columns") == k, F.col("h"))).alias(n) for n, k in (("ha", a), ("hb", b), ("hab", f"{a},{b}"))])
        one = one.select(F.lit(b).alias("i"), F.lit(a).alias("j"), F.expr("1 - (ha + hb - hab) / nullif(hab, 0)").alias("d"))
        out = one if out is None else out.unionByName(one)
    return out


def mdl_scores(df: DataFrame, columns: list[str], cls: str) -> DataFrame:
    """variable, mdl: bits a row that an attribute saves in telling the class (minimum description length)."""
    long = unpivot(df.where(F.col(cls).isNotNull()), columns, [cls], as_text=True).where("value IS NOT NULL")
    counts = long.groupBy("variable", "value", F.col(cls).alias("c")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    k = counts.select("c").distinct().agg(F.count(F.lit(1)).alias("k"))
    lf = lambda x: _log2_factorial(x)
    # bits to tell the classes of n rows: log2 (n! / prod n_c!) + log2 C(n + k - 1, k - 1)
    cost = lambda n, parts: lf(n) - parts + lf(n + F.col("k") - 1) - lf(n) - lf(F.col("k").cast("double") - 1)
    by_value = counts.groupBy("variable", "value").agg(F.sum("w").alias("n"), F.sum(lf(F.col("w"))).alias("parts")).crossJoin(F.broadcast(k)).withColumn("bits", cost(F.col("n"), F.col("parts"))).groupBy("variable").agg(F.sum("bits").alias("after"))
    whole = counts.groupBy("variable", "c").agg(F.sum("w").alias("w")).groupBy("variable").agg(F.sum("w").alias("n"), F.sum(lf(F.col("w"))).alias("parts")).crossJoin(F.broadcast(k)).withColumn("before", cost(F.col("n"), F.col("parts")))
    return whole.join(by_value, "variable").select("variable", ((F.col("before") - F.col("after")) / F.col("n")).alias("mdl"))


def _log2_factorial(n: Column) -> Column:
    """log2 n! by Stirling's series: exact to 1e-9 from 10 on, and by products below."""
    n = n.cast("double")
    series = (n + 0.5) * F.ln(n) - n + 0.5 * F.ln(F.lit(2.0) * F.pi()) + 1 / (12 * n) - 1 / (360 * n * n * n) + 1 / (1260 * F.pow(n, F.lit(5)))
    small = F.ln(F.factorial(F.least(n, F.lit(20.0)).cast("int")).cast("double"))
    return F.when(n <= 20, small).otherwise(series) / F.ln(F.lit(2.0))


def value_scores(df: DataFrame, column: str, cls: str) -> DataFrame:
    """value, gain: the information gain of telling one value of a column from all others."""
    t = contingency(df.where(F.col(column).isNotNull() & F.col(cls).isNotNull()), column, cls)
    # of each value: counts of classes with it, and in all
    classes = t.groupBy("inner").agg(F.sum("w").alias("nc"))
    values = t.select("outer").distinct()
    cells = values.crossJoin(F.broadcast(classes)).join(t, ["outer", "inner"], "left").fillna(0.0, ["w"])
    sums = cells.groupBy("outer").agg(F.sum("w").alias("n1"), F.sum("nc").alias("n"), F.collect_list(F.struct("w", "nc")).alias("c"))
    plogp = lambda x, n: F.when((x > 0) & (n > 0), -x / n * F.log2(x / n)).otherwise(0.0)
    h = lambda f, n: F.aggregate(F.transform("c", lambda s: plogp(f(s), n)), F.lit(0.0), lambda a, b: a + b)
    n0 = F.col("n") - F.col("n1")
    gain = h(lambda s: s["nc"], F.col("n")) - F.col("n1") / F.col("n") * h(lambda s: s["w"], F.col("n1")) - n0 / F.col("n") * h(lambda s: s["nc"] - s["w"], n0)
    return sums.select(F.col("outer").alias("value"), gain.alias("gain"))


def merged_values(x: Column, groups: dict[str, list[str]]) -> Column:
    """Values of a column joined under new names; others stay."""
    out = x
    for name, values in groups.items():
        out = F.when(x.isin(*values), F.lit(name)).otherwise(out)
    return out

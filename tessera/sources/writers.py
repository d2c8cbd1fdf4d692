"""Writers of annotated text formats: one file a partition that has rows, each with the header lines, which the readers drop from every file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..schema import ATTRIBUTE, BASKET, CLASS, CONTINUOUS, DISCRETE, META, STRING, WEIGHT, Variable, class_column, domain

_SHORT = {CONTINUOUS: "C", DISCRETE: "D", STRING: "S", BASKET: "B"}


def _escape(v: str) -> str:
    return v.replace(" ", "\\ ")


def tab_header(variables: list[Variable]) -> list[str]:
    """The three lines: names, types, flags."""
    kinds = [" ".join(map(_escape, v.values)) if v.kind == DISCRETE and v.values else "discrete" if v.kind == DISCRETE else v.kind for v in variables]
    flags = [" ".join([*({CLASS: ["class"], META: ["meta"], WEIGHT: ["weight"]}.get(v.role, [])), *(["-ordered"] if v.ordered else []), *(f"{k}={_escape(x)}" for k, x in v.flags.items())]) for v in variables]
    return ["\t".join(v.name for v in variables), "\t".join(kinds), "\t".join(flags)]


def prefixed_header(variables: list[Variable], sep: str) -> str:
    """Prefixes say role and kind; D only where values look like numbers."""
    out = []
    for v in variables:
        kind = _SHORT[v.kind]
        if v.kind == DISCRETE and not all(x.replace(".", "", 1).isdigit() for x in v.values):
            kind = ""
        mark = {CLASS: "c", META: "m"}.get(v.role, "") + kind
        out.append(f"{mark}#{v.name}" if mark else v.name)
    return sep.join(out)


def basket_text(items: Column) -> Column:
    """`item, item=weight`: a weight of 1 is left out."""
    return F.array_join(F.transform(F.map_entries(items), lambda e: F.when(e["value"] == 1.0, e["key"]).otherwise(F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ", ")


def _quoted(c: Column, sep: str, first: bool = False) -> Column:
    """A cell in quotes where it holds the separator or a quote, or as the first would leave a line blank; a backslash keeps a quote."""
    safe = F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    held = F.contains(c, F.lit(sep)) | F.contains(c, F.lit('"'))
    return F.when(held | ((c != "") & ~c.rlike(r"[^\x00-\x20]")) if first else held, safe).otherwise(c)


def _cells(df: DataFrame, sep: str, quote: bool = False) -> DataFrame:
    plain = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)} if sep in ",;\t" else set()
    cols = [(v.name, basket_text(F.col(v.name)) if v.kind == BASKET else F.col(f"`{v.name}`").cast("string")) for v in domain(df)]
    return df.select(F.concat_ws(sep, *[F.coalesce(_quoted(c, sep, i == 0) if quote and name not in plain else c, F.lit("?")) for i, (name, c) in enumerate(cols)]).alias("value"))


def _with_header(df: DataFrame, lines: list[str], path: str) -> None:
    """Every file begins with the header lines; a table without rows has one file of them."""
    spark = df.sparkSession
    write = lambda t: t.write.mode("overwrite").option("compression", "none").option("maxRecordsPerFile", 0).text(path)
    header = F.lit("\n".join(lines))
    # rows of a part are numbered from 0 in the lower 33 bits
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    write(df.select(F.when(first, F.concat(header, F.lit("\n"), "value")).otherwise(F.col("value")).alias("value")))
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(place).getLength():
        write(spark.range(1, numPartitions=1).select(header.alias("value")))


def write_tab(df: DataFrame, path: str) -> None:
    _with_header(_cells(df, "\t"), tab_header(domain(df)), path)


def write_prefixed(df: DataFrame, path: str, sep: str = "\t") -> None:
    names = [f'"{n}"' if sep in n else n for n in prefixed_header(domain(df), "\0").split("\0")]
    _with_header(_cells(df, sep, True), [sep.join(names)], path)


def write_basket(df: DataFrame, path: str, items: str = "items") -> None:
    df.select(basket_text(F.col(items)).alias("value")).write.mode("overwrite").text(path)


def write_arff(df: DataFrame, path: str, name: str = "table") -> None:
    kind = lambda v: "{" + ",".join(f"'{x}'" for x in v.values) + "}" if v.kind == DISCRETE else "numeric" if v.kind == CONTINUOUS else "string"
    lines = [f"@relation {name}", *[f"@attribute '{v.name}' {kind(v)}" for v in domain(df)], "@data"]
    _with_header(_cells(df, ","), lines, path)


def write_c50(df: DataFrame, path: str) -> None:
    """path.names and path.data; the class comes last."""
    cls = class_column(df)
    variables = domain(df)
    by = {v.name: v for v in variables}
    kind = lambda v: "continuous." if v.kind == CONTINUOUS else ", ".join(v.values) + "."
    names = [f"{', '.join(by[cls].values)}.", *[f"{v.name}: {kind(v)}" for v in variables if v.role == ATTRIBUTE]]
    df.sparkSession.createDataFrame([(x,) for x in names], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.names")
    cols = [v.name for v in variables if v.role == ATTRIBUTE] + [cls]
    df.select(F.concat_ws(", ", *[F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in cols])).write.mode("overwrite").text(f"{path}.data")


def write_libsvm(df: DataFrame, path: str, label: str, columns: list[str]) -> None:
    """Defined, non-zero values as index:value, from 1."""
    pairs = F.array_compact(F.array(*[F.when(F.col(c).isNotNull() & (F.col(c) != 0), F.concat(F.lit(f"{i}:"), F.col(c).cast("string"))) for i, c in enumerate(columns, 1)]))
    df.select(F.concat_ws(" ", F.col(label).cast("string"), F.array_join(pairs, " "))).write.mode("overwrite").text(path)


def write_pajek(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    n = vertices.count()
    v = vertices.orderBy("vertex").select(F.format_string('%d "%s"', "vertex", "label").alias("value"))
    e = edges.select(F.concat_ws(" ", F.col("a").cast("string"), F.col("b").cast("string")).alias("value"))
    spark = vertices.sparkSession
    mark = lambda x: spark.createDataFrame([(x,)], "value string")
    mark(f"*Vertices {n}").union(v).union(mark("*Edges")).union(e).coalesce(1).write.mode("overwrite").text(path)


def write_sql(df: DataFrame, url: str, table: str, mode: str = "append", **options) -> None:
    """Numbers as DOUBLE, other columns as VARCHAR(250)."""
    types = ", ".join(f"{v.name} {'DOUBLE' if v.kind == CONTINUOUS else 'VARCHAR(250)'}" for v in domain(df))
    df.write.format("jdbc").mode(mode).options(url=url, dbtable=table, createTableColumnTypes=types, **options).save()


WRITERS = {".tab": write_tab, ".txt": write_prefixed, ".csv": lambda d, p: write_prefixed(d, p, ","), ".basket": write_basket, ".arff": write_arff}


def write(df: DataFrame, path: str) -> None:
    ending = "." + path.rsplit(".", 1)[-1].lower()
    if ending not in WRITERS:
        raise ValueError(f"unknown format {ending}")
    WRITERS[ending](df, path)


def keep(df: DataFrame, path: str) -> None:
    """The table with its roles and lists of values, to be restored as it is."""
    df.write.mode("overwrite").parquet(path)


#: Rows that may become the source text of a data frame.
MOST_SOURCE_ROWS = 100_000


def r_source(df: DataFrame, name: str = "data") -> str:
    """R source of a data frame: factors for discrete columns, numbers and texts for others."""
    from ..schema import DISCRETE, STRING, domain

    rows = df.limit(MOST_SOURCE_ROWS + 1).collect()
    if len(rows) > MOST_SOURCE_ROWS:
        raise ValueError(f"more than {MOST_SOURCE_ROWS} rows")
    text = lambda v: "NA" if v is None else '"' + str(v).replace("\\", "\\\\").replace('"', '\\"') + '"'
    parts = []
    for v in domain(df):
        own = [r[v.name] for r in rows]
        if v.kind == DISCRETE:
            values = ", ".join(text(x) for x in v.values)
            parts.append(f"  `{v.name}` = factor(c({', '.join(text(x) for x in own)}), levels = c({values}))")
        elif v.kind == STRING:
            parts.append(f"  `{v.name}` = c({', '.join(text(x) for x in own)})")
        else:
            parts.append(f"  `{v.name}` = c({', '.join('NA' if x is None else repr(float(x)) for x in own)})")
    return f"{name} <- data.frame(\n" + ",\n".join(parts) + ",\n  check.names = FALSE)\n"

"""Readers of annotated tables: .tab, .txt, .csv, .basket, ARFF, libSVM, matrices, networks, SQL.

Headers are read on the driver (a few lines), rows by Spark.
"""

from __future__ import annotations

import csv
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..schema import ATTRIBUTE, BASKET, CLASS, CONTINUOUS, DISCRETE, META, MISSING, STRING, WEIGHT, Variable, value_order, with_roles


def cell(c: Column, missing: tuple[str, ...] = MISSING) -> Column:
    """Trimmed text, null where it stands for a missing value."""
    t = F.trim(c)
    # an array makes less code than a list of comparisons, which Java would not compile for many cells
    return F.when(F.array_contains(F.array(*map(F.lit, missing)), t), None).otherwise(t) if missing else t


def number(c: Column) -> Column:
    """A number with a decimal point or comma; null if it is none."""
    return F.replace(c, F.lit(","), F.lit(".")).try_cast("double")


def head(spark: SparkSession, path: str, n: int) -> list[str]:
    """The first lines of a file that any of Spark's file systems can hold."""
    rows = spark.read.text(path).limit(n).collect()
    return [r[0] for r in rows]


def _split_values(text: str) -> tuple[str, ...]:
    """Values parted by spaces; a backslash keeps a space."""
    return tuple(v.replace("\0", " ") for v in text.replace("\\ ", "\0").split())


_KINDS = {"c": CONTINUOUS, "continuous": CONTINUOUS, "d": DISCRETE, "discrete": DISCRETE, "s": STRING, "string": STRING, "basket": BASKET}


def tab_variables(names: list[str], kinds: list[str], flags: list[str], classes: bool = False) -> list[Variable | None]:
    """Variables of a three-line header; None for ignored columns."""
    out: list[Variable | None] = []
    for i, name in enumerate(names):
        kind, marks = (x[i].strip() if i < len(x) else "" for x in (kinds, flags))
        user, role, ordered = {}, ATTRIBUTE, False
        ignored = False
        for m in _split_values(marks):
            if m in ("class", "c"):
                role = CLASS
            elif m in ("meta", "m"):
                role = META
            elif m in ("weight", "w"):
                role = WEIGHT
            elif m in ("ignore", "i", "skip", "s"):
                ignored = True
            elif m in ("basket", "b"):
                kind = "basket"
            elif m == "-ordered":
                ordered = True
            elif "=" in m:
                k, _, v = m.partition("=")
                user[k] = v
        if kind in _KINDS:
            k, values = _KINDS[kind], ()
        else:
            k, values = DISCRETE, _split_values(kind)
        out.append(None if ignored else Variable(name.strip(), k, META if k in (STRING, BASKET) and role == ATTRIBUTE else role, values, ordered, user))
    if not classes and sum(v is not None and v.role == CLASS for v in out) > 1:
        raise ValueError("more than one class")
    return out


def prefixed_variables(names: list[str], no_class: bool = False) -> list[tuple[str, str | None, str, bool]]:
    """(name, kind or None, role, ignored) of a one-line header `[mic]?[DCSB]?#name`."""
    out = []
    for raw in names:
        m = re.fullmatch(r"([mic]?)([DCSB]?)#(.*)", raw.strip())
        mark, kind, name = m.groups() if m else ("", "", raw.strip())
        role = {"m": META, "c": CLASS}.get(mark, ATTRIBUTE)
        out.append((name, {"D": DISCRETE, "C": CONTINUOUS, "S": STRING, "B": BASKET}.get(kind), role, mark == "i"))
    if not no_class and not any(r == CLASS for _, _, r, _ in out):
        last = max((i for i, (_, _, r, ign) in enumerate(out) if r == ATTRIBUTE and not ign), default=None)
        if last is not None:
            out[last] = (out[last][0], out[last][1], CLASS, False)
    return out


def tokens(line: str, sep: str, quote: str | None = '"', escape: str = "\\") -> list[str]:
    """The cells of one header line, as the rows' are split."""
    return next(csv.reader([line], delimiter=sep, quotechar=quote or "\0", escapechar=escape, quoting=csv.QUOTE_MINIMAL if quote else csv.QUOTE_NONE), [])


def _body(spark: SparkSession, path: str, sep: str, width: int, skip: int, missing: tuple[str, ...], quote: str | None = None, comment: str | None = None) -> DataFrame:
    """The rows after a header as columns _c0, _c1, ...: short lines are padded, long ones fail, blank lines (of white space only) and lines of empty cells go.

    Header lines are told by their place at the start of a file, so that the file
    can still be split and rows may repeat them; Spark's own reader drops a single
    one. Quotes keep separators, and a backslash keeps a quote; a line that starts
    with the comment character goes.
    """
    names = [f"_c{i}" for i in range(width)]
    if quote and not comment and skip == 1 and width:
        how = {"sep": sep, "quote": quote, "escape": "\\", "mode": "PERMISSIVE"}
        # the text of a line of another number of cells, which is rare
        parsed = spark.read.schema(", ".join(f"{c} string" for c in [*names, "_line"])).options(**how, header=True, columnNameOfCorruptRecord="_line").csv(path)
        again = F.from_csv("_line", ", ".join(f"{c} string" for c in [*names, "_more"]), how)
        return _checked(parsed, [F.col(c) for c in names], F.trim(F.coalesce(again["_more"], F.lit(""))) != "", "_line", missing)
    places = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("_at"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    # a row for each file
    starts = places.where("_block = 0").groupBy(F.col("_file").alias("_f")).agg(F.min("_at").alias("_start"))
    lines = places.join(F.broadcast(starts), F.col("_file") == F.col("_f")).where(~((F.col("_block") == 0) & (F.col("_at") < F.col("_start") + skip)) & F.col("value").rlike(r"[^\x00-\x20]"))
    if comment:
        lines = lines.where(~F.col("value").startswith(comment))
    if quote:
        schema = ", ".join(f"{c} string" for c in [*names, "_more"])
        parsed = lines.select("value", F.from_csv("value", schema, {"sep": sep, "quote": quote, "escape": "\\", "mode": "PERMISSIVE"}).alias("p"))
        cells = [F.col(f"p.{c}") for c in names]
        more = F.trim(F.coalesce("p._more", F.lit(""))) != ""
    else:
        parts = F.split("value", re.escape(sep))
        parsed = lines.select("value", parts.alias("p"))
        cells = [F.get("p", i) for i in range(width)]
        more = F.size(F.filter(F.slice("p", width + 1, 1 << 20), lambda x: F.trim(x) != "")) > 0
    return _checked(parsed, cells, more, "value", missing)


def _cut_counts(spark: SparkSession, path: str, sep: str, header: str, missing: tuple[str, ...], quote: str, width: int, columns: list[str]) -> DataFrame:
    """c, v, n as by `value_counts` over lines other than the header, cut at each separator.

    Under c = '' stands each file, with `plain`: whether its first line is the only one
    like the header, and no line needs more than a cut: none has a quote, more cells
    than the header, other bytes than UTF-8, or only characters that make it blank.
    """
    value = F.col("value")
    blank = (value < "!") & ~value.rlike(r"[^\x00-\x20]") & (F.translate(value, sep + " ", "") != "")
    odd = F.contains(value, F.lit(quote)) | (F.size("_p") > width) | ~F.is_valid_utf8(value) | blank
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("_at"), F.col("_metadata.file_path").alias("_file"), (F.col("_metadata.file_block_start") == 0).alias("_top"), F.split("value", re.escape(sep)).alias("_p"))
    marked = lines.withColumns({"_like": value == header, "_odd": (value != header) & odd})
    each = [F.struct(F.lit(c).alias("c"), F.when(~F.col("_like"), cell(F.get("_p", int(c[2:])), missing)).alias("v")) for c in columns]
    file = F.struct(F.lit("").alias("c"), F.when(F.col("_top") | F.col("_like") | F.col("_odd"), F.col("_file")).alias("v"))
    rows = marked.select("_at", "_top", "_like", "_odd", F.explode(F.array(*each, file)).alias("x")).where("x.v IS NOT NULL")
    first = F.min(F.when(F.col("_top"), F.col("_at"))) == F.min(F.when(F.col("_top") & F.col("_like"), F.col("_at")))
    plain = F.coalesce(first, F.lit(False)) & (F.count_if("_like") == 1) & (F.count_if("_odd") == 0)
    return rows.groupBy("x.c", "x.v").agg(F.count(F.lit(1)).alias("n"), plain.alias("plain"))


def _cut_body(spark: SparkSession, path: str, sep: str, header: str, missing: tuple[str, ...], width: int) -> DataFrame:
    """What `_body` gives for plain files (see `_cut_counts`): no parser, and headers are told by their text."""
    said = f" *(?:{'|'.join(map(re.escape, missing))}) *"
    empty = F.col("value").rlike(rf"\A{said}(?:{re.escape(sep)}{said})*\z")
    # most lines are told by their first cell
    first = cell(F.substring_index("value", sep, 1), missing)
    lines = spark.read.text(path).where((F.col("value") != header) & F.when(first.isNotNull(), True).otherwise(~empty))
    parts = lines.select(F.split("value", re.escape(sep)).alias("p"))
    return parts.select(*[cell(F.get("p", i), missing).alias(f"_c{i}") for i in range(width)])


def _checked(parsed: DataFrame, cells: list[Column], more: Column, line: str, missing: tuple[str, ...]) -> DataFrame:
    """The cells as columns _c0, _c1, ...; a line with more of them fails."""
    checked = F.when(more, F.raise_error(F.concat(F.lit("example of invalid length: "), F.col(line))).cast("string"))
    rows = parsed.select(*[cell(F.coalesce(checked, c) if i == 0 else c, missing).alias(f"_c{i}") for i, c in enumerate(cells)])
    return rows if not cells else rows.where(" OR ".join(f"_c{i} IS NOT NULL" for i in range(len(cells))))


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """c, v, n: how often each value occurs in each column."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in columns])).alias("x")
    return df.select(each).where("x.v IS NOT NULL").groupBy("x.c", "x.v").agg(F.count(F.lit(1)).alias("n"))


def infer_kinds(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """Kinds by the distinct values: single digits only are codes, numbers continuous, the rest discrete or, if there are more than 20 and most occur once, text."""
    return _kinds_by(value_counts(df, columns), columns)


def _kinds_by(values: DataFrame, columns: list[str]) -> dict[str, str]:
    found = values.groupBy("c").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.bool_and(F.col("v").rlike("^[0-9]$")).alias("d"), F.bool_and(number(F.col("v")).isNotNull()).alias("f"))
    rows = {r.c: r for r in found.collect()}
    kind = lambda r: DISCRETE if r is None or r.d else CONTINUOUS if r.f else STRING if r.k > 20 and 2 * r.k > r.n else DISCRETE
    return {c: kind(rows.get(c)) for c in columns}


def _typed(body: DataFrame, variables: list[Variable | None], found: dict[str, list[str]] | None = None) -> DataFrame:
    """Columns under their names and types; undeclared value lists are `found`, or gathered in one pass."""
    used = [(f"_c{i}", v) for i, v in enumerate(variables) if v is not None]
    open_ = [c for c, v in used if v.kind == DISCRETE and not v.values]
    if found is None:
        found = body.agg(*[F.collect_set(c).alias(c) for c in open_]).first() if open_ else {}
    made = [Variable(v.name, v.kind, v.role, tuple(value_order(found[c])), v.ordered, v.flags) if c in open_ else v for c, v in used]
    cols = []
    for (c, _), v in zip(used, made, strict=True):
        x = number(F.col(c)) if v.kind == CONTINUOUS else basket_map(F.col(c)) if v.kind == BASKET else F.col(c)
        cols.append(x.alias(v.name))
    return with_roles(body.select(*cols), made)


def read_tab(spark: SparkSession, path: str, missing: tuple[str, ...] = MISSING, quote: str | None = None, comment: str | None = None, classes: bool = False) -> DataFrame:
    """A file with three header lines: names, types, flags; `classes` allows several columns in the role of the class."""
    top = head(spark, path, 3)
    names, kinds, flags = (x.split("\t") for x in [*top, *[""] * (3 - len(top))])
    variables = tab_variables(names, kinds, flags, classes)
    return _typed(_body(spark, path, "\t", len(names), 3, missing, quote, comment), variables)


def why_not_tab(lines: list[str]) -> str | None:
    """Why the first lines can't be a three-line header; None if they can."""
    if len(lines) < 3:
        return "fewer than three lines"
    names, kinds, flags = (x.split("\t") for x in lines[:3])
    if len(kinds) > len(names) or len(flags) > len(names):
        return "more types or flags than names"
    for name, kind in zip(names, kinds, strict=False):
        kind = kind.strip()
        if kind and kind not in _KINDS and number_like(kind):
            return f"the type of {name.strip()!r} is a number: {kind}"
    for mark in (m for f in flags for m in _split_values(f)):
        if mark not in _MARKS and "=" not in mark:
            return f"unknown flag {mark!r}"
    return None


_MARKS = ("class", "c", "meta", "m", "weight", "w", "ignore", "i", "skip", "s", "basket", "b", "-ordered")


def number_like(text: str) -> bool:
    try:
        float(text.replace(",", "."))
    except ValueError:
        return False
    return True


def find_file(spark: SparkSession, name: str, folders: tuple[str, ...] = (), endings: tuple[str, ...] = (".tab", ".txt", ".csv", ".basket", ".arff")) -> str:
    """The first path that exists: the name, with each ending, then the same in each folder."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in ("", *folders):
        for ending in ("", *endings):
            path = f"{folder.rstrip('/')}/{name}{ending}" if folder else f"{name}{ending}"
            place = jvm.org.apache.hadoop.fs.Path(path)
            if place.getFileSystem(conf).exists(place):
                return path
    raise FileNotFoundError(name)


def read_prefixed(spark: SparkSession, path: str, sep: str = "\t", no_class: bool = False, missing: tuple[str, ...] = MISSING, quote: str | None = '"', comment: str | None = None) -> DataFrame:
    """A file with one header line; kinds that it doesn't say are inferred."""
    top = head(spark, path, 100)
    header = top[0]
    names = tokens(header, sep, quote)
    described = prefixed_variables(names, no_class)
    open_ = [f"_c{i}" for i, (_, k, _, ign) in enumerate(described) if k is None and not ign]
    listed = [f"_c{i}" for i, (_, k, _, ign) in enumerate(described) if k in (None, DISCRETE) and not ign]
    # one pass over the file tells kinds and values, and whether all of its lines are plain
    body = values = None
    if listed and quote and not comment and not any(quote in x for x in top[1:]):
        values = _cut_counts(spark, path, sep, header, missing, quote, len(names), listed).persist()
        if values.where("c = '' AND NOT plain").isEmpty():
            body = _cut_body(spark, path, sep, header, missing, len(names))
        else:
            values.unpersist()
    if body is None:
        body = _body(spark, path, sep, len(names), 1, missing, quote, comment)
        values = value_counts(body, listed).persist() if listed else None
    kinds = _kinds_by(values.where(F.col("c").isin(open_)), open_) if open_ else {}
    variables = []
    for i, (name, kind, role, ignored) in enumerate(described):
        kind = kind or kinds.get(f"_c{i}")
        variables.append(None if ignored else Variable(name, kind, META if kind in (STRING, BASKET) else role))
    found: dict[str, list[str]] = {c: [] for c in listed}
    if values is not None:
        for r in values.where(F.col("c").isin([f"_c{i}" for i, v in enumerate(variables) if v is not None and v.kind == DISCRETE])).collect():
            found[r.c].append(r.v)
        values.unpersist()
    return _typed(body, variables, found)


def basket_map(line: Column) -> Column:
    """item -> weight of a line `item, item=weight, ...`; repeated items are summed."""
    parts = F.filter(F.transform(F.split(line, ","), lambda x: F.trim(x)), lambda x: x != "")
    names = F.transform(parts, lambda x: F.trim(F.split_part(x, F.lit("="), F.lit(1))))
    weight = lambda x: F.when(F.contains(x, F.lit("=")), F.split_part(x, F.lit("="), F.lit(-1)).try_cast("double")).otherwise(1.0)
    pairs = F.zip_with(names, parts, lambda n, x: F.struct(n.alias("k"), weight(x).alias("w")))
    total = lambda k: F.aggregate(F.filter(pairs, lambda p: p["k"] == k), F.lit(0.0), lambda a, p: a + p["w"])
    return F.map_from_entries(F.transform(F.array_distinct(names), lambda k: F.struct(k, total(k))))


def read_basket(spark: SparkSession, path: str) -> DataFrame:
    """`items`: a map item -> weight for each line."""
    return spark.read.text(path).where(F.trim("value") != "").select(basket_map(F.col("value")).alias("items"))


def read_arff(spark: SparkSession, path: str) -> DataFrame:
    """Attributes from the @attribute lines; the last one is the class."""
    lines = spark.read.text(path)
    declared = [r[0].strip() for r in lines.where(F.lower(F.trim("value")).startswith("@attribute")).limit(100_000).collect()]
    variables = []
    for d in dict.fromkeys(declared):  # every part of a table has them
        m = re.fullmatch(r"@attribute\s+('[^']*'|\"[^\"]*\"|\S+)\s+(.*)", d, re.IGNORECASE)
        name, kind = m[1].strip("'\""), m[2].strip()
        if kind.startswith("{"):
            variables.append(Variable(name, DISCRETE, ATTRIBUTE, tuple(v.strip().strip("'\"") for v in kind.strip("{}").split(","))))
        else:
            variables.append(Variable(name, CONTINUOUS if kind.lower() in ("numeric", "real", "integer") else STRING, ATTRIBUTE if kind.lower() in ("numeric", "real", "integer") else META))
    if variables and variables[-1].kind != STRING:
        v = variables[-1]
        variables[-1] = Variable(v.name, v.kind, CLASS, v.values)
    data = lines.where(~F.trim("value").rlike("^(@|%|$)"))
    parts = F.transform(F.split("value", ","), lambda x: F.trim(F.trim(x), F.lit("'\"")))
    body = data.select(parts.alias("p")).select(*[cell(F.get("p", i)).alias(f"_c{i}") for i in range(len(variables))])
    return _typed(body, variables)


def read_libsvm(spark: SparkSession, path: str) -> DataFrame:
    """label, features: a map index -> value of each line."""
    parts = F.split(F.trim("value"), r"\s+")
    pairs = F.transform(F.filter(F.slice(parts, 2, 1 << 24), lambda x: x != ""), lambda x: F.struct(F.split_part(x, F.lit(":"), F.lit(1)).cast("int"), F.split_part(x, F.lit(":"), F.lit(2)).cast("double")))
    return spark.read.text(path).where(F.trim("value") != "").select(F.get(parts, 0).cast("double").alias("label"), F.map_from_entries(pairs).alias("features"))


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """i, j, d from lines of a lower triangle, each led by its row's label if the first line says so."""
    first = head(spark, path, 1)[0].split()
    labelled = len(first) > 1
    from ..operators.relational import numbered

    rows = numbered(spark.read.text(path).where(F.col("value") != " ".join(first)).withColumn("_n", F.size(F.split("value", "\t"))), ["_n"], "i")
    cells = rows.select("i", F.posexplode(F.slice(F.split("value", "\t"), 2 if labelled else 1, 1 << 24)).alias("j", "d"))
    return cells.where(F.trim("d") != "").select("i", F.col("j").cast("long").alias("j"), F.col("d").cast("double").alias("d"))


def read_pajek(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices (vertex, label) and edges (a, b, w, directed) of a .net file.

    Sections are told by markers, whose offsets in the file bound their lines.
    """
    return _pajek(spark.read.text(path).withColumn("_at", F.monotonically_increasing_id()))


def parse_pajek(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame]:
    """The same from a string."""
    return _pajek(spark.createDataFrame(list(enumerate(text.splitlines())), "_at long, value string").select("value", "_at"))


def _pajek(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    marks = lines.where(F.col("value").startswith("*")).select("_at", F.lower(F.regexp_extract("value", r"^\*(\w+)", 1)).alias("s")).collect()
    section = F.lit(None).cast("string")
    for m in sorted(marks, key=lambda r: r["_at"]):
        section = F.when(F.col("_at") > m["_at"], F.lit(m["s"])).otherwise(section)
    rows = lines.withColumn("_s", section).where(~F.col("value").startswith("*") & (F.trim("value") != ""))
    p = F.split(F.trim("value"), r"\s+")
    vertices = rows.where("_s = 'vertices'").select(F.get(p, 0).cast("long").alias("vertex"), F.regexp_extract("value", '"([^"]*)"', 1).alias("label"))
    edges = rows.where("_s IN ('arcs', 'edges')").select(F.get(p, 0).cast("long").alias("a"), F.get(p, 1).cast("long").alias("b"), F.coalesce(F.get(p, 2).try_cast("double"), F.lit(1.0)).alias("w"), (F.col("_s") == "arcs").alias("directed"))
    return vertices, edges


def read_gml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges of a GML file, whose records are read as wholes."""
    text = spark.read.text(path, wholetext=True)
    part = lambda kind: F.explode(F.regexp_extract_all("value", F.lit(rf"(?s)\b{kind}\s*\[([^\]]*)\]"), F.lit(1))).alias("r")
    num = lambda k: F.regexp_extract("r", rf"\b{k}\s+(-?\d+)", 1).try_cast("long")
    vertices = text.select(part("node")).select(num("id").alias("vertex"), F.regexp_extract("r", r'label\s+"([^"]*)"', 1).alias("label"))
    return vertices, text.select(part("edge")).select(num("source").alias("a"), num("target").alias("b"))


def read_sql(spark: SparkSession, query: str, url: str | None = None, discrete: list[str] = (), metas: list[str] = (), cls: str = "class", **options) -> DataFrame:
    """A query's rows with roles: text is discrete if named so, else a meta; a column named as the class is it."""
    df = spark.read.format("jdbc").options(url=url, query=query, **options).load() if url else spark.sql(query)
    variables = []
    for name, kind in df.dtypes:
        k = DISCRETE if name in discrete or kind == "boolean" else STRING if kind in ("string", "date", "timestamp", "timestamp_ntz") else CONTINUOUS
        variables.append(Variable(name, k, CLASS if name == cls else META if name in metas or k == STRING else ATTRIBUTE))
    return with_roles(df, variables)


def read_sql_file(spark: SparkSession, path: str, **options) -> DataFrame:
    """A query with directives in comments: `--orng uri '...'`, `discrete [...]`, `meta [...]`, `class '...'`."""
    text = spark.read.text(path, wholetext=True).first()[0]
    marks: dict[str, str] = {}
    query = []
    for line in text.splitlines():
        m = re.match(r"\s*--orng\s+(\w+)\s+(.*)", line)
        if m:
            marks[m[1]] = m[2].strip()
        elif not line.strip().startswith("--"):
            query.append(line)
    names = lambda k: [x.strip().strip("'\"") for x in marks.get(k, "").strip("[]").split(",") if x.strip()]
    uri = marks.get("uri", "").strip("'\"")
    return read_sql(spark, "\n".join(query).strip().rstrip(";"), uri or None, names("discrete"), names("meta"), (names("class") or ["class"])[0], **options)


def read_sql_table(spark: SparkSession, table: str, url: str | None = None, **options) -> DataFrame:
    """All columns of a table."""
    return read_sql(spark, f"SELECT * FROM {table}", url, **options)


def restored(spark: SparkSession, path: str) -> DataFrame:
    """A table with its roles and lists of values, as `writers.keep` left it: Parquet holds a schema's metadata."""
    return spark.read.parquet(path)


READERS = {".tab": read_tab, ".txt": read_prefixed, ".csv": lambda s, p: read_prefixed(s, p, ","), ".basket": read_basket, ".arff": read_arff, ".svm": read_libsvm}


def read(spark: SparkSession, path: str) -> DataFrame:
    """By the extension."""
    ending = "." + path.rsplit(".", 1)[-1].lower()
    if ending not in READERS:
        raise ValueError(f"unknown format {ending}")
    return READERS[ending](spark, path)

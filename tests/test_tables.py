"""Readers, writers, roles, transforms and special functions on small cases."""

import math

import pytest
from tessera import schema
from tessera.functions import special, stats
from tessera.operators import filters as fl, graphs, learners, relational as rel, rules, sampling
from tessera.plans import transforms as tr
from tessera.sources import readers, writers
from tessera.streaming import online

from pyspark.sql import functions as F

TAB = "name\tcolour\tsize\tjunk\tkind\tbag\nstring\tred light\\ blue\tc\tc\td\tbasket\nmeta\t-ordered\tunit=cm\tignore\tclass\t\na\tred\t1.5\t9\tyes\tx, y=2, x\nb\tlight blue\t?\t9\tno\t\nc\t~\t2,5\t9\tyes\tz=0.5\nd\tred\n"


@pytest.fixture
def tab(spark, tmp_path):
    (tmp_path / "t.tab").write_text(TAB)
    return readers.read(spark, str(tmp_path / "t.tab"))


def test_three_line_header(tab):
    v = {x.name: x for x in schema.domain(tab)}
    assert list(v) == ["name", "colour", "size", "kind", "bag"]
    assert (v["colour"].kind, v["colour"].values, v["colour"].ordered) == ("discrete", ("red", "light blue"), True)
    assert (v["kind"].role, v["kind"].values) == ("class", ("no", "yes"))
    assert v["size"].flags == {"unit": "cm"} and v["name"].role == "meta"
    rows = {r.name: r for r in tab.collect()}
    assert rows["a"].size == 1.5 and rows["b"].size is None and rows["c"].size == 2.5 and rows["c"].colour is None
    assert rows["a"].bag == {"x": 2.0, "y": 2.0} and rows["d"].kind is None
    codes = {r.name: r.c for r in tab.select("name", schema.code(tab, "colour").alias("c")).collect()}
    assert codes == {"a": 0, "b": 1, "c": None, "d": 0}


def test_long_lines_fail(spark, tmp_path):
    (tmp_path / "t.tab").write_text("a\tb\nc\tc\n\t\n1\t2\t3\n")
    with pytest.raises(Exception, match="invalid length"):
        readers.read(spark, str(tmp_path / "t.tab")).collect()


def test_round_trip(spark, tab, tmp_path):
    for ending in ("tab", "txt", "csv"):
        path = str(tmp_path / f"out.{ending}")
        plain = schema.with_roles(tab, [v for v in schema.domain(tab) if v.kind != "basket"])
        writers.write(plain, path)
        again = readers.read(spark, path)
        assert sorted(map(str, again.select("name", "colour", "size", "kind").collect())) == sorted(map(str, plain.collect()))
        assert schema.class_column(again) == "kind"


def test_prefixed_header_and_inference(spark, tmp_path):
    (tmp_path / "t.csv").write_text("mS#id,code,C#x,word,last\n" + "".join(f"r{i},{i % 3},{i / 2},w{i % 2},{i * 1.5}\n" for i in range(30)))
    df = readers.read(spark, str(tmp_path / "t.csv"))
    kinds = {v.name: (v.kind, v.role) for v in schema.domain(df)}
    assert kinds == {"id": ("string", "meta"), "code": ("discrete", "attribute"), "x": ("continuous", "attribute"), "word": ("discrete", "attribute"), "last": ("continuous", "class")}


def test_other_formats(spark, tmp_path):
    (tmp_path / "t.basket").write_text("a, b=2, a\n\nc=0.5\n")
    assert [r["items"] for r in readers.read(spark, str(tmp_path / "t.basket")).collect()] == [{"a": 2.0, "b": 2.0}, {"c": 0.5}]
    (tmp_path / "t.arff").write_text("@relation r\n@attribute x numeric\n@attribute 'c' {a, b}\n@data\n% no\n1,a\n?,b\n")
    df = readers.read(spark, str(tmp_path / "t.arff"))
    assert sorted(map(tuple, df.collect()), key=str) == [(1.0, "a"), (None, "b")] and schema.class_column(df) == "c"
    (tmp_path / "t.svm").write_text("1 1:0.5 3:2\n-1 2:1\n")
    assert [(r.label, r.features) for r in readers.read(spark, str(tmp_path / "t.svm")).collect()] == [(1.0, {1: 0.5, 3: 2.0}), (-1.0, {2: 1.0})]
    (tmp_path / "m.txt").write_text("3\n0.0\n1.0\t0.0\n2.0\t3.0\t0.0\n")
    assert sorted(map(tuple, readers.read_matrix(spark, str(tmp_path / "m.txt")).where("i > j").collect())) == [(1, 0, 1.0), (2, 0, 2.0), (2, 1, 3.0)]
    (tmp_path / "g.net").write_text('*Vertices 3\n1 "a"\n2 "b c"\n3 "d"\n*Arcs\n1 2 0.5\n*Edges\n2 3\n')
    v, e = readers.read_pajek(spark, str(tmp_path / "g.net"))
    assert sorted(map(tuple, v.collect())) == [(1, "a"), (2, "b c"), (3, "d")]
    assert sorted(map(tuple, e.collect())) == [(1, 2, 0.5, True), (2, 3, 1.0, False)]
    with pytest.raises(ValueError, match="unknown format"):
        readers.read(spark, "x.doc")


def test_three_valued_filters(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, "a"), (3.0, None), (None, None)], "x double, s string")
    count = lambda c: df.where(c).count()
    for unknown, n in ((fl.ACCEPT, 3), (fl.REJECT, 1), (fl.IGNORE, 3)):
        assert count(fl.continuous("x", "greater", 2, unknown=unknown).alone()) == n
    assert count(fl.discrete("s", ["a"], negate=True).alone()) == 2  # what is said of missing values is turned
    assert count(fl.conjunction([fl.continuous("x", "less", 2, unknown=fl.IGNORE), fl.discrete("s", ["a"], unknown=fl.IGNORE)])) == 3
    assert count(fl.disjunction([fl.continuous("x", "less", 2, unknown=fl.IGNORE), fl.discrete("s", ["b"], unknown=fl.IGNORE)])) == 1
    assert count(fl.conjunction([])) == 4 and count(fl.disjunction([])) == 0
    yes, no = fl.split(df, fl.continuous("x", "less", 2).holds)
    assert (yes.count(), no.count()) == (1, 3)


def test_cuts(spark):
    df = spark.createDataFrame([(float(i), "a" if i < 40 else "b") for i in range(100)] + [(None, "a")], "x double, c string")
    assert tr.entropy_cuts(df, "x", "c") == [39.0]
    assert tr.equal_frequency_cuts(df, "x", 4) == [24.5, 49.5, 74.5]
    assert tr.equal_frequency_cuts(df.where("x < 3"), "x", 4) == [0.5, 1.5]
    assert tr.interval_labels([1, 2.5]) == ["<=1", "(1, 2.5]", ">2.5"]


def test_percentiles_and_density(spark):
    d = stats.distribution(spark.createDataFrame([(x,) for x in (1.0, 2.0, 4.0, 9.0)], "x double"), "x")
    assert [r.value for r in stats.percentiles(d, [0, 25, 50, 60, 100]).orderBy("percentile").collect()] == [1.0, 1.5, 3.0, 4.0, 9.0]
    assert stats.density(d, 3.0).first()[0] == 1.0 and stats.density(d, 20.0).first()[0] == 0.0


def test_special_functions(spark):
    assert special.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-10)
    assert special.f_tail(4.0, 2, 10) == pytest.approx((10 / 18) ** 5, abs=1e-10)
    assert special.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-9)
    assert special.normal_cdf(1.959963984540054) == pytest.approx(0.975, abs=1e-12)
    assert [special.bell(n) for n in range(6)] == [1, 1, 2, 5, 15, 52]
    assert spark.range(1, 2).select(special.erf(F.lit(0.5)).alias("x")).first().x == pytest.approx(math.erf(0.5))


def test_sampling_is_exact(spark):
    df = spark.range(103).withColumn("c", F.when(F.col("id") < 20, "a").otherwise("b"))
    sizes = sorted(r["count"] for r in sampling.folds(df, 10, ["id"], "c").groupBy("fold").count().collect())
    assert sizes == [10] * 7 + [11] * 3
    assert sampling.two_parts(df, 0.3, ["id"]).where("part = 0").count() == 31
    assert sampling.with_replacement(df, 500, ["id"]).count() == 500
    assert tr.add_missing(df.withColumn("x", F.lit(1)), "x", 0.25, ["id"]).where("x IS NULL").count() == 26


def test_rules(spark):
    baskets = spark.createDataFrame([(["a", "b"],), (["a", "b", "c"],), (["a"],), (["c"],)], "items array<string>")
    found = {(tuple(r.antecedent), tuple(r.consequent)): (r.support, r.confidence, r.lift) for r in rules.rules(baskets, 0.5, 0.6).collect()}
    assert found == {(("b",), ("a",)): (0.5, 1.0, pytest.approx(4 / 3)), (("a",), ("b",)): (0.5, pytest.approx(2 / 3), pytest.approx(4 / 3))}


def test_linear_regression(spark):
    df = spark.createDataFrame([(float(i), float(i * i % 7), 2.0 + 3.0 * i - 0.5 * (i * i % 7)) for i in range(20)], "a double, b double, y double")
    fit = learners.linear_regression(df, ["a", "b"], "y")
    assert [round(b, 6) for _, b, _, _ in fit] == [2.0, 3.0, -0.5]


def test_best_threshold(spark):
    df = spark.createDataFrame([(0.1, 0), (0.2, 0), (0.6, 1), (0.7, 0), (0.9, 1)], "p double, y int")
    r = learners.best_threshold(df, "p", "y").first()
    assert (r.threshold, r.ca) == (0.6, 0.8)


def test_graph_operators(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0)], "a long, b long, d double")
    assert sorted(map(tuple, graphs.pathfinder(e).collect())) == [(1, 2, 1.0), (2, 3, 1.0)]
    assert graphs.collapse(e, spark.createDataFrame([(1, 10), (2, 10)], "vertex long, grp long")).collect()[0]["n"] == 2


def test_merge_drops_missing_keys(spark):
    a = spark.createDataFrame([(1, "k"), (2, ""), (3, None), (4, "z")], "i long, k string")
    b = spark.createDataFrame([("k", 1, "x"), ("k", 0, "y"), ("", 5, "e"), (None, 6, "n")], "key string, o long, v string")
    assert sorted((r.i, r.v) for r in rel.merge_first(a, b, "k", "key", ["o"]).collect()) == [(1, "y"), (2, None), (3, None), (4, None)]


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(200).select((F.lit("2024-01-01").cast("timestamp") + F.make_interval(mins=F.col("id").cast("int"))).alias("ts"), (F.col("id") % 3).cast("string").alias("k"), F.col("id").cast("double").alias("v"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = online.windowed_stats(stream, "ts", "v", ["k"], "1 hour", "10 minutes").writeStream.outputMode("complete").format("memory").queryName("online_stats").start()
    q.processAllAvailable()
    q.stop()
    batch = online.windowed_stats(rows, "ts", "v", ["k"], "1 hour", "10 minutes")
    assert sorted(map(str, spark.table("online_stats").collect())) == sorted(map(str, batch.collect()))


@pytest.mark.parametrize("ending", ["csv", "txt"])
def test_a_file_is_read_once_for_kinds_and_values_and_once_for_its_rows(spark, tmp_path, ending):
    """No second look for the starts of files; a table by parts, whose rows may equal the header or hold white space only."""
    rows = [("mS#code", 1.0), ("\t", 2.0), ('a, "b"', None), (" \t ", 3.0), (None, 4.0), ("\\", 5.0), *((f"v{i}", float(i)) for i in range(40))]
    df = schema.with_roles(spark.createDataFrame(rows, "code string, x double").repartition(5), [schema.Variable("code", schema.STRING, schema.META), schema.Variable("x")])
    path = str(tmp_path / f"out.{ending}")
    writers.write(df, path)
    again = readers.read(spark, path)
    assert sorted(map(tuple, again.collect()), key=str) == sorted(((r[0].strip(" ") if r[0] else r[0], r[1]) for r in rows), key=str)
    plan = again._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Relation [") == 1
    # one column of white space, alone on its lines
    one = schema.with_roles(df.where("x IN (1, 2, 3) AND code NOT LIKE 'v%'"), [schema.Variable("code", schema.STRING, schema.META)])
    writers.write(one, path)
    assert sorted(r[0] for r in readers.read(spark, path).collect()) == ["\t", "\t", "mS#code"]


def test_every_file_has_the_header_and_a_table_without_rows_too(spark, tmp_path):
    df = spark.range(10).selectExpr("CAST(id AS double) AS x", "CAST(id % 2 AS string) AS c").repartition(4, "c")
    path = str(tmp_path / "out.csv")
    for table, n in ((df, 10), (df.where("x < 0"), 0)):
        with_roles = schema.with_roles(table, [schema.Variable("x"), schema.Variable("c", schema.DISCRETE, schema.CLASS, ("0", "1"))])
        writers.write(with_roles, path)
        files = [f.read_text().splitlines() for f in (tmp_path / "out.csv").glob("part-*") if f.stat().st_size]
        assert files and all(f[0] == files[0][0] for f in files) and sum(len(f) - 1 for f in files) == n
        again = readers.read(spark, path)
        assert again.columns == ["x", "c"] and again.count() == n and schema.class_column(again) == "c"


def test_short_and_long_lines_with_quotes(spark, tmp_path):
    """Short lines are padded, cells too many may be empty."""
    path = tmp_path / "t.csv"
    path.write_text('C#a,mS#b,D#c\n1\n2,"x, y"\n3,"x, ""y""",1,, \n"4",z,0\n')
    assert [(r[0], r[2]) for r in readers.read(spark, str(path)).collect()] == [(1.0, None), (2.0, None), (3.0, "1"), (4.0, "0")]
    path.write_text('C#a,mS#b,D#c\n1,b,0\n2,"x, y",1,more\n')
    with pytest.raises(Exception, match="invalid length.*x, y"):
        readers.read(spark, str(path)).collect()


@pytest.mark.parametrize("odd", [None, "mS#a\tword\tC#x", '"q"\tw\t1', "b\tw\t1\t \t", "\x01", "other"])
def test_files_of_plain_lines_need_no_parser(spark, tmp_path, odd):
    """Lines are cut at separators where that says all; one odd line, and Spark's reader takes the files. Both give the same rows."""
    header = "mS#a\tword\tC#x"
    lines = ["a\tw\t1,5", "?\t NA \t", "", "  ", "\t\t", " b \t~\t2", "?\t?\t3", "c", "\\\tv\tword", "d\tw\t4\t \t"[:5], *(f"r{i}\tw{i % 3}\t{i}" for i in range(90))]
    path = tmp_path / "t.txt"
    path.mkdir()
    for k in range(3):
        top, more = (odd, []) if k == 1 and odd == "other" else (header, [odd] if k == 1 and odd else [])
        (path / f"part-{k}").write_text("\n".join([top, *lines, *more]) + "\n")
    again = readers.read(spark, str(path))
    plan = again._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and ("Relation [value" in plan) == (odd is None)
    slow = readers._typed(readers._body(spark, str(path), "\t", 3, 1, schema.MISSING, '"'), schema.domain(again))
    assert sorted(map(str, again.collect())) == sorted(map(str, slow.collect()))
    assert again.count() == 3 * 96 + (odd not in (None, "\x01", "other"))
    assert {"w", "w0", "w1", "w2", "v"} <= set(next(v.values for v in schema.domain(again) if v.name == "word"))


def test_bytes_and_long_lines_of_plain_files(spark, tmp_path):
    path = tmp_path / "t.txt"
    path.write_bytes(b"word\tmS#b\na\t\xe4\nb\tx\n")
    assert sorted(map(tuple, readers.read(spark, str(path)).collect())) == [("a", "�"), ("b", "x")]
    path.write_text("word\tmS#b\na\tx\nb\ty\tz\n")
    with pytest.raises(Exception, match="invalid length.*b"):
        readers.read(spark, str(path)).count()

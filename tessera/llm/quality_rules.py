"""Quality rules with adaptive thresholds, in DataFrame expressions only.

Each text gets integer measures, of any size. For each language and source, every
measure has a mergeable quantile sketch with a bounded relative error (after
DDSketch, Masson et al., 2019): counts over buckets that are single numbers up to
2**BITS and from there on 2**(BITS - 1) to a doubling. Its size is bounded by the
buckets of 64 bits, not by the documents; sketches merge by adding counts, in any
order and with one result, from those of tasks to those of sources, languages, and
all; and a quantile is the true one, rounded down by less than one part in
2**(BITS - 1).

A document fails a rule if its measure lies outside the fences of its own
language and source, three interquartile ranges (or a least spread) beyond the
quartiles. Quartiles are shrunk towards those of the language, and these towards
those of all, with the weight of PRIOR documents, so that small sources borrow
from larger groups without a step. The fences are then joined to the documents.

A null text has no words, so it fails the base rule. Null language or source is
a value like any other. Repeated rows count each; other columns pass unread. An
empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ._dist import checkpoint_dir, cut

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Bits of a measure that a bucket keeps, and documents by whose weight quartiles are shrunk to those of the larger group.
BITS = 8
PRIOR = 200
FENCE = 3
#: Rows of fences that may be broadcast; more meet the documents by a shuffle.
MOST_BROADCAST = 100_000
#: Measure: whether low values fail, too, and the least spread.
MEASURES = {"symbols": (False, 20), "dup_lines": (False, 150), "repeats": (False, 150), "word_length": (True, 5), "upper": (False, 30), "shouts": (False, 20)}


def features(documents: DataFrame) -> DataFrame:
    """All columns of `documents`, and the counts and measures prefixed by `_q_`."""
    spaces = "[\\x20\\x09-\\x0D]+"
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, spaces), lambda w: w != "")
    one = documents.withColumns({
        "_q_words": words,
        "_q_lines": F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACES, "") != ""),
        "_q_chars": F.length(F.translate(text, SPACES, "")).cast("long"),
        "_q_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "_q_capitals": (F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long"),
        "_q_bangs": (F.length(text) - F.length(F.translate(text, "!", ""))).cast("long"),
    })
    w = F.col("_q_words")
    hashed = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("i")))
    windows = F.when(F.size(w) >= 3, F.sort_array(hashed)).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    two = one.withColumns({"_q_windows": windows, "_q_n_words": F.size(w).cast("long"), "_q_n_lines": F.size("_q_lines").cast("long"), "_q_n_dup": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long")})
    v, n = F.col("_q_windows"), F.size("_q_windows")
    pairs = F.zip_with(F.slice(v, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(v, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    found = F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull())))
    covered = F.size(F.array_distinct(F.flatten(F.transform(found, lambda i: F.array(i, i + 1, i + 2)))))
    three = two.withColumn("_q_repeat", covered.cast("long")).drop("_q_words", "_q_lines", "_q_windows")
    share = lambda a, b, scale=1000: F.expr(f"({a} * {scale}) div greatest({b}, 1)")
    measures = {"symbols": share("_q_symbols", "_q_chars"), "dup_lines": share("_q_n_dup", "_q_n_lines"), "repeats": share("_q_repeat", "_q_n_words"), "word_length": share("_q_chars", "_q_n_words", 10), "upper": share("_q_capitals", "_q_chars"), "shouts": share("_q_bangs", "_q_chars")}
    failed = (F.col("_q_n_words") < 50) | (100 * F.col("_q_repeat") > 50 * F.col("_q_n_words"))
    return three.withColumns({f"_q_m_{k}": v for k, v in measures.items()} | {"_q_failed": failed})


def bucket(x: Column) -> Column:
    """The least number of a measure's bucket: its highest BITS bits."""
    low = F.greatest(F.length(F.bin(x)) - BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", x, low), low)


def sketches(scored: DataFrame) -> DataFrame:
    """lang, source, measure, bin, n: the sketches of all languages and sources."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), bucket(F.col(f"_q_m_{k}")).alias("bin")) for k in MEASURES]))
    return scored.select("lang", "source", each.alias("x")).groupBy("lang", "source", "x.measure", "x.bin").agg(F.count(F.lit(1)).alias("n"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """keys, measure, and a struct of n, q1 and q3, from the merged sketch of each key."""
    parts = sketch.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))
    # a sketch has a bounded number of buckets
    whole = Window.partitionBy(*keys, "measure")
    cum = parts.withColumns({"cum": F.sum("n").over(whole.orderBy("bin")), "total": F.sum("n").over(whole)})
    at = lambda share: F.min(F.when(4 * F.col("cum") >= share * F.col("total"), F.col("bin"))).cast("double")
    return cum.groupBy(*keys, "measure").agg(F.struct(F.max("total").cast("double").alias("n"), at(1).alias("q1"), at(3).alias("q3")).alias("q"))


def fences(sketch: DataFrame) -> DataFrame:
    """lang, source, and low_ and high_ of each measure."""
    own = quartiles(sketch, ["lang", "source"])
    lang = quartiles(sketch, ["lang"]).select(F.col("lang").alias("_lang"), F.col("measure").alias("_m2"), F.col("q").alias("l"))
    every = quartiles(sketch, []).select(F.col("measure").alias("_m3"), F.col("q").alias("e"))
    # `every` has a row for each measure
    both = own.join(lang, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("measure") == F.col("_m2"))).join(F.broadcast(every), F.col("measure") == F.col("_m3"))
    shrunk = lambda a, q, b: (F.col(f"{a}.n") * F.col(f"{a}.{q}") + PRIOR * b) / (F.col(f"{a}.n") + PRIOR)
    q1, q3 = (shrunk("q", q, shrunk("l", q, F.col(f"e.{q}"))) for q in ("q1", "q3"))
    least = F.create_map(*[F.lit(x) for k, (_, spread) in MEASURES.items() for x in (k, float(spread))])[F.col("measure")]
    reach = FENCE * F.greatest(q3 - q1, least)
    limits = both.select("lang", "source", "measure", (q1 - reach).alias("low"), (q3 + reach).alias("high"))
    return limits.groupBy("lang", "source").agg(*[F.max(F.when(F.col("measure") == k, F.col(side))).alias(f"_q_{side}_{k}") for k in MEASURES for side in ("low", "high")])


def judged(scored: DataFrame, limits: DataFrame) -> DataFrame:
    """`scored` with `_q_kept`."""
    limits = cut(limits.withColumnsRenamed({"lang": "_q_lang", "source": "_q_source"}))
    if limits.count() <= MOST_BROADCAST:
        limits = F.broadcast(limits)
    both = scored.join(limits, F.col("lang").eqNullSafe(F.col("_q_lang")) & F.col("source").eqNullSafe(F.col("_q_source")), "left")
    fine: Column = ~F.col("_q_failed")
    for k, (two_sided, _) in MEASURES.items():
        fine = fine & (F.col(f"_q_m_{k}") <= F.col(f"_q_high_{k}"))
        if two_sided:
            fine = fine & (F.col(f"_q_m_{k}") >= F.col(f"_q_low_{k}"))
    return both.withColumn("_q_kept", F.coalesce(fine, F.lit(False)))


def verdicts(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept of every row."""
    scored = features(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source")).drop("text")
    scored = cut(scored)
    names = {"_q_n_words": "n_words", "_q_chars": "word_chars", "_q_symbols": "n_symbols", "_q_n_dup": "n_dup_lines", "_q_repeat": "n_repeat_words", "_q_failed": "base_failed", "_q_kept": "kept"}
    return judged(scored, fences(sketches(scored))).select("doc_id", *[F.col(a).alias(b) for a, b in names.items()])


def keep(documents: DataFrame) -> DataFrame:
    """The rows of `documents` that pass, unchanged.

    Measures are computed once and written beside the rows, as Parquet in the shared folder.
    """
    spark = documents.sparkSession
    folder = f"{checkpoint_dir(spark)}/measured-{uuid.uuid4().hex}"
    # small row groups, so that writers hold little
    features(documents).write.option("parquet.block.size", 32 << 20).parquet(folder)
    scored = spark.read.parquet(folder)
    return judged(scored, fences(sketches(scored))).where("_q_kept").select(*documents.columns)


def oracle() -> str:
    """DuckDB SQL for `verdicts`."""
    bucket = lambda x: f"((({x}) >> greatest(length(bin({x})) - {BITS}, 0)) << greatest(length(bin({x})) - {BITS}, 0))"
    share = lambda a, b, scale=1000: f"({a} * {scale}) // greatest({b}, 1)"
    measures = {"symbols": share("n_symbols", "word_chars"), "dup_lines": share("n_dup_lines", "n_lines"), "repeats": share("n_repeat_words", "n_words"), "word_length": share("word_chars", "n_words", 10), "upper": share("capitals", "word_chars"), "shouts": share("bangs", "word_chars")}
    levels = {"own": ("lang", "source"), "lang": ("lang", "NULL"), "all": ("NULL", "NULL")}
    spread = " ".join(f"WHEN '{k}' THEN {s}::DOUBLE" for k, (_, s) in MEASURES.items())
    bounds = " AND ".join(f"f.m_{k} <= p.high_{k}" + (f" AND f.m_{k} >= p.low_{k}" if two else "") for k, (two, _) in MEASURES.items())
    return rf"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM t
), grams AS (
  SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)
), again AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM grams) WHERE n > 1
), reps AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid
), c AS (
  SELECT w.rid, doc_id, lang, source, len(words)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::BIGINT AS capitals,
    (length(text) - length(replace(text, '!', '')))::BIGINT AS bangs,
    len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(reps.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN reps ON w.rid = reps.rid
), f AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, {", ".join(f"({v})::BIGINT AS m_{k}" for k, v in measures.items())} FROM c
), sk AS (
  {" UNION ALL ".join(f"SELECT lang, source, '{k}' AS measure, {bucket(f'm_{k}')} AS bin, count(*) AS n FROM f GROUP BY ALL" for k in MEASURES)}
), lv AS (
  {" UNION ALL ".join(f"SELECT '{lv}' AS level, {a}::VARCHAR AS lang, {b}::VARCHAR AS source, measure, bin, sum(n)::BIGINT AS n FROM sk GROUP BY ALL" for lv, (a, b) in levels.items())}
), cu AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY bin) AS cum, sum(n) OVER (PARTITION BY level, lang, source, measure) AS total FROM lv
), qu AS (
  SELECT level, lang, source, measure, max(total)::DOUBLE AS total, (min(bin) FILTER (4 * cum >= total))::DOUBLE AS q1, (min(bin) FILTER (4 * cum >= 3 * total))::DOUBLE AS q3
  FROM cu GROUP BY level, lang, source, measure
), pick AS (
  SELECT lang, source, measure, q1 - reach AS low, q3 + reach AS high
  FROM (SELECT *, ({FENCE} * greatest(q3 - q1, CASE measure {spread} END))::DOUBLE AS reach FROM (
    SELECT o.lang, o.source, o.measure, {", ".join(f"(o.total * o.{q} + {PRIOR} * ((l.total * l.{q} + {PRIOR} * e.{q}) / (l.total + {PRIOR}))) / (o.total + {PRIOR}) AS {q}" for q in ("q1", "q3"))}
    FROM qu o JOIN qu l ON l.level = 'lang' AND l.lang IS NOT DISTINCT FROM o.lang AND l.measure = o.measure
      JOIN qu e ON e.level = 'all' AND e.measure = o.measure WHERE o.level = 'own'))
), p AS (
  SELECT lang, source, {", ".join(f"max(low) FILTER (measure = '{k}') AS low_{k}, max(high) FILTER (measure = '{k}') AS high_{k}" for k in MEASURES)} FROM pick GROUP BY lang, source
)
SELECT f.doc_id, f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, f.base_failed,
  coalesce(NOT f.base_failed AND {bounds}, false) AS kept
FROM f LEFT JOIN p ON f.lang IS NOT DISTINCT FROM p.lang AND f.source IS NOT DISTINCT FROM p.source
"""

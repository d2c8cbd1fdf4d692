"""The pipeline's stages, each on what the one before kept."""

from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from tessera.llm import packing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    folder = tmp_path_factory.mktemp("stages")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], SF).write.parquet(str(folder / str(k)))
        out.append(spark.read.parquet(str(folder / str(k))))
    return out


def test_stages_hand_on_documents(stages):
    for df in stages[1:-1]:
        assert df.dtypes == stages[0].dtypes
    sizes = [df.count() for df in stages[:-1]]
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > sizes[0] * 0.4


def test_decisions_take_effect(stages, spark):
    from tessera.llm import packing, quality_rules, substring_dedup

    kept = {r.doc_id for r in quality_rules.verdicts(stages[0]).where("kept").collect()}
    assert {r.doc_id for r in stages[1].collect()} == kept
    before = {r.doc_id: r for r in substring_dedup.remove_repeats(stages[3]).collect()}
    after = stages[4].collect()
    assert all(len(r.text.split()) == before[r.doc_id].n_words - before[r.doc_id].n_removed and r.n_chars == len(r.text) for r in after)
    packed = stages[5].collect()
    assert Counter(r.doc_id for r in packed) == Counter(r.doc_id for r in packing.pieces(stages[4], packing.vocabulary_path(), 2048).collect())


def test_run_is_the_stages(spark, stages):
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, SF).select(*names).collect()) == Counter(tuple(r) for r in stages[5].select(*names).collect())


def test_run_equals_brute_force(spark, stages):
    """All stages again, plainly: the rules by SQL, the classifier and its scores in one process, pairs of sets, windows in a dictionary, the tokenizers library."""
    import zlib

    import duckdb
    import numpy as np
    from tessera.llm import quality_rules, toxicity
    from test_text_operators import dedup, near
    from tokenizers import Tokenizer

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    rows = con.sql("SELECT doc_id, text, lang, source FROM documents").fetchall()
    assert len({r[0] for r in rows}) == len(rows)
    fine = {r[0] for r in con.sql(f"SELECT doc_id FROM ({quality_rules.oracle()}) WHERE kept").fetchall()}
    rows = [r for r in rows if r[0] in fine]
    labels = dict(con.sql(f"SELECT doc_id, toxic FROM '{SF}/labels.parquet' WHERE toxic IN (0, 1)").fetchall())
    # only the order of examples is asked of Spark
    order = {r.i: k for k, r in enumerate(spark.createDataFrame([(r[0],) for r in rows], "i long").orderBy(F.xxhash64("i"), "i").collect())}
    taught = sorted((r for r in rows if r[0] in labels and zlib.crc32(str(r[0]).encode()) % 4 != 2), key=lambda r: order[r[0]])
    scorer = toxicity.Scorer(*toxicity.fit([r[1] or "" for r in taught], [float(labels[r[0]]) for r in taught]))
    scores = scorer.score([r[1] or "" for r in rows])
    rows = [r for r, s in zip(rows, scores, strict=True) if s < toxicity.THRESHOLD]
    assert {r.doc_id for r in stages[2].collect()} == {r[0] for r in rows}
    stay = {i for i, n, c in near(rows, 5, 80) if not n or c == i}
    rows = [r for r in rows if r[0] in stay]
    assert {r.doc_id for r in stages[3].collect()} == stay
    texts = {i: " ".join(kept) for i, _, kept in dedup(rows, 35)}
    assert {r.doc_id: r.text for r in stages[4].collect()} == texts
    library = Tokenizer.from_file(packing.vocabulary_path())
    expected = Counter()
    for i, text in texts.items():
        ids = library.encode(text, add_special_tokens=False).ids + [0]
        for p in range(-(-len(ids) // 2048)):
            part = ids[2048 * p : 2048 * p + 2048]
            expected[i, p, 2048 * p, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    fill = Counter()
    for r in got:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048 and len(fill) <= -(-sum(fill.values()) // 2048) + 1

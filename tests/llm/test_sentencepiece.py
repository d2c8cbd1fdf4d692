"""SentencePiece encoding, decoding and digests against the library."""

import random
import time
from collections import Counter

import pytest
import sentencepiece
from tessera.llm import sentencepiece_codec as codec

TEXTS = ["", None, "  a  b ", "नमस्ते 🎉 x\n\ty", " ", "aaaa" * 9, "▁x ▁", "a\r\nb", "The quick brown fox, the quick brown fox.", "Größe élan señor", "the the the", "a" * 70, "abcde" * 40, "x" * 61, "é" * 60 + " \u0000 ###!!"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=codec.model_path())


@pytest.fixture(scope="module")
def rows(corpus):
    return [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, "no id"), (None, None)] + [(100 + k, t) for k, (_, t, _, _) in enumerate(corpus) if t is None or len(t) < 2000]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, 3, "k", 1.5) for i, t in rows], "doc_id long, text string, ids int, unit string, decoded double")


def plain(library, text):
    """The digest columns from the library's own ids and text."""
    ids = library.encode(text or "")
    begun = digest = single = 0
    for i in ids:
        digest += (i + 1) * (2 * begun + 1)
        if library.is_byte(i):
            single += 1
            begun += int(library.id_to_piece(i)[3:5], 16) & 0xC0 != 0x80
        else:
            begun += len(library.id_to_piece(i))
    decoded = library.decode(ids) if ids else ""
    return len(ids), single, digest % 2**31, len(decoded), sum(ord(c) * (2 * k + 3) for k, c in enumerate(decoded)) % 2**31


def test_encode_and_decode_equal_the_library(docs, rows, library):
    encoded = codec.encode(docs)
    assert encoded.columns == ["doc_id", "text", "unit", "decoded", "ids"]
    assert Counter((r.doc_id, r.text, tuple(r.ids)) for r in encoded.collect()) == Counter((i, t, tuple(library.encode(t or ""))) for i, t in rows)
    decoded = codec.decode(encoded)
    assert decoded.columns == ["doc_id", "text", "unit", "ids", "decoded"]
    assert all(r.decoded == (r.text or "").replace("▁", " ") for r in decoded.collect())


def test_digests_equal_the_library(docs, rows, library, monkeypatch):
    expected = Counter((i, *plain(library, t)) for i, t in rows)
    assert Counter(tuple(r) for r in codec.digests(docs).collect()) == expected
    # the table of frequent units changes nothing
    monkeypatch.setattr(codec, "FREQUENT", 3)
    assert Counter(tuple(r) for r in codec.digests(docs).collect()) == expected


def test_empty_tables(docs):
    assert codec.encode(docs.limit(0)).collect() == []
    assert codec.decode(codec.encode(docs.limit(0))).collect() == []
    assert codec.digests(docs.limit(0)).collect() == []


def test_decoding_any_ids(spark, library):
    rng = random.Random(2)
    lists = [[rng.choice([rng.randrange(32000), rng.randrange(3, 259)]) for _ in range(rng.randint(0, 9))] for _ in range(3000)]
    lists += [[131], [240, 159, 142], [3 + 0xE4, 3 + 0xBD, 300], [0], [1, 2]]
    df = spark.createDataFrame([*((x,) for x in lists), ([None, 300, -1, 10**6],), (None,)], "ids array<int>")
    got = [(r.ids, r.decoded) for r in codec.decode(df).collect()]
    assert all(text == (library.decode(ids) if ids else "") for ids, text in got[: len(lists)])
    assert got[-2][1] == library.decode([300]) and got[-1] == (None, "")


def test_long_words_take_little_time(spark, library):
    rng = random.Random(4)
    texts = ["".join(rng.choice("etaoinshr") for _ in range(20_000)), "a" * 20_000, "字" * 20_000]
    start = time.monotonic()
    got = codec.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert time.monotonic() - start < 10
    assert all(r.ids == library.encode(r.text) for r in got)


def unigram_model(path):
    """A small unigram model, its pieces and scores put down by hand."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    m = proto.ModelProto()
    m.trainer_spec.model_type = codec.UNIGRAM
    m.trainer_spec.byte_fallback = True
    m.normalizer_spec.name = "identity"
    m.normalizer_spec.add_dummy_prefix = True
    m.normalizer_spec.remove_extra_whitespaces = False
    for piece, kind in (("<unk>", 2), ("<s>", 3), ("</s>", 3), *((f"<0x{b:02X}>", 6) for b in range(256))):
        m.pieces.add(piece=piece, score=0.0, type=kind)
    rng = random.Random(8)
    pieces = {"▁", *"abcdefg", *("".join(rng.choice("▁abcdefg") for _ in range(rng.randint(2, 5))) for _ in range(150))}
    for piece in sorted(pieces):
        m.pieces.add(piece=piece, score=-1 - 3 * rng.random() - len(piece), type=1)
    path.write_bytes(m.SerializeToString())
    return str(path)


def test_viterbi_for_a_unigram_model(spark, tmp_path):
    path = unigram_model(tmp_path / "unigram.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcdefg  é!") for _ in range(rng.randint(0, 70))) for _ in range(200)] + ["abc" * 40, "h" * 80]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert all(r.ids == library.encode(r.text) for r in codec.encode(docs, path).collect())
    assert Counter(tuple(r) for r in codec.digests(docs, path).collect()) == Counter((i, *plain(library, t)) for i, t in enumerate(texts))


def test_both_ways_of_segmenting_agree(spark, library):
    """Units short enough for the fold, by the worker's walk."""
    model = codec.load(codec.model_path())
    rng = random.Random(6)
    units = {"".join(rng.choice("▁aeinrstlo") for _ in range(rng.randint(1, codec.SHORT))) for _ in range(300)}
    df = spark.createDataFrame([(u,) for u in units], "unit string")
    assert all(r.ids == model.segment(r.unit) for r in codec.lattices(df, codec.model_path()).collect())

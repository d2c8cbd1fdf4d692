"""Operators on texts against plain versions of what they promise."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera.llm import ngram_join, packing, quality_rules, sharding, substring_dedup, token_counts
from tessera.llm.wordbpe import WordBpe, vocabulary_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall(t or "")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path())


ODD = ["it's IT'S don’t ΣΑΣ Σ. İstanbul é Å a\x1cb a\u0085b a​b <|endoftext|> x <|END", "<|startoftext|>a", "ﬁ Ⅷ ²³ 🎉🎉 नमस्ते ẞ ŉ", "'ſ 'S", "a 　b", "", "a" * 300 + ". x, x,, 1. .", "x" * 70 + " " + "x" * 70 + ","]


def test_word_table_equals_library(library, corpus):
    texts = ODD + [t or "" for _, t, _, _ in corpus]
    small = WordBpe(vocabulary_path(), cache=50)  # the table starts anew again and again
    for tok in (WordBpe(vocabulary_path()), small):
        for a in range(0, len(texts), 7):
            got = tok.encode_many(texts[a : a + 7])
            assert [np.frombuffer(x, "<u4").tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in texts[a : a + 7]]


def test_token_counts(spark, documents, nothing, corpus, library):
    expected = Counter((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, _, _ in corpus)
    rows = token_counts.token_counts(documents).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in rows) == expected
    assert all(r.over_limit == (r.n_tokens > 2048) for r in rows)
    odd = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(odd).collect()} == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in enumerate(ODD)}
    assert token_counts.token_counts(nothing).collect() == []


def dedup(corpus, width):
    tokens = [words(t) for _, t, _, _ in corpus]
    seen = Counter(tuple(w[k : k + width]) for w in tokens for k in range(len(w) - width + 1))
    for (i, *_), w in zip(corpus, tokens, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k : k + width])] > 1:
                gone[k : k + width] = [True] * width
        yield i, w, [x for x, g in zip(w, gone, strict=True) if not g]


def test_substring_dedup(documents, nothing, corpus):
    expected = Counter((i, len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()) for i, w, kept in dedup(corpus, 35))
    rows = substring_dedup.remove_repeats(documents).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows) == expected
    joined = substring_dedup.remove_repeats(documents, joined=True)
    assert joined.columns == documents.columns
    assert Counter((r.doc_id, r.text) for r in joined.collect()) == Counter((i, " ".join(kept)) for i, _, kept in dedup(corpus, 35))
    assert substring_dedup.remove_repeats(nothing).collect() == []


def test_null_ids_with_one_32_bit_hash_are_told_apart(spark):
    """The first two texts have one 32-bit hash, as ids of null have no other key."""
    shared = " ".join(f"w{k}" for k in range(40))
    rows = [(None, f"{shared} a113806", None, None), (None, "b232398", None, None), (1, shared, None, None)]
    got = substring_dedup.remove_repeats(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").coalesce(1)).collect()
    expected = Counter((i, len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()) for i, w, kept in dedup(rows, 35))
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == expected


def test_equal_rows_send_their_marks_once(spark):
    text = " ".join(f"w{k}" for k in range(200))
    marks = substring_dedup.repeated_windows(spark.createDataFrame([(None, text)] * 9, "doc_id long, text string").repartition(3)).collect()
    assert marks and len(marks) == len({(r.doc_id, r.key, r.first) for r in marks})
    assert sum(bin(r.mask % (1 << 64)).count("1") for r in marks) == 200 - 34


def test_a_passage_in_all_texts(spark):
    """Its grams come last in the order, its copies are marked where they are; results are those of the plain rule."""
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = " ".join(word() for _ in range(50))
    rows = [(i, f"{' '.join(word() for _ in range(rng.randint(0, 60)))} {passage} {' '.join(word() for _ in range(rng.randint(0, 60)))}", None, None) for i in range(120)]
    rows += [(i, " ".join(word() for _ in range(90)), None, None) for i in range(120, 180)] + [(7, rows[7][1], None, None)] * 3
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(5)
    assert len(substring_dedup.common_grams(df, 3, df.count()).hashes) >= 48
    got = substring_dedup.remove_repeats(df).collect()
    expected = Counter((i, len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()) for i, w, kept in dedup(rows, 35))
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == expected


def test_many_equal_rows_take_little_more_time(spark):
    import time

    text = " ".join(f"w{k}" for k in range(400))
    took = []
    for n in (200, 200, 1600):
        df = spark.createDataFrame([(1, text)] * n, "doc_id long, text string").repartition(4)
        start = time.monotonic()
        assert {r.n_removed for r in substring_dedup.remove_repeats(df).collect()} == {400}
        took.append(time.monotonic() - start)
    assert took[2] < 3 * took[1] + 2


def test_equal_window_hashes_are_told_apart_by_words(monkeypatch, corpus):
    """With a hash that says nothing, words alone decide."""
    from tessera.llm._text import Words

    texts = [(t or "").encode() for _, t, _, _ in corpus[:25]]
    w = Words(texts)
    count = np.maximum(w.count - 34, 0)
    keep = np.flatnonzero(count)
    w2 = Words([texts[i] for i in keep])
    honest = substring_dedup._repeated(np.minimum(count[keep], 30), np.ones(len(keep), int), w2, 35)
    monkeypatch.setattr(substring_dedup, "span_hashes", lambda buf, a, b: np.zeros(len(a), np.uint64))
    assert substring_dedup._repeated(np.minimum(count[keep], 30), np.ones(len(keep), int), w2, 35).tolist() == honest.tolist()


def shingles(t, size):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def near(corpus, size, percent):
    sets = [shingles(t, size) for _, t, _, _ in corpus]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups = defaultdict(list)
    for k, (i, *_) in enumerate(corpus):
        groups[find(k)].append(i)
    return [(i, len(sets[k]), min((x for x in groups[find(k)] if x is not None), default=None) if sets[k] else i) for k, (i, *_) in enumerate(corpus)]


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80)])
def test_ngram_join(documents, nothing, corpus, size, percent):
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(documents, size, percent).collect())
    assert got == Counter(near(corpus, size, percent))
    if size == 5:
        kept = ngram_join.keep_one(documents)
        assert kept.columns == documents.columns
        assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, n, c in near(corpus, 5, 80) if not n or c is None or c == i)
        assert ngram_join.keep_one(nothing).collect() == []


def test_divide_skip_counts():
    rng = np.random.default_rng(3)
    for _ in range(300):
        lists = [sorted(rng.choice(40, rng.integers(0, 30), replace=False).tolist()) for _ in range(rng.integers(1, 25))]
        least = int(rng.integers(1, 12))
        expected = {i: n for i, n in Counter(x for li in lists for x in li).items() if n >= least}
        assert ngram_join.divide_skip(lists, least, mu=float(rng.choice([0.01, 0.3, 2]))) == expected


def test_second_round_finds_what_stars_miss():
    """A posting list whose first member links with no other."""
    x = {"token": np.array([5, 5, 5], np.uint64), "cid": np.array([1, 2, 3]), "comp": np.array([1, 2, 3]), "n": np.array([20, 20, 20]), "pos": np.array([0, 1, 1])}
    stars = {tuple(sorted(p)) for p in zip(*(c.tolist() for c in ngram_join.star_pairs(x, 85)), strict=True)}
    cross = {tuple(sorted(p)) for p in zip(*(c.tolist() for c in ngram_join.cross_pairs(x, 85)), strict=True)}
    assert stars == {(1, 2), (1, 3)}
    assert cross == {(1, 2), (1, 3), (2, 3)}


def test_classes_without_a_first_round_pair_are_linked(spark):
    """H, C, Y, D in one list: C and D link, but neither fits the head H nor the one before it."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(9))
    sets = lambda texts: ngram_join.shingle_sets([t.encode() for t in texts], 4)
    bodies = [[word() for _ in range(15)] for _ in range(100)]
    body = min(bodies, key=lambda w: abs(float(sets([" ".join(w)])[0][0]) / 2**64 - 0.003))  # few shingles come before its first
    t = sets([" ".join(body)])[0][0]
    at = next(k for k in range(12) if t in sets([" ".join([*body[k : k + 4], "q"])])[0] and t not in sets([" ".join([*body[k + 1 : k + 4], "q", "q"])])[0])
    heads = [" ".join([word(), *body]) for _ in range(20_000)]
    heads = [(ngram_join.digest(s)[0], x) for x, s in zip(heads, sets(heads), strict=True) if s[1] == t]
    (low, c), (high, d) = min(heads), max(heads)
    longs = [" ".join([word() for _ in range(50)] + body[at : at + 4] + [word() for _ in range(50)]) for _ in range(3000)]
    places = [(int(np.searchsorted(s, t)), ngram_join.digest(s)[0], x) for x, s in zip(longs, sets(longs), strict=True)]
    h = next(x for p, _, x in places if p == 0)
    y = next(x for p, cid, x in places if p == 1 and low < cid < high)
    rows = [(1, h, None, None), (2, c, None, None), (3, y, None, None), (4, d, None, None)]
    expected = near(rows, 4, 85)
    assert [x for *_, x in expected] == [1, 2, 3, 2]
    got = ngram_join.join(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(expected)


def test_long_posting_lists_are_dealt_over_parts(spark):
    """A shingle in a fifth of all texts, a large group of near copies, and parts of a few members each."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(5))
    common, base = [word() for _ in range(4)], [word() for _ in range(60)]
    texts = []
    for k in range(400):
        w = [word() for _ in range(rng.randint(4, 30))] + common * (k % 5 == 0)
        if k % 3 == 0:
            w = [*base[: rng.randint(20, 60)]]
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    texts += [" ".join(common + [word()]) for _ in range(30)] + [" ".join([word(), *common]) for _ in range(30)]
    rows = [(i, t, None, None) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    expected = Counter(near(rows, 4, 60))
    for list_size in (3, 20):
        got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(docs, 4, 60, sample=1, list_size=list_size).collect())
        assert got == expected


def test_every_two_members_of_a_list_in_parts_meet():
    rng = np.random.default_rng(6)
    members, parts = 50, 5
    x = {"token": np.full(members, 9, np.uint64), "cid": rng.integers(-(2**60), 2**60, members), "comp": np.arange(members), "n": np.full(members, 20), "pos": np.zeros(members, int)}
    y = ngram_join._parted(x, np.full(members, parts), True)
    order = np.lexsort((y["cid"], y["pos"], y["token"]))
    found = ngram_join.cross_pairs({k: v[order] for k, v in y.items()}, 85)
    pairs = Counter(tuple(sorted(p)) for p in zip(*(c.tolist() for c in found), strict=True))
    assert len(pairs) == members * (members - 1) // 2
    alone = ngram_join._parted(x, np.full(members, parts), False)
    assert len(alone["token"]) == members and len(set(alone["token"].tolist())) == parts


def test_packing(documents, nothing, corpus, library):
    rows = packing.pack(documents).collect()
    ids = [library.encode(t or "", add_special_tokens=False).ids + [0] for _, t, _, _ in corpus]
    expected = Counter((i, p, 2048 * p, len(x[2048 * p : 2048 * p + 2048]), zlib.crc32(np.array(x[2048 * p : 2048 * p + 2048], "<u4").tobytes())) for (i, *_), x in zip(corpus, ids, strict=True) for p in range(-(-len(x) // 2048)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) == -(-sum(map(len, ids)) // 2048)  # no packing needs fewer
    assert packing.pack(nothing).collect() == []


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(1)
    for capacity in (10, 50, 200):
        counts = {int(n): int(rng.integers(1, 40)) for n in rng.integers(1, capacity + 1, 12)}
        fill, used = Counter(), Counter()
        for length, first, sequence, times, offset in packing.plan(counts, capacity):
            assert first == used[length]
            used[length] += times
            for s in range(sequence, sequence + times):
                assert fill[s] == offset
                fill[s] += length
        assert used == Counter(counts)
        assert max(fill.values()) <= capacity
        best = packing.fullest(counts, sorted(counts, reverse=True), capacity)
        reach = {0}
        for n, c in counts.items():
            reach = {x + k * n for x in reach for k in range(c + 1) if x + k * n <= capacity}
        assert sum(n * m for n, m in best.items()) == max(reach)
        assert all(m <= counts[n] for n, m in best.items())


def test_sharding(documents, nothing, corpus):
    rows = sharding.shard(documents).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _, _ in corpus)
    where, slots, sums = defaultdict(set), defaultdict(list), Counter()
    for r in rows:
        where[r.text_crc32].add(r.shard)
        slots[r.shard].append(r.slot)
        sums[r.shard] += r.size
        assert r.law == "bytes" and r.grown_shard is None
    assert all(len(s) == 1 for s in where.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    heaviest = max(Counter({t: sum(len((x or "").encode()) + 1 for _, x, _, _ in corpus if (x or "") == (t or "")) for _, t, _, _ in corpus}).values())
    assert max(sums.values()) <= max(heaviest, sum(sums.values()) / 16 * 1.2)
    assert sharding.shard(nothing).collect() == []


def test_differencing_beats_greedy():
    rng = np.random.default_rng(2)
    weights = rng.integers(1, 10_000, 400).tolist()
    loads = Counter()
    for w, s in zip(weights, sharding.differencing(weights, 4), strict=True):
        loads[s] += w
    greedy = [0] * 4
    for w in sorted(weights, reverse=True):
        greedy[greedy.index(min(greedy))] += w
    assert max(loads.values()) - min(loads.values()) <= max(greedy) - min(greedy)
    assert sharding.differencing([], 4) == [] and sharding.differencing([5], 4) in ([0], [1], [2], [3])


def plain_differencing(weights, shards):
    """Karmarkar and Karp, with lists: the sums of the shards."""
    parts = [(w, i, [0] * (shards - 1) + [w]) for i, w in enumerate(weights)]
    serial = len(parts)
    while len(parts) > 1:
        parts.sort(key=lambda p: (-p[0], p[1]))
        a, b = parts[0][2], parts[1][2]
        both = sorted(x + y for x, y in zip(a, reversed(b), strict=True))
        both = [x - both[0] for x in both]
        parts = [*parts[2:], (both[-1], serial, both)]
        serial += 1
    return parts[0][2] if parts else [0] * shards


def test_differencing_equals_a_plain_version():
    rng = random.Random(4)
    for shards in (2, 3, 16):
        weights = [rng.randint(1, 5000) for _ in range(rng.randint(1, 120))]
        sums = [0] * shards
        for w, s in zip(weights, sharding.differencing(weights, shards), strict=True):
            sums[s] += w
        low = min(sums)
        assert sorted(x - low for x in sums) == plain_differencing(weights, shards)


def test_small_tables_are_differenced_plainly(spark):
    """All groups weigh much, so that all are items of one differencing."""
    rng = random.Random(8)
    texts = ["x" * rng.randint(0, 400) + str(i) for i in range(150)] + ["copy"] * 20 + ["", None, None]
    rows = sharding.shard(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    groups = Counter()
    for x in texts:
        groups[hashlib.md5((x or "").encode()).digest()] += len((x or "").encode()) + 1
    sums = Counter({s: 0 for s in range(16)})
    for r in rows:
        sums[r.shard] += r.size
    low = min(sums.values())
    assert sorted(x - low for x in sums.values()) == plain_differencing([groups[k] for k in sorted(groups)], 16)


def test_subsets_of_light_groups_are_near_equal(spark):
    rng = random.Random(5)
    groups = [(bytes([k // 256, k % 256]), rng.randint(1, 3000)) for k in range(3000)]
    rows = sharding.subsets(spark.createDataFrame(groups, "_group binary, weight long").repartition(3), 16).collect()
    weight = dict(groups)
    sums = Counter()
    for r in rows:
        if r["_group"] is not None:
            sums[r.part, r.subset] += weight[bytes(r["_group"])]
    assert sums == Counter({(r.part, r.subset): r.weight for r in rows if r["_group"] is None})
    for part in {p for p, _ in sums}:
        own = [w for (p, _), w in sums.items() if p == part]
        assert max(own) - min(own) <= 3000


def test_quality_rules_equal_sql(documents, nothing, corpus):
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    con.register("documents", pd.DataFrame(corpus, columns=["doc_id", "text", "lang", "source"]).astype({"doc_id": "Int64"}))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    expected = Counter(con.sql(quality_rules.oracle()).select(*names).fetchall())
    assert Counter(tuple(r) for r in quality_rules.verdicts(documents).select(*names).collect()) == expected
    kept = quality_rules.keep(documents)
    assert kept.columns == documents.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter({k[0]: 0 for k in expected} | Counter(k[0] for k in expected.elements() if k[-1]))
    assert quality_rules.verdicts(nothing).collect() == []


def test_sketches_keep_their_error_and_merge(spark):
    rng = random.Random(21)
    values = [int(10 ** rng.uniform(0, 12)) for _ in range(3000)] + list(range(400))
    df = spark.createDataFrame([(rng.choice("ab"), rng.choice("xyz"), v) for v in values], "lang string, source string, v long").select("lang", "source", *[F.col("v").alias(f"_q_m_{k}") for k in quality_rules.MEASURES])
    sketch = quality_rules.sketches(df)
    for keys in ([], ["lang"], ["lang", "source"]):
        exact = {tuple(r[k] for k in keys): (r.q1, r.q3, r.n) for r in df.groupBy(*keys).agg(F.expr("percentile_disc(0.25) WITHIN GROUP (ORDER BY _q_m_upper)").alias("q1"), F.expr("percentile_disc(0.75) WITHIN GROUP (ORDER BY _q_m_upper)").alias("q3"), F.count("*").alias("n")).collect()}
        for r in quality_rules.quartiles(sketch, keys).collect():
            q1, q3, n = exact[tuple(r[k] for k in keys)]
            assert r.q.n == n
            for got, want in ((r.q.q1, q1), (r.q.q3, q3)):
                assert got <= want < got * (1 + 2**-7) + 1
    small = spark.range(256).select(quality_rules.bucket(F.col("id")).alias("b"), "id")
    assert small.where("b <> id").isEmpty()


def test_quality_measures_by_hand(spark):
    text = "a b c a b c\nxx ## é\n\na b c a b c\n"
    r = quality_rules.verdicts(spark.createDataFrame([(1, text, "en", "s")], "doc_id long, text string, lang string, source string")).first()
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.base_failed, r.kept) == (15, 17, 2, 1, True, False)
    w = words(text)
    grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    assert r.n_repeat_words == len({k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)})

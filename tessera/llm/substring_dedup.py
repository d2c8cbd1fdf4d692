"""Exact removal of repeated word windows by super-k-mer partitioning.

A window is `width` consecutive words of one text; it is repeated if its word
sequence also starts anywhere else. Each window has a minimiser: of the `seed`-
word grams inside it the one with the least hash, the leftmost of several.
Consecutive windows with the same minimiser place form a super-k-mer, which
travels once, as one packed string of words, to the bucket of its minimiser's
hash. Equal windows have equal minimisers and so meet in one bucket. There the
windows are sorted by a hash, and equal hashes are confirmed word for word.
What comes back for a super-k-mer is a bit for each of its windows.

Super-k-mers of one chunk for one bucket are packed and compressed into a single
row. Strings that occur again in their chunk are known to be repeated: their places
are marked at once, and one copy travels without a place, counting as two; so a
passage in a third of all texts sends neither its copies nor its places. Grams that
a bounded sample shows in many texts come last in the order of minimisers, so that
windows which only touch a common passage go by another gram, to buckets of their
own; the order changes the work, never the result. A bucket is one of several that
a task handles one by one; their number follows the bytes of all texts.

A null or empty text has no words and nothing removed. A text shorter than a
window keeps all words. A row that is repeated counts as another place, so its
windows are repeated; rows are told apart by doc_id and text, never by doc_id
alone, and a null doc_id is a value like any other. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._dist import cut, partitions
from ._text import Words, batches, gather, mix, release, span_hashes, text_chunks

WIDTH = 35
SEED = 3
#: Buckets for each shuffle partition at least, and bytes of packed words in a bucket, about.
BUCKETS = 8
BUCKET_BYTES = 16 << 20
#: Texts of the sample for common grams; a gram is common from one text in so many; grams of the table at most.
SAMPLE_DOCS = 4_000
COMMON = 200
MOST_COMMON = 1 << 16
CODEC = pa.Codec("zstd", compression_level=6)
_Q = 0xD6E8FEB86659FD93


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of `size` word hashes."""
    n = len(hashes) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(size):
        out += hashes[k : k + max(n, 0)] * np.uint64(pow(_Q, k + 1, 1 << 64))
    return mix(out)


def least(values: np.ndarray, span: int) -> np.ndarray:
    """The place of the least of each `span` consecutive values, leftmost of several."""
    at = np.arange(len(values), dtype=np.int32)

    def join(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.where(values[y] < values[x], y, x)

    have = 1
    while 2 * have <= span:
        at = join(at[:-have], at[have:])
        have *= 2
    return join(at[: len(at) - (span - have)], at[span - have :]) if have < span else at


class Common:
    """Hashes of common grams, behind a bit map that most grams don't pass."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)
        self.map = np.zeros(1 << 20, bool)
        self.map[(hashes >> np.uint64(44)).astype(np.int64)] = True

    def last(self, hashes: np.ndarray) -> np.ndarray:
        """The hashes with common ones above all others."""
        out = hashes >> np.uint64(1)
        near = np.flatnonzero(self.map[(hashes >> np.uint64(44)).astype(np.int64)])
        if len(near):
            at = np.minimum(np.searchsorted(self.hashes, hashes[near]), len(self.hashes) - 1)
            out[near[self.hashes[at] == hashes[near]]] |= np.uint64(1 << 63)
        return out


def super_kmers(words: Words, width: int, seed: int, common: Common | None = None) -> tuple[np.ndarray, ...]:
    """Of each super-k-mer: text, first word, number of windows, hash of the minimiser."""
    none = np.zeros(0, np.int64)
    if len(words.start) < width:
        return none, none, none, none.astype(np.uint64)
    hashes = grams(words.hashes(), seed)
    if common is not None:
        hashes = common.last(hashes)
    at = least(hashes, width - seed + 1)
    text = np.repeat(np.arange(len(words.count)), words.count)
    valid = text[: len(at)] == text[width - 1 :]
    first = np.flatnonzero(valid)
    if not len(first):
        return none, none, none, none.astype(np.uint64)
    new = np.ones(len(first), bool)
    new[1:] = (at[first[1:]] != at[first[:-1]]) | (text[first[1:]] != text[first[:-1]])
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(first)))
    begin = first[begin]
    return text[begin], begin, count, hashes[at[begin]]


def _packed(ids, keys, words: Words, found, width: int, buckets: int):
    """A row for each bucket of a chunk: its strings, and the places of those that occur once; and (bucket -1) marks of the others' places."""
    text, begin, count, minimiser = found
    size = words.end[begin + count + width - 2] - words.start[begin]
    whole = span_hashes(words.buf, words.start[begin], words.start[begin] + size)
    bucket = (mix(minimiser) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((whole, bucket))
    text, begin, count, size, whole, bucket = (x[order] for x in (text, begin, count, size, whole, bucket))
    # one copy of each string; equal hashes count as equal only if the bytes agree, too
    new = np.ones(len(order), bool)
    new[1:] = (bucket[1:] != bucket[:-1]) | (whole[1:] != whole[:-1])
    same = np.flatnonzero(~new)
    start = words.start[begin]
    for i in same.tolist():
        a, b = start[i - 1], start[i]
        if size[i] != size[i - 1] or words.buf[a : a + size[i]].tobytes() != words.buf[b : b + size[i]].tobytes():
            new[i] = True
    head = np.flatnonzero(new)
    copies = np.diff(np.append(head, len(new)))
    rel = begin - words.first[text]
    again = np.repeat(copies, copies) > 1
    if again.any():
        mask = (np.uint64(1) << count[again].astype(np.uint64)) - np.uint64(1)
        yield -1, *_marks(ids[text[again]], keys[text[again]], rel[again], mask)
    edge = np.flatnonzero(np.append(True, bucket[head][1:] != bucket[head][:-1]))
    for a, b in zip(edge.tolist(), np.append(edge[1:], len(head)).tolist(), strict=True):
        h = head[a:b]
        times = np.minimum(copies[a:b], 2)
        one = h[times == 1]
        strings = gather(words.buf, start[h], size[h] + 1)
        block = [count[h].astype("<i4"), (size[h] + 1).astype("<i4"), times.astype("<i4"), ids[text[one]].astype("<i8"), keys[text[one]].astype("<i8"), rel[one].astype("<i4")]
        raw = np.array([len(h), len(one), len(strings)], "<i8").tobytes() + b"".join(x.tobytes() for x in block) + strings.tobytes()
        yield int(bucket[h[0]]), len(raw), CODEC.compress(raw, asbytes=True)


def _marks(ids, keys, rel, mask) -> tuple[int, bytes]:
    """Packed marks; those of equal rows once."""
    ids, keys, rel, mask = _distinct(ids, keys, rel, mask)
    raw = b"".join(x.astype(t).tobytes() for x, t in ((ids, "<i8"), (keys, "<i8"), (rel, "<i4"), (mask, "<u8")))
    return len(raw), CODEC.compress(raw, asbytes=True)


def _distinct(ids, keys, rel, mask):
    """Marks without repeats: equal rows have equal marks."""
    order = np.lexsort((mask, rel, keys, ids))
    ids, keys, rel, mask = ids[order], keys[order], rel[order], mask[order]
    new = np.ones(len(order), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1]) | (rel[1:] != rel[:-1]) | (mask[1:] != mask[:-1])
    return ids[new], keys[new], rel[new], mask[new]


def _unmarked(size: int, blob: bytes):
    raw = pa.decompress(blob, size, "zstd", asbytes=True)
    n = size // 28
    return np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "<i8", n, 8 * n), np.frombuffer(raw, "<i4", n, 16 * n), np.frombuffer(raw, "<u8", n, 20 * n)


def _unpacked(blobs: list[tuple[int, bytes]]):
    parts: list[list[np.ndarray]] = [[] for _ in range(7)]
    for size, blob in blobs:
        raw = pa.decompress(blob, size, "zstd", asbytes=True)
        n, places, _ = np.frombuffer(raw, "<i8", 3).tolist()
        at = 24
        for k, (kind, length) in enumerate((("<i4", n), ("<i4", n), ("<i4", n), ("<i8", places), ("<i8", places), ("<i4", places))):
            parts[k].append(np.frombuffer(raw, kind, length, at))
            at += parts[k][-1].nbytes
        parts[6].append(np.frombuffer(raw, np.uint8, -1, at))
    return [np.concatenate(p) for p in parts]


def _repeated(count, copies, words: Words, width: int) -> np.ndarray:
    """For each string, which stands for so many copies, a bit mask of its repeated windows."""
    total = int(count.sum())
    before = np.cumsum(count) - count
    string = np.repeat(np.arange(len(count)), count)
    first = np.repeat(words.first[:-1] - before, count) + np.arange(total)
    a, b = words.start[first], words.end[first + width - 1]
    hashes = span_hashes(words.buf, a, b)
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    same = np.append(False, h[1:] == h[:-1])
    buf = words.buf
    left, right = order[np.flatnonzero(same) - 1], order[same]
    wrong = [i for i, (x, y) in enumerate(zip(left.tolist(), right.tolist(), strict=True)) if buf[a[x] : b[x]].tobytes() != buf[a[y] : b[y]].tobytes()]
    group = np.cumsum(~same)  # of windows in sorted order, from 1
    if wrong:  # different windows with one hash: number them by their words
        for g in np.unique(group[np.flatnonzero(same)[wrong]]).tolist():
            mine = np.flatnonzero(group == g)
            names: dict[bytes, int] = {}
            group[mine] = [group[-1] + 1 + g * total + names.setdefault(buf[a[x] : b[x]].tobytes(), len(names)) for x in order[mine].tolist()]
        _, group = np.unique(group, return_inverse=True)
    times = np.bincount(group, weights=copies[string[order]])
    again = np.zeros(total, bool)
    again[order] = times[group] > 1
    bit = np.uint64(1) << (np.arange(total) - np.repeat(before, count)).astype(np.uint64)
    return np.add.reduceat(np.where(again, bit, np.uint64(0)), before) if len(before) else np.zeros(0, np.uint64)


def common_grams(documents: DataFrame, seed: int, total: int) -> Common | None:
    """The grams that many texts of a sample have; None where there are none."""
    share = min(1.0, SAMPLE_DOCS / max(total, 1))

    def count(it):
        for batch in it:
            for _, _, items in text_chunks(batch.column(0)):
                words = Words(items)
                if len(words.start) < seed:
                    continue
                h = grams(words.hashes(), seed)
                own = np.repeat(np.arange(len(items)), words.count)
                inside = own[: len(h)] == own[seed - 1 :]
                # once a text
                pairs = np.unique(np.stack([own[: len(h)][inside].astype(np.uint64), h[inside]]), axis=1)[1]
                hashes, n = np.unique(pairs, return_counts=True)
                yield pa.record_batch({"h": pa.array(hashes[n > 1].view(np.int64)), "n": pa.array(n[n > 1])})
        release()

    texts_ = documents.select("text")
    found = (texts_.sample(share, 23) if share < 1 else texts_).mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    top = found.where(F.col("n") >= max(2, share * total / COMMON)).orderBy(F.desc("n"), "h").limit(MOST_COMMON).toPandas()
    return Common(top["h"].to_numpy(np.int64).view(np.uint64)) if len(top) else None


def repeated_windows(documents: DataFrame, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """doc_id, key, first, mask: bit i says that the window from word first + i is repeated.

    `key` is a 64-bit hash of the text. Super-k-mers without a repeated window give
    no row, and rows equal in doc_id and text give one row together.
    """
    spark = documents.sparkSession
    n = partitions(spark)
    # a super-k-mer holds about three times the words that it is for
    all_ = documents.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    buckets = n * max(BUCKETS, -(-3 * all_.bytes // (n * BUCKET_BYTES)))
    common = spark.sparkContext.broadcast(common_grams(documents, seed, all_.rows))

    def spread(it):
        schema = pa.schema([("bucket", pa.int64()), ("size", pa.int64()), ("blob", pa.binary())])
        lot = 0
        for batch in it:
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            keys = batch.column(1).to_numpy(zero_copy_only=False)
            for a, b, items in text_chunks(batch.column(2)):
                words = Words(items)
                lot += 1
                # marks are dealt over all tasks
                rows = [(k if k >= 0 else buckets + (lot * 7919 + int(keys[a])) % n, s, x) for k, s, x in _packed(ids[a:b], keys[a:b], words, super_kmers(words, width, seed, common.value), width, buckets)]
                for k in range(0, len(rows), 256):
                    part = list(zip(*rows[k : k + 256], strict=True))
                    yield batches(schema, bucket=part[0], size=part[1], blob=part[2])
        release()

    def count(it):
        schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("first", pa.int32()), ("mask", pa.int64())])
        out = lambda ids, keys, rel, mask: batches(schema, doc_id=ids, key=keys, first=rel, mask=mask.astype(np.int64))

        def one(blobs):
            count, size, times, ids, keys, rel, raw = _unpacked(blobs)
            words = Words([])
            words.buf = raw
            words.end = np.flatnonzero(raw == 32)
            words.start = np.append(0, words.end[:-1] + 1)
            words.first = np.append(0, np.searchsorted(words.end, np.cumsum(size), "left"))
            mask = _repeated(count, times, words, width)[times == 1]
            keep = mask != 0
            return out(*_distinct(ids[keep], keys[keep], rel[keep], mask[keep]))

        now, held = None, []
        for batch in it:
            if not batch.num_rows:
                continue
            buckets_, sizes = (c.to_numpy() for c in batch.columns[:2])
            edge = [0, *(np.flatnonzero(buckets_[1:] != buckets_[:-1]) + 1).tolist(), len(buckets_)]
            for a, b in zip(edge, edge[1:], strict=False):  # bucket by bucket, so that no more than one is unpacked
                if buckets_[a] != now and held:
                    yield one(held)
                    held = []
                now = buckets_[a]
                blobs = zip(sizes[a:b].tolist(), batch.column(2).slice(a, b - a).to_pylist(), strict=True)
                if now >= buckets:
                    for size, blob in blobs:
                        yield out(*_unmarked(size, blob))
                else:
                    held += blobs
        if held:
            yield one(held)
        release()

    keyed = documents.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), "text")
    packed = keyed.mapInArrow(spread, "bucket long, size long, blob binary")
    marks = packed.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(count, "doc_id long, key long, first int, mask long")
    # copies in several chunks have marked one place more than once
    return marks.groupBy("doc_id", "key", "first").agg(F.bit_or("mask").alias("mask"))


def row_key():
    """Tells rows with one doc_id, or with none, apart by their texts."""
    return F.xxhash64(F.col("doc_id").isNull(), F.col("text"))


def remove_repeats(documents: DataFrame, width: int = WIDTH, seed: int = SEED, joined: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row, or, `joined`, the kept text.

    With `joined` all columns of `documents` are kept, and `text` holds the kept
    words joined by one space.
    """
    marks = cut(lambda: repeated_windows(documents, width, seed))
    marks = marks.groupBy(F.col("doc_id").alias("__sd_id"), F.col("key").alias("__sd_key")).agg(F.collect_list("first").alias("__sd_first"), F.collect_list("mask").alias("__sd_mask"))
    own = [F.col(c) for c in documents.columns] if joined else [F.col("doc_id").cast("long").alias("doc_id"), F.col("text")]
    left = documents.select(*own, F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("__sd_id"), row_key().alias("__sd_key"))
    both = left.join(marks.hint("shuffle_hash"), ["__sd_id", "__sd_key"], "left").drop("__sd_id", "__sd_key")

    def kept(column, first, mask):
        for a, b, items in text_chunks(column):
            words = Words(items)
            firsts, masks = first.slice(a, b - a).to_pylist(), mask.slice(a, b - a).to_pylist()
            cover = np.zeros(len(words.start) + 1, np.int32)
            for d in range(b - a):
                if firsts[d] is None:
                    continue
                begin = words.first[d] + np.asarray(firsts[d], np.int64)
                bits = np.asarray(masks[d], np.int64)
                which, bit = np.nonzero(bits[:, None] >> np.arange(width) & 1)
                windows = begin[which] + bit
                np.add.at(cover, windows, 1)
                np.add.at(cover, windows + width, -1)
            stay = np.cumsum(cover[:-1]) == 0
            for d in range(b - a):
                x, y = words.first[d], words.first[d + 1]
                mine = stay[x:y]
                if mine.all():
                    yield y - x, 0, words.text(x, y)
                else:
                    at = x + np.flatnonzero(mine)
                    yield y - x, y - x - len(at), gather(words.buf, words.start[at], words.end[at] - words.start[at] + 1)[:-1].tobytes()

    def digest(it):
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
        for batch in it:
            rows = [(n, r, hashlib.sha256(t).hexdigest()) for n, r, t in kept(*batch.columns[1:4])]
            n, r, t = zip(*rows, strict=True) if rows else ((), (), ())
            yield batches(schema, doc_id=batch.column(0), n_words=n, n_removed=r, kept_sha256=t)

    def rewrite(it):
        for batch in it:
            names = batch.schema.names
            out = [t.decode("utf-8", "replace") for _, _, t in kept(batch.column("text"), batch.column("__sd_first"), batch.column("__sd_mask"))]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == "text" else batch.column(c) for c in names[:-2]], names[:-2])

    if joined:
        return both.select(*documents.columns, "__sd_first", "__sd_mask").mapInArrow(rewrite, documents.schema)
    return both.select("doc_id", "text", "__sd_first", "__sd_mask").mapInArrow(digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")

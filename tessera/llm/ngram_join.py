"""Joining of near-equal texts: Jaccard of word n-gram sets by T-occurrence search.

A document's set holds the 64-bit hashes of its distinct shingles. Documents with
equal sets form a class. Two sets with the required similarity share one of their
first elements in any common order (prefix filter); ours puts shingles that are
frequent in a sample last, which changes the work only. Postings of these
prefixes are packed by chunk and bucket, so that one shuffle carries them.

Candidates come in two rounds. In the first, each bucket pairs the members of a
posting list with one of them, the one that has the shared shingle earliest; so
their number is linear in the postings. In the second, lists that still hold more
than one component give all pairs across components that pass the length and
position filters. Every class is posted in both rounds, also one that the first
left without a pair. Nothing is capped: a link between different components is
always found by the second round, and links inside one don't matter to it. Pairs whose
sets must differ too much by the parities of hashed counts are left out unseen;
whole sets are looked up for the others only.

The list of a shingle that the sample shows in very many documents is dealt over
parts by a hash of the class. In the first round each part has its own first
member, and these meet once more in a list of their own. In the second, lists
whose members are all in one component by then, as those of a large group of near
copies are, are left out; of the others every two parts meet in a bucket.

Candidates of a query set are verified by DivideSkip: the inverted lists of the
query's shingles over its candidates are split, the short ones are merged on a
heap with a lower threshold, the long ones probed by binary search, and documents
with the required overlap stay. A query with very many candidates is dealt out.

Null, empty and blank texts have empty sets, are linked with nothing and have
their own doc_id as component. Texts shorter than a shingle have their whole word
sequence as the only element. Repeated rows are each reported. A null doc_id
never names a component; one of nothing else is null. Other columns are not read.
Classes are told apart by 64 bits of their set's hash, links rest on 48 bits of
each shingle's hash.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._dist import components, cut, partitions
from ._text import CHUNK, Words, batches, chunks, mix, release, text_chunks, texts
from .substring_dedup import grams

#: One document in so many is sampled for frequent shingles; the table of these is bounded, too.
SAMPLE = 16
FREQUENT = 200_000
#: Members of a part of a posting list, about; longer lists are dealt over several parts.
LIST = 4096
#: Candidates that one task verifies against a query at a time.
CHUNK_ROWS = 256
#: Pairs that a bucket holds before it hands them on.
HELD_PAIRS = 1 << 18
#: Places of the parities that screen pairs.
PARITIES = 512
#: Bytes of a shingle's hash by which whole sets are compared.
HASH_BYTES = 6
LOW = np.uint64((1 << 8 * HASH_BYTES) - 1)


def shingle_sets(items: list[bytes], size: int) -> list[np.ndarray]:
    """The sorted hashes of the distinct shingles of every text."""
    words = Words(items, lower=True)
    h = words.hashes()
    g = grams(h, size)
    out = []
    for d in range(len(items)):
        a, b = int(words.first[d]), int(words.first[d + 1])
        if b - a >= size:
            out.append(np.unique(g[a : b - size + 1]))
        elif b > a:
            out.append(mix(grams(h[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def required(a, b, percent: int):
    """The least overlap of sets of these sizes that makes a link."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


class Order:
    """Rare shingles first, then by hash."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, members: float = math.inf):
        """`members` of the sample make a part of a posting list."""
        self.members = members
        at = np.argsort(hashes)
        self.hashes, self.counts = hashes[at], counts[at]
        # the second round knows shingles by their low bytes only
        low = hashes & LOW
        at = np.argsort(low)
        self.low, self.low_counts = low[at], counts[at]

    def arrange(self, own: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return own
        at = np.minimum(np.searchsorted(self.hashes, own), len(self.hashes) - 1)
        count = np.where(self.hashes[at] == own, self.counts[at], 0)
        return own[np.lexsort((own, count))]

    def parts(self, tokens: np.ndarray) -> np.ndarray:
        """The number of parts of each token's posting list."""
        if not len(self.low):
            return np.ones(len(tokens), np.int64)
        at = np.minimum(np.searchsorted(self.low, tokens & LOW), len(self.low) - 1)
        return np.where(self.low[at] == tokens & LOW, np.ceil(self.low_counts[at] / self.members), 1).astype(np.int64).clip(1)


def packed_set(own: np.ndarray) -> bytes:
    """A set as the low bytes of its hashes: enough to compare two sets."""
    return own.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES].tobytes()


def unpacked_set(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // HASH_BYTES, 8), np.uint8)
    out[:, :HASH_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, HASH_BYTES)
    return out.reshape(-1).view("<u8")


def digest(own: np.ndarray) -> tuple[int, int]:
    a = int(mix(own).sum(dtype=np.uint64)) ^ (len(own) * 0x9E3779B97F4A7C15 & (2**64 - 1))
    b = int(mix(own ^ np.uint64(0xA5A5A5A5DEADBEEF)).sum(dtype=np.uint64))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return signed(int(mix(np.array([a], np.uint64))[0])), signed(b)


def divide_skip(lists: list[list[int]], least: int, mu: float = 0.01) -> dict[int, int]:
    """Ids in at least `least` of the sorted lists, and in how many (DivideSkip, Li et al., 2008)."""
    if least <= 0 or len(lists) < least:
        return {}
    lists = sorted(lists, key=len)
    most = len(lists[-1])
    n_long = min(least - 1, int(least / (mu * math.log2(most) + 1)) if most > 1 else least - 1)
    short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    bar = least - n_long
    out: dict[int, int] = {}
    heap = [(x[0], i) for i, x in enumerate(short) if x]
    heapq.heapify(heap)
    at = [0] * len(short)
    while len(heap) >= bar:
        top = heap[0][0]
        popped = []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap)[1])
        if len(popped) >= bar:
            count, left = len(popped), n_long
            for x in long:
                left -= 1
                k = bisect_left(x, top)
                count += k < len(x) and x[k] == top
                if count + left < least:
                    break
            if count >= least:
                out[top] = count
            for i in popped:
                at[i] += 1
                if at[i] < len(short[i]):
                    heapq.heappush(heap, (short[i][at[i]], i))
        else:
            # no id below the bar-th smallest head can reach the bar: skip to it
            while heap and len(popped) < bar - 1:
                popped.append(heapq.heappop(heap)[1])
            if not heap:
                break
            to = heap[0][0]
            for i in popped:
                at[i] = bisect_left(short[i], to, at[i])
                if at[i] < len(short[i]):
                    heapq.heappush(heap, (short[i][at[i]], i))
    return out


def linked(query: np.ndarray, sets: list[np.ndarray], percent: int) -> list[int]:
    """Which of the sets link to the query."""
    own = np.sort(query)
    sizes = np.array([len(s) for s in sets])
    places, ids = [], []
    for j, s in enumerate(sets):
        at = np.minimum(np.searchsorted(own, s), len(own) - 1)
        hit = at[own[at] == s]
        places.append(hit)
        ids.append(np.full(len(hit), j))
    places, ids = np.concatenate(places), np.concatenate(ids)
    order = np.lexsort((ids, places))
    places, ids = places[order], ids[order]
    edge = np.flatnonzero(np.append(True, places[1:] != places[:-1])) if len(places) else []
    lists = [x.tolist() for x in np.split(ids, edge[1:])] if len(places) else []
    found = divide_skip(lists, int(required(len(own), int(sizes.min()), percent)))
    return [j for j, n in found.items() if n >= required(len(own), int(sizes[j]), percent)]


# --- buckets of postings -------------------------------------------------------------------

_FIELDS = (("token", "<u8"), ("cid", "<i8"), ("comp", "<i8"), ("n", "<i4"), ("pos", "<i4"), ("part", "<i4"))
_BLOB = "bucket int, size long, blob binary"


def _parted(x: dict[str, np.ndarray], parts: np.ndarray, meet: bool) -> dict[str, np.ndarray]:
    """Postings with `part`, 0 in a list of one, under a token for each part of a list; where parts `meet`, for each two of them."""
    part = (mix(x["cid"].view(np.uint64) ^ np.uint64(0x2545F4914F6CDD1D)) % parts.astype(np.uint64)).astype(np.int64) + 1
    x = x | {"part": np.where(parts > 1, part, 0), "token": x["token"].copy()}
    hot = np.flatnonzero(parts > 1)
    if not len(hot):
        return x
    low = high = part[hot]
    if meet:
        copies = np.repeat(hot, parts[hot])
        other = np.arange(len(copies)) - np.repeat(np.cumsum(parts[hot]) - parts[hot], parts[hot]) + 1
        low, high = np.minimum(part[copies], other), np.maximum(part[copies], other)
        cold = np.flatnonzero(parts == 1)
        x = {k: np.concatenate([v[cold], v[copies]]) for k, v in x.items()}
        hot = np.arange(len(cold), len(cold) + len(copies))
    x["token"][hot] = mix(x["token"][hot] + mix((low.astype(np.uint64) << np.uint64(32)) + high.astype(np.uint64)))
    return x


def _pack(cids, comps, arranged: list[np.ndarray], percent: int, buckets: int, sizes=None, order: Order | None = None, only=None, settled: np.ndarray | None = None):
    """Blobs of a chunk's postings, one a bucket; `sizes` of the sets, if `arranged` are prefixes only.

    `order` deals long lists over parts, which meet each other where `settled`, the
    tokens whose lists need not be looked at, is given. `only` long lists: no parts.
    """
    n = np.array([len(s) for s in arranged]) if sizes is None else sizes
    lengths = np.array([prefix_size(int(k), percent) if k else 0 for k in n])
    if not lengths.sum():
        return
    token = np.concatenate([s[:k] for s, k in zip(arranged, lengths, strict=True)])
    owner = np.repeat(np.arange(len(arranged)), lengths)
    pos = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    x = {"token": token, "cid": cids[owner], "comp": comps[owner], "n": n[owner], "pos": pos}
    parts = order.parts(token) if order else np.ones(len(token), np.int64)
    keep = parts > 1 if only else ~np.isin(token, settled) if settled is not None and len(settled) else None
    if keep is not None:
        x, parts = {k: v[keep] for k, v in x.items()}, parts[keep]
    x = x | {"part": np.zeros(len(x["token"]), np.int64)} if only else _parted(x, parts, settled is not None)
    bucket = (mix(x["token"]) % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    edge = np.searchsorted(bucket[by], np.arange(buckets + 1))
    columns = {k: x[k][by].astype(t) for k, t in _FIELDS}
    for b in np.flatnonzero(np.diff(edge)).tolist():
        raw = b"".join(columns[k][edge[b] : edge[b + 1]].tobytes() for k, _ in _FIELDS)
        yield b, len(raw), pa.compress(raw, "zstd", asbytes=True)


def _unpack(blobs):
    parts = {k: [] for k, _ in _FIELDS}
    width = sum(np.dtype(t).itemsize for _, t in _FIELDS)
    for size, blob in blobs:
        raw, at = pa.decompress(blob, size, "zstd", asbytes=True), 0
        for k, t in _FIELDS:
            parts[k].append(np.frombuffer(raw, t, size // width, at))
            at += parts[k][-1].nbytes
    return {k: np.concatenate(v) for k, v in parts.items()}


def _blob_rows(rows):
    schema = pa.schema([("bucket", pa.int32()), ("size", pa.int64()), ("blob", pa.binary())])
    rows = list(rows)
    for k in range(0, len(rows), 256):
        part = list(zip(*rows[k : k + 256], strict=True))
        yield batches(schema, bucket=part[0], size=part[1], blob=part[2])


def _per_bucket(packed: DataFrame, n: int, pairs_of, percent: int) -> DataFrame:
    """a, b: what `pairs_of` gives, lot by lot, for the postings of each bucket, without repeats in a lot."""

    def run(it):
        def one(blobs):
            x = _unpack(blobs)
            order = np.lexsort((x["cid"], x["pos"], x["token"]))
            x = {k: v[order] for k, v in x.items()}
            new = np.ones(len(order), bool)
            new[1:] = (x["token"][1:] != x["token"][:-1]) | (x["cid"][1:] != x["cid"][:-1])
            x = {k: v[new] for k, v in x.items()}
            for a, b in pairs_of(x, percent):
                low, high = np.minimum(a, b), np.maximum(a, b)
                if len(low):
                    order = np.lexsort((high, low))
                    low, high = low[order], high[order]
                    new = np.append(True, (low[1:] != low[:-1]) | (high[1:] != high[:-1]))
                    low, high = low[new], high[new]
                yield pa.record_batch({"a": pa.array(low, pa.int64()), "b": pa.array(high, pa.int64())})

        now, held = None, []
        for batch in it:
            for bucket, size, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now and held:
                    yield from one(held)
                    held = []
                now = bucket
                held.append((size, blob))
        if held:
            yield from one(held)
        release()

    return packed.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "a long, b long")


def _passes(x, i, j, percent: int) -> np.ndarray:
    """Length and position filters, for pairs whose first common shingle this is."""
    need = required(x["n"][i].astype(np.int64), x["n"][j].astype(np.int64), percent)
    left = np.minimum(x["n"][i] - x["pos"][i], x["n"][j] - x["pos"][j])
    return (left >= need) & (x["cid"][i] != x["cid"][j])


def star_pairs(x, percent: int):
    """Each member of a list with its first: the one with the shingle earliest.

    The first members of parts of a list, where `part` tells them, come as pairs with themselves.
    """
    token = x["token"]
    first = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, int)
    head = np.repeat(first, np.diff(np.append(first, len(token))))
    i = np.flatnonzero(head != np.arange(len(token)))
    near = _passes(x, i, head[i], percent)
    # where the filters part the two, the neighbour stands in; a member that both fail waits for the second round
    far = i[~near]
    far = far[_passes(x, far, far - 1, percent)] if len(far) else far
    heads = first[x["part"][first] > 0] if "part" in x else first[:0]
    return np.concatenate([x["cid"][i[near]], x["cid"][far], x["cid"][heads]]), np.concatenate([x["cid"][head[i[near]]], x["cid"][far - 1], x["cid"][heads]])


def stars(x, percent: int):
    yield star_pairs(x, percent)


def cross_pairs(x, percent: int):
    """All pairs of a list from different components."""
    a, b = zip(*cross_lots(x, percent), strict=True)
    return np.concatenate(a), np.concatenate(b)


def cross_lots(x, percent: int):
    """The same in lots of about HELD_PAIRS."""
    token, comp = x["token"], x["comp"]
    part = x.get("part", np.zeros(len(token), np.int64))
    first = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, int)
    a, b, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for s, e in zip(first.tolist(), np.append(first[1:], len(token)).tolist(), strict=True):
        if e - s < 2:
            continue
        names, size = np.unique(comp[s:e], return_counts=True)
        if len(names) < 2:
            continue
        every = np.arange(s, e)
        across = (part[s] != part[s:e]).any()  # two parts meet here, and each has a list of its own
        rest = every[comp[s:e] != names[size.argmax()]]
        for i in rest.tolist():
            other = (comp[s:e] != comp[i]) & (part[s:e] != part[i]) if across else comp[s:e] != comp[i]
            j = every[other]
            j = j[_passes(x, np.full(len(j), i), j, percent)]
            a.append(np.full(len(j), x["cid"][i]))
            b.append(x["cid"][j])
            held += len(j)
            if held > HELD_PAIRS:
                yield np.concatenate(a), np.concatenate(b)
                a, b, held = [a[0]], [b[0]], 0
    yield np.concatenate(a), np.concatenate(b)


# --- the join -------------------------------------------------------------------------------


def _frequent(documents: DataFrame, size: int, sample: int, list_size: int) -> Order:
    def count(it):
        for batch in it:
            for _, _, items in text_chunks(batch.column(0)):
                sets = [s for s in shingle_sets(items, size) if len(s)]
                h, n = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                yield pa.record_batch({"h": pa.array(h.view(np.int64)), "n": pa.array(n.astype(np.int64))})

    some = documents.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(sample)) == 0).select("text")
    top = some.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n >= 3").orderBy(F.desc("n"), "h").limit(FREQUENT).toPandas()
    return Order(top["h"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64), list_size / sample)


def parities(own: np.ndarray) -> list[int]:
    """For each of PARITIES places, whether an odd number of the set's hashes fall there."""
    odd = np.bincount((mix(own) & np.uint64(PARITIES - 1)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8").tolist()


def _screened(pairs: DataFrame, short: DataFrame, percent: int) -> DataFrame:
    """The pairs whose parities leave a link possible.

    Where two parities differ, the sets do, too; so the number of these places
    is at most that of elements in one set only. No link is lost.
    """
    side = lambda c: short.select(F.col("cid").alias(c), F.col("n").cast("long").alias(f"n_{c}"), F.col("sig").alias(f"sig_{c}"))
    both = F.col("n_a") + F.col("n_b")
    need = F.expr(f"({percent} * (n_a + n_b) + {99 + percent}) div {100 + percent}")  # rounded up
    apart = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return pairs.join(side("a"), "a").join(side("b"), "b").where(apart <= both - 2 * need).select("a", "b")


def _verify(pairs: DataFrame, sets: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link; `pairs` and `sets` are cut already.

    Each set is looked up once for all requests of it.
    """
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CHUNK_ROWS).cast("int").alias("parts"))
    dealt = pairs.join(many, "a").select(F.col("b").alias("cid"), "a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("kind"))
    asked = many.select(F.col("a").alias("cid"), "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"))
    wanted = dealt.unionByName(asked).hint("shuffle_hash")

    def run(it):
        def out(query, ids, held):
            hits = linked(query, held, percent) if held else []
            return [(now[0], ids[j]) for j in hits]

        now, query, ids, held = None, None, [], []
        for batch in it:
            found = []
            for r in range(batch.num_rows):
                a, part, kind, b = (batch.column(c)[r].as_py() for c in range(4))
                own = unpacked_set(batch.column(4)[r].as_py())
                if kind == 0:
                    if (a, part) != now:
                        found += out(query, ids, held)
                        now, query, ids, held = (a, part), own, [], []
                elif (a, part) == now:
                    ids.append(b)
                    held.append(own)
            a, b = zip(*found, strict=True) if found else ((), ())
            yield pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
        found = out(query, ids, held)
        a, b = zip(*found, strict=True) if found else ((), ())
        yield pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
        release()

    met = sets.join(wanted, "cid").select("a", "part", "kind", F.col("cid").alias("b"), "own").repartition(n, "a", "part").sortWithinPartitions("a", "part", "kind", "b")
    return met.mapInArrow(run, "a long, b long")


def near_components(documents: DataFrame, size: int = 4, percent: int = 85, sample: int = SAMPLE, list_size: int = LIST) -> DataFrame:
    """doc_id, key, n_shingles, component_id of every row; `key` tells rows with one doc_id apart.

    `sample` and `list_size` change the work only.
    """
    spark = documents.sparkSession
    n = partitions(spark)
    frequent = _frequent(documents, size, sample, list_size)
    order = spark.sparkContext.broadcast(frequent)
    long_lists = bool((frequent.parts(frequent.hashes) > 1).any())
    base = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    signed = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n_shingles", pa.int64()), ("cid", pa.int64()), ("sig", pa.list_(pa.int64())), ("own", pa.binary())])

    def signatures(it):
        """Of each row its class; at the first of a class in a task also parities and prefix of the set, for the second round."""
        met: set[int] = set()
        for batch in it:
            rows = []
            for _, _, items in text_chunks(batch.column(2)):
                for s in shingle_sets(items, size):
                    cid, _ = digest(s)
                    new = len(s) > 0 and cid not in met
                    if new:
                        met.add(cid)
                    rows.append((len(s), cid, parities(s) if new else None, packed_set(order.value.arrange(s)[: prefix_size(len(s), percent)]) if new else None))
            count, cid, sig, own = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield batches(signed, doc_id=batch.column(0), key=batch.column(1), n_shingles=count, cid=cid, sig=sig, own=own)
        release()

    def postings(it):
        for batch in it:
            for _, _, items in text_chunks(batch.column(0), 2 * CHUNK):
                kept = {digest(s)[0]: s for s in shingle_sets(items, size) if len(s)}
                cids = np.fromiter(kept, np.int64, len(kept))
                yield from _blob_rows(_pack(cids, np.zeros_like(cids), [order.value.arrange(s) for s in kept.values()], percent, n, order=order.value))
        release()

    whole = cut(base.mapInArrow(signatures, "doc_id long, key long, n_shingles long, cid long, sig array<long>, own binary"))
    docs = whole.drop("sig", "own")
    # of every class size, parities and prefix, which are what screens and the second round need
    one = F.first(F.struct(F.col("n_shingles").cast("int").alias("n"), "sig", "own")).alias("r")
    short = cut(lambda: whole.where("own IS NOT NULL").groupBy("cid").agg(one).select("cid", "r.n", "r.sig", "r.own"))
    pairs = cut(lambda: _per_bucket(base.select("text").mapInArrow(postings, _BLOB), n, stars, percent).distinct())

    def own_sets(it):
        schema = pa.schema([("cid", pa.int64()), ("own", pa.binary())])
        met: set[int] = set()  # equal rows of one document are together: one of them will do
        for batch in it:
            rows = {c: t for c, t in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True) if c not in met}
            met.update(rows)
            cids, items = list(rows), list(rows.values())
            for a, b in chunks(items):
                yield batches(schema, cid=cids[a:b], own=[packed_set(order.value.arrange(s)) for s in shingle_sets(items[a:b], size)])
        release()

    def made(pairs: DataFrame) -> DataFrame:
        """The sets of all classes that occur in pairs, by one row of each."""
        members = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct()
        chosen = docs.join(members, "cid", "left_semi").groupBy("cid").agg(F.min(F.struct("doc_id", "key")).alias("r")).select("cid", F.col("r.doc_id").alias("doc_id"), F.col("r.key").alias("key"))
        # texts meet the few that are asked for by a shuffle at every size; what is asked for is the side that is built
        texts_of = base.join(chosen.hint("shuffle_hash"), base["doc_id"].eqNullSafe(chosen["doc_id"]) & (base["key"] == chosen["key"])).select("cid", "text")
        return texts_of.mapInArrow(own_sets, "cid long, own binary")

    def posted(**how):
        """Postings of classes by their prefixes; rows are cid, comp, n, own."""

        def run(it):
            for batch in it:
                cids, comp, sizes = (batch.column(c).to_numpy() for c in (0, 1, 2))
                own = [unpacked_set(x) for x in batch.column(3).to_pylist()]
                options = {k: v.value if hasattr(v, "value") else v for k, v in how.items()}
                for a in range(0, len(own), 4096):
                    yield from _blob_rows(_pack(cids[a : a + 4096], comp[a : a + 4096], own[a : a + 4096], percent, n, sizes[a : a + 4096], **options))
            release()

        return run

    def spread(it):
        """Of each shingle with a long list: the least and greatest component of a task's postings."""
        low: dict[int, int] = {}
        high: dict[int, int] = {}
        for batch in it:
            for comp, size_, own in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
                token = unpacked_set(own)[: prefix_size(size_, percent)]
                for t in token[order.value.parts(token) > 1].tolist():
                    low[t], high[t] = min(comp, low.get(t, comp)), max(comp, high.get(t, comp))
        names = np.fromiter(low, np.uint64, len(low)).view(np.int64)
        yield pa.record_batch({"t": pa.array(names), "a": pa.array(list(low.values()), pa.int64()), "b": pa.array(list(high.values()), pa.int64())})

    settled = np.zeros(0, np.uint64)
    if long_lists:
        heads = pairs.where("a = b").select(F.col("a").alias("cid")).join(short, "cid").select("cid", F.lit(0).cast("long").alias("comp"), "n", "own")
        firsts = _per_bucket(heads.mapInArrow(posted(order=order, only=True), _BLOB), n, stars, percent)
        pairs = cut(pairs.where("a <> b").union(firsts).distinct())

    def linked_pairs(close: DataFrame) -> DataFrame:
        sets = cut(lambda: made(close))
        return cut(lambda: _verify(close, sets, n, percent))

    links = linked_pairs(cut(lambda: _screened(pairs, short, percent)))
    comps = components(links)
    placed = short.join(comps, short["cid"] == comps["node"], "left").select("cid", F.coalesce("root", "cid").alias("comp"), "n", "own")
    if long_lists:
        # at most as many rows as the table of frequent shingles has
        ends = placed.mapInArrow(spread, "t long, a long, b long").groupBy("t").agg(F.min("a").alias("a"), F.max("b").alias("b"))
        settled = ends.where("a = b").select("t").toPandas()["t"].to_numpy(np.int64).view(np.uint64)
    done = spark.sparkContext.broadcast(settled)
    blobs = posted(order=order, settled=done)
    more = cut(lambda: _screened(_per_bucket(placed.mapInArrow(blobs, _BLOB), n, cross_lots, percent).distinct().join(pairs, ["a", "b"], "left_anti"), short, percent))
    if not more.isEmpty():
        comps = components(links.union(linked_pairs(more)))

    classes = docs.where("n_shingles > 0").groupBy("cid").agg(F.min("doc_id").alias("rep"))
    in_comps = comps.join(classes, comps["node"] == classes["cid"]).select("node", "root", "rep")
    least = in_comps.groupBy("root").agg(F.min("rep").alias("least"))
    named = in_comps.join(least, "root").select(F.col("node").alias("cid"), "least")
    names = classes.join(named, "cid", "left").select("cid", F.coalesce("least", "rep").alias("component_id"))
    named_docs = docs.withColumn("cid", F.when(F.col("n_shingles") > 0, F.col("cid"))).join(names, "cid", "left")
    return named_docs.select("doc_id", "key", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def join(documents: DataFrame, size: int = 4, percent: int = 85, **work) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    return near_components(documents, size, percent, **work).select("doc_id", "n_shingles", "component_id")


def keep_one(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `documents`, one of each component: that with the least doc_id, unchanged.

    Rows that repeat that id and text are one document and stay alike; rows without
    words, or without an id, all stay.
    """
    found = near_components(documents, size, percent)
    gone = found.where("n_shingles > 0 AND component_id IS NOT NULL AND doc_id IS DISTINCT FROM component_id").select(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).distinct()
    return documents.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__key")), "left_anti")

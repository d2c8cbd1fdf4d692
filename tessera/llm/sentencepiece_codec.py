"""SentencePiece encoding and decoding as relations.

Text is taken as the model says (spaces to U+2581, one in front) and cut into
units wherever two neighbouring characters occur side by side in no piece of the
model: no piece, and so no path or merge, reaches across such a place. Every
distinct unit gets its lattice by relations alone: its substrings up to the
longest piece are exploded, joined to the piece table (a table of fixed size,
broadcast), and grouped by unit. A fold by the higher-order function `aggregate`
then finds the segmentation:

* For a unigram model it is Viterbi's: the best path to each place from the edges
  that end there, then the way back.
* The best path by scores is not what a BPE model means. For one, the fold takes
  at each step the edge of best score, leftmost of several, that joins exactly two
  neighbours, and ends as soon as there is none. Places between symbols are bits
  of one number, so that a step is a walk over the unit's edges.

Units longer than SHORT characters don't fit such a number; they are rare (a run
of letters without any mark) and are segmented by a heap (BPE) or a plain Viterbi
walk in the worker, in time that hardly grows faster than their length. A
character without a piece becomes the pieces of its UTF-8 bytes.

Frequent units, a bounded number found in a bounded sample, go through the same
lattice first; their results are broadcast, so that only rare units are shuffled.
Occurrences of these are written once, as Parquet in the shared folder.

A null text is an empty one and has no pieces. Repeated rows are each encoded;
texts and ids may be of any length. Other columns are not read, and keep their
values and names; a column named as a new one is replaced. Decoding skips null
ids and ids that the model lacks; bytes that are no UTF-8 become U+FFFD each.
"""

from __future__ import annotations

import heapq
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ._dist import checkpoint_dir, cut, partitions
from ._text import release, span_hashes

#: Bounds of the table of frequent units: texts of the sample, units.
SAMPLE_DOCS = 20_000
FREQUENT = 1 << 18
#: Bytes of the texts that are split at a time.
CHUNK_BYTES = 1 << 20
#: Characters of a unit whose lattice is folded in one number's bits.
SHORT = 60
#: Bits of an id and of a rank in an edge.
BITS = 17
SCALE = 1 << BITS
MARK = "▁"
#: Digests are taken modulo this.
MODULUS = 1 << 31
UNIGRAM, BPE = 1, 2
#: What a unigram model takes off its least score for a character without a piece.
UNKNOWN_PENALTY = 10.0


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Model:
    """What of a model's file matters here."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self.kind = model.trainer_spec.model_type
        spec = model.normalizer_spec
        if self.kind not in (UNIGRAM, BPE) or spec.name not in ("", "identity") or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("a unigram or BPE model without normalisation, with a space in front, is needed")
        if len(model.pieces) > SCALE:
            raise ValueError(f"more than {SCALE} pieces")
        order = sorted((-p.score, i) for i, p in enumerate(model.pieces) if p.type in (1, 4))
        #: piece, id, rank by score, score
        self.rows: list[tuple[str, int, int, float]] = []
        rank, last = -1, None
        for s, i in order:
            rank, last = (rank if s == last else rank + 1), s
            self.rows.append((model.pieces[i].piece, i, rank, float(model.pieces[i].score)))
        self.longest = max((len(r[0]) for r in self.rows), default=1)
        bytes_ = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 6}
        self.bytes = [bytes_.get(f"<0x{b:02X}>", -1) for b in range(256)]
        if self.bytes != list(range(self.bytes[0], self.bytes[0] + 256)) or self.bytes[0] < 0:
            raise ValueError("a piece for every byte, in a row, is needed")
        self.unknown = min((r[3] for r in self.rows), default=0.0) - UNKNOWN_PENALTY
        #: what each id stands for: text, or -1 - byte
        self.says: list[str | int] = ["" if p.type in (3, 5) else " ⁇ " if p.type == 2 else p.piece.replace(MARK, " ") for p in model.pieces]
        for b, i in enumerate(self.bytes):
            self.says[i] = -1 - b
        self.spaced = [p.type != 2 and p.piece.startswith(MARK) for p in model.pieces]
        self.table = {r[0]: r for r in self.rows}
        pairs = {(a, b) for r in self.rows for a, b in zip(r[0], r[0][1:], strict=False)}
        left, right = sorted({a for a, _ in pairs}), sorted({b for _, b in pairs})
        self.left, self.right = np.zeros(0x110000, np.uint16), np.zeros(0x110000, np.uint16)
        self.left[[ord(c) for c in left]] = np.arange(1, len(left) + 1)
        self.right[[ord(c) for c in right]] = np.arange(1, len(right) + 1)
        self.joined = np.zeros((len(left) + 1, len(right) + 1), bool)
        for a, b in pairs:
            self.joined[self.left[ord(a)], self.right[ord(b)]] = True

    def units(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The marked texts in a row with their characters' codes; start and end of each unit in it, and the text that it is from."""
        sizes = np.fromiter((len(x) + 1 if x else 0 for x in texts), np.int64, len(texts))
        whole = "".join([MARK + x for x in texts if x]).replace(" ", MARK)
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
        new = np.ones(len(codes), bool)
        if len(codes):
            new[1:] = ~self.joined[self.left[codes[:-1]], self.right[codes[1:]]]
        begin = np.cumsum(sizes) - sizes
        new[begin[sizes > 0]] = True
        start = np.flatnonzero(new)
        return whole, codes, start, np.append(start[1:], len(codes)) if len(start) else start, np.searchsorted(begin + sizes, start, "right")

    def segment(self, unit: str) -> list[int]:
        """The ids of a unit of any length."""
        symbols = self._merged(unit) if self.kind == BPE else self._best(unit)
        return [i for s in symbols for i in ([self.table[s][1]] if s in self.table else [self.bytes[0] + b for c in s for b in c.encode("utf-8")])]

    def _merged(self, unit: str) -> list[str]:
        ahead, behind, symbol = list(range(1, len(unit) + 1)), list(range(-1, len(unit) - 1)), list(unit)
        heap: list[tuple[int, int, int]] = []

        def offer(a: int) -> None:
            b = ahead[a] if a >= 0 else len(unit)
            if b < len(unit):
                both = symbol[a] + symbol[b]
                if len(both) <= self.longest and both in self.table:
                    heapq.heappush(heap, (self.table[both][2], a, len(both)))

        for a in range(len(unit)):
            offer(a)
        while heap:
            _, a, size = heapq.heappop(heap)
            b = ahead[a]
            if not symbol[a] or b >= len(unit) or len(symbol[a]) + len(symbol[b]) != size:
                continue  # one of the two has gone elsewhere
            symbol[a], symbol[b] = symbol[a] + symbol[b], ""
            ahead[a] = ahead[b]
            if ahead[a] < len(unit):
                behind[ahead[a]] = a
            offer(behind[a])
            offer(a)
        return [s for s in symbol if s]

    def _best(self, unit: str) -> list[str]:
        best: list[tuple[float, int]] = [(0.0, 0)]
        for e in range(1, len(unit) + 1):
            one = unit[e - 1]
            way = (best[e - 1][0] + (self.table[one][3] if one in self.table else self.unknown), 1 - e)
            for s in range(max(0, e - self.longest), e - 1):
                if unit[s:e] in self.table:
                    way = max(way, (best[s][0] + self.table[unit[s:e]][3], -s))
            best.append((way[0], -way[1]))
        out, e = [], len(unit)
        while e:
            out.append(unit[best[e][1] : e])
            e = best[e][1]
        return out[::-1]

    def text(self, ids, whole: bool = True) -> str:
        """What ids stand for; a `whole` text loses the space in front."""
        out: list[str] = []
        held = bytearray()

        def close() -> None:
            data = bytes(held)
            held.clear()
            while data:
                try:
                    out.append(data.decode("utf-8"))
                    return
                except UnicodeDecodeError as e:
                    out.append(data[: e.start].decode("utf-8") + "�")
                    data = data[e.start + 1 :]

        first = True
        for i in ids:
            says = self.says[i] if i is not None and 0 <= i < len(self.says) else ""
            if isinstance(says, int):
                held.append(-1 - says)
                first = False
                continue
            if held:
                close()
            if first and says:
                first = False
                says = says[1:] if whole and self.spaced[i] else says
            out.append(says)
        close()
        return "".join(out)


@lru_cache(2)
def load(path: str) -> Model:
    """One a process, kept from task to task."""
    return Model(path)


# --- lattices --------------------------------------------------------------------------------


def _shift(a: Column, n: Column) -> Column:
    return F.call_function("shiftleft", a, n.cast("int"))


def _once(x: Column, use) -> Column:
    """use(x), with `x` computed once however often a fold looks at it."""
    return F.get(F.transform(F.array(x), use), 0)


def _merged(edges: Column, size: Column) -> Column:
    """The bits of the places between symbols that merging leaves; `edges` hold i, n, id in the order of ranks and places."""
    one = F.lit(1).cast("long")
    joining = F.filter(edges, lambda e: e["n"] > 1)
    # of an edge the places at its ends, and those between
    masks = F.transform(joining, lambda e: F.struct(_shift(one, e["i"]).bitwiseOR(_shift(one, e["i"] + e["n"])).alias("ends"), _shift(_shift(one, e["n"]) - 2, e["i"]).alias("inner")))

    def fold(masks: Column) -> Column:
        def step(state: Column, _: Column) -> Column:
            fits = lambda e: (state.bitwiseAND(e["ends"]) == e["ends"]) & (F.bit_count(state.bitwiseAND(e["inner"])) == 1)
            left = F.transform(F.slice(F.filter(masks, fits), 1, 1), lambda e: state.bitwiseAND(F.bitwise_not(e["inner"])))
            # a state below 0: no edge is left, and no later step looks for one
            return F.when(state < 0, state).otherwise(F.coalesce(F.get(left, 0), -state))

        return F.abs(F.aggregate(F.sequence(F.lit(1), size), _shift(one, size + 1) - 1, step))

    return _once(masks, fold)


def _best(edges: Column, size: Column, unknown: float) -> Column:
    """The same bits for the best path by scores; `edges` hold i, n, id, score."""

    def ahead(ways: Column, e: Column) -> Column:
        # the best way to place e; of several the one whose last piece is longest
        ends = F.filter(edges, lambda x: x["i"] + x["n"] == e)
        ways_here = F.transform(ends, lambda x: F.struct((F.get(ways, x["i"])["score"] + F.coalesce(x["score"], F.lit(unknown))).alias("score"), (-x["i"]).alias("from")))
        return F.concat(ways, F.array(F.array_max(ways_here)))

    start = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("from")))
    ways = F.aggregate(F.sequence(F.lit(1), size), start, ahead)
    one = F.lit(1).cast("long")

    def back(ways: Column) -> Column:
        def step(state: Column, _: Column) -> Column:
            at = -F.get(ways, state["at"])["from"]
            return F.when(state["at"] == 0, state).otherwise(F.struct(at.alias("at"), state["bits"].bitwiseOR(_shift(one, at)).alias("bits")))

        return F.aggregate(F.sequence(F.lit(1), size), F.struct(size.alias("at"), _shift(one, size).alias("bits")), step, lambda s: s["bits"])

    return _once(ways, back)


def _folded(units: DataFrame, path: str) -> DataFrame:
    """unit, ids: the segmentation of each distinct unit (column `unit`) by its lattice; null for long ones."""
    spark = units.sparkSession
    model = load(path)
    # the join is by a hash of 64 bits, which is much faster than by strings; hits are confirmed by the piece
    table = F.broadcast(spark.createDataFrame(model.rows, "known string, id int, rank int, score double").withColumn("_hash", F.xxhash64("known")))
    size = F.char_length("unit")
    start = units.where(size <= SHORT).select("unit", F.explode(F.sequence(F.lit(1), size)).alias("i"))
    span = start.select("unit", "i", F.explode(F.sequence(F.lit(1), F.least(F.lit(model.longest), size - F.col("i") + 1))).alias("n"))
    parts = span.withColumn("piece", F.substring(F.col("unit"), F.col("i"), F.col("n")))
    # single characters stay even without a piece, so that every unit has a lattice
    found = parts.withColumn("_hash", F.xxhash64("piece")).join(table, "_hash", "left").withColumn("id", F.when(F.col("known") == F.col("piece"), F.col("id")))
    edges = found.where("id IS NOT NULL OR n = 1")
    i, n = F.col("i") - 1, F.col("n")
    if model.kind == BPE:
        # an edge as one number, its rank above all, keeps the groups small and sorts fast
        number = ((F.coalesce("rank", F.lit(0)).cast("long") * 64 + i) * 64 + n) * (2 * SCALE) + F.coalesce(F.col("id") + 1, F.lit(0))
        lattice = edges.groupBy("unit").agg(F.sort_array(F.collect_list(number)).alias("e"))
        low = lambda x, skip, bits: F.shiftright(x, skip).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
        unpacked = F.transform("e", lambda x: F.struct(low(x, BITS + 7, 6).alias("i"), low(x, BITS + 1, 6).alias("n"), (low(x, 0, BITS + 1) - 1).alias("id")))
        fold = lambda e: _merged(e, size)
    else:
        lattice = edges.groupBy("unit").agg(F.collect_list(F.struct(i.alias("i"), n.alias("n"), F.coalesce("id", F.lit(-1)).alias("id"), "score")).alias("e"))
        unpacked = F.col("e")
        fold = lambda e: _best(e, size, model.unknown)
    one = F.lit(1).cast("long")

    def symbols(e: Column) -> Column:
        """Those edges whose ends, and no place between, are among the places left."""

        def chosen(places: Column) -> Column:
            # the places of a symbol, from its start to its end, hold the bits of both ends and no other
            own = F.filter(e, lambda x: F.call_function("shiftright", places, x["i"]).bitwiseAND(_shift(one, x["n"] + 1) - 1) == _shift(one, x["n"]) + 1)
            return F.sort_array(F.transform(own, lambda x: F.struct(x["i"].alias("i"), x["n"].alias("n"), x["id"].alias("id"))))

        return _once(fold(e), chosen)

    def ids(s: Column) -> Column:
        text = F.encode(F.substring(F.col("unit"), s["i"] + 1, s["n"]), "utf-8")
        as_bytes = F.transform(F.sequence(F.lit(1), F.octet_length(text)), lambda k: F.conv(F.hex(F.substring(text, k, F.lit(1))), 16, 10).cast("int") + model.bytes[0])
        return F.when(s["id"] >= 0, F.array(s["id"])).otherwise(as_bytes)

    folded = lattice.select("unit", F.flatten(F.transform(_once(unpacked, symbols), ids)).alias("ids"))
    return folded.unionByName(units.where(size > SHORT).select("unit", F.lit(None).cast("array<int>").alias("ids")))


def _filled(model: Model, batch: pa.RecordBatch) -> pa.Array:
    """The ids of a batch of `_folded`, with those of long units."""
    if not batch.column(1).null_count:
        return batch.column(1)
    return pa.array([model.segment(u) if x is None else x for u, x in zip(*(c.to_pylist() for c in batch.columns), strict=True)], pa.list_(pa.int32()))


def lattices(units: DataFrame, path: str) -> DataFrame:
    """unit, ids: the segmentation of each distinct unit (column `unit`)."""

    def run(it):
        model = load(path)
        for batch in it:
            yield pa.RecordBatch.from_arrays([batch.column(0), _filled(model, batch)], ["unit", "ids"])

    return _folded(units, path).mapInArrow(run, "unit string, ids array<int>")


# --- units of documents ------------------------------------------------------------------------


def _spans(model: Model, column: pa.Array) -> Iterator[tuple[int, int, str, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each chunk of texts: its range, the marked text, and of its units start, end, text, place in that text, hash.

    Texts become strings chunk by chunk, so that memory follows the chunk.
    """
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False) + 1)
    a = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + CHUNK_BYTES, "right")))
        whole, codes, start, end, owner = model.units([x or "" for x in column.slice(a, b - a).to_pylist()])
        first = np.zeros(b - a, np.int64)
        if len(start):
            head = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            first[owner[head]] = start[head]
        yield a, b, whole, start, end, owner, start - first[owner], span_hashes(codes, start, end) if len(start) else np.zeros(0, np.uint64)
        a = b


class Known:
    """Measures of frequent units by 64-bit hash and length: open addressing, at most half full."""

    def __init__(self, model: Model, units: list[str], values: np.ndarray):
        codes = np.frombuffer("".join(units).encode("utf-32-le"), "<u4")
        size = np.fromiter(map(len, units), np.int64, len(units))
        hashes = span_hashes(codes, np.cumsum(size) - size, np.cumsum(size)) if len(units) else np.zeros(0, np.uint64)
        slots = 1 << max(4, int(2 * len(units)).bit_length())
        self.mask = np.uint64(slots - 1)
        #: row 0 stands for units that are not here
        self.hash, self.size, self.values = np.append(np.uint64(0), hashes), np.append(0, size), np.vstack([np.zeros((1, MEASURES), np.int64), values.reshape(-1, MEASURES)])
        self.slot = np.zeros(slots, np.int32)
        left, at, self.probes = np.arange(1, len(units) + 1, dtype=np.int32), hashes & self.mask, 0
        while len(left):
            self.probes += 1
            free = self.slot[at] == 0
            self.slot[at[free]] = left[free]  # the last of several stays
            out = self.slot[at] != left
            left, at = left[out], (at[out] + np.uint64(1)) & self.mask

    def find(self, hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The row of each unit, 0 where it is not here."""
        out, left, at = np.zeros(len(hashes), np.int32), np.arange(len(hashes)), hashes & self.mask
        for _ in range(self.probes):
            row = self.slot[at]
            hit = (row > 0) & (self.hash[row] == hashes[left]) & (self.size[row] == sizes[left])
            out[left[hit]] = row[hit]
            rest = ~hit & (row > 0)
            left, at = left[rest], (at[rest] + np.uint64(1)) & self.mask
        return out


#: n_pieces, byte pieces, sum of ids + 1, the same times places, characters, sum of their codes, the same times places.
MEASURES = 7
_NAMES = ("n", "b", "s", "sp", "m", "c", "cp")


def measured(units: DataFrame, path: str) -> DataFrame:
    """unit and the measures of its ids, and of the text that they decode to.

    The ids are those of `lattices`; what is long is segmented and all is measured by one worker.
    """

    def run(it):
        model = load(path)
        says = [1 if isinstance(x, int) else len(x) for x in model.says]
        for b, i in enumerate(model.bytes):
            says[i] = int(b & 0xC0 != 0x80)
        begun = np.array(says, np.int64)  # characters that a piece begins
        for batch in it:
            lists = _filled(model, batch)
            offsets, flat = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy(zero_copy_only=False).astype(np.int64)
            flat, offsets = flat[offsets[0] : offsets[-1]], offsets - offsets[0]
            total = lambda x, o: np.diff(np.append(0, np.cumsum(x))[o])
            place = lambda x, o: np.cumsum(x) - x - np.repeat(np.append(0, np.cumsum(x))[o[:-1]], np.diff(o))
            out = [np.diff(offsets), total((flat >= model.bytes[0]) & (flat <= model.bytes[255]), offsets), total(flat + 1, offsets), total((flat + 1) * place(begun[flat], offsets), offsets)]
            decoded = [model.text(x, whole=False) for x in np.split(flat, offsets[1:-1])] if batch.num_rows else []
            ends = np.cumsum([0, *map(len, decoded)])
            codes = np.frombuffer("".join(decoded).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
            out += [np.diff(ends), total(codes, ends), total(codes * place(np.ones(len(codes), np.int64), ends), ends)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x.astype(np.int64)) for x in out)], ["unit", *_NAMES])
        release()

    return _folded(units, path).mapInArrow(run, "unit string, " + ", ".join(f"{c} long" for c in _NAMES))


def _digested(place, a, b):
    """What a unit at a place of its text adds to a digest."""
    return ((2 * place + 1) * a + 2 * b) % MODULUS


def frequent(documents: DataFrame, path: str) -> Known:
    """Measures of the units that occur most in a sample; the table only saves work."""
    share = min(1.0, SAMPLE_DOCS / max(documents.count(), 1))

    def count(it):
        model = load(path)
        for batch in it:
            seen: Counter = Counter()
            for _, _, whole, start, end, _, _, h in _spans(model, batch.column(0)):
                _, at, n = np.unique(h, return_index=True, return_counts=True)
                for s, e, k in zip(start[at].tolist(), end[at].tolist(), n.tolist(), strict=True):
                    if e - s <= SHORT:
                        seen[whole[s:e]] += k
            yield pa.record_batch({"unit": pa.array(list(seen), pa.string()), "k": pa.array(list(seen.values()), pa.int64())})
        release()

    sample = documents.select("text").sample(share, 17) if share < 1 else documents.select("text")
    counts = sample.mapInArrow(count, "unit string, k long").groupBy("unit").agg(F.sum("k").alias("k")).where("k > 1")
    top = cut(counts.orderBy(F.desc("k"), "unit").limit(FREQUENT).select("unit"))
    rows = measured(top.repartition(partitions(documents.sparkSession), "unit"), path).toPandas()
    return Known(load(path), rows["unit"].tolist(), rows[list(_NAMES)].to_numpy(np.int64))


def digests(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_pieces, n_bytes, ids_digest, n_chars, text_digest of every row.

    n_pieces and n_bytes count the pieces of the encoded text and those of them that
    stand for one byte; n_chars counts the characters of what they decode to.
    ids_digest is the sum of (id + 1) * (2 p + 1) over all pieces, p the number of
    characters that began before; text_digest that of code * (2 p + 3) over the
    characters of the decoded text at places p from 0; both modulo 2**31. So every
    unit adds what its ids and its decoded text say, and no text's ids need to meet.
    """
    path = path or model_path()
    spark = documents.sparkSession
    known = spark.sparkContext.broadcast(frequent(documents, path))
    sums = ("n_pieces", "n_bytes", "ids_digest", "n_chars", "text_digest")
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in sums), ("place", pa.int64()), ("unit", pa.string())])

    def split(it):
        model, table = load(path), known.value
        row = TaskContext.get().partitionId() << 40
        for batch in it:
            ids = batch.column(0)
            for a, b, whole, start, end, owner, place, h in _spans(model, batch.column(1)):
                at = table.find(h, end - start)
                edge = np.searchsorted(owner, np.arange(b - a + 1))
                total = lambda x, edge=edge: np.diff(np.append(0, np.cumsum(x))[edge])
                v = table.values[at]
                missing = np.flatnonzero(at == 0)
                ahead = np.append(place, 0)
                out = [total(v[:, 0]), total(v[:, 1]), total(_digested(place, v[:, 2], v[:, 3])), total(v[:, 4]), total(_digested(ahead[:-1], v[:, 5], v[:, 6]))]
                none = pa.nulls(b - a, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + b - a)), ids.slice(a, b - a), *(pa.array(x) for x in out), none, pa.nulls(b - a, pa.string())], schema=schema)
                if len(missing):
                    none = pa.nulls(len(missing), pa.int64())
                    names = [whole[s:e] for s, e in zip(start[missing].tolist(), end[missing].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(row + owner[missing]), none, *[none] * len(sums), pa.array(place[missing]), pa.array(names, pa.string())], schema=schema)
                row += b - a
        release()

    folder = f"{checkpoint_dir(spark)}/units-{uuid.uuid4().hex}"
    columns = "row long, doc_id long, " + ", ".join(f"{c} long" for c in sums) + ", place long, unit string"
    documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(split, columns).write.option("compression", "zstd").parquet(folder)
    split_ = spark.read.schema(columns).parquet(folder)
    rare = split_.where("unit IS NOT NULL").select("row", "place", "unit")
    # a number of partitions of its own: units make many edges, so that partitions that are joined by their bytes would spill
    found = measured(rare.select("unit").repartition(partitions(spark), "unit").distinct(), path)
    add = lambda a, b: F.expr(f"pmod((2 * place + 1) * {a} + 2 * {b}, {MODULUS})")
    each = rare.join(found, "unit").select("row", F.col("n").alias("n_pieces"), F.col("b").alias("n_bytes"), add("s", "sp").alias("ids_digest"), F.col("m").alias("n_chars"), add("c", "cp").alias("text_digest"))
    docs = split_.where("unit IS NULL").select("row", "doc_id", *sums)
    both = docs.unionByName(each, allowMissingColumns=True).groupBy("row").agg(F.max("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in sums])
    # the space in front is no part of the text: one character, of code 32 at place 0
    empty = F.col("n_chars") == 0
    return both.select("doc_id", "n_pieces", "n_bytes", F.pmod("ids_digest", F.lit(MODULUS)).alias("ids_digest"), F.when(empty, F.col("n_chars")).otherwise(F.col("n_chars") - 1).alias("n_chars"), F.when(empty, F.col("text_digest")).otherwise(F.pmod(F.col("text_digest") - 32, F.lit(MODULUS))).alias("text_digest"))


# --- whole texts -------------------------------------------------------------------------------


def _replaced(df: DataFrame, name: str, value: Column) -> list[Column]:
    return [*[F.col(c) for c in df.columns if c != name], value.alias(name)]


def encode(documents: DataFrame, path: str | None = None) -> DataFrame:
    """`documents` with `ids`, the piece ids of each text in order."""
    path = path or model_path()

    def split(it):
        model = load(path)
        for batch in it:
            for a, _, whole, start, end, owner, place, _ in _spans(model, batch.column(1)):
                names = [whole[s:e] for s, e in zip(start.tolist(), end.tolist(), strict=True)]
                yield pa.record_batch({"_sp_key": batch.column(0).take(pa.array(a + owner)), "_sp_place": pa.array(place), "unit": pa.array(names, pa.string())})
        release()

    # equal texts have equal ids, whatever rows they are in
    texts = documents.where("text <> ''").select(F.md5(F.col("text").cast("binary")).alias("_sp_key"), "text").dropDuplicates(["_sp_key"])
    units = texts.mapInArrow(split, "_sp_key string, _sp_place long, unit string")
    found = lattices(units.select("unit").distinct(), path)
    whole = units.join(found, "unit").groupBy("_sp_key").agg(F.array_sort(F.collect_list(F.struct("_sp_place", "ids"))).alias("p")).select("_sp_key", F.flatten(F.col("p.ids")).alias("_sp_ids"))
    keyed = documents.withColumn("_sp_key", F.md5(F.col("text").cast("binary")))
    ids = F.coalesce("_sp_ids", F.array().cast("array<int>"))
    return keyed.join(whole, "_sp_key", "left").select(*_replaced(documents, "ids", ids))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """`encoded` (with `ids`) with `decoded`, the text that the ids stand for; no shuffle."""
    path = path or model_path()
    columns = [c for c in encoded.columns if c != "decoded"]
    out = StructType([*[encoded.schema[c] for c in columns], StructField("decoded", StringType())])
    at = columns.index("ids")

    def run(it):
        model = load(path)
        for batch in it:
            texts = [model.text(x or ()) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*columns, "decoded"])

    return encoded.select(*columns).mapInArrow(run, out)

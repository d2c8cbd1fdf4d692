"""Packing of documents into fixed-length sequences by minimum bin slack.

Documents are tokenised once; only those longer than a sequence are cut. The
lengths of the pieces are whole numbers up to the sequence length, so a table of
counts a length, bounded by that length and not by the data, says all that the
search needs. Bin by bin, a bitset dynamic programme over the lengths still
available finds the fullest feasible combination beside the largest piece left;
it is removed as often as the counts allow. Pieces then find their place by
their rank among the pieces of the same length, which is dealt out over salts.

A null text is an empty one and still gives the closing id. Repeated rows are
packed each. Other columns are not read. No rows give no sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._dist import cut, dense_ranks, partitions
from ._text import batches, chunks
from .wordbpe import vocabulary_path, worker_tokenizer

SEQUENCE = 2048
CLOSING_ID = 0


def pieces(documents: DataFrame, path: str, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    end = np.array([CLOSING_ID], "<u4").tobytes()

    def encode(it):
        tok, step = worker_tokenizer(path), 4 * capacity
        for batch in it:
            rows = []
            doc_ids, items = batch.column(0).to_pylist(), [x or "" for x in batch.column(1).to_pylist()]
            for a, b in chunks(items, 1 << 20):
                for doc_id, own in zip(doc_ids[a:b], tok.encode_many(items[a:b]), strict=True):
                    ids = own + end
                    for k, at in enumerate(range(0, len(ids), step)):
                        part = ids[at : at + step]
                        rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield batches(schema, **dict(zip(schema.names, cols, strict=True)))

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, "doc_id long, piece int, start long, length long, ids_crc32 long")


def fullest(counts: Mapping[int, int], lengths: list[int], room: int) -> dict[int, int]:
    """The combination of available lengths with the largest sum up to `room`.

    Bit s of the set says that some combination sums to s. Lengths come in
    descending order; the copies of one are taken in powers of two.
    """
    mask, reach, steps, most = (1 << (room + 1)) - 1, 1, [], 1 << room
    for length in lengths:
        if length > room:
            continue
        left, k = min(counts[length], room // length), 1
        while left:
            take = min(k, left)
            left, k = left - take, 2 * k
            steps.append((reach, length, take))
            reach |= (reach << (length * take)) & mask
            if reach & most:
                break
        if reach & most:
            break
    at, chosen = reach.bit_length() - 1, {}
    for before, length, take in reversed(steps):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + take
            at -= length * take
    return chosen


def plan(counts: Mapping[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, first sequence, repetitions, offset).

    Pieces of `length` with ranks from `first rank` on go in turn to the
    sequences from `first sequence` on, `repetitions` of them, at `offset`;
    when these are used up, the next row of the length takes over.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    lengths = sorted(left, reverse=True)
    used = dict.fromkeys(left, 0)
    rows, sequence = [], 0
    while lengths:
        first = lengths[0]
        left[first] -= 1
        chosen = fullest(left, lengths if left[first] else lengths[1:], capacity - first)
        left[first] += 1
        chosen[first] = chosen.get(first, 0) + 1
        times = min(left[n] // m for n, m in chosen.items())
        offset = 0
        for n, m in sorted(chosen.items(), reverse=True):
            for _ in range(m):
                rows.append((n, used[n], sequence, times, offset))
                used[n] += times
                offset += n
            left[n] -= m * times
        sequence += times
        lengths = [n for n in lengths if left[n]]
    return rows


def pack(documents: DataFrame, path: str | None = None, capacity: int = SEQUENCE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    spark = documents.sparkSession
    parts = cut(pieces(documents, path or vocabulary_path(), capacity))
    counts = {r.length: r.n for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    by_length: dict[int, list] = {}
    for length, *row in plan(counts, capacity):
        by_length.setdefault(length, []).append(row)
    places = spark.sparkContext.broadcast({n: np.array(r, np.int64).T for n, r in by_length.items()})
    ranked = dense_ranks(parts, ["length"], [F.col(c) for c in ("doc_id", "piece", "ids_crc32")], "rank", partitions(spark))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(it):
        for batch in it:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in (3, 5))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length):
                mine = np.flatnonzero(length == n)
                first, base, _, off = places.value[int(n)]
                row = np.searchsorted(first, rank[mine], "right") - 1
                sequence[mine] = base[row] + rank[mine] - first[row]
                offset[mine] = off[row]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], schema=schema)

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

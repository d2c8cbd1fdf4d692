"""Token counts by a map-side, two-tier lookup, without any shuffle of words.

Tier one is a compact open-addressing hash table of the token counts of frequent
words, fitted on a bounded sample and broadcast; it is probed for all words of a
chunk at once. The sample is a share of all rows, taken and counted where they
lie, so that only counts of words travel. Tier two is the worker's own cache of the words that miss, which
the tokenizers library encodes on first sight.

Null and empty texts have no tokens and no bytes; repeated rows are each
counted; other columns of the input are not read. The table only saves time:
each hit is confirmed by 96 hash bits, and a word that it lacks is encoded.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._text import CHUNK, Words, batches, chunks, mix
from .wordbpe import WordBpe, vocabulary_path, worker_tokenizer

#: Bounds of the fitted table: documents of the sample, and entries.
SAMPLE_DOCS = 2_000
ENTRIES = 1 << 15


class LengthTable:
    """Open addressing with linear probing; 13 bytes a slot, at most half full."""

    def __init__(self, hashes: np.ndarray, checks: np.ndarray, counts: np.ndarray):
        size = 1 << max(4, int(2 * len(hashes)).bit_length())
        self.mask = np.uint64(size - 1)
        self.key, self.check, self.count = np.zeros(size, np.uint64), np.zeros(size, np.uint32), np.zeros(size, np.uint8)
        self.probes = 1
        for h, c, n in zip(hashes.tolist(), checks.tolist(), counts.tolist(), strict=True):
            at, probe = h & (size - 1), 1
            while self.count[at]:
                at, probe = (at + 1) & (size - 1), probe + 1
            self.key[at], self.check[at], self.count[at] = h, c, n
            self.probes = max(self.probes, probe)

    def find(self, hashes: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """The count of each word, 0 where the table lacks it."""
        out = np.zeros(len(hashes), np.int64)
        left = np.arange(len(hashes))
        at = hashes & self.mask
        for _ in range(self.probes):
            hit = (self.key[at] == hashes[left]) & (self.check[at] == checks[left]) & (self.count[at] > 0)
            out[left[hit]] = self.count[at[hit]]
            rest = ~hit & (self.count[at] > 0)
            left, at = left[rest], (at[rest] + np.uint64(1)) & self.mask
        return out


def word_keys(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each word, 64 bits and 32 further bits."""
    from ._text import span_hashes

    swapped = np.frombuffer(bytes(range(256))[::-1], np.uint8)[words.buf]
    second = span_hashes(swapped, words.start, words.end)
    return words.hashes(), (mix(second + np.uint64(0x51ED27)) >> np.uint64(32)).astype(np.uint32)


def _lowered(tok: WordBpe, text: str | None) -> bytes | None:
    """Normalised and lowered text; None: the library must count it."""
    words = tok.words(text or "")
    return None if words is None else " ".join(words).encode("utf-8", "surrogatepass")


def fit_table(documents: DataFrame, path: str, sample_docs: int = SAMPLE_DOCS, entries: int = ENTRIES) -> LengthTable:
    """The table of the words that occur most in a sample of whole texts."""

    def count(it):
        tok = worker_tokenizer(path)
        for batch in it:
            seen = Counter()
            for text in batch.column(0).to_pylist():
                seen.update(tok.words(text or "") or ())
            top = [(w, n) for w, n in seen.most_common(2 * entries) if len(w) <= 64]
            yield pa.record_batch({"word": pa.array([w for w, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())})

    share = min(1.0, sample_docs / max(documents.count(), 1))
    texts = documents.select("text")
    found = (texts.sample(share, 29) if share < 1 else texts).mapInArrow(count, "word string, n long")
    top = found.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(entries).select("word").collect()
    names = [r.word for r in top]
    tok = worker_tokenizer(path)
    counts = [len(x) // 4 for x in tok.encode_words(names)] if names else []
    fits = [(w, n) for w, n in zip(names, counts, strict=True) if 0 < n < 256]
    words = Words([w.encode() for w, _ in fits])
    keys, checks = word_keys(words)
    return LengthTable(keys, checks, np.array([n for _, n in fits], np.int64))


def token_counts(documents: DataFrame, path: str | None = None, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text."""
    path = path or vocabulary_path()
    table = documents.sparkSession.sparkContext.broadcast(fit_table(documents, path))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def count(it):
        tok, known, cache = worker_tokenizer(path), table.value, {}
        for batch in it:
            items = batch.column(1).to_pylist()
            sizes = [len(x.encode()) if x else 0 for x in items]
            totals = np.zeros(len(items), np.int64)
            lowered = []
            for i, x in enumerate(items):
                low = _lowered(tok, x)
                if low is None:
                    totals[i] = len(tok.library.encode(x, add_special_tokens=False).ids)
                lowered.append(low or b"")
            for a, b in chunks(lowered, CHUNK):
                words = Words(lowered[a:b])
                keys, checks = word_keys(words)
                counts = known.find(keys, checks)
                miss = np.flatnonzero(counts == 0)
                if len(miss):
                    _, at, back = np.unique(keys[miss], return_index=True, return_inverse=True)
                    counts[miss] = _misses(tok, cache, words, miss[at])[back]
                totals[a:b] += np.diff(np.concatenate([[0], np.cumsum(counts)])[words.first])
            yield batches(schema, doc_id=batch.column(0), n_bytes=sizes, n_tokens=totals, over_limit=totals > limit)

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def _misses(tok: WordBpe, cache: dict[bytes, int], words: Words, which: np.ndarray) -> np.ndarray:
    """Token counts of these words through the worker's cache."""
    names = [words.text(i, i + 1) for i in which.tolist()]
    new = [w for w in names if w not in cache]
    if new:
        if len(cache) + len(new) > tok.cache:
            cache.clear()
            new = names
        found = dict(zip(new, (len(x) // 4 for x in tok.encode_words([w.decode("utf-8", "surrogatepass") for w in new])), strict=True))
        cache.update((w, n) for w, n in found.items() if len(w) <= 256)
        return np.array([found[w] if w in found else cache[w] for w in names], np.int64)
    return np.array([cache[w] for w in names], np.int64)

"""The word-level BPE tokenizer as a worker-side table of words.

The tokenizers library defines the result. Its normaliser (NFC, white space to
spaces, lower case) and its split into pre-tokens never act across white space,
and its merges never leave a pre-token; so the ids of a text are the ids of its
words in order. A worker keeps the ids of the words it has met; new words are
split into pre-tokens, encoded by the library in one call and told apart by the
end-of-word tokens. A text that holds the string of an added token, or one of the
four separators on which Python and the library differ, goes to the library whole.
"""

from __future__ import annotations

import json
import os
import unicodedata
from functools import lru_cache

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Words that a worker remembers; beyond it the table starts anew, so that memory is bounded.
CACHE = 700_000
#: Longer words (in characters) are encoded each time.
LONGEST = 64


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordBpe:
    def __init__(self, path: str, cache: int = CACHE):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_str(json.dumps(spec))
        self.bare = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "added_tokens": []}))
        self.whole = [*(t["content"] for t in spec["added_tokens"]), "\x1c", "\x1d", "\x1e", "\x1f"]
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.ends = np.zeros(max(spec["model"]["vocab"].values()) + 1, bool)
        self.ends[[i for t, i in spec["model"]["vocab"].items() if t.endswith(spec["model"]["end_of_word_suffix"])]] = True
        self.cache = cache
        self.known: dict[str, bytes] = {}

    def words(self, text: str) -> list[str] | None:
        """The words in lower case; None: only the library can tell."""
        if any(mark in text for mark in self.whole):  # plain searches are faster than one pattern
            return None
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # the library lowers each character alone
                return "".join(c.lower() for c in text).split()
        return text.lower().split()

    def pretokens(self, word: str) -> list[str]:
        return self.pattern.findall(word)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word, by one call of the library."""
        if not words:
            return []
        split = [[w] if w.isalpha() else self.pattern.findall(w) for w in words]
        ids = np.array(self.bare.encode_batch_fast([" ".join([" ".join(p) for p in split])], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        counts = np.cumsum([len(p) for p in split])
        if len(ends) != counts[-1]:
            raise ValueError("the tokenizer does not end each pre-token with an end-of-word token")
        data, at, out = ids.tobytes(), 0, []
        for e in (ends[counts - 1] * 4).tolist():
            out.append(data[at:e])
            at = e
        return out

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """Puts these words into the table; returns those that are too long for it."""
        known = self.known
        new = words.difference(known)
        if len(known) + len(new) > self.cache:
            known.clear()
            new = words
        # letters and one mark are two pre-tokens
        marked = [w for w in new if w[-1] in ".," and w[:-1].isalpha()]
        plain = new.difference(marked).union([w[:-1] for w in marked]).union(".,").difference(known)
        long = {}
        names = list(plain)
        for w, i in zip(names, self.encode_words(names), strict=True):
            (known if len(w) <= LONGEST else long)[w] = i
        for w in marked:
            base = w[:-1]
            (known if len(w) <= LONGEST else long)[w] = (known.get(base) or long[base]) + known[w[-1]]
        return long

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, unsigned 32-bit little-endian."""
        lists = [self.words(t) for t in texts]
        long = self.learn(set().union(*[x for x in lists if x]))
        known = self.known
        out = []
        for text, words in zip(texts, lists, strict=True):
            if words is None:
                out.append(np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes())
            elif long:
                out.append(b"".join([known.get(w) or long[w] for w in words]))
            else:
                out.append(b"".join([known[w] for w in words]))
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]


@lru_cache(1)
def worker_tokenizer(path: str) -> WordBpe:
    """One a worker process, kept from task to task."""
    return WordBpe(path)

"""Encoding of a corpus with a public byte-level BPE, each distinct word once and shared prefixes once.

Words are walked as a trie in depth-first order: sorted, each word keeps the states of the prefix it shares with the word
before. The state of a prefix is the last token of its encoding. A longer prefix ends in the one vocabulary item t that is a suffix of it
and may follow the last token u of what comes before, that is, where merging bytes(u) + bytes(t) gives exactly u, t. So each trie
node is worked out once, whatever number of words passes it.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORDS_KEPT, PAIRS_KEPT = 300_000, 2_000_000


class TrieEncoder:
    """Words (bytes) to ids. Keeps encoded words and tested pairs up to a bound, then starts anew."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.lengths = [set() for _ in range(256)]  # by last byte: lengths of the items that end in it
        for b in ranks:
            self.lengths[b[-1]].add(len(b))
        self.lengths = [sorted(x, reverse=True) for x in self.lengths]
        self.words: dict[str, list[int]] = {}
        self.pairs: dict[int, bool] = {}

    def merge(self, b: bytes) -> list[int]:
        """Plain merging, lowest rank first; only for two tokens' bytes."""
        parts = [b[i : i + 1] for i in range(len(b))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def follows(self, u: int, t: int) -> bool:
        k = u << 32 | t
        ok = self.pairs.get(k)
        if ok is None:
            if len(self.pairs) > PAIRS_KEPT:
                self.pairs.clear()
            ok = self.pairs[k] = self.merge(self.bytes_of[u] + self.bytes_of[t]) == [u, t]
        return ok

    def own(self, t: int) -> bool:
        """Whether the item encodes to itself."""
        k = -1 - t
        ok = self.pairs.get(k)
        if ok is None:
            ok = self.pairs[k] = self.merge(self.bytes_of[t]) == [t]
        return ok

    def encode_new(self, words: list[str]) -> None:
        todo = sorted((w.encode("utf-8", "surrogatepass"), w) for w in words)
        before, last, size = b"", [], []  # states of the prefixes of the word before
        ranks, words_of = self.ranks, self.words
        for b, w in todo:
            whole = ranks.get(b)
            common, top = 0, min(len(before), len(b))
            while common < top and before[common] == b[common]:
                common += 1
            del last[common:], size[common:]
            for i in range(common + 1, len(b) + 1):
                for n in self.lengths[b[i - 1]]:
                    if n > i:
                        continue
                    t = ranks.get(b[i - n : i])
                    if t is not None and (self.own(t) if n == i else self.follows(last[i - n - 1], t)):
                        last.append(t)
                        size.append(n)
                        break
                else:
                    raise ValueError("the vocabulary lacks single bytes")
            before = b
            if whole is not None and last[-1] == whole:
                words_of[w] = [whole]
                continue
            ids, i = [], len(b)
            while i:
                ids.append(last[i - 1])
                i -= size[i - 1]
            words_of[w] = ids[::-1]

    def encode(self, texts: list[str | None], split) -> list[list[int]]:
        parts = [split(t) if t else [] for t in texts]
        if len(self.words) > WORDS_KEPT:
            self.words.clear()
        new = {w for p in parts for w in p}.difference(self.words)
        if new:
            self.encode_new(list(new))
        of = self.words
        return [[i for w in p for i in of[w]] for p in parts]


@lru_cache(maxsize=2)
def encoder(path: str) -> tuple[TrieEncoder, object]:
    """One a worker process; the vocabulary is read from path, which every executor has."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return TrieEncoder(ranks), regex.compile(PATTERN).findall


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY, count_only: bool = False) -> DataFrame:
    """(key, ids array<int>) or, with count_only, (key, n_tokens long) of every row, repeats included.

    Null and empty texts have an empty list (0 tokens). No special tokens; text that looks like one is ordinary text. Other columns are
    dropped; an empty table gives none. Texts are whole, whatever their length.
    """
    kind = df.schema[key].dataType.simpleString()
    name, out = ("n_tokens", "long") if count_only else ("ids", "array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, split = encoder(path)
        for b in batches:
            for at in range(0, len(b), 500):
                part = b.slice(at, 500)
                ids = enc.encode(part.column(1).to_pylist(), split)
                col = pa.array([len(x) for x in ids], pa.int64()) if count_only else pa.array(ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), col], [key, name])

    return df.select(F.col(key), F.col(text).alias("text")).mapInArrow(run, f"`{key}` {kind}, {name} {out}")

"""Byte-level byte-pair encoding of whole texts in batched numpy merge rounds.

The symbols of many words lie in one flat array. A round looks up the rank of every adjacent pair by binary search over the sorted
pair keys, takes the lowest rank of each word and merges its occurrences from left to right, all words at once. A word leaves the
array when none of its pairs can be merged. Words of more than LONG bytes (no natural ones: runs without a space or
punctuation), which would need thousands of rounds of their own, are merged with a queue instead, in the same order and to the same ids;
no text is cut.

Defined results: a null or empty text has no ids; text that looks like a special token is ordinary text; unpaired surrogates
can't occur in a table's text. Decoding the ids gives the text back, byte for byte.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialforge.functions.partitions import spread

LONG = 2048
#: Words whose ids are remembered by a worker.
MEMO = 200_000
_NONE = np.iinfo(np.int64).max


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where a public tokenizer's file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[str, int]:
    """The letters by which a byte-level vocabulary writes bytes: printable ones stand for themselves, others follow from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class BytePairs:
    """A vocabulary and its merges as sorted pair keys."""

    def __init__(self, path: str, pattern: str):
        model = json.load(open(path, encoding="utf-8"))["model"]
        vocab, letters = model["vocab"], _byte_letters()
        self.width = max(vocab.values()) + 1
        self.tokens = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if all(c in letters for c in t)}
        self.byte_ids = np.zeros(256, dtype=np.int64)
        for c, b in letters.items():
            self.byte_ids[b] = vocab[c]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.words = regex.compile(pattern)
        self.memo: dict[str, np.ndarray] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def _rounds(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of words, merged together."""
        out: list[np.ndarray] = [np.empty(0, dtype=np.int64)] * len(words)
        sym = self.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
        own = np.repeat(np.arange(len(words)), [len(w) for w in words])
        while len(sym):
            rank = np.full(len(sym), _NONE)
            inside = np.flatnonzero(own[1:] == own[:-1])
            rank[inside] = self._rank(sym[inside], sym[inside + 1])
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            lowest = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(sym)])
            done = lowest == _NONE
            if done.any():
                for k in np.flatnonzero(done):
                    out[own[starts[k]]] = sym[starts[k] : starts[k] + sizes[k]].copy()
                stay = np.repeat(~done, sizes)
                sym, own, rank = sym[stay], own[stay], rank[stay]
                lowest, sizes = lowest[~done], sizes[~done]
                if not len(sym):
                    break
            hit = rank == np.repeat(lowest, sizes)
            # of overlapping occurrences (a run of equal symbols) every second merges, from the left
            at = np.flatnonzero(hit)
            new_run = np.r_[True, (np.diff(at) > 1) | (own[at[1:]] != own[at[:-1]])]
            pos = np.arange(len(at)) - np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
            at = at[pos % 2 == 0]
            sym[at] = self.merged[rank[at]]
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
            sym, own = sym[keep], own[keep]
        return out

    def _long(self, word: bytes) -> np.ndarray:
        """The ids of one long word: linked symbols and a queue of pairs by rank and place."""
        sym = self.byte_ids[np.frombuffer(word, dtype=np.uint8)]
        first = self._rank(sym[:-1], sym[1:])
        queue = [(int(r), int(i)) for i, r in enumerate(first) if r != _NONE]
        heapq.heapify(queue)
        ids, nxt, prv = sym.tolist(), list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        end, keys, ranks, width = len(ids), self.keys, self.ranks, self.width

        def rank(a: int, b: int) -> int:
            key = ids[a] * width + ids[b]
            at = int(np.searchsorted(keys, key))
            return int(ranks[at]) if at < len(keys) and keys[at] == key else -1

        while queue:
            r, i = heapq.heappop(queue)
            j = nxt[i]
            if ids[i] < 0 or j >= end or rank(i, j) != r:
                continue
            ids[i], ids[j] = int(self.merged[r]), -1
            nxt[i] = nxt[j]
            if nxt[j] < end:
                prv[nxt[j]] = i
                if (x := rank(i, nxt[i])) >= 0:
                    heapq.heappush(queue, (x, i))
            if prv[i] >= 0 and (x := rank(prv[i], i)) >= 0:
                heapq.heappush(queue, (x, prv[i]))
        return np.array([x for x in ids if x >= 0], dtype=np.int64)

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        pieces = [self.words.findall(t) if t else [] for t in texts]
        if len(self.memo) > MEMO:
            self.memo.clear()
        fresh = list({w for p in pieces for w in p if w not in self.memo})
        raw = [w.encode("utf-8") for w in fresh]
        short = [k for k, b in enumerate(raw) if len(b) <= LONG]
        got = dict(zip(short, self._rounds([raw[k] for k in short])))
        new = {w: got[k] if k in got else self._long(raw[k]) for k, w in enumerate(fresh)}
        self.memo.update((w, new[w]) for k, w in enumerate(fresh) if k in got)
        none = np.empty(0, dtype=np.int64)
        return [np.concatenate([self.memo[w] if w in self.memo else new[w] for w in p]) if p else none for p in pieces]

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.tokens[i] for i in ids).decode("utf-8")


@lru_cache(maxsize=2)
def load(path: str, pattern: str | None = None) -> BytePairs:
    """The vocabulary of a file; each worker reads it once. The pattern that cuts words is the public tokenizers' own."""
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    return BytePairs(path, pattern)


def _encode(df: DataFrame, key: str, text: str, path: str | None, count: bool) -> DataFrame:
    path = path or vocabulary_path()
    name, kind = ("n_tokens", pa.int64()) if count else ("ids", pa.list_(pa.int32()))
    key_type = dict(df.dtypes)[key]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        model.memo.clear()  # words are remembered within a task, so that a run doesn't depend on those before it
        for batch in batches:
            size = max(1, min(512, batch.num_rows))
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                ids = model.encode_batch(part.column(1).to_pylist())
                if count:
                    col = pa.array([len(x) for x in ids], kind)
                else:
                    flat = np.concatenate(ids) if ids else np.empty(0)
                    ends = np.cumsum([0, *(len(x) for x in ids)])
                    col = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(np.int32), pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), col], ["k", name])

    flat = spread(df.select(F.col(key).alias("k"), F.col(text).alias("t")))
    return flat.mapInArrow(work, f"k {key_type}, {name} {'bigint' if count else 'array<int>'}").withColumnRenamed("k", key)


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """key and ids of each row. No shuffle; rows of any number and texts of any length."""
    return _encode(df, key, text, path, False)


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """key and n_tokens of each row."""
    return _encode(df, key, text, path, True)

"""Byte-level BPE encoding and decoding with length-bucketed padded matrices.

Distinct pre-tokens of similar length are rows of one numpy matrix. Each round looks all neighbouring pairs up in a
hashed pair table, merges the leftmost pair of least rank in every row, and compacts the matrix; rows without a pair
leave it.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import tidy
from .pretokens import looked_up, splitter

NONE = np.int32(2**31 - 1)
EDGES = (2, 4, 6, 8, 12, 16, 24, 32, 48, 64)
CELLS = 1 << 20  # cells of a matrix


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank from a .tiktoken file."""
    with open(path, "rb") as lines:
        pairs = [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, lines)]
    out = [b""] * (max(r for _, r in pairs) + 1)
    for token, rank in pairs:
        out[rank] = token
    return out


class Vocabulary:
    def __init__(self, path: str) -> None:
        self.tokens = read_ranks(path)
        self.ranks = {t: i for i, t in enumerate(self.tokens) if t}
        self.start = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = [(a, b, r) for t, r in self.ranks.items() for i in range(1, len(t)) if (a := self.ranks.get(t[:i])) is not None and (b := self.ranks.get(t[i:])) is not None]
        a, b, r = (np.array(x, np.int64) for x in zip(*pairs))
        self.bits = max(4, int(2 * len(a)).bit_length() + 1)
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        left, at = a << 32 | b, None
        at = self._slot(left)
        while len(left):  # linear probing, all pairs at once; the first to reach a free slot has it
            free = np.flatnonzero(self.keys[at] == -1)
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.keys[at[won]], self.values[at[won]] = left[won], r[won]
            rest = np.ones(len(left), bool)
            rest[won] = False
            left, r, at = left[rest], r[rest], (at[rest] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE for those that the table lacks or that touch padding (-1)."""
        key = (a.astype(np.int64) << 32 | (b.astype(np.int64) & 0xFFFFFFFF)).ravel()
        out = np.full(len(key), NONE, np.int32)
        open_ = np.flatnonzero((a.ravel() >= 0) & (b.ravel() >= 0))
        at = self._slot(key[open_])
        while len(open_):
            have = self.keys[at]
            hit = have == key[open_]
            out[open_[hit]] = self.values[at[hit]]
            on = ~hit & (have != -1)
            open_, at = open_[on], (at[on] + 1) & (len(self.keys) - 1)
        return out.reshape(a.shape)

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        buckets: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            whole = self.ranks.get(w)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif w:
                wide = next((e for e in EDGES if len(w) <= e), 1 << len(w).bit_length())
                buckets.setdefault(wide, []).append(i)
        for wide, rows in buckets.items():
            step = max(1, CELLS // wide)
            for at in range(0, len(rows), step):
                self._merge([words[i] for i in rows[at : at + step]], rows[at : at + step], wide, out)
        return out

    def _merge(self, words: list[bytes], rows: list[int], wide: int, out: list[bytes]) -> None:
        length = np.array([len(w) for w in words])
        ids = np.full((len(words), wide), -1, np.int32)
        ids[np.arange(wide) < length[:, None]] = self.start[np.frombuffer(b"".join(words), np.uint8)]
        where = np.array(rows)
        ranks = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        while len(where):
            at = ranks.argmin(axis=1)
            line = np.arange(len(where))
            least = ranks[line, at]
            done = least == NONE
            for i in np.flatnonzero(done):
                out[where[i]] = ids[i, : length[i]].astype("<u4").tobytes()
            if done.any():
                on = ~done
                ids, ranks, where, length, at, least = ids[on], ranks[on], where[on], length[on], at[on], least[on]
                line = np.arange(len(where))
            if not len(where):
                break
            # the merged pair becomes one cell, and the cells after it move up; the width follows the longest row
            length = length - 1
            width = int(length.max())
            cols = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, cols + (cols > at[:, None]), axis=1)
            ids[line, at] = least
            cols = cols[:-1]
            ranks = np.take_along_axis(ranks, np.minimum(cols + (cols >= at[:, None]), ranks.shape[1] - 1), axis=1)
            ids, ranks = ids[:, :width], ranks[:, : max(0, width - 1)]
            if width < 2:
                ranks = np.full((len(where), 1), NONE, np.int32)
                continue
            before, after = at > 0, at < width - 1
            b, a = line[before], line[after]
            ranks[b, at[b] - 1] = self.pair_ranks(ids[b, at[b] - 1], ids[b, at[b]])
            ranks[a, at[a]] = self.pair_ranks(ids[a, at[a]], ids[a, at[a] + 1])
            ranks[(at == length - 1) & (at < width - 1), at[(at == length - 1) & (at < width - 1)]] = NONE


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(2)
def _known(path: str) -> dict[str, bytes]:
    return {}


def _encoder(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, known, split = vocabulary(path), _known(path), splitter(pattern)
        learn = lambda new: vocab.encode_words([w.encode("utf-8", "surrogatepass") for w in new])
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [b"".join(row) for row in looked_up(part.column(1).to_pylist(), split, known, learn)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])
        tidy(known)

    return run


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids) for every row of docs: the ids of the whole text as little-endian unsigned 32-bit integers.

    Each match of the pattern is encoded separately; strings of special tokens are ordinary text. Null or empty text has
    no ids; repeated rows give repeated results; an empty table gives an empty result; other columns are ignored.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_encoder(path, pattern), "doc_id long, n_tokens long, ids binary")


def _decoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = vocabulary(path).tokens
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out = [None if x is None else b"".join(map(tokens.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded (doc_id, n_tokens, ids) with the bytes that the ids stand for as `decoded`; null ids give null."""
    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(_decoder(path), "doc_id long, n_tokens long, ids binary, decoded binary")

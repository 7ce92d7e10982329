"""Packing of token sequences: first-fit decreasing over a tournament tree of bin capacities, in randomised groups.

Documents are cut into pieces of at most the capacity. Pieces are dealt at random into groups of a bounded expected size, so no document, source or group of copies decides a group; each group is packed
on its own. The tree holds the free room of each bin and, in inner nodes, the most room below: the first bin with
enough room is found in one descent.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import settle, tidy
from .pretokens import looked_up, splitter

CAPACITY = 1024
GROUP = 20_000  # expected pieces of a group
SEED = 1024  # of the random deal


class Bins:
    """A tournament tree over the room left in bins; bin i is leaf i."""

    def __init__(self, most: int, capacity: int) -> None:
        self.leaves = 1 << max(0, (most - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """Put a piece into the first bin with room; the bin and the room that it had before."""
        room, node = self.room, 1
        while node < self.leaves:
            node *= 2
            if room[node] < size:
                node += 1
        had, leaf = room[node], node - self.leaves
        room[node] = had - size
        node //= 2
        while node:
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
            node //= 2
        return leaf, had


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; the longest pieces go first, ties by position. Full pieces have bins of their own."""
    order = np.argsort(-lengths, kind="stable")
    bin_, offset = np.empty(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    full = int((lengths == capacity).sum())
    bin_[order[:full]] = np.arange(full)
    tree = Bins(max(1, len(lengths) - full), capacity)
    for i, size in zip(order[full:].tolist(), lengths[order[full:]].tolist()):
        at, had = tree.place(size)
        bin_[i], offset[i] = full + at, capacity - had
    return bin_, offset


@lru_cache(2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores, and threads keep memory of their own
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t, {}


def _cutter(path: str, pattern: str, capacity: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (tokenizer, known), split, last = _tokenizer(path), splitter(pattern), end.to_bytes(4, "little")

        def learn(new: list[str]) -> list[bytes]:
            return [array("I", x.ids).tobytes() for x in tokenizer.encode_batch_fast(new, add_special_tokens=False)]

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part, rows = batch.slice(lo, 256), []
                for doc, row in zip(part.column(0).to_pylist(), looked_up(part.column(1).to_pylist(), split, known, learn)):
                    ids = b"".join(row) + last
                    for at in range(0, len(ids), 4 * capacity):
                        piece = ids[at : at + 4 * capacity]
                        rows.append((doc, at // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        tidy(known)

    return run


def _packer(capacity: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        bin_, offset = first_fit_decreasing(group["length"].to_numpy(), capacity)
        sequence = pa.array(group["g"][0].as_py() * (1 << 32) + bin_)
        return pa.table([*(group[c] for c in PARTS), sequence, pa.array(offset)], names=[*PARTS, "sequence_id", "offset"])

    return run


PARTS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pack(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, group: int = GROUP, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is the ids of its whole text, then the id `end`. Every id lies in one piece, every piece in one sequence
    of at most `capacity` ids, without gaps. Null or empty text is the end id alone; rows that repeat a doc_id are
    documents of their own; an empty table gives an empty result; other columns are ignored. A sequence_id holds the group in its upper bits.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # the random number is written with the piece, so a task that runs again deals it alike, and copies of a row go to different groups
    pieces = settle(base.mapInArrow(_cutter(path, pattern, capacity, end), PIECES).withColumn("r", F.rand(SEED)))
    groups = max(1, round(pieces.count() / group))
    dealt = pieces.withColumn("g", F.floor(F.col("r") * groups).cast("long"))
    return dealt.groupBy("g").applyInArrow(_packer(capacity), PIECES + ", sequence_id long, offset long")

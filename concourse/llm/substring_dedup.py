"""Removal of repeated byte strings by distributed prefix doubling over sparse suffix positions.

Names (ranks) of equal-length strings stand for their order classes, as in prefix doubling: positions whose name is
unique drop out, the others are renamed at a greater length, until they are unique or reach the threshold. Three things
keep the shuffled rows few. Only the anchor of each window is a position at first (equal windows have their anchor at
one offset). Then the windows of an anchor are taken together, in blocks: if the string that spans the block is
repeated, all its windows are; if the string that they share is unique, none is; only the rest is split and renamed.
One witness of each repeated block stays, so that partial matches of others still find it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import discard, mix64, settle, tidy
from .repeats import CHUNK, Names, anchors

LENGTH = 200
GRAM = 50
BLOCKS = (16, 4, 1)
_KEY = "k long, h long"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _encode(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def _anchor_rows(length: int, gram: int):
    def of(texts: list[bytes]) -> list[tuple]:
        """Per text: names of anchors, of the strings over their windows, positions, window offsets; texts are taken a bounded chunk at a time."""
        out: list[list] = [[] for _ in texts]
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= CHUNK):
                size += len(texts[j])
                j += 1
            data = np.frombuffer(b"".join(texts[i:j]), np.uint8)
            ends = np.cumsum([len(x) for x in texts[i:j]])
            for at in range(0, max(1, len(data)), CHUNK):  # longer than a chunk only if a single text is
                part = data[at : at + CHUNK + length - 1]
                stops = ends if len(part) == len(data) else np.array([len(part)])
                name, m, lo, hi = anchors(part, stops, length, gram)
                if not len(m):
                    continue
                over = mix64(Names(part).at(lo, hi + length) ^ ((m - lo).astype(np.uint64) * _ODD))
                text = np.searchsorted(stops, m, side="right")
                first = np.r_[0, stops[:-1]][text] - at
                packed = (m - lo) << 16 | (m - hi)
                cuts = np.flatnonzero(np.r_[True, text[1:] != text[:-1], True])
                for a, b in zip(cuts[:-1], cuts[1:]):
                    out[i + text[a]].append((name[a:b], over[a:b], (m - first)[a:b], packed[a:b]))
            i = j
        return [tuple(np.concatenate(x) for x in zip(*parts)) if parts else None for parts in out]

    def merged(row: tuple) -> tuple:
        """An anchor met in two chunks of a text is one anchor with the union of its windows."""
        name, over, m, packed = row
        twice = np.flatnonzero(m[1:] == m[:-1])
        if len(twice):
            packed[twice] = np.maximum(packed[twice] >> 16, packed[twice + 1] >> 16) << 16 | np.minimum(packed[twice] & 0xFFFF, packed[twice + 1] & 0xFFFF)
            over[twice] = mix64(over[twice] ^ over[twice + 1] * _ODD)
            name, over, m, packed = (np.delete(x, twice + 1) for x in (name, over, m, packed))
        return name, over, m, packed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [None if r is None else merged(r) for r in of([_encode(t) for t in batch.column(2).to_pylist()])]
            keep = pa.array([i for i, r in enumerate(rows) if r is not None], pa.int64())
            rows = [r for r in rows if r is not None]
            if rows:
                lists = [pa.array([r[c].view(np.int64) if c < 2 else r[c] for r in rows], pa.list_(t)) for c, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int32()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep), *lists], names=["k", "h", "name", "over", "m", "o"])
        tidy()

    return run


def _contexts(length: int):
    """For each open anchor of a text, the bytes around it that its windows cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, h, text, marks in zip(*(c.to_pylist() for c in batch.columns)):
                data = _encode(text)
                for m, o, quiet in {(x["m"], x["o"], x["quiet"]) for x in marks}:
                    far, near = o >> 16, o & 0xFFFF
                    rows.append((k, h, m, near, far, quiet, data[m - far : m - near + length]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()))], names=["k", "h", "m", "near", "far", "quiet", "context"])

    return run


def _block_names(length: int, size: int):
    """Names of the blocks of `size` windows that cover the offsets near..far of each row: of the string over the block (the part of it that the row has) and of the string that all its windows share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            near, far = (batch.column(i).to_numpy().astype(np.int64) for i in (3, 4))
            parts = batch.column(6).to_pylist()
            data = np.frombuffer(b"".join(parts), np.uint8)
            base = np.r_[0, np.cumsum([len(x) for x in parts])[:-1]] + far  # where offset 0 of the row lies
            count = far // size - near // size + 1
            row = np.repeat(np.arange(len(parts)), count)
            block = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + (near // size)[row]
            lo, hi = np.maximum(block * size, near[row]), np.minimum(block * size + size - 1, far[row])
            names, at = Names(data), base[row]
            over = mix64(names.at(at - hi, at - lo + length) ^ ((hi * 65536 + lo).astype(np.uint64) * _ODD))
            # the core of the whole block lies in each of its windows
            core = mix64(names.at(at - block * size, at - block * size - size + 1 + length) ^ (block.astype(np.uint64) * _ODD))
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(take) for i in (0, 1, 2)), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), batch.column(5).take(take), pa.array(over.view(np.int64)), pa.array(core.view(np.int64))], names=["k", "h", "m", "near", "far", "quiet", "over", "core"])

    return run


def _cut_contexts(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, h, m, far, context, marks in zip(*(c.to_pylist() for c in batch.columns)):
                for x in marks:
                    rows.append((k, h, m, x["near"], x["far"], x["quiet"], context[far - x["far"] : far - x["near"] + length]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()))], names=["k", "h", "m", "near", "far", "quiet", "context"])

    return run


_CONTEXT = _KEY + ", m long, near int, far int, quiet boolean, context binary"


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(k, h, spans array<struct<s, e>>) for each text of docs (k, h, text) with bytes in a repeated string of `length` bytes; spans may overlap.

    (k, h) names the text: rows with equal texts are one here, and all of such a text is repeated.
    """
    docs = docs.where(F.octet_length("text") >= length).select("k", "h", "text")
    copied = settle(docs.groupBy("k", "h").agg(F.count("*").alias("n"), F.max(F.octet_length("text")).cast("long").alias("e")).where("n > 1").select("k", "h", F.lit(0).cast("long").alias("s"), "e"))
    # copies meet in place before the shuffle: dropDuplicates keeps one of a key in each task first
    table = docs.mapInArrow(_anchor_rows(length, gram), _KEY + ", name array<long>, over array<long>, m array<long>, o array<int>")
    table = settle(table.dropDuplicates(["k", "h"]))
    rows = table.select("k", "h", F.inline(F.arrays_zip("name", "over", "m", "o")))
    # counts are written before they are joined back: a join right on an aggregate shares its shuffle and can't split a hot name
    twice = settle(rows.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name"))
    rows = settle(rows.join(twice, "name"), table)
    spot = F.xxhash64("k", "h", "m")
    kinds = settle(rows.groupBy("name", "over").agg(F.count("*").alias("n"), F.min(spot).alias("witness")))
    mixed = settle(kinds.groupBy("name").agg(F.count("*").alias("kinds")).where("kinds > 1").select("name", F.lit(True).alias("mixed")))
    kinds = settle(kinds.join(mixed, "name", "left").where("n > 1 or mixed"))
    state = settle(rows.join(kinds, ["name", "over"]).select("k", "h", "m", "o", (F.col("n") > 1).alias("quiet"), (F.coalesce("mixed", F.lit(False)) & (spot == F.col("witness"))).alias("open")), rows)
    found = [copied, state.where("quiet").select("k", "h", (F.col("m") - F.shiftright("o", 16)).alias("s"), (F.col("m") - F.col("o").bitwiseAND(0xFFFF) + length).alias("e"))]
    marks = state.where("open").groupBy("k", "h").agg(F.collect_list(F.struct("m", "o", "quiet")).alias("marks"))
    open_ = settle(docs.join(settle(marks), ["k", "h"]).select("k", "h", "text", "marks").mapInArrow(_contexts(length), _CONTEXT).dropDuplicates(["k", "h", "m", "near", "far", "quiet"]))
    for size in BLOCKS:
        named = settle(open_.mapInArrow(_block_names(length, size), _KEY + ", m long, near int, far int, quiet boolean, over long, core long"))
        spot = F.xxhash64("k", "h", "m", "near")
        same = settle(named.groupBy("over").agg(F.count("*").alias("n"), F.min(spot).alias("witness")).where("n > 1"))
        repeated = settle(named.join(same, "over", "left").select(*named.columns, F.coalesce("n", F.lit(1)).alias("n"), F.coalesce("witness", spot).alias("witness")), named)
        found.append(settle(repeated.where("n > 1 and not quiet").select("k", "h", (F.col("m") - F.col("far")).alias("s"), (F.col("m") - F.col("near") + length).alias("e"))))
        if size == 1:
            discard(repeated)
            break
        left = repeated.where(spot == F.col("witness")).select("k", "h", "m", "near", "far", (F.col("quiet") | (F.col("n") > 1)).alias("quiet"), "core")
        shared = settle(left.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core"))
        marks = left.join(shared, "core").groupBy("k", "h", "m").agg(F.collect_list(F.struct("near", "far", "quiet")).alias("marks"))
        # rows of one anchor are disjoint ranges of its windows: the row that holds a mark is the one it was cut from
        wide = open_.select("k", "h", "m", F.col("near").alias("n0"), F.col("far").alias("f0"), "context")
        cut = wide.join(marks, ["k", "h", "m"]).select("k", "h", "m", F.col("f0").alias("far"), "context", F.filter("marks", lambda x: (x["near"] >= F.col("n0")) & (x["far"] <= F.col("f0"))).alias("marks"))
        open_ = settle(cut.mapInArrow(_cut_contexts(length), _CONTEXT), open_, repeated)
    spans = found[0]
    for more in found[1:]:
        spans = spans.unionByName(more)
    return spans.groupBy("k", "h").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def _removed(data: bytes, spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted({(x["s"], x["e"]) for x in spans or ()}):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            data = _encode(text)
            cut = _removed(data, spans)
            kept, at = [], 0
            for s, e in cut:
                kept.append(data[at:s])
                at = e
            rest = b"".join(kept) + data[at:]
            rows.append((len(data), sum(e - s for s, e in cut), [{"s": s, "e": e} for s, e in cut], rest, hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore")))
        kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, (pa.int64(), pa.int64(), kind, pa.binary(), pa.string(), pa.string()))), *batch.columns[3:]], names=["doc_id", "n_bytes", "n_removed", "spans", "kept", "kept_sha256", "kept_text", *batch.schema.names[3:]])
    tidy()


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, carry: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept, kept_sha256, kept_text) and, with carry, the row itself as a struct `row`, for every row of docs.

    A byte goes if a string of `length` bytes that covers it also starts elsewhere in the corpus, the same document
    included; matches stay within documents and are judged on the input. spans: the maximal removed runs, as byte
    offsets; kept: the other bytes (a multi-byte character may be cut); kept_text: the whole characters of these. Null text is empty; texts shorter than
    `length` lose nothing; rows that repeat a doc_id or a whole row count as documents of their own, so copies of a long
    enough text go as a whole; an empty table
    gives an empty result; other columns are ignored.
    """
    row = ["row"] if carry else []
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *([F.struct("*").alias("row")] if carry else []))
    base = base.select("doc_id", "text", *row, F.xxhash64("text").alias("k"), F.xxhash64(F.lit(1), F.col("text")).alias("h"))
    spans = settle(repeated_spans(base.select("k", "h", "text"), length, gram))
    joined = base.join(spans, ["k", "h"], "left").select("doc_id", "text", "spans", *row)
    kind = f", row {base.schema['row'].dataType.simpleString()}" if carry else ""
    return joined.mapInArrow(_apply, f"doc_id long, n_bytes long, n_removed long, spans array<struct<s: long, e: long>>, kept binary, kept_sha256 string, kept_text string{kind}")

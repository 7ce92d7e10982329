"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in up to three bits meet at a value near both of them. Which values a fingerprint emits
follows from the parity of its set bits:

* one bit apart: the even one emits itself, the odd one all that differ from it in one bit;
* two bits apart, so of equal parity: both emit all that differ in one bit;
* three bits apart: the odd one emits those at one bit, the even one those at two bits. Of three differing bits two lie
  in one half of the word, so the even one needs only pairs of bits within a half: 992 of 2,016.

So an odd fingerprint has 64 variants and an even one 1,057. Those that share a variant form a star around a member at
most one bit away from it; each of its links is three bits long at most, and is verified. Variants are shuffled in
shares, one after another, so that the disk holds one share at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import settle, tidy
from .components import connected_components

WIDTH, SEED, RADIUS = 3, 42, 3
SHARES = 4
TASK = 1 << 21  # variants that a task sorts at a time
PIECE = 1 << 20  # bytes of text that are cut into words at a time
# Variants in the order in which they are emitted: one bit, none, then two bits of the low and of the high half.
_PAIRS = [1 << i | 1 << j for i in range(31) for j in range(i + 1, 32)]
MASKS = np.array([1 << i for i in range(64)] + [0] + _PAIRS + [p << 32 for p in _PAIRS], np.uint64)
FAR = np.bitwise_count(MASKS).astype(np.int8)


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """The SimHash of a text's word shingles: a bit is set where it is in over half of their XXH64 values. Fewer words than width: the whole sequence is one shingle. No words: 0."""
    from xxhash import xxh64_intdigest

    data, at = (text or "").encode("utf-8", "surrogatepass"), 0
    counts, n, words = np.zeros(64, np.int64), 0, []
    while at < len(data):
        stop = at + PIECE
        while stop < len(data) and data[stop] not in b"\x20\x09\x0a\x0b\x0c\x0d":
            stop += 1
        words += data[at:stop].lower().split()
        at = stop
        line = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = [0, *(ends[:-1] + 1).tolist()]
        h = np.array([xxh64_intdigest(line[i:j], SEED) for i, j in zip(starts, ends[width - 1 :].tolist())], "<u8")
        if len(h):
            counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            n += len(h)
            words = words[len(words) - width + 1 :]
    if not n:
        return xxh64_intdigest(b" ".join(words), SEED) if words else 0
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])
        tidy()

    return run


def _masks() -> str:
    """SQL of MASKS: the variants of an even fingerprint; the first 64 are those of an odd one."""
    low = "flatten(transform(sequence(0, 30), i -> transform(sequence(i + 1, 31), j -> shiftleft(1L, i) | shiftleft(1L, j))))"
    return f"concat(transform(sequence(0, 63), i -> shiftleft(1L, i)), array(0L), {low}, transform({low}, p -> shiftleft(p, 32)))"


def stars(v: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Links of equal variants v, made with mask number k: rows of (pivot, other), each pair once, verified."""
    order = np.argsort(v)
    same = v[order[1:]] == v[order[:-1]] if len(v) else np.empty(0, bool)
    order = order[np.r_[same, False] | np.r_[False, same]] if len(v) else order
    order = order[np.lexsort((FAR[k[order]], v[order]))]
    v, k = v[order], k[order]
    fp = v ^ MASKS[k]
    first = np.flatnonzero(np.r_[True, v[1:] != v[:-1]]) if len(v) else np.empty(0, int)
    pivot = np.repeat(first, np.diff(np.r_[first, len(v)]))
    links = np.stack([fp[pivot], fp], axis=1)
    true = (FAR[k[pivot]] <= 1) & (fp[pivot] != fp) & (np.bitwise_count(fp[pivot] ^ fp) <= RADIUS)
    return np.unique(links[true], axis=0)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    v, k = [], []
    for batch in batches:
        v.append(batch.column(0).to_numpy())
        k.append(batch.column(1).to_numpy().astype(np.int16))
    if v:
        links = stars(np.concatenate(v).view(np.uint64), np.concatenate(k)).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(links[:, i]) for i in (0, 1)], names=["a", "b"])
    tidy()


def ball_links(fingerprints: DataFrame, shares: int = SHARES) -> DataFrame:
    """(a, b): links among distinct fingerprints (fp) whose components are those of all pairs at up to three differing bits."""
    kinds = fingerprints.groupBy((F.bit_count("fp") % 2).alias("odd")).count().collect()
    emitted = sum(n * (64 if odd else len(MASKS)) for odd, n in kinds)
    masks = F.expr(f"if(bit_count(fp) % 2 = 1, slice({_masks()}, 1, 64), {_masks()})")
    found = None
    for s in range(shares):
        variants = fingerprints.select("fp", F.posexplode(masks).alias("k", "m")).select(F.expr("fp ^ m").alias("v"), "k").where(F.pmod(F.xxhash64("v"), F.lit(shares)) == s)
        part = settle(variants.repartition(1 + emitted // shares // TASK, "v").mapInArrow(_linked, "a long, b long"))
        found = part if found is None else found.unionByName(part)
    return found


def near_duplicates(docs: DataFrame, width: int = WIDTH, shares: int = SHARES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs; the fingerprint as 16 hexadecimal digits.

    Rows link at up to three differing bits; component_id is the smallest doc_id reachable, the row's own included.
    Null, empty or wordless text has fingerprint zero and links like any other. Rows that repeat a doc_id are rows of
    their own; a component of rows without a doc_id alone has a null component_id. Other columns of docs are ignored.
    An empty table gives an empty result.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = settle(texts.mapInArrow(_fingerprints(width), "doc_id long, fp long"))
    classes = settle(known.groupBy("fp").agg(F.min("doc_id").alias("low")))
    links = ball_links(classes.select("fp"), shares)
    label = settle(connected_components(links, "a", "b"))
    named = settle(classes.join(label, classes.fp == label.id, "left").select("fp", "low", F.coalesce("component", "fp").alias("component")), classes, label)
    least = settle(named.groupBy("component").agg(F.min("low").alias("component_id")))
    top = settle(named.join(least, "component").select("fp", "component_id"), named, least)
    return known.join(top, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

"""MinHash near-duplicate detection with sequential Bayesian verification.

Documents with the same shingle set are one class and take part once. Class signatures are banded; the members of a
bucket are linked through pivots (components.py), so a large group makes a few pairs a member; what pivots leave of a
large bucket is screened in tiles by the same sequential comparison, without a row for each pair.
Signature batches of a candidate pair are compared one after another and the pair is dropped once the posterior
probability of a similarity at the threshold or above falls under the chosen miss probability; survivors are verified
on full sets. Shingles have 64-bit names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import mix64, settle, tidy
from .components import bucket_components, shared_buckets

BANDS, ROWS = 32, 7  # at similarity 0.8 a pair shares no band with probability 0.0005, at 0.9 with 1e-9
SIGNATURE = 128  # hashes that are kept for the comparison
BATCH = 16
MISS = 1e-7
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BLANK = re.compile(rb"[\x20\x09-\x0d]")
_IS_BLANK = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


CHUNK = 1 << 20  # characters that are cut into words at a time
LANES = 64  # bytes up to which words are named eight bytes at a time


def _chunks(texts: list[str | None]) -> Iterator[list[str]]:
    part, size = [], 0
    for text in texts:
        part.append(text or "")
        size += len(part[-1])
        if size >= CHUNK:
            yield part
            part, size = [], 0
    if part:
        yield part


def _named(block: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit names of the words from start to stop: their length and eight bytes at a time are mixed in; of words over LANES bytes, their XXH3."""
    eights = np.lib.stride_tricks.sliding_window_view(np.r_[block, np.zeros(8, np.uint8)], 8)
    size = stop - start
    out = mix64(size.astype(np.uint64) + _STEP)
    todo = np.flatnonzero(size <= LANES)
    for at in range(0, LANES, 8):
        todo = todo[size[todo] > at]
        if not len(todo):
            break
        lane = eights[start[todo] + at].view("<u8").ravel()
        spare = (8 * np.maximum(0, at + 8 - size[todo])).astype(np.uint64)
        out[todo] = mix64((out[todo] + _STEP) ^ (lane << spare))
    for i in np.flatnonzero(size > LANES).tolist():
        out[i] = xxhash.xxh3_64_intdigest(block[start[i] : stop[i]].tobytes())
    return out


def _word_names(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of data starts, and its 64-bit name; data is taken in blocks that end at white space."""
    starts, names, at = [], [], 0
    while at < len(data):
        found = _BLANK.search(data, at + CHUNK)
        stop = found.start() if found else len(data)
        block = np.frombuffer(data, np.uint8, stop - at, at)
        edges = np.flatnonzero(np.diff(np.r_[True, _IS_BLANK[block], True].view(np.int8)))
        starts.append(edges[::2] + at)
        names.append(_named(block, edges[::2], edges[1::2]))
        at = stop
    return (np.concatenate(starts), np.concatenate(names)) if starts else (np.empty(0, np.int64), np.empty(0, np.uint64))


def shingle_sets(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit names of the word shingles of each text; ASCII case is folded, words end at ASCII white space. Fewer words than width: the whole sequence is one shingle. No words: empty."""
    for part in _chunks(texts):
        part = [t.encode("utf-8", "surrogatepass") for t in part]
        starts, h = _word_names(b" ".join(part).lower())
        ends = np.searchsorted(starts, np.r_[0, np.cumsum([len(t) + 1 for t in part])])
        # names of all runs of `width` words, over the ends of texts too; those are left out below
        n = max(0, len(h) - width + 1)
        full = np.full(n, width, np.uint64)
        for i in range(width):
            full = mix64(full + _STEP) ^ h[i : i + n]
        full = mix64(full)
        for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist()):
            if hi - lo >= width:
                names = np.sort(full[lo : hi - width + 1])
                yield names[np.r_[True, names[1:] != names[:-1]]]
            elif hi > lo:
                one = np.full(1, hi - lo, np.uint64)
                for i in range(lo, hi):
                    one = mix64(one + _STEP) ^ h[i : i + 1]
                yield mix64(one)
            else:
                yield np.empty(0, np.uint64)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    return next(shingle_sets([text], width))


def _hash_family(count: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240611)
    return (r.integers(0, 2**32, count, np.uint64) | np.uint64(1)).astype(np.uint32), r.integers(0, 2**32, count, np.uint64).astype(np.uint32)


_A, _B = _hash_family(BANDS * ROWS)


def signature(names: np.ndarray) -> np.ndarray:
    low = (names >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 256):
        x = low[i : i + 256, None] * _A
        x += _B
        np.minimum(best, x.min(axis=0), out=best)
    return best


def band_keys(sigs: np.ndarray) -> np.ndarray:
    """Keys of the bands of each row of signatures."""
    out = np.tile(np.arange(BANDS, dtype=np.uint64), (len(sigs), 1))
    for i in range(ROWS):
        out = mix64(out * _STEP + sigs[:, i::ROWS][:, :BANDS].astype(np.uint64))
    return out.view(np.int64)


def _describe(width: int, smallest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, names, sigs, has = [], [], [], []
            for s in shingle_sets(batch.column(2).to_pylist(), width):
                n.append(len(s))
                names.append((int(mix64(s).sum()), int(mix64(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum())) if len(s) else (None, None))
                has.append(len(s) >= max(1, smallest))
                if has[-1]:
                    sigs.append(signature(s))
            sigs = np.array(sigs, np.uint32).reshape(len(sigs), BANDS * ROWS)
            rows = iter(zip((x.tobytes() for x in sigs[:, :SIGNATURE]), band_keys(sigs)))
            sig, keys = zip(*[next(rows) if x else (None, None) for x in has]) if has else ((), ())
            f, g = (pa.array([None if x is None else x - (x >> 63 << 64) for x in c], pa.int64()) for c in (zip(*names) if names else ((), ())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), f, g, pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "h", "n_shingles", "f", "g", "sig", "keys"])
        tidy()

    return run


def least_matches(threshold: float, miss: float, total: int, batch: int) -> list[int]:
    """After n compared hashes, the fewest matches m at which P(similarity >= threshold | m of n) >= miss, under a uniform prior: Beta(m + 1, n - m + 1)."""
    out = []
    for n in range(batch, total + 1, batch):
        # P(Beta(m+1, n-m+1) >= t) is the binomial tail P(Bin(n+1, t) <= m)
        tail, m = 0.0, 0
        while True:
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        out.append(m)
    return out


def _posterior(threshold: float, miss: float):
    least = least_matches(threshold, miss, SIGNATURE, BATCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            one = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(n, -1)
            two = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint32).reshape(n, -1)
            alive, same = np.arange(n), np.zeros(n, np.int64)
            for k, bound in enumerate(least):
                at = slice(k * BATCH, (k + 1) * BATCH)
                same[alive] += (one[alive, at] == two[alive, at]).sum(axis=1)
                alive = alive[same[alive] >= bound]
            yield pa.RecordBatch.from_arrays([c.take(pa.array(alive)) for c in batch.columns[:2]], names=["a", "b"])

    return run


def _screen(signatures: DataFrame, sets: DataFrame, percent: int, miss: float):
    """For tiles of large buckets: links between their components. Pairs that the posterior doesn't drop are verified on full sets in the task, one link for each two components."""
    least = least_matches(percent / 100, miss, SIGNATURE, BATCH)

    def tile(group: pa.Table) -> pa.Table:
        part, ids, n, c = (group.column(x).to_numpy() for x in ("t", "id", "n", "c"))
        sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint32).reshape(len(ids), -1)
        names = [x.values.to_numpy().view(np.uint64) for x in group.column("names")]
        lo, hi = group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
        right = np.flatnonzero(part == hi)
        first, rid, rn, c = np.ascontiguousarray(sig[right, :BATCH]), ids[right], n[right], c.copy()
        links: list[tuple[int, int]] = []
        for i in np.flatnonzero(part == lo).tolist():
            other = (c[right] != c[i]) & (100 * np.minimum(rn, n[i]) >= percent * np.maximum(rn, n[i]))
            alive = np.flatnonzero(other & (rid > ids[i]) if lo == hi else other)
            same = (first[alive] == sig[i, :BATCH]).sum(axis=1)
            for k, bound in enumerate(least):
                if k:
                    at = slice(k * BATCH, (k + 1) * BATCH)
                    same = same + (sig[right[alive], at] == sig[i, at]).sum(axis=1)
                stay = same >= bound
                alive, same = alive[stay], same[stay]
            for j in right[alive[np.argsort(-same, kind="stable")]].tolist():
                if c[j] == c[i]:
                    continue
                at = np.searchsorted(names[i], names[j])
                shared = int((names[i][np.minimum(at, len(names[i]) - 1)] == names[j]).sum())
                if 100 * shared >= percent * (len(names[i]) + len(names[j]) - shared):
                    links.append((ids[i], ids[j]))
                    c[c == c[j]] = c[i]
        a, b = zip(*links) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    def run(tiles: DataFrame) -> DataFrame:
        full = tiles.join(signatures.select("id", "sig"), "id").join(sets, "id")
        return full.groupBy("k", "lo", "hi").applyInArrow(tile, "a long, b long")

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.view(np.int64) for s in shingle_sets(batch.column(1).to_pylist(), width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "names"])
        tidy()

    return run


def _verified(pairs: DataFrame, signatures: DataFrame, sets: DataFrame, percent: int, miss: float) -> DataFrame:
    """The candidate pairs whose full sets reach the threshold."""
    sig = signatures.select("id", "sig")
    both = pairs.join(sig.toDF("a", "sig_a"), "a").join(sig.toDF("b", "sig_b"), "b").select("a", "b", "sig_a", "sig_b")
    left = settle(both.mapInArrow(_posterior(percent / 100, miss), "a long, b long"))
    full = left.join(sets.toDF("a", "names_a"), "a").join(sets.toDF("b", "names_b"), "b")
    shared = F.size(F.array_intersect("names_a", "names_b"))
    return full.where(100 * shared >= percent * (F.size("names_a") + F.size("names_b") - shared)).select("a", "b")


def _classed(base: DataFrame, width: int, percent: int, miss: float) -> DataFrame:
    """(doc_id, h, n_shingles, top) for every row of base (doc_id, h, text); top: the smallest (none, doc_id, h) of its component, null without shingles."""
    # two different sets can only reach the threshold if the larger has at least 1 / (1 - t) members
    smallest = math.ceil(1 / (1 - percent / 100) - 1e-9) - 1 if percent < 100 else 2**31
    seen = base.mapInArrow(_describe(width, smallest), "doc_id long, h long, n_shingles long, f long, g long, sig binary, keys array<long>")
    seen = settle(seen.withColumn("rid", F.monotonically_increasing_id()))
    # one class for each distinct set: its number is that of one of its rows
    low = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    classes = settle(seen.where("n_shingles > 0").groupBy("f", "g", "n_shingles").agg(F.min("rid").alias("id"), F.min(low).alias("low")))
    signatures = settle(seen.where("sig is not null").join(classes.select(F.col("id").alias("rid")), "rid", "left_semi").select(F.col("rid").alias("id"), F.col("n_shingles").alias("n"), "sig", "keys"))
    members = shared_buckets(signatures.select("id", "n", "keys"))
    # full sets of the classes that share a bucket, each from one of its texts
    wanted = settle(members.select("id").distinct().join(classes.select("id", "low.doc_id", "low.h"), "id"))
    texts = base.join(wanted.select("id", F.col("doc_id").alias("d"), F.col("h").alias("e")), base.doc_id.eqNullSafe(F.col("d")) & (base.h == F.col("e"))).select("id", "text")
    sets = settle(texts.mapInArrow(_sets(width), "id long, names array<long>").dropDuplicates(["id"]))
    label = bucket_components(members, signatures.select("id", "keys"), percent / 100, lambda pairs: _verified(pairs, signatures, sets, percent, miss), _screen(signatures, sets, percent, miss))
    linked = settle(classes.join(label, "id", "left").withColumn("component", F.coalesce("component", "id")), signatures, sets, members, wanted, label)
    top = settle(linked.groupBy("component").agg(F.min("low").alias("top")))
    named = settle(linked.join(top, "component").select("f", "g", "n_shingles", "top"), classes, linked, top)
    return seen.select("doc_id", "h", "n_shingles", "f", "g").join(named, ["f", "g", "n_shingles"], "left").select("doc_id", "h", "n_shingles", "top")


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("h"), F.col(text_col).cast("string").alias("text"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, miss: float = MISS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs.

    Links are pairs with 100 * |A and B| >= percent * |A or B| on distinct word shingles. Null, empty or wordless text
    has no shingles and links with nothing. Rows that repeat a doc_id are rows of their own, whatever their texts: sets
    are linked under numbers of their own, and the smallest doc_id of a component names it. A null doc_id is a row like
    others; a component of such rows alone has a null component_id, and they aren't kept. Other columns of docs are
    ignored. An empty table gives an empty result.
    """
    known = _classed(_base(docs, id_col, text_col), width, percent, miss)
    known = known.withColumn("component_id", F.when(F.col("top").isNull(), F.col("doc_id")).otherwise(F.col("top.doc_id")))
    return known.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, miss: float = MISS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, of each component of near-duplicates one only: that of the smallest doc_id (null comes last), then the smallest hash of its text.

    Rows without shingles all stay. Of rows that agree in doc_id and text one stays, whatever their other columns hold.
    An empty table gives an empty result; columns stay as they are.
    """
    key = [F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("k"), F.xxhash64(F.col(text_col).cast("string")).alias("h")]
    known = _classed(_base(docs, id_col, text_col), width, percent, miss)
    stands = F.col("top").isNull() | (F.col("doc_id").eqNullSafe(F.col("top.doc_id")) & (F.col("h") == F.col("top.h")))
    known = known.where(stands).groupBy(F.coalesce("doc_id", F.lit(-(2**63))).alias("k"), "h").agg(F.count("*").alias("n"), F.max("n_shingles").alias("shingles"))
    known = settle(known.select("k", "h", ((F.col("n") > 1) & (F.col("shingles") > 0)).alias("repeated")))
    rows = docs.select(F.struct("*").alias("row"), *key)
    once = rows.join(known.where("not repeated"), ["k", "h"], "left_semi").select("row.*")
    # repeated rows meet in place before they are shuffled
    again = rows.join(known.where("repeated"), ["k", "h"], "left_semi").groupBy("k", "h").agg(F.first("row").alias("row")).select("row.*")
    return once.unionByName(again)

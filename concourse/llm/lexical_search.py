"""Ranked lexical search of a query set against all documents by dense blocked multiplication.

The items are taken in slices of bounded text. One pass over the documents keeps, of each, its length and how often it
holds the terms of the slice; from that table come the document frequencies and, in a second pass, the scores. Items
are tiled: a tile is a dense float64 matrix of its items by its own compact vocabulary, cut into parts whose sums stay
under 2^53, so that each product is exact; the parts are added as 64-bit integers. A tile meets the impacts of a block
of documents, and of the scores of that block each item keeps its k highest, ties by the smaller doc_id.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import discard, settle, tidy

SLICE_BYTES = 1 << 24  # text of the items that one pass over the documents answers
ITEM_TILE, TERM_TILE, DOC_TILE, ENTRIES = 256, 4096, 1024, 1 << 20
PIECE = 1 << 20  # bytes that are cut into terms at a time
IMPACT = 1_000_000  # no impact is higher
EXACT = (2**53 - 1) // IMPACT  # weights that a float64 sum of products may hold together
# A-Z to a-z; digits, letters and bytes over 127 stay, all other bytes end a term
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text, in pieces of about PIECE bytes."""
    data, at = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD), 0
    while at < len(data):
        stop = data.find(b" ", at + PIECE)
        stop = len(data) if stop < 0 else stop
        yield data[at:stop].split()
        at = stop


def _counts(text: str | None) -> Counter:
    found: Counter = Counter()
    for piece in terms(text):
        found.update(piece)
    return found


def _postings(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value.get
        for batch in batches:
            lengths, ids, tfs = [], [], []
            for text in batch.column(1):
                n, found = 0, []
                for piece in terms(text.as_py()):
                    n += len(piece)
                    found.append(np.array([i for i in map(number, piece) if i is not None], np.int32))
                distinct, tf = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.int32),) * 2
                lengths.append(n)
                ids.append(distinct)
                tfs.append(tf.astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], names=["doc_id", "n", "ids", "tfs"])
        tidy()

    return run


def item_tiles(counts: list[dict[int, int]], weights: np.ndarray) -> list[tuple[int, int, list[tuple[np.ndarray, ...]]]]:
    """Items from .. to of each tile, and its parts: (vocabulary, row, column, value) with sums of a row up to EXACT."""
    tiles = []
    for first in range(0, len(counts), ITEM_TILE):
        own = counts[first : first + ITEM_TILE]
        columns: dict[int, list[list[int]]] = {}
        for row, found in enumerate(own):
            for term, q in found.items():
                if weights[term]:
                    columns.setdefault(term, []).append([row, int(weights[term]) * q])
        parts, left = [], sorted(columns.items())
        while left:
            room, vocabulary, cells, later = [EXACT] * len(own), [], [], []
            for term, entries in left:
                take = [(row, min(value, room[row])) for row, value in entries] if len(vocabulary) < TERM_TILE else []
                take = [(row, value) for row, value in take if value]
                for row, value in take:
                    room[row] -= value
                    cells.append((row, len(vocabulary), value))
                given = dict(take)
                rest = [[row, value - given.get(row, 0)] for row, value in entries if value > given.get(row, 0)]
                vocabulary += [term] if take else []
                later += [(term, rest)] if rest else []
            row, column, value = np.array(cells, np.int64).T
            parts.append((np.array(vocabulary), row, column, value.astype(np.float64)))
            left = later
        tiles.append((first, first + len(own), parts))
    return tiles


def tile_scores(tile, width: int, doc: np.ndarray, ids: np.ndarray, impacts: np.ndarray, docs: int) -> np.ndarray:
    """Scores of the items of a tile (rows) for a block of documents (columns)."""
    first, last, parts = tile
    total = np.zeros((last - first, docs), np.int64)
    for vocabulary, row, column, value in parts:
        at = np.full(width, -1)
        at[vocabulary] = np.arange(len(vocabulary))
        place = at[ids]
        here = place >= 0
        used, place = np.unique(place[here], return_inverse=True)
        if not len(used):
            continue
        a, b = np.zeros((last - first, len(vocabulary))), np.zeros((len(used), docs))
        a[row, column] = value
        b[place, doc[here]] = impacts[here]
        total += (a[:, used] @ b).astype(np.int64)
    return total


def best_of_tile(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the k highest positive scores of each row are, the leftmost of equal ones, and the k-th score (0 if there are fewer)."""
    n = scores.shape[1]
    low = np.partition(scores, n - k, axis=1)[:, n - k] if n >= k else np.zeros(len(scores), np.int64)
    above, tie = scores > low[:, None], scores == low[:, None]
    keep = above | (tie & (np.cumsum(tie, axis=1) <= k - above.sum(axis=1)[:, None]))
    return keep & (scores > 0), low


def _ranked(plan, n_docs: int, n_terms: int, width: int, k: int):
    def block(rows: list[tuple], low: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows.sort(key=lambda r: (r[0] is None, r[0] or 0))
        doc = np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows])
        ids, tf = np.concatenate([r[2] for r in rows]), np.concatenate([r[3] for r in rows])
        m = np.array([75 + 25 * r[1] * n_docs // n_terms for r in rows], np.int64)
        impacts = (1000 * IMPACT * tf) // (1000 * tf + 12 * m[doc])
        items, tiles = plan.value
        for t, tile in enumerate(tiles):
            scores = tile_scores(tile, width, doc, ids, impacts, len(rows))
            keep, kth = best_of_tile(scores, k)
            # what this task has seen of an item bounds its k-th score from below
            row, col = np.nonzero(keep & (scores >= low[t][:, None]))
            low[t] = np.maximum(low[t], kth)
            if len(row):
                yield pa.RecordBatch.from_arrays([pa.array(items[tile[0] + row]), pa.array([rows[i][0] for i in col], pa.int64()), pa.array(scores[row, col])], names=["item_id", "doc_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = [np.zeros(last - first, np.int64) for first, last, _ in plan.value[1]]
        rows, entries = [], 0
        for batch in batches:
            ids, tfs = batch.column(2), batch.column(3)
            for i, (doc_id, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                rows.append((doc_id, n, ids[i].values.to_numpy(), tfs[i].values.to_numpy()))
                entries += len(rows[-1][2])
                if len(rows) == DOC_TILE or entries >= ENTRIES:
                    yield from block(rows, low)
                    rows, entries = [], 0
        if rows:
            yield from block(rows, low)
        tidy()

    return run


def _answered(docs: DataFrame, rows: list, k: int) -> DataFrame:
    """The k best documents of each of the items (item_id, text), not yet ranked over all blocks."""
    spark = docs.sparkSession
    vocabulary: dict[bytes, int] = {}
    counts = [{vocabulary.setdefault(t, len(vocabulary)): q for t, q in _counts(text).items()} for _, text in rows]
    held = spark.sparkContext.broadcast(vocabulary)
    found = settle(docs.mapInArrow(_postings(held), "doc_id long, n long, ids array<int>, tfs array<long>"))
    size = found.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    df = np.zeros(len(vocabulary), np.int64)
    for i, n in found.select(F.explode("ids").alias("i")).groupBy("i").count().collect():
        df[i] = n
    weights = np.array([math.floor(1000 * math.log((2 * size["docs"] + 2) / (2 * int(n) + 1))) for n in df], np.int64)
    plan = spark.sparkContext.broadcast((np.array([i for i, _ in rows], np.int64), item_tiles(counts, weights)))
    best = settle(found.where("size(ids) > 0").mapInArrow(_ranked(plan, size["docs"], size["terms"], len(vocabulary), k), "item_id long, doc_id long, score long"))
    discard(found)
    held.destroy()
    plan.destroy()
    return best


def search(items: DataFrame, docs: DataFrame, k: int = 20, item_col: str = "item_id", item_text: str = "text", doc_col: str = "doc_id", doc_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of the highest score above 0 for each item; fewer, if there are fewer.

    Null and empty texts have no terms: such items get no rows, such documents don't count. Equal scores are ranked by
    the smaller doc_id; a null doc_id comes last. Documents that repeat a doc_id stand for themselves, items that repeat
    an item_id are one item (the smallest of their texts), and items without an id are left out. Other columns are
    ignored. An empty table gives an empty result. Each SLICE_BYTES of item text take two passes: the driver and each
    worker hold the terms and counts of that much at a time, never more but for a single longer item.
    """
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).where("item_id is not null and text is not null")
    asked = settle(asked.groupBy("item_id").agg(F.min("text").alias("text")))
    corpus = docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(doc_text).cast("string").alias("text"))
    slices = 1 + (asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SLICE_BYTES
    found = None
    for s in range(slices):
        rows = [tuple(r) for r in asked.where(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == s).orderBy("item_id").collect()]
        part = _answered(corpus, rows, k)
        found = part if found is None else found.unionByName(part)
    best = [F.desc("score"), F.asc_nulls_last("doc_id")]
    for keys in (["item_id", F.pmod(F.xxhash64("doc_id", "score"), F.lit(32))], ["item_id"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*best))).where(F.col("rank") <= k)
    return found.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")

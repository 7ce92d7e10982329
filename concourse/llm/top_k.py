"""Exact top-k search by distributed histogram selection.

Queries and candidates are packed into blocks of vectors; every query block meets every candidate block once a round,
where all pairs are scored as one matrix product. A round counts each query's scores in the bins of its current
interval and keeps the bin that holds its k-th score, until bins are one score wide; a last pass then keeps what is
above the k-th score and its ties of smallest id. A block reports only the bins from the top down to where it has
reached k by itself, as the k-th score of all cannot be lower than that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import settle

STEP = 10  # bits of an interval that a round resolves
QUERY_BLOCK, CANDIDATE_BLOCK, SLOT = 512, 2048, 8192


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int, null_ids: bool = False) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x) of each component; rows with a null vector or a null or non-finite component take no part, nor do those with a null id, unless null_ids."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"), F.coalesce(fine, F.lit(False)).alias("fine"))
    rows = rows if null_ids else rows.where("vec_id is not null")
    return rows.where("x is not null and fine and size(x) > 0").select("vec_id", F.transform("x", lambda c: F.floor(c * scale)).alias("v"))


def _packer(size: int, more: int):
    """Rows of (vec_id, v, more long columns) of one length as blocks: dim, ids, matrix, columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, cols = batch.column(0).to_numpy(), [batch.column(2 + i).to_numpy() for i in range(more)]
            dims = np.diff(batch.column(1).offsets.to_numpy())
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            first = np.cumsum(dims) - dims
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                for at in range(0, len(rows), size):
                    r = rows[at : at + size]
                    m = flat[(first[r][:, None] + np.arange(dim))].astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([int(dim)], pa.int64()), *(pa.array([x.astype(np.int64).tobytes()], pa.binary()) for x in (ids[r], m, *(c[r] for c in cols)))], names=["dim", "ids", "m", *(f"c{i}" for i in range(more))])

    return run


def _packed(rows: DataFrame, size: int, more: int = 0) -> DataFrame:
    return rows.mapInArrow(_packer(size, more), "dim long, ids binary, m binary" + "".join(f", c{i} binary" for i in range(more)))


def _read(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, ...]:
    return tuple(np.frombuffer(batch.column(batch.schema.get_field_index(n))[i].as_py(), np.int64) for n in ("q_ids", "q_m", "q_c0", "q_c1", "ids", "m"))


def _scores(q: np.ndarray, c: np.ndarray, dim: int) -> np.ndarray:
    q, c = q.reshape(-1, dim), c.reshape(-1, dim)
    if float(np.abs(q).max()) * float(np.abs(c).max()) * dim < 2**53:  # sums of products stay exact
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return q @ c.T


def _histograms(bits: int, step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dim = batch.column(batch.schema.get_field_index("dim"))[i].as_py()
                ids, q, low, need, c_ids, c = _read(batch, i)
                s = _scores(q, c, dim) - low[:, None]
                inside = (s >= 0) & (s < 1 << bits) & (ids[:, None] != c_ids)
                row, col = np.nonzero(inside)
                cell, n = np.unique(row << step | (~(s[row, col] >> (bits - step)) & ((1 << step) - 1)), return_counts=True)  # bins from the top down
                row = cell >> step
                before = np.cumsum(n) - n
                start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.empty(0, int)
                before = before - np.repeat(before[start], np.diff(np.r_[start, len(row)]))
                keep = before < need[row]
                yield pa.RecordBatch.from_arrays([pa.array(ids[row[keep]]), pa.array(~cell[keep] & ((1 << step) - 1)), pa.array(n[keep].astype(np.int64))], names=["query_id", "bin", "n"])

    return run


def _winners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            dim = batch.column(batch.schema.get_field_index("dim"))[i].as_py()
            ids, q, low, need, c_ids, c = _read(batch, i)
            order = np.argsort(c_ids, kind="stable")
            c_ids, s = c_ids[order], _scores(q, c, dim)[:, order]
            other = ids[:, None] != c_ids
            tie = (s == low[:, None]) & other
            row, col = np.nonzero(((s > low[:, None]) & other) | (tie & (np.cumsum(tie, axis=1) <= need[:, None])))
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(c_ids[col]), pa.array(s[row, col])], names=["query_id", "vec_id", "score"])


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products over all candidates but those of its own id; ties go to the smaller vec_id.

    Components count as floor(scale * x). Queries with fewer than k candidates get all of them. Vectors that are null,
    empty, or hold null or non-finite components take no part; vectors of different lengths do not meet; a repeated
    query id is one query (its first vector by value); candidates that repeat an id stand for themselves. Empty tables give an empty result.
    """
    q = integer_vectors(queries, id_col, vector_col, scale).groupBy("vec_id").agg(F.min("v").alias("v"))
    c = integer_vectors(candidates, id_col, vector_col, scale)
    size = c.agg(F.count("*").alias("n"), F.max(F.greatest(F.array_max("v"), -F.array_min("v"))).alias("most"), F.max(F.size("v")).alias("dim")).first()
    if not size["n"]:
        return q.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.col("vec_id").alias("score")).limit(0)
    most = max(size["most"], q.agg(F.max(F.greatest(F.array_max("v"), -F.array_min("v")))).first()[0] or 0)
    bits = (2 * most * most * size["dim"] + 1).bit_length()
    slots = max(1, size["n"] // SLOT)
    blocks = settle(_packed(c, CANDIDATE_BLOCK).withColumn("slot", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(slots))))
    parts = max(1, q.count() // QUERY_BLOCK)
    state = settle(q.select("vec_id", "v", F.lit(-(1 << (bits - 1))).cast("long").alias("low"), F.lit(k).cast("long").alias("need")))

    def met(state: DataFrame) -> DataFrame:
        packed = _packed(state.repartition(parts, "vec_id"), QUERY_BLOCK, 2).toDF("dim", "q_ids", "q_m", "q_c0", "q_c1")
        packed = packed.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))))
        # a copy of each query block for each slot: its size can't be told from the file of the state, and would go through the driver if broadcast
        return packed.hint("merge").join(blocks.hint("merge"), ["slot", "dim"])

    while bits > 0:
        step = min(STEP, bits)
        counted = met(state).mapInArrow(_histograms(bits, step), "query_id long, bin long, n long").groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("query_id").orderBy(F.desc("bin"))
        counted = counted.withColumn("upto", F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, 0)))
        found = state.select(F.col("vec_id").alias("query_id"), "need").join(counted, "query_id").where("upto >= need").groupBy("query_id").agg(F.max("bin").alias("bin"), F.min(F.col("upto") - F.col("n")).alias("above"))
        # without a k-th score all candidates count: low stays under every score
        lost = F.col("bin").isNull()
        state = settle(
            state.join(found, state.vec_id == found.query_id, "left").select(
                "vec_id", "v", F.when(lost, F.col("low")).otherwise(F.col("low") + F.shiftleft(F.col("bin"), bits - step)).alias("low"), F.when(lost, F.col("need")).otherwise(F.col("need") - F.col("above")).alias("need")
            ),
            state,
        )
        bits -= step
    rows = met(state).mapInArrow(_winners, "query_id long, vec_id long, score long")
    best = [F.desc("score"), F.col("vec_id")]
    for keys in (["query_id", F.pmod(F.xxhash64("vec_id"), F.lit(32))], ["query_id"]):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*best))).where(F.col("rank") <= k)
    return rows.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

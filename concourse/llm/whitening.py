"""Embedding whitening with MLlib's distributed block matrices.

Distinct vectors are centred, indexed and dealt into blocks; the product of that matrix with its transpose is the
scatter, whose eigenvectors are found locally (its size is the dimension squared). All rows, indexed and blocked alike,
are multiplied by the whitening matrix.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import discard, settle
from .top_k import integer_vectors

BLOCK_CELLS, BLOCK_COLUMNS = 1 << 18, 1024  # numbers in a block of rows, and its columns
BLOCKS_A_TASK = 8  # blocks that a task of the scatter multiplies
FLAT = 1e-12  # variances under this share of the largest, for each dimension, are those of no component


class Whitening(NamedTuple):
    n: int
    sums: np.ndarray  # of each dimension, exact
    explained: np.ndarray  # share of the trace of each kept component
    matrix: np.ndarray  # dimension x kept components
    identity_error: float


def _indexed(rows: DataFrame) -> DataFrame:
    """rows with a gapless long `index`. Places are written with the rows, so that a task that runs again finds the same ones."""
    place = F.monotonically_increasing_id()
    placed = settle(rows.select("*", F.shiftright(place, 33).alias("part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("at")))
    # one row for each part of the table
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    first = settle(placed.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("first")))
    out = settle(placed.join(first, "part").select(*rows.columns, (F.col("first") + F.col("at")).alias("index")), placed, first)
    return out


def _blocks(rows: DataFrame, n: int, sums: np.ndarray, count: int) -> BlockMatrix:
    """Rows (index, v), centred by the mean sums / n, as a block matrix of `count` rows."""
    total = F.array(*[F.lit(int(s)) for s in sums])
    centred = F.zip_with("v", total, lambda x, s: (x * n - s).cast("double") / n)
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector(centred).alias("vector")), "vector")
    width = min(len(sums), BLOCK_COLUMNS)
    return IndexedRowMatrix(vectors, count, len(sums)).toBlockMatrix(max(1, BLOCK_CELLS // width), width)


def _times(a: BlockMatrix, b: BlockMatrix, parts: int) -> BlockMatrix:
    """a x b; the inner blocks are dealt to `parts` tasks and their products added."""
    product = a._java_matrix_wrapper._java_model.multiply(b._java_matrix_wrapper._java_model, parts)
    return BlockMatrix(product, a.rowsPerBlock, b.colsPerBlock)


def _local(matrix: np.ndarray, spark, rows_a_block: int) -> BlockMatrix:
    d, k = matrix.shape
    blocks = [((i // rows_a_block, 0), DenseMatrix(len(part), k, part.ravel(order="F"))) for i in range(0, d, rows_a_block) for part in [matrix[i : i + rows_a_block]]]
    return BlockMatrix(spark.sparkContext.parallelize(blocks), rows_a_block, k)


def _projected(blocks: BlockMatrix, matrix: np.ndarray, spark) -> DataFrame:
    """(index, w array<double>): the rows of blocks times the matrix; a row of zeros only may be left out."""
    product = blocks.multiply(_local(matrix, spark, blocks.colsPerBlock))
    rows = callMLlibFunc("getIndexedRows", product.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return rows.select("index", vector_to_array("vector").alias("w"))


def fit(vectors: DataFrame, components: int = 4) -> Whitening | None:
    """The whitening of integer vectors (v array<long>) of one length, each distinct vector counted once, by the covariance of divisor n; None without vectors or without variance."""
    spark = vectors.sparkSession
    rows = _indexed(vectors.select("v").distinct())
    n = rows.count()
    by_dimension = rows.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("s")).orderBy("i").collect() if n else []
    sums = np.array([r["s"] for r in by_dimension], np.int64)
    found = None
    if n:
        blocks = _blocks(rows, n, sums, n)
        tasks = -(-n // (blocks.rowsPerBlock * BLOCKS_A_TASK))
        covariance = _times(blocks.transpose(), blocks, tasks).toLocalMatrix().toArray() / n
        values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
        values, axes = values[::-1], axes[:, ::-1]
        kept = min(components, int((values > FLAT * len(sums) * max(values[0], 0)).sum()))
        if kept:
            matrix = axes[:, :kept] / np.sqrt(values[:kept])
            white = _projected(blocks, matrix, spark)
            cells = [(i, j) for i in range(kept) for j in range(i, kept)]
            at = white.agg(*[F.covar_pop(F.col("w")[i], F.col("w")[j]).alias(f"c{i}_{j}") for i, j in cells]).first()
            error = max(abs(c - (i == j)) for (i, j), c in zip(cells, at))
            found = Whitening(n, sums, values[:kept] / np.trace(covariance), matrix, float(error))
    discard(rows)
    return found


def _whitened(rows: DataFrame, model: Whitening) -> DataFrame:
    """One row for each row (vec_id, v) and component of the model."""
    spark, n = rows.sparkSession, model.n
    placed = _indexed(rows)
    projected = _projected(_blocks(placed, n, model.sums, placed.count()), model.matrix, spark)
    # the sum of (n * x - S)^2 over the dimensions, from exact sums of x * x, x * S and S * S
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    total = F.array(*[F.lit(int(s)) for s in model.sums])
    add = lambda a, x: a + x
    zero = F.lit(0).cast("long")
    exact = placed.withColumns({"xx": F.aggregate(F.transform("v", lambda x: x * x), zero, add), "xs": F.aggregate(F.zip_with("v", total, lambda x, s: x * s), zero, add)})
    squared = F.lit(n).cast("decimal(20,0)") * F.lit(n).cast("decimal(18,0)")
    spread = squared * wide("xx").cast("decimal(19,0)") - F.lit(2 * n).cast("decimal(18,0)") * wide("xs").cast("decimal(19,0)") + F.lit(str(sum(int(s) ** 2 for s in model.sums))).cast("decimal(38,0)")
    exact = exact.select("index", "vec_id", spread.try_cast("long").alias("deviation"))
    nil = F.array(*[F.lit(0.0)] * model.matrix.shape[1])
    both = exact.join(projected, "index", "left").select("vec_id", "deviation", F.posexplode(F.coalesce("w", nil)).alias("i", "whitened"))
    shares = F.array(*[F.lit(float(x)) for x in model.explained])
    return both.select("vec_id", (F.col("i") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", shares[F.col("i")].alias("explained"), F.lit(model.identity_error).alias("identity_error"))


def whiten(vectors: DataFrame, components: int = 4, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for every row and component, numbered from 1 by falling variance.

    Entries count as floor(scale * c). Rows whose vector is null, empty, or holds null or non-finite entries are left
    out; repeated vectors are fitted once and projected for each of their rows; a null vec_id is a row like others.
    Vectors of different lengths are whitened apart, each length by its own fit. Directions without variance are no
    components, so equal vectors alone, or a single one, give no rows, and neither does an empty table. deviation is
    null where it doesn't fit a long. Other columns are ignored.
    """
    rows = integer_vectors(vectors, id_col, vector_col, scale, null_ids=True)
    rows = settle(rows)
    lengths = [r[0] for r in rows.select(F.size("v")).distinct().collect()]
    empty = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    out = vectors.sparkSession.createDataFrame([], empty)
    for length in sorted(lengths):
        own = rows.where(F.size("v") == length)
        model = fit(own, components)
        if model:
            out = out.unionByName(_whitened(own, model))
    return out

"""Whitening of embeddings with Spark MLlib's BlockMatrix.

A vector's entries c become whole numbers ``floor(64 * c) + 1000000``.  The fit list is each distinct vector once; it gives the
number n, the sums S of every dimension and the covariance V (divisor n).  Its centred rows are indexed into a distributed block
matrix X, and ``X' X / n`` is V, summed over blocks of rows in many tasks.  Only V, of dimensions squared, comes to the driver, where
``numpy.linalg.eigh`` gives the whitening matrix; the rows of all vectors meet it as blocks again.  Copies of a
vector are combined before they are shuffled, and blocks are dealt by row index, so that a vector that fills a third of the table
fills no task.

Vectors that are null or empty, or that hold a null or non-finite entry, are dropped.  Should lengths differ, the commonest (of
equally common ones the longest) is the table's dimension and the others are dropped too.  Repeated rows and null ids are
rows like any other.  Components without variance cannot be whitened and are left out, so a table of fewer than two distinct
vectors, as an empty one, gives no rows.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wideprep.session import checkpoint_dir, shuffle_partitions

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Rows of a block; a longer table gets longer blocks, for the driver holds the place of every block.
BLOCK_ROWS = 1024
MOST_BLOCKS = 200_000
BLOCK_COLUMNS = 1024
#: Sums taken by one aggregate.
CHUNK = 200
#: Share of the largest eigenvalue up to which an eigenvalue is rounding.
NO_VARIANCE = 1e-10
#: A block and its place.
BLOCK = T.StructType([
    T.StructField("place", T.StructType([T.StructField("row", T.LongType(), False), T.StructField("column", T.LongType(), False)]), False),
    T.StructField("matrix", MatrixUDT(), False)])


def whole(vector: Column) -> Column:
    """The entries as whole numbers."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(SHIFT).cast("long"))


def is_sound(vector: Column) -> Column:
    finite = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, finite)


def indexed(rows: DataFrame, size: int) -> tuple[DataFrame, int]:
    """``rows``, written to the checkpoint folder, with their index ``at`` in a matrix of blocks of ``size`` rows, and the number of
    blocks.  Rows are numbered inside their partition, and each partition begins a block of its own (the partitions' counts, a row
    each, say which), so that no row is shuffled to form blocks.  Indices that a partition leaves open are rows of zeros."""
    marked = rows.withColumn("uid", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftrightunsigned("uid", 33)
    counts = marked.groupBy(part.alias("part")).agg(F.ceil(F.count("*") / size).alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    placed = marked.withColumn("part", part).join(F.broadcast(first), "part") \
        .withColumn("at", F.col("first") * size + F.col("uid").bitwiseAND((1 << 33) - 1)).drop("uid", "part", "first")
    return placed, counts.agg(F.sum("n")).first()[0] or 0


def blocks(rows: DataFrame, n_blocks: int, size: int, dims: int, mean: list[float]) -> BlockMatrix:
    """The centred vectors ``x`` of indexed rows as a block matrix, block by block where the rows lie."""
    width, centre = min(dims, BLOCK_COLUMNS), np.array(mean)

    def parts(block: int, values: np.ndarray) -> pa.RecordBatch:
        cuts = [values[:, k:k + width] for k in range(0, dims, width)]
        places = [{"row": block, "column": i} for i in range(len(cuts))]
        matrices = [{"type": 1, "numRows": size, "numCols": c.shape[1], "colPtrs": None, "rowIndices": None, "isTransposed": True} for c in cuts]
        kind = pa.struct([("type", pa.int8()), ("numRows", pa.int32()), ("numCols", pa.int32()), ("colPtrs", pa.list_(pa.int32())),
                          ("rowIndices", pa.list_(pa.int32()))])
        head = pa.array(matrices, kind)
        flat = pa.ListArray.from_arrays(np.cumsum([0, *[c.size for c in cuts]]).astype(np.int32), pa.array(np.concatenate([c.ravel() for c in cuts])))
        matrix = pa.StructArray.from_arrays([*head.flatten(), flat, pa.array([True] * len(cuts))], names=[f.name for f in kind] + ["values", "isTransposed"])
        return pa.RecordBatch.from_arrays([pa.array(places, pa.struct([("row", pa.int64()), ("column", pa.int64())])), matrix], names=["place", "matrix"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, values = -1, np.zeros((size, dims))
        for batch in batches:
            at = batch.column("at").to_numpy()
            x = batch.column("x").flatten().to_numpy().reshape(len(at), dims) - centre
            for b in np.unique(at // size).tolist():
                if b != block:
                    if block >= 0:
                        yield parts(block, values)
                    block, values = b, np.zeros((size, dims))
                own = at // size == b
                values[at[own] % size] = x[own]
        if block >= 0:
            yield parts(block, values)

    made = rows.select("at", "x").mapInArrow(run, BLOCK)
    return BlockMatrix(callMLlibFunc("createBlockMatrix", made, size, width, n_blocks * size, dims), size, width)


def scatter(matrix: BlockMatrix, splits: int) -> np.ndarray:
    """``X' X`` of a tall block matrix; ``splits`` tasks each sum a share of its row blocks.  The method of the JVM class takes
    that number, its Python twin would give all row blocks to one task."""
    turned, model = matrix.transpose(), matrix._java_matrix_wrapper._java_model
    product = turned._java_matrix_wrapper.call("multiply", model, max(1, min(splits, matrix.numRowBlocks)))
    return BlockMatrix(product, turned.rowsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def kept(matrix: BlockMatrix) -> BlockMatrix:
    """A matrix that several products read: its blocks stay on the executors (lost ones are made again) until ``let_go``."""
    return matrix.persist(StorageLevel.MEMORY_AND_DISK)


def let_go(matrix: BlockMatrix) -> None:
    matrix._java_matrix_wrapper._java_model.blocks().unpersist(False)


def local_blocks(spark, values: np.ndarray, size: int) -> BlockMatrix:
    """A small matrix of the driver as a block matrix with blocks of ``size`` rows."""
    cut = [((i, 0), DenseMatrix(len(part), values.shape[1], part.ravel(order="F").tolist()))
           for i, part in enumerate(values[k:k + size] for k in range(0, len(values), size))]
    return BlockMatrix(callMLlibFunc("createBlockMatrix", spark.createDataFrame(cut, BLOCK), size, values.shape[1], *values.shape), size, values.shape[1])


def whitening_matrix(covariance: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit eigenvectors over the root of their eigenvalue, largest eigenvalue first, and the share of variance of each."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > NO_VARIANCE * max(values.max(), 0)]
    return vectors[:, order] / np.sqrt(values[order]), values[order] / np.trace(covariance)


def whiten(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``vec_id``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained`` and ``identity_error`` of every sound vector and
    each of its first ``components`` components.  ``deviation`` is exact and raises where it leaves 64 bits.
    ``identity_error`` is measured on the fit list's whitened rows."""
    spark = embeddings.sparkSession
    checkpoint_dir(spark)
    kind = embeddings.schema[vec_id].dataType.simpleString()
    nothing = spark.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    sound = embeddings.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{vector}`").alias("v")).where(is_sound(F.col("v")))
    commonest = sound.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if commonest is None:
        return nothing
    dims, size = commonest["dims"], max(BLOCK_ROWS, -(-commonest["count"] // MOST_BLOCKS))
    rows, n_blocks = indexed(sound.where(F.size("v") == dims).select("vec_id", whole(F.col("v")).alias("x")), size)
    fit, fit_blocks = indexed(rows.select("x").distinct(), size)
    n, sums = fit.count(), []
    for k in range(0, dims, CHUNK):
        sums += fit.agg(*[F.sum(F.get("x", F.lit(i))).alias(f"s{i}") for i in range(k, min(dims, k + CHUNK))]).first()
    mean, splits = [s / n for s in sums], shuffle_partitions(spark)
    centred = kept(blocks(fit, fit_blocks, size, dims, mean))
    matrix, explained = whitening_matrix(scatter(centred, splits) / n, components)
    k = matrix.shape[1]
    if not k:
        let_go(centred)
        return nothing
    wide = local_blocks(spark, matrix, centred.colsPerBlock)
    fitted = kept(centred.multiply(wide))
    error = float(np.abs(scatter(fitted, splits) / n - np.eye(k)).max())
    let_go(fitted)
    let_go(centred)
    every = blocks(rows, n_blocks, size, dims, mean).multiply(wide).toIndexedRowMatrix()
    projected = callMLlibFunc("getIndexedRows", every._java_matrix_wrapper._java_model).toDF("at", "z").select("at", vector_to_array("z").alias("z"))
    exact = F.aggregate(F.zip_with("x", F.lit(sums), lambda x, s: (x * n - s) * (x * n - s)), F.lit(0).cast("long"), lambda a, d: a + d)
    found = rows.select("at", "vec_id", exact.alias("deviation")).join(projected, "at") \
        .select("vec_id", "deviation", F.posexplode("z").alias("c", "whitened"))
    return found.select("vec_id", (F.col("c") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                        F.get(F.lit([float(e) for e in explained]), F.col("c")).alias("explained"), F.lit(error).alias("identity_error"))

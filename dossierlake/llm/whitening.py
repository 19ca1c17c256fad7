"""Whitening of embeddings with distributed block matrices.

Entries become whole numbers x = floor(256 * c). The fit list holds each distinct x vector once. Its rows,
centred by the exact means, are numbered and dealt into blocks of a BlockMatrix; the transposed matrix times the
matrix is the scatter (the long dimension is split, so blocks meet in many tasks and only d x d results are
added up). Its eigenvectors are found on the driver, and the block matrix times the whitening matrix
projects all rows. Without repeated vectors both matrices are one; else the scatter has one of its own, in which
the rows left out are zeros.

On the driver are the sums, the d x d scatter, the whitening matrix, and one pair of numbers for each block of
about `ENTRIES` entries, which the multiplication asks for.

Defined cases: a vector that is null or holds a null, NaN or infinite entry is dropped; a vector shorter than the
longest is filled up with zeros; null or repeated vec_ids and equal rows are kept as rows of their own; with fewer than
`components` dimensions there are as many components; a component without variance (also when only one distinct vector is
left) has whitened 0, explained 0, and does not count for identity_error; a deviation beyond the range of long is null;
an empty table gives no row; further columns of any name are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from dossierlake.llm.common import checkpoint

STEPS, COMPONENTS = 256, 4
ENTRIES = 1 << 18
FLAT = 1e-12  # share of the trace below which a component has no variance
SCHEMA = ("vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")


def whole_vectors(vectors: DataFrame, column: str) -> DataFrame:
    """vec_id and x of the rows that can be used, all of one length."""
    given = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col(column).cast("array<double>").alias("c")).where(
        F.col("c").isNotNull() & F.forall("c", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    size = given.agg(F.max(F.size("c")).alias("d")).first()["d"] or 0
    x = F.transform("c", lambda v: F.floor(v * STEPS))
    return given.select("vec_id", F.concat(x, F.array_repeat(F.lit(0).cast("bigint"), F.lit(size) - F.size("c"))).alias("x"))


def sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and exact sum of each dimension."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            if batch.num_rows:
                block = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
                added = block.astype(object).sum(0) if np.abs(block.astype(float)).sum() > 2**62 else block.sum(0).astype(object)
                n, total = n + batch.num_rows, added if total is None else total + added
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array([n] * len(total), pa.int64()), pa.array(range(len(total)), pa.int32()), pa.array([str(v) for v in total], pa.string())],
                names=["n", "dimension", "total"])

    found = fit.select("x").mapInArrow(part, "n bigint, dimension int, total string").groupBy("dimension").agg(
        F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).orderBy("dimension").collect()
    return (found[0]["n"], [int(r["total"]) for r in found]) if found else (0, [])


def numbered(rows: DataFrame) -> DataFrame:
    """The rows with `index`, counted from 0 without gaps; `at` is the stored monotonic id of a row.

    Only one number for each partition is added up.
    """
    part = F.shiftright("at", 33)
    begin = F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("first")).select(
        "part", "first", begin.alias("begin"))
    return rows.withColumn("part", part).join(begins, "part").withColumn("index", F.col("begin") + F.col("at") - F.col("first")).drop(
        "part", "first", "begin")


def block_matrix(rows: DataFrame, centre: list[float], count: int) -> BlockMatrix:
    """Rows (index, x), less the centre, as blocks over whole rows."""
    centred = F.zip_with("x", F.lit(centre), lambda a, b: a - b)
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector(centred).alias("vector")), "vector")
    size = len(centre)
    return IndexedRowMatrix(vectors, count, size).toBlockMatrix(max(1, ENTRIES // size), size)


def scatter(matrix: BlockMatrix) -> np.ndarray:
    """Transposed matrix times matrix; the long dimension is summed up in as many parts as there are partitions."""
    turned, parts = matrix.transpose(), max(1, matrix.blocks.getNumPartitions())
    product = turned._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, parts)
    return BlockMatrix(product, matrix.colsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def projected(spark: SparkSession, matrix: BlockMatrix, weights: np.ndarray) -> DataFrame:
    """index and `whitened`, the row of the product with the weights."""
    local = Matrices.dense(*weights.shape, weights.ravel(order="F").tolist())
    right = BlockMatrix(spark.sparkContext.parallelize([((0, 0), local)], 1), *weights.shape)
    rows = matrix.multiply(right).toIndexedRowMatrix()
    return callMLlibFunc("getIndexedRows", rows._java_matrix_wrapper._java_model).select(
        "index", vector_to_array("vector").alias("whitened"))


def whitened(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every row and component."""
    spark = vectors.sparkSession
    rows = numbered(checkpoint(whole_vectors(vectors, column).withColumn("at", F.monotonically_increasing_id())))
    fit = checkpoint(rows.groupBy("x").agg(F.min("index").alias("index")))
    n, total = sums(fit)
    size, count = len(total), rows.count()
    if not size:
        return spark.createDataFrame([], SCHEMA)
    centre = [t / n for t in total]
    everything = block_matrix(rows, centre, count)
    covariance = scatter(everything if n == count else block_matrix(fit, centre, count)) / n
    values, basis = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(values)[::-1][:components]
    values, basis, trace = values[order], basis[:, order], float(np.trace(covariance))
    varies = values > FLAT * trace
    weights = np.where(varies, basis / np.sqrt(np.where(varies, values, 1.0)), 0.0)
    explained = [float(v) / trace if ok else 0.0 for v, ok in zip(values, varies, strict=True)]

    squares = F.transform(F.zip_with("x", F.lit(total), lambda a, s: F.try_subtract(F.try_multiply(a, F.lit(n).cast("bigint")), s)), lambda v: F.try_multiply(v, v))
    deviation = F.aggregate(squares, F.lit(0).cast("bigint"), F.try_add)
    done = checkpoint(rows.select("index", "vec_id", deviation.alias("deviation")).join(projected(spark, everything, weights), "index"))

    k = len(values)
    y = [F.col("whitened")[i] for i in range(k)]
    moments = [F.sum(y[i]).alias(f"s{i}") for i in range(k)] + [F.sum(y[i] * y[j]).alias(f"p{i}_{j}") for i in range(k) for j in range(i, k)]
    fitted = done if n == count else done.join(fit.select("index"), "index", "left_semi")
    found = fitted.agg(*moments).first()
    error = 0.0
    for i in range(k):
        for j in range(i, k):
            if varies[i] and varies[j]:
                cov = found[f"p{i}_{j}"] / n - found[f"s{i}"] / n * (found[f"s{j}"] / n)
                error = max(error, abs(cov - (i == j)))
    each = F.posexplode(F.arrays_zip(F.col("whitened"), F.lit(explained).alias("explained")))
    return done.select("vec_id", "deviation", each).select(
        "vec_id", (F.col("pos") + 1).cast("int").alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "col.whitened", "col.explained",
        F.lit(error).alias("identity_error"))

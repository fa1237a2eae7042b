"""Embedding whitening with distributed block matrices.

Entries are scaled to whole numbers. The distinct vectors are the fit list; centred, they
are cut into the blocks of an MLlib BlockMatrix where they lie. Its transpose times itself
is the scatter; its middle dimension is split, so the blocks meet in many tasks and only
sums of d x d values go on. The scatter's eigenvectors are found locally (d x d numbers, d
at most ``MAX_DIMS``), and the block matrix of all rows times the whitening matrix projects
the rows. Rows and results meet again by block number, a few numbers a row.

Rows with a null vector, or with null or non-finite entries, are left out. All other
vectors must have one length, or a ValueError says so. Entries beyond a 64-bit integer
after scaling take its largest or smallest value; a deviation that does not fit a 64-bit
integer is null. Repeated rows are all returned, and count once in the fit list. Null ids
stay. Components without variance (by the rank of the covariance in double precision) have
null in ``whitened``; where no component has variance, ``identity_error`` is null, and
``explained`` too where the whole variance is 0. Of equal eigenvalues any basis is right.
An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kit

SCALE = 256
COMPONENTS = 4
MAX_DIMS = 4096
# Bytes of the doubles of one block; its rows follow from the number of dimensions.
BLOCK_BYTES = 1 << 20
BLOCKS = T.StructType([
    T.StructField("at", T.StructType([T.StructField("row", T.LongType()), T.StructField("column", T.LongType())])),
    T.StructField("matrix", MatrixUDT()),
])


def scaled(vectors: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    """(vec_id, x): the rows with whole finite vectors, entries as floor(scale * entry)."""
    entry = vectors[vector_column]
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    rows = vectors.where(entry.isNotNull() & ~F.exists(entry.cast("array<double>"), bad))
    return rows.select(
        rows[id_column].alias("vec_id"),
        F.transform(entry.cast("array<double>"), lambda c: F.floor(F.lit(float(scale)) * c)).alias("x"),
    )


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def totals(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sum of each dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = 0, [0] * dims
        for batch in batches:
            x = _matrix(batch.column(0), dims)
            # Sums of halves of the bits cannot overflow for any batch.
            high, low = (x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist()
            count, sums = count + len(x), [s + (h << 32) + v for s, h, v in zip(sums, high, low)]
        if count:
            yield pa.RecordBatch.from_arrays([pa.array([count] * dims), pa.array(range(dims), pa.int32()), pa.array(map(str, sums))],
                                             names=["n", "place", "total"])

    found = kit.map_arrow(fit, run, "n long, place int, total string").groupBy("place").agg(
        F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).orderBy("place").collect()
    return found[0]["n"], [int(r["total"]) for r in found]


def _row_blocks(batches: Iterator[pa.RecordBatch], dims: int, height: int, parts: int):
    """Runs of ``height`` rows of a partition, the last one shorter, with a block number unique in the table."""
    number, held, rows = TaskContext.get().partitionId(), [], 0
    for batch in batches:
        while rows + len(batch) >= height:
            held.append(batch.slice(0, height - rows))
            batch = batch.slice(height - rows)
            yield number, pa.Table.from_batches(held).combine_chunks()
            number, held, rows = number + parts, [], 0
        if len(batch):
            held.append(batch)
            rows += len(batch)
    if held:
        yield number, pa.Table.from_batches(held).combine_chunks()


def block_matrix(rows: DataFrame, mean: np.ndarray, height: int) -> BlockMatrix:
    """The centred rows(x) as a block matrix of one block column.

    Blocks are cut inside the partitions of a stored table, so nothing is shuffled; the
    last block of a partition is filled up with zero rows, which add nothing to products.
    """
    dims, parts = len(mean), rows.rdd.getNumPartitions()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, table in _row_blocks(batches, dims, height, parts):
            values = np.zeros((dims, height))
            values[:, : len(table)] = (_matrix(table["x"].chunk(0), dims) - mean).T
            none = pa.array([None], pa.list_(pa.int32()))
            matrix = pa.StructArray.from_arrays(
                [pa.array([1], pa.int8()), pa.array([height], pa.int32()), pa.array([dims], pa.int32()), none, none,
                 kit.list_column(values.ravel(), np.array([values.size]), pa.float64()), pa.array([False])],
                names=["type", "numRows", "numCols", "colPtrs", "rowIndices", "values", "isTransposed"])
            at = pa.StructArray.from_arrays([pa.array([number], pa.int64()), pa.array([0], pa.int64())], names=["row", "column"])
            yield pa.RecordBatch.from_arrays([at, matrix], names=BLOCKS.names)

    blocks = kit.map_arrow(rows.select("x"), run, BLOCKS)
    return BlockMatrix(callMLlibFunc("createBlockMatrix", blocks, height, dims, 0, 0), height, dims)


def gram(a: BlockMatrix, splits: int) -> np.ndarray:
    """a' a, summed over ``splits`` groups of row blocks; the result is small."""
    product = a.transpose()._java_matrix_wrapper.call("multiply", a._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, a.colsPerBlock, a.colsPerBlock).toLocalMatrix().toArray()


def eigen(scatter: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of the covariance, falling, and their unit eigenvectors as columns."""
    values, vectors = np.linalg.eigh((scatter + scatter.T) / (2.0 * n))
    return values[::-1], vectors[:, ::-1]


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, id_column: str = "vec_id",
           vector_column: str = "embedding", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    The fit runs when it is called; the projection of the rows is lazy.
    """
    spark = vectors.sparkSession
    rows = kit.stage(scaled(vectors, id_column, vector_column, scale), "scaled")
    schema = T.StructType([
        rows.schema["vec_id"], T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
        T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType()),
        T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType()),
    ])
    shortest, longest = rows.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if not longest:
        return spark.createDataFrame([], schema)
    if shortest != longest or longest > MAX_DIMS:
        raise ValueError(f"vectors of {shortest} to {longest} entries; one length of at most {MAX_DIMS} is needed")
    dims = longest
    fit = kit.stage(rows.select("x").distinct(), "fit")
    n, sums = totals(fit, dims)
    mean = np.array([s / n for s in sums])
    height = max(1, block_bytes // (8 * dims))
    a = block_matrix(fit, mean, height)
    splits = max(int(spark.conf.get("spark.sql.shuffle.partitions")), fit.rdd.getNumPartitions())
    values, basis = eigen(gram(a, splits), n)
    k = min(components, dims)
    good = int((values[:k] > max(values[0], 0) * dims * np.finfo(float).eps).sum())
    spread = values.clip(min=0).sum()
    explained = [float(v / spread) if spread > 0 else None for v in values[:k].clip(min=0)]
    error = None
    found = None
    if good:
        whitening = basis[:, :good] / np.sqrt(values[:good])
        w = BlockMatrix(spark.sparkContext.parallelize([((0, 0), DenseMatrix(dims, good, whitening.ravel("F")))], 1), dims, good)
        error = float(np.abs(gram(a.multiply(w), splits) / n - np.eye(good)).max())
        projected = block_matrix(rows, mean, height).multiply(w)
        found = callMLlibFunc("getMatrixBlocks", projected._java_matrix_wrapper._java_model).select(
            F.col("_1._1").cast("long").alias("block"), F.col("_2").alias("matrix"))
    measured = _deviations(rows, n, sums, height)
    pairs = measured.join(found, "block") if found is not None else measured.withColumn("matrix", F.lit(None).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                ids, deviation = batch.column(0)[i].values, batch.column(1)[i].values
                m = len(ids)
                which = pa.array(np.repeat(np.arange(m), k))
                y = np.zeros((m, k))
                if good:
                    y[:, :good] = batch.column(2)[i]["values"].values.to_numpy().reshape(good, height)[:, :m].T
                empty = np.tile(np.arange(k) >= good, m)
                yield pa.RecordBatch.from_arrays([
                    ids.take(which), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                    deviation.take(which), pa.array(y.ravel(), mask=empty), pa.array(explained * m, pa.float64()),
                    pa.array([error] * (m * k), pa.float64()),
                ], names=schema.names)

    return pairs.select("ids", "deviations", "matrix").mapInArrow(run, schema)


def _deviations(rows: DataFrame, n: int, sums: list[int], height: int) -> DataFrame:
    """(block, ids, deviations): ids and exact squared distances from the mean, times n * n, by block."""
    parts, dims = rows.rdd.getNumPartitions(), len(sums)
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(rows.schema["vec_id"].dataType)),
        T.StructField("deviations", T.ArrayType(T.LongType())),
    ])
    most = 1 << 63

    def exact(x: np.ndarray) -> list[int | None]:
        reach = max(abs(int(x.min())), abs(int(x.max())))
        if (n * reach + max(map(abs, sums))) ** 2 * dims < most:
            return (np.square(x * np.int64(n) - np.array(sums, np.int64)).sum(axis=1)).tolist()
        whole = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
        return [v if v < most else None for v in whole]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, table in _row_blocks(batches, dims, height, parts):
            ids, ends = table["vec_id"].chunk(0), pa.array([0, len(table)], pa.int32())
            yield pa.RecordBatch.from_arrays([
                pa.array([number], pa.int64()), pa.ListArray.from_arrays(ends, ids),
                pa.ListArray.from_arrays(ends, pa.array(exact(_matrix(table["x"].chunk(0), dims)), pa.int64())),
            ], names=schema.names)

    return kit.map_arrow(rows.select("vec_id", "x"), run, schema)

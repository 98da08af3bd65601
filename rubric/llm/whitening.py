"""Embedding whitening with distributed block matrices.

Entries become whole steps (``floor(steps * c)``), so equal vectors are equal
exactly.  The fit list has each distinct vector once.  Its rows, less the
mean, are dealt to the blocks of an MLlib ``BlockMatrix``; its transpose times
itself is the scatter, a matrix of dimensions only, whose eigenvectors a local
``eigh`` gives.  A second ``BlockMatrix`` holds the rows to project and is
multiplied by the whitening matrix.

Blocks are made in the tasks that read the rows: a partition's rows follow
each other, the last block is filled up with zero rows (they add nothing to
a scatter), and a prefix sum over the partitions' numbers of blocks numbers
them.  Two layouts are used.  For the scatter all blocks stand in one column,
and the multiplication splits that inner dimension into as many parts as there
are partitions.  For the projection they stand in a square grid, with the whitening matrix
on the diagonal of the right factor: MLlib deals out the cells of a result's
grid, and a single column of them would go to few tasks.

On the driver: the numbers of rows of each partition, the coordinates of at
most ``BLOCKS`` blocks (MLlib's multiplication plans with them; blocks get
longer instead), and matrices of dimensions x dimensions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .rows import python_ready, written

STEPS = 256
COMPONENTS = 4
#: Rows of a block, while there are at most ``BLOCKS`` of them.
BLOCK_ROWS = 4096
BLOCKS = 1 << 18
#: Rows turned into output at a time.
ROWS = 8192

PLACE = StructType([StructField("_1", LongType()), StructField("_2", LongType())])
CELL = StructType([StructField("_1", PLACE), StructField("_2", MatrixUDT())])
INTS = pa.list_(pa.int32())


@dataclass
class Model:
    """``n`` vectors of the fit list with the sums ``total``; ``vectors``
    (dimensions x components) and ``values`` of the leading eigenvectors of
    their covariance, whose trace is ``trace``."""

    n: int
    total: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.total])

    @property
    def matrix(self) -> np.ndarray:
        """The whitening matrix; a component without variance has zeros."""
        scale = np.divide(1.0, np.sqrt(np.maximum(self.values, 0)), out=np.zeros(len(self.values)), where=self.varies)
        return self.vectors * scale

    @property
    def varies(self) -> np.ndarray:
        least = len(self.total) * np.finfo(float).eps * max(self.trace, 0.0)
        return self.values > least


def whole_steps(rows: DataFrame, steps: int = STEPS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x), x the vector in whole steps as longs, as a written table.

    Rows whose vector is null, empty, or holds a null or non-finite entry are
    dropped, and so are those of another length than most rows have (the
    longer one of a tie).
    """
    c = F.transform(rows[vector_col], lambda e: e.cast("double"))
    finite = F.forall(c, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False)))
    good = rows.select(rows[id_col].cast("long").alias("vec_id"), c.alias("c")).where(
        F.col("c").isNotNull() & (F.size("c") > 0) & finite)
    table = written(good.select("vec_id", F.transform("c", lambda e: F.floor(e * steps).cast("long")).alias("x")), "whitening-rows")
    width = table.groupBy(F.size("x").alias("width")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    return table.where(F.size("x") == (width["width"] if width else 0))


def block_rows(n: int) -> int:
    return max(BLOCK_ROWS, -(-n // BLOCKS))


def first_blocks(rows: DataFrame, size: int) -> tuple[dict[int, int], int]:
    """The number of the first block of each partition of a written table, and the number of blocks."""
    counts = rows.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()
    first, blocks = {}, 0
    for r in sorted(counts, key=lambda r: r["part"]):
        first[r["part"]] = blocks
        blocks += -(-r["n"] // size)
    return first, blocks


def in_blocks(batches: Iterator[pa.RecordBatch], first: dict[int, int], size: int) -> Iterator[tuple[int, pa.Table]]:
    """(block number, its rows) of this task's partition."""
    number, held, n = first.get(TaskContext.get().partitionId(), 0), [], 0
    for batch in batches:
        while batch.num_rows:
            some = batch.slice(0, size - n)
            held.append(some)
            n += some.num_rows
            batch = batch.slice(some.num_rows)
            if n == size:
                yield number, pa.Table.from_batches(held)
                number, held, n = number + 1, [], 0
    if n:
        yield number, pa.Table.from_batches(held)


def vectors_of(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(-1, width)


def cell(place: tuple[int, int], matrix: np.ndarray) -> pa.RecordBatch:
    """One block as a row of ``CELL``, values row by row."""
    at = pa.StructArray.from_arrays([pa.array([i], pa.int64()) for i in place], ["_1", "_2"])
    values = pa.ListArray.from_arrays(pa.array([0, matrix.size], pa.int32()), pa.array(np.ascontiguousarray(matrix).ravel()))
    dense = pa.StructArray.from_arrays(
        [pa.array([1], pa.int8()), pa.array([matrix.shape[0]], pa.int32()), pa.array([matrix.shape[1]], pa.int32()),
         pa.array([None], INTS), pa.array([None], INTS), values, pa.array([True])],
        ["type", "numRows", "numCols", "colPtrs", "rowIndices", "values", "isTransposed"])
    return pa.RecordBatch.from_arrays([at, dense], ["_1", "_2"])


def block_matrix(cells: DataFrame, block: tuple[int, int], grid: tuple[int, int]) -> BlockMatrix:
    return BlockMatrix(callMLlibFunc("createBlockMatrix", cells, *block, block[0] * grid[0], block[1] * grid[1]), *block)


def centred(rows: DataFrame, mean: np.ndarray, columns: int = 1, size: int = BLOCK_ROWS) -> tuple[BlockMatrix, int]:
    """``rows`` (x) less ``mean`` as a block matrix whose blocks fill
    ``columns`` columns (0: as many as rows of blocks) row by row, and the
    number of columns."""
    first, blocks = first_blocks(rows, size)
    columns = columns or max(1, int(np.ceil(np.sqrt(blocks))))
    width = len(mean)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, table in in_blocks(batches, first, size):
            matrix = np.zeros((size, width))
            matrix[:table.num_rows] = vectors_of(table.column(0), width) - mean
            yield cell(divmod(number, columns), matrix)

    cells = rows.select("x").mapInArrow(make, CELL)
    return block_matrix(cells, (size, width), (max(1, -(-blocks // columns)), columns)), columns


def scatter(matrix: BlockMatrix, parts: int) -> np.ndarray:
    """The transpose times the matrix.  ``parts``: of the inner dimension, each multiplied by itself and then added up."""
    left, right = matrix.transpose()._java_matrix_wrapper._java_model, matrix._java_matrix_wrapper._java_model
    product = BlockMatrix(left.multiply(right, parts), matrix.colsPerBlock, matrix.colsPerBlock)
    return product.toLocalMatrix().toArray()


def fit(distinct: DataFrame, components: int = COMPONENTS) -> Model | None:
    """The model of a written table of distinct vectors (x); None if it has none.

    Sums of whole numbers are exact; a sum beyond a long stops the job.
    """
    one = distinct.select(F.size("x").alias("width")).first()
    if one is None:
        return None
    found = distinct.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.get("x", F.lit(i))).alias(f"s{i}") for i in range(one["width"])]).first()
    n, total = found[0], list(found[1:])
    mean = np.array([s / n for s in total])
    matrix, _ = centred(distinct, mean, size=block_rows(n))
    covariance = scatter(matrix, max(1, distinct.rdd.getNumPartitions())) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(values)[::-1][:components]
    return Model(n, total, values[order], vectors[:, order], float(np.trace(covariance)))


def project(rows: DataFrame, model: Model, size: int) -> DataFrame:
    """The block matrix of ``rows`` (x, written) times the whitening matrix:
    (block, z), z the block's result row by row, zero rows of filling included."""
    matrix, columns = centred(rows, model.mean, 0, size)
    weights, spark = model.matrix, rows.sparkSession
    width, k = weights.shape

    def diagonal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                yield cell((i, i), weights)

    right = block_matrix(spark.range(columns).mapInArrow(diagonal, CELL), (width, k), (columns, columns))
    product = matrix.multiply(right)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, m in zip(batch.column(0).to_pylist(), batch.column(1)):
                z = m["values"].values.to_numpy()
                if not m["isTransposed"].as_py():
                    z = z.reshape(k, -1).T
                yield pa.RecordBatch.from_arrays([pa.array([at["_1"] * columns + at["_2"]], pa.int64()),
                                                  pa.array([np.ascontiguousarray(z).tobytes()], pa.binary())], ["block", "z"])

    return callMLlibFunc("getMatrixBlocks", product._java_matrix_wrapper._java_model).mapInArrow(unpack, "block long, z binary")


def identity_error(distinct: DataFrame, model: Model, size: int) -> float:
    """Largest absolute entry of the covariance of the whitened fit list less the identity, over the components that vary."""
    k = len(model.values)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, mean = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            for z in batch.column(1):
                rows = np.frombuffer(z.as_py()).reshape(-1, k)
                gram += rows.T @ rows
                mean += rows.sum(axis=0)
        both = np.concatenate([gram.ravel(), mean])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(both)), pa.int32()), pa.array(both)], ["at", "v"])

    found = project(distinct, model, size).mapInArrow(grams, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    sums = np.zeros(k * k + k)
    for r in found:
        sums[r["at"]] = r["v"]
    mean = sums[k * k:] / model.n
    off = np.abs(sums[:k * k].reshape(k, k) / model.n - np.outer(mean, mean) - np.eye(k))
    return float(off[np.ix_(model.varies, model.varies)].max(initial=0.0))


def deviations(x: np.ndarray, n: int, total: list[int]) -> list[int]:
    """Sum over dimensions of (n * x - total)^2 of each row, exactly; beyond a long it stops the job."""
    most = float(n) * float(np.abs(x.astype(float)).max(initial=0.0)) + max(map(abs, total), default=0)
    if most < 2 ** 31 and most * most * x.shape[1] < 2 ** 62:
        return ((x * n - np.array(total)) ** 2).sum(axis=1).tolist()
    return [sum((n * v - s) ** 2 for v, s in zip(row, total)) for row in x.tolist()]


def whiten(rows: DataFrame, steps: int = STEPS, components: int = COMPONENTS,
           id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per remaining input row (``whole_steps``) and component:
    vec_id, component (from 1), n, deviation, whitened, explained,
    identity_error.

    Fitted on each distinct vector once; every row is projected, repeated
    ids and vectors too, and null ids stay null.  There are at most as many
    components as dimensions.  A component without variance has a null
    ``whitened`` (with a single distinct vector all have), ``explained`` is
    null if there is no variance at all.  Without rows there are none.
    """
    spark = rows.sparkSession
    python_ready(spark)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    table = whole_steps(rows, steps, id_col, vector_col)
    distinct = written(table.select("x").distinct(), "whitening-fit")
    model = fit(distinct, components)
    if model is None:
        return spark.createDataFrame([], schema)
    error = identity_error(distinct, model, block_rows(model.n))
    size = block_rows(table.count())
    first, _ = first_blocks(table, size)
    width, k, varies, n, total = len(model.total), len(model.values), model.varies, model.n, model.total
    explained = [float(v) / model.trace if model.trace > 0 else None for v in model.values]

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, some in in_blocks(batches, first, size):
            lists = [pa.array([some.column(0).to_pylist()], pa.list_(pa.int64())),
                     pa.array([deviations(vectors_of(some.column(1), width), n, total)], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *lists], ["block", "ids", "deviations"])

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, far, z in zip(*(batch.column(c) for c in ("ids", "deviations", "z"))):
                ids, far, z = ids.values, far.values, np.frombuffer(z.as_py()).reshape(-1, k)
                for i in range(0, len(ids), ROWS):
                    take = pa.array(np.repeat(np.arange(i, min(i + ROWS, len(ids))), k))
                    m = len(take) // k
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(take), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array([n] * (m * k), pa.int64()),
                         far.take(take), pa.array(z[i:i + m].ravel(), mask=np.tile(~varies, m)),
                         pa.array(explained * m, pa.float64()), pa.array([error] * (m * k), pa.float64())],
                        ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    held = table.select("vec_id", "x").mapInArrow(members, "block long, ids array<long>, deviations array<long>")
    return held.join(project(table, model, size), "block").mapInArrow(out, schema)

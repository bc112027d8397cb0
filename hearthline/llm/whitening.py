"""Embedding whitening on distributed blocks: scatter by a transposed product, local eigenvectors, projection by a second product.

Vectors become blocks of centred rows of a ``BlockMatrix``. Its transpose times itself, with the middle dimension split over tasks, is the
scatter matrix, as wide as a vector; its eigenvectors are found on the driver. For the projection the same blocks are laid out as a
square grid of panels and multiplied by a block-diagonal matrix of whitening blocks: the grid partitioner deals a tall single column of
blocks to the square root of its partitions only, a square grid to all of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame, SparkSession, functions as F

from hearthline.llm.frames import keep_shuffles_short, stored, table
from hearthline.plans.catalog import query

#: Rows of a block; blocks that one task makes; components that are returned.
ROWS, BLOCKS, COMPONENTS = 1024, 8, 32
#: x = floor(SCALE * entry) + SHIFT. Larger products than LARGEST, far beyond what a double holds exactly, count as that.
SCALE, SHIFT, LARGEST = 64, 1_000_000, 2**52
#: Eigenvalues of at most this share of the largest are rounding errors.
TINY = 1e-13


def usable_vectors(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows whose vector is neither missing nor holds a missing or infinite entry or NaN; the vector as doubles."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda c: F.coalesce((c - c) == F.lit(0.0), F.lit(False)) & ~F.isnan(c))
    return rows.where(F.col(vector).isNotNull()).where(fine).withColumn(vector, v)


def _blocks(rows: DataFrame, dim: int, n: int) -> DataFrame:
    """block, ids, x: whole numbers of up to ROWS vectors as the bytes of one block."""
    tasks = max(1, math.ceil(n / (ROWS * BLOCKS)))
    schema = "part int, nth int, ids array<long>, x binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth, ids, held = TaskContext.get().partitionId(), 0, [], []

        def block() -> pa.RecordBatch:
            x = np.clip(np.floor(SCALE * np.concatenate(held)), -LARGEST, LARGEST).astype(np.int64) + SHIFT
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([nth], pa.int32()), pa.array([ids], pa.list_(pa.int64())),
                                               pa.array([x.tobytes()], pa.binary())], ["part", "nth", "ids", "x"])

        for b in batches:
            values = b.column(1).flatten().to_numpy().reshape(-1, dim)
            own = b.column(0).to_pylist()
            at = 0
            while at < len(own):
                more = ROWS - len(ids)
                ids.extend(own[at:at + more])
                held.append(values[at:at + more])
                at += more
                if len(ids) == ROWS:
                    yield block()
                    nth, ids, held = nth + 1, [], []
        if ids:
            yield block()

    made = stored(rows.repartition(tasks).mapInArrow(cut, schema), "vector-blocks")
    # Blocks are numbered without gaps; of each task's blocks only the last may be short.
    first, at = {}, 0
    for r in made.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():
        first[r["part"]], at = at, at + r["n"]
    number = F.element_at(F.create_map(*(F.lit(v) for pair in first.items() for v in pair)), F.col("part")) if first else F.lit(0)
    return made.select((number + F.col("nth")).cast("long").alias("block"), "ids", "x")


def _matrix(blocks: DataFrame, means: np.ndarray, n_blocks: int, columns: int) -> BlockMatrix:
    """The centred rows, block by block, as a matrix of ``columns`` columns of blocks; short blocks are filled with zero rows."""
    dim = len(means)

    def centred(r):
        x = np.frombuffer(r["x"], np.int64).reshape(-1, dim)
        values = np.zeros((ROWS, dim))
        values[:len(x)] = x - means
        return (r["block"] // columns, r["block"] % columns), DenseMatrix(ROWS, dim, values.ravel(order="F"))

    made = BlockMatrix(blocks.rdd.map(centred), ROWS, dim, math.ceil(n_blocks / columns) * ROWS, columns * dim)
    return made.persist(StorageLevel.MEMORY_AND_DISK)


def _transposed_product(m: BlockMatrix, splits: int) -> np.ndarray:
    """m' m. The Python class has no argument for the number of splits of the middle dimension, without which one task gets all blocks."""
    t = m.transpose()
    product = t._java_matrix_wrapper.call("multiply", m._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, m.colsPerBlock, m.colsPerBlock).toLocalMatrix().toArray()


def _exact(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sum over the entries of (n * x - sums)^2 by row, in whole numbers; None where a long can't hold it."""
    far = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * n + max((abs(int(s)) for s in sums), default=0)
    if far < 2**62 and (far_off := int(np.abs(n * x - sums.astype(np.int64)).max(initial=0))) ** 2 * x.shape[1] < 2**63:
        return ((n * x - sums.astype(np.int64)) ** 2).sum(1).tolist()
    exact = ((n * x.astype(object) - sums) ** 2).sum(1)
    return [int(v) if v < 2**63 else None for v in exact]


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, most: int = COMPONENTS, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row for every usable vector and component up to ``most``, with the columns of OUT.

    Entries c become x = floor(64 c) + 1000000. n is the number of vectors; deviation is the sum of (n x - S)^2 over dimensions, S being
    the sums of x, and null if no long holds it; whitened is the centred x, projected on the unit eigenvector of the covariance that belongs to
    the component-th largest eigenvalue, over the eigenvalue's root; explained is that eigenvalue's share of the trace; identity_error the
    largest absolute entry of whitened's covariance minus the identity. A component without variance has no whitened value (null) and explains
    0 or, if no component has any, null; identity_error leaves it out (null if none is left).

    Vectors that are missing or hold missing or non-finite entries are dropped, and so are vectors of another length than most have (the
    greater of equally frequent ones). Repeated rows count and return as often as they occur, a missing id stays missing, other
    columns are not read. No usable vector: an empty table. The dimension is bounded, as the driver holds matrices of that width.
    """
    spark = rows.sparkSession
    keep_shuffles_short(spark)
    fine = usable_vectors(rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v")), "v")
    sizes = fine.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    if not sizes or sizes[0]["dim"] == 0:
        return spark.createDataFrame([], OUT)
    dim, n = sizes[0]["dim"], sizes[0]["n"]
    blocks = _blocks(fine.where(F.size("v") == dim), dim, n)
    n_blocks = blocks.count()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * dim
        for b in batches:
            for x in b.column(0):
                total = [a + int(s) for a, s in zip(total, np.frombuffer(x.as_py(), np.int64).reshape(-1, dim).sum(0))]
        yield pa.RecordBatch.from_pydict({"dim": pa.array(range(dim), pa.int32()), "total": pa.array(map(str, total))})

    summed = blocks.select("x").mapInArrow(add, "dim int, total string").groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    sums = np.array([int(r["total"]) for r in summed.orderBy("dim").collect()], object)
    means = np.array([s / n for s in sums], float)

    tasks = max(2, spark.sparkContext.defaultParallelism, n_blocks // BLOCKS)
    tall = _matrix(blocks, means, n_blocks, 1)
    scatter = _transposed_product(tall, min(n_blocks, tasks)) / n
    values, vectors = np.linalg.eigh((scatter + scatter.T) / 2)
    most = min(most, dim)
    order = np.argsort(-values, kind="stable")[:most]
    trace, values, vectors = float(np.trace(scatter)), values[order], vectors[:, order]
    real = values > TINY * max(values.max(), 0.0) if trace > 0 else np.zeros(most, bool)
    project = np.where(real, vectors / np.sqrt(np.where(real, values, 1.0)), 0.0)
    explained = np.where(real, values / trace, 0.0).tolist() if trace > 0 else [None] * most

    panels = max(1, math.isqrt(n_blocks))
    packed = project.ravel(order="F")
    diagonal = spark.sparkContext.parallelize(range(panels), min(panels, tasks)).map(lambda i: ((i, i), DenseMatrix(dim, most, packed)))
    whitening = BlockMatrix(diagonal, dim, most, panels * dim, panels * most)
    grid = _matrix(blocks, means, n_blocks, panels)
    projected = grid.multiply(whitening)
    w = stored(spark.createDataFrame(projected.blocks.map(lambda b: (b[0][0] * panels + b[0][1], bytearray(b[1].toArray().tobytes()))), "block long, w binary"), "whitened-blocks")
    for m in (tall, grid):
        m._java_matrix_wrapper._java_model.blocks().unpersist(False)
    joined = blocks.join(w, "block")

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(most), np.zeros((most, most))
        for b in batches:
            for v, k in zip(b.column(0), b.column(1).to_pylist()):
                y = np.frombuffer(v.as_py(), float).reshape(-1, most)[:k]
                first += y.sum(0)
                second += y.T @ y
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(most + most * most), pa.int32()), "s": np.concatenate([first, second.ravel()])})

    moments = joined.select("w", F.size("ids").alias("k")).mapInArrow(products, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).orderBy("at")
    s = np.array([r["s"] for r in moments.collect()])
    covariance = s[most:].reshape(most, most) / n - np.outer(s[:most] / n, s[:most] / n)
    off = np.abs(covariance - np.eye(most))[np.ix_(real, real)]
    error = float(off.max()) if off.size else None

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, x, v in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                k = len(ids)
                x = np.frombuffer(x.as_py(), np.int64).reshape(-1, dim)
                y = np.frombuffer(v.as_py(), float).reshape(-1, most)[:k]
                each = lambda values, kind: pa.array(values, kind).take(pa.array(np.repeat(np.arange(k), most)))
                by = np.tile(np.arange(most), k)
                yield pa.RecordBatch.from_arrays([
                    each(ids, pa.int64()), pa.array(by + 1, pa.int32()), pa.array(np.full(k * most, n, np.int64)), each(_exact(x, n, sums), pa.int64()),
                    pa.array(y.ravel(), mask=~np.tile(real, k)), pa.array(explained, pa.float64()).take(pa.array(by)),
                    pa.array([error], pa.float64()).take(pa.array(np.zeros(k * most, np.int64)))], [f.split()[0] for f in OUT.split(", ")])

    return joined.select("ids", "x", "w").mapInArrow(expand, OUT)


@query("op11_embedding_whitening")
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))

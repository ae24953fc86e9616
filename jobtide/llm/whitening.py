"""Embedding whitening over MLlib's BlockMatrix.

Vectors become longs x = floor(SCALE * c) + SHIFT, so counts, sums and deviations are exact. Rows are
numbered without gaps, centred by the exact mean ((n*x - S) / n) and put into blocks of BLOCK entries, a
BlockMatrix A. A's transpose times A is the scatter; MLlib deals the middle dimension to as many tasks as there
are stretches of blocks, and adds up the products of one matrix of dimension x dimension each. Its
eigenvectors are found on the driver (eigh), scaled by 1 / sqrt(eigenvalue), and A times that matrix gives the rows.
What passes through the driver: sums and scatter (by the dimension alone), one count a partition,
and in MLlib the ids of the blocks.

Defined cases: rows whose vector is null, empty, or holds a null, a non-finite entry or one of 2^42 and more
(whose x no double holds exactly) are dropped; where vectors differ in length the most frequent length counts (of
equals the greater) and others are dropped; repeated rows and ids, null ids too, each give their own
rows and count each time; components whose eigenvalue is zero to double precision are not given,
so n = 1, equal vectors or an empty table give no rows; eigenvalues that tie keep the order that
eigh gives; a deviation beyond a long is null; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, written

#: Entries of a block of rows: 4 MB of doubles.
BLOCK = 1 << 19
#: Blocks whose products one task adds up.
STRETCH = 8
SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
MOST = float(1 << 42)
OUT = "vec_id {}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Whitened:
    """rows: (id, x, deviation, z), z the row's components; the eigenvalues of these, and the trace of the covariance."""

    rows: DataFrame
    n: int
    eigenvalues: np.ndarray
    trace: float
    identity_error: float


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of the rows that take part, as doubles."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    # `abs(c) < MOST` is false for infinities and NaN, which Spark sorts last.
    whole = F.coalesce(F.forall("vec", lambda c: F.coalesce(F.abs(c) < MOST, F.lit(False))), F.lit(False))
    rows = rows.filter(whole & (F.size("vec") > 0))
    common = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size("vec") == (common["d"] if common else 0))


def numbered(rows: DataFrame, purpose: str) -> DataFrame:
    """Adds index, 0, 1, ... without gaps; the rows are stored, so the numbers stay. One row a partition is summed up."""
    stored = written(rows.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), purpose)
    parts = stored.groupBy("part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", (before - F.col("first")).alias("shift"))
    return stored.join(F.broadcast(parts), "part").withColumn("index", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def blocks_of(rows: DataFrame, d: int) -> BlockMatrix:
    """(index, vec) as blocks of whole rows, kept, as three products read them."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector("vec").alias("vector")), "vector")
    return IndexedRowMatrix(vectors).toBlockMatrix(max(1, BLOCK // d), d).persist(StorageLevel.MEMORY_AND_DISK)


def scatter(blocks: BlockMatrix) -> np.ndarray:
    """Transpose times blocks. The splits of the middle dimension have no public argument in Python."""
    splits = max(1, -(-blocks.numRowBlocks // STRETCH))
    product = blocks.transpose()._java_matrix_wrapper.call("multiply", blocks._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, blocks.colsPerBlock, blocks.colsPerBlock).toLocalMatrix().toArray()


def components(covariance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and their unit eigenvectors as columns; those that are zero to double precision left out."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    there = values > len(covariance) * np.finfo(float).eps * max(values[0], 0.0)
    return values[there], vectors[:, there]


def projected(blocks: BlockMatrix, matrix: np.ndarray) -> DataFrame:
    """(index, z) of every row: blocks times `matrix`."""
    spark = SparkSession.getActiveSession()
    one = spark.sparkContext.parallelize([((0, 0), Matrices.dense(*matrix.shape, matrix.flatten("F").tolist()))], 1)
    rows = blocks.multiply(BlockMatrix(one, *matrix.shape)).toIndexedRowMatrix().rows
    return spark.createDataFrame(rows.map(lambda r: (r.index, r.vector.toArray().tolist())), "index bigint, z array<double>")


def identity_error(rows: DataFrame, k: int) -> float:
    """The largest absolute entry of the covariance of z (centred, divisor n) minus the identity."""
    covariances = rows.agg(*(F.covar_pop(F.get("z", F.lit(i)), F.get("z", F.lit(j))).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k))).first()
    return max(abs(covariances[f"c{i}_{j}"] - (i == j)) for i in range(k) for j in range(i, k))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = COMPONENTS) -> Whitened | None:
    """Whitens all usable rows by components fitted on all of them; None where there is no component."""
    x = F.transform("vec", lambda c: F.floor(SCALE * c).cast("long") + SHIFT)
    rows = numbered(usable(vectors, id_col, vec_col).select("id", x.alias("x")), "vectors")
    sums = sorted(rows.select(F.posexplode("x")).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(20,0)")).alias("s"), F.count("*").alias("n")).collect())
    if not sums:
        return None
    n, d = sums[0]["n"], len(sums)
    exact = lambda c: c.cast("decimal(38,0)")
    off = F.zip_with("x", F.array(*(exact(F.lit(s["s"])) for s in sums)), lambda a, s: exact(exact(a) * F.lit(n) - s))
    rows = rows.withColumn("off", off)
    blocks = blocks_of(rows.select("index", F.transform("off", lambda o: o.cast("double") / n).alias("vec")), d)
    covariance = scatter(blocks) / n
    values, directions = components(covariance, k)
    z = written(projected(blocks, directions / np.sqrt(values)), "whitened") if len(values) else None
    blocks._java_matrix_wrapper._java_model.blocks().unpersist(False)
    if z is None:
        return None
    squares = F.aggregate("off", exact(F.lit(0)), lambda a, o: exact(F.try_add(a, F.try_multiply(o, o))))
    rows = rows.select("id", "index", "x", squares.try_cast("bigint").alias("deviation")).join(z, "index").drop("index")
    return Whitened(rows, n, values, float(np.trace(covariance)), identity_error(z, len(values)))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component."""
    vectors = table(spark, sf_dir, "embeddings")
    found = whiten(vectors)
    if found is None:
        return spark.createDataFrame([], OUT.format(dict(vectors.dtypes)["vec_id"]))
    shares = F.array(*(F.lit(float(e / found.trace)) for e in found.eigenvalues))
    rows = found.rows.select(F.col("id").alias("vec_id"), "deviation", F.posexplode("z").alias("pos", "whitened"))
    return rows.select("vec_id", (F.col("pos") + 1).alias("component"), F.lit(found.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("pos")).alias("explained"), F.lit(found.identity_error).alias("identity_error"))


QUERIES = {"op13_whitening": op13_whitening}

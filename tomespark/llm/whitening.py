"""Whitening of embeddings by their covariance, in two passes over the vectors.

Pass one adds up whole numbers, x = floor(1024 c) + 100000, exactly: sums are
kept as high and low halves of 32 bits, so they can't leave 64 bits before
2**31 rows of a task, and halves of tasks are added as Python integers. Pass two
centres each vector by the mean and adds outer products, one matrix product of
NumPy for each batch; treeAggregate merges the tasks' matrices. The driver holds
one matrix of the vectors' own width, never rows: symmetric eigh of LAPACK gives
the components, and a matrix of at most 8 of them goes to the workers.

Defined cases: a vector that is null, empty or holds null or non-finite entries
takes no part; nor do vectors of another length than most have (of equally
frequent lengths the longest counts), as they have no covariance with the others.
Rows that repeat count each and come out each; a null id keeps its row. Entries
so large that x leaves 64 bits take no part either. A component along which the
vectors don't vary (its eigenvalue is below the rounding of the largest) can't be
scaled to one: its whitened values are null, its explained share is what it is,
and identity_error leaves it out. Where deviation leaves 64 bits it is null. An
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Numbers of one block of vectors in a worker, about.
BLOCK = 1 << 20
_LEAST, _MOST = -(2.0**63), 2.0**63 - 2048


def vectors_of(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and vec, an array of whole numbers, for vectors that can take part."""
    scaled = F.transform(F.col(vector_col), lambda c: F.floor(c.cast("double") * SCALE).cast("bigint") + SHIFT)
    fits = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & F.abs(c.cast("double")).between(0.0, _MOST / SCALE / 2)
    usable = F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & F.forall(vector_col, fits)
    whole = table.filter(usable).select(F.col(id_col).cast("long").alias("vec_id"), scaled.alias("vec"))
    lengths = whole.groupBy(F.size("vec").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    return whole.filter(F.size("vec") == (lengths["width"] if lengths else 0))


def _blocks(batches) -> Iterator[tuple]:
    """Ids (an Arrow array) and whole numbers (rows by dimensions), in blocks of bounded size."""
    for b in batches:
        if not b.num_rows:
            continue
        vecs = b.column(1)
        width = len(vecs[0])
        step = max(1, BLOCK // width)
        for a in range(0, b.num_rows, step):
            part = vecs.slice(a, step)
            yield b.column(0).slice(a, step), part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), width)


def exact_sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """The number of vectors and the sum of each dimension."""

    def sums(batches):
        import pyarrow as pa

        n, high, low = 0, 0, 0
        for _, x in _blocks(batches):
            n += len(x)
            high = high + (x >> 32).sum(axis=0)
            low = low + (x & 0xFFFFFFFF).sum(axis=0)
        if n:
            dims = range(len(high))
            yield pa.RecordBatch.from_arrays([pa.array([*dims], pa.int32()), pa.array(high), pa.array(low), pa.array([n] * len(high))], names=["dim", "high", "low", "n"])

    parts = vectors.mapInArrow(sums, "dim int, high bigint, low bigint, n bigint")
    whole = "decimal(38,0)"
    total = parts.groupBy("dim").agg(F.sum(F.col("high").cast(whole) * 4294967296 + F.col("low").cast(whole)).alias("s"), F.sum("n").alias("n")).orderBy("dim").collect()
    return (total[0]["n"], [int(r["s"]) for r in total]) if total else (0, [])


def _tree_sum(parts: DataFrame, width: int) -> np.ndarray:
    """The sum of square matrices, one row of bytes each, merged in a tree of tasks."""
    zero = np.zeros((width, width))

    def add(total: np.ndarray, row) -> np.ndarray:
        return total + np.frombuffer(row["m"], dtype=np.float64).reshape(width, width)

    return parts.rdd.treeAggregate(zero, add, lambda a, b: a + b, depth=3)


def centred_products(vectors: DataFrame, mean: np.ndarray) -> np.ndarray:
    """The sum of outer products of centred vectors."""

    def products(batches):
        import pyarrow as pa

        total = None
        for _, x in _blocks(batches):
            c = x.astype(np.float64) - mean
            total = c.T @ c if total is None else total + c.T @ c
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    return _tree_sum(vectors.mapInArrow(products, "m binary"), len(mean))


def components(covariance: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues in falling order, unit eigenvectors as columns, and which of them can be scaled to one."""
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    usable = values > max(values[0], 0.0) * len(covariance) * np.finfo(float).eps
    return np.maximum(values, 0.0), vectors, usable


def _projected(vectors: DataFrame, mean: np.ndarray, axes: np.ndarray, n: int, sums: list[int]) -> DataFrame:
    """vec_id, deviation and whitened (an array, one entry a column of ``axes``)."""
    sent = vectors.sparkSession.sparkContext.broadcast((mean, axes, sums))

    def project(batches):
        import pyarrow as pa

        mean, axes, sums = sent.value
        whole = np.array(sums, dtype=object)
        for ids, x in _blocks(batches):
            far = max((max(abs(n * int(x.max()) - s), abs(n * int(x.min()) - s)) for s in (min(sums), max(sums))), default=0)
            if far < 2**62 and far * far * x.shape[1] < 2**63 and max(abs(s) for s in sums) < 2**62:
                d = n * x - np.array(sums, dtype=np.int64)
                deviation = (d * d).sum(axis=1).tolist()
            else:  # numbers of any size
                deviation = [int(v) if v < 2**63 else None for v in (((n * x.astype(object) - whole) ** 2).sum(axis=1))]
            y = (x.astype(np.float64) - mean) @ axes
            flat = pa.array(y.ravel())
            offsets = pa.array(np.arange(0, y.size + 1, y.shape[1]) if y.size else np.zeros(len(y) + 1), pa.int32())
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(deviation, pa.int64()), pa.ListArray.from_arrays(offsets, flat)], names=["vec_id", "deviation", "whitened"])

    return vectors.mapInArrow(project, "vec_id bigint, deviation bigint, whitened array<double>")


def identity_error(projected: DataFrame, width: int) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, measured on all rows."""
    if not width:
        return 0.0
    means = projected.agg(F.count(F.lit(1)).alias("n"), *(F.avg(F.col("whitened")[j]).alias(f"m{j}") for j in range(width))).first()
    mean = np.array([means[f"m{j}"] for j in range(width)])

    def products(batches):
        import pyarrow as pa

        total = np.zeros((width, width))
        for b in batches:
            c = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, width) - mean
            total += c.T @ c
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    covariance = _tree_sum(projected.select("whitened").mapInArrow(products, "m binary"), width) / means["n"]
    return float(np.abs(covariance - np.eye(width)).max())


def whiten(table: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """One row a vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    vectors = vectors_of(table, id_col, vector_col)
    n, sums = exact_sums(vectors)
    names = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if not n:
        return table.sparkSession.createDataFrame([], names)
    mean = np.array([s / n for s in sums])  # quotients of Python integers are rounded once
    covariance = centred_products(vectors, mean) / n
    values, axes, usable = components(covariance, most)
    trace = float(np.trace(covariance))
    projected = _projected(vectors, mean, axes[:, usable] / np.sqrt(values[usable]), n, sums)
    error = identity_error(projected, int(usable.sum()))
    explained = F.array(*(F.lit(float(v) / trace if trace > 0 else 0.0) for v in values))
    each = F.posexplode(F.transform(explained, lambda e, i: F.struct(F.get("whitened", i).alias("w"), e.alias("e"))))
    rows = projected.select("vec_id", "deviation", each.alias("i", "c"))
    return rows.select("vec_id", (F.col("i") + 1).cast("int").alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", F.col("c.w").alias("whitened"), F.col("c.e").alias("explained"), F.lit(error).alias("identity_error"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(common.spread(common.table(spark, sf_dir, "embeddings")))

"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more than this share of all rows is hot; so there are at most 1 / HOT_SHARE of them, however large the table.
HOT_SHARE, SALTS = 0.001, 64
#: Bytes of text that a Python worker turns into objects at once, about; a longer text is handled alone.
SLICE_BYTES = 8 << 20
#: Ids (8 bytes each) that are broadcast at most to drop their rows; beyond, it's a shuffled join.
BROADCAST_DROPPED = 1_000_000


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share.

    The cluster names that folder in ``spark.checkpoint.dir``. Only in local
    mode (tests, one machine) does a temporary folder stand in for it.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tomespark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its lineage ends there, so lost executors cost no recomputing."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing reads any more, as their successors are written."""
    for df in tables:
        for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            jvm = df.sparkSession._jvm
            path = jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def with_counts(rows: DataFrame, counts: DataFrame, keys: Sequence[str], salt: Column, total: int, n: str = "n", how: str = "inner", replicas: int = SALTS) -> DataFrame:
    """Join ``counts`` (one row a key, ``n``: rows of the key) to ``rows`` without gathering a hot key in one task.

    Rows of a hot key are dealt among ``replicas`` tasks by ``salt``, and its
    one row of ``counts`` is sent to each. There are at most 1 / HOT_SHARE hot
    keys, so their list is broadcast.
    """
    limit = max(1000, int(total * HOT_SHARE))
    hot = counts.filter(F.col(n) > limit).select(*keys, F.lit(True).alias("__hot"))
    salted = rows.join(F.broadcast(hot), list(keys), "left").withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(salt), F.lit(replicas))).otherwise(F.lit(0)).cast("long")).drop("__hot")
    each = F.when(F.col(n) > limit, F.sequence(F.lit(0).cast("long"), F.lit(replicas - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    many = counts.withColumn("__salt", F.explode(each))
    return salted.join(many, [*keys, "__salt"], how).drop("__salt")


def without(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs, all columns, whose id isn't in ``dropped`` (one column, distinct, a stored table).

    Rows without an id stay; they take no part in the join, as they would all
    be one task's. Both sides of a shuffled join are plain shuffles, so the
    rows of an id that repeats often can be split at run time.
    """
    key = F.col(id_col).cast("long")
    ids = dropped.toDF("__dropped")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_DROPPED else ids
    named = docs.filter(key.isNotNull()).join(ids, key == F.col("__dropped"), "left_anti")
    return named.unionByName(docs.filter(key.isNull()))


def sliced(batches: Iterable, column: int, most: int | None = None) -> Iterator:
    """The record batches in slices of bounded bytes (SLICE_BYTES by default) of text in the column of that number."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        part = (size - 1) // (most or SLICE_BYTES)
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield batch.slice(a, b - a)


def raw_texts(column) -> list[bytes]:
    """UTF-8 bytes of a text column of a record batch; null is empty."""
    import pyarrow as pa

    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer splits than there are cores, dealt among the cores; any other table as it stands, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs, as ``doc_id`` and ``text``; a null text is an empty one."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def groups(batches, keys: int):
    """(key, rows as one RecordBatch) for runs of equal values in the first ``keys`` columns of sorted batches."""
    import numpy as np
    import pyarrow as pa

    held: list = []
    last = None

    def whole():
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield last, whole()
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield last, whole()

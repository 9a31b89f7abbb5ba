"""Token ids as ORC files: stripes, integer run-length encoding, row indexes and Bloom filters on the document id.

``write_tokens`` encodes whole texts and writes ids as ``array<int>`` columns in
ascending document order; ORC stores them run-length encoded. ``read_tokens``
reads stripes in parallel and adds each document's global start;
``lookup_tokens`` prunes stripes and row groups by the index and the filter.

Defined cases: a null or empty text has only the end id; a null document id
sorts first; repeated ids stay separate rows, ordered among themselves by a
hash of the text; a text of any length is one row, encoded on its own where it
is longer than a chunk; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens

#: Files (16 bytes each) whose starts are broadcast at most.
BROADCAST_PARTS = 500_000
SCHEMA = "part int, row int, doc_id long, start_in_part long, n_tokens long, token_ids array<int>"


def write_tokens(
    docs: DataFrame,
    path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    end_id: int = 2,
    stripe_bytes: int = 16 << 20,
    row_index_stride: int = 1000,
    bloom_fpp: float = 0.01,
) -> None:
    """Write the ids of every whole text, each document closed by ``end_id``, in ascending id order.

    The one shuffle deals rows into ranges of the id (and of a hash of the text
    among equal or null ids), so each file holds one range and neither a hot
    source nor an id that repeats can gather in one task.
    """
    file = tokenizer or tokens.tokenizer_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, start = TaskContext.get().partitionId(), 0, 0
        enc = tokens.encoder(file)
        for batch in common.sliced(batches, 1):
            for lo, hi, ids, begins in enc.encode(common.raw_texts(batch.column(1)), end_id):
                lists = pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(ids.view("<i4")))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(hi - lo, part, dtype=np.int32)),
                        pa.array(np.arange(row, row + hi - lo, dtype=np.int32)),
                        batch.column(0).slice(lo, hi - lo),
                        pa.array(start + begins[:-1]),
                        pa.array(np.diff(begins)),
                        lists,
                    ],
                    names=["part", "row", "doc_id", "start_in_part", "n_tokens", "token_ids"],
                )
                row += hi - lo
                start += int(begins[-1])

    (
        common.id_and_text(docs, id_col, text_col)
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(F.col("doc_id").asc_nulls_first(), "tie")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
        .select("doc_id", "text")
        .mapInArrow(encode, SCHEMA)
        .write.option("orc.stripe.size", stripe_bytes)
        .option("orc.row.index.stride", row_index_stride)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", bloom_fpp)
        .option("orc.compress", "ZSTD")
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, token_ids.

    The totals of the parts come from two integer columns of the files; there
    are as many rows of them as files, so the window over them stays small.
    They are broadcast up to ``BROADCAST_PARTS`` files; beyond, it's a shuffled join.
    """
    files = spark.read.schema(SCHEMA).orc(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    starts = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("part_start"))
    if totals.count() <= BROADCAST_PARTS:
        starts = F.broadcast(starts)
    return files.join(starts, "part").select("doc_id", (F.col("part_start") + F.col("start_in_part")).alias("start"), "n_tokens", "token_ids")


def lookup_tokens(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of a few documents; the predicate reaches the ORC row indexes and Bloom filters."""
    return spark.read.schema(SCHEMA).orc(path).filter(F.col("doc_id").isin(doc_ids)).select("doc_id", "n_tokens", "token_ids")


def digest(read: DataFrame) -> DataFrame:
    """The crc32 of each document's ids as little-endian unsigned 32-bit integers."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            values = ids.values.to_numpy().astype("<i4", copy=False)
            offsets = ids.offsets.to_numpy()
            sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read.mapInArrow(crc, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.shared_folder(spark, "token-orc")
    write_tokens(common.table(spark, sf_dir, "documents"), path)
    return digest(read_tokens(spark, path))

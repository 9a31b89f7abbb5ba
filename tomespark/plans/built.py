"""Files made from the rows of a table, one for each key, in bounded memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tomespark.sources.corpus import Corpus, Made

#: Rows that are Python objects at once, and bytes of finished files that are sent together.
ROWS, BYTES = 100, 1 << 20
FILES = "file_key string, content binary"


def partitions(rows: DataFrame) -> int:
    """Tasks that make files: a set number, as few bytes make long work, and tasks joined by their bytes would be too few."""
    spark = rows.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def built(rows: DataFrame, order: str, build: Callable[[list[tuple]], bytes]) -> DataFrame:
    """file_key and content: ``build`` of the rows of each ``file_key`` (the first column) in order."""
    placed, run = making(rows, order, build)
    return placed.mapInArrow(run, FILES)


def corpus_of(rows: DataFrame, order: str, build: Callable[[list[tuple]], bytes]) -> Corpus:
    """The same files as a corpus; a store takes them where they are made."""
    placed, run = making(rows, order, build)
    return Corpus(rows.sparkSession, placed.mapInArrow(run, FILES), placed=partitions(rows), made=(placed, run))


def making(rows: DataFrame, order: str, build: Callable[[list[tuple]], bytes]) -> Made:
    """The rows where their files are made, and what makes record batches of files of theirs."""
    placed = rows.repartition(partitions(rows), "file_key").sortWithinPartitions("file_key", order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, files, own, last = [], [], [], None

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(files, pa.binary())], ["file_key", "content"])

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                for row in zip(*(c.to_pylist() for c in batch.slice(at, ROWS).columns)):
                    if own and row[0] != last:
                        keys.append(last)
                        files.append(build(own))
                        own = []
                        if len(files) * len(files[-1]) >= BYTES:
                            yield sent()
                            keys, files = [], []
                    last = row[0]
                    own.append(row)
        if own:
            keys.append(last)
            files.append(build(own))
        if keys:
            yield sent()

    return placed, run

"""Every table of a collection from one decoding: a bucketed table with a manifest.

save() decodes each file once. A row of the store belongs to one table (the
partition column ``part_of``) and holds its values in the struct of that name,
so reading a table reads that partition and those columns only. Rows are
bucketed by ``file_key``: joins of stored tables on it need no exchange (nor do
joins on more columns, where the session's requireAllClusterKeysForCoPartition
is off). The
manifest, written last, names the tables and their rows; a store without one is
one whose writing didn't end, and isn't opened.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Collection, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomespark.operators import tables

from .container import BadFile, HelpFile
from .corpus import TABLES, Corpus, columns_of, rows_of, split

BATCH_ROWS = 500
#: Columns of page_ops that Corpus.links reads.
LINKS = ("page_idx", "seq", "op", "kind", "target", "file", "text")


class StoredCorpus(Corpus):
    """A corpus whose tables are read from a store; close() deletes it."""

    def __init__(self, spark: SparkSession, name: str, path: str, manifest: dict) -> None:
        self.spark, self.name, self.path, self.manifest = spark, name, path, manifest
        self.font_stride = manifest["font_stride"]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in TABLES:
            raise AttributeError(name)
        if name not in self.manifest["rows"]:
            raise ValueError(f"the store holds only {', '.join(self.manifest['rows'])}")
        return self.spark.table(self.name).filter(F.col("part_of") == name).select("file_key", f"{name}.*")

    def table(self, name: str, columns: Collection[str] | None = None, ops: Collection[str] | None = None) -> DataFrame:
        held = getattr(self, name)
        held = held if ops is None else held.filter(F.col("op").isin(*ops))
        return held if columns is None else held.select("file_key", *(c for c in held.columns if c in columns))

    @property
    def errors(self) -> DataFrame:
        return self.spark.table(self.name).filter("part_of = 'errors'").select("file_key", F.col("errors.message").alias("message"))

    def close(self) -> None:
        """Delete the store's files and its name."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        tables.deleted(self.spark, self.path)


def save(corpus: Corpus, path: str | None = None, names: Collection[str] | dict[str, Collection[str] | None] | None = None, buckets: int | None = None, ops: Collection[str] | None = None) -> StoredCorpus:
    """Decode every file of a corpus once and store its tables (all, or those named) under ``path``.

    ``names``: tables, or tables with the columns that are kept (None: all).
    ``ops``: the operations of pages that are kept, all by default. ``path``: in the shared folder by default. ``buckets``: tasks of later joins,
    spark.sql.shuffle.partitions by default.
    """
    spark, stride = corpus.spark, corpus.font_stride
    chosen = dict(names) if isinstance(names, dict) else dict.fromkeys(names or TABLES)
    names = list(chosen)
    buckets = buckets or corpus.placed or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = path or tables.shared_folder(spark, "help-store")
    columns = ", ".join(f"{n} struct<{', '.join(_field(c) for c in columns_of(n, chosen[n]))}>" for n in names)
    schema = spark.createDataFrame([], f"file_key string, part_of string, errors struct<message:string>, {columns}").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        of = {name: rows_of(name, ops if name == "page_ops" else None) for name in names}
        held: dict[str, tuple[list[str], list[dict]]] = {name: ([], []) for name in ("errors", *names)}

        def sent(part: str) -> pa.RecordBatch:
            """The rows that are held of a table; the other tables' columns are null."""
            keys, rows = held[part]
            own = {"file_key": lambda kind: pa.array(keys, kind), "part_of": lambda kind: pa.array([part] * len(keys), kind), part: lambda kind: pa.array(rows, kind)}
            columns = [own[f.name](f.type) if f.name in own else pa.nulls(len(keys), f.type) for f in arrow]
            held[part] = [], []
            return pa.RecordBatch.from_arrays(columns, schema=arrow)

        def rows(content: bytes) -> Iterator[tuple[str, dict]]:
            try:
                file = HelpFile(content, stride)
            except BadFile as e:
                yield "errors", {"message": str(e)}
                return
            try:
                file.blocks  # noqa: B018  as in the table of errors
            except BadFile as e:
                yield "errors", {"message": str(e)}
            for name in names:
                try:
                    for row in of[name](file):
                        yield name, row
                except BadFile:
                    pass  # the rows before the fault stay, as in a table that is decoded alone

        for batch in batches:
            for key, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                for part, row in rows(content.as_py() or b""):
                    keys, own = held[part]
                    keys.append(key)
                    own.append(row)
                    if len(own) == BATCH_ROWS:
                        yield sent(part)
        for part, (keys, _) in list(held.items()):
            if keys:
                yield sent(part)

    # Files are placed by bucket before they are decoded, so what moves is their packed bytes; those that are made
    # there are decoded by the worker that makes them, some at a time.
    if corpus.made and corpus.placed == buckets:
        placed, make = corpus.made
        decoded = placed.mapInArrow(lambda batches: run(make(batches)), schema)
    else:
        placed = corpus.files.select("file_key", "content")
        placed = placed if corpus.placed == buckets else placed.repartition(buckets, "file_key")
        decoded = placed.mapInArrow(run, schema)
    name = f"help_store_{uuid.uuid4().hex}"
    decoded.write.partitionBy("part_of").bucketBy(buckets, "file_key").option("path", f"{path}/rows").format("parquet").saveAsTable(name)
    counted = {r["part_of"]: r["n"] for r in spark.table(name).groupBy("part_of").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a table
    manifest = {"rows": {n: counted.get(n, 0) for n in names}, "errors": counted.get("errors", 0), "buckets": buckets, "font_stride": stride, "schema": schema.simpleString()}
    spark.createDataFrame([(json.dumps(manifest),)], "manifest string").coalesce(1).write.json(f"{path}/manifest")
    return StoredCorpus(spark, name, path, manifest)


def load(spark: SparkSession, path: str) -> StoredCorpus:
    """A store that save() has written, also by another session."""
    manifest = json.loads(spark.read.schema("manifest string").json(f"{path}/manifest").first()["manifest"])
    name = f"help_store_{uuid.uuid4().hex}"
    columns = manifest["schema"].removeprefix("struct<").removesuffix(">")
    ddl = ", ".join(c.replace(":", " ", 1) for c in split(columns))
    spark.sql(f"CREATE TABLE {name} ({ddl}) USING parquet OPTIONS (path '{path}/rows') PARTITIONED BY (part_of) CLUSTERED BY (file_key) INTO {manifest['buckets']} BUCKETS")
    spark.sql(f"MSCK REPAIR TABLE {name}")
    return StoredCorpus(spark, name, path, manifest)


def _field(column: str) -> str:
    name, kind = column.split(" ", 1)
    return f"{name}: {kind}"

"""New help files of a folder as they arrive: the corpus tables over Spark's streaming file source."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tomespark.functions import native
from tomespark.sources.corpus import Corpus

FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_corpus(spark: SparkSession, path: str, files_per_trigger: int = 1000, font_stride: int = 34) -> Corpus:
    """A corpus whose tables are streaming DataFrames; each file is read once, in micro-batches of bounded size."""
    read = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.[hH][lL][pP]").option("maxFilesPerTrigger", files_per_trigger).load(path)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return Corpus(spark, read.select(native.file_key(native.decoded(name)).alias("file_key"), "length", "content"), font_stride)

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tomespark.llm import common, components


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_keys_are_dealt_and_joined_once(spark, how):
    rows = spark.range(0, 6000).select(F.when(F.col("id") < 5000, 7).otherwise(F.col("id")).cast("long").alias("k"), F.col("id").alias("v")).repartition(3)
    counts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("most")).filter("k % 2 = 1")
    got = common.with_counts(rows, counts, ["k"], F.col("v"), 6000, how=how)
    want = rows.join(counts, ["k"], how)
    key = lambda r: (r["v"], r["n"], r["most"])
    assert sorted(map(key, got.select("k", "v", "n", "most").collect()), key=str) == sorted(map(key, want.collect()), key=str)
    assert "__salt" not in got.columns
    # the hot key's rows lie in many partitions
    places = got.filter("k = 7").select(F.spark_partition_id().alias("p")).distinct().count()
    assert places > 1 or spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled") == "true"


def test_a_star_with_a_hot_centre(spark):
    edges = spark.range(1, 4000).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b")).unionByName(spark.range(5000, 5010).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    got = {r["id"]: r["label"] for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(4000)} | {i: 5000 for i in range(5000, 5011)}


def test_slices_cover_the_batch_and_are_bounded(monkeypatch):
    monkeypatch.setattr(common, "SLICE_BYTES", 10)
    texts = ["abcd", None, "é", "x" * 50, "", "ab", "cdefgh", "ij"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], names=["i", "t"])
    parts = list(common.sliced([batch, batch.slice(0, 0)], 1))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(8))
    assert len(parts) > 2 and common.raw_texts(batch.column(1)) == [(t or "").encode() for t in texts]


def test_written_tables_can_be_released(spark):
    table = common.written(spark.range(10), "t")
    folder = table.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    assert os.path.isdir(folder)
    common.released(table)
    assert not os.path.exists(folder)


def test_only_local_mode_has_a_folder_of_its_own(spark):
    class Context:
        master = "spark://somewhere"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError):
        common.shared_folder(Session(), "t")


@pytest.mark.parametrize("most", [0, 10])
def test_rows_without_an_id_stay(spark, monkeypatch, most):
    monkeypatch.setattr(common, "BROADCAST_DROPPED", most)
    docs = spark.createDataFrame([(1, "a", 5), (1, "b", 6), (2, "c", 7), (None, "d", 8), (None, "d", 8)], "doc_id long, text string, __hit long")
    dropped = common.written(spark.createDataFrame([(1,), (9,)], "doc_id long"), "dropped")
    got = common.without(docs, dropped)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(2, "c", 7), (None, "d", 8), (None, "d", 8)], key=str)
    assert common.without(docs, dropped.limit(0)).count() == 5
    assert common.without(docs.limit(0), dropped).count() == 0

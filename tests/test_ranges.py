"""Running results over ranges equal those over one window a key, and a hot key is shared by many tasks."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tomespark.operators import lookups, ranges


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    data = []
    for i in range(3000):
        key = None if i % 50 == 0 else ("hot" if i % 3 == 0 else f"k{rng.randint(0, 40)}")
        data.append((key, i % 7, i, rng.choice([None, rng.randint(-5, 9)]), rng.choice([None, None, None, f"v{i}"])))
    return spark.createDataFrame(data, "k string, g int, at long, n long, v string").repartition(5)


@pytest.mark.parametrize("count", [1, 2, 17])
@pytest.mark.parametrize("by", [[], ["k"], ["k", "g"]])
def test_scan_equals_one_window(rows, by, count):
    got = ranges.scan(rows, by, ["at"], {"total": ("sum", F.col("n")), "held": ("last", F.col("v"))}, count)
    along = Window.partitionBy(*by).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    want = rows.withColumn("total", F.coalesce(F.sum("n").over(along), F.lit(0))).withColumn("held", F.last("v", ignorenulls=True).over(along))
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_a_hot_key_lies_in_many_ranges(rows):
    cut = rows.select(F.struct("k").alias("key"), "at").repartitionByRange(16, "key", "at").withColumn("r", F.spark_partition_id())
    sizes = {r["r"]: r["n"] for r in cut.groupBy("r").agg(F.count(F.lit(1)).alias("n")).collect()}
    of_hot = cut.filter("key.k = 'hot'").select("r").distinct().count()
    assert of_hot >= 5 and max(sizes.values()) < 3 * 3000 / 16


@pytest.mark.parametrize("count", [1, 13])
def test_floor_lookup_equals_the_window_of_a_key(spark, rows, count):
    pages = rows.filter("at % 5 = 0").select("k", F.col("at").alias("start"), "g", "n")
    pages = pages.unionByName(pages.withColumn("g", F.col("g") + 10))  # ties that g decides
    asked = rows.select("k", "at", F.col("v").alias("start")).unionByName(spark.createDataFrame([("none", 5, "x"), ("hot", -1, "y"), ("hot", None, "z")], "k string, at long, start string"))
    value = F.struct("start", "g", "n")
    got = ranges.floor_lookup(asked, pages, ["k"], "at", "start", ["g"], value, "page", count)
    want = lookups.floor_lookup(asked, pages, ["k"], "at", "start", [F.col("g")], value, "page")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_offsets_pages_and_positions(rows):
    off = ranges.running_offset(rows, ["k"], ["at"], "n", "off", 9)
    assert sorted(map(tuple, off.collect()), key=str) == sorted(map(tuple, lookups.running_offset(rows, ["k"], ["at"], "n", "off").collect()), key=str)
    page = ranges.page_numbers(rows, ["k"], ["at"], F.col("g") == 3, ranges=9)
    assert sorted(map(tuple, page.collect()), key=str) == sorted(map(tuple, lookups.page_numbers(rows, ["k"], ["at"], F.col("g") == 3).collect()), key=str)
    place = ranges.ranked(rows, ["k"], ["g", "at"], "place", 9)
    assert sorted(map(tuple, place.collect()), key=str) == sorted(map(tuple, lookups.ranked(rows, ["k"], ["g", "at"], "place").collect()), key=str)


def test_values_that_are_null_count_as_values(spark):
    pages = spark.createDataFrame([("a", 1, "x"), ("a", 5, None)], "k string, s long, v string")
    asked = spark.createDataFrame([("a", 3), ("a", 9)], "k string, at long")
    assert {r["at"]: r["v"] for r in ranges.floor_lookup(asked, pages, ["k"], "at", "s", ["s"], F.col("v"), "v", 3).collect()} == {3: "x", 9: None}


def test_empty(rows):
    assert ranges.ranked(rows.limit(0), ["k"], ["at"], "place", 4).count() == 0

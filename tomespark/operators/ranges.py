"""Running results along a key's order without giving a key to one task.

Rows are cut into ranges of about equal size by (key, order), so a key with a
third of all rows lies in a third of the ranges. A range runs over its own rows;
what the ranges before it hold of its first key comes from a small table with
one row a range: the result over the last key of each range, scanned along the
ranges of that key. The table has as many rows as there are ranges (at most
MOST_RANGES), so it is broadcast.

Rows of one key and order value share a range. Nulls in a key are a key of their
own; null order values come first; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import written

MOST_RANGES = 20_000


def _run(kind: str, column: str, window) -> Column:
    return F.last(column, ignorenulls=True).over(window) if kind == "last" else F.coalesce(F.sum(column).over(window), F.lit(0))


def scan(rows: DataFrame, by: list[str], order: list[str], results: dict[str, tuple[str, Column]], ranges: int | None = None) -> DataFrame:
    """``rows`` with running results up to and with each row, in the order of each key.

    results: name -> ("sum", number) or ("last", value): the sum so far, or the
    last value so far that isn't null. Of rows with equal order values any may
    come first; give an order without ties where that matters. ``ranges``: how
    many tasks share the work, spark.sql.shuffle.partitions by default.
    """
    spark = rows.sparkSession
    ranges = min(MOST_RANGES, ranges or int(spark.conf.get("spark.sql.shuffle.partitions")))
    key = F.struct(*by) if by else F.struct(F.lit(0))
    parts = {f"__v_{name}": value for name, (_, value) in results.items()}
    kinds = {name: kind for name, (kind, _) in results.items()}
    placed = rows.select("*", key.alias("__key"), *(v.alias(n) for n, v in parts.items()))
    # The cut depends on a sample that differs between runs, so it is written before it is read twice.
    cut = written(placed.repartitionByRange(ranges, "__key", *order).withColumn("__range", F.spark_partition_id()), "ranges")

    ends = cut.groupBy("__range").agg(F.min("__key").alias("__first"), F.max("__key").alias("__last"))
    of_last = cut.join(F.broadcast(ends), "__range").filter(F.col("__key").eqNullSafe(F.col("__last")))
    total = lambda name, kind: F.sum(f"__v_{name}").alias(f"__c_{name}") if kind == "sum" else F.max_by(f"__v_{name}", F.when(F.col(f"__v_{name}").isNotNull(), F.struct(*order))).alias(f"__c_{name}")
    sums = of_last.groupBy("__range", F.col("__last").alias("__key")).agg(*(total(n, k) for n, k in kinds.items()))
    # One row a range asks for what came before its first key's rows; it stands before the row of the range's own last key.
    asking = ends.select("__range", F.col("__first").alias("__key"), F.lit(0).alias("__side"))
    along = Window.partitionBy("__key").orderBy("__range", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = asking.unionByName(sums.withColumn("__side", F.lit(1)), allowMissingColumns=True)
    carried = both.select("__range", "__side", F.col("__key").alias("__first"), *(_run(k, f"__c_{n}", along).alias(f"__c_{n}") for n, k in kinds.items())).filter("__side = 0").drop("__side")

    inside = Window.partitionBy("__range", "__key").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = cut.select("*", *(_run(k, f"__v_{n}", inside).alias(f"__r_{n}") for n, k in kinds.items())).join(F.broadcast(carried), "__range", "left")
    early = F.col("__key").eqNullSafe(F.col("__first"))

    def with_carry(name: str, kind: str) -> Column:
        own, before = F.col(f"__r_{name}"), F.when(early, F.col(f"__c_{name}"))
        return (F.coalesce(own, before) if kind == "last" else own + F.coalesce(before, F.lit(0))).alias(name)

    return run.select(*(F.col(c) for c in rows.columns), *(with_carry(n, k) for n, k in kinds.items()))


def floor_lookup(asked: DataFrame, rows: DataFrame, on: list[str], at: str, row_at: str, order: list[str], value: Column, out: str, ranges: int | None = None) -> DataFrame:
    """The value of the last row of the key at or below each asked place; of rows at one place the one that ``order`` puts last."""
    kind = asked.select(F.struct(*asked.columns).alias("r")).schema["r"].dataType
    blank = [F.lit(None).cast(rows.schema[c].dataType).alias(f"__o{i}") for i, c in enumerate(order)]
    left = asked.select(*on, F.col(at).alias("__at"), F.lit(1).alias("__side"), *blank, F.lit(None).alias("__value"), F.struct(*asked.columns).alias("__row"))
    right = rows.select(*on, F.col(row_at).alias("__at"), F.lit(0).alias("__side"), *(F.col(c).alias(f"__o{i}") for i, c in enumerate(order)), F.struct(value.alias("v")).alias("__value"), F.lit(None).cast(kind).alias("__row"))
    both = right.filter(F.col("__at").isNotNull()).unionByName(left)
    found = scan(both, on, ["__at", "__side", *(f"__o{i}" for i in range(len(order)))], {"__found": ("last", F.col("__value"))}, ranges)
    return found.filter("__side = 1").select("__row.*", F.col("__found.v").alias(out))


def running_offset(rows: DataFrame, by: list[str], order: list[str], length: str, out: str, ranges: int | None = None) -> DataFrame:
    """The sum of the lengths of all earlier rows of the key."""
    own = F.coalesce(F.col(length).cast("long"), F.lit(0))
    return scan(rows, by, order, {out: ("sum", own)}, ranges).withColumn(out, F.col(out) - own)


def page_numbers(rows: DataFrame, by: list[str], order: list[str], starts_page: Column, out: str = "page_no", ranges: int | None = None) -> DataFrame:
    """How many rows that start a page stand at or before each row."""
    return scan(rows, by, order, {out: ("sum", F.when(starts_page, 1).otherwise(0).cast("long"))}, ranges)


def ranked(rows: DataFrame, by: list[str], order: list[str], out: str, ranges: int | None = None) -> DataFrame:
    """Rows with their place within their key, from 1."""
    return scan(rows, by, order, {out: ("sum", F.lit(1).cast("long"))}, ranges)

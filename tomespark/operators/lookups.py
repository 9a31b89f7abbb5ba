"""Navigation lookups, set at a time: every function takes tables of many files and answers all rows at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resolve_hash(asked: DataFrame, context: DataFrame, on: list[str], keep_raw: bool = False, hash_col: str = "hash", offset_col: str = "topic_offset") -> DataFrame:
    """Adds the topic offset of each hash; a miss is null, or with ``keep_raw`` the hash itself."""
    keys = [*on, hash_col]
    found = asked.join(context.select(*keys, offset_col), keys, "left")
    return found.withColumn(offset_col, F.coalesce(offset_col, F.col(hash_col))) if keep_raw else found


def floor_lookup(asked: DataFrame, rows: DataFrame, on: list[str], at: str, row_at: str, order: list[Column], value: Column, out: str) -> DataFrame:
    """The value of the last row at or below each asked place, by a union and one window per key: no range join.

    ``order`` breaks ties between rows at the same place; the window sees rows
    of one key in order and holds only the last value. All rows of a key are one
    task's, which suits files; keys that can hold a large share of all rows
    should be made finer.
    """
    keys = [F.col(k) for k in on]
    n = len(order)
    blank = [F.lit(None).cast("long").alias(f"__o{i}") for i in range(n)]
    left = asked.select(*keys, F.col(at).alias("__at"), F.lit(1).alias("__side"), *blank, F.lit(None).alias("__value"), F.struct(*asked.columns).alias("__row"))
    kind = asked.select(F.struct(*asked.columns).alias("r")).schema["r"].dataType
    right = rows.select(*keys, F.col(row_at).alias("__at"), F.lit(0).alias("__side"), *(o.cast("long").alias(f"__o{i}") for i, o in enumerate(order)), value.alias("__value"), F.lit(None).cast(kind).alias("__row"))
    window = Window.partitionBy(*on).orderBy("__at", "__side", *(f"__o{i}" for i in range(n))).rowsBetween(Window.unboundedPreceding, 0)
    both = right.unionByName(left).withColumn(out, F.last("__value", ignorenulls=True).over(window))
    return both.filter("__side = 1").select("__row.*", out)


def keyword_offsets(asked: DataFrame, keywords: DataFrame, on: list[str], place: list[str], most: int = 64) -> DataFrame:
    """Up to ``most`` rows of each keyword in stored order; the cut is what the lookup does, and its default."""
    ranked = keywords.withColumn("__n", F.row_number().over(Window.partitionBy(*on).orderBy(*place)))
    # compared as it is, so that the optimizer limits each task's rows of a keyword before they are shuffled
    return asked.join(ranked.filter(F.col("__n") <= most).withColumn("off_seq", F.col("__n") - 1).drop("__n"), on)


def keyword_target(counted: DataFrame, n: str, only: str, *fallbacks: str) -> Column:
    """The single offset of a keyword; the fallbacks where it has none; null where it has several."""
    return F.when(F.col(n) == 1, F.col(only)).when(F.col(n) == 0, F.coalesce(*(F.col(f) for f in fallbacks)))


def first_of(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("__n = 1").drop("__n")


def not_covered(rows: DataFrame, covered: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(covered.select(*on).distinct(), on, "left_anti")


def index_entries(keywords: DataFrame, topics: DataFrame, on: list[str], most: int = 64) -> DataFrame:
    """The index of each file: keywords with their offsets, and titles of topics that no keyword's offset covers.

    keywords: on..., keyword, kw_seq, off_seq, topic_offset. topics: on...,
    page_idx, topic_offset, title. Only the first ``most`` offsets of a keyword
    count; of titles at one offset the first page's stays.
    """
    used = keywords.filter(F.col("off_seq") < most)
    by_keyword = used.groupBy(*on, F.col("keyword").alias("text"), "kw_seq").agg(F.count(F.lit(1)).alias("n_offsets"), F.min_by("topic_offset", "off_seq").alias("first_offset"))
    open_titles = not_covered(topics.filter("title <> ''"), used, [*on, "topic_offset"])
    titles = first_of(open_titles, [*on, "topic_offset"], ["page_idx"])
    return (
        by_keyword.select(*on, F.lit("keyword").alias("source"), "text", F.col("kw_seq").cast("long").alias("seq"), "n_offsets", "first_offset")
        .unionByName(titles.select(*on, F.lit("title").alias("source"), F.col("title").alias("text"), F.col("page_idx").cast("long").alias("seq"), F.lit(1).cast("long").alias("n_offsets"), F.col("topic_offset").alias("first_offset")))
        .withColumn("sort_key", F.lower("text"))
    )


def index_filter(entries: DataFrame, query: str, column: str = "text") -> DataFrame:
    """Entries whose text holds the query, whatever the case."""
    return entries.filter(F.contains(F.lower(column), F.lit(query.lower())))


def running_offset(rows: DataFrame, by: list[str], order: list[str], length: str, out: str) -> DataFrame:
    """The sum of the lengths of all earlier rows of the key."""
    window = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(out, F.coalesce(F.sum(F.col(length).cast("long")).over(window), F.lit(0)))


def page_numbers(rows: DataFrame, by: list[str], order: list[str], starts_page: Column, out: str = "page_no") -> DataFrame:
    """How many rows that start a page stand at or before each row."""
    window = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.sum(F.when(starts_page, 1).otherwise(0)).over(window))


def anchor(asked: DataFrame, paragraphs: DataFrame, on: list[str], at: str, para_at: str, out: str = "anchor") -> DataFrame:
    """The paragraph of each key that an offset means: the one at it, else the last one below it, else the key's first.

    An exact one is the last one at or below, too, and the first one stands below all offsets once more, so one floor
    lookup gives all three.
    """
    first = paragraphs.groupBy(*on).agg(F.min(para_at).alias("__para")).withColumn("__place", F.lit(None).cast("long"))
    places = paragraphs.select(*on, F.col(para_at).alias("__para"), F.col(para_at).cast("long").alias("__place"))
    return floor_lookup(asked, places.unionByName(first), on, at, "__place", [F.col("__para")], F.col("__para"), out)


def topic_titles(asked: DataFrame, pages: DataFrame, on: list[str], at: str = "topic_offset", out: str = "title") -> DataFrame:
    """The title of the page at or below each offset; "Topic at N" where there is no page or it has no title."""
    found = floor_lookup(asked, pages, on, at, "topic_offset", [F.col("page_idx")], F.coalesce(F.col("title"), F.lit("")), out)
    return found.withColumn(out, F.when(F.coalesce(F.col(out), F.lit("")) != "", F.col(out)).otherwise(F.concat(F.lit("Topic at "), F.col(at).cast("string"))))


def region(ref: Column, scroll_ref: Column) -> Column:
    """Whether a record lies in a page's fixed part, before the reference where it starts to scroll, or in the rest."""
    return F.when(ref < scroll_ref, "fixed").otherwise("scrolling")


def browse_neighbours(rows: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """``rows`` with the values of the neighbours one place before and after, null where the chain breaks."""
    before = rows.select(*by, (F.col(at) + 1).alias(at), F.col(value).alias(f"prev_{value}"))
    after = rows.select(*by, (F.col(at) - 1).alias(at), F.col(value).alias(f"next_{value}"))
    return rows.join(before, [*by, at], "left").join(after, [*by, at], "left")


def offsets_of(rows: DataFrame, by: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """The values of each key in stored order, as an array."""
    held = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("__value"))))
    return rows.groupBy(*by).agg(held.alias("__held")).select(*by, F.transform("__held", lambda x: x["__value"]).alias(out))


def sizes(rows: DataFrame, by: list[str], distinct: str) -> DataFrame:
    """Rows and distinct values of each key."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(distinct).alias(f"n_{distinct}"))


def index_order(entries: DataFrame, on: list[str]) -> DataFrame:
    """Entries with their position in their file's index: by sort key, keywords before titles, each in stored order."""
    return ranked(entries, on, ["sort_key", "source", "seq"], "position")


def ranked(rows: DataFrame, by: list[str], order: list[str], out: str) -> DataFrame:
    """Rows with their place within their key, from 1."""
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))

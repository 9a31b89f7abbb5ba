"""Chains of pointers as sequences, by contraction and then by pointer doubling.

Doubling alone rewrites every open row in every round, some twenty times for
chains of a million links. So rows are first taken out of their chains: in a
round a row with coin 0 that points to a row with coin 1 leaves (a quarter of
them, no two in a row), and rows that point to it take over its pointer. What is
left falls by a quarter a round, so all rounds together move a few times the
rows, whatever the length of the chains. Once few are left, doubling ends them,
and rows that left get their results back from the row they pointed to, in the
opposite order. A coin is a hash of row and round.

A round is one join, and its results are written tables, deleted once they are
used. A row that is still open when pointers reach further than there are rows
lies on a cycle or leads into one.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import deleted, shared_folder

#: Rows that doubling starts from; it moves them some twenty times.
FEW_ROWS, MOST_ROUNDS = 200_000, 40


def follow(rows: DataFrame, node: str, pointer: str, end: str = "head", steps: str = "position", cyclic: str = "is_cyclic") -> DataFrame:
    """``node`` with the row at which its pointers end, how many steps away that is, and whether they never end.

    Nodes are unique and not null. A pointer that is null, or to a node that
    isn't there, ends the chain. Rows that never end have null ``end`` and ``steps``.
    """
    spark = rows.sparkSession
    there = rows.select(F.col(node).alias("__there"))
    first = rows.select(F.col(node).alias("node"), F.col(pointer).alias("to")).join(there, F.col("to") == F.col("__there"), "left")
    first = first.select("node", F.col("__there").alias("to"), F.when(F.col("__there").isNull(), 0).otherwise(1).cast("long").alias("steps"))

    def kept(df: DataFrame) -> tuple[DataFrame, str]:
        path = shared_folder(spark, "chain-round")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), path

    def coin(column: str, number: int) -> Column:
        return F.pmod(F.xxhash64(F.col(column), F.lit(number)), F.lit(2))

    state, path = kept(first)  # node, to (null: the end of a chain), steps
    left: list[tuple[DataFrame, str]] = []
    n = state.count()
    while n > FEW_ROWS and len(left) < MOST_ROUNDS:
        number = len(left)
        leaves = F.col("to").isNotNull() & (coin("node", number) == 0) & (coin("to", number) == 1)
        gone, gone_path = kept(state.filter(leaves))
        stay = state.filter(~leaves)
        asking = F.col("to").isNotNull() & (coin("to", number) == 0)  # only these may point to a row that left
        over = gone.select(F.col("node").alias("to"), F.col("to").alias("__to"), F.col("steps").alias("__steps"))
        moved = stay.filter(asking).join(over, "to", "left").select("node", F.coalesce("__to", "to").alias("to"), (F.col("steps") + F.coalesce("__steps", F.lit(0))).alias("steps"))
        before = path
        state, path = kept(stay.filter(~asking).unionByName(moved))
        deleted(spark, before)
        left.append((gone, gone_path))
        n = state.count()

    before = path
    state, path = kept(state.select("node", "to", F.when(F.col("to").isNull(), F.col("node")).alias("end"), "steps"))
    deleted(spark, before)
    for _ in range(ceil(log2(max(2, n))) + 1):
        open_ = state.filter(F.col("end").isNull())
        if open_.isEmpty():
            break
        at = state.select(F.col("node").alias("to"), F.col("to").alias("__to"), F.col("end").alias("__end"), F.col("steps").alias("__steps"))
        moved = open_.select("node", "to", "steps").join(at, "to").select("node", F.col("__to").alias("to"), F.col("__end").alias("end"), (F.col("steps") + F.col("__steps")).alias("steps"))
        before = path
        state, path = kept(state.filter(F.col("end").isNotNull()).unionByName(moved))
        deleted(spark, before)

    # Rows that left in a round point to rows whose results are known by then; each table is written once.
    done = [(state.select("node", "end", F.when(F.col("end").isNotNull(), F.col("steps")).alias("steps")), path)]
    for gone, gone_path in reversed(left):
        known = done[0][0]
        for more, _ in done[1:]:
            known = known.unionByName(more)
        of_to = known.select(F.col("node").alias("to"), "end", F.col("steps").alias("__steps"))
        done.append(kept(gone.join(of_to, "to").select("node", "end", (F.col("steps") + F.col("__steps")).alias("steps"))))
        deleted(spark, gone_path)
    found = done[0][0]
    for more, _ in done[1:]:
        found = found.unionByName(more)
    return found.select(F.col("node").alias(node), F.col("end").alias(end), F.col("steps").alias(steps), F.col("end").isNull().alias(cyclic))

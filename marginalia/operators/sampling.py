"""Samples that give every group its turn, and keyset pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def round_robin(rows: DataFrame, group: str, newest: Column, key: str, n: int) -> DataFrame:
    """The first ``n`` rows when groups take turns, the larger group first in each turn, each with its newest rows first."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("of_group"))
    turn = F.row_number().over(Window.partitionBy(group).orderBy(newest.desc(), F.col(key)))
    turns = rows.withColumn("turn", turn).where(F.col("turn") <= n)  # a rank beyond n is never needed, so it is cut off before rows are exchanged
    return turns.join(sizes, group).orderBy("turn", F.desc("of_group"), group, key).limit(n)


def nearest_ranks(rows: DataFrame, group: str, value: str, at: dict[str, float], parts: int = 64) -> DataFrame:
    """(group and a column for each of ``at``): the ceil(p * n)-th smallest of each group's n values; null for none.

    Values are counted first. Counts are summed by ``parts`` ranges of each group's values, which a bounded sketch
    cuts, and then inside the ranges, so no task orders a whole group.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("_c"))
    cuts = counts.groupBy(group).agg(F.percentile_approx(value, [i / parts for i in range(1, parts)], 1000).alias("_cuts"))
    held = counts.join(cuts, group).withColumn("_part", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    by_part = held.groupBy(group, "_part").agg(F.sum("_c").alias("_p"))
    every = Window.partitionBy(group)
    before = F.coalesce(F.sum("_p").over(every.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by_part = by_part.select(group, "_part", before.alias("_before"), F.sum("_p").over(every).alias("_n"))  # ``parts`` rows a group
    upto = F.sum("_c").over(Window.partitionBy(group, "_part").orderBy(value)) + F.col("_before")
    ranked = held.join(by_part, [group, "_part"]).withColumn("_upto", upto)
    found = [F.min(F.when(F.col("_upto") >= F.ceil(F.col("_n") * p), F.col(value))).alias(name) for name, p in at.items()]
    return rows.select(group).distinct().join(ranked.groupBy(group).agg(*found), group, "left")


def page_after(rows: DataFrame, clock: str, key: str, since: object, since_key: object, n: int) -> DataFrame:
    """The next ``n`` rows by (clock, key) after the cursor, and one more as evidence that there are more."""
    after = (F.col(clock) > F.lit(since)) | ((F.col(clock) == F.lit(since)) & (F.col(key) > F.lit(since_key)))
    return rows.where(after).orderBy(clock, key).limit(n + 1)

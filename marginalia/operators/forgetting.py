"""Forgetting: one table of what refers to what, from which both the preview and the effect follow."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F


@dataclass(frozen=True)
class Reference:
    """A column of a table that names what is forgotten: its rows go, or with ``keep`` stay without the name."""

    table: str
    column: str
    keep: bool = False


def preview(tables: dict[str, DataFrame], gone: DataFrame, rules: list[Reference]) -> DataFrame:
    """(table, rows): how many rows of each table forgetting ``gone`` (id) changes."""
    ids = gone.select(F.col("id").alias("_id")).where("_id is not null").distinct()
    counts = [tables[r.table].join(ids, F.col(r.column) == F.col("_id"), "left_semi").agg(F.count("*").alias("rows")).select(F.lit(r.table).alias("table"), "rows") for r in rules]
    return reduce(DataFrame.union, counts)


def forgotten(tables: dict[str, DataFrame], gone: DataFrame, rules: list[Reference]) -> dict[str, DataFrame]:
    """The tables after it, all made from the same ids; a second time changes nothing. Tables without a rule stay as they are."""
    ids = gone.select(F.col("id").alias("_id")).where("_id is not null").distinct()
    after = dict(tables)
    for r in rules:
        rows = after[r.table]
        if r.keep:
            marked = rows.join(ids, F.col(r.column) == F.col("_id"), "left")
            after[r.table] = marked.withColumn(r.column, F.when(F.col("_id").isNull(), F.col(r.column))).select(*rows.columns)
        else:
            after[r.table] = rows.join(ids, F.col(r.column) == F.col("_id"), "left_anti")
    return after


def unknown(known: DataFrame, key: str, asked: DataFrame) -> DataFrame:
    """(id): asked for but not there. Any such id refuses the whole set, before anything changes."""
    return asked.select("id").distinct().join(known.select(F.col(key).alias("id")), "id", "left_anti")


def cluster(heads: DataFrame, named: DataFrame) -> DataFrame:
    """(id): all entities of the clusters that ``named`` (id) belong to now, and the old heads that registrations may still name.

    ``heads`` has entity and head; an id that isn't an entity any more stands for itself.
    """
    now = named.select(F.col("id").alias("entity")).join(heads, "entity", "left").select(F.coalesce("head", "entity").alias("head")).distinct()
    return heads.join(now, "head", "left_semi").select(F.col("entity").alias("id")).union(now.select(F.col("head").alias("id"))).distinct()


def footprint(items: DataFrame, people: DataFrame, who: str, key: str, attested: str) -> DataFrame:
    """(id): the items that were pulled from people's own sources, not those that someone saved."""
    ids = people.select(F.col("id").alias("_who"))
    return items.where(~F.coalesce(F.col(attested), F.lit(False))).join(ids, F.col(who) == F.col("_who"), "left_semi").select(F.col(key).alias("id"))

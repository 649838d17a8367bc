"""Snapshot fingerprints and differences, and merges of what arrived into what is there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def row_hash(columns: list[str]) -> Column:
    """SHA-256 of a row's values, each marked with its length, nulls apart from empty strings."""
    parts = [F.when(F.col(c).isNull(), "n:").otherwise(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string"))) for c in columns]
    return F.sha2(F.concat_ws("|", *parts), 256)


def digest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: n and the sums of the eight 32-bit limbs of all row hashes, whatever the rows' order (carry them for the sum modulo 2**256)."""
    h = rows.select(row_hash(columns).alias("h"))
    limb = [F.sum(F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("long")).alias(f"limb{i}") for i in range(8)]
    return h.agg(F.count("*").alias("n"), *limb)


def changes(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, change): 'write' for keys that are new or whose row changed, 'delete' for keys that are gone."""
    a = old.select(F.col(key), row_hash(columns).alias("_old"))
    b = new.select(F.col(key), row_hash(columns).alias("_new"))
    both = a.join(b, key, "full_outer").where(~F.col("_old").eqNullSafe(F.col("_new")))
    return both.select(key, F.when(F.col("_new").isNull(), "delete").otherwise("write").alias("change"))


def upsert(old: DataFrame, new: DataFrame, key: str, columns: list[str], clock: str) -> DataFrame:
    """``old`` with the newest of ``new`` for each key; a row whose content is equal is left as it was. Needs columns and version."""
    latest = new.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(clock), row_hash(columns)))).where("_r = 1")
    b = latest.select(key, F.struct(*columns).alias("_b"), row_hash(columns).alias("_hb"))
    a = old.select(key, F.struct(*columns).alias("_a"), row_hash(columns).alias("_ha"), "version")
    both = a.join(b, key, "full_outer")
    stays = F.col("_hb").isNull() | F.col("_ha").eqNullSafe(F.col("_hb"))
    kept = F.when(stays, F.col("_a")).otherwise(F.col("_b"))
    version = F.when(F.col("_ha").isNull(), 1).when(stays, F.col("version")).otherwise(F.col("version") + 1)
    return both.select(key, *(kept[c].alias(c) for c in columns), version.cast("int").alias("version"))

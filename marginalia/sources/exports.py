"""Exports and their changes: an allow-list of columns and keys, deltas that turn an old snapshot into a new one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marginalia.functions import maps
from marginalia.operators import snapshots


def export(rows: DataFrame, columns: list[str], objects: dict[str, list[str]]) -> DataFrame:
    """``columns`` as they are and the JSON columns of ``objects`` with only their allowed keys; nothing else leaves. Null stays null."""
    kept = [F.when(F.col(c).isNotNull(), F.to_json(maps.allowed(maps.decoded(F.col(c)), keys))).alias(c) for c, keys in objects.items()]
    return rows.select(*columns, *kept)


def dropped(rows: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """(key, dropped): what the allow-list of a JSON column leaves out, so that a new key doesn't vanish unseen."""
    found = F.map_keys(maps.decoded(F.col(column)))
    lost: Column = F.filter(found, lambda k: ~k.isin(keys)) if keys else found
    return rows.select(F.explode(lost).alias("key")).groupBy("key").agg(F.count("*").alias("dropped"))


def delta(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The columns of ``new`` with ``change``: rows to write, and of rows to delete the key alone. Keys are unique."""
    columns = [c for c in new.columns if c != key]
    change = snapshots.changes(old, new, key, columns)
    return change.join(new, key, "left").select("change", *new.columns)


def patched(old: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``old`` after a delta; a delta of an empty difference leaves it as it was."""
    stays = old.join(changes.select(key), key, "left_anti")
    return stays.unionByName(changes.where("change = 'write'").select(*old.columns))


def verified(rows: DataFrame, columns: list[str], digest: tuple[int, ...]) -> bool:
    """Whether a snapshot has the digest (n and eight sums) that its maker gave; one row comes to the driver."""
    return tuple(snapshots.digest(rows, columns).first()) == tuple(digest)

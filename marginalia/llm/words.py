"""The word definition all text operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: A word is a run of anything but ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"
GAP = "[\\x20\\x09-\\x0D]"


def words(text: Column) -> Column:
    """Array of the words of ``text``; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def has_words(text: Column) -> Column:
    return F.coalesce(text.rlike(WORD), F.lit(False))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def slice_words(text: Column, start: Column, n: Column) -> Column:
    """``n`` words of ``text`` from the 0-based word ``start`` on, with what stands between them; the text itself if that is all of it."""
    found = F.regexp_extract_all(text, F.lit(f"{WORD}{GAP}*"), F.lit(0))
    some = F.regexp_replace(F.array_join(F.slice(found, start.cast("int") + 1, n.cast("int")), ""), f"{GAP}+$", "")
    return F.when((start == 0) & (n == F.size(found)), text).otherwise(some)


def row_key(*columns: Column) -> Column:
    """64-bit key of an id, a text and what else rows that repeat each other share, nulls included."""
    return F.xxhash64(*(F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns))


#: Rows of one key that are joined with all their pieces together; rows of more are joined one by one.
TOGETHER = 64


def numbered(rows: DataFrame, key: str = "_k") -> DataFrame:
    """``rows`` with ``_copy``, which tells rows with one key apart (1, 2, ...), and how many there are, ``_copies``."""
    same = Window.partitionBy(key)
    return rows.withColumn("_copy", F.row_number().over(same.orderBy(key))).withColumn("_copies", F.count("*").over(same))


def with_pieces(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """Numbered ``rows`` once for each of their ``pieces`` (_k, _copy, _copies and others), which come as the struct ``_at``.

    Both are numbered by key, so rows of a key that few repeat need no other exchange; only rows of keys that many
    repeat are dealt once more, by key and number.
    """
    at = F.struct(*(c for c in pieces.columns if c not in ("_k", "_copy", "_copies")))
    few = pieces.where(F.col("_copies") <= TOGETHER).groupBy("_k").agg(F.collect_list(F.struct(F.col("_copy").alias("copy"), at.alias("at"))).alias("_all"))
    own = F.transform(F.filter("_all", lambda x: x["copy"] == F.col("_copy")), lambda x: x["at"])
    some = rows.where(F.col("_copies") <= TOGETHER).join(few, "_k").select(*rows.columns, F.explode(own).alias("_at"))
    many = pieces.where(F.col("_copies") > TOGETHER).groupBy("_k", "_copy").agg(F.collect_list(at).alias("_all"))
    rest = rows.where(F.col("_copies") > TOGETHER).join(many, ["_k", "_copy"]).select(*rows.columns, F.explode("_all").alias("_at"))
    return some.union(rest)

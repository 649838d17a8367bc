"""Streams into tables: duplicates dropped while they may come, and merges that stay right when a batch is replayed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from marginalia.operators import snapshots
from marginalia.sources.copies import Copy


def once(arrived: DataFrame, key: list[str], clock: str, late: str) -> DataFrame:
    """Each key's first row; the state of a key is kept until rows as late as ``late`` can't come any more."""
    return arrived.withWatermark(clock, late).dropDuplicatesWithinWatermark(key)


def merged(copy: Copy, batch: DataFrame, batch_id: int, clock: str) -> bool:
    """Merge a batch's newest row of each key into a copy; False for a batch that the copy holds already.

    A key's row is replaced by one with a later clock only, so late rows change nothing. The batch's number is in the
    manifest that makes its rows visible, so a replay after a crash is seen whenever the crash was.
    """
    if copy.batch() >= batch_id:
        return False
    columns = [c for c in batch.columns if c != copy.key]
    newest = batch.where(F.col(copy.key).isNotNull()).groupBy(copy.key).agg(F.max_by(F.struct(*columns), F.struct(clock, snapshots.row_hash(columns))).alias("_r")).select(copy.key, "_r.*")
    old = copy.rows()
    if old is None:
        copy.replace(newest, batch=batch_id)
        return True
    held = old.select(F.col(copy.key), F.col(clock).alias("_held"))
    fresh = newest.join(held, copy.key, "left").where(F.col("_held").isNull() | (F.col(clock) > F.col("_held"))).drop("_held")
    copy.apply(fresh.withColumn("change", F.lit("write")).select("change", *old.columns), None, batch=batch_id)
    return True


def merge_stream(arrived: DataFrame, copy: Copy, clock: str, checkpoint: str) -> StreamingQuery:
    """Run a stream of rows into a copy until what is there is in."""
    write = arrived.writeStream.foreachBatch(lambda batch, n: merged(copy, batch, n, clock) and None)
    return write.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tallied(arrived: DataFrame, clock: str, keys: list[str], late: str) -> DataFrame:
    """Counts by day and keys as rows stream in, each row counted once; a day is told when no row of it can come any more."""
    day = F.window(clock, "1 day")["start"].cast("date").alias("day")
    return arrived.withWatermark(clock, late).groupBy(F.window(clock, "1 day"), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").cast("date").alias("day"), *keys, "n") if keys else arrived.withWatermark(clock, late).groupBy(day).agg(F.count("*").alias("n"))

"""Tables, shared scratch space and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of a partition where a step holds or sorts them.
ROWS_A_PART = 1 << 18


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``folder`` (any path that Spark can read)."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary one where a local session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='marginalia-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def parts(rows: int) -> int:
    """How many partitions so many rows are dealt to where a step's memory goes by its rows: their number grows with the input, their size doesn't."""
    return 1 + rows // ROWS_A_PART


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage with a table that survives lost executors, compressed and with only the needed columns
    read later. The folder belongs to the cluster, which clears it with the application.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(df: DataFrame) -> DataFrame:
    """``df`` materialised; the driver's collection lets Spark delete the shuffle files that led to it, which nothing reads any more."""
    out = materialise(df)
    df.sparkSession.sparkContext._jvm.System.gc()
    return out

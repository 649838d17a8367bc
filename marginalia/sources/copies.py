"""Copies of a table in generations: buckets of files, a manifest that names them and is written last, deltas that touch few buckets."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from marginalia.operators import snapshots

BUCKETS = 32
LIMBS = [f"limb{i}" for i in range(8)]


class Stale(Exception):
    """A delta doesn't fit the copy it is for, or the copy didn't come out as it should. The copy is as it was."""


class TooLarge(Exception):
    """The copy would have more rows than it may. It is as it was."""


class Copy:
    """A copy of a table with unique keys below a folder that all executors share.

    Each version's manifest says for each bucket of keys where its file is, how many rows it has and the sums of
    their hashes. A version counts once its manifest is there, whole; files of a version that was cut off are never
    read. A manifest's name is taken once only, so of two writers one fails.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, buckets: int = BUCKETS) -> None:
        self.spark, self.folder, self.key, self.buckets = spark, folder.rstrip("/"), key, buckets

    def _manifests(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.folder}/manifest/*")
        except Exception as e:  # Spark has no call that asks whether there is any
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def manifest(self) -> list:
        """The rows of the newest version, one for each bucket; none if there is no version."""
        every = self._manifests()
        if every is None:
            return []
        newest = every.agg(F.max("version")).first()[0]
        return every.where(F.col("version") == newest).collect()

    def version(self) -> int:
        return max((r.version for r in self.manifest()), default=0)

    def batch(self) -> int:
        """The last batch of a stream that the newest version holds, -1 for none."""
        return max((r.batch for r in self.manifest()), default=-1)

    def digest(self) -> tuple[int, ...]:
        """n and the sums of all row hashes of the newest version: a fingerprint whatever the rows' order."""
        held = self.manifest()
        return (sum(r.n for r in held), *(sum(r[x] for r in held) for x in LIMBS))

    def rows(self) -> DataFrame | None:
        """The newest version, None if there is none."""
        return self._rows(self.manifest())

    def _rows(self, held: list) -> DataFrame | None:
        return self.spark.read.parquet(*sorted({r.path for r in held})).drop("_bucket") if held else None

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias("_bucket")

    def _publish(self, rows: DataFrame, kept: list, digest: tuple[int, ...] | None, most: int | None, batch: int) -> int:
        """Write buckets, read them back, check them, and only then name them."""
        columns, version = rows.columns, self.version() + 1
        path = f"{self.folder}/rows/{version}-{uuid.uuid4().hex}"
        rows.select("*", self._bucket()).repartition("_bucket").write.partitionBy("_bucket").parquet(path)
        back = self.spark.read.option("basePath", path).schema(rows.select("*", self._bucket()).schema).parquet(path)
        h = back.select("_bucket", snapshots.row_hash(columns).alias("h"))
        limbs = [F.sum(F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("long")).alias(x) for i, x in enumerate(LIMBS)]
        made = h.groupBy("_bucket").agg(F.count("*").alias("n"), *limbs).collect()  # a row for each bucket
        named = [(version, batch, r["_bucket"], f"{path}/_bucket={r['_bucket']}", r.n, *(r[x] for x in LIMBS)) for r in made]
        named += [(version, batch, r.bucket, r.path, r.n, *(r[x] for x in LIMBS)) for r in kept]
        sums = (sum(r[4] for r in named), *(sum(r[5 + i] for r in named) for i in range(8)))
        if digest is not None and sums != tuple(digest):
            raise Stale("the copy didn't come out with the digest that was asked for")
        if most is not None and sums[0] > most:
            raise TooLarge(f"{sums[0]} rows, {most} at most")
        schema = f"version long, batch long, bucket int, path string, n long, {', '.join(f'{x} long' for x in LIMBS)}"
        empty = [] if named else [(version, batch, -1, "", 0, *[0] * 8)]
        self.spark.createDataFrame(named + empty, schema).coalesce(1).write.mode("errorifexists").parquet(f"{self.folder}/manifest/v{version}")
        return version

    def replace(self, rows: DataFrame, digest: tuple[int, ...] | None = None, most: int | None = None, batch: int = -1) -> int:
        """A whole new version."""
        return self._publish(rows, [], digest, most, batch)

    def apply(self, changes: DataFrame, base: tuple[int, ...] | None, digest: tuple[int, ...] | None = None, most: int | None = None, batch: int = -1) -> int:
        """A version with the changes (``exports.delta``): only buckets that they touch are read and written.

        ``base`` is the digest of the version that the changes were made against; any other one raises Stale.
        """
        held = self.manifest()
        if not held or base is not None and self.digest() != tuple(base):
            raise Stale("the changes were made against another version")
        touched = {r[0] for r in changes.select(self._bucket()).distinct().collect()}  # buckets
        old = self._rows([r for r in held if r.bucket in touched and r.n])
        write = changes.where("change = 'write'").drop("change")
        rows = write if old is None else old.join(changes.select(self.key), self.key, "left_anti").unionByName(write.select(*old.columns))
        return self._publish(rows, [r for r in held if r.bucket not in touched and r.n], digest, most, batch)

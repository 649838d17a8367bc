"""Versions, deltas and streams into copies: what is cut off, stale, too large, late or replayed changes nothing."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from marginalia.operators import graph, snapshots
from marginalia.sources import copies, exports
from marginalia.storage import shared_folder
from marginalia.streaming import ledger


@pytest.fixture
def folder(spark):
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, v string")


def held(copy):
    return sorted(map(tuple, copy.rows().collect()))


def test_deltas_touch_few_buckets_and_count_when_named(spark, folder, monkeypatch):
    old, new = [(i, f"a{i}") for i in range(200)], [(i, f"a{i}") for i in range(200) if i != 7] + [(3, "b"), (500, None)]
    new = [r for r in new if r != (3, "a3")]
    copy = copies.Copy(spark, folder, "id", 16)
    assert copy.rows() is None and copy.version() == 0
    with pytest.raises(copies.Stale):
        copy.apply(exports.delta(table(spark, old), table(spark, new), "id"), None)
    assert copy.replace(table(spark, old)) == 1
    base, want = copy.digest(), tuple(snapshots.digest(table(spark, new), ["id", "v"]).first())
    assert base == tuple(snapshots.digest(table(spark, old), ["id", "v"]).first())
    delta = exports.delta(table(spark, old), table(spark, new), "id")
    for wrong, error in (({"base": want}, copies.Stale), ({"base": base, "digest": base}, copies.Stale), ({"base": base, "most": 199}, copies.TooLarge)):
        with pytest.raises(error):
            copy.apply(delta, **wrong)
        assert copy.version() == 1 and held(copy) == sorted(old) and copy.digest() == base
    before = {r.bucket: r.path for r in copy.manifest()}
    monkeypatch.setattr(copy.spark, "createDataFrame", lambda *_: (_ for _ in ()).throw(RuntimeError("cut off")), raising=False)
    with pytest.raises(RuntimeError):
        copy.apply(delta, base, want)  # files are written, no manifest
    monkeypatch.undo()
    assert copy.version() == 1 and held(copy) == sorted(old)
    assert copy.apply(delta, base, want, most=200) == 2
    assert held(copy) == sorted(new, key=lambda r: r[0]) and copy.digest() == want
    after = {r.bucket: r.path for r in copy.manifest()}
    assert 1 <= sum(before[b] != after.get(b) for b in before) <= 3
    assert copy.apply(exports.delta(table(spark, new), table(spark, new), "id"), want, want) == 3 and copy.digest() == want
    monkeypatch.setattr(copy, "version", lambda: 2)
    with pytest.raises(Exception, match="(?i)exists"):
        copy.replace(table(spark, old))  # another writer has taken version 3
    assert copies.Copy(spark, folder, "id", 16).digest() == want


def test_an_empty_copy(spark, folder):
    copy = copies.Copy(spark, folder, "id", 4)
    copy.replace(table(spark, []))
    assert copy.version() == 1 and copy.digest() == (0, *[0] * 8)
    copy.apply(exports.delta(table(spark, []), table(spark, [(1, "x")]), "id"), copy.digest())
    assert held(copy) == [(1, "x")]


T0 = dt.datetime(2024, 1, 1)
ROWS = "id long, v string, at timestamp"


def batches(spark, folder, *parts):
    for rows in parts:
        spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def test_merges_are_right_when_replayed_or_late(spark, folder):
    copy = copies.Copy(spark, f"{folder}/copy", "id", 4)
    at = lambda h: T0 + dt.timedelta(hours=h)
    stream = batches(spark, folder, [(1, "a", at(1)), (2, "b", at(1)), (1, "a2", at(2))], [(1, "late", at(0)), (3, "c", at(3)), (None, "x", at(3))])
    ledger.merge_stream(stream, copy, "at", f"{folder}/check").awaitTermination(200)
    want = [(1, "a2", at(2)), (2, "b", at(1)), (3, "c", at(3))]
    assert held(copy) == want and copy.batch() == 1
    version = copy.version()
    assert not ledger.merged(copy, spark.createDataFrame([(1, "again", at(9))], ROWS), 1, "at") and copy.version() == version
    ledger.merge_stream(stream, copy, "at", f"{folder}/other").awaitTermination(200)  # all batches once more, from a lost checkpoint
    assert held(copy) == want and copy.version() == version
    ledger.merge_stream(batches(spark, folder, [(2, "b2", at(5))]), copy, "at", f"{folder}/check").awaitTermination(200)
    assert held(copy) == [want[0], (2, "b2", at(5)), want[2]]


def test_once_within_the_watermark(spark, folder):
    at = lambda h: T0 + dt.timedelta(hours=h)
    stream = batches(spark, folder, [(1, "a", at(1)), (1, "a", at(1)), (2, "b", at(1))], [(1, "a", at(2)), (3, "c", at(30))], [(2, "old", at(1)), (4, "d", at(31))])
    out = ledger.once(stream, ["id"], "at", "6 hours")
    out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination(200)
    assert sorted(r.id for r in spark.read.parquet(f"{folder}/out").collect()) == [1, 2, 3, 4]


def test_ancestries(spark):
    rows = [(i, i - 1 if i else None, "a" if i < 700 else "b") for i in range(1000)]
    rows += [(2000 + i, 2000, "c") for i in range(1, 50)] + [(2000, 1_000_000, "c"), (3000, 3001, "d"), (3001, 3000, "d"), (3002, 3000, "d")]
    posts = spark.createDataFrame(rows, "id long, to long, who string")
    got = {r.node: (r.root, r.depth, r.unbroken) for r in graph.ancestries(posts, "id", "to", F.col("who") == F.col("up_who"), rounds=12).collect()}
    want = {i: (0, i, i < 700) for i in range(1000)} | {2000 + i: (2000, 1, True) for i in range(1, 50)} | {2000: (2000, 0, True)} | {i: (None, None, False) for i in (3000, 3001, 3002)}
    assert got == want
    assert graph.ancestries(posts.limit(0), "id", "to").count() == 0


def test_self_threads(spark):
    rows = [(1, None, "a", 1, "one"), (2, 1, "a", 2, "two"), (3, 2, "b", 3, "no"), (4, 3, "a", 4, "cut"), (5, 2, "a", 5, None), (6, None, "b", 1, "alone")]
    got = graph.self_threads(spark.createDataFrame(rows, "id long, to long, who string, n int, t string"), "id", "to", "who", "n", "t")
    want = got.sparkSession.createDataFrame([(1, "a", 3, "one\n\ntwo\n\n"), (6, "b", 1, "alone")], "root long, who string, posts long, t string").select("root", "who", "posts", F.sha2("t", 256))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))

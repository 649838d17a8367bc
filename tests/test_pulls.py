"""Pulled sources: what moves a mark and what doesn't, batch and stream, over a restart."""

import ast
import json
import os
import uuid

from marginalia.sources import pulls
from marginalia.storage import shared_folder

PAIRS = [("ledgers", "feed"), ("ledgers", "index"), ("genes", "feed"), ("genes", "index")]


def fixture(folder, query, source, answer):
    with open(f"{folder}/{query}-{source}.json", "w") as f:
        f.write(answer if isinstance(answer, str) else json.dumps(answer))


def answer(as_of, *days):
    return {"as_of": as_of, "items": [{"id": f"i{d}", "at": d} for d in days]}


def reader(folder):
    def fetch(query, source, since):
        with open(f"{folder}/{query}-{source}.json") as f:
            return f.read()

    return fetch


def test_marks(spark, tmp_path):
    folder, out, name = str(tmp_path), f"{shared_folder(spark)}/{uuid.uuid4().hex}", f"pulled_{uuid.uuid4().hex[:8]}"
    spark.dataSource.register(pulls.source(name, PAIRS, reader(folder)))
    fixture(folder, "ledgers", "feed", answer("03", "01", "02"))
    fixture(folder, "ledgers", "index", {"as_of": "03", "items": []})
    fixture(folder, "genes", "feed", "<html>busy</html>")  # malformed; genes-index can't be asked at all

    states = {(r.query, r.source): [] for r in spark.read.format(name).load().collect()}
    for r in spark.read.format(name).load().collect():
        states[r.query, r.source].append(r.id or r.state.split(":")[0])
    assert states == {PAIRS[0]: ["i01", "i02"], PAIRS[1]: ["empty"], PAIRS[2]: ["malformed"], PAIRS[3]: ["FileNotFoundError"]}

    def go():
        stream = spark.readStream.format(name).load()
        query = stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(once=True).start()
        query.awaitTermination(120)
        marks = ast.literal_eval(str(query.lastProgress.sources[0].endOffset))
        return sorted((r.query, r.source, r.id) for r in spark.read.schema(pulls.ITEM).parquet(f"{out}/rows").collect()), marks

    found, marks = go()
    assert found == [("ledgers", "feed", "i01"), ("ledgers", "feed", "i02")]
    assert marks == {json.dumps(list(p)): "03" for p in PAIRS[:2]}
    fixture(folder, "ledgers", "feed", "not json")  # fails now: its mark stays
    fixture(folder, "ledgers", "index", answer("05", "04", "06"))  # what is after the answer's own time waits
    fixture(folder, "genes", "feed", answer("05", "02", "05"))
    found, marks = go()
    assert found == [("genes", "feed", "i02"), ("genes", "feed", "i05"), ("ledgers", "feed", "i01"), ("ledgers", "feed", "i02"), ("ledgers", "index", "i04")]
    assert marks == {json.dumps(["ledgers", "feed"]): "03", json.dumps(["ledgers", "index"]): "05", json.dumps(["genes", "feed"]): "05"}
    fixture(folder, "ledgers", "feed", answer("09", "02", "03", "07"))  # only what is later than its mark is new
    fixture(folder, "ledgers", "index", answer("07", "04", "06"))
    found, marks = go()
    assert [x for x in found if x[0] == "ledgers"] == [("ledgers", "feed", "i01"), ("ledgers", "feed", "i02"), ("ledgers", "feed", "i07"), ("ledgers", "index", "i04"), ("ledgers", "index", "i06")]
    assert os.path.exists(folder)


def test_a_batch_that_is_read_again_is_the_same(tmp_path):
    folder = str(tmp_path)
    for q, s in PAIRS:
        fixture(folder, q, s, answer("04", "01", "03"))
    stream = pulls.source("x", PAIRS, reader(folder))({}).simpleStreamReader(None)
    rows, end = stream.read({})
    first = sorted(rows)
    fixture(folder, "genes", "feed", answer("09", "01", "03", "08"))
    assert sorted(stream.readBetweenOffsets({}, end)) == first and len(first) == 8
    later, new = stream.read(end)
    assert [(r[0], r[1], r[2]) for r in later] == [("genes", "feed", "i08")] and new[json.dumps(["genes", "feed"])] == "09"

"""Walks as keyed state: order, replays, cycles, patience, and a restart from the checkpoint."""

import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F

from marginalia.storage import shared_folder
from marginalia.streaming import walks

T0 = dt.datetime(2024, 1, 1)


def page(c, g, cursor="0", nxt=None, branch="root", opens=(), shown=1, at=T0):
    return c, g, branch, cursor, nxt, list(opens), shown, at


PAGES = [
    page("a", 1, nxt="1"), page("a", 1, "1", "2"), page("a", 1, "2", shown=0),  # complete
    page("a", 2, nxt="1"), page("a", 2, "1", "2"),  # a page is owed
    page("b", 1, opens=["l1", "l2"]), page("b", 1, branch="l1"), page("b", 1, branch="l2", nxt="1"), page("b", 1, "1", branch="l2"),  # branches
    page("c", 1, opens=["l1"]),  # a branch is owed
    page("d", 1, nxt="1"), page("d", 1, "1", "2"), page("d", 1, "2", "1"),  # a cycle
    page("e", 1, nxt="0"),  # a cycle of one
    page("f", 1, nxt="1", shown=0), page("f", 1, "1"),  # no progress
    page("g", 1), page("g", 3), page("g", 2),  # the latest counts
    page("h", 1), page("h", 1, "9"),  # nothing leads to a page
]
WANT = {"a": (1, 3, 2), "b": (1, 4, 4), "g": (3, 1, 1)}


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key, None)
    spark.conf.set(key, walks.ROCKS)
    yield
    spark.conf.set(key, old) if old else spark.conf.unset(key)


class Stream:
    """Pages written as files one after another, followed into a folder from one checkpoint."""

    def __init__(self, spark, patience=None):
        self.spark, self.patience, self.top = spark, patience, f"{shared_folder(spark)}/{uuid.uuid4().hex}"

    def feed(self, *batches):
        for rows in batches:
            self.spark.createDataFrame(rows, walks.PAGE).coalesce(1).write.mode("append").parquet(f"{self.top}/in")
        source = self.spark.readStream.schema(walks.PAGE).option("maxFilesPerTrigger", 1).parquet(f"{self.top}/in")
        out = walks.followed(source, self.patience)
        out.writeStream.format("parquet").option("path", f"{self.top}/out").option("checkpointLocation", f"{self.top}/state").trigger(availableNow=True).start().awaitTermination(300)
        return self.rows()

    def rows(self):
        return self.spark.read.schema(walks.OUT).parquet(f"{self.top}/out").collect()


def latest(rows):
    return {c: max((r.generation, r.pages, r.shown) for r in rows if r.collector == c and r.state == "complete") for c in {r.collector for r in rows if r.state == "complete"}}


def test_batch(spark):
    rows = spark.createDataFrame([*PAGES, *PAGES[:4]], walks.PAGE)
    assert {r.collector: (r.generation, r.pages, r.shown) for r in walks.settled_walks(rows).collect()} == WANT
    assert walks.settled_walks(rows.limit(0)).count() == 0


def test_stream_equals_batch_in_any_order_and_over_restarts(spark, rocks):
    rnd = random.Random(3)
    mixed = [*PAGES, *PAGES[::2]]
    rnd.shuffle(mixed)
    stream = Stream(spark)
    stream.feed(mixed[:9], mixed[9:15])
    rows = stream.feed(mixed[15:])  # a new query from the checkpoint of the first
    assert latest(rows) == WANT
    states = {(r.collector, r.generation): r.state for r in rows}
    assert {(c, g) for (c, g), s in states.items() if s != "complete"} == {("d", 1), ("e", 1), ("f", 1)} and states["d", 1] == states["e", 1] == "cycle" and states["f", 1] == "stuck"
    more = stream.feed([page("a", 2, "2"), page("h", 1, nxt="9")])
    assert latest(more) == WANT | {"a": (2, 3, 3)}  # the owed page came; a page that came again led nowhere new


def test_patience(spark, rocks):
    stream = Stream(spark, dt.timedelta(hours=2))
    rows = stream.feed([page("a", 1, nxt="1"), page("b", 1)], [page("z", 1, at=T0 + dt.timedelta(days=2))], [page("z", 2, at=T0 + dt.timedelta(days=3))])
    assert {(r.collector, r.state) for r in rows} == {("a", "stalled"), ("b", "complete"), ("z", "complete")}
    assert latest(stream.feed([page("a", 1, "1", at=T0 + dt.timedelta(days=3))]))["a"] == (1, 2, 2)


class Stored(dict):
    """A map or value state in memory that counts what it is asked."""

    calls = 0

    def _did(self, got=None):
        Stored.calls += 1
        return got

    def getValue(self, key): return self._did(self.get(key))
    def updateValue(self, key, value): self._did(self.__setitem__(key, value))
    def removeKey(self, key): self._did(self.pop(key, None))
    def keys(self): return self._did(list(super().keys()))
    def iterator(self): return self._did(list(self.items()))
    def get(self, key=None): return dict.get(self, key)
    def update(self, value): self._did(self.__setitem__(None, value))
    def getValueState(self, *_): return Stored()
    def getMapState(self, *_): return Stored()


def fed(batches):
    """What is told of one collector's pages, and the states that stay."""
    from pyspark.sql import Row

    made, out = walks.Walks(), []
    made.init(Stored())
    Stored.calls = 0
    names = "collector generation branch cursor next opens shown at".split()
    for rows in batches:
        out += made.handleInputRows(("a",), iter([Row(**dict(zip(names, r))) for r in rows]), None)
    return [(r.generation, r.state, r.pages) for r in out], made


def test_a_batch_of_pages_asks_the_store_little():
    chain = [page("a", 1, str(i), str(i + 1) if i < 999 else None) for i in range(1000)]
    random.Random(5).shuffle(chain)
    told, made = fed([chain[:500], chain[500:], chain[:50]])
    assert told == [(1, "complete", 1000)] and not made.tally and not made.cursors
    assert Stored.calls < 60  # one by one they were thousands


@pytest.mark.parametrize("size", [1, 2, 300])
def test_a_walk_is_the_same_in_any_batches_and_entries(size, monkeypatch):
    monkeypatch.setattr(walks, "ENTRY", 2)
    rnd = random.Random(size)
    chain = [page("a", g, str(i), str(i + 1) if i < 59 else None, opens=["l"] if i == 7 else []) for g in (1, 2, 3) for i in range(60)] + [page("a", g, branch="l") for g in (1, 2)]
    chain += [page("a", 4, "0", "1"), page("a", 4, "1", "0"), *chain[:40]]
    rnd.shuffle(chain)
    told, made = fed([chain[i : i + size] for i in range(0, len(chain), size)])
    assert (2, "complete", 61) in told and {s for g, s, _ in told if g == 4} == {"cycle"} and not any(g == 3 for g, _, _ in told)
    assert {g for g, in made.tally} == {3, 4} and {g for g, _ in made.cursors} == {3, 4} and made.tally[3,][7] >= 16

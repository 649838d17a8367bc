"""Walks over paged listings as keyed state: a generation counts only when all its pages are in."""

from __future__ import annotations

import datetime as dt
import json
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROOT, START = "root", "0"
PAGE = "collector string, generation long, branch string, cursor string, next string, opens array<string>, shown long, at timestamp"
OUT = "collector string, generation long, state string, pages long, shown long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Cursors of a generation that one entry of the state holds, on average at most.
ENTRY = 256


def _hash(at: tuple[str, str]) -> int:
    return zlib.crc32("\0".join(x or "" for x in at).encode())


class _Generation:
    """A generation as one call sees it: its tally, and of its cursors the entries that the call's pages need.

    Cursors are dealt by hash to entries of the state, whose number doubles as they become more.
    """

    def __init__(self, g: int, tally: tuple | None, cursors) -> None:
        self.g, self.stored, self.new = g, cursors, tally is None
        self.owed, self.stray, self.pages, self.shown, self.failed, self.timer, self.held, self.parts = tally or (0, 0, 0, 0, None, None, 0, 1)
        self.was, self.read, self.changed = self.timer, {}, set()
        self.empty = self.new  # nothing of it is stored
        if self.new:
            self.ask((ROOT, START))

    def _entry(self, part: int) -> dict[tuple[str, str], list]:
        if part not in self.read:
            found = None if self.empty else self.stored.getValue((self.g, part))
            self.read[part] = {(b, c): [asked, got] for b, c, asked, got in json.loads(found[0])} if found else {}
        return self.read[part]

    def _at(self, at: tuple[str, str]) -> list:
        """[how often it is led to, whether its page is in], to be changed in place."""
        part = _hash(at) % self.parts
        entry = self._entry(part)
        self.changed.add(part)
        if at not in entry:
            entry[at] = [0, False]
            self.held += 1
        return entry[at]

    def ask(self, at: tuple[str, str]) -> None:
        state = self._at(at)
        if state[0]:
            self.failed = self.failed or "cycle"
        else:
            self.owed, self.stray = self.owed + (not state[1]), self.stray - state[1]
        state[0] += 1

    def take(self, page: Row) -> bool:
        """Count a page in; false if it was in."""
        state = self._at((page.branch, page.cursor))
        if state[1]:
            return False
        state[1] = True
        self.owed, self.stray = self.owed - (state[0] > 0), self.stray + (state[0] == 0)
        self.pages, self.shown = self.pages + 1, self.shown + (page.shown or 0)
        if page.next is not None and not page.shown:
            self.failed = self.failed or "stuck"
        for to in [*([(page.branch, page.next)] if page.next is not None else []), *((b, START) for b in page.opens or ())]:
            self.ask(to)
        return True

    def _store(self, part: int) -> None:
        rows = [[*at, *state] for at, state in self.read[part].items()]
        self.stored.updateValue((self.g, part), (json.dumps(rows),))

    def write(self) -> tuple:
        """Store the entries that changed, in twice as many where they are full; gives the tally."""
        while self.held > ENTRY * self.parts:
            for part in range(self.parts):  # an entry after another, so that a long walk is never held whole
                known, entry = part in self.read, self._entry(part)
                far = {at: x for at, x in entry.items() if _hash(at) % (2 * self.parts) != part}
                self.read[part], self.read[part + self.parts] = {at: x for at, x in entry.items() if at not in far}, far
                self._store(part)
                self._store(part + self.parts)
                if not known:
                    del self.read[part], self.read[part + self.parts]
            self.parts, self.changed, self.empty = 2 * self.parts, set(), False
        for part in self.changed:
            self._store(part)
        return self.owed, self.stray, self.pages, self.shown, self.failed, self.timer, self.held, self.parts


class Walks(StatefulProcessor):
    """The state of one collector's generations.

    A page leads to its next cursor and to the starts of the branches it opens; the root's start is asked for from the
    beginning. A generation is complete when every cursor that is led to has its page and every page is led to, in
    whatever order they come. A page that comes again changes nothing. A cursor that is led to twice is a cycle, a page
    without anything shown that goes on makes no progress: either way the generation fails for good. The latest
    complete generation is accepted; what comes of it or of earlier ones afterwards is out of date.

    The pages of a batch are worked on together: every call to the state store is a message to another process.
    """

    def __init__(self, patience: dt.timedelta | None = None) -> None:
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.accepted = handle.getValueState("accepted", "generation long")
        self.cursors = handle.getMapState("cursors", "generation long, part int", "held string")
        self.tally = handle.getMapState("tally", "generation long", "owed long, stray long, pages long, shown long, failed string, timer long, held long, parts int")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        done = self.accepted.get()
        upto, before = (done[0] if done else None,) * 2
        open_: dict[int, _Generation] = {}
        for page in rows:
            g = page.generation
            if upto is not None and g <= upto:
                continue
            if g not in open_:
                open_[g] = _Generation(g, self.tally.getValue((g,)), self.cursors)
            walk = open_[g]
            failed = walk.failed
            if not walk.take(page):
                continue
            if self.patience and page.at:
                ends = int((page.at + self.patience).timestamp() * 1000)
                walk.timer = ends if walk.timer is None else max(ends, walk.timer)
            if walk.failed and not failed:
                yield Row(collector=key[0], generation=g, state=walk.failed, pages=walk.pages, shown=walk.shown)
            if not walk.failed and not walk.owed and not walk.stray:
                upto = g
                yield Row(collector=key[0], generation=g, state="complete", pages=walk.pages, shown=walk.shown)
        if upto != before:
            self.accepted.update((upto,))
            self._forget(upto)
        for g, walk in open_.items():
            if upto is None or g > upto:
                if walk.timer != walk.was:
                    if walk.was is not None:
                        self.handle.deleteTimer(walk.was)
                    self.handle.registerTimer(walk.timer)
                self.tally.updateValue((g,), walk.write())

    def _forget(self, upto: int) -> None:
        for (g,), tally in [(tuple(k), v) for k, v in self.tally.iterator() if k[0] <= upto]:
            timer, parts = tally[5], tally[7]
            if timer is not None:
                self.handle.deleteTimer(timer)
            for part in range(parts):
                self.cursors.removeKey((g, part))
            self.tally.removeKey((g,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """A generation without a page for so long is told as stalled, once; a page that comes later still counts."""
        at = expiredTimerInfo.getExpiryTimeInMs()
        for (g,) in [tuple(k) for k in self.tally.keys()]:
            owed, stray, pages, shown, failed, timer, *more = self.tally.getValue((g,))
            if timer == at:
                self.tally.updateValue((g,), (owed, stray, pages, shown, failed, None, *more))
                if not failed:
                    yield Row(collector=key[0], generation=g, state="stalled", pages=pages, shown=shown)

    def close(self) -> None:
        pass


def followed(pages: DataFrame, patience: dt.timedelta | None = None, late: str = "1 hour") -> DataFrame:
    """A stream of (collector, generation, state, pages, shown): complete, cycle, stuck or, with a patience, stalled generations.

    ``pages`` is a stream of PAGE rows. The session's state store has to be RocksDB (``ROCKS``).
    """
    rows = pages.withWatermark("at", late) if patience else pages
    return rows.groupBy("collector").transformWithState(Walks(patience), OUT, outputMode="Append", timeMode="EventTime" if patience else "None")


def settled_walks(pages: DataFrame) -> DataFrame:
    """(collector, generation, pages, shown) of the latest complete generation of each collector, from all pages at once.

    The same rules as joins and counts: every cursor that is led to has a page, every page is led to, none twice.
    """
    page = pages.dropDuplicates(["collector", "generation", "branch", "cursor"])
    at = ["collector", "generation"]
    onward = page.where("next is not null").select(*at, "branch", F.col("next").alias("cursor"))
    opened = page.select(*at, F.explode("opens").alias("branch"), F.lit(START).alias("cursor"))
    first = page.select(*at).distinct().select(*at, F.lit(ROOT).alias("branch"), F.lit(START).alias("cursor"))
    asked = onward.union(opened).union(first).groupBy(*at, "branch", "cursor").agg(F.count("*").alias("asked"))
    both = page.join(asked, [*at, "branch", "cursor"], "full_outer")
    stuck = F.col("next").isNotNull() & (F.coalesce("shown", F.lit(0)) == 0)
    good = F.bool_and((F.coalesce("asked", F.lit(0)) == 1) & F.col("got") & ~F.coalesce(stuck, F.lit(False)))
    whole = both.withColumn("got", F.col("at").isNotNull()).groupBy(*at).agg(good.alias("good"), F.count_if("got").alias("pages"), F.coalesce(F.sum("shown"), F.lit(0)).alias("shown")).where("good")
    return whole.groupBy("collector").agg(F.max_by(F.struct("generation", "pages", "shown"), "generation").alias("x")).select("collector", "x.*")

"""Pulled sources as data sources: batch and stream reads whose offsets are the marks of (query, source) pairs."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

#: What a pull gives: an item, or (without id) what became of a pull that gave none.
ITEM = "query string, source string, id string, at string, payload string, state string"


class Failed(Exception):
    """A source couldn't be asked or gave what can't be read. Its mark stays where it was."""


def read_answer(text: str) -> tuple[str, list[tuple[str, str, str]]]:
    """(as_of, [(id, at, payload)]) of a JSON answer with ``as_of`` and ``items``; no items is an empty answer, anything else is malformed."""
    try:
        answer = json.loads(text)
        return str(answer["as_of"]), [(str(x["id"]), str(x["at"]), json.dumps(x, sort_keys=True)) for x in answer["items"]]
    except (ValueError, KeyError, TypeError) as e:
        raise Failed(f"malformed: {type(e).__name__}") from e


def source(name: str, pairs: list[tuple[str, str]], fetch: Callable[[str, str, str | None], str], parse: Callable[[str], tuple[str, list]] = read_answer) -> type[DataSource]:
    """A data source to register: ``fetch(query, source, since)`` gives an answer of a bounded page of items after ``since``, oldest first, and says up to when it is complete.

    A stream's offset has a mark for each pair. A pull that works moves its pair's mark to the time its answer is complete
    up to, with items or without; one that fails (``Failed`` or any error of ``fetch``) leaves it, and the other pairs go
    on. A batch that is read again asks from its first mark and takes items up to its last, so replays give the same
    rows. Items come through the driver, a page for each pair and trigger; a batch read asks pairs in tasks.
    """

    def pull(query: str, of: str, since: str | None) -> tuple[str, list]:
        try:
            as_of, items = parse(fetch(query, of, since))
        except Failed:
            raise
        except Exception as e:
            raise Failed(f"{type(e).__name__}: {e}") from e
        return as_of, [x for x in items if since is None or x[1] > since]

    def key(query: str, of: str) -> str:
        return json.dumps([query, of])

    class Pair(InputPartition):
        pass

    class Batch(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            return [Pair(p) for p in pairs]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            query, of = partition.value
            try:
                _, items = pull(query, of, None)
            except Failed as e:
                yield query, of, None, None, None, str(e)
                return
            for i, at, payload in items:
                yield query, of, i, at, payload, "found"
            if not items:
                yield query, of, None, None, None, "empty"

    class Stream(SimpleDataSourceStreamReader):
        def initialOffset(self) -> dict:
            return {}

        def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
            rows, end = [], dict(start)
            for query, of in pairs:
                try:
                    as_of, items = pull(query, of, start.get(key(query, of)))
                except Failed:
                    continue
                end[key(query, of)] = max(as_of, start.get(key(query, of)) or "")
                rows += [(query, of, i, at, payload, "found") for i, at, payload in items if at <= as_of]
            return iter(rows), end

        def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
            for query, of in pairs:
                low, high = start.get(key(query, of)), end.get(key(query, of))
                if high is not None and high != low:
                    for i, at, payload in pull(query, of, low)[1]:
                        if at <= high:
                            yield query, of, i, at, payload, "found"

    class Pulled(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return ITEM

        def reader(self, schema) -> DataSourceReader:
            return Batch()

        def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
            return Stream()

    return Pulled

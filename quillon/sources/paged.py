"""Cursor-paged feeds as a streaming data source with offsets.

A feed is a set of queries over records that appear at dates.  Its offset is the date up to which it has been read; a batch covers the dates
between two offsets, cut into windows at fixed places, so one query is many tasks and a batch that is run again makes the same ones.  Each task follows the
cursor chain of its query and window and keeps one page in memory.  Spark logs the offsets in the stream's checkpoint: a
restarted stream goes on after the last batch that was finished, and reads an unfinished one again.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

DAYS = 7
FIRST = "1970-01-01"


class Window(InputPartition):
    """Records of a query that appeared on or after ``since`` and before ``until``."""

    def __init__(self, query: str, since: str, until: str):
        self.query, self.since, self.until = query, since, until


def windows(queries: list[str], since: str, until: str, days: int = DAYS) -> list[Window]:
    """The windows between two dates: cut where the days since the epoch are multiples of ``days``."""
    epoch, a, b = (datetime.date.fromisoformat(d) for d in (FIRST, since, until))
    out = []
    while a < b:
        end = min(b, a + datetime.timedelta(days=days - (a - epoch).days % days))
        out += [Window(q, a.isoformat(), end.isoformat()) for q in queries]
        a = end
    return out


def chain(fetch: Callable[[str, str, str, str], dict], window: Window) -> Iterator[tuple]:
    """(query, record) of all pages of a window."""
    cursor, seen = "*", set()
    while cursor and cursor not in seen:
        seen.add(cursor)  # a feed that hands out a cursor twice would never end
        page = fetch(window.query, window.since, window.until, cursor)
        yield from ((window.query, r) for r in page["results"])
        cursor = page.get("next_cursor") if page["results"] else None


def feed(fetch: Callable[[str, str, str, str], dict], horizon: Callable[[], str], name: str = "feed", schema: str = "query string, record string") -> type[DataSource]:
    """A data source, to be registered by ``spark.dataSource.register``, for ``spark.readStream`` and ``spark.read``.

    fetch(query, since, until, cursor) returns {"results": [text, ...], "next_cursor": text or None}, beginning at cursor ``*``; it runs in
    tasks.  horizon() is the date up to which records are complete.  Options: ``queries`` (one a line), ``since``, ``days`` of a window.
    """

    class Stream(DataSourceStreamReader):
        def __init__(self, queries: list[str], since: str, days: int):
            self.queries, self.since, self.days = queries, since, days

        def initialOffset(self) -> dict:
            return {"until": self.since}

        def latestOffset(self) -> dict:
            return {"until": max(horizon(), self.since)}

        def partitions(self, start: dict, end: dict) -> list[InputPartition]:
            return windows(self.queries, start["until"], end["until"], self.days)

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            return chain(fetch, partition)

        def commit(self, end: dict) -> None:
            """Nothing is held for a batch that is done: the checkpoint has its offset."""

    class Batch(DataSourceReader):
        def __init__(self, queries: list[str], since: str, days: int):
            self.queries, self.since, self.days = queries, since, days

        def partitions(self) -> list[InputPartition]:
            return windows(self.queries, self.since, max(horizon(), self.since), self.days)

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            return chain(fetch, partition)

    class Feed(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def _settings(self) -> tuple[list[str], str, int]:
            return [q for q in self.options.get("queries", "").split("\n") if q], self.options.get("since", FIRST), int(self.options.get("days", DAYS))

        def streamReader(self, schema) -> DataSourceStreamReader:
            return Stream(*self._settings())

        def reader(self, schema) -> DataSourceReader:
            return Batch(*self._settings())

    return Feed


def listing(uri: str, page: int = 100) -> Callable[[str, str, str, str], dict]:
    """A ``fetch`` over a folder of Parquet (query, day, key, record) in any store that Arrow opens; the cursor is the last key."""

    def fetch(query: str, since: str, until: str, cursor: str) -> dict:
        import pyarrow.compute as pc
        import pyarrow.dataset as ds
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        wanted = (pc.field("query") == query) & (pc.field("day") >= since) & (pc.field("day") < until)
        if cursor != "*":
            wanted = wanted & (pc.field("key") > int(cursor))
        rows = ds.dataset(path, filesystem=store, format="parquet").to_table(columns=["key", "record"], filter=wanted).sort_by("key").slice(0, page)
        keys = rows.column("key").to_pylist()
        return {"results": rows.column("record").to_pylist(), "next_cursor": str(keys[-1]) if len(keys) == page else None}

    return fetch

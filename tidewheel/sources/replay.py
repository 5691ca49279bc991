"""A paging candle source as a Python data source, in batches and as a stream.

``spark.dataSource.register(CandlePages)`` and then ``spark.read.format("candle_pages").option("path", ...)`` or
``spark.readStream``.  The pages are JSON files named by their first time below a folder for each symbol, so recorded responses
replay offline, from any store that Arrow's file systems reach; each symbol is one partition of a read.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from typing import TypeVar

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "symbol string, timestamp long, open double, high double, low double, close double, volume double"
#: Empty pages after which a batch takes a symbol to have ended; tries of a request, and seconds before the second one, doubled each time.
EMPTY, TRIES, WAIT = 3, 5, 0.5
END = 1 << 62
A = TypeVar("A")


def tried(ask: Callable[[], A], tries: int = TRIES, wait: float = WAIT) -> A:
    """What ``ask`` gives; a failed request is made again after a growing pause."""
    for k in range(tries):
        try:
            return ask()
        except OSError:
            if k == tries - 1:
                raise
            time.sleep(wait * 2**k)
    raise ValueError("at least one try")


class Pages:
    """The pages below a path."""

    def __init__(self, path: str):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        self.select = fs.FileSelector
        self.folder = fs.FileType.Directory

    def symbols(self) -> list[str]:
        return sorted(x.base_name for x in tried(lambda: self.fs.get_file_info(self.select(self.root, allow_not_found=True))) if x.type == self.folder)

    def of(self, symbol: str) -> list[tuple[int, str]]:
        """(first time, path) of a symbol's pages, in order."""
        found = tried(lambda: self.fs.get_file_info(self.select(f"{self.root}/{symbol}", allow_not_found=True)))
        return sorted((int(x.base_name.partition(".")[0]), x.path) for x in found if x.base_name.partition(".")[0].isdigit())

    def rows(self, path: str) -> list[list]:
        """A page's rows [ms, o, h, l, c, v], in the order of their time."""

        def ask() -> list[list]:
            with self.fs.open_input_stream(path) as f:
                return json.loads(f.read())

        return sorted(tried(ask), key=lambda r: r[0])

    def between(self, symbol: str, since: int, until: int, empty: int | None = None) -> Iterator[tuple]:
        """Rows from ``since`` to before ``until``, each time once; a page that ends before ``since`` is never asked for.

        ``empty`` pages in a row end the symbol.
        """
        pages, cursor, none = self.of(symbol), since, 0
        start = max((k for k, (first, _) in enumerate(pages) if first <= since), default=0)
        for first, path in pages[start:]:
            if first >= until:
                return
            page = self.rows(path)
            if max((r[0] for r in page), default=first) < since:
                continue
            none = 0 if page else none + 1
            if none == empty:
                return
            for r in page:
                if cursor <= r[0] < until:
                    yield (symbol, int(r[0]), *map(float, r[1:6]))
                    cursor = r[0] + 1

    def end(self, symbol: str, since: int, most: int | None) -> int:
        """The cursor after the last row of the ``most`` next pages from ``since`` on that have any beyond it."""
        pages, cursor, taken = self.of(symbol), since, 0
        start = max((k for k, (first, _) in enumerate(pages) if first <= since), default=0)
        # Without a bound only the last pages are looked at.
        for _, path in pages[start:] if most else reversed(pages[start:]):
            last = max((r[0] + 1 for r in self.rows(path)), default=0)
            if last > cursor:
                cursor, taken = last, taken + 1
                if taken == (most or 1):
                    break
        return cursor


class SymbolPages(InputPartition):
    def __init__(self, symbol: str, since: int, until: int):
        self.symbol, self.since, self.until = symbol, since, until


class CandlePages(DataSource):
    """Options: path, since and until (milliseconds, until excluded), and for streams pagesPerBatch."""

    @classmethod
    def name(cls) -> str:
        return "candle_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PagesReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PagesStreamReader(self.options)


class PagesReader(DataSourceReader):
    """All rows there are now; a symbol ends with three empty pages."""

    def __init__(self, options):
        self.path = options["path"]
        self.since, self.until = int(options.get("since", 0)), int(options.get("until", END))

    def partitions(self) -> list[InputPartition]:
        return [SymbolPages(s, self.since, self.until) for s in Pages(self.path).symbols()]

    def read(self, partition: SymbolPages) -> Iterator[tuple]:
        yield from Pages(self.path).between(partition.symbol, partition.since, partition.until, EMPTY)


class PagesStreamReader(DataSourceStreamReader):
    """The offset is a cursor for each symbol: the time from which on its rows haven't been read.

    Cursors are kept in the query's checkpoint, so a restart goes on where it stopped, and symbols may appear at any time.
    """

    def __init__(self, options):
        self.path = options["path"]
        self.since, self.until = int(options.get("since", 0)), int(options.get("until", END))
        self.most = int(options["pagesPerBatch"]) if "pagesPerBatch" in options else None
        self.at: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        pages = Pages(self.path)
        self.at |= {s: min(self.until, pages.end(s, self.at.get(s, self.since), self.most)) for s in pages.symbols()}
        return dict(self.at)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        # After a restart the cursors of the checkpoint are the ones that count.
        self.at = {s: max(end[s], self.at.get(s, 0)) for s in end}
        return [SymbolPages(s, start.get(s, self.since), until) for s, until in sorted(end.items()) if until > start.get(s, self.since)]

    def read(self, partition: SymbolPages) -> Iterator[tuple]:
        yield from Pages(self.path).between(partition.symbol, partition.since, partition.until)

    def commit(self, end: dict) -> None:
        pass

"""Services that give their rows in pages by key, as a Spark data source for batches and streams.

A client is a function client(after, until, size, options) that gives up to size rows as dictionaries, those with a
key in (after, until], ascending; with size 0 it gives the least and greatest key there. A batch is read over key
ranges, each a task; conditions on the key narrow the ranges before a page is asked for. A stream's place is the
greatest key that it has seen, and each of its batches is read over ranges as well.
"""

from __future__ import annotations

import importlib
import json
import sys
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from larkspur.functions.shipping import ship

Client = Callable[[int, int, int, dict], list[dict]]


def http_pages(after: int, until: int, size: int, options: dict) -> list[dict]:
    """Pages of a JSON service: GET url?after=..&until=..&size=.. gives a list."""
    with urllib.request.urlopen(f"{options['url']}?{urllib.parse.urlencode({'after': after, 'until': until, 'size': size})}", timeout=60) as reply:
        return json.load(reply)


#: Pages that the stand-in reads at a time, if keys are dense, and what it has of the last range that was asked for.
WINDOW, HELD = 200, {}


def parquet_pages(after: int, until: int, size: int, options: dict) -> list[dict]:
    """A stand-in: pages of a Parquet table in the order of its key. Many pages are read at a time, so that a page does not cost a scan of its range."""
    store, at = pafs.FileSystem.from_uri(options["table"].replace("file:///", "/"))
    key, data = options["key"], pads.dataset(at, filesystem=store)
    inside = lambda a, b: (pc.field(key) > a) & (pc.field(key) <= b)
    if not size:
        ends = pc.min_max(data.to_table(filter=inside(after, until), columns=[key]).column(key)).as_py()
        return [{"least": ends["min"], "greatest": ends["max"]}]
    place, width = (options["table"], key, until), WINDOW * size
    while True:
        begin, end, rows = HELD.get(place, (0, 0, None))
        if rows is None or not begin <= after < end:
            begin, end = after, min(until, after + width)
            rows, width = data.to_table(filter=inside(begin, end)).sort_by(key), 8 * width
            HELD.clear()
            HELD[place] = begin, end, rows
        first = pc.sum(pc.less_equal(rows.column(key), after)).as_py() or 0
        if end >= until and first + size >= rows.num_rows:
            HELD.clear()  # the range is at its end: who asks again gets what is there then
        if first < rows.num_rows or end >= until:
            return rows.slice(first, size).to_pylist()
        after = end


#: Clients that go by their name alone.
CLIENTS = {"http": http_pages, "parquet": parquet_pages}


class Range(InputPartition):
    def __init__(self, after: int, until: int):
        super().__init__((after, until))
        self.after, self.until = after, until


def ranges(after: int, until: int, parts: int) -> list[Range]:
    """(after, until] in so many ranges of about equal width."""
    cuts = sorted({after + (until - after) * k // parts for k in range(parts + 1)})
    return [Range(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]


class Pages:
    """What batches and streams share: the client, and a range's rows page by page."""

    def __init__(self, schema: StructType, options: dict):
        self.names, self.options = schema.names, dict(options)
        self.key, self.size, self.parts = options["key"], int(options.get("size", 1000)), int(options.get("parts", 8))

    def client(self) -> Client:
        module, _, name = self.options["client"].partition(":")
        return getattr(importlib.import_module(module), name) if name else CLIENTS[module]

    def ends(self, after: int = -(1 << 62), until: int = 1 << 62) -> tuple[int, int] | None:
        """Least and greatest key within limits."""
        found = self.client()(after, until, 0, self.options)
        return (found[0]["least"], found[0]["greatest"]) if found and found[0]["least"] is not None else None

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        fetch, after = self.client(), partition.after
        while rows := fetch(after, partition.until, self.size, self.options):
            yield pa.RecordBatch.from_pylist([{c: r[c] for c in self.names} for r in rows])
            after = rows[-1][self.key]


class BatchReader(Pages, DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        super().__init__(schema, options)
        self.after, self.until = -(1 << 62), 1 << 62

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Conditions on the key become limits of the ranges; the others stay with Spark."""
        for f in filters:
            if getattr(f, "attribute", None) != (self.key,) or not isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, In, LessThan, LessThanOrEqual)):
                yield f
                continue
            least, greatest = (min(f.value), max(f.value)) if isinstance(f, In) else (f.value, f.value)
            if not isinstance(f, (LessThan, LessThanOrEqual)):
                self.after = max(self.after, least if isinstance(f, GreaterThan) else least - 1)
            if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.until = min(self.until, greatest - 1 if isinstance(f, LessThan) else greatest)
            if isinstance(f, In):
                yield f  # the range may hold others

    def partitions(self) -> list[Range]:
        found = self.ends(self.after, self.until) if self.after < self.until else None
        return ranges(found[0] - 1, found[1], self.parts) if found else [Range(0, -1)]


class StreamReader(Pages, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"last": int(self.options.get("after", -(1 << 62)))}

    def latestOffset(self) -> dict:
        """The greatest key of the service now; a key that is written later has to be a greater one."""
        found = self.ends()
        return {"last": found[1]} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Range]:
        found = self.ends(start["last"], end["last"])
        return ranges(found[0] - 1, found[1], self.parts) if found else [Range(0, -1)]


class PagedService(DataSource):
    """Options: client (http, parquet or module:function), key, size and parts, and those that the client reads; the schema is the caller's."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def reader(self, schema: StructType) -> BatchReader:
        return BatchReader(schema, self.options)

    def streamReader(self, schema: StructType) -> StreamReader:
        return StreamReader(schema, self.options)


def register(spark: SparkSession) -> None:
    """Make the format "paged" known to a session, with filters handed on to it."""
    ship(spark)
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # Spark plans a source in a process that has no package of its own
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedService)

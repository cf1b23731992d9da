"""Positioned page items as a data source: `spark.read.format("page_items").load(folder)` after `register(spark)`.

A folder of JSON lines, one item a line, as a page parser leaves them. A partition is a range of bytes of one file: it takes the lines
that begin in its range, so files of any size are read in parallel, and no line twice. Only the columns of the schema asked for are kept
(`.schema("doc_id STRING, page INT, text STRING")`); a line that is no item gives none, or fails with mode FAILFAST.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from readlake.schemas import LAKE

RANGE = 8 << 20
BATCH = 4096


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


def ranges(path: str, size: int) -> list[Range]:
    """The byte ranges of a file, or of all files below a folder whose names do not begin with `_` or `.`."""
    store, at = _opened(path)
    info = store.get_file_info(at)
    found = store.get_file_info(fs.FileSelector(at, recursive=True)) if info.type == fs.FileType.Directory else [info]
    files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._")
    prefix = path.split("://", 1)[0] + "://" if "://" in path else ""
    return [Range(prefix + p, a, min(n, a + size)) for p, n in files for a in range(0, n, size)]


def lines(part: Range) -> Iterator[bytes]:
    """The lines that begin in a range."""
    store, at = _opened(part.path)
    with store.open_input_file(at) as f, pa.PythonFile(f, mode="r") as raw:
        begin = max(part.start - 1, 0)
        raw.seek(begin)
        held, place = b"", begin
        # From the byte before: what ends there is a line of the range before.
        skip = part.start > 0
        while True:
            end = held.find(b"\n")
            if end < 0:
                more = raw.read(1 << 20)
                if more:
                    held += more
                    continue
                if held and not skip and place < part.end:
                    yield held
                return
            if not skip:
                if place >= part.end:
                    return
                yield held[:end]
            skip, place, held = False, place + end + 1, held[end + 1 :]


class PageItemsReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path = schema, options["path"]
        self.size, self.strict = int(options.get("rangeBytes", RANGE)), options.get("mode", "").upper() == "FAILFAST"

    def partitions(self) -> list[Range]:
        return ranges(self.path, self.size) or [Range(self.path, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.end == 0:
            return
        shape = to_arrow_schema(self.schema)
        held: list[dict] = []
        for line in lines(part):
            try:
                row = json.loads(line)
                if not isinstance(row, dict):
                    raise ValueError("a line is no item")
            except ValueError:
                if self.strict:
                    raise
                continue
            held.append({n: row.get(n) for n in shape.names})
            if len(held) == BATCH:
                yield pa.RecordBatch.from_pylist(held, schema=shape)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=shape)


class PageItems(DataSource):
    @classmethod
    def name(cls) -> str:
        return "page_items"

    def schema(self) -> str:
        return LAKE["page_items"]

    def reader(self, schema: StructType) -> PageItemsReader:
        return PageItemsReader(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PageItems)

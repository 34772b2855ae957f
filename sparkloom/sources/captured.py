"""Captured output of processes as a data source: a folder of files, one JSON document each.

    spark.dataSource.register(CapturedOutput)
    spark.read.format("captured_output").schema("id string, fields array<struct<label:string>>").load(folder)

Files are dealt over partitions by size and read where a partition runs, through Arrow's file systems (local and shared
folders, HDFS, S3); the folder has to be one that every executor reaches.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime

from pyarrow import fs
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_SCALARS = {T.StringType: (str,), T.BooleanType: (bool,), T.LongType: (int,), T.IntegerType: (int,), T.DoubleType: (int, float)}


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it. `file:` with one slash is local too."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = f"file://{path[5:]}"
    return fs.FileSystem.from_uri(path)


def typed(value: object, kind: T.DataType, at: str) -> object:
    """A JSON value as a value of a Spark type; one of another type raises. Fields that a struct doesn't name are left out,
    missing ones are null."""
    if value is None:
        return None
    if isinstance(kind, T.StructType) and isinstance(value, dict):
        return tuple(typed(value.get(f.name), f.dataType, f"{at}.{f.name}") for f in kind)
    if isinstance(kind, T.ArrayType) and isinstance(value, list):
        return [typed(x, kind.elementType, f"{at}.{i}") for i, x in enumerate(value)]
    if isinstance(kind, T.MapType) and isinstance(value, dict):
        return {k: typed(x, kind.valueType, f"{at}.{k}") for k, x in value.items()}
    if isinstance(kind, (T.TimestampType, T.DateType)) and isinstance(value, str):
        return date.fromisoformat(value) if isinstance(kind, T.DateType) else datetime.fromisoformat(value)
    scalars = _SCALARS.get(type(kind), ())
    if isinstance(value, scalars) and (bool in scalars or not isinstance(value, bool)):
        return float(value) if isinstance(kind, T.DoubleType) else value
    raise ValueError(f"{at}: {type(value).__name__} is no {kind.simpleString()}")


@dataclass
class _Files(InputPartition):
    paths: list[str]


class CapturedOutput(DataSource):
    """A row a file. Options: path; partition_bytes, how much a partition reads (8 MiB); mode, `failfast` (a malformed or
    mistyped document raises, with its path) or `permissive` (it gives a row of nulls). A schema of (path, value) strings,
    which is used when none is given, takes the texts as they are. A folder that isn't there has no rows."""

    @classmethod
    def name(cls) -> str:
        return "captured_output"

    def schema(self) -> str:
        return "path string, value string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(schema, self.options)


class _Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]) -> None:
        self.schema, self.path = schema, options["path"]
        self.size = int(options.get("partition_bytes", 8 << 20))
        self.strict = options.get("mode", "failfast").lower() == "failfast"

    def partitions(self) -> list[_Files]:
        files, base = opened(self.path)
        found = files.get_file_info(fs.FileSelector(base, allow_not_found=True, recursive=True))
        out, room = [], 0
        for info in sorted((i for i in found if i.type == fs.FileType.File and not i.base_name.startswith((".", "_"))), key=lambda i: i.path):
            if not out or room < info.size:
                out.append(_Files([]))
                room = self.size
            out[-1].paths.append(info.path)
            room -= info.size
        return out or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        files, _ = opened(self.path)
        raw = [f.name for f in self.schema] == ["path", "value"]
        for path in partition.paths:
            with files.open_input_stream(path) as stream:
                text = stream.read().decode("utf-8")
            if raw:
                yield path, text
                continue
            try:
                document = json.loads(text)
                if not isinstance(document, dict):
                    raise ValueError(f"{type(document).__name__} is no object")
                row = typed(document, self.schema, "")
            except ValueError as e:
                if self.strict:
                    raise ValueError(f"{path}: {e}") from e
                row = (None,) * len(self.schema)
            yield row

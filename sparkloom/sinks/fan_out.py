"""Rows as text files, one a row: a data source that writes (path, text).

    spark.dataSource.register(TextFiles)
    df.write.format("text_files").mode("append").save(folder)

Tasks write to a staging folder of their own; when all have succeeded, the driver moves their files into place and drops what
is left, so a task that is tried again, or that runs twice, leaves no doubles. A failed job leaves the folder as it was.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Row
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from sparkloom.sources.captured import opened

STAGING = "_staging"


@dataclass
class _Written(WriterCommitMessage):
    folder: str


class TextFiles(DataSource):
    """Columns path (relative to the folder) and text; a null text is empty. Mode `overwrite` drops the folder's other files
    when the new ones are published. Paths that leave the folder, or that two rows have, raise. The driver moves every
    file, as Spark's own committers do: for many thousands of files, not for a table's rows."""

    @classmethod
    def name(cls) -> str:
        return "text_files"

    def schema(self) -> str:
        return "path string, text string"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        if [f.name for f in schema] != ["path", "text"]:
            raise ValueError(f"path and text are written, not {schema.simpleString()}")
        return _Writer(self.options["path"], overwrite)


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> _Written:
        files, base = opened(self.path)
        own = f"{base}/{STAGING}-{self.job}/{uuid.uuid4().hex}"
        files.create_dir(own, recursive=True)
        seen: set[str] = set()
        for path, text in rows:
            clean = posixpath.normpath(path or "")
            if clean.startswith(("/", "..")) or clean == "." or clean.split("/")[0].startswith(STAGING):
                raise ValueError(f"path outside the folder: {path}")
            if clean in seen:
                raise ValueError(f"written twice: {clean}")
            seen.add(clean)
            files.create_dir(posixpath.dirname(f"{own}/{clean}"), recursive=True)
            with files.open_output_stream(f"{own}/{clean}") as out:
                out.write((text or "").encode("utf-8"))
        return _Written(own)

    def commit(self, messages: list[_Written | None]) -> None:
        files, base = opened(self.path)
        staged = [(i.path, i.path[len(m.folder) + 1 :]) for m in messages if m for i in files.get_file_info(fs.FileSelector(m.folder, recursive=True)) if i.type == fs.FileType.File]
        targets = [t for _, t in staged]
        if len(set(targets)) < len(targets):
            self.abort(messages)
            raise ValueError(f"written twice: {sorted(t for t in set(targets) if targets.count(t) > 1)[0]}")
        if self.overwrite:
            for i in files.get_file_info(fs.FileSelector(base)):
                if not i.base_name.startswith(STAGING):
                    files.delete_dir(i.path) if i.type == fs.FileType.Directory else files.delete_file(i.path)
        for source, target in staged:
            files.create_dir(posixpath.dirname(f"{base}/{target}"), recursive=True)
            files.move(source, f"{base}/{target}")
        self.abort(messages)

    def abort(self, messages: list[_Written | None]) -> None:
        """Drop what was staged."""
        files, base = opened(self.path)
        if files.get_file_info(f"{base}/{STAGING}-{self.job}").type == fs.FileType.Directory:
            files.delete_dir(f"{base}/{STAGING}-{self.job}")

"""File sources: rule documents, JSON documents, lines of captured output."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.text import path_matches
from sparkloom.functions.validate import json_strict

WHOLE = "path string, value string"


def files_by_glob(spark: SparkSession, directory: str, globs: Sequence[str], recursive: bool = True) -> DataFrame:
    """(path, value) of a directory's files whose paths end in one of the globs and in none of those after a `!`."""
    options = {"wholetext": True, "recursiveFileLookup": recursive}
    try:
        got = spark.read.options(**options).text(directory)
    except AnalysisException:
        return spark.createDataFrame([], WHOLE)
    return got.select(F.col("_metadata.file_path").alias("path"), "value").where(path_matches(F.col("path"), globs))


def whole_files(spark: SparkSession, directory: str, pattern: str = "*", exclude: str | None = None) -> DataFrame:
    """(path, value) of the files right in a directory; none if it isn't there.

    `exclude` is a regular expression on the path."""
    try:
        got = spark.read.option("pathGlobFilter", pattern).text(directory, wholetext=True)
    except AnalysisException:
        return spark.createDataFrame([], WHOLE)
    out = got.select(F.col("_metadata.file_path").alias("path"), "value")
    return out.where(~F.col("path").rlike(exclude)) if exclude else out


def rule_files(spark: SparkSession, directory: str) -> DataFrame:
    return whole_files(spark, directory, "*.mdc")


def json_document(spark: SparkSession, path: str, schema: T.StructType | str, comments: bool = False) -> DataFrame:
    """One row of a JSON file, with comments if they are allowed; a mistyped field raises."""
    return spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST", allowComments=comments)


def captured_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A row for each file that holds a process's output, one JSON document; malformed and mistyped ones raise."""
    got = spark.read.text(path, wholetext=True)
    return got.select(json_strict(F.col("value"), schema).alias("d")).select("d.*")


def output_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line) of captured process output, without empty lines."""
    return spark.read.text(path).select(F.col("value").alias("line")).where("line <> ''")


def find_upwards(start: str, marker: str) -> str | None:
    """The nearest file of that name in a directory or above it."""
    for folder in [Path(start).resolve(), *Path(start).resolve().parents]:
        if (folder / marker).exists():
            return str(folder / marker)
    return None

"""The folder that the driver and all executors share, and small files in it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}  # of local sessions that name no folder, by application


def shared_dir(spark: SparkSession) -> str:
    """This application's part of the folder in spark.checkpoint.dir. A local session may leave that unset: it then has a
    temporary folder of its own; elsewhere executors would write to their own disks, so it raises."""
    app = spark.sparkContext.applicationId
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: no folder that driver and executors share")
        at = _OWN.setdefault(app, "")
        at = _OWN[app] = at or tempfile.mkdtemp(prefix="sparkloom-")
    return f"{at.rstrip('/')}/sparkloom-{app}"


def new_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: its lineage is short and outlives executors."""
    path = new_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def together(tables: Sequence[DataFrame]) -> DataFrame:
    """Tables of one schema that stored() gave, as one table: one scan of all their files, however many tables they are."""
    paths = dict.fromkeys(f.rsplit("/", 1)[0] for t in tables for f in t.inputFiles())
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*paths)


def dealt(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """df over a task for each so many rows, and over all cores at least: costly steps on a table of few bytes would otherwise
    run in the one or two tasks that read it. df is counted first, so it must be cheap to read twice."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows)))


def told_apart(df: DataFrame, rows: int = 250_000) -> DataFrame:
    """Distinct rows of df, with about so many in a task, whatever their size on disk; df must be cheap to read twice."""
    pieces = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(pieces, *df.columns).distinct()


def write_files(spark: SparkSession, directory: str, files: Mapping[str, str]) -> str:
    """Small text files by name (which may have folders), through Spark's own file systems; the directory."""
    for name, content in files.items():
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{directory}/{name}")
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
        try:
            out.write(bytearray(content, "utf-8"))
        finally:
            out.close()
    return directory

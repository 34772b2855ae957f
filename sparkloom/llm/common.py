"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.sources.shared import new_dir, shared_dir

#: A word: a run of code points outside these ASCII ranges, after A-Z are lower-cased.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: short lineage that outlives executors."""
    spark = df.sparkSession
    path = new_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete what cut() wrote in this application; results that still read it must be written first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def words(text: Column) -> Column:
    """Array of the words of text; null has none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lowered, NOT_WORD, -1), lambda w: w != "")


def aside(df: DataFrame) -> tuple[DataFrame, dict[str, str], dict[str, str]]:
    """df with other names for the columns that begin with `__`, as the operators' own do, and these names by the old ones and
    the other way round."""
    taken = {c.lower() for c in df.columns}
    new = {c: next(x for x in (f"kept{'_' * i}{c}" for i in range(len(taken) + 1)) if x.lower() not in taken) for c in df.columns if c.startswith("__")}
    return df.withColumnsRenamed(new), new, {v: k for k, v in new.items()}


def last_within(rows: list, most: dict) -> dict:
    """From (class, digest, bytes), the last digest of each class before which there are less than most[class] bytes."""
    last, before = {}, dict.fromkeys(most, 0)
    for y, digest, size in sorted(map(tuple, rows)):
        if before[y] < most[y]:
            last[y] = digest
        before[y] += size
    return last


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the table that cut() wrote for df; 0 for other DataFrames."""
    spark = df.sparkSession
    files = [f for f in df.inputFiles() if "/sparkloom-" in f]
    if not files:
        return 0
    path = spark._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def is_small(df: DataFrame, max_rows: int = 200_000, max_bytes: int = 32 << 20) -> bool:
    """Whether the table is known to have at most max_rows rows and max_bytes stored bytes.

    df must be cheap to read twice (the result of cut())."""
    return stored_bytes(df) <= max_bytes and df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = 200_000, max_bytes: int = 32 << 20) -> DataFrame:
    """Hint a broadcast only if is_small(); else leave the join to a shuffle."""
    return F.broadcast(df) if is_small(df, max_rows, max_bytes) else df


#: A key is hot if it holds more than one in so many rows; so there are fewer hot keys than this.
HOT = 1000


def salted_join(rows: DataFrame, table: DataFrame, on: str | Sequence[str], salts: int = 16) -> DataFrame:
    """rows joined with a table by some columns: by broadcast if the table is small, else by a shuffle in which a key's
    rows are dealt over `salts` partitions by their digest, and the table's are repeated there."""
    on = [on] if isinstance(on, str) else [*on]
    if is_small(table):
        return rows.join(F.broadcast(table), on)
    dealt = rows.withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int"))
    each = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(each, [*on, "__salt"]).drop("__salt")


def keyed_join(rows: DataFrame, table: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with a table that has one row a key; both are cheap to read twice (results of cut()).

    A small table is broadcast. Otherwise the table's rows of hot keys are, fewer than HOT, and all other rows are
    shuffled: no task gets more than one in HOT of the rows with one key."""
    if is_small(table):
        return rows.join(F.broadcast(table), [*on], how)
    if is_small(rows):
        return rows.join(table, [*on], how)
    counted = rows.groupBy(*on).agg(F.count("*").alias("__n"))
    hot = F.broadcast(cut(counted.where(F.col("__n") > rows.count() / HOT).drop("__n")))
    held = broadcast_if_small(cut(table.join(hot, [*on], "left_semi")))
    return rows.join(hot, [*on], "left_semi").join(held, [*on], how).unionByName(rows.join(hot, [*on], "left_anti").join(table, [*on], how))

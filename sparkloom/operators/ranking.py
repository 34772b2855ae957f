"""Places of rows in a global order, without one task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.sources.shared import stored


def locale_order(column: str) -> list[Column]:
    """The order of a locale-independent collation; what it holds for equal, by code points."""
    return [F.collate(F.col(column), "UNICODE").asc(), F.col(column).asc()]


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "place", partitions: int | None = None) -> DataFrame:
    """df with each row's place, from 1, in an order over all rows; equal rows have different places, in no stated order.

    Sampled splitters deal the rows over partitions by range, each partition sorts and numbers its own (JVM only), and the
    rows of the partitions before are added. One count a partition goes through the driver. With at most a few rows of each
    value of the order, partitions are even; add columns to the order where one value has many."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = fresh_name("at", df.columns)
    piece = F.shiftright(F.col(own), 33).cast("int")  # the upper bits are the partition, the lower the row's number in it
    numbered = stored(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(own, F.monotonically_increasing_id()))
    counts = sorted((r.piece, r.n) for r in numbered.groupBy(piece.alias("piece")).agg(F.count("*").alias("n")).collect())
    before = [0, *accumulate(c for _, c in counts)]
    key, ahead = fresh_name("piece", df.columns), fresh_name("before", df.columns)
    offsets = spark.createDataFrame([(p, b) for (p, _), b in zip(counts, before, strict=False)], f"`{key}` int, `{ahead}` long")  # a row a partition
    placed = numbered.join(F.broadcast(offsets), piece == F.col(key))
    return placed.select(*(numbered[c] for c in df.columns if c != name), (F.col(ahead) + F.col(own).bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias(name))


def fresh_name(name: str, taken: Sequence[str]) -> str:
    """name, or with a number after it, whatever no column has."""
    lowered = {c.lower() for c in taken}
    return next(x for x in (f"{name}{i or ''}" for i in range(len(lowered) + 1)) if x not in lowered)

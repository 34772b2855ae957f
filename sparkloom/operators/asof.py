"""As-of search: for each row the last mark of its key at or before a moment, or the first at or after it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.sources.shared import stored


def as_of(rows: DataFrame, marks: DataFrame, key: str = "key", at: str = "at", value: str = "value", forward: bool = False, found: str = "found", partitions: int | None = None) -> DataFrame:
    """rows with `found`: the value of the mark (key, at, value) with the row's key and the largest `at` up to the row's; with
    forward, the smallest from the row's on. Null where there is none. `at` is a whole number; marks are unique by key and
    at. A null key or `at` finds nothing, and is not found.

    Rows and marks are dealt together by ranges of (key, at), so the rows of one key lie in as many partitions as they need.
    A partition looks among its own marks; for the one key that it shares with those before it, the last mark before its
    range is added: a row a partition, which is broadcast. All of it is built-in expressions."""
    spark = rows.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.col(at).cast("long")
    place = -place if forward else place
    kept = F.struct(*(F.col(c) for c in rows.columns)).alias("row")
    mark = marks.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("key"), place.alias("at"), F.lit(0).alias("asks"), F.lit(None).cast(rows.select(kept).schema["row"].dataType).alias("row"), F.struct(F.col(value).alias("v")).alias("mark"))
    asks = rows.select(F.col(key).alias("key"), place.alias("at"), F.lit(1).alias("asks"), kept, F.lit(None).cast(mark.schema["mark"].dataType).alias("mark"))
    dealt = stored(mark.unionByName(asks).repartitionByRange(n, "key", "at").withColumn("piece", F.spark_partition_id()))
    so_far = Window.partitionBy("piece", "key").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0)
    near = dealt.withColumn("mark", F.last("mark", ignorenulls=True).over(so_far)).where("asks = 1")
    last = dealt.groupBy("key", "piece").agg(F.max_by("mark", F.when(F.col("mark").isNotNull(), F.col("at"))).alias("mark"))
    before = Window.partitionBy("key").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)  # over a key's pieces
    carried = stored(last.select("key", "piece", F.last("mark", ignorenulls=True).over(before).alias("carried")).where("carried IS NOT NULL"))
    whole = near.join(F.broadcast(carried), ["key", "piece"], "left")  # no more rows than pieces: only a piece's first key goes on from another
    return whole.select("row.*", F.coalesce("mark", "carried")["v"].alias(found))

"""What differs between two versions of a table, by a tree of digests over key ranges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.operators.ranking import fresh_name
from sparkloom.sources.shared import stored

#: A node of the tree covers so many ranges of the level below, as a power of two.
FANOUT = 4
_NO_KEY = -(1 << 62)


def key_range(df: DataFrame, key: str, width: int) -> Column:
    """The range that a row's key is in: of so many whole numbers, or, for other keys, of so many 2^-44 parts of the keys'
    hashes. Null keys have one range."""
    whole = isinstance(df.schema[key].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    number = F.col(key).cast("long") if whole else F.shiftright(F.xxhash64(key), 20)
    return F.when(F.col(key).isNull(), F.lit(_NO_KEY)).otherwise(F.floor(number / width)).cast("long")


def _digest(columns: list[str]) -> list[Column]:
    """Two sums of the rows' hashes, which tell null from missing and one row from two."""
    cells = [x for c in columns for x in (F.col(c), F.col(c).isNull())]
    return [F.sum(F.xxhash64(F.lit(i), *cells).cast("decimal(20,0)")).alias(f"digest{i}") for i in range(2)]


def digest_tree(df: DataFrame, key: str, width: int = 1 << 16, levels: int = 4) -> DataFrame:
    """(level, node, n, digest0, digest1): rows and digests of each key range (level 0), and of 16 nodes of the level below in
    each node above. One pass over the table, with partial sums; the tree, as large as there are ranges, is written to the
    shared folder and can be kept, so that a version need not be read again to be compared."""
    level = stored(df.groupBy(key_range(df, key, width).alias("node")).agg(F.count("*").alias("n"), *_digest(df.columns)))
    out = []
    for i in range(levels):
        out.append(level.select(F.lit(i).alias("level"), "node", "n", "digest0", "digest1"))
        level = level.groupBy(F.shiftright("node", FANOUT).alias("node")).agg(*(F.sum(c).alias(c) for c in ("n", "digest0", "digest1")))
    return stored(reduce(DataFrame.unionByName, out))


def differing_ranges(old: DataFrame, new: DataFrame) -> DataFrame:
    """(node) of the key ranges in which two trees differ: from the top, only below nodes that differ. Two versions of a range
    that differ pass as equal where both 64-bit sums agree, which has odds of about 2^-128."""
    top = max(old.agg(F.max("level")).first()[0] or 0, new.agg(F.max("level")).first()[0] or 0)
    above = None
    for i in range(top, -1, -1):
        a, b = (t.where(F.col("level") == i).select("node", F.struct("n", "digest0", "digest1").alias(s)) for t, s in ((old, "a"), (new, "b")))
        if above is not None:
            a, b = (t.withColumn("up", F.shiftright("node", FANOUT)).join(above, "up", "left_semi").drop("up") for t in (a, b))
        nodes = stored(a.join(b, "node", "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("node"))
        above = nodes.withColumnRenamed("node", "up")
    return nodes


def changes(old: DataFrame, new: DataFrame, key: str, width: int = 1 << 16, levels: int = 4, ranges: DataFrame | None = None) -> DataFrame:
    """(key, change) of every key whose rows differ: added, removed or changed. Columns are taken by name and must be the same.

    Only rows in ranges that differ are compared, in one aggregation; `ranges` (node) may come from trees that were kept. Rows
    may repeat: a key is changed if each version has rows that the other lacks, or has more often."""
    new = new.select(*old.columns)
    if ranges is None:
        ranges = differing_ranges(digest_tree(old, key, width, levels), digest_tree(new, key, width, levels))
    own = fresh_name("range", old.columns)
    sides = [t.withColumn(own, key_range(t, key, width)).join(ranges.withColumnRenamed("node", own), own, "left_semi").select(F.struct(*old.columns).alias("row"), F.lit(s).alias("sign")) for t, s in ((old, -1), (new, 1))]
    left = sides[0].unionByName(sides[1]).groupBy("row").agg(F.sum("sign").alias("more")).where("more <> 0")
    by_key = left.groupBy(F.col("row")[key].alias(key)).agg(F.bool_or(F.col("more") > 0).alias("added"), F.bool_or(F.col("more") < 0).alias("removed"))
    return by_key.select(key, F.when(F.col("added") & F.col("removed"), "changed").when(F.col("added"), "added").otherwise("removed").alias("change"))

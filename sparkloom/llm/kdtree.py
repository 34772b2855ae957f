"""Sharding by a K-d tree over document metadata.

Rows are points: size-independent numbers for each metadata dimension, and a weight in bytes. A node that is over the
target splits at the weighted median of its widest dimension, and so on until no leaf is over the target by more than a
row (or, where a number of leaves is asked for, until there are so many). Widths are shares of the whole range of a dimension.

The medians are found by counting, not sorting: all open nodes of a level at once, bytes by node and bin of the widest
dimension, then the bin that crosses the middle again in finer bins, until a bin holds a single value. Rows that tie in
the value (a hot source, say) are split by a digest of the row, refined in the same way, so leaves come out equal
however many rows share a value. Counts are aggregated before they are shuffled; a level's histograms have about ALL_BINS
rows together and are searched where they are. One aggregation tells sizes and extents of all new nodes. The driver sees
node bounds only, a few numbers for each leaf; they go to the rows by a broadcast join, and by a shuffled one if there are
more than MOST_SENT.

Slots number the rows of a shard without gaps: rows are dealt into buckets by digest, buckets counted, and only the
offsets of the buckets are summed up; no shard is ever in one task. Rows that are equal in everything are told apart by
the partition of the stored points that they come from.

Defined results: null metadata sort first; null text has no bytes, and size is bytes + 1. Text dimensions are the ranks of
their whole values, fractions 2^60 equal steps of their range. An empty table has no rows and no shards. Extra columns are not read. Repeated rows each get their row;
rows that are equal in all dimensions and in digest stay in one leaf. With target_bytes a leaf has at most the target and one row more, or only rows that no split divides.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import cut, is_small, keyed_join, table
from sparkloom.operators.ranking import global_rank

BINS, ALL_BINS, LEAST_BINS = 1 << 18, 1 << 20, 256  # a node, all nodes of a level together, and a node in any case
MOST_SENT = 200_000  # nodes whose bounds are broadcast
LEVELS = 4  # between tables written to the shared folder
BUCKET_ROWS = 2000
TIE_BITS = 36
LIMIT = 1 << 61  # numbers beyond it tie, so that differences fit in 64 bits


@dataclass
class Node:
    path: int  # 1, then a bit for each split: left 0, right 1
    bytes: int
    rows: int
    extents: list[tuple[int, int]]
    leaves: int
    axis: int = -1
    value: int = 0  # left: value < this, or equal and tie < the bound
    tie: int = 0


def _ranked(rows: DataFrame, column: str) -> DataFrame:
    """rows (read from storage) with a text column as ranks of its distinct values, by code points; null is 0.

    A few values are ranked in one task, of a size that is counted first; more of them by ranges of values."""
    some = F.col(column).isNotNull()
    values = cut(rows.select(column).where(some).distinct())
    if is_small(values):
        ranks = values.withColumn("__rank", F.row_number().over(Window.orderBy(column)).cast("long"))
    else:
        ranks = global_rank(values, [F.col(column).asc()], "__rank")
    known = keyed_join(rows.where(some), cut(ranks), [column]).withColumn(column, F.col("__rank")).select(*rows.columns)
    return known.unionByName(rows.where(~some).withColumn(column, F.lit(0).cast("long")))


def _scaled(rows: DataFrame, column: str) -> Column:
    """Fractions and floats as 2^60 equal steps between the least and the greatest finite value; null and NaN are least,
    infinities tie with the ends."""
    x = F.col(column).cast("double") / 2  # so that differences are finite
    finite = F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
    ends = rows.agg(F.min(finite).alias("low"), F.max(finite).alias("high")).first()  # two numbers
    low, wide = ends.low or 0.0, ((ends.high or 0.0) - (ends.low or 0.0)) or 1.0
    share = F.least(F.greatest((x - low) / wide, F.lit(0.0)), F.lit(1.0))
    return F.when(x.isNull() | F.isnan(x), -1).otherwise(F.floor(share * float(1 << 60))).cast("long")


def points(docs: DataFrame, dims: tuple[str, ...], size: Column, keep: tuple[Column, ...]) -> DataFrame:
    """keep, size, tie and d0, d1, ...: order-keeping whole numbers of the dimensions."""
    kinds = [docs.schema[d].dataType for d in dims]
    tie = F.shiftrightunsigned(F.xxhash64(*keep), 64 - TIE_BITS)
    rows = docs.select(*keep, size.alias("size"), tie.alias("tie"), *(F.col(d).alias(f"d{k}") for k, d in enumerate(dims)))
    if any(isinstance(k, (T.StringType, T.FractionalType)) for k in kinds):
        rows = cut(rows)  # read several times
    for k, kind in enumerate(kinds):
        c = f"d{k}"
        if isinstance(kind, T.StringType):
            rows = _ranked(rows, c)
        elif isinstance(kind, T.FractionalType):
            rows = rows.withColumn(c, _scaled(rows, c))
        else:  # greatest and least skip nulls, so null is told first
            whole = F.least(F.greatest(F.col(c).cast("long"), F.lit(-LIMIT)), F.lit(LIMIT))
            rows = rows.withColumn(c, F.when(F.col(c).isNull(), -LIMIT - 1).otherwise(whole))
    return rows


def _known(df: DataFrame, rows: list[tuple], names: tuple[str, ...]) -> DataFrame:
    """df with numbers that are known of each row's node (its path and one for each name); null for other nodes."""
    if [r[0] for r in rows] == [1]:  # all rows are the root's
        return df.select("*", *(F.lit(x).cast("long").alias(name) for name, x in zip(names, rows[0][1:], strict=True)))
    nodes = df.sparkSession.createDataFrame(rows, ", ".join(f"{c} bigint" for c in ("path", *names)))
    return df.join(F.broadcast(nodes) if len(rows) <= MOST_SENT else nodes, "path", "left")


def _along(n_dims: int) -> Column:
    """The row's number on its node's axis."""
    value = F.lit(None).cast("long")
    for k in range(n_dims):
        value = F.when(F.col("axis") == k, F.col(f"d{k}")).otherwise(value)
    return value


def _place(df: DataFrame, nodes: list[Node], n_dims: int) -> DataFrame:
    """Rows one level down: path of each row's child node; rows of closed nodes keep theirs."""
    known = _known(df, [(n.path, n.axis, n.value, n.tie) for n in nodes], ("axis", "split_at", "tie_at"))
    value = _along(n_dims)
    right = (value > F.col("split_at")) | ((value == F.col("split_at")) & (F.col("tie") >= F.col("tie_at")))
    return known.withColumn("path", F.when(F.col("axis").isNull(), F.col("path")).otherwise(F.col("path") * 2 + right.cast("long"))).drop("axis", "split_at", "tie_at")


def _crossing(df: DataFrame, lows: dict[int, int], highs: dict[int, int], goals: dict[int, int]) -> dict[int, tuple[int, int]]:
    """For each path, the least v with sum of size over column v <= v at least the goal, and the bytes below v."""
    below = dict.fromkeys(lows, 0)
    lows, highs = dict(lows), dict(highs)
    order = Window.partitionBy("path").orderBy("bin")
    bins = max(LEAST_BINS, min(BINS, ALL_BINS // max(1, len(lows))))
    while todo := [p for p in lows if lows[p] < highs[p]]:
        width = {p: max(1, -((lows[p] - highs[p] - 1) // bins)) for p in todo}
        bounds = [(p, lows[p], highs[p], width[p], goals[p] - below[p]) for p in todo]
        counts = _known(df, bounds, ("low", "high", "wide", "goal")).where("v BETWEEN low AND high")
        counts = counts.groupBy("path", "goal", F.expr("(v - low) div wide").alias("bin")).agg(F.sum("size").alias("bytes"))
        summed = counts.withColumn("upto", F.sum("bytes").over(order)).where("upto >= goal")
        first = summed.groupBy("path").agg(F.min(F.struct("bin", (F.col("upto") - F.col("bytes")).alias("under"))).alias("x"))
        found = {r.path: r.x for r in first.collect()}  # a row a node
        for p in todo:
            if p in found:
                below[p] += found[p].under
                lows[p], highs[p] = lows[p] + found[p].bin * width[p], min(highs[p], lows[p] + (found[p].bin + 1) * width[p] - 1)
            else:
                lows[p] = highs[p]
    return {p: (lows[p], below[p]) for p in lows}


def _nodes(df: DataFrame, n_dims: int, among: list[int]) -> dict[int, tuple[int, int, int, list[tuple[int, int]]]]:
    """Bytes, largest row, rows and extents of the nodes among these paths that have rows."""
    extent = [f(f"d{k}").alias(f"{f.__name__}{k}") for k in range(n_dims) for f in (F.min, F.max)]
    open_rows = _known(df, [(p, 1) for p in among], ("open",)).where("open = 1")
    sums = open_rows.groupBy("path").agg(F.sum("size").alias("bytes"), F.max("size").alias("largest"), F.count("*").alias("rows"), *extent)
    return {r.path: (r.bytes, r.largest, r.rows, [(r[f"min{k}"], r[f"max{k}"]) for k in range(n_dims)]) for r in sums.collect()}  # a row a node


def tree(df: DataFrame, n_dims: int, leaves: int | None = None, target_bytes: int | None = None) -> tuple[DataFrame, list[int], int]:
    """df (read from storage) with the path of each row's leaf, the paths in order, and the number of rows. Either `leaves`
    (shares as equal as can be) or `target_bytes` says where to stop."""
    df = df.withColumn("path", F.lit(1).cast("long"))
    found = _nodes(df, n_dims, [1])
    if not found:
        return df, [1], 0
    size, largest, total, extents = found[1]
    wanted = lambda size, largest: max(1, -(-(size - largest) // (target_bytes or 1)))  # noqa: E731  a leaf is done at the target and a row
    whole = [max(1, b - a) for a, b in extents]
    going = [Node(1, size, total, extents, leaves or wanted(size, largest))]
    done: list[int] = []
    level = 0
    while going:
        done += [n.path for n in going if n.leaves <= 1]
        going = [n for n in going if n.leaves > 1]
        if not going:
            break
        low, high, goal = {}, {}, {}
        for n in going:
            n.axis = max(range(n_dims), key=lambda k: ((n.extents[k][1] - n.extents[k][0]) / whole[k], -k))  # noqa: B023
            low[n.path], high[n.path] = n.extents[n.axis]
            goal[n.path] = max(1, n.bytes * (n.leaves // 2) // n.leaves)
        valued = _known(df, [(n.path, n.axis) for n in going], ("axis",)).where("axis IS NOT NULL").select("path", "size", "tie", _along(n_dims).alias("v"))
        medians = _crossing(valued, low, high, goal)
        for n in going:
            n.value = medians[n.path][0]
        tied = _known(valued, [(n.path, n.value) for n in going], ("split_at",)).where("v = split_at")
        ties = _crossing(tied.select("path", "size", F.col("tie").alias("v")), dict.fromkeys(low, 0), dict.fromkeys(low, (1 << TIE_BITS) - 1), {p: max(1, goal[p] - medians[p][1]) for p in low})
        for n in going:
            n.tie = ties[n.path][0] + 1  # the row that crosses the goal goes left
        df = _place(df, going, n_dims)
        level += 1
        if level % LEVELS == 0 or len(going) > MOST_SENT:
            df = cut(df)
        found = _nodes(df, n_dims, [2 * n.path + side for n in going for side in (0, 1)])
        ahead = []
        for n in going:
            for side in (0, 1):
                size, largest, rows, extents = found.get(2 * n.path + side, (0, 0, 0, [(0, 0)] * n_dims))
                if leaves:
                    share = n.leaves // 2 if side == 0 else n.leaves - n.leaves // 2
                else:
                    share = wanted(size, largest) if rows < n.rows else 1  # what no split divides stays
                if rows or leaves:
                    ahead.append(Node(2 * n.path + side, size, rows, extents, share if rows else 1))
        going = ahead
    return df, sorted(done, key=lambda p: bin(p)[3:]), total


def with_slots(df: DataFrame, group: str, digest: str, rows: int) -> DataFrame:
    """df (made from storage without a shuffle) with `slot`: gapless numbers from 0 in each group. It has about so many rows."""
    buckets = max(1, rows // BUCKET_ROWS)
    # the stored file's place tells equal rows apart, so even a hot row is spread
    df = cut(df.withColumn("__bucket", F.pmod(F.xxhash64(digest, F.spark_partition_id()), F.lit(buckets))))
    counts = df.groupBy(group, "__bucket").agg(F.count("*").alias("n"))
    spread = cut(counts.withColumn("part", F.floor(F.col("__bucket") / BUCKET_ROWS)))
    parts = spread.groupBy(group, "part").agg(F.sum("n").alias("n"))
    before_part = F.coalesce(F.sum("n").over(_w(group, order="part", before=True)), F.lit(0))
    parts = parts.select(group, "part", before_part.alias("before_part"))
    inside = F.coalesce(F.sum("n").over(_w(group, "part", order="__bucket", before=True)), F.lit(0))
    offsets = spread.select(group, "part", "__bucket", inside.alias("inside")).join(parts, [group, "part"])
    offsets = offsets.select(group, "__bucket", (F.col("inside") + F.col("before_part")).alias("before"))
    numbered = df.withColumn("__n", F.row_number().over(_w(group, "__bucket", order=digest)))
    out = numbered.join(offsets, [group, "__bucket"])
    return out.withColumn("slot", (F.col("before") + F.col("__n") - 1).cast("long")).drop("__bucket", "__n", "before")


def _w(*by: str, order: str, before: bool = False) -> WindowSpec:
    w = Window.partitionBy(*by).orderBy(order)
    return w.rowsBetween(Window.unboundedPreceding, -1) if before else w


def shard(docs: DataFrame, dims: tuple[str, ...], doc_id: str = "doc_id", text: str = "text", shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each document."""
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    keep = (F.col(doc_id).alias("doc_id"), F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("text_crc32"))
    df, leaves, rows = tree(cut(points(docs, dims, size, keep)), len(dims), shards, target_bytes)
    df = _known(df, [(p, i) for i, p in enumerate(leaves)], ("shard",)).select("doc_id", "size", "text_crc32", "tie", "shard")
    return with_slots(df, "shard", "tie", rows).select("doc_id", "size", "text_crc32", "shard", "slot")


def op1_kdtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = shard(docs, ("n_chars", "lang", "source", "doc_id"), shards=8)
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))

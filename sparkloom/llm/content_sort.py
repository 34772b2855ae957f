"""Exact duplicates by sorting contents: equal normalised texts come to lie next to each other and are compared whole.

Sampled splitters deal rows by range over partitions, by a bounded lead of the normalised text, its hash and the
identifier, so a driver that samples splitters never sees a whole text, and a text with a third of all rows spreads over
as many partitions as its rows need. Each partition sorts its rows by lead, hash, whole text and identifier (Spark's
external sort, which spills) and compares every text with the one before. Groups that a partition's ends may cut, two a
partition, are put together by their whole texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import broadcast_if_small, cut, table

#: Runs of these are one space.
SPACE = r"[\x20\x09-\x0D]+"
#: Code points of a text that splitters may hold.
LEAD = 64
#: Rows of one group that are handed on at once.
PIECE = 10_000
#: About so many bytes of texts go to one partition, if the session's number of partitions gives more.
SHARE = 64 << 20


def normalised(text: Column) -> Column:
    """White space runs as single spaces; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


FOUND = ["id", "keep_id", "n", "first", "sha", "pid", "number", "body"]


@dataclass
class _Group:
    """Rows of one text in one partition, the first with the least identifier."""

    body: bytes
    key: int
    number: int
    ids: list[pa.Array] = field(default_factory=list)

    def batches(self, pid: int, cut_off: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """Its rows, with the whole text in the first if the partition's ends may have cut it off."""
        ids = pa.chunked_array(self.ids)
        sha, n, keep = hashlib.sha256(self.body).hexdigest(), len(ids), ids[0]
        number = self.number if cut_off else None
        for at in range(0, n, PIECE):
            part = ids.slice(at, PIECE).combine_chunks()
            m = len(part)
            first = [True] * (at == 0) + [False] * (m - (at == 0))
            bodies = [self.body if cut_off and x else None for x in first]
            columns = [part, pa.repeat(keep, m), [n] * m, first, [sha] * m, [pid] * m, [number] * m, bodies]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def _gathered(batches: Iterator[pa.RecordBatch], size: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `size` rows."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of equal neighbours among sorted rows (hash, identifier, text).

    Held at a time: the identifiers of the groups that have the hash of the last row seen, and a text for each of these.
    They are copies: a slice of a batch would keep all of its texts."""
    pid = TaskContext.get().partitionId()
    lowest: int | None = None
    held: list[_Group] = []
    number = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, ids, texts = batch.columns
        ids = ids.take(pa.array(range(len(ids)), pa.int32()))
        schema = pa.schema([*zip(FOUND, [ids.type, ids.type, pa.int64(), pa.bool_(), pa.string(), pa.int32(), pa.int64(), pa.binary()], strict=True)])
        fresh = [True, *pc.invert(pc.equal(texts.slice(1), texts.slice(0, len(texts) - 1))).to_pylist()]
        fresh[0] = not held or held[-1].body != texts[0].as_buffer().to_pybytes()
        starts = [i for i, x in enumerate(fresh) if x]
        if not fresh[0]:
            held[-1].ids.append(ids.slice(0, starts[0] if starts else None))
        for a, b in zip(starts, [*starts, len(texts)][1:], strict=True):
            key = keys[a].as_py()
            lowest = key if lowest is None else lowest
            if held and held[0].key != key:
                for g in held:
                    yield from g.batches(pid, g.key == lowest, schema)
                held = []
            held.append(_Group(texts[a].as_buffer().to_pybytes(), key, number, [ids.slice(a, b - a)]))
            number += 1
    for g in held:
        yield from g.batches(pid, True, schema)


def exact_groups(docs: DataFrame, id_column: str = "doc_id", column: str = "text", partitions: int | None = None) -> DataFrame:
    """A row a document: id_column, keep_id, group_size, kept, text_sha256 (of the normalised text, lowercase hex).

    Texts are equal if they are identical once normalised. Of equal texts the row with the smallest identifier stays; of
    rows that have that identifier too, one. Null and empty texts are one group, and so are texts of white space alone
    (one space). A null identifier is larger than any other; keep_id is null only if all of a group's are. Other columns
    are not looked at. An empty table gives no rows."""
    spark = docs.sparkSession
    size = 0 if partitions else docs.agg(F.sum(F.octet_length(column))).first()[0] or 0
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARE))
    text = normalised(F.col(column))
    rows = docs.select(F.col(id_column).alias("id"), text.alias("text")).select("id", "text", F.left("text", F.lit(LEAD)).alias("lead"), F.xxhash64("text").alias("key"))
    by_id = F.col("id").asc_nulls_last()
    dealt = rows.repartitionByRange(n, "lead", "key", by_id).sortWithinPartitions("lead", "key", "text", by_id)
    kind = docs.schema[id_column].dataType.simpleString()
    found = cut(dealt.select("key", "id", "text").mapInArrow(lambda b: _gathered(_neighbours(b)), f"id {kind}, keep_id {kind}, n bigint, first boolean, sha string, pid int, number bigint, body binary"))
    whole = found.where("number IS NULL").select("id", "keep_id", "n", "first", "sha")
    ends = found.where("body IS NOT NULL").groupBy("body").agg(F.min("keep_id").alias("least"), F.sum("n").alias("all"), F.collect_list(F.struct("pid", "number")).alias("at"))
    ends = cut(ends.select("least", "all", F.inline("at")))  # a few for each partition
    joined = found.where("number IS NOT NULL").join(broadcast_if_small(ends), ["pid", "number"])
    joined = joined.select("id", F.col("least").alias("keep_id"), F.col("all").alias("n"), (F.col("first") & F.col("keep_id").eqNullSafe(F.col("least"))).alias("first"), "sha")
    return whole.unionByName(joined).select(F.col("id").alias(id_column), "keep_id", F.col("n").alias("group_size"), F.col("first").alias("kept"), F.col("sha").alias("text_sha256"))


def without_copies(docs: DataFrame, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """docs without the rows that exact_groups() drops; of rows with one identifier and equal texts one stays. All columns
    stay as they are, whatever their names."""
    taken = {c.lower() for c in docs.columns}
    own = next(c for c in (f"sha{i or ''}" for i in range(len(taken) + 1)) if c not in taken)
    kept = exact_groups(docs, id_column, column).where("kept").select(F.col(id_column).alias("k"), F.col("text_sha256").alias("s"))
    marked = docs.withColumn(own, F.sha2(normalised(F.col(column)), 256))
    stays = marked.join(kept, marked[own].eqNullSafe(kept.s) & marked[id_column].eqNullSafe(kept.k), "left_semi")
    return stays.dropDuplicates([id_column, own]).drop(own)


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM n
"""

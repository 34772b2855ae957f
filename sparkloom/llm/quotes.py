"""Conversations from messages that quote each other.

A line's quote level is the number of `>` before its text. Neighbouring lines of one level are a passage, and each
passage is normalised (lower case, runs of white space as one blank) and hashed, whole and by paragraph. Passages are
joined to the messages of their thread (or, where no threads are given, of the whole table) whose own words hash the same,
whole or by paragraph: originals are first brought down to one a hash, the earliest, so a sentence that thousands have
written gives one row, and a passage that very many quote is joined by broadcast (common.keyed_join). A message's parent is the
original of its first linked passage of the least level; deeper levels count as links to ancestors.

Depths come from pointer doubling over parents. Positions order a thread by roots, then by depth, then by the order of
messages; they are made from counts of small ranges and offsets, so no thread is ever in one task. Without given threads,
each root has a conversation of its own and positions start at 0 in it.

Defined results: null text is empty. A quote whose original is missing or not earlier gives no link. Messages without a
linked quote are roots. Lines like `On ..., X wrote:` right before a quote go with it, of any length; the words are a
parameter. Very long messages are read whole. Repeated (thread, order) rows each
get their row; links go to the one with the least text, and equal rows share a position range in some order. Null
threads or orders never link. Outputs replace columns of the same name; other columns are kept.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import aside, cut, keyed_join, table

MARK = re.compile(r"^[ \t]?(?:>[ \t]?)+")
#: Words that end the line before a quote.
WROTE = ("wrote", "schrieb", "écrit", "escribió")
RANGE = 256
OUTPUTS = ("parent", "root", "depth", "position", "n_quotes", "n_linked", "clean_text")


@lru_cache(maxsize=16)
def introduction(wrote: tuple[str, ...]) -> re.Pattern:
    """A line of any length that ends in one of the words and a colon."""
    return re.compile(rf"^\S.*(?:{'|'.join(map(re.escape, wrote))})\s?:[ \t]*$", re.IGNORECASE)


def passages(text: str, wrote: tuple[str, ...] = WROTE) -> tuple[str, list[tuple[int, str]]]:
    """Own text, and (level, passage) in order."""
    own: list[str] = []
    quoted: list[tuple[int, list[str]]] = []
    level_before = 0
    for line in text.split("\n"):
        m = MARK.match(line)
        level = m.group().count(">") if m else 0
        body = line[m.end() :] if m else line
        if level == 0:
            doubled = level_before and not line.strip() and (not own or not own[-1].strip())
            if not doubled:  # one blank line stays where a quote was
                own.append(line)
        else:
            if level_before == 0:
                while own and not own[-1].strip():
                    own.pop()
                if own and introduction(wrote).match(own[-1]):
                    own.pop()
            if quoted and level == level_before:
                quoted[-1][1].append(body)
            else:
                quoted.append((level, [body]))
        level_before = level
    clean = "\n".join(own)
    return (clean.strip(" \t\r\n") if quoted else clean), [(k, "\n".join(x)) for k, x in quoted]


def hashes(text: str) -> list[str]:
    """Of the whole and of each paragraph, normalised; none of empty ones."""
    out = []
    for part in [text, *re.split(r"\n[ \t]*\n", text)]:
        norm = " ".join(part.lower().split())
        if norm and (h := hashlib.md5(norm.encode()).hexdigest()) not in out:
            out.append(h)
    return out


def parsed(messages: DataFrame, text: str, wrote: tuple[str, ...] = WROTE) -> DataFrame:
    """messages with clean_text, own (hashes of it) and quotes (level, hashes)."""
    keep = [c for c in messages.columns if c not in OUTPUTS]
    src = messages.select(*keep)
    at = keep.index(text)
    more = T.StructType.fromDDL("clean_text string, __own array<string>, __quotes array<struct<level:int,hashes:array<string>>>")
    quote = pa.list_(pa.struct([("level", pa.int32()), ("hashes", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [passages(x.as_py() or "", wrote) for x in batch.column(at)]
            made = [pa.array([c for c, _ in got], pa.string()), pa.array([hashes(c) for c, _ in got], pa.list_(pa.string())), pa.array([[{"level": k, "hashes": hashes(p)} for k, p in q] for _, q in got], quote)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*keep, "clean_text", "__own", "__quotes"])

    return src.mapInArrow(run, T.StructType([*src.schema.fields, *more.fields]))


def depths(parents: DataFrame) -> DataFrame:
    """(thread, node, root, depth) of a table (thread, node, parent), parent null for roots, by pointer doubling."""
    at = parents.select("thread", "node", F.coalesce("parent", "node").alias("root"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth"))
    at = cut(at)
    while True:
        ahead = at.select("thread", F.col("node").alias("root"), F.col("root").alias("far"), F.col("depth").alias("more"))
        at = cut(keyed_join(at, ahead, ["thread", "root"]).select("thread", "node", F.col("far").alias("root"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("more") > 0).alias("moved")))
        if at.where("moved").isEmpty():
            return at.drop("moved")
        at = at.drop("moved")


def positions(rows: DataFrame) -> DataFrame:
    """(thread, root, node, first): how many messages of the thread come before a node, by root, depth and node.

    rows: (thread, root, depth, node, copies). Ranges of nodes are counted, then summed up."""
    part = F.floor(F.col("node") / RANGE)
    rows = rows.withColumn("part", part)
    sums = cut(rows.groupBy("thread", "root", "depth", "part").agg(F.sum("copies").alias("n")))
    levels = cut(sums.groupBy("thread", "root", "depth").agg(F.sum("n").alias("n")))
    before = lambda by, order: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chains = cut(levels.groupBy("thread", "root").agg(F.sum("n").alias("n")).withColumn("big", F.floor(F.col("root") / RANGE)))
    bigs = chains.groupBy("thread", "big").agg(F.sum("n").alias("n")).select("thread", "big", before(["thread"], ["big"]).alias("a"))
    tops = chains.select("thread", "root", "big", before(["thread", "big"], ["root"]).alias("b"))
    b0 = tops.join(bigs, ["thread", "big"]).select("thread", "root", (F.col("a") + F.col("b")).alias("a"))
    b1 = levels.select("thread", "root", "depth", before(["thread", "root"], ["depth"]).alias("b"))
    b2 = sums.select("thread", "root", "depth", "part", before(["thread", "root", "depth"], ["part"]).alias("c"))
    offsets = b2.join(b1, ["thread", "root", "depth"]).join(b0, ["thread", "root"]).select("thread", "root", "depth", "part", (F.col("a") + F.col("b") + F.col("c")).alias("offset"))
    inside = rows.select("thread", "root", "depth", "part", "node", F.coalesce(F.sum("copies").over(Window.partitionBy("thread", "root", "depth", "part").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("d"))
    return inside.join(offsets, ["thread", "root", "depth", "part"]).select("thread", "node", "root", "depth", (F.col("offset") + F.col("d")).alias("first"))


def link(messages: DataFrame, thread: str | None = "thread", order: str = "node", text: str = "text", wrote: tuple[str, ...] = WROTE) -> DataFrame:
    """messages with parent, root, depth, position, n_quotes, n_linked and clean_text; with thread None, quotes are linked
    over the whole table, whose order must then be one of all messages."""
    messages, new, back = aside(messages)
    thread, order, text = (new.get(c, c) if c else c for c in (thread, order, text))
    read = cut(parsed(messages, text, wrote))
    group = F.lit(0) if thread is None else F.col(thread)
    one = read.where(group.isNotNull() & F.col(order).isNotNull()).select(group.alias("thread"), F.col(order).cast("long").alias("node"), "clean_text", "__own", "__quotes")
    nodes = one.groupBy("thread", "node").agg(F.min(F.struct("clean_text", "__own", "__quotes")).alias("m"), F.count("*").alias("copies")).select("thread", "node", "copies", "m.*")
    nodes = cut(nodes)
    originals = nodes.select("thread", "node", F.explode("__own").alias("hash")).groupBy("thread", "hash").agg(F.min("node").alias("original"))
    quotes = nodes.select("thread", "node", F.posexplode("__quotes").alias("place", "q")).select("thread", "node", "place", "q.level", F.posexplode("q.hashes").alias("nth", "hash"))
    linked = keyed_join(cut(quotes), cut(originals), ["thread", "hash"]).where(F.col("original") < F.col("node"))
    # the whole passage counts before its paragraphs, and one link a passage is enough
    best = linked.groupBy("thread", "node", "place").agg(F.min(F.struct("nth", "level", "original")).alias("b"))
    parents = best.groupBy("thread", "node").agg(F.count("*").alias("n_linked"), F.min(F.struct("b.level", "place", "b.original")).alias("p"))
    tree = nodes.select("thread", "node", "copies").join(parents.select("thread", "node", "n_linked", F.col("p.original").alias("parent")), ["thread", "node"], "left")
    tree = cut(tree)
    deep = depths(tree).join(tree.select("thread", "node", "copies"), ["thread", "node"])
    whole = ["thread", "node"] if thread is not None else ["node"]
    placed = positions(deep if thread is not None else deep.withColumn("thread", F.col("root")))
    facts = placed.join(tree.select(*whole, "parent", "n_linked"), whole)
    facts = facts.select(F.col("thread").alias("__t"), F.col("node").alias("__n"), "parent", "root", F.col("depth").cast("int").alias("depth"), F.col("first").cast("long").alias("position"), "n_linked")
    keep = [c for c in messages.columns if c not in OUTPUTS]
    same = F.col(order).cast("long") == F.col("__n")
    out = read.join(facts, same if thread is None else same & (F.col(thread) == F.col("__t")), "left")
    return out.select(*keep, "parent", "root", "depth", "position", F.size("__quotes").cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "clean_text").withColumnsRenamed(back)


def quoted_turns(turns: DataFrame) -> DataFrame:
    """The conversation table has no quotes: each turn is made to quote the one before, and that one's predecessor within."""
    def as_quote(x: Column, mark: str) -> Column:
        return F.regexp_replace(x, "(?m)^", mark)

    prior = turns.groupBy("conv_id", "turn").agg(F.min(F.coalesce("text", F.lit(""))).alias("t"))
    b1 = prior.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("t").alias("t1"))
    b2 = prior.select("conv_id", (F.col("turn") + 2).alias("turn"), F.col("t").alias("t2"))
    both = turns.join(b1, ["conv_id", "turn"], "left").join(b2, ["conv_id", "turn"], "left")
    deeper = F.when(F.col("t2").isNotNull(), F.concat(as_quote(F.col("t2"), ">> "), F.lit("\n"))).otherwise("")
    body = F.concat(F.lit("The other wrote:\n"), deeper, as_quote(F.col("t1"), "> "), F.lit("\n\n"), F.coalesce("text", F.lit("")))
    return both.select("conv_id", "turn", "role", F.when(F.col("t1").isNotNull(), body).otherwise(F.col("text")).alias("text"))


def op7_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return link(quoted_turns(turns), "conv_id", "turn").drop("text")


OP7_SQL = r"""
WITH RECURSIVE m AS (
  SELECT conv_id, turn, min(coalesce(text, '')) AS t, count(*) AS copies FROM conversations GROUP BY conv_id, turn
), n AS (
  SELECT *, trim(regexp_replace(lower(t), '\s+', ' ', 'g')) AS norm FROM m
), f AS (
  SELECT conv_id, norm, min(turn) AS first FROM n WHERE norm <> '' GROUP BY conv_id, norm
), q AS (
  SELECT a.conv_id, a.turn, a.copies, f1.first AS parent, (b.turn IS NOT NULL)::INT + (c.turn IS NOT NULL)::INT AS n_quotes,
    (f1.first IS NOT NULL)::INT + (f2.first IS NOT NULL)::INT AS n_linked, coalesce(f1.first, f2.first) AS up
  FROM n a LEFT JOIN n b ON b.conv_id = a.conv_id AND b.turn + 1 = a.turn LEFT JOIN n c ON c.conv_id = a.conv_id AND c.turn + 2 = a.turn AND b.turn IS NOT NULL
  LEFT JOIN f f1 ON f1.conv_id = b.conv_id AND f1.norm = b.norm LEFT JOIN f f2 ON f2.conv_id = c.conv_id AND f2.norm = c.norm
), r AS (
  SELECT conv_id, turn, turn AS root, 0 AS depth FROM q WHERE up IS NULL
  UNION ALL SELECT q.conv_id, q.turn, r.root, r.depth + 1 FROM r JOIN q ON q.conv_id = r.conv_id AND q.up = r.turn
), p AS (
  SELECT conv_id, turn, root, depth, coalesce(sum(copies) OVER (PARTITION BY conv_id ORDER BY root, depth, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS position
  FROM r JOIN q USING (conv_id, turn)
)
SELECT x.conv_id, x.turn, x.role, q.up AS parent, p.root, CAST(p.depth AS INT) AS depth, CAST(p.position AS BIGINT) AS position,
  CAST(q.n_quotes AS BIGINT) AS n_quotes, CAST(q.n_linked AS BIGINT) AS n_linked,
  CASE WHEN q.n_quotes > 0 THEN trim(coalesce(x.text, ''), E' \t\r\n') ELSE coalesce(x.text, '') END AS clean_text
FROM conversations x JOIN q USING (conv_id, turn) JOIN p USING (conv_id, turn)
"""

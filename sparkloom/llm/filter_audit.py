"""How quality filters overlap: what each removes after which others, for every order of the filters.

One pass over Arrow's own buffers gives each document a mask of the filters that it fails: byte classes by table, counts
by prefix sums, distinct words by sorted hashes whose equal neighbours are compared byte by byte. Masks are counted by part;
everything else follows from 32 counts a part.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import cut, keyed_join, table
from sparkloom.llm.textvec import sliced

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5  # words; of a hundred words; of a hundred code points
SYMBOLS = b"#$%&*|"
#: Longer texts (bytes) are scanned piece by piece.
LONG = 4 << 20

_SPACE, _CAPITAL, _SYMBOL, _LATER = 1, 2, 4, 8
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] |= _SPACE
_CLASS[ord("A") : ord("Z") + 1] |= _CAPITAL
_CLASS[list(SYMBOLS)] |= _SYMBOL
_CLASS[0x80:0xC0] |= _LATER  # a code point's later bytes


def _counts(held: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many of the marked bytes lie in each document, by prefix sums."""
    return np.diff(np.concatenate(([0], np.cumsum(held, dtype=np.int64)))[bounds])


_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(max(n - 1, 0), base, np.uint64))))[:n]


def distinct_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray, n_docs: int, mask: int = (1 << 64) - 1) -> np.ndarray:
    """Distinct words of each document. Words' hashes are differences of a prefix sum over the bytes; sorted within
    documents, equal neighbours are compared byte by byte. A document in which a comparison fails is counted from its
    words themselves. `mask` shortens hashes, for tests."""
    if not len(start):
        return np.zeros(n_docs, np.int64)
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)), dtype=np.uint64)))
        hashes = (sums[end] - sums[start]) * _powers(_BACK, len(data))[start] & np.uint64(mask)
    size = end - start
    order = np.lexsort((size, hashes, doc))
    a, b = order[:-1], order[1:]
    same = (doc[a] == doc[b]) & (hashes[a] == hashes[b]) & (size[a] == size[b])
    a, b = a[same], b[same]
    found = np.bincount(doc, minlength=n_docs) - np.bincount(doc[b], minlength=n_docs)
    if len(a):
        n = size[a]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        differs = data[within + np.repeat(start[a], n)] != data[within + np.repeat(start[b], n)]
        for d in np.unique(np.repeat(doc[a], n)[differs]):
            own = np.flatnonzero(doc == d)
            found[d] = len({data[start[i] : end[i]].tobytes() for i in own})
    return found


def scan(texts: pa.Array, hash_mask: int = (1 << 64) - 1) -> dict[str, np.ndarray]:
    """words, distinct, capitals, symbols and code points of each text (null: none), read from the array's own buffers."""
    n = len(texts)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, at, held = texts.buffers()
    bounds = np.frombuffer(at, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    if texts.null_count:  # what lies behind a null is no text; fill it with empty ones
        return scan(texts.fill_null(""), hash_mask)
    data = np.frombuffer(held, np.uint8)[bounds[0] : bounds[-1]] if held is not None else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    cls = _CLASS[data]
    space = cls & _SPACE > 0
    first = np.zeros(len(data) + 1, bool)
    first[bounds] = True  # of a document
    inside = ~space
    begins = inside.copy()
    begins[1:] &= space[:-1] | first[1:-1]
    ends = inside.copy()
    ends[:-1] &= space[1:] | first[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    doc = np.searchsorted(bounds, start, "right") - 1
    return {
        "words": _counts(begins, bounds),
        "distinct": distinct_words(data, start, end, doc, n, hash_mask),
        "capitals": _counts(cls & _CAPITAL > 0, bounds),
        "symbols": _counts(cls & _SYMBOL > 0, bounds),
        "points": _counts(cls & _LATER == 0, bounds),
    }


def _pieces(body: memoryview, size: int = LONG // 4) -> Iterator[bytes]:
    """A long text in pieces that end after white space, or with the text."""
    at, rest = 0, b""
    while at < len(body):
        piece = rest + bytes(body[at : at + size])
        at += size
        last = max(piece.rfind(c) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if at < len(body) and last < 0:
            rest = piece
            continue
        rest = piece[last + 1 :] if at < len(body) else b""
        yield piece[: len(piece) - len(rest)]


def scan_long(body: memoryview) -> dict[str, int]:
    """scan() of one long text: memory grows with its distinct words and one piece."""
    seen: set[bytes] = set()
    total = dict.fromkeys(("words", "capitals", "symbols", "points"), 0)
    for piece in _pieces(body):
        cls = _CLASS[np.frombuffer(piece, np.uint8)]
        words = piece.split()  # at just the bytes of _SPACE
        seen.update(words)
        total["words"] += len(words)
        for name, bit in (("capitals", _CAPITAL), ("symbols", _SYMBOL)):
            total[name] += int(np.count_nonzero(cls & bit))
        total["points"] += int(np.count_nonzero(cls & _LATER == 0))
    return total | {"distinct": len(seen)}


def mask(c: dict) -> np.ndarray:
    """Bits of the failed filters A to D."""
    a, b = c["words"] < LEAST_WORDS, 100 * c["distinct"] < LEAST_DISTINCT * c["words"]
    return a * 1 | b * 2 | (100 * c["capitals"] > MOST_CAPITALS * c["points"]) * 4 | (c["symbols"] > 0) * 8


def scanned(docs: DataFrame, column: str = "text") -> DataFrame:
    """docs with `fails`, the mask of filters A to D, and `digest`, the text's SHA-256, in place of the text."""
    keep = [c for c in docs.columns if c != column]
    src = docs.select(*keep, column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, len(keep)):
                texts = part.column(len(keep))
                bodies = [memoryview(x.as_buffer()) if x.is_valid else memoryview(b"") for x in texts]
                long = [i for i, x in enumerate(bodies) if len(x) > LONG]
                if long:
                    got = {k: np.array([x[k] for x in map(scan_long, bodies)], np.int64) for k in ("words", "distinct", "capitals", "symbols", "points")}
                else:
                    got = scan(texts)
                digest = pa.array([hashlib.sha256(x).digest() for x in bodies], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(mask(got).astype(np.int32)), digest], names=[*keep, "fails", "digest"])

    fields = [src.schema[c] for c in keep]
    return src.mapInArrow(run, T.StructType([*fields, T.StructField("fails", T.IntegerType()), T.StructField("digest", T.BinaryType())]))


#: (filters before, filter) as masks; and each order's steps, with the place of theirs among these.
STEPS = [(before, 1 << f) for f in range(5) for before in range(32) if not before >> f & 1]
ORDERS = [("".join(FILTERS[i] for i in p), step + 1, STEPS.index((sum(1 << i for i in p[:step]), 1 << f))) for p in permutations(range(5)) for step, f in enumerate(p)]


def document_masks(docs: DataFrame, labels: DataFrame, part: str = "source", id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """(doc_id, part, fails, good, toxic), a row a document: the mask with E's bit (16), and whether labels say so.

    A document fails E if a smaller identifier has the same text (null: empty); one without an identifier fails if any
    document has one. A document that is labelled twice has each label that any of the rows gives."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(column).alias("text"))
    rows = cut(scanned(rows))
    least = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1 AND least IS NOT NULL").select("digest", "least")
    met = keyed_join(rows, cut(least), ["digest"], "left").drop("digest")
    again = F.col("least").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("least")))
    met = cut(met.select("doc_id", "part", (F.col("fails") + F.when(again, 16).otherwise(0)).alias("fails")))
    said = labels.groupBy(F.col(id_column).alias("doc_id")).agg(F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("toxic")).where("doc_id IS NOT NULL AND (good OR toxic)")
    known = keyed_join(met, cut(said), ["doc_id"], "left")
    return known.select("doc_id", "part", "fails", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def _table(rows: list[tuple], names: str, schema: str) -> Column:
    """A constant array of structs."""
    return F.from_json(F.lit(json.dumps([dict(zip(names.split(), r, strict=True)) for r in rows])), f"array<struct<{schema}>>")


def audit(masks: DataFrame) -> DataFrame:
    """A row a part, filter_order and step, of document_masks(). Parts without documents have no rows.

    Each part's documents are counted by mask (partial sums, then 32 counts at most a part); a filter's `shapley` weighs
    what it removes after each set of filters by the orders that begin with just these."""
    by_mask = masks.groupBy("part", "fails").agg(F.count("*").alias("n"), F.count_if("good").alias("g"), F.count_if("toxic").alias("t"))
    parts = by_mask.groupBy("part").agg(F.collect_list(F.struct("fails", "n", "g", "t")).alias("held"))

    def total(of: Callable[[Column], Column], where: Callable[[Column], Column]) -> Column:
        return F.aggregate("held", F.lit(0).cast("long"), lambda a, h: a + F.when(where(h["fails"]), of(h)).otherwise(0))

    def step(s: Column) -> Column:
        before, bit = s["before"], s["bit"]
        meets = lambda m, x: m.bitwiseAND(x) != 0
        here = lambda m: meets(m, bit) & ~meets(m, before)
        n, g, t = (lambda h, c=c: h[c] for c in "ngt")
        return F.struct(
            bit.alias("bit"), s["weight"].alias("weight"),
            total(n, lambda m: ~meets(m, before.bitwiseOR(bit))).alias("kept"), total(n, here).alias("removed"), total(n, lambda m: meets(m, bit) & meets(m, before)).alias("redundant"),
            total(n, lambda m: m == bit).alias("unique_fails"), total(g, here).alias("good_lost"), total(t, here).alias("toxic_lost"),
        )

    weights = [(before, bit, factorial(before.bit_count()) * factorial(4 - before.bit_count())) for before, bit in STEPS]
    done = parts.select("part", F.transform(_table(weights, "before bit weight", "before:int,bit:int,weight:int"), step).alias("steps"))
    orders = F.inline(_table(ORDERS, "filter_order step i", "filter_order:string,step:int,i:int"))
    each = done.select("part", "steps", orders).select("part", "filter_order", "step", "steps", F.element_at("steps", F.col("i") + 1).alias("s"))
    shapley = F.aggregate("steps", F.lit(0).cast("long"), lambda a, x: a + F.when(x["bit"] == F.col("s.bit"), x["removed"] * x["weight"]).otherwise(0))
    return each.select("part", "filter_order", "step", *(f"s.{c}" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")), shapley.alias("shapley"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(document_masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


OP13_SQL = r"""
WITH letters(l, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (SELECT filter_order, step, f.bit, coalesce((SELECT sum(p.bit) FROM letters p WHERE position(p.l IN filter_order) < step), 0) AS before
  FROM orders, generate_series(1, 5) g(step), letters f WHERE f.l = filter_order[step]),
docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
read AS (SELECT doc_id, part, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w, length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS caps, min(doc_id) OVER (PARTITION BY t) AS least FROM docs),
said AS (SELECT doc_id, max(quality) FILTER (quality = 1) AS good, max(toxic) FILTER (toxic = 1) AS toxic FROM labels GROUP BY doc_id),
masks AS (SELECT part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
    CASE WHEN len(w) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END + CASE WHEN 100 * caps > 5 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN least IS NOT NULL AND (doc_id IS NULL OR doc_id > least) THEN 16 ELSE 0 END AS m
  FROM read LEFT JOIN said l USING (doc_id)),
counted AS (SELECT part, m, count(*) AS n, sum(good) AS g, sum(toxic) AS t FROM masks GROUP BY part, m),
audited AS (SELECT part, filter_order, step, bit,
    sum(CASE WHEN m & (before | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN m & bit > 0 AND m & before = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN m & bit > 0 AND m & before > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN m = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN m & bit > 0 AND m & before = 0 THEN g ELSE 0 END) AS good_lost, sum(CASE WHEN m & bit > 0 AND m & before = 0 THEN t ELSE 0 END) AS toxic_lost
  FROM counted, (SELECT filter_order, CAST(step AS INT) AS step, CAST(bit AS INT) AS bit, CAST(before AS INT) AS before FROM steps) GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM audited
"""

"""N-gram Jaccard self-join of documents, candidates pruned by Bayesian inference over MinHash values.

Words are lower-cased (A-Z) runs of letters, digits and other code points from U+0080; a document is the set of its
shingles of five consecutive words (all its words, if fewer). Documents with the same set are one class; the join is
between classes.

1. Every set gets BANDS x ROWS MinHash values. Classes that agree on a band share a bucket; at the threshold of 0.8 a
   pair shares none with a probability of (1 - 0.8^6)^48 = 4.6e-7, above it less.
2. A bucket's least class is its hub. Every class goes with its least hub, and its other hubs with that one: about one
   edge a class, never all pairs; the connected components hold all candidate pairs.
3. A component too large for one block is cut into blocks of bounded size, classes of one least hub together. Two blocks
   make a task if they share a bucket, so no group lands in one task whole, and what only a chain connects never meets.
   Within a task, MinHash values are compared 32 at a time. With m of n equal and a uniform prior the similarity is
   Beta(m + 1, n - m + 1); a pair is dropped once P(J >= 0.8) < TOLERANCE. The rest are verified exactly on the sets.
4. A task returns, for each class with links, their number and a representative of what they connect: rows grow with the
   classes, not the pairs.

Results: one row a document: class_id (least doc_id of the class), n_links (other classes with J >= threshold), group_id
(least doc_id of what links connect). A document without words is alone: its own doc_id, no links. Null ids are ignored
where others are there. Repeated rows each get their row. Fingerprints of shingles and sets have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import textvec as tv
from sparkloom.llm.common import aside, broadcast_if_small, cut, table
from sparkloom.llm.components import components

N_WORDS, THRESHOLD, TOLERANCE = 5, 0.8, 1e-6
BANDS, ROWS, STEP = 48, 6, 32
BLOCK_ROWS, BLOCK_SHINGLES, PACKED = 256, 300_000, 16
_RNG = np.random.default_rng(20)
FACTORS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLACES = _RNG.integers(0, 1 << 63, N_WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(texts: list[str], n: int = N_WORDS) -> list[np.ndarray]:
    """The sorted shingle fingerprints of each text."""
    cps, bounds = tv.lay(texts)
    upper = (cps >= 65) & (cps <= 90)
    low = np.where(upper, cps + 32, cps)
    word = (low >= 0x80) | ((low >= 97) & (low <= 122)) | ((low >= 48) & (low <= 57))
    inside = np.concatenate(([False], word, [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    h = tv.word_hashes(low, start, end)
    count = np.bincount(np.searchsorted(bounds, start, "right"), minlength=len(texts))
    places = np.resize(PLACES, n)
    full = np.zeros(max(len(h) - n + 1, 0), np.uint64)
    for k in range(n):
        full += tv.mix(h[k : k + len(full)] ^ places[k])
        full = full * places[0]
    full = tv.mix(full)
    out, at = [], 0
    for c in count.tolist():
        if c >= n:
            out.append(np.unique(full[at : at + c - n + 1]))
        elif c:
            x = np.uint64(c)
            for k in range(c):
                x = tv.mix(np.array([x ^ h[at + k]]) + places[k])[0]
            out.append(np.array([x], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out


def signature(s: np.ndarray) -> np.ndarray:
    """MinHash values of a set, 32 bits each."""
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max)
    for a in range(0, len(s), 1024):
        np.minimum(least, np.multiply.outer(FACTORS, s[a : a + 1024]).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    x = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        x = tv.mix(x * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return x


def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """Fewest of n equal values with P(J >= threshold) >= tolerance, which is P(Binomial(n + 1, threshold) <= m)."""
    p = 0.0
    for m in range(n + 1):
        p += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if p >= tolerance:
            return m
    return n


def linked(a: list[np.ndarray], sig_a: np.ndarray, b: list[np.ndarray], sig_b: np.ndarray, same: bool, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and b of the pairs that reach the threshold; of one block with itself, each pair once."""
    alive_a, alive_b = np.triu_indices(len(a), 1) if same else (x.ravel() for x in np.indices((len(a), len(b))))
    size_a, size_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    small, large = np.minimum(size_a[alive_a], size_b[alive_b]), np.maximum(size_a[alive_a], size_b[alive_b])
    fits = small >= threshold * large - 1e-9
    alive_a, alive_b = alive_a[fits], alive_b[fits]
    m = np.zeros(len(alive_a), np.int32)
    for at in range(0, sig_a.shape[1], STEP):
        m += (sig_a[alive_a, at : at + STEP] == sig_b[alive_b, at : at + STEP]).sum(axis=1, dtype=np.int32)
        keep = m >= least_matches(min(at + STEP, sig_a.shape[1]), threshold, tolerance)
        alive_a, alive_b, m = alive_a[keep], alive_b[keep], m[keep]
    if not len(alive_a):
        return alive_a, alive_b
    common = intersections(a, b, alive_a, alive_b)
    union = size_a[alive_a] + size_b[alive_b] - common
    good = common >= threshold * union - 1e-9
    return alive_a[good], alive_b[good]


def intersections(a: list[np.ndarray], b: list[np.ndarray], at_a: np.ndarray, at_b: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections, by pairs where they are few, else by products of incidence matrices."""
    ids, inverse = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    if len(at_a) * 2e-5 < len(a) * len(b) * len(ids) * 1e-10 + len(ids) * 1e-7:
        return np.array([len(np.intersect1d(a[i], b[j], assume_unique=True)) for i, j in zip(at_a, at_b, strict=True)], np.int64)
    owner = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in [*a, *b]])
    order = np.argsort(inverse, kind="stable")
    owner, inverse = owner[order], inverse[order]
    out = np.zeros((len(a), len(b)), np.float64)
    width = 4096
    for lo in range(0, len(ids), width):
        x, y = np.searchsorted(inverse, [lo, lo + width])
        there = np.zeros((len(a) + len(b), width), np.float32)
        there[owner[x:y], inverse[x:y] - lo] = 1
        out += there[: len(a)] @ there[len(a) :].T
    return out[at_a, at_b].astype(np.int64)


def text_key(text: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def fingerprints(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, tkey of the text, rep (fingerprint of the set, null without words), n of the set, and band keys."""
    src = docs.select(F.col(doc_id).alias("doc_id"), text_key(text).alias("tkey"), F.col(text).alias("text"))
    id_type = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tv.sliced(batch, 2):
                reps, sizes, bands = [], [], []
                for s in shingles([x.as_py() or "" for x in part.column(2)]):
                    sizes.append(len(s))
                    reps.append(int(tv.mix(s + np.uint64(len(s))).sum().view(np.int64)) if len(s) else None)
                    bands.append(band_keys(signature(s)).view(np.int64) if len(s) else None)
                made = [pa.array(reps, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *made], names=["doc_id", "tkey", "rep", "n", "bands"])

    return src.mapInArrow(run, f"doc_id {id_type}, tkey binary, rep bigint, n bigint, bands array<bigint>")


def blocks(classes: DataFrame, nearest: DataFrame, comps: DataFrame) -> DataFrame:
    """(rep, tkey, block, several) of the classes in components: several says that the component has more than one block.

    Classes of one least hub go together, in as many blocks as their size asks for. Where a component would have at most
    PACKED blocks, those of small hubs share blocks, as nearly all of its blocks will meet; in a larger one they don't, so
    that a long chain's blocks meet their neighbours only."""

    def parts(rows: Column, n: Column) -> Column:
        return F.greatest(F.ceil(rows / BLOCK_ROWS), F.ceil(n / BLOCK_SHINGLES)).cast("long")

    members = classes.select("rep", "tkey", "n").join(nearest, "rep").join(comps, "rep")
    by_hub = members.groupBy("comp", "hub").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
    by_hub = cut(by_hub.withColumn("parts", parts(F.col("rows"), F.col("n"))))
    small = F.col("parts") == 1
    wide = by_hub.groupBy("comp").agg(parts(F.sum("rows"), F.sum("n")).alias("whole"), parts(F.sum(F.when(small, F.col("rows"))), F.sum(F.when(small, F.col("n")))).alias("bins"))
    with_others = small & (F.col("whole") <= PACKED)
    own = F.when(F.col("whole") == 1, F.xxhash64("comp")).when(with_others, F.xxhash64("comp", F.pmod(F.xxhash64("hub"), "bins")))
    sized = by_hub.join(wide, "comp").select("comp", "hub", "parts", (F.col("whole") > 1).alias("several"), own.alias("shared"))
    dealt = F.xxhash64("comp", "hub", F.pmod(F.xxhash64("rep"), "parts"))
    return cut(members.join(sized, ["comp", "hub"]).select("rep", "tkey", F.coalesce("shared", dealt).alias("block"), "several"))


def block_pairs(classes: DataFrame, members: DataFrame) -> DataFrame:
    """(block, task, side): each block with itself and with those that it shares a bucket with."""
    alone = members.select("block").distinct().select(F.col("block").alias("low"), F.col("block").alias("high"))
    several = members.where("several")
    if several.isEmpty():
        pairs = alone
    else:
        held = classes.select("rep", "bands").join(several.select("rep", "block"), "rep")
        held = cut(held.select("block", F.explode("bands").alias("bucket")).distinct())
        # of buckets with the same blocks (their number and the xor of their digests) one is enough
        sets = held.groupBy("bucket").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("block")).alias("x")).where("c > 1")
        held = held.join(sets.groupBy("c", "x").agg(F.min("bucket").alias("bucket")), "bucket").select("bucket", "block")
        held = cut(held)
        both = held.select("bucket", F.col("block").alias("low")).join(held.select("bucket", F.col("block").alias("high")), "bucket")
        pairs = alone.union(both.where("low < high").select("low", "high").distinct())
    task = F.concat_ws(":", "low", "high").alias("task")
    ends = F.explode(F.expr("IF(low = high, array(low), array(low, high))"))
    sides = cut(pairs.select(task, "low", ends.alias("block")))
    return sides.select("block", "task", F.when(F.col("block") == F.col("low"), 0).otherwise(1).alias("side"))


def block_tasks(docs: DataFrame, members: DataFrame, sides: DataFrame, text: str) -> DataFrame:
    """(task, side, rep, shingles, signature): each class's set in every task that its block takes part in."""
    known = docs.select(F.col(text).alias("text"), text_key(text).alias("tkey"))
    texts = known.join(broadcast_if_small(members), "tkey").dropDuplicates(["rep"]).select("rep", "block", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tv.sliced(batch, 2):
                got = shingles([x.as_py() or "" for x in part.column(2)])
                data = [pa.array([s.tobytes() for s in got], pa.binary()), pa.array([signature(s).tobytes() for s in got], pa.binary())]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], *data], names=["rep", "block", "shingles", "signature"])

    made = texts.mapInArrow(sets, "rep bigint, block bigint, shingles binary, signature binary")
    return made.join(sides, "block").select("task", "side", "rep", "shingles", "signature")


def compared(tasks: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(rep, n_links, root): for each task, the classes with links, and the least class that they connect to there."""

    def one(task: str | None, rows: list[tuple[int, int, bytes, bytes]]) -> list[tuple[int, int, int]]:
        sides = [[r for r in rows if r[0] == k] for k in (0, 1)]
        blocks = (task or "").split(":")[-2:]
        same = blocks[0] == blocks[-1]
        left, right = sides[0], sides[0] if same else sides[1]
        if not left or not right or (same and len(left) < 2):
            return []
        get = lambda side: ([np.frombuffer(r[2], np.uint64) for r in side], np.stack([np.frombuffer(r[3], np.uint32) for r in side]))
        a, sig_a = get(left)
        b, sig_b = (a, sig_a) if same else get(right)
        at_a, at_b = linked(a, sig_a, b, sig_b, same, threshold, tolerance)
        ids = [r[1] for r in left] + ([] if same else [r[1] for r in right])
        at_b = at_b if same else at_b + len(left)
        counts = np.bincount(np.concatenate((at_a, at_b)), minlength=len(ids))
        root = {x: x for x in ids}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for i, j in zip(at_a.tolist(), at_b.tolist(), strict=True):
            x, y = find(ids[i]), find(ids[j])
            if x != y:
                root[max(x, y)] = min(x, y)
        return [(x, int(c), find(x)) for x, c in zip(ids, counts, strict=True) if c]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, bytes, bytes]] = []
        task: str | None = None
        out: list[tuple[int, int, int]] = []
        for batch in batches:
            for t, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if t != task:
                    out += one(task, rows)
                    rows, task = [], t
                rows.append(tuple(row))
            if len(out) > 10_000:
                yield written(out)
                out = []
        yield written(out + one(task, rows))

    def written(out: list[tuple[int, int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(3)], names=["rep", "n_links", "root"])

    return tasks.repartition("task").sortWithinPartitions("task").mapInArrow(run, "rep bigint, n_links bigint, root bigint")


def join_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[DataFrame, DataFrame]:
    """(doc_id, tkey, rep) of every document, and (rep, class_id, n_links, label) of every class."""
    prints = cut(fingerprints(docs, doc_id, text))
    classes = prints.where("rep IS NOT NULL").groupBy("rep").agg(F.min("doc_id").alias("class_id"), F.min(F.struct("tkey", "n", "bands")).alias("one"))
    classes = cut(classes.select("rep", "class_id", "one.*"))
    buckets = classes.select("rep", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.min("rep").alias("v"), F.count("*").alias("c")).where("c > 1").drop("c")
    hubs = cut(buckets.join(shared, "bucket").select("rep", "v").distinct())
    nearest = hubs.groupBy("rep").agg(F.min("v").alias("hub"))
    nearest = cut(nearest)
    others = hubs.join(nearest, "rep").select(F.col("v").alias("u"), F.col("hub").alias("v"))
    comps = components(nearest.select(F.col("rep").alias("u"), F.col("hub").alias("v")).union(others))
    members = blocks(classes, nearest, comps.select(F.col("u").alias("rep"), F.col("label").alias("comp")))
    found = cut(compared(block_tasks(docs, members, block_pairs(classes, members), text), threshold, tolerance))
    links = found.groupBy("rep").agg(F.sum("n_links").alias("n_links"), F.min("root").alias("root"))
    several = members.where("several").select("rep")
    if several.isEmpty():
        labels = links.select("rep", "n_links", F.col("root").alias("label"))
    else:  # what one block pair connects may go on in others
        chained = found.join(several, "rep", "left_semi").select(F.col("rep").alias("u"), F.col("root").alias("v"))
        ends = components(chained).select(F.col("u").alias("rep"), "label")
        labels = links.join(ends, "rep", "left").select("rep", "n_links", F.coalesce("label", "root").alias("label"))
    out = classes.select("rep", "class_id").join(labels, "rep", "left")
    return prints.select("doc_id", "tkey", "rep"), cut(out.select("rep", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("label", "rep").alias("label")))


def jaccard_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row a document: doc_id, class_id, n_links, group_id."""
    prints, classes = join_classes(docs, doc_id, text, threshold, tolerance)
    least = classes.groupBy("label").agg(F.min("class_id").alias("group_id"))
    verdict = classes.join(least, "label").select("rep", "class_id", "n_links", "group_id")
    out = prints.join(verdict, "rep", "left")
    own = F.col("rep").isNull()
    return out.select("doc_id", F.when(own, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(own, F.col("doc_id")).otherwise(F.col("group_id")).alias("group_id"))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each group: the one with the least id, and of equal ids the least text digest."""
    docs, new, back = aside(docs)
    doc_id, text = new.get(doc_id, doc_id), new.get(text, text)
    prints, classes = join_classes(docs, doc_id, text)
    rows = prints.where("rep IS NOT NULL").groupBy("rep", "doc_id", "tkey").agg(F.count("*").alias("copies"))
    rows = cut(rows.join(classes.select("rep", "label"), "rep").select("label", "doc_id", "tkey", "copies"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tkey")
    best = rows.groupBy("label").agg(F.min(order).alias("best")).select("best.doc_id", "best.tkey", F.lit(True).alias("best"))
    # a row has one class, so id and digest tell the group's best; no join by the group
    mine = rows["doc_id"].eqNullSafe(best["doc_id"]) & (rows["tkey"] == best["tkey"])
    judged = rows.join(best, mine, "left").select(rows["doc_id"], rows["tkey"], "copies", F.coalesce("best", F.lit(False)).alias("stays"))
    judged = cut(judged.where("NOT stays OR copies > 1").select(F.col("doc_id").alias("__id"), F.col("tkey").alias("__tkey"), "stays"))
    keyed = docs.withColumn("__own", text_key(text))
    match = lambda x: F.col(doc_id).eqNullSafe(x["__id"]) & (F.col("__own") == x["__tkey"])
    marked = broadcast_if_small(judged)
    kept = keyed.join(marked, match(marked), "left_anti")
    repeated = cut(judged.where("stays"))
    if not repeated.isEmpty():  # rows that are there more than once
        some = broadcast_if_small(repeated)
        kept = kept.union(keyed.join(some, match(some), "left_semi").dropDuplicates([doc_id, "__own"]))
    return kept.drop("__own").withColumnsRenamed(back)


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN NULL ELSE list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1),
    lambda i: array_to_string(w[i:i + 4], ' ')))) END AS g FROM d
), c AS (
  SELECT g, min(doc_id) AS class_id FROM s WHERE g IS NOT NULL GROUP BY g
), x AS (
  SELECT class_id, len(g) AS n, unnest(g) AS sh FROM c
), p AS (
  SELECT a.class_id AS a, b.class_id AS b FROM x a JOIN x b ON a.sh = b.sh AND a.class_id <> b.class_id
  GROUP BY a.class_id, b.class_id, a.n, b.n HAVING 10 * count(*) >= 8 * (a.n + b.n - count(*))
), links AS (
  SELECT a AS class_id, count(*) AS n_links FROM p GROUP BY a
), reach AS (
  WITH RECURSIVE r(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a) SELECT a, min(b) AS b FROM r GROUP BY a
)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(n_links, 0) AS n_links, least(coalesce(class_id, doc_id), coalesce(b, class_id, doc_id)) AS group_id
FROM s LEFT JOIN c USING (g) LEFT JOIN links USING (class_id) LEFT JOIN reach ON reach.a = class_id
"""

"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

An item is cut into windows of consecutive words; a shorter item is one window. Windows and documents are sets of
shingles: five consecutive words with their place (all of a window's words, if it has fewer). A document contains a
window only if it holds every one of its shingles, so ordering a window's shingles by rarity over the whole corpus, a
prefix of one is enough: a document without the rarest shingle can't hold the window. Length and position bound what is
left (the window must fit between the document's ends around that shingle), and each candidate is then verified exactly:
shingles that cover the window must all be at their places.

Documents are cut into words once to find the shingles that any window has; all else works on those places. A shingle is
looked up by a 64-bit digest and then compared word by word. Windows with a shingle that no document has are dropped at
once. Texts are handled by their digest, so copies of a text are verified once. What is broadcast is counted first;
beyond the bound the joins shuffle, with the places of a hot shingle dealt over several tasks.

Defined results: null or empty text has no words, no hits. An item without words has no window. A null item id marks
hits but is not listed. Repeated items count once by id. Repeated documents each get their row. Very long texts are read
whole. Without items or documents nothing is found. Columns of docs that have the names of the outputs are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import LOWER, NOT_WORD, UPPER, aside, broadcast_if_small, cut, is_small, salted_join, table

WINDOW, SHINGLE = 10, 5
OUTPUTS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NOT_WORD, -1), "")


def _digest(words: str, at: Column, k: int) -> Column:
    return F.xxhash64(*(F.get(words, at + i) for i in range(k)))


def windows(items: DataFrame, item_id: str, text: str, size: int) -> tuple[DataFrame, DataFrame]:
    """(wid, words) of the distinct windows, and (wid, item) of the items that have them."""
    got = items.select(F.col(item_id).cast("string").alias("item"), _words(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    cuts = got.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("words"))
    cuts = cut(cuts.withColumn("wid", F.md5(F.array_join("words", " "))))
    return cut(cuts.select("wid", "words").dropDuplicates(["wid"])), cut(cuts.where("item IS NOT NULL").select("wid", "item").distinct())


def shingles(found: DataFrame) -> DataFrame:
    """(wid, len, k, off, sid, words) of the shingles of each window."""
    k = F.least(F.size("words"), F.lit(SHINGLE))
    sized = found.select("wid", "words", F.size("words").alias("len"), k.alias("k"))
    placed = sized.select("*", F.explode(F.sequence(F.lit(0), F.col("len") - F.col("k"))).alias("off"))
    each = placed.withColumn("words", F.slice("words", F.col("off") + 1, F.col("k")))
    return each.withColumn("sid", F.md5(F.array_join("words", " ")))


def places(docs: DataFrame, vocabulary: DataFrame, text: str, sizes: list[int]) -> DataFrame:
    """(key, n, pos, sid): where the texts hold shingles (k, words, sid) of the vocabulary. sizes has all values of k."""
    of = F.lit(None).cast("long")
    for k in sizes:
        of = F.when(F.col("k") == k, _digest("words", F.lit(0), k)).otherwise(of)
    known = vocabulary.withColumn("digest", of)
    body = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t"))
    spread = body.select(F.md5("t").alias("key"), _words(F.col("t")).alias("w")).select("key", "w", F.size("w").alias("n"), F.posexplode("w").alias("pos", "word"))
    if len(sizes) == 1:
        probes = spread.select("key", "w", "n", "pos", F.lit(sizes[0]).alias("k"), _digest("w", F.col("pos"), sizes[0]).alias("digest"))
    else:
        each = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), _digest("w", F.col("pos"), k).alias("digest")) for k in sizes)))
        probes = spread.select("key", "w", "n", "pos", each.alias("p")).select("key", "w", "n", "pos", "p.*")
    probes = probes.where(F.col("pos") + F.col("k") <= F.col("n"))
    here = F.slice("w", F.col("pos") + 1, F.col("k"))
    if is_small(vocabulary):
        met = probes.join(F.broadcast(known.drop("k")), "digest").where(here == F.col("words"))
    else:  # don't shuffle whole texts
        met = salted_join(probes.select("key", "n", "pos", "digest", here.alias("here")), known.drop("k"), "digest").where("here = words")
    return cut(met.select("key", "n", "pos", "sid").distinct())


def verdicts(docs: DataFrame, items: DataFrame, text: str, item_id: str, item_text: str, size: int) -> DataFrame:
    """By digest of the text: n_hit, n_items and items_sha256. Only texts with a hit have a row."""
    found, listed = windows(items, item_id, item_text, size)
    parts = cut(shingles(found))
    vocabulary = cut(parts.select("k", "words", "sid").dropDuplicates(["sid"]))
    sizes = sorted(r.k for r in vocabulary.select("k").distinct().collect())  # at most SHINGLE rows
    hits = places(docs, vocabulary, text, sizes or [SHINGLE])
    counts = hits.groupBy("sid").count()
    rank = F.struct(F.coalesce("count", F.lit(0)).alias("count"), "sid", "off")
    rarest = parts.join(counts, "sid", "left").groupBy("wid", "len").agg(F.min(rank).alias("r")).where("r.count > 0")
    prefixes = cut(rarest.select("wid", "len", "r.sid", "r.off"))
    start = (F.col("pos") - F.col("off")).alias("start")
    candidates = salted_join(hits, prefixes, "sid").where("pos >= off AND pos - off + len <= n").select("key", start, "wid").distinct()
    # shingles side by side, and the last one, cover a window
    cover = parts.where("off % k = 0 OR off = len - k").select("wid", "len", "off", "sid", F.ceil(F.col("len") / F.col("k")).alias("all"))
    wanted = salted_join(candidates, cut(cover), "wid").withColumn("pos", F.col("start") + F.col("off"))
    met = wanted.join(hits.select("key", "pos", "sid"), ["key", "pos", "sid"]).groupBy("key", "start", "wid", "len", "all").agg(F.count("*").alias("c"))
    matches = cut(met.where("c = all").select("key", "start", "wid", (F.col("start") + F.col("len")).alias("end")))
    before = Window.partitionBy("key").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    reach = matches.groupBy("key", "start").agg(F.max("end").alias("end")).withColumn("upto", F.max("end").over(before))
    new = F.col("end") - F.greatest("start", F.least("end", F.coalesce("upto", "start")))
    n_hit = reach.groupBy("key").agg(F.sum(new).cast("long").alias("n_hit"))
    return cut(n_hit.join(named(matches.select("key", "wid").distinct(), listed), "key", "left"))


def named(held: DataFrame, listed: DataFrame) -> DataFrame:
    """(key, n_items, items_sha256) of texts with windows (key, wid) that items have (wid, item).

    Windows with the same items are one set, told by the number and the sums of two hashes of their items, and texts with the
    same sets are one combination. Items are listed once for each combination, not for each text, so a window that very many
    items and texts share costs their sum, not their product."""
    hashes = [F.sum(F.xxhash64(F.lit(i), "item").cast("decimal(20,0)")).alias(f"s{i}") for i in range(2)]
    sets = cut(listed.groupBy("wid").agg(F.count("*").alias("n"), *hashes).select("wid", F.md5(F.concat_ws(":", "n", "s0", "s1")).alias("set")))
    one = sets.groupBy("set").agg(F.min("wid").alias("wid"))
    members = cut(salted_join(listed, cut(one), "wid").select("set", "item"))
    of_text = salted_join(held, sets, "wid").groupBy("key").agg(F.array_sort(F.collect_set("set")).alias("sets"))  # a text's own windows
    of_text = cut(of_text.withColumn("combination", F.md5(F.array_join("sets", ":"))))
    every = of_text.dropDuplicates(["combination"]).select("combination", F.explode("sets").alias("set"))
    items = salted_join(every, members, "set").groupBy("combination").agg(F.array_sort(F.collect_set("item")).alias("items"))
    digested = items.select("combination", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return salted_join(of_text.select("key", "combination"), cut(digested), "combination").select("key", "n_items", "items_sha256")


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256 and contaminated."""
    docs, new, back = aside(docs)
    text = new.get(text, text)
    hits = broadcast_if_small(verdicts(docs, items, text, item_id, item_text, size)).withColumnsRenamed({"key": "__key", "n_hit": "__hit", "n_items": "__n", "items_sha256": "__sha"})
    keep = [c for c in docs.columns if c not in OUTPUTS]
    own = docs.select(*keep, F.size(_words(F.col(text))).cast("long").alias("n_words"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("__key"))
    out = own.join(hits, "__key", "left")
    return out.select(
        *keep,
        "n_words",
        F.coalesce("__hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("__n", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("__sha", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        F.col("__hit").isNotNull().alias("contaminated"),
    ).withColumnsRenamed(back)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate(docs.select("doc_id", "text"), items).drop("text")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), i AS (
  SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark
), cuts AS (
  SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0
), win AS (
  SELECT DISTINCT item, w[s:s + 9] AS ws, w[s] AS word FROM cuts
), pos AS (
  SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM d
), hit AS (
  SELECT r, p, len(ws) AS n, item FROM (SELECT r, w, p, w[p] AS word FROM pos) JOIN win USING (word)
  WHERE w[p:p + len(ws) - 1] = ws
), places AS (
  SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM hit) GROUP BY r
), listed AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hit WHERE item IS NOT NULL) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN listed USING (r)
"""

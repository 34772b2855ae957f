"""Information-theoretic sanitisation of personal data, in DataFrame functions only.

Protected entities are e-mail addresses, IPv4 addresses, card numbers and phone numbers, found by pattern. A term
near an entity may give it away even when the entity is masked. How much is estimated from the whole corpus: with N
texts, an entity e in n(e) of them, a term t in n(t), and t near e in n(e,t), the term discloses

    PMI(e;t) / IC(e) = log(n(e,t) N / (n(e) n(t))) / log(N / n(e))

of the entity's information: 1 if the term occurs only beside e, 0 if it is independent. A term seen beside e in at
least `support` different texts is generalised to its kind of token where this surely reaches `generalise`, wherever in
the corpus it occurs, and removed where it reaches `remove`. Surely: with the lower end of the interval of n(e,t) / n(t),
`confidence` standard errors below, in its place. So a few texts in which a rare term and a rare entity meet by chance (or
near copies of one) don't count as much as many. A term is judged by its highest value over all entities for which it is
sure. An entity that more than the part `common` of all texts hold (a half: less than one bit to give away) discloses
nothing.

Copies of a text count once everywhere: N, n(e), n(t) and n(e,t) are numbers of different texts.

Only a stretch of `near` characters on either side of an entity counts as near, so the pairs grow with the entities, not
with document length times entities. Terms that can't reach the threshold (by their counts beside entities, then in the
texts with entities) are dropped before the pass over the corpus that counts the rest.

Patterns use possessive groups and start only where a run starts: the matches are those of the plain patterns, without
recursion and in linear time on very long texts. Places are sums over the pieces between matches, taken over rows; what
is beside or between spans is read from pieces of CHUNK characters. So a text with very many spans takes time in
proportion to its length and its spans.

Defined results: null text is empty and stays null. Offsets are code points, the end exclusive. Failing matches are
dropped and not retried. Term spans never overlap base spans. Repeated rows each get their row. Extra columns are kept by
sanitise(); outputs replace columns of the same name. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import LOWER, UPPER, aside, broadcast_if_small, cut, salted_join, table

KINDS = ("email", "ip", "card", "phone", "term")
LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Separators of terms, in text that is not lower-cased.
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
TERM = BREAK.replace("[", "[^", 1)
NEAR, SUPPORT, GENERALISE, REMOVE = 64, 3, 0.8, 0.95
CONFIDENCE, COMMON = 0.84, 0.5  # standard errors (a one-sided level of 80 %); part of all texts
CHUNK = 2048
SPANS = "array<struct<start:int,kind:int,end:int,value:string,upto:int>>"
OUTPUTS = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_term")


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return x.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        return F.when(F.length(_digits(x)).between(12, 19), _luhn(_digits(x))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(x)).between(9, 15)
    return F.lit(True)


def _matches(text: Column, pattern: str, kind: int) -> Column:
    """All matches, each with the length of what is between it and the one before."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    return F.zip_with(found, between, lambda m, gap: F.struct(F.lit(kind).alias("kind"), F.length(gap).alias("gap"), m.alias("value")))


def _placed(texts: DataFrame, matches: Column) -> DataFrame:
    """(key, kind, start, end, value) of the matches of texts (key, t)."""
    rows = texts.select("key", F.posexplode(matches).alias("i", "m")).select("key", "i", "m.*")
    upto = Window.partitionBy("key", "kind").orderBy("i")
    ends = rows.withColumn("end", F.sum(F.col("gap") + F.length("value")).over(upto).cast("int"))
    return ends.select("key", "kind", (F.col("end") - F.length("value")).alias("start"), "end", "value")


def base_spans(texts: DataFrame) -> DataFrame:
    """(key, kind, start, end, value) of the base spans of texts (key, t). kind is the place in KINDS."""
    parts, t = [], F.col("t")
    for k, kind in enumerate(KINDS[:4]):
        needed = F.lit(True) if kind not in ("email", "phone") else F.contains(t, F.lit("@" if kind == "email" else "+"))
        parts.append(F.when(needed & t.rlike(PATTERNS[kind]), _matches(t, PATTERNS[kind], k)))
    none = F.array().cast("array<struct<kind:int,gap:int,value:string>>")
    valid = F.lit(False)
    for k, kind in enumerate(KINDS[:4]):
        valid = F.when(F.col("kind") == k, _valid(kind, F.col("value"))).otherwise(valid)
    return _placed(texts, F.concat(*(F.coalesce(x, none) for x in parts))).where(valid)


def _chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{CHUNK}}}"), F.lit(0))


def _between(chunks: Column, start: Column, end: Column) -> Column:
    """The characters from start to end of a text in chunks. What is beyond the text is empty."""
    first, last = F.floor(start / CHUNK).cast("int"), F.floor(end / CHUNK).cast("int")
    head, tail = F.coalesce(F.get(chunks, first), F.lit("")), F.coalesce(F.get(chunks, last), F.lit(""))
    inside = F.substring(head, start % CHUNK + 1, end - start)
    middle = F.array_join(F.slice(chunks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    across = F.concat(F.substring(head, start % CHUNK + 1, F.lit(CHUNK)), middle, F.substring(tail, F.lit(1), end % CHUNK))
    return F.when(end <= start, "").when(first == last, inside).otherwise(across)


def _terms(text: Column) -> Column:
    """Lower-cased terms with a letter, of three characters or more."""
    return F.filter(F.split(F.translate(text, UPPER, LOWER), BREAK + "+", -1), lambda w: (F.length(w) > 2) & w.rlike("[^0-9]"))


def _near(chunks: Column, start: Column, end: Column, near: int) -> Column:
    """Terms beside a span. Terms cut by the stretch's outer end are left out.

    The stretch is taken with one more character where there is one: that character's run is what the end cuts."""
    left = _between(chunks, F.greatest(start - near - 1, F.lit(0)), start)
    left = F.when(start > near, F.regexp_replace(left, rf"\A(?:{TERM}++|{BREAK})", "")).otherwise(left)
    right = _between(chunks, end, end + near + 1)
    right = F.when(F.length(right) > near, F.regexp_replace(right, rf"(?:(?<!{TERM}){TERM}++|{BREAK})\z", "")).otherwise(right)
    return _terms(F.concat(left, F.lit(" "), right))


def entity_spans(docs: DataFrame, text: str, near: int = NEAR) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(key, kind, start, end, value) of the base spans of the distinct texts, (key, entity, term) of what is beside them and
    not part of a span of the text, and (key, t) of these texts."""
    found = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t")).where(
        F.greatest(*(F.col("t").rlike(p) for p in PATTERNS.values()))
    )
    found = cut(found.select(F.md5("t").alias("key"), "t").dropDuplicates(["key"]))
    spans = cut(base_spans(found))
    places = spans.groupBy("key").agg(F.collect_list(F.struct("start", "end", "value")).alias("x"))  # a text's own
    # a generator's rows must not carry the text along: they are held together, a text's at once
    around = found.join(places, "key").select("key", _chunks(F.col("t")).alias("chunks"), "x")
    beside = F.transform("x", lambda s: F.struct(F.lower(s["value"]).alias("entity"), _near(F.col("chunks"), s["start"], s["end"], near).alias("terms")))
    beside = around.select("key", F.explode(beside).alias("b")).select("key", "b.entity", F.explode("b.terms").alias("term")).distinct()
    own = spans.select("key", F.explode(_terms(F.col("value"))).alias("term")).distinct()
    return spans, cut(beside.join(own, ["key", "term"], "left_anti").select("key", "entity", "term")), found


def least_part(some: Column, of: Column, confidence: float) -> Column:
    """Lower end of Wilson's interval of a part, so many standard errors below."""
    p, z2 = some / of, confidence**2
    return (p + z2 / (2 * of) - confidence * F.sqrt(p * (1 - p) / of + z2 / (4 * of * of))) / (1 + z2 / of)


def disclosures(docs: DataFrame, spans: DataFrame, pairs: DataFrame, found: DataFrame, text: str, support: int, generalise: float, confidence: float = CONFIDENCE, common: float = COMMON) -> tuple[DataFrame, DataFrame]:
    """(term, share) of the terms that disclose an entity, and (key, term) of the texts that hold them."""
    n_texts = docs.select(F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))).alias("key")).distinct().count()
    together = pairs.groupBy("entity", "term").agg(F.count("*").alias("n_et"))
    n_e = spans.select("key", F.lower("value").alias("entity")).distinct().groupBy("entity").agg(F.count("*").alias("n_e"))
    n_floor = pairs.select("key", "term").distinct().groupBy("term").agg(F.count("*").alias("n_floor"))
    share = lambda part: 1 + F.log(part) / F.log(n_texts / F.col("n_e"))  # noqa: E731  of the entity's information, if the term's texts have it so often
    part = F.col("n_et") / F.col("n_t")
    sure = share(least_part(F.col("n_et"), F.col("n_t"), confidence)) >= generalise
    seen = together.where(F.col("n_et") >= support).join(n_e, "entity").where(F.col("n_e") <= common * n_texts)
    likely = cut(seen.join(n_floor.withColumnRenamed("n_floor", "n_t"), "term").where(sure).drop("n_t"))

    def holding(body: DataFrame) -> DataFrame:
        """(key, term) of the texts (t) that hold the likely terms."""
        words = F.array_distinct(F.split(F.translate("t", UPPER, LOWER), BREAK + "+", -1))
        spread = body.select(F.unhex(F.md5("t")).alias("key"), F.explode(words).alias("term"))
        return salted_join(spread, cut(likely.select("term").distinct()), "term").distinct()

    def counted(held: DataFrame) -> DataFrame:
        return likely.join(held.groupBy("term").agg(F.count("*").alias("n_t")), "term").where(sure)

    # the texts with entities tell most terms apart that are common elsewhere too, before all texts are looked at
    likely = cut(counted(holding(found)).drop("n_t"))
    held = cut(holding(docs.select(F.coalesce(F.col(text), F.lit("")).alias("t"))))
    terms = cut(counted(held).groupBy("term").agg(F.max(share(part)).alias("share")))
    return terms, held.select(F.lower(F.hex("key")).alias("key"), "term")


def all_spans(docs: DataFrame, text: str, support: int, generalise: float, remove: float, near: int, confidence: float = CONFIDENCE, common: float = COMMON) -> DataFrame:
    """(key, spans) of the distinct texts with base or term spans, by start and kind. A term's value is what replaces it;
    upto is the end of all spans before."""
    base, pairs, found = entity_spans(docs, text, near)
    terms, held = disclosures(docs, base, pairs, found, text, support, generalise, confidence, common)
    known = broadcast_if_small(terms)
    keys = broadcast_if_small(cut(held.join(known, "term", "left_semi").select("key").distinct()))
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("key", F.md5("t")).join(keys, "key", "left_semi").dropDuplicates(["key"])
    runs = _placed(texts, _matches(F.col("t"), TERM + "++", 4)).withColumn("term", F.translate("value", UPPER, LOWER))
    kind = F.when(F.col("value").rlike("[0-9]"), "[CODE]").when(F.col("value").rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]")
    put = F.when(F.col("share") >= remove, F.lit("")).otherwise(kind)
    located = salted_join(runs, terms, "term").select("key", "kind", "start", "end", put.alias("value"))
    # a term stands free if no base span before it ends, and none after it starts, within it
    spans_of = Window.partitionBy("key")
    before = spans_of.orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    after = spans_of.orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)  # from the end
    is_base = F.col("kind") < 4
    both = base.union(located).select("*", F.max(F.when(is_base, F.col("end"))).over(before).alias("ended"), F.min(F.when(is_base, F.col("start"))).over(after).alias("starts"))
    free = (F.coalesce("ended", F.lit(0)) <= F.col("start")) & (F.coalesce("starts", "end") >= F.col("end"))
    kept = both.where(is_base | free).select("key", "kind", "start", "end", "value", F.coalesce(F.max("end").over(before), F.lit(0)).alias("upto"))
    listed = F.array_sort(F.collect_list(F.struct("start", "kind", "end", "value", "upto")))  # a text's own
    return cut(kept.groupBy("key").agg(listed.cast(SPANS).alias("spans")))


def _masked_text(chunks: Column, spans: Column) -> Column:
    """The text in chunks with base spans masked by kind and terms replaced; where spans overlap, the first decides."""
    marks = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    put = lambda x: F.when(x["kind"] == 4, x["value"]).otherwise(F.element_at(marks, x["kind"] + 1))
    parts = F.transform(F.filter(spans, lambda x: x["start"] >= x["upto"]), lambda x: F.concat(_between(chunks, x["upto"], x["start"]), put(x)))
    return F.concat(F.array_join(parts, ""), _between(chunks, F.array_max(F.transform(spans, lambda x: x["end"])), F.size(chunks) * CHUNK))


def sanitise(docs: DataFrame, text: str = "text", support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE, near: int = NEAR, confidence: float = CONFIDENCE, common: float = COMMON) -> DataFrame:
    """docs with their text sanitised, the counts of base spans, and all spans of the original text."""
    docs, new, back = aside(docs)
    text = new.get(text, text)
    marked = broadcast_if_small(all_spans(docs, text, support, generalise, remove, near, confidence, common), 100_000).withColumnsRenamed({"key": "__key", "spans": "__spans"})
    keep = [c for c in docs.columns if c not in OUTPUTS]
    own = docs.select(*keep, F.md5(F.coalesce(F.col(text), F.lit(""))).alias("__key"))
    spans = F.coalesce("__spans", F.array().cast(SPANS))
    names = F.array(*map(F.lit, KINDS))

    def listed(x: Column) -> Column:
        return F.array_join(F.transform(x, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")

    def count(k: int) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")

    some = F.col("__spans").isNotNull()
    joined = own.join(marked, "__key", "left").withColumn("__chunks", F.when(some, _chunks(F.col(text))))
    safe = F.when(some, _masked_text(F.col("__chunks"), F.col("__spans"))).otherwise(F.col(text))
    return joined.select(
        *(c for c in keep if c != text),
        safe.alias(text),
        *(count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)),
        F.sha2(listed(F.filter(spans, lambda s: s["kind"] < 4)), 256).alias("base_sha256"),
        listed(spans).alias("spans"),
    ).withColumnsRenamed(back)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sanitise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_term")

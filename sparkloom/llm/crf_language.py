"""Language of words and texts by a linear-chain conditional random field.

Each word gets scores from its affixes (first and last three letters, bounds marked), its letter trigrams and, if the
training texts hold it often enough, a lexicon entry. Learned transitions join the words of a sentence, and
forward-backward gives each word's posterior over the languages, so a word that could be of either language follows its
neighbours, and a text that switches gets a label for each stretch. A text's language has the largest share of its
letters, weighing each word's posterior by its letters; that share is the score. Shares say which of the learned languages
fits best, not whether any does; for that, `known` is the share of a text's trigrams (of words with a letter) that
training texts have at all, whatever the number of languages: close to 1 for text in a learned language.

Chains end at sentence ends and line ends, and after CHAIN words where there are none; every word is in one chain.

Training: at most `per_language` texts of each language, those with the smallest residues of their digests, for as long
as those before them have less than `train_bytes`. This bounds the sample on the driver; training and predictions read
whole texts. Words of a text take the text's language as label. Weights are fitted by AdaGrad on the chains' conditional log-likelihood.

Defined results: null text, or text without a letter, is `und` with score and known 0. Without usable training rows every text is
`und`. Ties between languages go to the first by name. Repeated rows each get their row; extra columns are kept, those
with the outputs' names are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm import textvec as tv
from sparkloom.llm.common import cut, last_within, table

CHAIN = 64
BITS = 18
TABLE = 1 << BITS  # hashed triples of code points
LEXICON = 1 << 16
OUTPUTS = ("lang_pred", "score", "known")
ENDS = np.array([ord(c) for c in ".!?\n…。"], np.uint32)


@dataclass
class Model:
    languages: list[str]
    emit: np.ndarray  # rows of the features that training texts have x languages; row 0 is of all others
    move: np.ndarray  # languages x languages
    row: np.ndarray  # row of each feature: trigrams, prefixes, suffixes, lexicon


def features(w: tv.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Trigram codes of all words with the counts a word, and prefix, suffix and lexicon rows of each word."""
    # a word of n letters, with bounds marked by 0, has n trigrams
    c = np.concatenate((np.zeros(1, np.uint32), w.cls, np.zeros(1, np.uint32)))
    at = tv.positions(w.start, w.end)
    tri = tv.gram_codes([c[at], c[at + 1], c[at + 2]], BITS).astype(np.int64)
    n = w.end - w.start
    padded = np.concatenate((w.cls, np.zeros(3, np.uint32)))
    none = np.uint32(0)
    second = np.where(n > 1, padded[w.start + 1], none)
    third = np.where(n > 2, padded[np.minimum(w.start + 2, len(padded) - 1)], none)
    prefix = tv.gram_codes([padded[w.start], second, third], BITS).astype(np.int64)
    before = np.where(n > 1, padded[w.end - 2], none)
    earlier = np.where(n > 2, padded[np.maximum(w.end - 3, 0)], none)
    suffix = tv.gram_codes([earlier, before, padded[w.end - 1]], BITS).astype(np.int64)
    word = (tv.word_hashes(w.cls, w.start, w.end) % np.uint64(LEXICON)).astype(np.int64)
    return tri, n, TABLE + prefix, 2 * TABLE + suffix, 3 * TABLE + word


def chains(w: tv.Words) -> tuple[np.ndarray, np.ndarray]:
    """First word and number of words of each chain."""
    k = len(w.start)
    if not k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.concatenate(([0], np.cumsum(np.isin(w.cps, ENDS))))
    sentence = ends[w.start]
    new = np.concatenate(([True], sentence[1:] != sentence[:-1]))
    first = np.flatnonzero(new)
    within = np.arange(k) - np.repeat(first, np.diff(np.append(first, k)))
    first = np.flatnonzero(within % CHAIN == 0)
    return first, np.diff(np.append(first, k))


def scores(m: Model, w: tv.Words) -> tuple[np.ndarray, np.ndarray]:
    """Emission scores, words x languages, and the number of each word's trigrams that training texts have."""
    tri, n, prefix, suffix, word = features(w)
    if not len(n):
        return np.zeros((0, len(m.languages)), np.float32), n
    row = m.row[tri]
    first = np.cumsum(n) - n
    sums = np.add.reduceat(m.emit[row], first, axis=0)
    all_scores = sums / np.sqrt(n)[:, None].astype(np.float32) + m.emit[m.row[prefix]] + m.emit[m.row[suffix]] + m.emit[m.row[word]]
    return all_scores, np.add.reduceat((row > 0).astype(np.int32), first)


def forward_backward(emit: np.ndarray, move: np.ndarray, first: np.ndarray, size: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of all words, and the expected transitions if asked for. Chains go side by side, longest first."""
    n_lang = len(move)
    e = np.exp(emit - emit.max(axis=1, keepdims=True))
    t = np.exp(move - move.max())
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    steps = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(1, steps + 1), "right")  # chains with a word at each step
    alpha, beta = np.empty_like(e), np.ones_like(e)
    for s in range(steps):
        at = first[: active[s]] + s
        a = e[at] if s == 0 else (alpha[at - 1] @ t) * e[at]
        alpha[at] = a / a.sum(axis=1, keepdims=True)
    expected = np.zeros((n_lang, n_lang))
    for s in range(steps - 2, -1, -1):
        at = first[: active[s + 1]] + s
        ahead = e[at + 1] * beta[at + 1]
        b = ahead @ t.T
        if pairs:
            joint = alpha[at][:, :, None] * t[None] * ahead[:, None, :]
            expected += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        beta[at] = b / b.sum(axis=1, keepdims=True)
    post = alpha * beta
    return post / post.sum(axis=1, keepdims=True), expected


def fit(rows: list[tuple[str, str]], rounds: int = 4, rate: float = 0.3, least: int = 4) -> Model:
    """A model from (text, language)."""
    languages = sorted({lang for _, lang in rows})
    k = len(languages)
    m = Model(languages, np.zeros((1, k), np.float32), np.zeros((k, k), np.float32), np.zeros(3 * TABLE + LEXICON, np.int32))
    if not k:
        return m
    rng = np.random.default_rng(7)
    label = {lang: i for i, lang in enumerate(languages)}
    w = tv.split([t for t, _ in rows])
    counts = Counter((tv.word_hashes(w.cls, w.start, w.end) % np.uint64(LEXICON)).tolist())
    known = np.zeros(LEXICON, bool)
    known[[x for x, c in counts.items() if c >= least]] = True
    tri, _, prefix, suffix, _ = features(w)
    seen_ids = np.unique(np.concatenate((tri, prefix, suffix, 3 * TABLE + np.flatnonzero(known))))
    m.row[seen_ids] = np.arange(1, len(seen_ids) + 1)
    m.emit = np.zeros((len(seen_ids) + 1, k), np.float32)
    if k < 2:  # nothing to tell apart
        return m
    grad_e, grad_m = np.full_like(m.emit, 1e-2), np.full_like(m.move, 1e-2)
    lang_of = np.array([label[lang] for _, lang in rows])
    batches = [np.sort(x) for x in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 40, sum(len(t) for t, _ in rows) // 1_000_000))]
    for _ in range(rounds):
        for batch in batches:
            w = tv.split([rows[i][0] for i in batch])
            if not len(w.start):
                continue
            first, size = chains(w)
            gold = lang_of[batch][w.doc]
            post, expected = forward_backward(scores(m, w)[0], m.move, first, size, pairs=True)
            g = -post
            g[np.arange(len(gold)), gold] += 1
            tri, n, prefix, suffix, word = features(w)
            inner = np.ones(len(gold), bool)
            inner[first + size - 1] = False
            seen = np.zeros((k, k))
            np.add.at(seen, (gold[inner], gold[inner]), 1)  # the words of a chain have one label
            step_m = (seen - expected) / len(gold)
            grad_m += step_m**2
            m.move += rate * step_m / np.sqrt(grad_m)
            spread = np.repeat(g / np.sqrt(n)[:, None], n, axis=0)
            lex = known[word - 3 * TABLE]
            ids = np.concatenate((tri, prefix, suffix, word[lex]))
            all_g = np.concatenate((spread, g, g, g[lex]))
            rows_at, inverse = np.unique(m.row[ids], return_inverse=True)
            step = np.stack([np.bincount(inverse, all_g[:, j], len(rows_at)) for j in range(k)], axis=1) / len(first)
            step -= 1e-4 * m.emit[rows_at]
            grad_e[rows_at] += step**2
            m.emit[rows_at] += rate * step / np.sqrt(grad_e[rows_at])
    return m


def label_words(m: Model, text: str) -> list[tuple[str, str, float]]:
    """Each word of a text with its language and posterior."""
    w = tv.split([text])
    if not len(w.start) or not m.languages:
        return []
    first, size = chains(w)
    post, _ = forward_backward(scores(m, w)[0], m.move, first, size)
    return [(text[s:e], m.languages[int(p.argmax())], float(p.max())) for s, e, p in zip(w.start, w.end, post, strict=True)]


def label_texts(m: Model, texts: list[str]) -> tuple[list[str], list[float], list[float]]:
    """The language of each text, its share of the text's letters, and the share of trigrams that training texts have."""
    n = len(texts)
    if not m.languages:
        return ["und"] * n, [0.0] * n, [0.0] * n
    w = tv.split(texts)
    marks = np.concatenate(([0], np.cumsum(tv.letters(w.cps))))
    weight = (marks[w.end] - marks[w.start]).astype(np.float64)
    first, size = chains(w)
    emit, seen = scores(m, w)
    post, _ = forward_backward(emit, m.move, first, size)
    share = np.stack([np.bincount(w.doc, post[:, j] * weight, n) for j in range(len(m.languages))], axis=1) if len(w.start) else np.zeros((n, len(m.languages)))
    total = share.sum(axis=1)
    best = share.argmax(axis=1)
    names = [m.languages[b] if x > 0 else "und" for b, x in zip(best, total, strict=True)]
    has = weight > 0
    known = np.bincount(w.doc, seen * has, n) / np.maximum(np.bincount(w.doc, (w.end - w.start) * has, n), 1)
    return names, np.where(total > 0, share[np.arange(n), best] / np.maximum(total, 1e-9), 0).clip(0, 1).tolist(), known.tolist()


def train(docs: DataFrame, text: str = "text", lang: str = "lang", per_language: int = 300, train_bytes: int = 4_000_000) -> Model:
    """Fit on a bounded sample of docs: rows with text and language."""
    usable = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    counts = {r[0]: r[1] for r in usable.groupBy(F.col(lang)).count().collect()}
    if not counts:
        return fit([])
    # Digests below a bound that about 1.5 times the wanted texts of a language have: no sort, and copies count once.
    bound = F.create_map(*(F.lit(x) for name, n in counts.items() for x in (name, int(min(1.0, 1.5 * per_language / n) * (1 << 30)))))
    digest = F.xxhash64(text)
    some = usable.withColumn("__place", F.pmod(digest, F.lit(1 << 30))).where(F.col("__place") < F.element_at(bound, F.col(lang)))
    some = some.select(F.col(lang).alias("lang"), F.col("__place").alias("place"), F.col(text).alias("text"), digest.alias("digest"))
    some = cut(some.dropDuplicates(["lang", "digest"]))
    last = last_within(some.select("lang", "place", F.octet_length("text")).collect(), dict.fromkeys(counts, train_bytes))
    ends = F.create_map(*(F.lit(x) for pair in last.items() for x in pair)) if last else F.lit(None).cast("map<string,bigint>")
    rows = sorted((r.lang, r.place, r.text) for r in some.where(F.col("place") <= F.element_at(ends, F.col("lang"))).collect())
    taken: Counter[str] = Counter()
    kept = []
    for name, _, body in rows:
        if taken[name] < per_language:
            taken[name] += 1
            kept.append((body, name))
    return fit(kept)


def detect(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred, score and known."""
    keep = [c for c in docs.columns if c not in OUTPUTS]
    sent = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(*keep)
    at = keep.index(text)
    schema = T.StructType([*src.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("known", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tv.sliced(batch, at, 8_000_000 // max(8, len(sent.value.languages))):
                names, sure, known = label_texts(sent.value, [x.as_py() or "" for x in part.column(at)])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(sure, pa.float64()), pa.array(known, pa.float64())], names=[*keep, *OUTPUTS])

    return src.mapInArrow(run, schema)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out)
    model = train(docs.where(~F.col("held_out")))
    return detect(docs.select("doc_id", "held_out", "text"), model).drop("text")

"""Toxicity by a support vector machine over a gapped subsequence kernel with Nyström landmarks.

The kernel compares words by their subsequences of three characters, bounds marked, where a skipped character costs a
factor DECAY and at most GAPS are skipped. An insult keeps most of its subsequences when characters are put in between.
Before that, signs inside a word are dropped and runs of single letters are joined, so `i.d-i o t` gives one word. A
word's feature vector is scaled by what a word of its length has without repeats.

Landmarks are some of the training words. With their kernel matrix K, words map to k(x) K^(-1/2), and a linear machine
with squared hinge loss is fitted there by Newton's method. A text is toxic if one of its words is: the machine is
trained on the words that stand for their texts (the worst word of each toxic text, the worst few of each other text),
which are chosen again with each round's machine. Of a toxic text only words count that a first guess, from how often
runs of characters occur in toxic and in other texts, sets above nearly all other texts' words; toxic texts without one
are left out. So the insults of rarer languages are not lost beside those of the most frequent. Each chosen word is there
a second time with a character put in. As the kernel is linear in subsequence counts, the sum over landmarks
folds into one weight a subsequence, and scoring a text is a few table look-ups a character, over the whole text.

A text's value is its highest word value; a logistic fit on texts that the machine was not fitted on makes it a score.

Training: about `per_class` toxic and twice as many other labelled texts, whole, in the order of their digests for as
long as those before them have less than `train_bytes` (a third of it for toxic ones), which bounds the sample on the
driver. Words of more than PIECE characters are cut into overlapping pieces.

Defined results: null text is empty; an empty text has no word and gets the value of a word without subsequences.
Without rows of both labels, every score is 0. Repeated rows each get their row; extra columns are kept, those with the
outputs' names are replaced. Of several labels for one id, or for equal texts, the higher counts. Very long texts are read
whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm import textvec as tv
from sparkloom.llm.common import cut, last_within, table

DECAY, GAPS, PIECE = 0.6, 2, 32
PLACES = [(a, b) for a in range(GAPS + 1) for b in range(GAPS + 1 - a)]  # characters skipped before and after the middle
LANDMARKS, ROUNDS, WORST = 480, 5, 4
RUNS = (4, 6, 8)  # characters of the runs that the first guess counts
PLAIN = 0.95  # share of other texts above whose best guess a toxic text's must be to teach
PUT_IN = np.frombuffer(b"0123456789abcdefghijklmnopqrstuvwxyz", np.uint8).astype(np.uint32)
_SPACE = np.zeros(0x10000, bool)
_SPACE[[cp for cp in range(0x10000) if not 0xD800 <= cp < 0xE000 and chr(cp).isspace()]] = True


@dataclass
class Model:
    weight: np.ndarray | None  # of each subsequence code
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0


@dataclass
class Stream:
    """Marked words laid end to end: 0, lower-cased code points, 0."""

    cls: np.ndarray
    first: np.ndarray  # of each word, its opening mark
    size: np.ndarray  # with marks
    doc: np.ndarray


def words(texts: list[str]) -> Stream:
    cps, bounds = tv.lay(texts)
    cls = tv.classes(cps)
    space = _SPACE[np.minimum(cps, 0xFFFF)]
    at = np.flatnonzero(cls)
    if not len(at):
        none = np.zeros(0, np.int64)
        return Stream(np.zeros(0, np.uint32), none, none, none)
    token = np.cumsum(space)[at]
    start = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
    doc = np.searchsorted(bounds, at[start], "right")
    n = np.diff(np.append(start, len(at)))
    alone = (n == 1) & np.concatenate(([False], (n[1:] == 1) & (n[:-1] == 1) & (doc[1:] == doc[:-1])))[: len(n)]
    start, doc = start[~alone], doc[~alone]
    n = np.diff(np.append(start, len(at)))
    if len(n) and n.max() > PIECE:
        parts = [np.arange(0, max(1, k - PIECE // 2), PIECE // 2) if k > PIECE else np.zeros(1, np.int64) for k in n]
        times = [len(p) for p in parts]
        offset = np.concatenate(parts)
        n = np.minimum(np.repeat(n, times) - offset, PIECE)
        start, doc = np.repeat(start, times) + offset, np.repeat(doc, times)
    out = np.zeros(int(n.sum()) + 2 * len(n), np.uint32)
    first = np.cumsum(n + 2) - (n + 2)
    out[tv.positions(first + 1, first + 1 + n)] = cls[at[tv.positions(start, start + n)]]
    return Stream(out, first, n + 2, doc)


def self_kernel(size: np.ndarray) -> np.ndarray:
    """Of a marked word of each size without repeated subsequences."""
    total = np.zeros(len(size))
    for a, b in PLACES:
        total += DECAY ** (2 * (a + b)) * np.maximum(size - 2 - a - b, 0)
    return np.maximum(total, 1.0)


def subsequences(s: Stream) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each way to skip: codes of the subsequence from every place, whether it stays in the word, and its worth."""
    c = s.cls
    owner = np.repeat(np.arange(len(s.size), dtype=np.int32), s.size)
    for a, b in PLACES:
        j, k = 1 + a, 2 + a + b
        if len(c) > k:
            yield tv.gram_codes([c[:-k], c[j : len(c) - k + j], c[k:]], 18), owner[:-k] == owner[k:], DECAY ** (a + b)


def values(m: Model, s: Stream) -> np.ndarray:
    """The machine's value of every word."""
    total = np.zeros(len(s.cls), np.float32)
    for code, inside, worth in subsequences(s):
        total[: len(code)] += m.weight[code] * inside * np.float32(worth)
    return np.add.reduceat(total, s.first) / np.sqrt(self_kernel(s.size)) + m.bias if len(s.first) else np.zeros(0)


def text_values(m: Model, texts: list[str]) -> np.ndarray:
    s = words(texts)
    out = np.full(len(texts), m.bias)
    if len(s.doc):
        first = np.flatnonzero(np.concatenate(([True], s.doc[1:] != s.doc[:-1])))
        out[s.doc[first]] = np.maximum.reduceat(values(m, s), first)
    return out


def taken(s: Stream, at: np.ndarray) -> Stream:
    size = s.size[at]
    return Stream(s.cls[tv.positions(s.first[at], s.first[at] + size)], np.cumsum(size) - size, size, s.doc[at])


def entries(s: Stream) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, code, value) of the scaled feature vectors, by word."""
    owner = np.repeat(np.arange(len(s.size), dtype=np.int32), s.size)
    parts = [(owner[: len(code)][inside], code[inside], np.full(int(inside.sum()), worth)) for code, inside, worth in subsequences(s)]
    word, code, value = (np.concatenate([p[k] for p in parts]) for k in range(3))
    order = np.argsort(word, kind="stable")
    word, code, value = word[order], code[order], value[order]
    return word, code, value / np.sqrt(self_kernel(s.size))[word]


def kernel(s: Stream, marks: Stream) -> np.ndarray:
    """Kernel values, words x landmarks."""
    word, code, value = entries(marks)
    codes, at = np.unique(code, return_inverse=True)
    z = np.zeros((len(codes) + 1, len(marks.size)))
    np.add.at(z, (at, word), value)
    out = np.zeros((len(s.size), len(marks.size)))
    for lo in range(0, len(s.size), 1000):
        part = taken(s, np.arange(lo, min(lo + 1000, len(s.size))))
        word, code, value = entries(part)
        at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
        hit = codes[at] == code
        word, at, value = word[hit], at[hit], value[hit]
        if len(word):
            start = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            out[lo + word[start]] = np.add.reduceat(z[at] * value[:, None], start, axis=0)
    return out


def machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 10.0) -> np.ndarray:
    """Weights and bias (last) of a linear machine with squared hinge loss."""
    x = np.concatenate((x, np.ones((len(x), 1))), axis=1)
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(20):
        margin = 1 - y * (x @ w)
        on = margin > 0
        xs, c = x[on], weight[on] * cost
        new = np.linalg.solve(ridge + (xs * c[:, None]).T @ xs, (xs * c[:, None]).T @ y[on])
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w


def gapped(s: Stream, rng: np.random.Generator) -> Stream:
    """The words with one character put in at a random inner place."""
    at = s.first + 1 + (rng.random(len(s.size)) * np.maximum(s.size - 3, 0)).astype(np.int64) + (s.size > 3)
    cls = np.insert(s.cls, at, PUT_IN[rng.integers(0, 36, len(at))])
    return Stream(cls, s.first + np.arange(len(s.first)), s.size + 1, s.doc)


def platt(v: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic fit, with a light pull towards slope 2."""
    x = np.stack((np.clip(v, -1.5, 1.5), np.ones(len(v))), axis=1)
    w, pull = np.array([2.0, 0.0]), np.diag([0.05, 0.01])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + pull @ (w - [2.0, 0.0])
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull, g)
        w = w - np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def first_guess(s: Stream, labels: np.ndarray, own: np.ndarray, least: int = 3) -> np.ndarray:
    """A value for each word before there is a machine: of the runs of four to eight characters that it has, the highest log
    ratio of the shares of toxic and of other texts with it, each share moved by its standard error against the run, as
    runs in few texts have high ratios by chance. Runs in fewer than `least` toxic texts don't count."""
    c = s.cls
    owner = np.repeat(np.arange(len(s.size), dtype=np.int32), s.size)
    total = np.full(len(c), -9.0)
    n_pos, n_neg = max((own & (labels == 1)).sum(), 1), max((own & (labels == 0)).sum(), 1)
    for length in RUNS:
        if len(c) < length:
            break
        places = [np.zeros(len(c) - length + 1, np.uint32) for _ in range(4)]
        for k in range(length):  # codes take four places
            places[k % 4] = places[k % 4] * np.uint32(0x01000193) + c[k : len(c) - length + 1 + k]
        code = tv.gram_codes(places, 24)
        inside = owner[: len(code)] == owner[length - 1 :]
        pairs = np.unique(s.doc[owner[: len(code)][inside]] << 24 | code[inside])
        pairs = pairs[own[pairs >> 24]]
        toxic = labels[pairs >> 24] == 1
        codes, at = np.unique((pairs & (1 << 24) - 1).astype(np.int32), return_inverse=True)
        del pairs
        if not len(codes):
            continue
        pos, neg = np.bincount(at[toxic], minlength=len(codes)), np.bincount(at[~toxic], minlength=len(codes))
        sure, doubt = np.maximum(pos - np.sqrt(pos), 1e-9), neg + np.sqrt(neg) + 1
        ratio = np.where(pos >= least, np.log(sure / n_pos) - np.log(doubt / n_neg), -9.0)
        place = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
        known = inside & (codes[place] == code)
        total[: len(code)][known] = np.maximum(total[: len(code)][known], ratio[place[known]])
    return np.maximum.reduceat(total, s.first)


def fit(rows: list[tuple[str, int]]) -> Model:
    """A model from (text, label)."""
    highest: dict[str, int] = {}
    for t, y in rows:
        highest[t] = max(y, highest.get(t, y))
    rows = sorted(highest.items())
    rng = np.random.default_rng(11)
    rows = [rows[i] for i in rng.permutation(len(rows))]
    labels = np.array([y for _, y in rows])
    if not len(rows) or labels.min() == labels.max():
        return Model(None)
    own = np.ones(len(rows), bool)  # the others make the score
    for y in (0, 1):
        at = np.flatnonzero(labels == y)
        own[at[: len(at) // 3]] = False
    s = words([t for t, _ in rows])
    # each different word once a text
    ident = tv.word_hashes(s.cls, s.first, s.first + s.size)
    _, at = np.unique(tv.mix(s.doc.astype(np.uint64) + np.uint64(1)) ^ ident, return_index=True)
    s = taken(s, np.sort(at))
    s_label, s_own = labels[s.doc], own[s.doc]
    bounds = np.flatnonzero(np.concatenate(([True], s.doc[1:] != s.doc[:-1])))

    value = guess = first_guess(s, labels, own)
    m = Model(np.zeros(1 << 18, np.float32))
    ident = tv.word_hashes(s.cls, s.first, s.first + s.size)
    hard = np.zeros(0, np.int64)
    # A toxic text's words that would be nothing special in other texts say nothing. Should all be so, all count.
    others = s_own[bounds] & (s_label[bounds] == 0)
    tells = guess > (np.quantile(np.maximum.reduceat(guess, bounds)[others], PLAIN) if others.any() else np.inf)
    tells |= not (tells & s_own & (s_label == 1)).any()
    for _ in range(ROUNDS):
        telling = np.where(tells | (s_label == 0), value, -np.inf)
        worst_of = lambda y, k: np.concatenate([np.zeros(0, np.int64)] + [a + np.argsort(-telling[a:b], kind="stable")[:k] for a, b in zip(bounds, [*bounds[1:], len(value)], strict=True) if s_own[a] and s_label[a] == y])  # noqa: E731,B023
        good, bad = worst_of(0, WORST), worst_of(1, 1)
        bad = bad[tells[bad]]
        if not len(bad) or not len(good):
            return Model(None)
        _, at, count = np.unique(ident[bad], return_index=True, return_counts=True)
        common = bad[at[np.argsort(-count, kind="stable")]]
        spread = common[: LANDMARKS // 3]
        more = rng.permutation(common[LANDMARKS // 3 :])[: LANDMARKS // 3]
        # what once was among the worst of the others stays, each word once
        good = np.concatenate((hard, good))
        good = hard = good[np.unique(ident[good], return_index=True)[1]]
        near = good[np.argsort(-value[good], kind="stable")][: LANDMARKS // 6]
        marks = taken(s, np.concatenate((spread, more, near, rng.permutation(good)[: LANDMARKS // 6])))
        plain = rng.permutation(np.flatnonzero(s_own & (s_label == 0)))[: 2 * len(good)]
        plain = plain[np.unique(ident[plain], return_index=True)[1]]
        x = np.concatenate((kernel(taken(s, np.concatenate((bad, good, plain))), marks), kernel(gapped(taken(s, bad), rng), marks)))
        y = np.concatenate((np.ones(len(bad)), -np.ones(len(good) + len(plain)), np.ones(len(bad))))
        size, vectors = np.linalg.eigh(kernel(marks, marks))
        size, vectors = size[size > 1e-6], vectors[:, size > 1e-6]
        root = vectors / np.sqrt(size)
        half = (y > 0).mean()
        w = machine(x @ root, y, np.where(y > 0, 0.5 / half, 0.5 / (1 - half)) / len(y) * 1000)
        beta = root @ w[:-1]
        word, code, val = entries(marks)
        m.weight = np.bincount(code, val * beta[word], 1 << 18).astype(np.float32)
        m.bias = float(w[-1])
        value = values(m, s)
    top = np.full(len(rows), m.bias)
    top[s.doc[bounds]] = np.maximum.reduceat(value, bounds)
    m.slope, m.shift = platt(top[~own], labels[~own])
    return m


def text_scores(m: Model, texts: list[str]) -> np.ndarray:
    if m.weight is None:
        return np.zeros(len(texts))
    return 1 / (1 + np.exp(-np.clip(m.slope * text_values(m, texts) + m.shift, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", per_class: int = 700, train_bytes: int = 12_000_000) -> Model:
    """Fit on a bounded sample of the labelled rows of docs. Labels of other documents are not looked at, not even counted."""
    given = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("__given"))
    known = labels.join(given, labels[doc_id] == given["__given"], "left_semi").where(F.col(doc_id).isNotNull() & F.col(toxic).isin(0, 1)).groupBy(F.col(doc_id).alias("__id")).agg(F.max(toxic).alias("y"))
    counts = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    if set(counts) != {0, 1}:
        return Model(None)
    bound = F.create_map(*(F.lit(x) for y, n in counts.items() for x in (y, int(min(1.0, per_class * (1 + (y == 0)) / n) * (1 << 30)))))
    some = known.where(F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) < F.element_at(bound, F.col("y")))
    # about three times per_class rows by construction
    got = docs.where(F.col(text).isNotNull()).join(F.broadcast(some), F.col(doc_id) == F.col("__id")).select(F.col(text).alias("t"), "y", F.xxhash64(text).alias("digest"))
    got = cut(got.distinct())
    last = last_within(got.select("y", "digest", F.octet_length("t")).collect(), {1: train_bytes // 3, 0: train_bytes * 2 // 3})
    if set(last) != {0, 1}:
        return Model(None)
    return fit([(r.t, r.y) for r in got.where(F.col("digest") <= F.when(F.col("y") == 1, last[1]).otherwise(last[0])).collect()])


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score and predicted."""
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    src = docs.select(*keep)
    at = keep.index(text)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*src.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tv.sliced(batch, at):
                p = text_scores(sent.value, [x.as_py() or "" for x in part.column(at)])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], names=[*keep, "score", "predicted"])

    return src.mapInArrow(run, schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out)
    model = train(docs.where(~F.col("held_out")), table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "held_out", "text"), model).drop("text")

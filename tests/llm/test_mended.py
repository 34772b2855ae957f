"""Cases that once failed: labels that are held out, columns with the operators' own names, whole values, exact durations."""

import hashlib
import json
import pickle
import random
import tracemalloc
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import bpe, common, decontaminate, jaccard, kdtree, mpeg, pii, quotes, textvec, toxicity

SF = "/root/testdata/sf0.1"


def test_held_out_labels_change_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    seen = docs.where(~out)
    models = [toxicity.train(seen, x) for x in (labels, labels.where(~out), labels.withColumn("toxic", F.when(out, 1 - F.col("toxic")).otherwise(F.col("toxic"))))]
    assert models[0].weight is not None
    for m in models[1:]:
        assert np.array_equal(m.weight, models[0].weight) and (m.bias, m.slope, m.shift) == (models[0].bias, models[0].slope, models[0].shift)


def test_worst_texts_do_not_tie(monkeypatch):
    monkeypatch.setattr(toxicity, "text_values", lambda m, texts: np.array([1.6, 2.5, -2.0, -3.0]))
    p = toxicity.text_scores(toxicity.Model(np.ones(1, np.float32), 0.0, 2.0, 0.0), [""] * 4)
    assert p[1] > p[0] > 0.5 > p[2] > p[3]


# ---- names


OWN = ["__key", "__items", "__hit", "__n", "__sha", "__spans", "__chunks", "__own", "__id", "__tkey", "__quotes", "__t", "__url", "__at", "__c", "__p", "kept__key"]


def named(df):
    for k, c in enumerate(OWN):
        df = df.withColumn(c, F.lit(k))
    return df


def test_columns_with_the_operators_own_names(spark):
    docs = spark.createDataFrame([(1, "one two three a@b.example"), (1, "one two three a@b.example"), (2, None), (3, "one two three a@b.example")], "doc_id bigint, text string")
    items = named(spark.createDataFrame([("i", "one two three")], "item_id string, text string"))
    turns = spark.createDataFrame([("t", 0, "hello there"), ("t", 1, "> hello there\nyes")], "thread string, node int, text string")
    cases = {
        "decontaminate": (docs, lambda d: decontaminate.decontaminate(d, items)),
        "sanitise": (docs, pii.sanitise),
        "deduplicate": (docs, jaccard.deduplicate),
        "link": (turns, quotes.link),
    }
    for name, (df, f) in cases.items():
        plain, got = f(df), f(named(df))
        assert set(OWN) < set(got.columns), name
        assert all(list(r) == [*range(len(OWN))] for r in got.select(*OWN).collect()), name
        columns = sorted(plain.columns)
        assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, plain.select(*columns).collect())), name


def test_a_text_column_with_such_a_name(spark):
    docs = spark.createDataFrame([(1, "one two three a@b.example"), (2, None)], "doc_id bigint, __key string")
    items = spark.createDataFrame([("i", "one two three")], "item_id string, text string")
    got = decontaminate.decontaminate(docs, items, text="__key")
    assert got.columns[:2] == ["doc_id", "__key"] and sorted((r.doc_id, r.contaminated) for r in got.collect()) == [(1, True), (2, False)]
    safe = pii.sanitise(docs, text="__key")
    assert sorted((r.doc_id, r["__key"]) for r in safe.collect()) == [(1, "one two three [EMAIL]"), (2, None)]


def test_names_are_set_aside_and_given_back(spark):
    df, new, back = common.aside(named(spark.createDataFrame([(1,)], "a int")))
    assert not any(c.startswith("__") for c in df.columns) and df.withColumnsRenamed(back).columns == ["a", *OWN] and len(set(df.columns)) == len(OWN) + 1


# ---- windows that many items share


@pytest.mark.parametrize("small", [True, False])
def test_windows_of_many_items(spark, monkeypatch, small):
    """Each of 300 items has one window, which 300 texts hold; some hold windows of fewer items as well."""
    if not small:
        monkeypatch.setattr(common, "is_small", lambda *_, **__: False)
        monkeypatch.setattr(decontaminate, "is_small", lambda *_, **__: False)
    window, other = "a b c d e f g h i j", "k l m n o p q r s t"
    items = spark.createDataFrame([(f"i{k:03}", f"{window} {other if k < 3 else ''}") for k in range(300)] + [(None, "u v w x y")], "item_id string, text string")
    docs = spark.createDataFrame([(k, f"{k} {window if k % 2 else ''} z {other if k % 3 == 0 else ''} {'u v w x y' if k % 5 == 0 else ''}") for k in range(300)], "doc_id bigint, text string")
    for r in decontaminate.decontaminate(docs, items).collect():
        want = {f"i{k:03}" for k in range(300)} if r.doc_id % 2 else {"i000", "i001", "i002"} if r.doc_id % 3 == 0 else set()
        assert r.n_items == len(want) and r.items_sha256 == hashlib.sha256(",".join(sorted(want)).encode()).hexdigest()
        assert r.contaminated == bool(r.doc_id % 2 or r.doc_id % 3 == 0 or r.doc_id % 5 == 0)


# ---- terms that disclose


def test_the_threshold_decides(spark):
    """A term in 8 texts beside the entity and 10 without, at 0.853, is treated; of 3 and 6 it may be chance."""
    def terms(both, alone, others):
        rows = [(i, f"a{i} meadow bob@x.example") for i in range(both)] + [(1000 + i, f"b{i} meadow") for i in range(alone)] + [(10_000 + i, f"c{i}") for i in range(others)]
        df = spark.createDataFrame(rows, "doc_id int, text string")
        return {r.term: r.share for r in pii.disclosures(df, *pii.entity_spans(df, "text"), "text", pii.SUPPORT, pii.GENERALISE)[0].collect()}

    assert terms(8, 10, 1982) == {"meadow": pytest.approx(0.853, abs=1e-3)}
    assert terms(3, 6, 5000) == {} and terms(80, 0, 5000) == {"meadow": pytest.approx(1)}


# ---- metadata by whole values


def test_long_texts_and_small_fractions_split(spark):
    rows = [(i, "x", f"https://{c}.example/{'p' * 40}", v) for i, (c, v) in enumerate([(c, v) for c in "az" for v in (0.0001, 0.0009)] * 25)]
    df = spark.createDataFrame(rows, "doc_id int, text string, url string, v double")
    for dims in (("url",), ("v",)):
        got = kdtree.shard(df, dims, shards=2).join(df.select("doc_id", *dims), "doc_id").groupBy("shard").agg(F.collect_set(dims[0]).alias("held")).collect()
        assert sorted(len(r.held) for r in got) == [1, 1]
    odd = spark.createDataFrame([(0, float("nan")), (1, None), (2, float("-inf")), (3, -1e308), (4, 1.0), (5, 1e308), (6, float("inf"))], "doc_id int, v double").withColumn("text", F.lit("t"))
    number = {r.doc_id: r.d0 for r in kdtree.points(odd, ("v",), F.lit(1), (F.col("doc_id"),)).collect()}
    assert number[0] == number[1] < number[2] == number[3] < number[4] < number[5] == number[6]


def test_ranks_of_very_many_values(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"v{i % 50:02}" if i % 3 else "hot", None if i % 7 == 0 else f"w{i}") for i in range(300)], "doc_id int, s string, u string").withColumn("text", F.lit("t"))
    few = sorted(map(str, kdtree.points(df, ("s", "u"), F.lit(1), (F.col("doc_id"),)).collect()))
    monkeypatch.setattr(kdtree, "is_small", lambda *_, **__: False)
    monkeypatch.setattr(common, "is_small", lambda *_, **__: False)
    assert sorted(map(str, kdtree.points(df, ("s", "u"), F.lit(1), (F.col("doc_id"),)).collect())) == few


# ---- media


def frame(rate):
    """A silent MPEG 1 layer III frame of 128 kbit/s."""
    head = bytes([0xFF, 0xFB, 9 << 4 | {44100: 0, 48000: 1, 32000: 2}[rate] << 2, 3 << 6])
    return head.ljust(mpeg.header(head).length, b"\0")


def test_durations_over_several_rates(spark):
    s = mpeg.parse(frame(44100) * 5 + frame(48000) * 5)
    assert len(s.offsets) == 10 and float(s.duration) == pytest.approx(0.250612, abs=1e-6) and s.duration == mpeg.Fraction(5760, 44100) + mpeg.Fraction(5760, 48000)
    got = mpeg.media_columns(spark.createDataFrame([(bytearray(frame(44100) * 5 + frame(48000) * 5),), (None,)], "media binary")).select("mpeg.duration").collect()
    assert [(r.duration.numerator, r.duration.denominator) for r in got] == [(s.duration.numerator, s.duration.denominator), (0, 1)]


def test_a_false_header_at_the_end():
    good = frame(44100) * 3
    false = frame(48000)[:200].ljust(mpeg.header(frame(48000)).length, b"\1")
    assert len(mpeg.parse(good + b"junk" + false + b"\2\3").offsets) == 3  # nothing confirms another rate
    assert len(mpeg.parse(good + b"junk" + frame(44100) + b"\2\3").offsets) == 4  # it is like the frames before
    assert len(mpeg.parse(frame(48000)).offsets) == 1  # a whole file


# ---- marks


def test_marks_belong_to_words():
    def words(text):
        w = textvec.split([text])
        return [text[a:b] for a, b in zip(w.start, w.end, strict=True)]

    assert words("हिन्दी भाषा, ภาษาที่สอง!") == ["हिन्दी", "भाषा", "ภาษาที่สอง"]
    text = "Créé à Mañana où Über"
    apart = unicodedata.normalize("NFD", text)
    assert [unicodedata.normalize("NFC", x) for x in words(apart)] == words(text)
    assert words("") == []


# ---- bytes to tokens: what a worker holds


@pytest.fixture(scope="module")
def automaton():
    return bpe.Automaton(json.loads(bpe.vocabulary()))


def test_bpe_words_are_walked_in_blocks(automaton):
    """New words take memory by the block, not all at once."""
    rng = random.Random(5)
    words = ["".join(rng.choices("etaoinshr", k=rng.randrange(30, 60))).encode() for _ in range(40_000)]
    automaton.paths(words[:100])
    tracemalloc.start()
    automaton.paths(words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6


def test_bpe_workers_get_arrays(automaton):
    """The automaton goes to workers without the entries compiled so far, and encodes there as here."""
    text = "Some words, and <|endoftext|> more; été " + "x-" * 300
    want = automaton.encode(text)
    sent = pickle.dumps(automaton, 5)
    assert len(sent) < 16e6 and pickle.loads(sent).encode(text) == want


def test_bpe_sizes_of_blocks_change_nothing(automaton, monkeypatch):
    texts = ["".join(random.Random(k).choices("ab \né-1", k=k)) for k in range(0, 400, 7)] + ["ab" * 500, "", "-" * 300]
    want = [automaton.encode(t) for t in texts]
    for name, size in (("BLOCK", 7), ("WRITTEN", 20), ("SIDE_BY_SIDE", 5)):
        monkeypatch.setattr(bpe, name, size)
    known = bpe.Known(automaton)
    got = []
    for some in bpe.blocks([known.numbers(automaton.pieces(t)) for t in texts]):
        tokens, ends = known.encode(some)
        got += [tokens[i:j].tolist() for i, j in zip([0, *ends], ends, strict=False)]
    assert got == want

"""The corpus pipeline against a brute-force version of every stage, on the smallest tables."""

import hashlib
import math
import random
import re
import sys
from collections import defaultdict
from pathlib import Path

import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import corpus_pipeline
from sparkloom.llm import crf_language, pii
from test_operators import BASE, base_spans, brute

SF = "/root/testdata/sf0.001"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t)


def without_copies(docs):
    want, links, classes = brute(docs)
    root = {}

    def find(s):
        while root.get(s, s) != s:
            s = root[s]
        return s

    for s, others in links.items():
        for x in others:
            a, b = find(s), find(x)
            if a != b:
                root[a] = b
    groups = defaultdict(list)
    sets = {i: c for c, i in classes.items()}
    for i, (c, _) in want.items():
        groups[find(sets[c]) if c in sets else i].append(i)
    return {min(g) for g in groups.values()}


def contaminated(text, items):
    w = re.findall(WORD, lower(text))
    for item in items:
        v = re.findall(WORD, lower(item))
        n = min(10, len(v))
        if n and any(v[i : i + n] == w[k : k + n] for i in range(len(v) - n + 1) for k in range(len(w) - n + 1)):
            return True
    return False


def beside(t, at, step):
    """The text beside a place, as far as it counts as near, without a word that the end cuts."""
    run = t[at : at + pii.NEAR + 1] if step > 0 else t[max(0, at - pii.NEAR - 1) : at]
    if len(run) <= pii.NEAR:
        return run
    within = re.split(f"({pii.BREAK})", run)
    return "".join(within[:-1][: -1 if not within[-1] else None] if step > 0 else within[1:][1 if not within[0] else 0 :])


def sanitised(docs):
    """Base spans masked, and terms by their co-occurrence; only texts with spans change."""
    texts = set(docs.values())
    terms_of = lambda t: [x for x in re.split(pii.BREAK + "+", lower(t)) if len(x) > 2 and re.search("[^0-9]", x)]
    pairs, n_e, floor = defaultdict(set), defaultdict(set), defaultdict(set)
    for t in texts:
        spans = [(int(a), int(b)) for _, a, b in (s.split(":") for s in base_spans(t))]
        own = {x for a, b in spans for x in terms_of(t[a:b])}
        for a, b in spans:
            around = beside(t, a, -1) + " " + beside(t, b, 1)
            n_e[t[a:b].lower()].add(t)
            for x in set(terms_of(around)) - own:
                pairs[t[a:b].lower(), x].add(t)
                floor[x].add(t)
    held = defaultdict(set)
    for t in texts:
        for x in set(re.split(pii.BREAK + "+", lower(t))):
            held[x].add(t)
    shares = {}
    for (e, x), both in pairs.items():
        if len(both) >= pii.SUPPORT and len(n_e[e]) <= pii.COMMON * len(texts):
            n, p, z = len(held[x]), len(both) / len(held[x]), pii.CONFIDENCE
            least = (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
            share = lambda part: 1 + math.log(part) / math.log(len(texts) / len(n_e[e]))  # noqa: B023, E731
            if share(least) >= pii.GENERALISE:
                shares[x] = max(share(p), shares.get(x, 0))
    out = {}
    for i, t in docs.items():
        marks = [(int(a), list(BASE).index(k), int(b), f"[{k.upper()}]") for k, a, b in (s.split(":") for s in base_spans(t))]
        for m in re.finditer(f"(?:(?!{pii.BREAK}).)+", t, re.DOTALL):
            x = lower(m.group())
            if x in shares and not any(a < m.end() and m.start() < b for a, _, b, _ in marks if _ is not None):
                put = "" if shares[x] >= pii.REMOVE else "[CODE]" if re.search("[0-9]", x) else "[NAME]" if m.group()[0].isupper() else "[WORD]"
                marks.append((m.start(), 4, m.end(), put))
        new, at = "", 0
        for a, _, b, put in sorted(marks):
            if a >= at:
                new += t[at:a] + put
            at = max(at, b)
        out[i] = new + t[at:] if marks else t
    return out


@pytest.fixture(scope="module")
def result(spark):
    return {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}


def test_against_brute_force(spark, result):
    import public_tokenizers
    from tokenizers import Tokenizer

    src = pd.read_parquet(f"{SF}/documents.parquet")
    docs = dict(zip(src.doc_id, src.text, strict=True))
    df = spark.read.parquet(f"{SF}/documents.parquet")
    import zlib

    learned = crf_language.train(df.where(df.doc_id.isin([int(i) for i in docs if zlib.crc32(str(i).encode()) % 5])))
    names, _, known = crf_language.label_texts(learned, [*docs.values()])
    docs = {i: t for (i, t), n, k in zip(docs.items(), names, known, strict=True) if n != "und" and k >= corpus_pipeline.LEAST_KNOWN}
    kept = without_copies(docs)
    items = pd.read_parquet(f"{SF}/benchmark.parquet").text
    docs = {i: t for i, t in docs.items() if i in kept and not contaminated(t, items)}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for i, t in sanitised(docs).items():
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert {i: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for i, r in result.items()} == want


def test_stages_keep_columns_and_take_odd_rows(spark):
    rows = [(1, "one two three four five six", "en", "a", 27, "x"), (1, "one two three four five six", "en", "a", 27, "x"), (2, None, None, None, None, None), (3, "", "en", "b", 0, None), (None, "mail me at a@b.example or so", "en", "a", 9, "y"), (4, "12 34", "en", "a", 5, "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score string")
    for docs in (df, df.where("false")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns, name
            got = out.collect()
            if docs is df:
                assert {r.score for r in got if r.doc_id == 1} == {"x"}, name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_language_stage_rejects_what_no_language_is(spark):
    clean = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").where("text IS NOT NULL").collect()]
    rng = random.Random(4)
    junk = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 10))) for _ in range(60)) for _ in range(20)]
    other = ["това е български текст за проверка на езика", "这是一段没有学过的语言", "अपठित भाषा का एक वाक्य", "12 34 !!"]
    for languages in ({"en", "fr", "de", "es"}, {"en", "fr"}, {"en"}):  # however many there are
        rows = [x for x in clean if x[2] in languages] + [(10**6 + i, t, None) for i, t in enumerate(junk + other)]
        docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
        left = {r.doc_id for r in corpus_pipeline.in_a_language(spark, docs, SF).collect()}
        assert left == {i for i, t, _ in clean if i in {x[0] for x in rows} and re.search("[A-Za-z]", t)}, languages


def test_stages_read_very_long_texts(spark):
    long = "mail ann@x.example now and then " * 20_000
    df = spark.createDataFrame([(1, long, "en", len(long)), (2, long, "en", len(long)), (3, "another short text here", "en", 23)], "doc_id bigint, text string, lang string, n_chars bigint")
    for _, stage in corpus_pipeline.STAGES[1:]:
        df = stage(spark, df, SF)
    got = {r.doc_id: r.n_tokens for r in df.collect()}
    assert set(got) == {1, 3} and got[1] > 100_000 and got[3] == 4


def test_clean_documents_stay(result):
    src = pd.read_parquet(f"{SF}/documents.parquet")
    assert 0.7 * len(src) < len(result) <= len(src)

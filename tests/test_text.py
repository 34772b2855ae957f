"""Literals of the text functions: expected values worked by hand or given by published behaviour."""

import pytest
from helpers import values
from pyspark.sql import functions as F

from sparkloom.functions import case, text
from sparkloom.plans import rules

CASES = {
    case.no_case: "foo bar http server", case.kebab_case: "foo-bar-http-server", case.snake_case: "foo_bar_http_server", case.dot_case: "foo.bar.http.server", case.path_case: "foo/bar/http/server",
    case.constant_case: "FOO_BAR_HTTP_SERVER", case.capital_case: "Foo Bar Http Server", case.train_case: "Foo-Bar-Http-Server", case.pascal_snake_case: "Foo_Bar_Http_Server",
    case.sentence_case: "Foo bar http server", case.pascal_case: "FooBarHttpServer", case.camel_case: "fooBarHttpServer",
}


@pytest.mark.parametrize("function", CASES, ids=lambda f: f.__name__)
def test_cases(spark, function):
    assert values(spark, function, ["fooBarHTTPServer", "", "  ", None]) == [CASES[function], "", "", None]


def test_words(spark):
    assert values(spark, case.words, ["Customer#000000001", "4-NOT SPECIFIED", "éÀb", "--", "aB1C"]) == [["Customer", "000000001"], ["4", "NOT", "SPECIFIED"], ["é", "Àb"], [], ["a", "B1", "C"]]
    assert values(spark, case.words_and_numbers, ["abc123def", "ABC1D", "v2x"]) == [["abc", "123", "def"], ["ABC", "1", "D"], ["v", "2", "x"]]


def test_number_words_are_marked(spark):
    assert values(spark, case.pascal_case, ["version 1 2"]) == ["Version_1_2"]
    assert values(spark, lambda x: case.camel_case(x, merge_numbers=True), ["version 1 2"]) == ["version12"]


def test_affixes(spark):
    assert values(spark, lambda x: case.camel_case(x, prefix="_$", suffix="_"), ["__$foo bar_", "foo", "__"]) == ["__$fooBar_", "foo", "__"]


def test_slugs(spark):
    assert values(spark, case.slug, ["It's  a Tést.", " x "]) == ["its-a-test", "x"]
    assert values(spark, case.slug_plural, ["dog", "dogs"]) == ["dogs", "dogs"]
    assert values(spark, case.pascal_singular, ["big dogs"]) == ["BigDog"]


DEDENT = [
    ("", ""), ("  hello  ", "hello"), ("\n\nhello\n\n", "hello"), ("\n        line1\n          line2\n\n        line3\n      ", "line1\n  line2\n\nline3\n"), ("hello\nworld", "hello\nworld"), ("  \t ", ""), ("\n\n\n", ""),
    ("hello\n\nworld", "hello\n\nworld"), ("\n      line1\n        line2\n      ", "line1\n  line2\n"), ("\n\n      line1\n        line2\n      \n\n", "line1\n  line2\n"), ("\n    line1\n\n    line2\n  ", "line1\n\nline2\n"),
    ("\n\n\n      ", ""), ("line1\n  line2\n    line3", "line1\n  line2\n    line3"), ("\n\t\tline1\n\t\t\tline2\n\t", "line1\n\tline2\n"), ("\n  \tline1\n  \t  line2\n  ", "line1\n  line2\n"),
]
ONE_LINE = [("", ""), ("hello\nworld", "hello world"), ("  hello  \n  world  \n", "hello world"), ("hello\n\nworld", "hello world"), ("hello world", "hello world"), ("  \n   \n  ", "")]
SANITIZED = [("my-worker", "my-worker"), ("worker123", "worker123"), ("MyWorker", "myworker"), ("my@worker", "my-worker"), ("my___worker", "my-worker"), ("_my_worker_", "my-worker"), ("a" * 60, "a" * 54), ("___", ""), ("a" * 53 + " b", "a" * 53 + "-")]
STRIPPED = [("---\n'a': patch\n---\n\nfix: x\n", "fix: x"), ("---\na\n---\nfix: x", ""), ("---\na\n---", "---\na\n---"), ("no fence", "no fence")]


@pytest.mark.parametrize("function, pairs", [(text.dedent, DEDENT), (text.one_line, ONE_LINE), (text.sanitize_name, SANITIZED), (text.strip_packages, STRIPPED), (text.bullet_list, [(" a\nb ", "- a\n- b")])], ids=["dedent", "one_line", "sanitize", "strip_packages", "bullets"])
def test_literals(spark, function, pairs):
    assert values(spark, function, [a for a, _ in pairs]) == [b for _, b in pairs]


def test_required_name_raises(spark):
    with pytest.raises(Exception, match="results in empty string"):
        values(spark, text.required_name, ["---"])


def test_default_name(spark):
    df = spark.createDataFrame([(0, "@x/y", "d"), (1, "___", "My Dir"), (2, None, "--"), (3, None, None)], "i int, a string, b string")
    assert [r.n for r in df.select("i", text.default_name(F.col("a"), F.col("b")).alias("n")).orderBy("i").collect()] == ["x-y", "my-dir", "my-worker", "my-worker"]


def test_small_functions(spark):
    assert values(spark, text.tool_version, ["pnpm@10.1.2", "pnpm@10", "npm@1.2.3", None]) == ["10.1.2", None, None, None]
    assert values(spark, text.outcome, [0, 2, None], "int") == ["Success!", "Failed with code: 2", "Failed with code: null"]
    assert values(spark, lambda x: text.first_truthy(x, F.lit("b")), ["", None, "a"]) == ["b", "b", "a"]
    assert values(spark, lambda x: text.with_extension(x, F.lit(".mjs")), ["a.js", "a.js.map"]) == ["a.mjs", "a.js.map"]


def test_front_matter(spark):
    got = values(spark, text.front_matter, ["---\na: 1\n---\nbody\n", "plain", "---\n---\nx"])
    assert [tuple(g) for g in got] == [(True, "a: 1", "body\n"), (False, "", "plain"), (True, "", "x")]
    assert values(spark, text.quote_globs, ["---\nglobs: *.ts,*.tsx\nx: 1\n---\nb", '---\nglobs: "*.ts"\n---\n', "globs: *.ts"]) == ['---\nglobs: "*.ts,*.tsx"\nx: 1\n---\nb', '---\nglobs: "*.ts"\n---\n', "globs: *.ts"]


#: Values of `description` as YAML has them: (header, kind, value).
SCALARS = [
    ("description: plain words # note", "text", "plain words"), ("x: 1", "absent", None), ("description:", "null", None), ("description: ~", "null", None), ("description: # note", "null", None),
    ("description: |\n  one\n   two\n\n  three\nglobs: x", "text", "one\n two\n\nthree\n"), ("description: |-\n  one\n  two\n\nglobs: x", "text", "one\ntwo"), ("description: |+\n  one\n\nglobs: x", "text", "one\n\n"),
    ("description: >\n  one\n  two\n\n  three\n\n\n  four\n", "text", "one two\nthree\n\nfour\n"), ("description: >-\n  one\n    more\n  two\n  three", "text", "one\n  more\ntwo three"), ("description: |2- # note\n    one\n  two", "text", "  one\ntwo"),
    ("description: |\n    one\n  two", "malformed", None), ("description: |\n  key: - # [x\n", "text", "key: - # [x\n"), ("description: |-", "text", ""),
    ("description: one\n  two\n\n  three  # note", "text", "one two\nthree"), ("description:\n  below\n  it", "text", "below it"), ("description: # note\n  below", "text", "below"),
    ('description: "a \\"b\\" \\\\ \\t\\u00e9\\x41" # n', "text", 'a "b" \\ \té\x41'), ('description: "one\n  two\n\n  three"', "text", "one two\nthree"), ('description: "one \\\n  two"', "text", "one two"), ('description: "bad \\q"', "malformed", None), ('description: "open', "malformed", None),
    ("description: 'it''s\n  here'", "text", "it's here"), ("description: 'a' b", "malformed", None), ("'description' : a:b#c", "text", "a:b#c"),
    ("description: a: b", "malformed", None), ("description:\n  a: b", "other", None), ("description:\n  - a", "other", None), ("description: - a", "malformed", None), ("description: [a]", "other", None),
    ("description: &x a", "unread", None), ("description: !!str 1", "unread", None), ("description: @a", "malformed", None), ("description: TRUE", "boolean", "TRUE"), ("description: yes", "text", "yes"),
    ("description: 12_000", "other", None), ("description: -1.5e3", "other", None), ("description: 0x1F", "other", None), ("description: 2024-01-31", "other", None), ("description: 1.2.3", "text", "1.2.3"), ("description: 12 rules", "text", "12 rules"),
]


def test_yaml_scalars(spark):
    df = spark.createDataFrame([(i, h) for i, (h, *_) in enumerate(SCALARS)], "i int, header string")
    got = rules.read_key(df, "description").orderBy("i").collect()
    for r, (header, kind, value) in zip(got, SCALARS, strict=True):
        assert r.kind_description == kind, header
        assert kind not in ("text", "boolean") or r.value_description == value, header


def test_rules_with_blocks(spark):
    long = "description: |\n" + "  word\n" * 20_000
    docs = [
        ("a", "---\nname: [x, y]\ndescription: >-\n  Folded over\n  two lines\nglobs: '*.ts'\nalwaysApply: True\n---\nB"), ("b", "---\ndescription: one two three\ndescription: again and again\n---\nB"), ("c", "---\ndescription: *anchor\n---\n"),
        ("d", "---\ndescription: long enough to pass\nno key here\n---\n"), ("e", f"---\n{long}---\nB"), ("f", "---\ndescription:no blank after it\n---\n"), ("g", "---\ndescription: long enough to pass\nalwaysApply:\n---\n"),
    ]
    parsed = rules.parse(spark.createDataFrame(docs, "path string, value string"))
    good = {r.filename: r.frontmatter for r in rules.valid(parsed).collect()}
    assert set(good) == {"a", "e"} and tuple(good["a"]) == ("Folded over two lines", "*.ts", True) and good["e"].description == "word\n" * 20_000
    bad = {r.filename: r.error for r in rules.rejected(parsed).collect()}
    assert bad == {"b": "malformed header", "c": "anchors, aliases and tags are not read", "d": "malformed header", "f": "malformed header", "g": "alwaysApply is no boolean"}


def test_unicode_space(spark):
    assert values(spark, text.strip, ["\u00a0\u3000 a b \ufeff\u2028", "\u200b"]) == ["a b", "\u200b"]
    assert values(spark, text.one_line, ["\u00a0x\u2003\n\u00a0\ny"]) == ["x y"]

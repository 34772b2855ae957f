import json

import pytest
from helpers import rows
from pyspark.sql import functions as F

from sparkloom.plans import rules
from sparkloom.sinks import files
from sparkloom.sources import documents
from sparkloom.streaming import responses

RULES = {
    "typescript-style": '---\ndescription: TypeScript coding standards and style guide\nglobs: "**/*.ts,**/*.tsx"\nalwaysApply: false\n---\n\n# Style\n',
    "always-apply": "---\ndescription: Project-wide coding standards that always apply\nglobs:\nalwaysApply: true\n---\nText\n",
    "manual-only": "---\ndescription: short\n---\nx\n",
    "empty-frontmatter": "---\n---\nx\n",
    "no-frontmatter": "just text\n",
    "unquoted-globs": "---\ndescription: Unquoted patterns work as well\nglobs: *.ts,*.tsx\n---\nBody\n",
    "list-globs": "---\ndescription: A list of globs is rejected\nglobs:\n  - a\n---\nBody\n",
    "invalid-frontmatter": "---\ndescription: fine description here\nalwaysApply: maybe\n---\nBody\n",
}


@pytest.fixture
def rule_dir(tmp_path):
    for name, body in RULES.items():
        (tmp_path / f"{name}.mdc").write_text(body)
    (tmp_path / "other.md").write_text(RULES["always-apply"])
    return str(tmp_path)


def test_rules(spark, rule_dir):
    parsed = rules.parse(documents.rule_files(spark, rule_dir))
    got = {r.name: r for r in rules.valid(parsed).collect()}
    assert sorted(got) == ["always-apply", "typescript-style", "unquoted-globs"]
    assert got["typescript-style"].frontmatter.globs == "**/*.ts,**/*.tsx" and got["typescript-style"].content == "# Style"
    assert got["always-apply"].frontmatter.globs is None and got["always-apply"].frontmatter.alwaysApply is True
    assert got["unquoted-globs"].frontmatter.globs == "*.ts,*.tsx" and got["unquoted-globs"].frontmatter.alwaysApply is None
    errors = {r.filename: r.error for r in rules.rejected(parsed).collect()}
    assert errors == {"manual-only.mdc": "missing description (must be at least 10 characters)", "empty-frontmatter.mdc": "missing description (must be at least 10 characters)", "no-frontmatter.mdc": "missing description (must be at least 10 characters)", "list-globs.mdc": "globs is no string", "invalid-frontmatter.mdc": "alwaysApply is no boolean"}


def test_tools(spark, rule_dir):
    got = {r.tool: r.description for r in rules.tools(spark, rule_dir).collect()}
    assert got["cursor_rule_always-apply"] == "Read Cursor rule: Project-wide coding standards that always apply (always-apply)"
    assert got["cursor_rule_typescript-style"].endswith("(applies to **/*.ts,**/*.tsx)")


def test_missing_directory(spark, tmp_path):
    assert documents.rule_files(spark, str(tmp_path / "gone")).count() == 0


def test_other_sources(spark, tmp_path):
    (tmp_path / "package.json").write_text('{"name": "x", "dependencies": {"a": "1"}}')
    (tmp_path / "out.txt").write_text("a\n\nb\n")
    from sparkloom.functions.validate import MANIFEST

    assert documents.json_document(spark, str(tmp_path / "package.json"), MANIFEST).first().dependencies == {"a": "1"}
    assert rows(documents.output_lines(spark, str(tmp_path / "out.txt")), "line") == [("a",), ("b",)]
    (tmp_path / "deep" / "er").mkdir(parents=True)
    assert documents.find_upwards(str(tmp_path / "deep" / "er"), "package.json") == str(tmp_path / "package.json")
    assert documents.whole_files(spark, str(tmp_path), "*", exclude=r"\.json$").count() == 1


def test_tsv(spark):
    df = spark.createDataFrame([(1, "hello"), (2, None)], "a int, b string")
    assert files.tsv_text(df.where("a = 9"), ["a", "b"]) == ""
    assert files.tsv_text(df.orderBy("a"), ["a", "b"]) == "a\tb\n1\thello\n2\t"
    assert files.tsv_text(df.where("a = 1"), ["a", "c"]) == "a\tc\n1\t"
    odd = spark.createDataFrame([("John\tDoe", "Line1\nLine2", 'James "Jim" Raynor')], "n string, d string, q string")
    assert files.tsv_text(odd, ["n", "d", "q"]) == 'n\td\tq\n"John\tDoe"\t"Line1\nLine2"\t"James ""Jim"" Raynor"'


def test_tsv_files(spark, tmp_path):
    df = spark.createDataFrame([('a"b', None), ("x\ty", " z ")], "p string, q string")
    files.write_tsv(df, str(tmp_path / "t"))
    back = spark.read.options(**files.CSV).option("header", "true").option("multiLine", "true").csv(str(tmp_path / "t"))
    assert sorted(rows(back), key=str) == [('a"b', None), ("x\ty", " z ")]


def test_config_files(tmp_path):
    files.write_new_config(str(tmp_path), "wrangler.jsonc", "{}")
    with pytest.raises(FileExistsError):
        files.write_new_config(str(tmp_path), "wrangler.json", "{}")
    path = str(tmp_path / "c.json")
    assert files.write_if_changed(path, {"b": 1, "a": 2}) and not files.write_if_changed(path, {"b": 1, "a": 2})
    assert json.loads((tmp_path / "c.json").read_text()) == {"b": 1, "a": 2}
    files.check_unchanged(path, {"b": 1, "a": 2})
    with pytest.raises(ValueError):
        files.check_unchanged(path, {"a": 2, "b": 1})


def test_results(spark):
    df = spark.createDataFrame([("lint", 0), ("types", 2)], "name string, exit_code int")
    assert rows(files.result_table(df), "name") == [("lint", "Success!"), ("types", "Failed with code: 2")]
    assert files.same_rows(df, df) and not files.same_rows(df, df.union(df))


def answered(spark, tmp_path, batches, **options):
    """(key, seconds) to hit, of a stream that gets the batches one after another, and of a table of all of them."""
    schema = "url string, method string, s int, status int"
    at = F.timestamp_seconds(F.col("s") + 1_000_000).alias("ts")
    frames = [spark.createDataFrame(x, schema).select("url", "method", at, "status").coalesce(1) for x in batches]
    for df in frames:
        df.write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = responses.cached(stream, **options).writeStream.format("memory").queryName("hits").outputMode("append").start()
    q.processAllAvailable()
    state = [p["stateOperators"][0]["numRowsTotal"] for p in (json.loads(x.json) if hasattr(x, "json") else x for x in q.recentProgress) if p["stateOperators"]]
    q.stop()
    hits = lambda rows: {(r.key, int(r.ts.timestamp()) - 1_000_000): r.hit for r in rows}
    options.pop("lateness", None)
    everything = spark.createDataFrame([r for x in batches for r in x], schema).select("url", "method", at, "status")
    table = hits(responses.cached_table(everything, **options).collect())
    assert hits(spark.table("hits").collect()) == table
    return table, state


def test_response_cache(spark, tmp_path):
    data = [("/a", "GET", 0, 200), ("/a", "GET", 5, 200), ("/a", "GET", 61, 200), ("/a", "GET", 62, 500), ("/b", "GET", 1, 500), ("/b", "GET", 2, 200), ("/a", "POST", 3, 200)]
    got, _ = answered(spark, tmp_path, [data], rules=[(200, 60)])
    assert got == {("/a GET", 0): False, ("/a GET", 5): True, ("/a GET", 61): False, ("/a GET", 62): True, ("/b GET", 1): False, ("/b GET", 2): False, ("/a POST", 3): False}


def test_response_cache_of_every_status(spark, tmp_path):
    data = [[("/a", "GET", 0, 500), ("/a", "GET", 9, 404)], [("/a", "GET", 10, 200), ("/b", "GET", 12, 500)], [("/b", "GET", 21, 500), ("/b", "GET", 23, 500)]]
    got, _ = answered(spark, tmp_path, data, default_ttl=10)
    assert got == {("/a GET", 0): False, ("/a GET", 9): True, ("/a GET", 10): False, ("/b GET", 12): False, ("/b GET", 21): True, ("/b GET", 23): False}


def test_response_cache_forgets(spark, tmp_path):
    data = [[(f"/{k}", "GET", 1000 * k, 200)] for k in range(8)]
    _, state = answered(spark, tmp_path, data, rules=[(200, 60), (404, 5)], lateness="1 second")
    assert state and max(state) <= 3  # of eight keys


def test_globs(spark):
    from sparkloom.functions import text

    paths = ["/x/a.ts", "/x/y/a.tsx", "/x/a.d.ts", "/x/node_modules/p/a.ts", "/x/axts", "a.ts"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    hit = lambda *globs: [r.p for r in df.where(text.path_matches(F.col("p"), globs)).collect()]
    assert hit("*.ts") == ["/x/a.ts", "/x/a.d.ts", "/x/node_modules/p/a.ts", "a.ts"]
    assert hit("**/*.{ts,tsx}", "!*.d.ts", "!**/node_modules/**") == ["/x/a.ts", "/x/y/a.tsx", "a.ts"] and hit("x/?.ts") == ["/x/a.ts"] and hit("!a") == []


def test_shared_folder(spark, tmp_path):
    from types import SimpleNamespace

    from sparkloom.sources import shared

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="yarn", applicationId="app"))
    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        shared.shared_dir(cluster)
    assert shared.shared_dir(spark) == shared.shared_dir(spark)
    with pytest.raises(ValueError):
        files.tsv_text(spark.range(5), ["id"], most=4)


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kolkata", "UTC"])
def test_moments_in_any_zone(spark, zone):
    from datetime import datetime, timezone

    from sparkloom.functions import web

    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(0,), (1_710_054_000_123,), (-1,)], "ms long")  # the second in a gap of New York's clock
        assert [r.x for r in df.select(web.iso_millis(F.col("ms")).alias("x")).collect()] == ["1970-01-01T00:00:00.000Z", "2024-03-10T07:00:00.123Z", "1969-12-31T23:59:59.999Z"]
        now = datetime.now(timezone.utc).strftime("%Y-%m-%d")
        assert now <= df.select(web.today().alias("x")).first().x <= datetime.now(timezone.utc).strftime("%Y-%m-%d")
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)

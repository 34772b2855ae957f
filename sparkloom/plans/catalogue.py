"""Queries over the driver tables, one or more for each operator, and the same in SQL written independently of them."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions import case, text, validate, web
from sparkloom.operators import records, recursive
from sparkloom.plans import checks, commands, rules, secrets, structure, versions  # noqa: F401  (some only register their queries)
from sparkloom.plans.registry import ORACLE_SQL, QUERIES, projection, query, table
from sparkloom.sinks import files
from sparkloom.sources import documents, shared
from sparkloom.streaming import responses

# ---- word splitting and case conversion

PART = lambda: F.concat(F.col("p_brand"), F.lit(" "), F.col("p_name"), F.lit("HTTPServer"), F.col("p_size"), F.lit("x-éÀb"))
PART_SQL = "concat(p_brand, ' ', p_name, 'HTTPServer', p_size, 'x-éÀb')"


def words_sql(x: str, numbers: bool = False) -> str:
    y = rf"regexp_replace(regexp_replace(regexp_replace({x}, '([\p{{Ll}}0-9])(\p{{Lu}})', '\1 \2', 'g'), '(\p{{Lu}})(\p{{Lu}}\p{{Ll}})', '\1 \2', 'g'), '[^\p{{L}}0-9]+', ' ', 'g')"
    if numbers:
        y = rf"regexp_replace(regexp_replace({y}, '([0-9])(\p{{Ll}})', '\1 \2', 'g'), '(\p{{L}})([0-9])', '\1 \2', 'g')"
    return f"list_filter(string_split({y}, ' '), lambda w: w <> '')"


CAPITAL = "upper(w[1]) || lower(w[2:])"
PASCAL = f"CASE WHEN i > 1 AND w[1] BETWEEN '0' AND '9' THEN '_' || lower(w) ELSE {CAPITAL} END"
CASES: dict[str, tuple[Callable[[Column], Column], str, str]] = {
    "no": (case.no_case, "lower(w)", " "), "kebab": (case.kebab_case, "lower(w)", "-"), "snake": (case.snake_case, "lower(w)", "_"), "dot": (case.dot_case, "lower(w)", "."), "path": (case.path_case, "lower(w)", "/"),
    "constant": (case.constant_case, "upper(w)", "_"), "capital": (case.capital_case, CAPITAL, " "), "train": (case.train_case, CAPITAL, "-"), "pascal_snake": (case.pascal_snake_case, CAPITAL, "_"),
    "sentence": (case.sentence_case, f"CASE WHEN i = 1 THEN {CAPITAL} ELSE lower(w) END", " "), "pascal": (case.pascal_case, PASCAL, ""), "camel": (case.camel_case, f"CASE WHEN i = 1 THEN lower(w) ELSE {PASCAL} END", ""),
}


def case_sql(x: str, shape: str, delimiter: str, numbers: bool = False) -> str:
    return f"array_to_string(list_transform({words_sql(x, numbers)}, lambda w, i: {shape}), '{delimiter}')"


for _name, (_f, _shape, _by) in CASES.items():
    projection(f"case_{_name}", "part", ["p_partkey"], lambda f=_f: {"converted": f(PART())}, {"converted": case_sql(PART_SQL, _shape, _by)})
projection("case_names", "customer", ["c_custkey"], lambda: {"kebab": case.kebab_case(F.col("c_name")), "pascal": case.pascal_case(F.col("c_name")), "merged": case.pascal_case(F.col("c_name"), merge_numbers=True)},
           {"kebab": case_sql("c_name", "lower(w)", "-"), "pascal": case_sql("c_name", PASCAL, ""), "merged": case_sql("c_name", CAPITAL, "")})
projection("split_words", "orders", ["o_orderkey"], lambda: {"words": F.array_join(case.words(F.col("o_orderpriority")), "|"), "n": F.size(case.words(F.col("o_orderpriority"))).cast("long")},
           {"words": f"array_to_string({words_sql('o_orderpriority')}, '|')", "n": f"CAST(len({words_sql('o_orderpriority')}) AS BIGINT)"})
projection("split_numbers", "part", ["p_partkey"], lambda: {"words": F.array_join(case.words_and_numbers(PART()), "|"), "snake": case.snake_case(PART(), split=case.words_and_numbers)},
           {"words": f"array_to_string({words_sql(PART_SQL, True)}, '|')", "snake": case_sql(PART_SQL, "lower(w)", "_", True)})
projection("case_affixes", "part", ["p_partkey"], lambda: {"kept": case.kebab_case(F.concat(F.lit("__$"), F.col("p_name"), F.lit("_")), prefix="_$", suffix="_")}, {"kept": "'__$' || " + case_sql("p_name", "lower(w)", "-") + " || '_'"})

SLUG_SQL = "regexp_replace(lower(regexp_replace(regexp_replace(replace(translate(c_name || ' Ünï''s. x', 'àáâãäåçèéêëìíîïñòóôõöøùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ', 'aaaaaaceeeeiiiinoooooouuuuyyAAAAAACEEEEIIIINOOOOOOUUUUY'), 'ß', 'ss'), '[''.]', '', 'g'), '^\\s+|\\s+$', '', 'g')), '\\s+', '-', 'g')"
SLUG = lambda: F.concat(F.col("c_name"), F.lit(" Ünï's. x"))
projection("slug_text", "customer", ["c_custkey"], lambda: {"slug": case.slug(SLUG()), "plural": case.slug_plural(SLUG()), "one": case.slug_singular(F.concat(SLUG(), F.lit("s")))},
           {"slug": SLUG_SQL, "plural": f"{SLUG_SQL} || 's'", "one": SLUG_SQL})
_PS = case_sql("p_name", PASCAL, "")
projection("pascal_helpers", "part", ["p_partkey"], lambda: {n.replace("-", "_"): case.HELPERS[n](F.col("p_name")) for n in ("pascal", "pascal-s", "pascal-p")},
           {"pascal": _PS, "pascal_s": f"regexp_replace({_PS}, 's$', '')", "pascal_p": f"CASE WHEN ends_with({_PS}, 's') THEN {_PS} ELSE {_PS} || 's' END"})

# ---- text

INDENTED = lambda: F.concat(F.lit("\n\n"), F.regexp_replace("text", "(?m)^", "   "), F.lit("\n     \n  "))
INDENTED_SQL = r"(E'\n\n' || '   ' || replace(text, E'\n', E'\n   ') || E'\n     \n  ')"
projection("dedent", "conversations", ["conv_id", "turn"], lambda: {"dedented": text.dedent(F.concat(INDENTED(), F.lit("  end ")))},
           {"dedented": r"""(SELECT array_to_string(list_transform(l, lambda x: CASE WHEN trim(x, E' \t\r') = '' THEN '' ELSE rtrim(x[1 + m:], E' \t\r') END), E'\n')
             FROM (SELECT l, list_min(list_transform(list_filter(l, lambda x: trim(x, E' \t\r') <> ''), lambda x: len(x) - len(ltrim(x, E' \t\r')))) AS m
               FROM (SELECT string_split(trim(%s || '  end ', E'\n'), E'\n') AS l)))""" % INDENTED_SQL})  # fmt: skip
projection("one_line", "documents", ["doc_id"], lambda: {"line": text.one_line(F.col("text"))},
           {"line": r"array_to_string(list_filter(list_transform(string_split(text, E'\n'), lambda x: trim(x, E' \t\r')), lambda x: x <> ''), ' ')"})
projection("bullet_list", "conversations", ["conv_id", "turn"], lambda: {"bullets": text.bullet_list(F.col("text"))}, {"bullets": r"'- ' || replace(trim(text, E' \t\r\n'), E'\n', E'\n- ')"})

SAFE = r"left(regexp_replace(regexp_replace(regexp_replace(lower(%s), '[^a-z0-9-]', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g'), 54)"
LONG = lambda: F.concat(F.lit("_"), F.col("c_name"), F.lit(" "), F.repeat(F.col("c_mktsegment"), 6))
LONG_SQL = "('_' || c_name || ' ' || repeat(c_mktsegment, 6))"
NAME_SQL = r"CASE WHEN %(x)s = '' THEN 'Worker name cannot be empty' WHEN len(%(x)s) > 54 THEN 'Worker name cannot exceed 54 characters' WHEN NOT regexp_full_match(%(x)s, '[a-z0-9-]+') THEN 'Worker name can only contain lowercase letters, numbers, and hyphens' WHEN starts_with(%(x)s, '-') OR ends_with(%(x)s, '-') THEN 'Worker name cannot start or end with a hyphen' END"
projection("sanitize_name", "customer", ["c_custkey"], lambda: {"name": text.required_name(LONG()), "error": validate.name_error(text.sanitize_name(LONG()))}, {"name": SAFE % LONG_SQL, "error": NAME_SQL % {"x": SAFE % LONG_SQL}})
projection("validate_name", "part", ["p_partkey"], lambda: {"raw": validate.name_error(F.col("p_name")), "kebab": validate.name_error(case.kebab_case(F.col("p_type"))), "edge": validate.name_error(F.concat(F.lit("-"), F.col("p_size"))), "none": validate.name_error(F.lit(""))},
           {"raw": NAME_SQL % {"x": "p_name"}, "kebab": NAME_SQL % {"x": case_sql("p_type", "lower(w)", "-")}, "edge": NAME_SQL % {"x": "('-' || p_size)"}, "none": NAME_SQL % {"x": "''"}})
_MAN = lambda: F.when(F.col("c_custkey") % 3 == 0, F.lit("___")).when(F.col("c_custkey") % 3 == 1, F.col("c_name"))
projection("default_name", "customer", ["c_custkey"], lambda: {"name": text.default_name(_MAN(), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")))},
           {"name": "coalesce(nullif(" + SAFE.replace("%s", "CASE WHEN c_custkey % 3 = 0 THEN '___' WHEN c_custkey % 3 = 1 THEN c_name END") + ", ''), nullif(" + SAFE.replace("%s", "CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END") + ", ''), 'my-worker')"})
projection("repository_name", "part", ["p_partkey"], lambda: {"raw": validate.repository_name_ok(F.col("p_name")), "plain": validate.repository_name_ok(F.replace(F.col("p_brand"), F.lit("#"), F.lit("_"))), "dots": validate.repository_name_ok(F.repeat(F.lit("."), F.col("p_size") % 3 + 1)), "lines": validate.repository_name_ok(F.lit("__"))},
           {"raw": r"regexp_full_match(p_name, '[A-Za-z0-9\-_.]+')", "plain": r"regexp_full_match(replace(p_brand, '#', '_'), '[A-Za-z0-9\-_.]+')", "dots": "false", "lines": "false"})
projection("tool_version", "part", ["p_partkey"], lambda: {"version": text.tool_version(F.concat(F.when(F.col("p_size") % 2 == 0, "pnpm@").otherwise("yarn@"), F.col("p_size"), F.lit(".2."), F.col("p_partkey"))), "build": text.build_version(F.col("p_size").cast("string"), F.left(F.md5("p_name"), F.lit(7)))},
           {"version": "CASE WHEN p_size % 2 = 0 THEN p_size || '.2.' || p_partkey END", "build": "p_size || '-' || left(md5(p_name), 7)"})
projection("outcome_label", "events", ["event_id"], lambda: {"label": text.outcome(F.when(F.col("event_id") % 7 == 0, None).otherwise(F.col("event_id") % 3))}, {"label": "CASE WHEN event_id % 7 = 0 THEN 'Failed with code: null' WHEN event_id % 3 = 0 THEN 'Success!' ELSE 'Failed with code: ' || (event_id % 3) END"})
projection("truthy_coalesce", "documents", ["doc_id"], lambda: {"first": text.first_truthy(F.when(F.col("doc_id") % 3 == 0, F.col("lang")).when(F.col("doc_id") % 3 == 1, ""), F.when(F.col("doc_id") % 2 == 0, F.col("source")), F.lit("last"))},
           {"first": "coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN lang WHEN doc_id % 3 = 1 THEN '' END, ''), CASE WHEN doc_id % 2 = 0 THEN source END, 'last')"})
_FORM = lambda: F.when(F.col("p_size") % 2 == 0, "esm").otherwise("cjs")
projection("extension_rewrite", "part", ["p_partkey"], lambda: {"file": text.with_extension(F.concat(F.col("p_partkey"), F.when(F.col("p_size") % 3 == 0, ".js.map").otherwise(".js")), text.output_extension(_FORM()))},
           {"file": "CASE WHEN p_size % 3 = 0 THEN p_partkey || '.js.map' WHEN p_size % 2 = 0 THEN p_partkey || '.mjs' ELSE p_partkey || '.cjs' END"})
_CHANGES = lambda: F.concat(F.lit("---\n'"), F.col("p_name"), F.lit("': patch\n---"), F.when(F.col("p_size") % 3 == 0, "").when(F.col("p_size") % 3 == 1, F.lit("\nlost")).otherwise(F.concat(F.lit("\n\nfix: "), F.col("p_type"), F.lit("\n"))))
projection("strip_packages", "part", ["p_partkey"], lambda: {"body": text.strip_packages(_CHANGES())}, {"body": r"CASE WHEN p_size % 3 = 0 THEN E'---\n''' || p_name || E''': patch\n---' WHEN p_size % 3 = 1 THEN '' ELSE 'fix: ' || p_type END"})
_RULE = lambda: F.concat(F.lit("---\ndescription: "), F.col("p_name"), F.lit("\nglobs: *."), F.col("p_size"), F.lit(",*.x \n---\nBody of "), F.col("p_type"), F.lit("\n"))
projection("quote_globs", "part", ["p_partkey"], lambda: {"fixed": text.quote_globs(_RULE()), "untouched": text.quote_globs(F.col("p_name"))}, {"fixed": r"""E'---\ndescription: ' || p_name || E'\nglobs: "*.' || p_size || E',*.x"\n---\nBody of ' || p_type || E'\n'""", "untouched": "p_name"})

# ---- URLs, time, JSON

SECRET = lambda: F.concat(F.regexp_extract("url", "^[^?#]*", 0), F.lit("?Api_Key=a%20b&page=1&x=ü+y&token=1&token=2"), F.regexp_extract("url", "#.*$", 0))
projection("redact_url", "pages", ["page_id"], lambda: {"redacted": web.redact(SECRET()), "plain": web.redact(F.col("url"))},
           {"redacted": "regexp_extract(url, '^[^?#]*', 0) || '?Api_Key=REDACTED&page=1&x=%C3%BC+y&token=REDACTED' || regexp_extract(url, '#.*$', 0)", "plain": "url"})
projection("url_params", "pages", ["page_id"], lambda: {"pairs": F.array_join(web.params_array(F.col("url")), ";"), "n": F.size(web.params(F.col("url"))).cast("long")},
           {"pairs": "replace(regexp_extract(url, '\\?([^#]*)', 1), '&', ';')", "n": "CAST(len(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: x <> '')) AS BIGINT)"})
projection("iso_timestamp", "events", ["event_id"], lambda: {"iso": web.iso_millis(F.unix_millis(F.col("ts").cast("timestamp")))}, {"iso": "strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ')"})
projection("error_body", "events", ["event_id"], lambda: {"status": (_E := web.error_body(F.col("event_id") % 5 != 0, F.element_at(F.array(*map(F.lit, (400, 401, 404, 500, 503))), (F.col("event_id") % 5 + 1).cast("int")), F.col("event_type")))["status"], "body": _E["body"], "logged": _E["logged"], "missing": web.not_found_body(), "raised": F.to_json(web.http_error(F.lit(418), F.col("event_type")))},
           {"status": "CASE WHEN event_id % 5 = 0 THEN 500 ELSE [400, 401, 404, 500, 503][event_id % 5 + 1] END",
            "body": """'{"success":false,"error":{"message":"' || CASE event_id % 5 WHEN 0 THEN 'internal server error' WHEN 1 THEN 'unauthorized' ELSE event_type END || '"}}'""",
            "logged": "event_id % 5 IN (0, 3, 4)", "missing": """'{"success":false,"error":{"message":"not found"}}'""", "raised": """'{"status":418,"message":"' || event_type || '"}'"""})


@query("""SELECT 'https://x.example/' || event_type || '?key=REDACTED&u=' || user_id AS url, 'GET' AS method, '/' || event_type AS path, '/:type' AS "routePath", 'key=REDACTED&u=' || user_id AS "searchParams",
  '[["cf-connecting-ip",""],["x-real-ip","10.0.0.' || (user_id % 9) || '"]]' AS headers, '10.0.0.' || (user_id % 9) AS ip, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS timestamp FROM events""")
def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    headers = F.create_map(F.lit("cf-connecting-ip"), F.lit(""), F.lit("x-real-ip"), F.concat(F.lit("10.0.0."), F.col("user_id") % 9))
    url = F.concat(F.lit("https://x.example/"), F.col("event_type"), F.lit("?key=s3&u="), F.col("user_id"))
    return records.request_log(e.select(url.alias("url"), F.lit("GET").alias("method"), F.concat(F.lit("/"), F.col("event_type")).alias("path"), F.lit("/:type").alias("route_path"), headers.alias("headers"), F.unix_millis(F.col("ts").cast("timestamp")).alias("started_ms")))


# ---- records

_GLOBS = lambda: F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).when(F.col("p_size") % 3 == 0, "")
projection("described", "part", ["p_partkey"], lambda: {"description": records.described(F.col("p_name"), _GLOBS(), F.col("p_size") % 5 == 0)},
           {"description": "'Read Cursor rule: ' || p_name || CASE WHEN p_size % 2 = 0 AND p_size % 5 = 0 THEN ' (applies to ' || p_brand || ', always-apply)' WHEN p_size % 2 = 0 THEN ' (applies to ' || p_brand || ')' WHEN p_size % 5 = 0 THEN ' (always-apply)' ELSE '' END"})
projection("path_prefix", "part", ["p_partkey"], lambda: {"paths": F.array_join(records.under(F.lit("src/"), F.array(F.concat(F.lit("./"), F.col("p_brand")), F.col("p_name"))), "|")}, {"paths": "'src/' || p_brand || '|src/' || p_name"})
_FEATURES = lambda: F.when(F.col("p_size") % 4 == 0, F.array(F.lit("entryPoint"))).when(F.col("p_size") % 4 == 1, F.array(F.lit("staticAssets"))).when(F.col("p_size") % 4 == 2, F.array(F.lit("entryPoint"), F.lit("staticAssets"))).otherwise(F.array().cast("array<string>"))
_NAME = lambda: F.when(F.col("p_size") % 5 == 0, F.col("p_name")).otherwise(F.lit("good-name"))
_CHECKED = lambda: validate.result(F.to_json(validate.worker_config(_NAME(), _FEATURES(), F.lit("src/index.ts"), F.lit("./public"), F.lit("2024-01-15"))), validate.options_error(_NAME(), _FEATURES()))
projection("worker_config", "part", ["p_partkey"], lambda: {"success": _CHECKED()["success"], "config": _CHECKED()["data"], "error": _CHECKED()["error"]}, {
    "success": "p_size % 5 <> 0 AND p_size % 4 <> 3",
    "config": """CASE WHEN p_size % 5 <> 0 THEN CASE p_size % 4 WHEN 0 THEN '{"name":"good-name","main":"src/index.ts","compatibility_date":"2024-01-15","observability":{"enabled":true}}'
      WHEN 1 THEN '{"name":"good-name","compatibility_date":"2024-01-15","assets":{"directory":"./public"}}'
      WHEN 2 THEN '{"name":"good-name","main":"src/index.ts","compatibility_date":"2024-01-15","observability":{"enabled":true},"assets":{"directory":"./public","binding":"ASSETS"}}' END END""",
    "error": "CASE WHEN p_size % 5 = 0 THEN " + NAME_SQL % {"x": "p_name"} + " WHEN p_size % 4 = 3 THEN 'At least one feature must be selected' END",
})
_PRESENT = lambda: F.array_compact(F.array(F.when(F.col("p_size") % 2 == 0, "yarn.lock"), F.when(F.col("p_size") % 3 == 0, "bun.lock"), F.when(F.col("p_size") % 5 == 0, "package-lock.json"), F.when(F.col("p_size") % 7 == 0, "index.ts"), F.when(F.col("p_size") % 4 == 0, "dist"), F.lit("public")))
projection("precedence", "part", ["p_partkey"], lambda: {"manager": records.package_manager(_PRESENT()), "entry": records.first_existing(records.ENTRY_POINTS, _PRESENT()), "assets": F.array_join(records.existing(records.ASSET_DIRECTORIES, _PRESENT()), ","), "cut": F.left(F.col("p_name"), F.lit(54))},
           {"manager": "CASE WHEN p_size % 3 = 0 THEN 'bun' WHEN p_size % 2 = 0 THEN 'yarn' ELSE 'npm' END", "entry": "CASE WHEN p_size % 7 = 0 THEN 'index.ts' END", "assets": "CASE WHEN p_size % 4 = 0 THEN 'public,dist' ELSE 'public' END", "cut": "left(p_name, 54)"})
_FLAGS = lambda: records.default_all({"deps": F.col("p_size") % 2 == 0, "lint": F.col("p_size") % 3 == 0, "types": F.lit(False), "format": F.lit(None).cast("boolean"), "exports": F.col("p_size") % 5 == 0}, ("deps", "lint", "types", "format"))
_NONE = "(p_size % 2 <> 0 AND p_size % 3 <> 0 AND p_size % 5 <> 0)"
projection("default_flags", "part", ["p_partkey"], _FLAGS, {"deps": f"p_size % 2 = 0 OR {_NONE}", "lint": f"p_size % 3 = 0 OR {_NONE}", "types": _NONE, "format": _NONE, "exports": "p_size % 5 = 0"})
projection("membership", "part", ["p_partkey"], lambda: {"manager": validate.one_of(F.when(F.col("p_size") % 2 == 0, "bun").when(F.col("p_size") % 3 == 0, "pip"), validate.MANAGERS), "either": records.either_has_key(F.create_map(F.col("p_brand"), F.lit("1")), F.when(F.col("p_size") % 2 == 0, F.create_map(F.lit("Brand#11"), F.lit("2"))), "Brand#11"), "some": F.exists(case.words(F.col("p_name")), lambda w: F.length(w) > 6)},
           {"manager": "p_size % 2 = 0", "either": "p_brand = 'Brand#11' OR p_size % 2 = 0", "some": f"len(list_filter({words_sql('p_name')}, lambda w: len(w) > 6)) > 0"})
projection("rule_files", "part", ["p_partkey"], lambda: {"files": F.array_join(records.files_to_remove(F.when(F.col("p_size") % 2 == 0, F.array(F.lit("claude"), F.lit("amp"))).otherwise(F.array(F.lit("cursor")))), ",")},
           {"files": "CASE WHEN p_size % 2 = 0 THEN '.cursor,.windsurf' ELSE 'CLAUDE.md,.claude,.windsurf,AGENTS.md' END"})
projection("first_match_rule", "events", ["event_id"], lambda: {"ttl": records.first_rule(F.col("event_type"), [("click", 60), ("view", 10), ("click", 5)])}, {"ttl": "CASE event_type WHEN 'click' THEN 60 WHEN 'view' THEN 10 END"})
projection("iso_validity", "events", ["event_id"], lambda: {"good": validate.iso_datetime_ok(web.iso_millis(F.unix_millis(F.col("ts").cast("timestamp")))), "bad": validate.iso_datetime_ok(F.lit("2024-13-01T00:00:00Z")), "loose": validate.iso_datetime_ok(F.col("ts").cast("string"))}, {"good": "true", "bad": "false", "loose": "false"})


@query("SELECT d.doc_id, d.lang, d.source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def semi_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.matching(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), table(spark, sf_dir, "labels"), "doc_id", "doc_id")


@query("SELECT d.doc_id, d.lang, d.source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.unmatched(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), table(spark, sf_dir, "labels"), "doc_id", "doc_id")


@query("SELECT c_custkey, c_nationkey AS name, n_name AS value FROM customer JOIN nation ON n_nationkey = c_nationkey")
def required_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("name"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("name"), F.col("n_name").alias("value"))
    return records.required_lookup(names, nations)


@query("SELECT r.r_name AS preset, n.n_name AS name, v.key, v.value FROM nation n JOIN region r ON r_regionkey = n_regionkey JOIN (VALUES ('NATION_6', 'A', '1'), ('NATION_6', 'B', '2'), ('NATION_18', 'A', '3'), ('NOWHERE', 'A', '4')) v(name, key, value) ON v.name = n.n_name")
def derived_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    presets = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("preset")).agg(F.collect_list("n_name").alias("names"))
    variables = spark.createDataFrame([("NATION_6", "A", "1"), ("NATION_6", "B", "2"), ("NATION_18", "A", "3"), ("NOWHERE", "A", "4")], "name string, key string, value string")
    return records.derived(records.expanded(presets), variables).select("preset", "name", "key", "value")


@query("SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id, event_type")
def last_wins_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.last_wins(table(spark, sf_dir, "events"), "event_type", "value", ["ts", "event_id"], by=["user_id"])


@query("SELECT user_id, bool_or(event_id % 11 = 1 OR event_id % 13 = 2) AS failed, count(*) AS n, string_agg(event_type, ',' ORDER BY event_id) AS types FROM events GROUP BY user_id")
def any_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.when(F.col("event_id") % 13 == 2, None).when(F.col("event_id") % 11 == 1, 2).otherwise(0)  # null: it never ended
    return table(spark, sf_dir, "events").groupBy("user_id").agg(records.any_failed(code).alias("failed"), F.count("*").alias("n"), records.joined(F.col("event_type"), F.col("event_id"), ",").alias("types"))


@query("SELECT count(*) AS n, min(length(text)) AS least FROM documents")
def rule_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("n"), F.coalesce(F.min(F.length("text")), F.lit(0)).cast("long").alias("least"))


@query("""SELECT event_id, k AS key, CASE WHEN k = 'type' AND event_id % 2 = 0 THEN 'over' WHEN k = 'type' THEN event_type WHEN k = 'user' THEN CAST(user_id AS VARCHAR) ELSE 'new' END AS value
  FROM events, (VALUES ('type'), ('user'), ('extra')) v(k) WHERE k <> 'extra' OR event_id % 3 = 0""")
def right_biased_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    low = F.create_map(F.lit("type"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string"))
    high = records.string_entries(F.create_map(F.lit("type"), F.when(F.col("event_id") % 2 == 0, "over"), F.lit("extra"), F.when(F.col("event_id") % 3 == 0, "new")))
    return e.select("event_id", F.explode(records.merged(low, high)).alias("key", "value"))


@query("SELECT event_id, element_at(m, 'a')[1] AS a, element_at(m, 'b')[1] AS b FROM (SELECT event_id, MAP {'a': CAST(user_id AS VARCHAR), 'b': event_type} AS m FROM events)")
def last_wins_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    m = records.last_wins_map(F.array(pair("a", F.lit("old")), pair("b", F.col("event_type")), pair("a", F.col("user_id").cast("string"))))
    return table(spark, sf_dir, "events").select("event_id", m.alias("m")).select("event_id", F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b"))


@query("SELECT name, count(*) AS n FROM (SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier UNION ALL SELECT c_name FROM customer) GROUP BY name")
def concatenation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name")), table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"))
    return records.concatenated([c, s, c]).groupBy("name").agg(F.count("*").alias("n"))


projection("array_sets", "part", ["p_partkey"], lambda: {"rest": F.array_join(F.array_except(case.words(F.col("p_type")), case.words(F.col("p_name"))), ","), "flat": F.array_join(F.flatten(F.array(case.words(F.col("p_type")), case.words(F.col("p_name")))), ",")},
           {"rest": "array_to_string(" + f"list_filter({words_sql('p_type')}, lambda x, i: NOT list_contains({words_sql('p_name')}, x) AND list_position({words_sql('p_type')}, x) = i)" + ", ',')", "flat": f"array_to_string(list_concat({words_sql('p_type')}, {words_sql('p_name')}), ',')"})


@query("SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS place FROM part")
def ranked_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.ranked(table(spark, sf_dir, "part"), ["p_brand"], [F.col("p_retailprice"), F.col("p_partkey")]).select("p_partkey", "p_name", F.col("place").cast("long").alias("place"))


# ---- validation

@query("""SELECT event_id, json_valid(props) AND json_extract_string(props, '$.k') IS NOT NULL AS success, json_extract_string(props, '$.k') AS first FROM events""")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = validate.json_soft(F.col("props"), "k string", required=["k"])
    return table(spark, sf_dir, "events").select("event_id", got.alias("g")).select("event_id", F.col("g.success").alias("success"), F.col("g.data.k").alias("first"))


_ITEM = lambda: F.to_json(F.struct(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("title"), F.lit(True).alias("favorite"), F.lit(1).alias("version"), F.struct(F.lit("v").alias("id"), F.lit("n").alias("name")).alias("vault"), F.when(F.col("c_custkey") % 2 == 0, "SECURE_NOTE").otherwise("LOGIN").alias("category"), F.lit("x").alias("last_edited_by"), F.lit("2024-01-02T03:04:05Z").alias("created_at"), F.when(F.col("c_custkey") % 3 == 0, "yesterday").otherwise("2024-01-02T03:04:05Z").alias("updated_at"), F.when(F.col("c_custkey") % 5 != 0, "").alias("additional_information"), F.array(F.struct(F.lit("s").alias("id"))).alias("sections"), F.array().cast("array<struct<id:string>>").alias("fields")))
projection("secret_item", "customer", ["c_custkey"], lambda: {"error": validate.secret_item_error(F.col("item"))}, {"error": "CASE WHEN c_custkey % 5 = 0 THEN 'additional_information is required' WHEN c_custkey % 2 <> 0 THEN 'category is invalid' WHEN c_custkey % 3 = 0 THEN 'time is invalid' END"}, once=lambda: {"item": validate.json_strict(_ITEM(), validate.SECRET_ITEM)})
_TASKS = lambda: F.concat(F.lit('{"unknown":1,'), F.when(F.col("p_size") % 7 == 0, '"$schema":"own",').otherwise(""), F.lit('"ui":"'), F.when(F.col("p_size") % 2 == 0, "tui").otherwise("gui"), F.lit('","tasks":{"build":{"cache":true,"dependsOn":["^build","//#gen","lint"],"outputLogs":"'), F.when(F.col("p_size") % 3 == 0, "all").otherwise("full"), F.lit('"}}}'))
projection("task_config", "part", ["p_partkey"], lambda: {"error": validate.task_config_error(F.col("config")), "schema": validate.with_default_schema(F.col("config")["$schema"], "https://json.example/schema")}, {"error": "CASE WHEN p_size % 2 <> 0 THEN 'ui is invalid' WHEN p_size % 3 = 0 THEN 'outputLogs is invalid' END", "schema": "CASE WHEN p_size % 7 = 0 THEN 'own' ELSE 'https://json.example/schema' END"}, once=lambda: {"config": validate.json_strict(_TASKS(), validate.TASK_CONFIG)})


@query("SELECT p_partkey, 'build' AS task, d AS depends_on, s AS scope FROM part, (VALUES ('build', 'upstream'), ('gen', 'root'), ('lint', 'package')) v(d, s)")
def task_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = table(spark, sf_dir, "part").select("p_partkey", validate.json_strict(_TASKS(), validate.TASK_CONFIG)["tasks"].alias("tasks"))
    return recursive.task_edges(config, keep=["p_partkey"])


# ---- sinks and whole plans

_CELL = lambda: F.concat(F.col("p_name"), F.when(F.col("p_size") % 3 == 0, '\t"x"').otherwise(""))
projection("tsv_rows", "part", ["p_partkey"], lambda: {"line": files.tsv_row(F.col("p_partkey"), _CELL(), F.lit(None), F.col("p_size")), "environment": files.environment_value(F.col("p_partkey"), F.col("p_brand"))},
           {"line": r'''p_partkey || E'\t' || CASE WHEN p_size % 3 = 0 THEN '"' || p_name || E'\t""x"""' ELSE p_name END || E'\t\t' || p_size''', "environment": """'{"p_partkey":' || p_partkey || ',"p_brand":"' || p_brand || '"}'"""})


@query(r"""SELECT p_partkey || '.mdc' AS filename, CAST(p_partkey AS VARCHAR) AS name, p_name AS description, CASE WHEN p_size % 2 = 0 THEN '*.' || p_size || ',*.x' END AS globs, p_size % 5 = 0 AS always, 'Body of ' || p_type AS content
  FROM part WHERE length(p_name) >= 10""")
def rule_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    globs = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("*."), F.col("p_size"), F.lit(",*.x"))).otherwise("")
    body = F.concat(F.lit("---\ndescription: "), F.col("p_name"), F.lit("\nglobs: "), globs, F.lit("\nalwaysApply: "), (F.col("p_size") % 5 == 0).cast("string"), F.lit("\n---\n\nBody of "), F.col("p_type"), F.lit("\n"))
    docs = shared.dealt(table(spark, sf_dir, "part")).select(F.concat(F.lit("/rules/"), F.col("p_partkey"), F.lit(".mdc")).alias("path"), body.alias("value"))
    f = F.col("frontmatter")
    return rules.valid(rules.parse(docs)).select("filename", "name", f["description"].alias("description"), f["globs"].alias("globs"), f["alwaysApply"].alias("always"), "content")


@query(r"""SELECT p_partkey || '.mdc' AS filename, CASE p_size % 3 WHEN 0 THEN p_name || ' of ' || p_brand || E'\nlast' WHEN 1 THEN p_name || E'\n\n  of ' || p_brand || E'\n' ELSE p_name || E' "of"\n' || p_brand END AS description,
  'it''s *.' || p_size || ' too' AS globs FROM part""")
def rule_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Front matter with folded, literal and quoted scalars of several lines."""
    name, brand = F.col("p_name"), F.col("p_brand")
    folded = F.concat(F.lit(">-\n  "), name, F.lit("\n  of "), brand, F.lit("\n\n  last\n"))
    literal = F.concat(F.lit("|\n    "), name, F.lit("\n\n      of "), brand, F.lit("\n\n"))
    quoted = F.concat(F.lit('"'), name, F.lit(' \\"of\\"\\n\\\n  '), brand, F.lit('"  # note\n'))
    value = F.when(F.col("p_size") % 3 == 0, folded).when(F.col("p_size") % 3 == 1, literal).otherwise(quoted)
    body = F.concat(F.lit("---\ntags: [a, b]\ndescription: "), value, F.lit("globs: 'it''s\n  *."), F.col("p_size"), F.lit("\n  too'\n---\nBody\n"))
    docs = shared.dealt(table(spark, sf_dir, "part")).select(F.concat(F.lit("/rules/"), F.col("p_partkey"), F.lit(".mdc")).alias("path"), body.alias("value"))
    f = F.col("frontmatter")
    return rules.valid(rules.parse(docs)).select("filename", f["description"].alias("description"), f["globs"].alias("globs"))


@query("""SELECT 'secret' AS kind, n_name AS key, 's' || n_nationkey AS value FROM nation WHERE n_regionkey = 3 OR n_name = 'NATION_7'
  UNION ALL SELECT 'variable', 'REGION', 'given' UNION ALL SELECT 'variable', 'D_' || n_name, n_name FROM nation WHERE n_regionkey = 3 OR n_name = 'NATION_7' UNION ALL SELECT 'variable', 'D_ABSENT', 'x' UNION ALL SELECT 'variable', 'TWICE', 'late'""")
def container_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    held = nation.select(F.col("n_name").alias("name"), F.concat(F.lit("s"), F.col("n_nationkey")).alias("value"))
    presets = nation.groupBy(F.concat(F.lit("r"), F.col("n_regionkey")).alias("preset")).agg(F.collect_list("n_name").alias("names"))
    asked = spark.createDataFrame([("NATION_7", 0), ("ABSENT", 1)], "name string, at int")
    wanted = spark.createDataFrame([("r3",)], "preset string")
    own = nation.select(F.col("n_name").alias("name"), F.concat(F.lit("D_"), F.col("n_name")).alias("key"), F.col("n_name").alias("value"))
    more = [("ABSENT", "D_ABSENT", "x", 0), ("NATION_7", "REGION", "derived", 0), ("NATION_7", "TWICE", "z", 1), ("NATION_7", "TWICE", "y", 2), ("ABSENT", "TWICE", "late", 3)]
    variables = own.withColumn("at", F.lit(0)).unionByName(spark.createDataFrame(more, "name string, key string, value string, at int"))
    env = spark.createDataFrame([("REGION", "given"), ("NOTHING", None)], "key string, value string")
    return secrets.with_env(held, secrets.secret_names(asked, presets, wanted), variables, env)


@query("""SELECT f.key AS label, arg_max(f.value, f.at) AS value FROM (SELECT event_type AS key, CAST(user_id AS VARCHAR) AS value, event_id AS at, user_id % 4 AS s FROM events) f WHERE s IN (1, 2) GROUP BY f.key""")
def section_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    field = F.struct(F.col("event_id").alias("at"), F.struct((F.col("user_id") % 4).cast("string").alias("id")).alias("section"), F.col("event_type").alias("label"), F.col("user_id").cast("string").alias("value"))
    fields = e.select(field.alias("f")).select(F.col("f.at").alias("at"), F.col("f.section.id").alias("section"), F.col("f.label").alias("label"), F.col("f.value").alias("value"))
    sections = spark.createDataFrame([("1",), ("2",)], "id string")
    return records.last_wins(records.matching(fields, sections, "section", "id"), "label", "value", ["at"])


# ---- sources: files are written to the shared folder first, then read as any others

def _nation_files(spark: SparkSession, sf_dir: str, name: Callable[[int, str], str], content: Callable[[int, str], str]) -> str:
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect()  # a fixed table of 25 rows
    return shared.write_files(spark, shared.new_dir(spark), {name(k, n): content(k, n) for k, n in nations})


@query(r"""SELECT 'cursor_rule_' || n_name AS tool, 'Read Cursor rule: About ' || n_name || CASE WHEN n_nationkey % 3 = 0 AND n_nationkey % 2 = 0 THEN ' (applies to *.' || n_nationkey || ', always-apply)' WHEN n_nationkey % 3 = 0 THEN ' (always-apply)'
  WHEN n_nationkey % 2 = 0 THEN ' (applies to *.' || n_nationkey || ')' ELSE '' END AS description, 'Body ' || n_nationkey AS content FROM nation WHERE n_nationkey % 5 <> 4 AND length('About ' || n_name) >= 10""")
def rule_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directory of rule files to tools; every fifth file is no rule file."""
    globs = lambda k: f"globs: *.{k}\n" if k % 2 == 0 else ""
    at = _nation_files(spark, sf_dir, lambda k, n: f"{n}.{'md' if k % 5 == 4 else 'mdc'}", lambda k, n: f"---\ndescription: About {n}\n{globs(k)}alwaysApply: {str(k % 3 == 0).lower()}\n---\nBody {k}\n")
    return rules.tools(spark, at)


@query(r"""SELECT n_name || '.mdc' AS filename, CASE n_nationkey % 4 WHEN 0 THEN 'missing description (must be at least 10 characters)' WHEN 1 THEN 'alwaysApply is no boolean' WHEN 2 THEN 'globs is no string' END AS error FROM nation WHERE n_nationkey % 4 <> 3""")
def rule_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = ["description: short\n", "description: long enough for a rule\nalwaysApply: maybe\n", "description: long enough for a rule\nglobs:\n  - a\n", "description: long enough for a rule\n"]
    at = _nation_files(spark, sf_dir, lambda k, n: f"{n}.mdc", lambda k, n: f"---\n{heads[k % 4]}---\nBody\n")
    return rules.rejected(rules.parse(documents.rule_files(spark, at)))


@query("SELECT 'a/' || n_name || CASE WHEN n_nationkey % 2 = 0 THEN '.ts' ELSE '.tsx' END AS path, 'text ' || n_nationkey AS value FROM nation WHERE n_nationkey % 3 <> 0")
def globbed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several globs, some of them negative, down through folders."""
    def name(k: int, n: str) -> str:
        return f"{'node_modules/x' if k % 3 == 0 else 'a'}/{n}.{'ts' if k % 2 == 0 else 'tsx'}"

    at = _nation_files(spark, sf_dir, name, lambda k, n: f"text {k}")
    shared.write_files(spark, at, {"a/readme.md": "no", "a/x.d.ts": "no"})
    got = documents.files_by_glob(spark, at, ["**/*.{ts,tsx}", "!**/node_modules/**", "!*.d.ts"])
    return got.select(F.regexp_extract("path", "[^/]+/[^/]+$", 0).alias("path"), "value")


@query(r"""SELECT p_partkey, 'src/' || p_name || '/' || CASE WHEN p_size % 2 = 0 THEN 'test.ts' ELSE 'b.test.tsx' END AS path FROM part WHERE p_size % 3 <> 0 AND (p_size % 2 <> 0 OR p_name NOT LIKE 's%')""")
def glob_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    path = F.concat(F.lit("src/"), "p_name", F.lit("/"), F.when(F.col("p_size") % 3 == 0, "test.js").when(F.col("p_size") % 2 == 0, "test.ts").otherwise("b.test.tsx"))
    return parts.select("p_partkey", path.alias("path")).where(text.path_matches(F.col("path"), ["**/*test.{ts,tsx}", "!s*/test.t?", "!src/s*/test.t?"]))


@query("SELECT n_name AS name, 'dep' || n_nationkey AS dependency, '^' || n_regionkey AS version FROM nation")
def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed JSON documents with unknown keys."""
    regions = {r.n_name: r.n_regionkey for r in table(spark, sf_dir, "nation").select("n_name", "n_regionkey").collect()}
    at = _nation_files(spark, sf_dir, lambda k, n: f"{n}.json", lambda k, n: json.dumps({"name": n, "private": True, "dependencies": {f"dep{k}": f"^{regions[n]}"}}, indent=2))
    return documents.json_document(spark, at, validate.MANIFEST).select("name", F.explode("dependencies").alias("dependency", "version"))


@query("SELECT n_name AS config, 'es' || n_nationkey AS target, CASE WHEN n_nationkey % 2 = 0 THEN 'true' END AS strict FROM nation")
def commented_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON with comments."""
    strict = lambda k: '"strict": "true", ' if k % 2 == 0 else ""
    at = _nation_files(spark, sf_dir, lambda k, n: f"{n}.json", lambda k, n: f'{{ // of {n}\n  "name": "{n}", /* options */\n  "compilerOptions": {{ {strict(k)}"target": "es{k}" }}\n}}')
    got = documents.json_document(spark, at, "name string, compilerOptions struct<target:string,strict:string>", comments=True)
    return got.select(F.col("name").alias("config"), "compilerOptions.target", "compilerOptions.strict")


@query("SELECT n_name AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'category is invalid' END AS error, 'v' || n_nationkey AS value FROM nation")
def captured_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a process printed, one JSON document a file, checked as a secret item."""
    def item(k: int, n: str) -> str:
        field = {"id": "f", "type": "STRING", "label": "l", "value": f"v{k}", "reference": "r", "section": {"id": "s"}}
        rest = {"title": n, "favorite": False, "version": 1, "vault": {"id": "v", "name": "n"}, "category": "LOGIN" if k % 2 == 0 else "SECURE_NOTE", "last_edited_by": "x", "additional_information": ""}
        return json.dumps({"id": n, **rest, "created_at": "2024-01-02T03:04:05Z", "updated_at": "2024-01-02T03:04:05Z", "sections": [{"id": "s"}], "fields": [field]})

    got = documents.captured_json(spark, _nation_files(spark, sf_dir, lambda k, n: f"{n}.out", item), validate.SECRET_ITEM)
    return got.select("id", validate.secret_item_error(F.struct(*got.columns)).alias("error"), F.col("fields")[0]["value"].alias("value"))


@query("SELECT n_name AS line FROM nation UNION ALL SELECT 'second ' || n_nationkey FROM nation")
def process_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.output_lines(spark, _nation_files(spark, sf_dir, lambda k, n: f"{n}.out", lambda k, n: f"{n}\n\nsecond {k}\n\n"))


@query(r"""SELECT '/r/' || p_brand || '/' || p_type || '/' || p_partkey AS folder, CASE WHEN p_partkey % 4 = 0 THEN '/r/' || p_brand || '/' || p_type || '/' || p_partkey || '/turbo.json' WHEN length(p_type) % 2 = 0 THEN '/r/' || p_brand || '/' || p_type || '/turbo.json' END AS found FROM part""")
def nearest_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest marker file in a folder or above it."""
    part = table(spark, sf_dir, "part")
    above = F.concat(F.lit("/r/"), "p_brand", F.lit("/"), "p_type")
    folders = part.select(F.concat(above, F.lit("/"), "p_partkey").alias("folder"))
    own = folders.join(part.where("p_partkey % 4 = 0").select(F.concat(above, F.lit("/"), "p_partkey").alias("folder")), "folder").select(F.concat("folder", F.lit("/turbo.json")).alias("path"))
    shared_ones = part.where("length(p_type) % 2 = 0").select(F.concat(above, F.lit("/turbo.json")).alias("path")).distinct()
    return records.nearest_above(folders, own.union(shared_ones), "turbo.json")


# ---- sinks

@query("SELECT event_type || event_id AS name, CASE WHEN event_id % 4 = 0 THEN 'Success!' ELSE 'Failed with code: ' || (event_id % 4) END AS outcome FROM events")
def result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.result_table(table(spark, sf_dir, "events").select(F.concat("event_type", "event_id").alias("name"), (F.col("event_id") % 4).cast("int").alias("exit_code")))


@query("""SELECT 'secret' AS kind, n_name AS key FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 'variable', 'D_' || n_name FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 'variable', 'GIVEN' UNION ALL SELECT 'variable', 'NOTHING'""")
def container_cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    held = nation.select(F.col("n_name").alias("name"), F.lit("s").alias("value"))
    presets = nation.groupBy(F.concat(F.lit("r"), F.col("n_regionkey")).alias("preset")).agg(F.collect_list("n_name").alias("names"))
    names = secrets.secret_names(spark.createDataFrame([], "name string"), presets, spark.createDataFrame([("r2",)], "preset string"))
    variables = nation.select(F.col("n_name").alias("name"), F.concat(F.lit("D_"), F.col("n_name")).alias("key"), F.lit("x").alias("value"))
    return secrets.without_env(held, names, variables, spark.createDataFrame([("GIVEN", "1"), ("NOTHING", None)], "key string, value string"))


@query("SELECT c_nationkey AS key, CASE WHEN max(c_custkey) % 2 = 0 THEN 'late' || max(c_custkey) ELSE 'early' || c_nationkey END AS value FROM customer GROUP BY c_nationkey")
def merged_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    early = c.select(F.col("c_nationkey").alias("key"), F.concat(F.lit("early"), "c_nationkey").alias("value")).distinct()
    late = c.groupBy(F.col("c_nationkey").alias("key")).agg(F.max("c_custkey").alias("m")).where("m % 2 = 0").select("key", F.concat(F.lit("late"), "m").alias("value"))
    return records.merge_tables([early, late], "key", "value")


# ---- paths, commands, languages, time and JSON

projection("normal_paths", "part", ["p_partkey"], lambda: {"path": records.under(F.lit("out"), F.array(F.concat(F.lit("./a//"), F.col("p_name"), F.when(F.col("p_size") % 2 == 0, "/../b/").otherwise("/./b"))))[0], "above": records.normal_path(F.concat(F.lit("/x/../../"), F.col("p_type"))), "back": records.normal_path(F.concat(F.lit("../"), F.col("p_brand"), F.lit("/..")))},
           {"path": "CASE WHEN p_size % 2 = 0 THEN 'out/a/b/' ELSE 'out/a/' || p_name || '/b' END", "above": "'/' || p_type", "back": "'..'"})
projection("add_commands", "part", ["p_partkey"], lambda: {"command": F.concat_ws(" ", records.add_command(F.element_at(F.array(*map(F.lit, ("bun", "pnpm", "yarn", "npm", "pip"))), (F.col("p_size") % 5 + 1).cast("int")), "wrangler"))},
           {"command": "CASE p_size % 5 WHEN 0 THEN 'bun add --dev wrangler' WHEN 1 THEN 'pnpm add --save-dev wrangler' WHEN 2 THEN 'yarn add --dev wrangler' WHEN 3 THEN 'npm install --save-dev wrangler' ELSE '' END"})
projection("language_case", "part", ["p_partkey"], lambda: {"low": text.lower_in(F.concat(F.lit("Iİ"), F.upper("p_name")), "tr"), "high": text.upper_in(F.concat(F.lit("ıi"), "p_name"), "tr"), "plain": text.upper_in(F.concat(F.lit("i"), "p_name"))},
           {"low": "'ıi' || replace(lower(p_name), 'i', 'ı')", "high": "'Iİ' || upper(replace(p_name, 'i', 'İ'))", "plain": "'I' || upper(p_name)"})
projection("pretty_records", "part", ["p_partkey"], lambda: {"json": web.pretty_json(F.struct(F.col("p_partkey").alias("key"), F.struct(F.concat(F.col("p_name"), F.lit('" : ')).alias("name"), F.lit(True).alias("on")).alias("sub")))},
           {"json": r"""E'{\n  "key": ' || p_partkey || E',\n  "sub": {\n    "name": "' || p_name || E'\\" : ",\n    "on": true\n  }\n}'"""})


@query("SELECT event_type, max(event_type) AS parsed, strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%gZ') AS latest, CAST(count(*) FILTER (WHERE strftime(ts, '%Y-%m-%d') < strftime(current_date, '%Y-%m-%d')) AS BIGINT) AS before_today FROM events GROUP BY event_type")
def clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each type of event: the type, raising if it were none; the latest moment; how many lie before today."""
    at = F.col("ts").cast("timestamp")
    kind = validate.parsed(F.col("event_type"), F.when(F.col("event_type") == "", F.lit("event_type is required")))
    e = table(spark, sf_dir, "events").select("event_type", kind.alias("parsed"), F.unix_millis(at).alias("ms"), (F.date_format(at, "yyyy-MM-dd") < web.today()).alias("past"))
    return e.groupBy("event_type").agg(F.max("parsed").alias("parsed"), web.iso_millis(F.max("ms")).alias("latest"), F.count_if("past").alias("before_today"))


# ---- the response cache, as a table

_CACHE_SQL = """WITH RECURSIVE e AS (SELECT user_id || ' ' || event_type AS key, ts, epoch_ms(ts) AS ms, row_number() OVER (PARTITION BY user_id, event_type ORDER BY epoch_ms(ts), {status}) AS n, {status} AS status, {ttl} AS ttl FROM events),
  r AS (SELECT key, n, ts, status, FALSE AS hit, CASE WHEN ttl > 0 THEN ms + 1000 * ttl ELSE 0 END AS until FROM e WHERE n = 1
    UNION ALL SELECT e.key, e.n, e.ts, e.status, e.ms < r.until, CASE WHEN e.ms >= r.until AND e.ttl > 0 THEN e.ms + 1000 * e.ttl ELSE r.until END FROM r JOIN e ON e.key = r.key AND e.n = r.n + 1)
  SELECT key, ts, status, hit FROM r"""
_STATUS = "CAST(CASE event_id % 3 WHEN 0 THEN 200 WHEN 1 THEN 404 ELSE 500 END AS INT)"


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_id") % 3 == 0, 200).when(F.col("event_id") % 3 == 1, 404).otherwise(500).alias("status"))


def cache_query(name: str, ttl: str, **options: object) -> None:
    QUERIES[name] = lambda spark, sf_dir: responses.cached_table(_requests(spark, sf_dir), by=("user_id", "event_type"), **options)
    ORACLE_SQL[name] = _CACHE_SQL.format(status=_STATUS, ttl=ttl)


cache_query("cache_ok", "CASE WHEN event_id % 3 = 0 THEN 100000 ELSE 0 END", rules=[(200, 100_000)])
cache_query("cache_all", "50000", default_ttl=50_000)
cache_query("cache_by_status", "CASE event_id % 3 WHEN 0 THEN 200000 WHEN 1 THEN 20000 ELSE 0 END", rules=[(200, 200_000), (404, 20_000), (200, 5)])


@query("""SELECT d.doc_id, 'Read Cursor rule: ' || d.lang || '-' || d.source || CASE WHEN d.doc_id % 2 = 0 THEN ' (applies to *.' || d.lang || ')' ELSE '' END AS description,
  CAST(length(d.text) AS BIGINT) AS n_chars, array_to_string(list_filter(list_transform(string_split(text, E'\\n'), lambda x: trim(x, E' \\t\\r')), lambda x: x <> ''), ' ') AS line
  FROM documents d WHERE length(text) >= 10 AND EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan, filter by length, membership, project: the longest path from documents to descriptions."""
    docs = table(spark, sf_dir, "documents").where(F.length("text") >= rules.LEAST_DESCRIPTION)
    known = records.matching(docs, table(spark, sf_dir, "labels"), "doc_id", "doc_id")
    label = case.kebab_case(F.concat_ws(" ", "lang", "source"))
    globs = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("*."), F.col("lang")))
    return known.select("doc_id", records.described(label, globs, F.lit(False)).alias("description"), F.length("text").cast("long").alias("n_chars"), text.one_line(F.col("text")).alias("line"))

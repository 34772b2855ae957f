"""The template helpers as functions of SQL, so that a query in text alone can call them.

Each is a temporary function whose body is an expression, which Spark puts in place of the call: no Python runs.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from sparkloom.functions.case import ACCENTED, PLAIN

_WORDS = r"""filter(split(regexp_replace(regexp_replace(regexp_replace(value, r'([\p{Ll}0-9])(\p{Lu})', '$1 $2'), r'(\p{Lu})(\p{Lu}\p{Ll})', '$1 $2'), r'[^\p{L}0-9]+', ' '), ' '), w -> w <> '')"""
_NUMBERS = r"""filter(split(regexp_replace(array_join(word_list(value), ' '), r'(?<=[0-9])(?=\p{Ll})|(?<=\p{L})(?=[0-9])', ' '), ' '), w -> w <> '')"""
_PASCAL = r"""array_join(transform(split_words, (w, i) -> CASE WHEN i > 0 AND w RLIKE '^[0-9]' THEN concat('_', lower(w)) ELSE concat(upper(left(w, 1)), lower(substring(w, 2))) END), '')"""
_SLUG = rf"""regexp_replace(lower(regexp_replace(regexp_replace(replace(translate(value, '{ACCENTED}', '{PLAIN}'), 'ß', 'ss'), "['.]", ''), r'^\s+|\s+$', '')), r'\s+', '-')"""

#: (name, parameters, result, body), each made of those before it. Pascal forms take a list of words, so a query may split
#: text as it likes.
FUNCTIONS = (
    ("word_list", "value STRING", "ARRAY<STRING>", _WORDS),
    ("word_and_number_list", "value STRING", "ARRAY<STRING>", _NUMBERS),
    ("pascal_of", "split_words ARRAY<STRING>", "STRING", _PASCAL),
    ("kebab_of", "split_words ARRAY<STRING>", "STRING", "lower(array_join(split_words, '-'))"),
    ("singular", "value STRING", "STRING", "regexp_replace(value, 's$', '')"),
    ("plural", "value STRING", "STRING", "CASE WHEN endswith(value, 's') THEN value ELSE concat(value, 's') END"),
    ("slug", "value STRING", "STRING", _SLUG),
    ("slug_s", "value STRING", "STRING", "singular(slug(value))"),
    ("slug_p", "value STRING", "STRING", "plural(slug(value))"),
    ("pascal", "value STRING", "STRING", "pascal_of(word_list(value))"),
    ("pascal_s", "value STRING", "STRING", "singular(pascal(value))"),
    ("pascal_p", "value STRING", "STRING", "plural(pascal(value))"),
)


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    """Make the functions in this session, replacing those of the same names; their names. A null value gives null."""
    names = [n for n, *_ in FUNCTIONS]
    for name, parameters, result, body in FUNCTIONS:
        for n in names:
            body = body.replace(f"{n}(", f"{prefix}{n}(") if prefix else body
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS {result} RETURN {body}")
    return [prefix + n for n in names]

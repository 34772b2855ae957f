"""Rule documents to tool descriptions: scan, parse, validate, filter, project."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import text
from sparkloom.functions.validate import first_error, result
from sparkloom.operators.records import described, settled
from sparkloom.sources.documents import rule_files

LEAST_DESCRIPTION = 10


KEYS = ("description", "globs", "alwaysApply")
#: Top-level lines must be comments, markers or open with a key, quoted or not.
_KEY = r"""(?:"[^"\n]*"|'[^'\n]*'|[^\s#"'\[{&*!|>%@`,\]}-][^\n]*?)[ \t]*:(?:[ \t]|$)"""


def _header_error() -> Column:
    """First message of a header whose values have been read."""
    header, kind = F.col("header"), {k: F.col(f"kind_{k}") for k in KEYS}
    twice = lambda k: F.size(F.split(header, rf"""(?m)^(?:{k}|"{k}"|'{k}')[ \t]*:(?:[ \t]|$)""", -1)) > 2
    any_key = lambda test: reduce(or_, map(test, KEYS))
    return first_error(
        (~header.rlike(rf"(?dm)^(?!#|{_KEY})[^\s]") & ~any_key(twice) & ~any_key(lambda k: kind[k] == "malformed"), "malformed header"),
        (~any_key(lambda k: kind[k] == "unread"), "anchors, aliases and tags are not read"),
        (kind["description"].isin("absent", "null", "text"), "description is no string"),
        (kind["globs"].isin("absent", "null", "text"), "globs is no string"),
        (kind["alwaysApply"].isin("absent", "boolean"), "alwaysApply is no boolean"),
    )


def read_key(df: DataFrame, key: str) -> DataFrame:
    """df with kind_ and value_ of a key of its column header: see text.yaml_kind. Each step is used more than once."""
    chunk, short, block, flow = F.col("__chunk"), F.col("__short"), F.col("__block"), F.col("__flow")
    cut = settled(settled(df, __chunk=text.yaml_chunk(F.col("header"), key)), __short=text.yaml_short(chunk))
    rest = chunk.isNotNull() & short.isNull()
    read = settled(cut, __block=F.when(rest, text.yaml_block(chunk)), __flow=F.when(rest, text.yaml_flow(chunk)))
    value = F.when(short.isNotNull(), short["value"]).when(rest, F.when(block["found"], block["value"]).otherwise(text.yaml_string(flow)))
    kind = F.when(short.isNotNull(), short["kind"]).when(rest, text.yaml_kind(chunk, block, flow)).otherwise("absent")
    return settled(read, **{f"kind_{key}": kind, f"value_{key}": value}).drop("__chunk", "__short", "__block", "__flow")


def parse(files: DataFrame) -> DataFrame:
    """(filename, name, checked, content, fullContent) of (path, value); globs are quoted first, so parsing is one pass.

    checked is struct(success, data, error); null and absent descriptions are empty. The three keys may be plain, quoted,
    literal or folded scalars of any number of lines; anchors, aliases and tags are rejected. Values of other keys are not
    looked at."""
    fixed = settled(files.select("path", "value"), fixed=text.quote_globs(F.col("value")))
    doc = text.front_matter(F.col("fixed"))
    parts = settled(fixed, header=doc["header"], body=doc["body"])
    judged = settled(reduce(read_key, KEYS, parts), error=_header_error())
    data = F.struct(
        F.coalesce("value_description", F.lit("")).alias("description"),
        F.col("value_globs").alias("globs"),
        (F.lower("value_alwaysApply") == "true").alias("alwaysApply"),
    )
    filename = F.element_at(F.split("path", "/"), -1)
    name = F.regexp_replace(filename, r"^(.*?)\.mdc", "$1")
    return judged.select(filename.alias("filename"), name.alias("name"), result(data, F.col("error")).alias("checked"), text.strip(F.col("body")).alias("content"), F.col("value").alias("fullContent"))


def valid(rules: DataFrame) -> DataFrame:
    """Rules with a valid header and a description of ten characters or more."""
    good = rules.where(F.col("checked.success") & (F.length("checked.data.description") >= LEAST_DESCRIPTION))
    return good.select("filename", "name", F.col("checked.data").alias("frontmatter"), "content", "fullContent")


def rejected(rules: DataFrame) -> DataFrame:
    """(filename, error) of the rest."""
    short = F.lit(f"missing description (must be at least {LEAST_DESCRIPTION} characters)")
    return rules.where(~F.col("checked.success") | (F.length("checked.data.description") < LEAST_DESCRIPTION)).select("filename", F.coalesce("checked.error", short).alias("error"))


def tools(spark: SparkSession, directory: str, prefix: str = "cursor_rule_") -> DataFrame:
    """(tool, description, content) of a directory's rules."""
    rules = valid(parse(rule_files(spark, directory)))
    f = F.col("frontmatter")
    return rules.select(F.concat(F.lit(prefix), F.col("name")).alias("tool"), described(f["description"], f["globs"], f["alwaysApply"]).alias("description"), "content")

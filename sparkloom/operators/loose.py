"""Files of JSON objects with any keys, as tables (path, text): what to write, what differs, what stands in the way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Any of these means that a folder has a configuration already.
CONFIG_FILES = ("wrangler.jsonc", "wrangler.json", "wrangler.toml")


def order_free(text: Column) -> Column:
    """JSON with all keys and values, keys sorted at every level, without white space; null for text that is no JSON. Numbers
    are written as they are read."""
    return F.to_json(F.try_parse_json(text))


def order_bound(text: Column) -> Column:
    """JSON without white space outside strings, keys in their order; null for text that is no JSON."""
    bare = F.regexp_replace(text, r'("(?:[^"\\]|\\.)*+")|\s+', "$1")
    return F.when(F.try_parse_json(text).isNotNull(), bare)


def compared(current: DataFrame, wanted: DataFrame, ordered: bool = True) -> DataFrame:
    """(path, state, text): for each path of either table (path, text), whether its JSON is the same, differs, or is missing from
    the current or the wanted files; text is the wanted one. A text that is no JSON is the same as none but the same text.

    Paths are listed once in each table. One shuffle join; texts are compared where the join puts them."""
    form = order_bound if ordered else order_free
    a = current.select("path", F.coalesce(form(F.col("text")), F.concat(F.lit("?"), "text")).alias("held"), F.lit(True).alias("there"))
    b = wanted.select("path", "text", F.coalesce(form(F.col("text")), F.concat(F.lit("?"), "text")).alias("given"), F.lit(True).alias("asked"))
    state = F.when(F.col("there").isNull(), "missing").when(F.col("asked").isNull(), "unwanted").when(F.col("held").eqNullSafe(F.col("given")), "same").otherwise("differs")
    return a.join(b, "path", "full").select("path", state.alias("state"), "text")


def writes(current: DataFrame, wanted: DataFrame, ordered: bool = True) -> DataFrame:
    """(path, text) of the wanted files that are missing or differ: what remains to be written."""
    return compared(current, wanted, ordered).where("state IN ('missing', 'differs')").select("path", "text")


def checked(current: DataFrame, wanted: DataFrame, ordered: bool = True) -> DataFrame:
    """(path) of the wanted files; reading it raises an error at the first that is missing or differs."""
    c = compared(current, wanted, ordered).where("state <> 'unwanted'")
    return c.select(F.when(F.col("state") == "same", F.col("path")).otherwise(F.raise_error(F.concat("path", F.lit(" does not match its source")))).alias("path"))


def guarded(current: DataFrame, wanted: DataFrame, others: tuple[str, ...] = CONFIG_FILES) -> DataFrame:
    """wanted (path, text) with `blocked_by`: the first file by name, among its own and the others in its folder, that is there
    already; null where it may be written."""
    folder, name = F.regexp_extract("path", r"^(.*/)?", 0), F.regexp_extract("path", r"[^/]*\z", 0)
    names = F.array_sort(F.array_distinct(F.concat(F.array(name), F.array(*map(F.lit, others)))))
    tried = wanted.select("path", F.explode(F.transform(names, lambda x: F.concat(folder, x))).alias("file"))
    met = tried.join(current.select(F.col("path").alias("file")), "file").groupBy("path").agg(F.min("file").alias("blocked_by"))
    return wanted.join(met, "path", "left")

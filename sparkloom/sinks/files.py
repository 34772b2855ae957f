"""Sinks: tab-separated text, guarded and compared JSON files, environment values, tables on the terminal."""

from __future__ import annotations

import json
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CSV = {"sep": "\t", "quote": '"', "escape": '"', "nullValue": "", "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
#: Any of these means that there is a configuration already.
CONFIG_FILES = ("wrangler.jsonc", "wrangler.json", "wrangler.toml")


def tsv_row(*columns: Column) -> Column:
    """One line of tab-separated values: quotes where there is a tab, quote or line break, quotes doubled, null empty."""
    def cell(c: Column) -> Column:
        text = F.coalesce(c.cast("string"), F.lit(""))
        quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(text.rlike('[\t\n\r"]'), quoted).otherwise(text)

    return F.concat_ws("\t", *map(cell, columns))


def tsv_lines(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Lines of a table; columns that the table lacks are empty, others are left out."""
    there = set(df.columns)
    return df.select(tsv_row(*(F.col(c) if c in there else F.lit(None) for c in columns)).alias("line"))


def tsv_text(df: DataFrame, columns: Sequence[str], most: int = 100_000) -> str:
    """Header and lines of a small table, for one caller; no rows give the empty string. More rows than `most` are refused:
    write_tsv() is for those."""
    lines = [r.line for r in tsv_lines(df, columns).limit(most + 1).collect()]
    if len(lines) > most:
        raise ValueError(f"more than {most} rows")
    return "\n".join(["\t".join(columns), *lines]) if lines else ""


def write_tsv(df: DataFrame, path: str) -> None:
    """A large table, as files of tab-separated values with headers."""
    df.write.options(**CSV).option("header", "true").csv(path)


def canonical(value: object) -> str:
    return json.dumps(value, indent="\t", ensure_ascii=False)


def write_new_config(directory: str, name: str, content: str, others: Sequence[str] = CONFIG_FILES) -> str:
    """Write a file, refusing where it or one of the others is there already."""
    folder = Path(directory)
    if found := [x for x in {name, *others} if (folder / x).exists()]:
        raise FileExistsError(f"configuration exists: {sorted(found)[0]}")
    (folder / name).write_text(content, encoding="utf-8")
    return str(folder / name)


def write_if_changed(path: str, value: object) -> bool:
    """Write JSON unless the file holds the same in the same key order; whether it was written."""
    file = Path(path)
    if file.exists() and canonical(json.loads(file.read_text(encoding="utf-8"))) == canonical(value):
        return False
    file.write_text(canonical(value), encoding="utf-8")
    return True


def check_unchanged(path: str, value: object) -> None:
    """Raise if the file holds anything else."""
    if canonical(json.loads(Path(path).read_text(encoding="utf-8"))) != canonical(value):
        raise ValueError(f"{path} does not match its source")


def same_rows(left: DataFrame, right: DataFrame) -> bool:
    """Whether two tables hold the same rows as often."""
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def result_table(results: DataFrame) -> DataFrame:
    """(name, outcome) rows for the terminal."""
    from sparkloom.functions.text import outcome

    return results.select("name", outcome(F.col("exit_code")).alias("outcome"))


def environment_value(*columns: Column) -> Column:
    """A record as JSON for an environment variable."""
    return F.to_json(F.struct(*columns))

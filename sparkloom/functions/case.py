"""Word splitting and case conversion as Column functions.

A word boundary is where a lower-case letter or digit meets an upper-case letter, before the last of several upper-case
letters that a lower-case one follows, and every run of characters that are neither letters nor digits.
Null gives null; text without letters and digits has no words and converts to the empty string.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Splitter = Callable[[Column], Column]


def words(text: Column) -> Column:
    """Words of text, as they stand."""
    marked = F.regexp_replace(text, r"([\p{Ll}0-9])(\p{Lu})", "$1 $2")
    marked = F.regexp_replace(marked, r"(\p{Lu})(\p{Lu}\p{Ll})", "$1 $2")
    return _pieces(F.regexp_replace(marked, r"[^\p{L}0-9]+", " "))


def words_and_numbers(text: Column) -> Column:
    """Words, with numbers cut from the letters around them."""
    return _pieces(F.regexp_replace(F.array_join(words(text), " "), r"(?<=[0-9])(?=\p{Ll})|(?<=\p{L})(?=[0-9])", " "))


def _pieces(spaced: Column) -> Column:
    bare = F.trim(spaced)
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, " "))


def _capital(word: Column) -> Column:
    return F.concat(F.upper(F.left(word, F.lit(1))), F.lower(F.substring(word, 2, F.length(word))))


def _pascal(word: Column, index: Column) -> Column:
    """A number that is not the first word is marked, so that it can't run into the word before."""
    return F.when((index > 0) & word.rlike("^[0-9]"), F.concat(F.lit("_"), F.lower(word))).otherwise(_capital(word))


def _edges(text: Column, prefix: str, suffix: str) -> tuple[Column, Column, Column]:
    """Leading characters to keep, the middle, trailing characters to keep."""
    empty = F.substring(text, 1, 0)
    head = F.regexp_extract(text, f"^[{_class(prefix)}]*", 0) if prefix else empty
    rest = F.substring(text, F.length(head) + 1, F.length(text)) if prefix else text
    tail = F.regexp_extract(rest, f"[{_class(suffix)}]*$", 0) if suffix else empty
    return head, F.substring(rest, F.lit(1), F.length(rest) - F.length(tail)) if suffix else rest, tail


def _class(characters: str) -> str:
    return "".join(re.escape(c) for c in characters)


def _joined(text: Column, shape: Callable[[Column], Column], delimiter: str, split: Splitter, prefix: str, suffix: str) -> Column:
    head, middle, tail = _edges(text, prefix, suffix)
    return F.concat(head, F.array_join(shape(split(middle)), delimiter), tail)


def no_case(text: Column, delimiter: str = " ", split: Splitter = words, prefix: str = "", suffix: str = "") -> Column:
    return _joined(text, lambda w: F.transform(w, F.lower), delimiter, split, prefix, suffix)


def dot_case(text: Column, **options) -> Column:
    return no_case(text, ".", **options)


def kebab_case(text: Column, **options) -> Column:
    return no_case(text, "-", **options)


def path_case(text: Column, **options) -> Column:
    return no_case(text, "/", **options)


def snake_case(text: Column, **options) -> Column:
    return no_case(text, "_", **options)


def constant_case(text: Column, delimiter: str = "_", split: Splitter = words, prefix: str = "", suffix: str = "") -> Column:
    return _joined(text, lambda w: F.transform(w, F.upper), delimiter, split, prefix, suffix)


def capital_case(text: Column, delimiter: str = " ", split: Splitter = words, prefix: str = "", suffix: str = "") -> Column:
    return _joined(text, lambda w: F.transform(w, lambda x: _capital(x)), delimiter, split, prefix, suffix)


def train_case(text: Column, **options) -> Column:
    return capital_case(text, "-", **options)


def pascal_snake_case(text: Column, **options) -> Column:
    return capital_case(text, "_", **options)


def sentence_case(text: Column, delimiter: str = " ", split: Splitter = words, prefix: str = "", suffix: str = "") -> Column:
    return _joined(text, lambda w: F.transform(w, lambda x, i: F.when(i == 0, _capital(x)).otherwise(F.lower(x))), delimiter, split, prefix, suffix)


def pascal_case(text: Column, delimiter: str = "", merge_numbers: bool = False, split: Splitter = words, prefix: str = "", suffix: str = "") -> Column:
    shape = (lambda x, i: _capital(x)) if merge_numbers else _pascal
    return _joined(text, lambda w: F.transform(w, shape), delimiter, split, prefix, suffix)


def camel_case(text: Column, delimiter: str = "", merge_numbers: bool = False, split: Splitter = words, prefix: str = "", suffix: str = "") -> Column:
    later = (lambda x, i: _capital(x)) if merge_numbers else _pascal
    return _joined(text, lambda w: F.transform(w, lambda x, i: F.when(i == 0, F.lower(x)).otherwise(later(x, i))), delimiter, split, prefix, suffix)


#: Latin letters and what stands for them in a slug.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinoooooouuuuyyAAAAAACEEEEIIIINOOOOOOUUUUY"


def slug(text: Column) -> Column:
    """Lower case, accents dropped, `'` and `.` removed, white space as single hyphens; other signs stay."""
    plain = F.regexp_replace(F.regexp_replace(F.translate(text, ACCENTED, PLAIN), "ß", "ss"), "['.]", "")
    return F.regexp_replace(F.lower(F.regexp_replace(plain, r"^\s+|\s+$", "")), r"\s+", "-")


def singular(value: Column) -> Column:
    return F.regexp_replace(value, "s$", "")


def plural(value: Column) -> Column:
    return F.when(F.endswith(value, F.lit("s")), value).otherwise(F.concat(value, F.lit("s")))


def slug_singular(text: Column) -> Column:
    return singular(slug(text))


def slug_plural(text: Column) -> Column:
    return plural(slug(text))


def pascal_singular(text: Column) -> Column:
    return singular(pascal_case(text))


def pascal_plural(text: Column) -> Column:
    return plural(pascal_case(text))


#: Helpers by the names under which templates call them.
HELPERS: dict[str, Callable[[Column], Column]] = {"slug": slug, "slug-s": slug_singular, "slug-p": slug_plural, "pascal": pascal_case, "pascal-s": pascal_singular, "pascal-p": pascal_plural}

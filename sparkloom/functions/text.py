"""Text formatting and parsing as Column functions. Null gives null unless said otherwise."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as ECMAScript trims it: more than Spark's trim, which takes blanks only.
SPACE = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
NAME_LIMIT = 54


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def dedent(text: Column) -> Column:
    """Drop outer line feeds, the least indentation (a count of characters) of all lines with content, and white space at
    line ends; lines without content become empty."""
    bare = F.regexp_replace(text, r"^\n+|\n+\z", "")
    lines = F.split(bare, "\n", -1)
    indents = F.transform(F.filter(lines, lambda x: strip(x) != ""), lambda x: F.length(x) - F.length(F.regexp_replace(x, f"^{SPACE}+", "")))
    least = F.coalesce(F.array_min(indents), F.lit(0))
    cut = F.transform(lines, lambda x: F.when(strip(x) == "", "").otherwise(F.regexp_replace(F.substring(x, least + 1, F.length(x)), rf"{SPACE}+\z", "")))
    return F.array_join(cut, "\n")


def one_line(text: Column) -> Column:
    """Lines stripped, empty ones dropped, joined by blanks."""
    return F.array_join(F.filter(F.transform(F.split(text, "\n", -1), strip), lambda x: x != ""), " ")


def bullet_list(text: Column) -> Column:
    """`- ` before every line of the stripped text."""
    return F.array_join(F.transform(F.split(strip(text), "\n", -1), lambda x: F.concat(F.lit("- "), x)), "\n")


def quote_globs(document: Column) -> Column:
    """Put quotes around an unquoted `globs:` value with an asterisk in the front matter of a document."""
    head = F.regexp_extract(document, r"(?s)\A---\n(.*?)\n---\n", 1)
    rest = F.regexp_extract(document, r"(?s)\A---\n.*?\n---\n(.*)\z", 1)
    fixed = F.regexp_replace(head, r"""(?m)^([ \t]*globs:[ \t]*)([^"'\s][^"'\n]*\*[^"'\n]*?|\*[^"'\n]*?)[ \t]*$""", '$1"$2"')
    return F.when(document.rlike(r"(?s)\A---\n.*?\n---\n"), F.concat(F.lit("---\n"), fixed, F.lit("\n---\n"), rest)).otherwise(document)


def front_matter(document: Column) -> Column:
    """struct(found, header, body) of a document that opens with a `---` block."""
    fence = r"(?s)\A---[ \t]*\n(?:(.*?)\n)?---[ \t]*(?:\n|\z)"
    found = document.rlike(fence)
    return F.struct(
        found.alias("found"),
        F.when(found, F.regexp_extract(document, fence, 1)).otherwise("").alias("header"),
        F.when(found, F.regexp_replace(document, fence, "")).otherwise(document).alias("body"),
    )


#: A quoted scalar, whole.
_DOUBLE, _SINGLE = r'"(?:[^"\\]++|\\.)*+"', r"'(?:[^']++|'')*+'"
#: Plain scalars that are no strings: numbers (also to other bases and of sixty), moments.
_NUMBER = (
    r"\A(?:[-+]?(?:0b[01_]+|0x[0-9a-fA-F_]+|[0-9][0-9_]*(?::[0-5]?[0-9])*(?:\.[0-9_]*)?(?:[eE][-+]?[0-9]+)?|\.[0-9][0-9_]*(?:[eE][-+]?[0-9]+)?|\.(?:inf|Inf|INF))|\.(?:nan|NaN|NAN)"
    r"|[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}(?:[Tt]|[ \t]+)[0-9]{1,2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]*)?(?:[ \t]*(?:Z|[-+][0-9]{1,2}(?::[0-9]{2})?))?)\z"
)


def yaml_chunk(header: Column, key: str) -> Column:
    """What follows a top-level key of a YAML header, with the indented and empty lines after it; null without the key."""
    opening = rf"""(?dm)^(?:{key}|"{key}"|'{key}')[ \t]*:(?=[ \t\n]|\z)[ \t]*"""
    after = F.split(header, opening, 2)
    return F.when(F.size(after) > 1, F.get(F.split(F.get(after, 1), r"\n(?=[^ \t\n])", 2), 0))


def yaml_short(chunk: Column) -> Column:
    """struct(kind, value) of the commonest values, without a look at all that others may be: nothing, a word or more on one
    line, a double-quoted text without escapes. Null for any other chunk."""
    bare = F.regexp_replace(chunk, r"[ \t]*\n?\z", "")
    word = bare.isin("true", "True", "TRUE", "false", "False", "FALSE")
    pair = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    nothing = pair("null", F.lit(None).cast("string"))
    plain = F.when(word, pair("boolean", bare)).when(bare.isin("null", "Null", "NULL"), nothing).otherwise(pair("text", bare))
    return (
        F.when(bare == "", nothing)
        .when(bare.rlike(r"\A[A-Za-z][A-Za-z0-9_ ,./*-]*+\z"), plain)
        .when(bare.rlike(r'\A"[^"\\\n]*+"\z'), pair("text", F.substring(bare, F.lit(2), F.length(bare) - 2)))
    )


def yaml_block(chunk: Column) -> Column:
    """struct(found, sound, value) of a literal (`|`) or folded (`>`) block, with its indentation and chomping marks."""
    found = chunk.rlike(r"\A[|>](?:[+-]?[1-9]?|[1-9][+-])[ \t]*(?:[ \t]#[^\n]*)?(?:\n|\z)")
    chomp = F.regexp_extract(chunk, r"\A[|>][1-9]?([+-])", 1)
    least = F.coalesce(F.nullif(F.regexp_extract(chunk, r"\A[|>][+-]?([1-9])", 1), F.lit("")).try_cast("int"), F.length(F.regexp_extract(chunk, r"\n( +)[^ \n]", 1)))
    lines = F.split(chunk, "\n", -1)
    lines = F.slice(lines, 2, F.size(lines))
    sound = ~F.exists(lines, lambda x: x.rlike("[^ ]") & (F.length(F.regexp_extract(x, "^( *)", 1)) < least))
    literal = F.array_join(F.transform(lines, lambda x: F.substring(x, least + 1, F.length(x))), "\n")
    # single breaks between lines at the indentation are blanks, longer ones lose a break
    folded = F.regexp_replace(F.regexp_replace(literal, r"(?dm)^([^\s].*)\n(?=[^\s])", "$1 "), r"(?dm)^([^\s].*)\n(\n+)(?=[^\s])", "$1$2")
    content = F.regexp_replace(F.when(F.startswith(chunk, F.lit(">")), folded).otherwise(literal), r"\n+\z", "")
    end = F.when(chomp == "+", F.regexp_extract(F.concat(literal, F.lit("\n")), r"(\n+)\z", 1)).when((chomp == "-") | (content == ""), "").otherwise("\n")
    return F.struct(found.alias("found"), sound.alias("sound"), F.concat(content, end).alias("value"))


def yaml_flow(chunk: Column) -> Column:
    """A plain or quoted scalar of any number of lines as one: comments off, quotes kept, line breaks folded."""
    bare = F.regexp_replace(F.regexp_replace(chunk, r"\A#[^\n]*", ""), r"\A[ \t\n]+|[ \t\n]+\z", "")
    quoted = F.regexp_extract(bare, rf"(?s)\A({_DOUBLE}|{_SINGLE})(?:[ \t\n]+#[^\n]*)?\z", 1)
    plain = F.regexp_replace(bare, r"(?d)(?:\A|[ \t\n]+)#[^\n]*\z", "")
    one = F.when(bare.rlike("\\A[\"']") & (quoted != ""), quoted).otherwise(plain)
    one = F.regexp_replace(one, r"[ \t]*\n[ \t]*", "\n")
    one = F.when(F.startswith(bare, F.lit('"')), F.regexp_replace(one, r"(?<!\\)((?:\\\\)*)\\\n+", "$1")).otherwise(one)
    return F.regexp_replace(F.regexp_replace(one, r"(?<!\n)\n(?!\n)", " "), r"\n(\n+)", "$1")


def yaml_string(flow: Column) -> Column:
    """A scalar of yaml_flow as text: quotes and escapes undone, null for null values and for escapes that are none."""
    inner = F.regexp_replace(F.regexp_replace(F.substring(flow, 2, F.length(flow) - 2), r"(?<!\\)((?:\\\\)*)\\x([0-9A-Fa-f]{2})", r"$1\\u00$2"), r"(?<!\\)((?:\\\\)*)\\([ 0])", "$1$2")
    double = F.get(F.from_json(F.concat(F.lit('["'), inner, F.lit('"]')), "array<string>", {"allowUnquotedControlChars": "true"}), 0)
    single = F.replace(F.substring(flow, 2, F.length(flow) - 2), F.lit("''"), F.lit("'"))
    return F.when(flow.rlike(rf"(?s)\A{_DOUBLE}\z"), double).when(flow.rlike(rf"(?s)\A{_SINGLE}\z"), single).when(~flow.isin("", "~", "null", "Null", "NULL"), flow)


def yaml_kind(chunk: Column, block: Column, flow: Column) -> Column:
    """absent, null, text, boolean, other (a number, moment, list or map), unread (anchors, aliases, tags) or malformed."""
    below = chunk.rlike(r"\A(?:#[^\n]*)?\n")
    found = (
        F.when(chunk.isNull(), "absent").when(block["found"], F.when(block["sound"], "text").otherwise("malformed"))
        .when(flow.rlike("\\A[\"']"), F.when(flow.rlike(rf"(?s)\A(?:{_DOUBLE}|{_SINGLE})\z") & yaml_string(flow).isNotNull(), "text").otherwise("malformed"))
        .when(yaml_string(flow).isNull(), "null").when(flow.rlike(r"\A[&*!]"), "unread").when(flow.rlike(r"\A[\[{]"), "other")
        .when(flow.rlike(r"\A[-?](?:\s|\z)") | flow.rlike(r":(?:\s|\z)"), F.when(below, "other").otherwise("malformed"))
        .when(flow.rlike(r"\A[@`%|>,\]}]") | flow.rlike(r"\s#"), "malformed")
        .when(flow.rlike(r"\A(?:true|True|TRUE|false|False|FALSE)\z"), "boolean").when(flow.rlike(_NUMBER), "other")
    )
    return found.otherwise("text")


def strip_packages(changeset: Column) -> Column:
    """A changeset without its package block.

    The line after the second fence goes too; if nothing follows that line's fence, the text stays whole (Q6)."""
    lines = F.split(changeset, "\n", -1)
    fences = F.filter(F.transform(lines, lambda x, i: F.when(F.startswith(x, F.lit("---")), i)), lambda i: i.isNotNull())
    second = F.try_element_at(fences, F.lit(2))
    start = F.when(second.isNotNull() & (second + 1 < F.size(lines)), second + 2).otherwise(0)
    return strip(F.array_join(F.slice(lines, start + 1, F.size(lines)), "\n"))


def sanitize_name(name: Column) -> Column:
    """Lower case; other characters than a-z, 0-9 and hyphen as one hyphen, none at the ends; 54 characters at most.

    Cutting comes last, so a result may end in a hyphen (Q4). Nothing left gives the empty string; see required_name."""
    safe = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9-]", "-"), "-+", "-")
    return F.substring(F.regexp_replace(safe, "^-|-$", ""), 1, NAME_LIMIT)


def required_name(name: Column) -> Column:
    """sanitize_name, raising an error where nothing is left."""
    safe = sanitize_name(name)
    message = F.concat(F.lit('Cannot sanitize worker name "'), F.coalesce(name, F.lit("")), F.lit('" - results in empty string'))
    return F.when(F.coalesce(safe, F.lit("")) == "", F.raise_error(message)).otherwise(safe)


def default_name(manifest_name: Column, directory: Column, fallback: str = "my-worker") -> Column:
    """The first of manifest name and directory name that leaves a name, else the fallback."""
    return F.coalesce(F.nullif(sanitize_name(manifest_name), F.lit("")), F.nullif(sanitize_name(directory), F.lit("")), F.lit(fallback))


def tool_version(declared: Column, tool: str = "pnpm") -> Column:
    """X.Y.Z of `tool@X.Y.Z`, null for anything else."""
    return F.nullif(F.regexp_extract(declared, rf"^{tool}@([0-9]+\.[0-9]+\.[0-9]+)$", 1), F.lit(""))


def build_version(version: Column, commit: Column) -> Column:
    return F.concat(version, F.lit("-"), commit)


def outcome(exit_code: Column) -> Column:
    """Label of an exit code; a null code (ended by a signal) has failed."""
    return F.when(exit_code == 0, "Success!").otherwise(F.concat(F.lit("Failed with code: "), F.coalesce(exit_code.cast("string"), F.lit("null"))))


def first_truthy(*values: Column) -> Column:
    """The first value that is neither null nor empty; else the last as it is."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values[:-1]), values[-1])


#: Output format -> file extension.
EXTENSIONS = {"esm": ".mjs", "cjs": ".cjs"}


def output_extension(form: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, extension in EXTENSIONS.items():
        out = F.when(form == name, extension).otherwise(out)
    return out


def with_extension(file: Column, extension: Column) -> Column:
    """file with its final `.js` replaced."""
    return F.when(F.endswith(file, F.lit(".js")), F.concat(F.regexp_replace(file, r"\.js$", ""), extension)).otherwise(file)


def glob_regex(glob: str) -> str:
    """A regular expression for paths that end in what a glob says: `**/` is any folders, `*` and `?` stay within a part,
    `{a,b}` is either."""
    tokens = {"**/": "(?:[^/]+/)*", "**": ".*", "*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")", ",": "|"}
    depth, out, at = 0, "", 0
    while at < len(glob):
        token = next((t for t in ("**/", "**", "*", "?", "{", "}", ",") if glob.startswith(t, at)), "")
        depth += {"{": 1, "}": -1}.get(token, 0)
        plain = not token or token == "," and not depth
        out += (re.escape(glob[at]) if plain else tokens[token])
        at += 1 if plain else len(token)
    return f"(?:^|/){out}$"


def path_matches(path: Column, globs: Sequence[str]) -> Column:
    """Whether a path ends in one of the globs, and in none of those that start with `!`."""
    wanted = [glob_regex(g) for g in globs if not g.startswith("!")]
    unwanted = [glob_regex(g[1:]) for g in globs if g.startswith("!")]
    some = path.rlike("|".join(f"(?:{g})" for g in wanted)) if wanted else F.lit(False)
    return some & ~path.rlike("|".join(f"(?:{g})" for g in unwanted)) if unwanted else some


#: Languages in which i keeps its dot and the dotless one is a letter of its own.
DOTTED = ("tr", "az")


def lower_in(value: Column, language: str = "") -> Column:
    """Lower case by a language's rules."""
    return F.lower(F.translate(F.replace(value, F.lit("İ"), F.lit("i")), "I", "ı")) if language in DOTTED else F.lower(value)


def upper_in(value: Column, language: str = "") -> Column:
    """Upper case by a language's rules."""
    return F.upper(F.translate(value, "i", "İ")) if language in DOTTED else F.upper(value)

"""Scalar functions on names and texts, as column expressions where built-in functions suffice."""

from __future__ import annotations

import textwrap

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


def file_type(name: Column) -> Column:
    """1 C, 2 Kconfig, 3 Rust, 4 assembly, by the end of the name; null for others (0 is a directory)."""
    return (
        F.when(name.endswith(".c") | name.endswith(".h"), 1).when(name.endswith(".S") | name.endswith(".s"), 4)
        .when(name.endswith("Kconfig"), 2).when(name.endswith(".rs"), 3).cast("smallint")
    )


def normalize_ws(text: Column) -> Column:
    """Runs of space, tab and line ends become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, "[ \\t\\r\\n\\f\\u000b]+", " "))


def strip_slashes(path: Column) -> Column:
    return F.regexp_replace(path, "^/+|/+$", "")


def safe_decode(data: Column) -> Column:
    """Bytes as UTF-8 if they are valid, else as Latin-1."""
    return F.when(F.is_valid_utf8(data.cast("string")), F.decode(data, "UTF-8")).otherwise(F.decode(data, "ISO-8859-1"))


def json_or_text(text: Column, path: str) -> Column:
    """The value at a path of a JSON text; the text itself if it is no JSON."""
    return F.when(F.get_json_object(text, "$").isNull(), text).otherwise(F.get_json_object(text, path))


def relative_path(path: Column, root: str) -> Column:
    """The path without the work folder it starts with; other paths as they are."""
    p = root.rstrip("/") + "/"
    return F.when(path.startswith(p), F.substring(path, F.lit(len(p) + 1), F.length(path))).otherwise(path)


def truncated(text: Column, n: int = 255) -> Column:
    return F.substring(text, 1, n)


def joined_lines(text: Column) -> Column:
    """Lines that end with a backslash go on in the next."""
    return F.regexp_replace(text, "\\\\(\r\n|\n|\r)", "")


def ifdef_names(text: Column) -> Column:
    """The names after ``#ifdef`` at the start of a line, in order."""
    return F.regexp_extract_all(text, F.lit("(?m)^#ifdef[ \\t]+([A-Za-z_][A-Za-z_0-9]*)"), 1)


def include_path(target: Column, file: Column) -> Column:
    """Path of an include: ``"x"`` beside the file, ``<x>`` under include; ``.`` and ``..`` folded."""
    name = F.substring(target, F.lit(2), F.length(target) - 2)
    folder = F.when(file.contains("/"), F.regexp_replace(file, "[^/]*$", "")).otherwise(F.lit(""))
    raw = F.when(target.startswith("<"), F.concat(F.lit("include/"), name)).otherwise(F.concat(folder, name))
    return fold_path(raw)


def fold_path(path: Column) -> Column:
    """``a/./b/../c`` becomes ``a/c``; a ``..`` with nothing above it stays."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    nothing = F.array().cast("array<string>")

    def step(acc: Column, x: Column) -> Column:
        up = (x == "..") & (F.size(acc) > 0) & (F.coalesce(F.element_at(acc, -1), F.lit("")) != "..")
        return F.when(up, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))

    return F.array_join(F.aggregate(parts, nothing, step), "/")


#: Bits of type qualifiers and the node types they stand for.
QUALIFIERS = ((1, "const", 16), (2, "volatile", 17), (4, "restrict", 18), (8, "_Atomic", 19))


def qualifiers(flags: Column) -> Column:
    """Node types of the qualifier bits that are set, in order."""
    return F.filter(F.array(*(F.when(flags.bitwiseAND(F.lit(b)) != 0, F.lit(t)) for b, _, t in QUALIFIERS)), lambda x: x.isNotNull())


def declared_type(type_id: Column, form: int) -> Column:
    """Node type of a declaration (``form`` 1) or of an unbound use (2) of a function, struct, enum or union.

    Those of other types are theirs plus ``form`` too.
    """
    return (type_id + form).cast("int")


#: A piece of C text: a comment that is closed, a literal that is closed (with its escapes), a run of other text, or one
#: character that opens nothing. The loops are possessive, so they take no stack however long a literal is.
_PIECE = r"""(?s)/(?:/[^\n]*+|\*.*?\*/)|(["'])(?:(?!\1)[^\\]|\\.)*+\1|[^/"']++|."""


def comment_free(text: Column) -> Column:
    """C comments removed, their line ends kept; comment signs in strings and character constants stay.

    A comment or literal that is not closed is plain text. Null stays null, an empty text stays empty.
    """
    pieces = F.regexp_extract_all(text, F.lit(_PIECE), 0)  # only comments begin with a slash and go on
    kept = F.transform(pieces, lambda x: F.when(x.startswith("/") & (F.length(x) > 1), F.regexp_replace(x, "[^\n]+", "")).otherwise(x))
    return F.array_join(kept, "")


@F.pandas_udf(ArrayType(StringType()))
def wrapped(text: pd.Series, width: pd.Series) -> pd.Series:
    """Lines of at most ``width`` characters, broken between words; longer words are not split."""
    return pd.Series([None if t is None else textwrap.wrap(t, int(w), break_long_words=False, break_on_hyphens=False) for t, w in zip(text, width, strict=True)])


def hard_wrapped(text: Column, width: int) -> Column:
    """Pieces of exactly ``width`` characters, the last shorter; line ends count as characters."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{width}}}"), 0)


def prefixed(lines: Column, prefix: str) -> Column:
    return F.transform(lines, lambda x: F.concat(F.lit(prefix), x))


def listed(items: Column) -> Column:
    """``a, b and c`` from an array."""
    n = F.size(items)
    many = F.concat(F.array_join(F.slice(items, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(" and "), F.element_at(items, -1))
    return F.when(n == 0, "").when(n == 1, items[0]).otherwise(many)


def duration(seconds: Column) -> Column:
    """Seconds from 1 on, else milliseconds, with one decimal from 10 on and two below; numbers are at least five wide, halves round up."""
    ms = seconds * 1000
    return F.when(ms >= 1000, F.format_string("%5.2fs", seconds)).when(ms >= 10, F.format_string("%5.1fms", ms)).otherwise(F.format_string("%5.2fms", ms))


def share_level(percent: Column) -> Column:
    """high from 50 %, medium from 25 %, else low."""
    return F.when(percent >= 50, "high").when(percent >= 25, "medium").otherwise("low")

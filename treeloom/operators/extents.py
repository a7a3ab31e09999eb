"""Source extents: (line_s, char_s) to (line_e, char_e), from 1, the end column exclusive. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def start(p: str = "") -> Column:
    return F.struct(F.col(f"{p}line_s").alias("line"), F.col(f"{p}char_s").alias("char"))


def end(p: str = "") -> Column:
    return F.struct(F.col(f"{p}line_e").alias("line"), F.col(f"{p}char_e").alias("char"))


def contains(outer: str, inner: str) -> Column:
    """Whether the extent with prefix ``outer`` holds that with prefix ``inner``, ends included; null if a place is null."""
    def le(a: str, ax: str, b: str, bx: str) -> Column:
        return (F.col(a) < F.col(b)) | ((F.col(a) == F.col(b)) & (F.col(ax) <= F.col(bx)))

    return le(f"{outer}line_s", f"{outer}char_s", f"{inner}line_s", f"{inner}char_s") & le(f"{inner}line_e", f"{inner}char_e", f"{outer}line_e", f"{outer}char_e")


def containing_pairs(df: DataFrame, group: str, block: int = 64) -> DataFrame:
    """(group, a_..., b_...): the extents of a group that hold another one, and the one they hold; equal rows count once.

    An inner extent starts on a line of the outer one, so both meet in the block of lines where the inner one starts: a
    group with very many extents is split by blocks, and only an extent of many lines goes to several. Extents with a
    null bound or that end before they start take no part.
    """
    cols = ("line_s", "char_s", "line_e", "char_e")
    whole = df.filter(" and ".join(f"{c} is not null" for c in (group, *cols)) + " and line_e >= line_s").select(group, *cols).distinct()
    nth = lambda c: F.floor(F.col(c) / block)
    a = whole.select(group, *(F.col(c).alias(f"a_{c}") for c in cols), F.explode(F.sequence(nth("line_s"), nth("line_e"))).alias("_block"))
    b = whole.select(group, *(F.col(c).alias(f"b_{c}") for c in cols), nth("line_s").alias("_block"))
    differ = F.struct(*(f"a_{c}" for c in cols)) != F.struct(*(f"b_{c}" for c in cols))
    return a.join(b, [group, "_block"]).filter(differ & contains("a_", "b_")).drop("_block")


def equal(a: str, b: str) -> Column:
    return start(a).eqNullSafe(start(b)) & end(a).eqNullSafe(end(b))


def hull() -> list[Column]:
    """Aggregates: the smallest start and the greatest end, compared by line, then column."""
    return [F.min(start()).alias("s"), F.max(end()).alias("e")]


def with_end(line: Column, char: Column) -> list[Column]:
    """The extent with another end; an end before the start becomes the start."""
    before = (line < F.col("line_s")) | ((line == F.col("line_s")) & (char < F.col("char_s")))
    return [F.when(before, F.col("line_s")).otherwise(line).alias("line_e"), F.when(before, F.col("char_s")).otherwise(char).alias("char_e")]


def relative_height(line_s: Column, line_e: Column) -> Column:
    """Last line of an extent that is moved to start at line 1: at least 1."""
    return F.greatest(F.lit(1), line_e - line_s + 1).cast("int")


def lines(text: Column) -> Column:
    """Lines of a text; all three kinds of line ends count."""
    return F.split(text, "\r\n|\n|\r", -1)


def slice_text(text: Column, line_s: Column, char_s: Column, line_e: Column, char_e: Column) -> Column:
    """The text of an extent; column 0 means the whole line; lines beyond the text are cut off. Lines joined by LF."""
    got = F.slice(lines(text), line_s, F.greatest(line_e - line_s + 1, F.lit(0)))
    n = F.size(got)

    def cut(x: Column, i: Column) -> Column:
        last = (i == n - 1) & (n == line_e - line_s + 1) & (char_e > 0)
        x = F.when(last, F.substring(x, F.lit(1), F.greatest(char_e - 1, F.lit(0)))).otherwise(x)
        return F.when((i == 0) & (char_s > 1), F.substring(x, char_s, F.length(x))).otherwise(x)

    return F.array_join(F.transform(got, cut), "\n")

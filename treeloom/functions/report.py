"""Small reports: shares, groups of lines, aligned columns, stage timings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treeloom.functions.text import duration, share_level


def share_of_total(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, total, pct): the sum per key and its percentage of the sum over all keys."""
    sums = df.groupBy(key).agg(F.sum(value).alias("total"))
    return sums.join(F.broadcast(sums.agg(F.sum("total").alias("_all")))).select(key, "total", (F.col("total") * 100.0 / F.col("_all")).alias("pct"))


def grouped_lines(df: DataFrame, key: str, line: str, starts: Column) -> DataFrame:
    """Rows with a group number that grows at every line where ``starts`` holds (lines before the first: group 0)."""
    w = Window.partitionBy(key).orderBy(line).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("grp", F.sum(F.when(starts, 1).otherwise(0)).over(w))


def aligned(df: DataFrame, columns: list[str], padding: int = 2) -> DataFrame:
    """Text of the columns, each padded to its greatest width plus ``padding``; nulls are empty. One row of widths is shared."""
    text = df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns))
    widths = text.agg(*(F.coalesce(F.max(F.length(c)), F.lit(0)).alias(f"_w_{c}") for c in columns))
    return text.join(F.broadcast(widths)).select(F.concat(*(F.rpad(F.col(c), F.col(f"_w_{c}") + padding, F.lit(" ")) for c in columns)).alias("line"))


def stage_report(timings: DataFrame, stages: list[str]) -> DataFrame:
    """(stage, seconds, pct, shown, level) of stage columns of a timing table (one row per file); nulls count as 0."""
    rows = timings.select(F.explode(F.array(*(F.struct(F.lit(s).alias("stage"), F.coalesce(F.col(s), F.lit(0.0)).cast("double").alias("s")) for s in stages))).alias("x")).select("x.*")
    r = share_of_total(rows, "stage", "s").withColumnRenamed("total", "seconds")
    return r.select("stage", "seconds", "pct", duration(F.col("seconds")).alias("shown"), share_level(F.col("pct")).alias("level"))


def roll_up(results: DataFrame, group: list[str], passed: str) -> DataFrame:
    """(group, all_passed, any_failed, n) of boolean results; null counts as failed."""
    ok = F.coalesce(F.col(passed), F.lit(False))
    return results.groupBy(*group).agg(F.bool_and(ok).alias("all_passed"), F.bool_or(~ok).alias("any_failed"), F.count(F.lit(1)).alias("n"))


def failures(df: DataFrame, ok: Column, what: str) -> DataFrame:
    """One row (what, n, failed): how many rows there are and how many fail a check; null counts as failed."""
    bad = F.count(F.when(~F.coalesce(ok, F.lit(False)), 1))
    return df.agg(F.count(F.lit(1)).alias("n"), bad.alias("failed")).select(F.lit(what).alias("what"), "n", "failed")

"""A source tree as a table: files of a folder, saved lists of changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.functions.text import file_type, relative_path, safe_decode


def read_tree(spark: SparkSession, root: str, vid: int) -> DataFrame:
    """(vid, path, content, content_hash, ftype) of all files under a folder, distributed by file; empty files included.

    The reader skips empty files; they are those it lists but does not give.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)

    def plain(c: str) -> Column:
        return F.regexp_replace(F.regexp_replace(c, "^[a-z0-9]+:/*", "/"), "%20", " ")

    listed = spark.createDataFrame([(f,) for f in raw.inputFiles()], "file string").select(plain("file").alias("file"))
    full = raw.select(plain("path").alias("file"), "content")
    empty = listed.join(full.select("file"), "file", "left_anti").select("file", F.lit(b"").alias("content"))
    path = relative_path(F.col("file"), "/" + root.split(":")[-1].strip("/"))
    return full.unionByName(empty).select(F.lit(vid).alias("vid"), path.alias("path"), safe_decode(F.col("content")).alias("content"), F.sha2("content", 256).alias("content_hash"), file_type(path).alias("ftype"))


def parse_changes(lines: DataFrame, column: str = "value") -> DataFrame:
    """(op, score, path, old_path) from lines ``M<TAB>path`` or ``R100<TAB>old<TAB>new``; blank lines have no row.

    The first letter is the operation; digits after it are the similarity.
    """
    p = F.split(F.col(column), "\t")
    code = p[0]
    return lines.filter(F.length(F.trim(F.col(column))) > 0).select(
        F.substring(code, 1, 1).alias("op"),
        F.when(F.length(code) > 1, F.substring(code, F.lit(2), F.length(code)).cast("int")).alias("score"),
        F.element_at(p, -1).alias("path"),
        F.when(F.size(p) > 2, p[1]).alias("old_path"),
    )


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    return parse_changes(spark.read.text(path))

"""Queries p7_ to p9_."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.llm import abuse, packing, tokenize
from treeloom.runtime import materialize
from treeloom.sources.catalog import table


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    ids = tokenize.encode(table(spark, d, "documents"), "doc_id", "text", tokenize.tokenizer_file(spark))
    return ids.select(F.col("doc").alias("doc_id"), "ids")


def p7_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Number of tokens of every document."""
    ids = tokenize.encode(table(spark, d, "documents"), "doc_id", "text", tokenize.tokenizer_file(spark), count_only=True)
    return ids.select(F.col("doc").alias("doc_id"), F.col("ids").alias("n_tokens"))


def p8_assign(spark: SparkSession, d: str) -> DataFrame:
    """The containers of every document for every capacity: (pack_id, doc_id, piece, start, len, container).

    Null pack ids and capacities that are null or not positive are no containers; without any there are no rows.
    """
    sizes = materialize(p7_sizes(spark, d).select(F.col("doc_id").alias("doc"), F.col("n_tokens").alias("n")), "sizes")
    packs = table(spark, d, "pack_capacity").select("pack_id", "capacity").filter("pack_id is not null and capacity > 0").distinct().collect()  # a fixed table
    if not packs:
        return spark.createDataFrame([], "pack_id int, doc_id long, piece int, start long, len long, container string")
    parts = [
        packing.pack(sizes, r["capacity"]).select(F.lit(r["pack_id"]).cast("int").alias("pack_id"), F.col("doc").alias("doc_id"), "piece", "start", "len", "container")
        for r in sorted(packs)
    ]
    return reduce(DataFrame.unionAll, parts)


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Per capacity: containers used, the fewest possible by volume, and the tokens left unused."""
    boxes = p8_assign(spark, d).groupBy("pack_id", "container").agg(F.sum("len").alias("used"))
    sums = boxes.groupBy("pack_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"))
    packs = table(spark, d, "pack_capacity").select("pack_id", "capacity").distinct()
    return sums.join(packs, "pack_id").select(
        "pack_id", "capacity", "containers", F.ceil(F.col("tokens") / F.col("capacity")).alias("least"), "tokens",
        (F.col("containers") * F.col("capacity") - F.col("tokens")).alias("unused"), "fullest",
    )


def _p9(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return abuse.scores(docs, *abuse.fit(docs, table(spark, d, "doc_label")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with abusive, hateful or sexual content."""
    return _p9(spark, d).filter("score > 1").select("doc_id")


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    """The score of every document; above 1 it is a case."""
    return _p9(spark, d)


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    """Documents, cases and their rate per source."""
    return _p9(spark, d).groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.sum((F.col("score") > 1).cast("long")).alias("cases"), F.avg((F.col("score") > 1).cast("double")).alias("rate")
    )


QUERIES = {f.__name__: f for f in (p7_ids, p7_sizes, p8_assign, p8_report, p9_found, p9_scores, p9_rates)}
SQL: dict[str, str] = {}

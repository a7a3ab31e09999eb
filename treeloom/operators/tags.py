"""Tags of a changed file: recycle what stayed, close what went, open what came."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treeloom.runtime import dense_ids


def numbered(df: DataFrame, group: list[str], code: str, order: list[str]) -> DataFrame:
    """Occurrence number of each text inside its group, so that repeated texts match one to one."""
    return df.withColumn("occ", F.row_number().over(Window.partitionBy(*group, code).orderBy(*order)))


def match(prior: DataFrame, nodes: DataFrame, group: list[str], code: str, prior_order: list[str], order: list[str]) -> DataFrame:
    """(group, tag_id, code, pos..., op): RECYCLE where a prior tag has the same text and occurrence, OPEN for new nodes,
    CLOSE for prior tags without a node. Null and empty texts never match: such nodes open, such tags close. They are not
    numbered, so a file with very many of them is no group.
    """
    some = F.col(code).isNotNull() & (F.col(code) != "")
    p = numbered(prior.filter(some), group, code, prior_order).select(*(F.col(g).alias(f"p_{g}") for g in group), F.col(code).alias("p_code"), F.col("occ").alias("p_occ"), "tag_id")
    n = numbered(nodes.filter(some), group, code, order)
    cond = (F.col(code) == F.col("p_code")) & (F.col("occ") == F.col("p_occ"))
    for g in group:
        cond = cond & (F.col(g) == F.col(f"p_{g}"))
    op = F.when(F.col("p_occ").isNull(), "OPEN").when(F.col("occ").isNull(), "CLOSE").otherwise("RECYCLE")
    j = n.join(p, cond, "full").select(*(F.coalesce(g, f"p_{g}").alias(g) for g in group), "tag_id", F.coalesce(code, "p_code").alias(code), *order, op.alias("op"))
    kinds = dict(nodes.dtypes) | {"tag_id": dict(prior.dtypes)["tag_id"]}
    new = nodes.filter(~F.coalesce(some, F.lit(False))).select(*group, F.lit(None).cast(kinds["tag_id"]).alias("tag_id"), code, *order, F.lit("OPEN").alias("op"))
    gone = prior.filter(~F.coalesce(some, F.lit(False))).select(*group, "tag_id", code, *(F.lit(None).cast(kinds[o]).alias(o) for o in order), F.lit("CLOSE").alias("op"))
    return j.unionByName(new).unionByName(gone)


def by_operation(changes: DataFrame, prior: DataFrame, nodes: DataFrame, file: str) -> tuple[DataFrame, DataFrame]:
    """What of prior tags and nodes each changed file needs, by its operation: (prior, nodes) for :func:`match`.

    ``changes`` has one row (file, op) per file: an added file has no prior tags (all its nodes open), a deleted one no
    nodes (all its tags close), a modified or renamed one both. Files that did not change take no part.
    """
    p = prior.join(changes.filter("op <> 'A'").select(file), file, "left_semi")
    return p, nodes.join(changes.filter("op <> 'D'").select(file), file, "left_semi")


def opened(matched: DataFrame, first_tag: int, vid: int, order: list[str]) -> DataFrame:
    """Matched nodes with their tags: recycled ones keep theirs, new ones get the next ids in ``order``; with (vid_s, vid_e) where new."""
    new = dense_ids(matched.filter("op = 'OPEN'").drop("tag_id"), order, "tag_id", first_tag).withColumn("vid_s", F.lit(vid)).withColumn("vid_e", F.lit(0))
    kept = matched.filter("op = 'RECYCLE'").withColumn("vid_s", F.lit(None).cast("int")).withColumn("vid_e", F.lit(None).cast("int"))
    return new.unionByName(kept.select(*new.columns))


def closed(tags: DataFrame, matched: DataFrame, vid: int) -> DataFrame:
    """Tags with those marked CLOSE ended at ``vid - 1`` if they are open; all others unchanged."""
    gone = matched.filter("op = 'CLOSE'").select("tag_id").distinct().withColumn("gone", F.lit(True))
    end = F.when(F.col("gone") & (F.col("vid_e") == 0), F.lit(vid - 1)).otherwise(F.col("vid_e")).cast("int")
    return tags.join(gone, "tag_id", "left").withColumn("vid_e", end).drop("gone").select(*tags.columns)


def prior_tags(bridge_file: DataFrame, bridge_tag: DataFrame, tag: DataFrame, vid: int) -> DataFrame:
    """The tags of every path as of a version: path id, file, tag and place (all rows, whatever their vid_e)."""
    files = bridge_file.filter((F.col("vid") == vid) & F.col("fnid").isNotNull()).select("fnid", "fid").distinct()
    places = bridge_tag.select("fid", "tag_id", "line_s", "line_e", "char_s", "char_e").distinct()
    return files.join(places, "fid").join(tag.select("tag_id", "vid_s", "vid_e", "code", "ast_id").distinct(), "tag_id")

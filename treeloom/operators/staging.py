"""Staged inserts: deduplication, ids, natural-key references, upserts, and views taken apart into rows of tables."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treeloom.operators.select import first_rule
from treeloom.runtime import dense_ids, hot_keys

#: Children of one parent from which on they are numbered in parallel.
HOT_ROWS = 1_000_000


def next_id(df: DataFrame, column: str) -> DataFrame:
    """One row: the greatest id plus 1, or 1 for an empty table."""
    return df.agg((F.coalesce(F.max(column), F.lit(0)) + 1).cast("long").alias("next_id"))


def last_wins(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the last by ``order``, ties by the greatest remaining columns (nulls first). Pre-aggregates."""
    rest = [c for c in df.columns if c not in key and c not in order]
    top = F.max(F.struct(*order, *rest)).alias("_r")
    return df.groupBy(*key).agg(top).select(*key, *(F.col(f"_r.{c}").alias(c) for c in df.columns if c not in key)).select(*df.columns)


def assign_ids(df: DataFrame, key: Sequence[str], name: str, start: int) -> DataFrame:
    """Distinct rows of ``key`` with ids ``start``, ``start + 1``, ... in key order, without a single-task window."""
    return dense_ids(df.select(*key).distinct(), list(key), name, start)


def get_or_create(dim: DataFrame, wanted: DataFrame, key: str, ident: str) -> DataFrame:
    """(key, id, op): stored rows keep their id (``DONE``), missing keys get the next ones in key order (``SET``).

    Null keys are not created. ``dim`` has one row per key.
    """
    top = dim.agg(F.coalesce(F.max(ident), F.lit(0)).cast("long").alias("_top"))
    new = wanted.select(key).filter(F.col(key).isNotNull()).distinct().join(dim.select(key), key, "left_anti")
    made = dense_ids(new, [key], "_n").join(F.broadcast(top))  # one row
    return dim.select(key, F.col(ident).cast("long").alias(ident), F.lit("DONE").alias("op")).unionByName(
        made.select(key, (F.col("_top") + F.col("_n")).alias(ident), F.lit("SET").alias("op"))
    )


def upsert(base: DataFrame, updates: DataFrame, key: Sequence[str]) -> DataFrame:
    """The new full state: rows of ``updates`` replace rows of ``base`` with the same key, others are added.

    ``updates`` has one row per key (see :func:`last_wins`) and the columns of ``base``.
    """
    return base.join(updates.select(*key), list(key), "left_anti").select(*base.columns).unionByName(updates.select(*base.columns))


def patch(base: DataFrame, updates: DataFrame, key: Sequence[str], unresolved: Column | None = None) -> DataFrame:
    """The new full state where a null in an update keeps the stored value; updates of unknown keys are ignored.

    Updates for which ``unresolved`` holds (a reference that is not known yet) are skipped whole.
    """
    if unresolved is not None:
        updates = updates.filter(~F.coalesce(unresolved, F.lit(False)))
    rest = [c for c in base.columns if c not in key]
    u = updates.select(*key, *(F.col(c).alias(f"_u_{c}") for c in rest if c in updates.columns))
    return base.join(u, list(key), "left").select(*(F.coalesce(F.col(f"_u_{c}"), F.col(c)).alias(c) if f"_u_{c}" in u.columns else F.col(c) for c in base.columns))


def rank_children(df: DataFrame, parent: str, order: Sequence[str], start: int = 0, name: str = "priority") -> DataFrame:
    """Position of each row among its parent's rows, from ``start``, in a total order."""
    rank = F.row_number().over(Window.partitionBy(parent).orderBy(*order)) - 1 + start
    hot = hot_keys(df, parent, share=0.01, least=HOT_ROWS)
    if not hot:
        return df.withColumn(name, rank.cast("int"))
    # Parents with very many children (at most a hundred) are numbered over range partitions instead of in one task.
    is_hot = F.coalesce(F.col(parent).isin(*hot), F.lit(False))
    at = dense_ids(df.filter(is_hot), [parent, *order], "_at")
    first = at.groupBy(F.col(parent).alias("_first_of")).agg(F.min("_at").alias("_first"))
    at = at.join(F.broadcast(first), F.col(parent) == F.col("_first_of")).withColumn(name, (F.col("_at") - F.col("_first") + start).cast("int"))
    return df.filter(~is_hot).withColumn(name, rank.cast("int")).unionByName(at.drop("_at", "_first", "_first_of"))


def signature(children: DataFrame, parent: str, parts: Sequence[str]) -> DataFrame:
    """(parent, s1, s2, k): digest of the set of each parent's children, nulls included.

    ``parts`` hold the position of a child, so a set tells as much as a list. The digest (two independent 64-bit hashes,
    one summed and one xored, and the count) merges on the map side: a parent with very many children is never gathered.
    """
    nulls = [F.col(p).isNull() for p in parts]
    h1 = F.xxhash64(F.lit(1), *parts, *nulls).cast("decimal(20,0)")
    h2 = F.xxhash64(F.lit("2"), *reversed(parts), *nulls)
    return children.groupBy(parent).agg(F.sum(h1).alias("s1"), F.bit_xor(h2).alias("s2"), F.count(F.lit(1)).alias("k"))


def same_structure(signatures: DataFrame, parent: str) -> DataFrame:
    """(k, n, rep): parents with equal structure are one; k children, n parents, the smallest parent."""
    return signatures.groupBy("s1", "s2", "k").agg(F.count(F.lit(1)).alias("n"), F.min(parent).alias("rep")).select("k", "n", "rep")


def decompose(flat: DataFrame, group: Sequence[str], parent: dict[str, Column], child: dict[str, Column], order: Sequence[str], start: int = 1) -> tuple[DataFrame, DataFrame]:
    """Take a flat view apart: one new parent id per ``group`` that fills every open id, and ranked child rows with it."""
    ids = assign_ids(flat, group, "new_id", start)
    parents = ids.select(F.col("new_id"), *(c.alias(n) for n, c in parent.items()))
    kids = rank_children(flat.distinct().join(ids, list(group)), "new_id", order)
    return parents, kids.select("new_id", "priority", *(c.alias(n) for n, c in child.items()))


def resolve(staged: DataFrame, key: str, ids: DataFrame, id_key: str, ident: str) -> DataFrame:
    """Replace a natural key by the id it stands for; what cannot be resolved gets a null id."""
    return staged.join(ids.select(F.col(id_key).alias("_k"), ident), F.col(key) == F.col("_k"), "left").drop("_k")


def missing_parents(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Violations of a reference: child rows whose non-null, non-zero key the parent lacks."""
    there = parent.select(F.col(key).alias("_k")).filter("_k is not null").distinct()
    return child.filter(F.col(column).isNotNull() & (F.col(column) != 0)).join(there, F.col(column) == F.col("_k"), "left_anti")


def repeated_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Violations of a primary key: keys with more than one row, and how many."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def expand(children: DataFrame, parent: str, order: Sequence[str], kind: Column, rules: Sequence[tuple], otherwise: Any, start: int = 0) -> DataFrame:
    """Container rows from child rows: (parent, priority, type_id, child): the first rule that matches ``kind`` gives the type of
    the link, the place among the parent's children (from ``start``) its priority. ``children`` has a column ``child``.
    """
    typed = children.withColumn("link_type", first_rule(kind, rules, otherwise).cast("short"))
    return rank_children(typed, parent, order, start, "priority").select(parent, "priority", F.col("link_type").alias("type_id"), "child")


def resolve_all(staged: DataFrame, key: str, needs: str) -> DataFrame:
    """(key, round) of staged rows whose references lead to rows that need nothing: the round in which they can be done, from 0.

    Rows that wait for each other in a circle, or for a row above such a circle, have round null. A row that needs
    several others waits for the last of them only where they are one chain; here each key has one ``needs`` (the
    smallest counts). Rounds come from doubled pointers, not from trying again.
    """
    from treeloom.operators.hierarchy_paths import hierarchy

    h = hierarchy(staged.select(F.col(needs).alias("p"), F.col(key).alias("v"), F.lit(0).alias("rank")), "p", "v", "rank")
    return h.select(F.col("node_id").alias(key), F.when(F.col("depth") >= 0, F.col("depth")).alias("round"))

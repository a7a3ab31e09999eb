"""Selection by wildcard tuples and the predicates of the read side. All are plain column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wildcard_select(df: DataFrame, values: Sequence[Any]) -> DataFrame:
    """Rows whose columns equal ``values`` position by position; None matches anything, missing positions too.

    A null in a column never equals a value.
    """
    if len(values) > len(df.columns):
        raise ValueError("more values than columns")
    for name, value in zip(df.columns, values, strict=False):
        if value is not None:
            df = df.filter(df[name] == F.lit(value))
    return df


def select_first(df: DataFrame, values: Sequence[Any], key: Sequence[str]) -> DataFrame:
    """The first match in the order of ``key``, ties by all other columns: one row or none."""
    rest = [c for c in df.columns if c not in key]
    return wildcard_select(df, values).orderBy(*key, *rest).limit(1)


def below(path: Column, prefix: str) -> Column:
    """The path lies anywhere under the directory ``prefix`` (no wildcards in it); everything under an empty one."""
    p = prefix.strip("/")
    return path.startswith(p + "/") if p else path.isNotNull()


def tail(path: Column, prefix: str) -> Column:
    """What follows the directory ``prefix`` in a path under it."""
    p = prefix.strip("/")
    return F.substring(path, F.lit(len(p) + 2), F.length(path)) if p else path


def has_separator(path: Column) -> Column:
    return path.contains("/")


def immediate_child(path: Column, prefix: str) -> Column:
    return below(path, prefix) & ~tail(path, prefix).contains("/")


def without_zero(df: DataFrame, column: str) -> DataFrame:
    """Drop rows whose id is null or 0 (no entity)."""
    return df.filter(F.col(column).isNotNull() & (F.col(column) != 0))


def in_keys(df: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose column is among the keys, by semi join (no literal list)."""
    return df.join(keys.select(F.col(key).alias("_k")).filter("_k is not null").distinct(), F.col(column) == F.col("_k"), "left_semi")


def not_in_keys(df: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose column is not among the keys; rows with a null column stay."""
    return df.join(keys.select(F.col(key).alias("_k")).filter("_k is not null").distinct(), F.col(column) == F.col("_k"), "left_anti")


def either_endpoint(edges: DataFrame, a: str, b: str, keys: DataFrame, key: str) -> DataFrame:
    """Distinct edges with either end among the keys: a union of two semi joins instead of an OR join."""
    return in_keys(edges, a, keys, key).unionByName(in_keys(edges, b, keys, key)).distinct()


def first_rule(value: Column, rules: Sequence[tuple[Any, Any]], otherwise: Any) -> Column:
    """The result of the first rule whose scalar or set of scalars matches; ``otherwise`` if none does."""
    out: Column | None = None
    for match, result in rules:
        cond = value.isin(*match) if isinstance(match, (set, frozenset, list, tuple)) else value == F.lit(match)
        out = F.when(cond, F.lit(result)) if out is None else out.when(cond, F.lit(result))
    return F.lit(otherwise) if out is None else out.otherwise(F.lit(otherwise))


def plain_values(df: DataFrame) -> DataFrame:
    """Only integers and strings: booleans become 0 or 1, anything else its text."""
    cols = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        cols.append(c if kind in ("string", "tinyint", "smallint", "int", "bigint") else (c.cast("int") if kind == "boolean" else c.cast("string")).alias(name))
    return df.select(*cols)


def check_schema(df: DataFrame, ddl: str) -> list[str]:
    """Differences between the columns of ``df`` and a declared schema, in words; empty if there are none."""
    short = {"tinyint": "byte", "smallint": "short", "bigint": "long"}
    have = {n: short.get(t, t) for n, t in df.dtypes}
    want = dict(c.split() for c in ddl.split(","))
    return [f"{n}: {have.get(n, 'missing')} instead of {t}" for n, t in want.items() if have.get(n) != t]

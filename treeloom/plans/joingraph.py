"""Views over a graph of equi-joins, and the rewrite of long star-shaped ones.

A view names a first table and joins; every column of the result is called ``A{n}_{column}``, n counting the aliases from
1 in join order, so no names clash. A join may repeat its target under several aliases, each with its own filters.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Join:
    """``from_table.from_column = to_table.to_column``, the target ``repeat`` times."""

    from_table: str
    from_column: str
    to_table: str
    to_column: str
    repeat: int = 1


def aliases(first: str, joins: Sequence[Join]) -> Iterator[tuple[int, str, Join | None]]:
    """(alias number, table, join that brings it in) in the order of the view's columns."""
    yield 1, first, None
    n = 1
    for j in joins:
        for _ in range(j.repeat):
            n += 1
            yield n, j.to_table, j


def _renamed(df: DataFrame, n: int) -> DataFrame:
    return df.select(*(F.col(f"`{c}`").alias(f"A{n}_{c}") for c in df.columns))


def view(tables: dict[str, DataFrame], first: str, joins: Sequence[Join] = (), values: Sequence[Any] = ()) -> DataFrame:
    """All columns of all aliases side by side, inner joins, filtered by a wildcard tuple over the whole width.

    ``values`` may be shorter than the width. A join starts from the first alias of its table. Filters sit on the scans,
    so they are pushed down.
    """
    out, at, taken = None, {}, 0
    for n, name, j in aliases(first, joins):
        part = _renamed(tables[name], n)
        for c in part.columns:
            value = values[taken] if taken < len(values) else None
            taken += 1
            if value is not None:
                part = part.filter(F.col(c) == F.lit(value))
        at.setdefault(name, n)
        if j is None:
            out = part
        else:
            out = out.join(part, F.col(f"A{at[j.from_table]}_{j.from_column}") == F.col(f"A{n}_{j.to_column}"))
    if taken < len(values):
        raise ValueError("more values than columns")
    return out


def view_first(tables: dict[str, DataFrame], first: str, joins: Sequence[Join], values: Sequence[Any], key: Sequence[str]) -> DataFrame:
    """The first row of the view in the order of ``key`` (columns of alias 1), ties by all columns."""
    v = view(tables, first, joins, values)
    lead = [f"A1_{k}" for k in key]
    return v.orderBy(*lead, *(c for c in v.columns if c not in lead)).limit(1)


def containing(child: DataFrame, root: str, slices: Sequence[dict[str, Any]]) -> DataFrame:
    """Roots that have, for every slice, a child row with these values: relational division instead of a self-join each.

    One pass over the children whatever the number of slices; an empty list of slices gives every root.
    """
    if not slices:
        return child.select(root).filter(F.col(root).isNotNull()).distinct()

    def hit(s: dict[str, Any]):
        cond = F.lit(True)
        for c, v in s.items():
            cond = cond & (F.col(c) == F.lit(v))
        return F.coalesce(cond, F.lit(False))

    hits = [hit(s) for s in slices]
    wanted = hits[0]
    for h in hits[1:]:
        wanted = wanted | h
    flags = [F.max(h).alias(f"_h{i}") for i, h in enumerate(hits)]
    every = " and ".join(f"_h{i}" for i in range(len(hits)))
    return child.filter(F.col(root).isNotNull() & wanted).groupBy(root).agg(*flags).filter(every).select(root)

"""Where tables live: Parquet folders, temporary views or memory, behind one small interface."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.operators.staging import upsert
from treeloom.runtime import publish, published, remove_path
from treeloom.sources.catalog import SPECS, seed


class ParquetEngine:
    """Tables as lists of Parquet folders; what a table consists of changes by one rename of a manifest.

    An insert adds a folder, so it costs what it inserts; an update writes the new state. Steps that die before their
    rename leave the table as it was. One writer for each table at a time.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _state(self, name: str) -> tuple[int, dict]:
        """(generation, {"parts": folders, "sorted": columns or null}): 0 where there is no table."""
        n, state = published(self.spark, f"{self.root}/{name}/manifests")
        return n, state or {"parts": [], "sorted": None}

    def _publish(self, name: str, n: int, parts: list[str], order: list[str] | None) -> None:
        publish(self.spark, f"{self.root}/{name}/manifests", n, {"parts": parts, "sorted": order})

    def _write(self, name: str, df: DataFrame) -> str:
        part = f"{self.root}/{name}/data/{uuid.uuid4().hex}"
        df.select(*SPECS[name].columns).write.parquet(part)
        return part

    def exists(self, name: str) -> bool:
        return self._state(name)[0] > 0

    def missing(self, names: list[str]) -> list[str]:
        return [n for n in names if not self.exists(n)]

    def scan(self, name: str) -> DataFrame:
        return self.spark.read.schema(SPECS[name].ddl).parquet(*self._state(name)[1]["parts"])

    def replace(self, name: str, df: DataFrame, order: list[str] | None = None) -> None:
        """Write the new full state beside the old one, then make it current."""
        n, _ = self._state(name)
        self._publish(name, n + 1, [self._write(name, df)], order)

    def create(self, names: list[str]) -> None:
        """Make missing tables with their seed rows; existing ones stay."""
        for n in self.missing(names):
            self.replace(n, seed(self.spark, n))

    def drop(self, names: list[str]) -> None:
        for n in names:
            remove_path(self.spark, f"{self.root}/{n}")

    def insert(self, name: str, rows: DataFrame) -> None:
        """Add rows in a folder of their own; what is stored is not read."""
        n, state = self._state(name)
        self._publish(name, n + 1, [*state["parts"], self._write(name, rows)], None)

    def update(self, name: str, rows: DataFrame) -> None:
        self.replace(name, upsert(self.scan(name), rows.select(*SPECS[name].columns), SPECS[name].primary))

    def create_index(self, name: str, columns: list[str]) -> None:
        """Lay the table out in the order of the columns, so that their bounds in the files prune scans; again changes nothing."""
        if not self.index_exists(name, columns):
            df = self.scan(name)
            self.replace(name, df.repartitionByRange(*columns).sortWithinPartitions(*columns), columns)

    def index_exists(self, name: str, columns: list[str]) -> bool:
        return self._state(name)[1]["sorted"] == columns

    def remove_index(self, name: str, columns: list[str]) -> None:
        """Forget the order; the rows stay where they are."""
        n, state = self._state(name)
        if state["sorted"] == columns:
            self._publish(name, n + 1, state["parts"], None)

    def commit(self, staged: dict[str, DataFrame], updates: dict[str, DataFrame] | None = None, workers: int = 8) -> None:
        """Insert into several tables at once and then update them, one Spark job each."""
        def one(name: str) -> None:
            if name in staged:
                self.insert(name, staged[name])
            if updates and name in updates:
                self.update(name, updates[name])

        with ThreadPoolExecutor(max_workers=workers) as pool:
            list(pool.map(one, dict.fromkeys([*staged, *(updates or {})])))


class MemoryEngine(ParquetEngine):
    """Tables as data frames held by this object; the same interface for tests and small work."""

    def __init__(self, spark: SparkSession, root: str = "") -> None:
        super().__init__(spark, root)
        self.tables: dict[str, DataFrame] = {}
        self.orders: dict[str, list[str] | None] = {}

    def exists(self, name: str) -> bool:
        return name in self.tables

    def scan(self, name: str) -> DataFrame:
        return self.tables[name]

    def replace(self, name: str, df: DataFrame, order: list[str] | None = None) -> None:
        self.tables[name], self.orders[name] = df.select(*SPECS[name].columns), order

    def insert(self, name: str, rows: DataFrame) -> None:
        self.replace(name, self.tables[name].unionByName(rows.select(*SPECS[name].columns)))

    def index_exists(self, name: str, columns: list[str]) -> bool:
        return self.orders.get(name) == columns

    def remove_index(self, name: str, columns: list[str]) -> None:
        if self.index_exists(name, columns):
            self.orders[name] = None

    def drop(self, names: list[str]) -> None:
        for n in names:
            self.tables.pop(n, None)


ENGINES = {"parquet": ParquetEngine, "memory": MemoryEngine, "inmemory": MemoryEngine, "mock": MemoryEngine}


def get_engine(name: str = "parquet") -> type[ParquetEngine]:
    try:
        return ENGINES[name.lower()]
    except KeyError:
        raise ValueError(f"unknown engine {name!r}; there are {', '.join(sorted(ENGINES))}") from None


def debug_json(df: DataFrame, key: str) -> DataFrame:
    """(key, ast_raw): each row as JSON text, nulls left out."""
    return df.select(key, F.to_json(F.struct(*df.columns)).alias("ast_raw"))

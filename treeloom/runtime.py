"""Session helpers shared by all operators: shared-folder tables, hot-key handling, distributed dense ids.

Nothing here collects data that grows with the input. What reaches the driver is bounded by construction:
hot keys (at most ``1 / share`` of them) and one row per Spark partition (offsets of :func:`dense_ids`).
"""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    It is the one the session names in ``spark.checkpoint.dir``. Only a local session without that setting (tests)
    gets a folder of its own; on a cluster a missing setting is an error, since a machine-local folder would not
    survive the loss of an executor.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get().rstrip("/")
    if not (sc.master or "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _LOCAL_DIRS:
        folder = tempfile.mkdtemp(prefix="treeloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _LOCAL_DIRS[sc.applicationId] = f"file://{folder}"
    return _LOCAL_DIRS[sc.applicationId]


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/treeloom/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex[:12]}"


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_all(spark: SparkSession) -> None:
    """Delete everything this application wrote to the shared folder; results that were not written out are lost."""
    remove_path(spark, f"{shared_dir(spark)}/treeloom/{spark.sparkContext.applicationId}")


def published(spark: SparkSession, folder: str) -> tuple[int, dict]:
    """(generation, state) last published in a folder; (0, {}) before the first."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    n = max((int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit()), default=0) if fs.exists(p) else 0
    return n, json.loads("\n".join(r[0] for r in spark.read.text(f"{folder}/{n}").collect())) if n else {}


def publish(spark: SparkSession, folder: str, n: int, state: dict) -> None:
    """Make ``state`` generation ``n`` with one rename: readers see it whole or not at all. One writer at a time; a second
    one that wants the same generation gets an error and changes nothing.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    tmp, final = path(f"{folder}/.{uuid.uuid4().hex}.tmp"), path(f"{folder}/{n}")
    fs = tmp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(tmp, False)
    out.write(bytearray(json.dumps(state).encode()))
    out.close()
    if fs.exists(final) or not fs.rename(tmp, final):
        fs.delete(tmp, False)
        raise RuntimeError(f"generation {n} was published by another writer")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._treeloom_path = path
    return out


def forget(df: DataFrame | None) -> None:
    """Delete a table written by :func:`materialize` that no later plan reads."""
    path = getattr(df, "_treeloom_path", None)
    if path:
        remove_path(df.sparkSession, path)


def hot_keys(df: DataFrame, key: str, share: float = 0.005, least: int = 20_000, total: int | None = None) -> list:
    """Keys holding at least ``share`` of the rows and at least ``least`` rows: at most ``1 / share`` values."""
    counts = df.groupBy(key).count()
    if total is None:
        total = df.count()
    floor = max(int(total * share), least)
    if total < floor:
        return []
    return [r[0] for r in counts.filter((F.col("count") >= floor) & F.col(key).isNotNull()).select(key).collect()]


def split_join(left: DataFrame, right: DataFrame, lkey: str, rkey: str, how: str, hot: Sequence) -> DataFrame:
    """Equi-join whose right side is unique on ``rkey``; rows of hot keys meet a broadcast of those few right rows.

    ``hot`` comes from :func:`hot_keys`, so the broadcast holds at most one row per hot key. All other rows use an
    ordinary (shuffled) join. ``how`` is ``inner`` or ``left``.
    """
    cond = F.col(lkey) == F.col(rkey)
    if not hot:
        return left.join(right, cond, how)
    is_hot = F.coalesce(F.col(lkey).isin(*hot), F.lit(False))
    cold = left.filter(~is_hot).join(right, cond, how)
    few = right.filter(F.col(rkey).isin(*hot))
    return cold.unionByName(left.filter(is_hot).join(F.broadcast(few), cond, how))


def broadcast_if_small(df: DataFrame, rows: int, limit: int = 500_000) -> DataFrame:
    """Broadcast hint only for a side whose row count was measured to be within ``limit``."""
    return F.broadcast(df) if rows <= limit else df


def dense_ids(df: DataFrame, order: Sequence[str], name: str = "id", start: int = 1) -> DataFrame:
    """``start``, ``start + 1``, ... over the total order of ``order`` without a single-partition window.

    Rows are range-partitioned, numbered inside each range, and shifted by the row counts of the ranges before
    (one small row per partition). Ties in ``order`` are numbered arbitrarily, so pass a total order.
    """
    spark = df.sparkSession
    parts = materialize(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ids")
    counts = parts.groupBy("_p").count()
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_p", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_off"))
    local = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return (
        parts.withColumn("_place", local)
        .join(F.broadcast(offsets), "_p")
        .withColumn(name, (F.col("_off") + F.col("_place") + F.lit(start - 1)).cast("long"))
        .drop("_p", "_place", "_off")
    )


"""History of changing attributes: affected-chain rebuild.

The history of an entity is a chain of versions ``[vid_s, vid_e]`` (inclusive, ``vid_e`` 0: still valid). Late or
corrected updates touch a part of the entities. For those only, the raw changes (stored rows and updates) are
fetched, the whole chain is rebuilt, and it replaces the old one in one atomic step (:class:`ChainStore`).

Every step is built-in Spark SQL. Rows are pre-aggregated to one event per (entity, version) before the chain
window, so a window group is never larger than the number of versions, however hot an entity is.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from treeloom.runtime import broadcast_if_small, new_path, publish, published

KEY = ["kind", "key_id"]


def touched_keys(updates: DataFrame) -> DataFrame:
    """Entities with at least one usable update (its vid, kind and key are not null)."""
    return updates.filter("vid is not null and key_id is not null and kind is not null").select(*KEY).distinct()


def tag_rows(m_tag: DataFrame) -> DataFrame:
    """Stored rows of tags in the common form (kind, key_id, vid_s, vid_e, code, ast_id)."""
    return m_tag.select(F.lit("tag").alias("kind"), F.col("tag_id").alias("key_id"), "vid_s", "vid_e", "code", "ast_id")


def only_touched(rows: DataFrame, touched: DataFrame, n_touched: int) -> DataFrame:
    """Raw rows of touched entities only; the key set is broadcast when measured small, else shuffled (AQE splits skew)."""
    return rows.join(broadcast_if_small(touched, n_touched), KEY, "left_semi")


def file_rows(m_file: DataFrame, m_bridge_file: DataFrame, touched: DataFrame | None = None, n_touched: int = 0) -> DataFrame:
    """Stored rows of paths: the m_file rows whose fid is linked to the path, in the common form."""
    links = m_bridge_file.filter("fnid is not null and fid is not null").select(F.lit("file").alias("kind"), F.col("fnid").alias("key_id"), "fid")
    if touched is not None:
        links = only_touched(links, touched, n_touched)
    links = links.distinct()
    return (
        links.join(m_file.select("fid", "vid_s", "vid_e").distinct(), "fid")
        .select("kind", "key_id", "vid_s", "vid_e", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("ast_id"))
    )


def rebuild(stored: DataFrame, updates: DataFrame) -> DataFrame:
    """Chains of all entities in ``stored`` and ``updates``: (kind, key_id, vid_s, vid_e, code, ast_id).

    * a stored row starts at ``vid_s``; ``vid_e`` not 0 and not null ends the entity after ``vid_e`` unless a stored
      row starts at ``vid_e + 1``; a row with null ``vid_s`` is ignored; of several stored rows with one start the
      greatest (code, ast_id) counts, null lowest;
    * updates for a vid replace what stored rows say for that vid; of several the last by (arrived_at, upd_id);
      updates with null vid, kind or key are ignored; stat ``D`` ends, any other stat (null included) sets; a null
      code or ast_id keeps the value in force just before (null if the entity was not valid then);
    * kind ``tag``: adjoining versions with equal values are one; other kinds: every start begins a version.

    Empty inputs give an empty result.
    """
    rows = stored.filter("vid_s is not null")
    vals = F.struct("code", "ast_id")
    no_upd = F.lit(None).cast("struct<arrived_at:timestamp_ntz,upd_id:bigint,stat:string,code:string,ast_id:bigint>")
    points = F.array(
        F.struct(F.col("vid_s").alias("vid"), vals.alias("start")),
        F.struct((F.col("vid_e") + 1).alias("vid"), F.lit(None).cast("struct<code:string,ast_id:bigint>").alias("start")),
    )
    old = (
        rows.select(*KEY, "vid_e", F.explode(points).alias("e"))
        .filter("e.start is not null or (vid_e is not null and vid_e <> 0)")
        .select(*KEY, F.col("e.vid").alias("vid"), F.col("e.start").alias("start"), no_upd.alias("upd"))
    )
    new = updates.filter("vid is not null and key_id is not null and kind is not null").select(
        *KEY,
        "vid",
        F.lit(None).cast("struct<code:string,ast_id:bigint>").alias("start"),
        F.struct(F.col("arrived_at").cast("timestamp_ntz").alias("arrived_at"), F.col("upd_id").cast("long").alias("upd_id"), "stat", "code", F.col("ast_id").cast("long").alias("ast_id")).alias("upd"),
    )
    events = old.unionByName(new).groupBy(*KEY, "vid").agg(F.max("start").alias("start"), F.max("upd").alias("upd"))
    by_upd = F.col("upd").isNotNull()
    ends = F.when(by_upd, F.coalesce(F.col("upd.stat") == "D", F.lit(False))).otherwise(F.col("start").isNull())

    def setter(c: str):
        """A one-field struct where the event sets the value (null included), null where the value is carried on."""
        null = F.struct(F.lit(None).cast("string" if c == "code" else "long").alias("v"))
        upd = F.when(F.col(f"upd.{c}").isNotNull(), F.struct(F.col(f"upd.{c}").alias("v")))
        return F.when(F.col("ends"), null).when(by_upd, upd).otherwise(F.struct(F.col(f"start.{c}").alias("v")))

    w = Window.partitionBy(*KEY).orderBy("vid")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    events = events.withColumn("ends", ends)
    events = events.select(
        *KEY, "vid", "ends",
        F.last(setter("code"), True).over(so_far).getField("v").alias("code"),
        F.last(setter("ast_id"), True).over(so_far).getField("v").alias("ast_id"),
    )
    same = (
        (F.col("kind") == "tag")
        & ~F.col("ends")
        & ~F.coalesce(F.lag("ends").over(w), F.lit(True))
        & F.col("code").eqNullSafe(F.lag("code").over(w))
        & F.col("ast_id").eqNullSafe(F.lag("ast_id").over(w))
    )
    return (
        events.withColumn("goes_on", same)
        .filter("not goes_on")
        .withColumn("vid_e", F.coalesce(F.lead("vid").over(w) - 1, F.lit(0)).cast("int"))
        .filter("not ends")
        .select(*KEY, F.col("vid").cast("int").alias("vid_s"), "vid_e", "code", "ast_id")
    )


def affected_chains(m_tag: DataFrame, m_file: DataFrame, m_bridge_file: DataFrame, updates: DataFrame) -> DataFrame:
    """Fetch the raw changes of touched entities only and rebuild their chains."""
    touched = touched_keys(updates)
    n = touched.count()
    stored = only_touched(tag_rows(m_tag), touched, n).unionByName(file_rows(m_file, m_bridge_file, touched, n))
    return rebuild(stored, updates)


def stored_history(m_tag: DataFrame, m_file: DataFrame, m_bridge_file: DataFrame) -> DataFrame:
    """The history before any update: the chains of all stored entities but tag 0, which is none."""
    stored = tag_rows(m_tag).filter("key_id <> 0").unionByName(file_rows(m_file, m_bridge_file))
    no_updates = m_tag.sparkSession.createDataFrame([], "upd_id long, kind string, key_id long, vid int, stat string, code string, ast_id long, arrived_at timestamp")
    return rebuild(stored, no_updates)


class ChainStore:
    """A history on shared storage, in hash buckets, whose touched chains are replaced atomically.

    A manifest names the folders of each bucket. :meth:`replace` writes the buckets that hold touched keys anew, into a
    folder of its own, and then publishes a new manifest with one rename: a reader sees all replaced chains or none. A
    job that dies before the rename leaves the old state in force and a folder that no manifest names; the same step can
    be taken again. One writer at a time; a second one fails and changes nothing.

    Rows with a null key are in a bucket like all others. A key is never split over buckets, so ``buckets`` should grow
    with the data (``files`` more tasks write each bucket).
    """

    def __init__(self, spark: SparkSession, root: str | None = None, buckets: int = 64, files: int = 1) -> None:
        self.spark, self.root, self.buckets, self.files = spark, (root or new_path(spark, "chains")), buckets, files

    def _manifest(self) -> tuple[int, dict]:
        return published(self.spark, f"{self.root}/manifests")

    def _publish(self, n: int, manifest: dict) -> None:
        publish(self.spark, f"{self.root}/manifests", n, manifest)

    def _bucket(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(*KEY), F.lit(self.buckets)).cast("int"))

    def _write(self, rows: DataFrame) -> str:
        data = f"{self.root}/data/{uuid.uuid4().hex}"
        self._bucket(rows).repartition("bucket", F.pmod(F.xxhash64("key_id", F.lit(1)), F.lit(self.files))).write.partitionBy("bucket").parquet(data)
        return data

    def write(self, history: DataFrame) -> None:
        """Make ``history`` the whole state."""
        n, _ = self._manifest()
        data = self._write(history)
        self._publish(n + 1, {str(b): f"{data}/bucket={b}" for b in range(self.buckets)} | {"schema": history.schema.json()})

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The current state, or some buckets of it."""
        _, m = self._manifest()
        schema = StructType.fromJson(json.loads(m["schema"]))
        wanted = [m[str(b)] for b in (range(self.buckets) if buckets is None else buckets) if str(b) in m]
        paths = [p for p in dict.fromkeys(wanted) if self._exists(p)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _exists(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def replace(self, touched: DataFrame, chains: DataFrame) -> None:
        """Put ``chains`` in place of all versions of the ``touched`` entities. The store may be empty before."""
        n, m = self._manifest()
        hit = sorted(r[0] for r in self._bucket(touched.select(*KEY)).select("bucket").distinct().collect())  # at most `buckets` values
        if not hit and n:
            return
        if n:
            chains = self.read(hit).join(touched.select(*KEY).distinct(), KEY, "left_anti").unionByName(chains)
        data = self._write(chains)
        self._publish(n + 1, m | {str(b): f"{data}/bucket={b}" for b in hit} | {"schema": chains.schema.json()})

"""Version after version: snapshots that arrive in a folder are applied one by one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from treeloom.operators.versions import apply_version
from treeloom.runtime import new_path, publish, published

FILES = "fid long, path string, content string, vid_s int, vid_e int, ftype smallint, s_stat string, e_stat string"
BRIDGE = "vid int, path string, fid long"
MOVED = "s_fid long, e_fid long"
SNAPSHOT = "vid int, path string, content string, ftype smallint"


class VersionedTree:
    """The three tables of a tree, kept in the shared folder; :meth:`add` applies the next snapshot.

    A version that was applied already is skipped, so a batch that is delivered again changes nothing. With a ``root``
    (beside the checkpoint of the stream) the state outlives the driver: it is published after each version, and an
    object made anew over the same root goes on from there.
    """

    def __init__(self, spark: SparkSession, root: str | None = None) -> None:
        self.spark, self.root = spark, root
        self.generation, state = published(spark, f"{root}/state") if root else (0, {})
        schemas = {"files": FILES, "bridge": BRIDGE, "moved": MOVED}
        self.files, self.bridge, self.moved = (spark.read.schema(s).parquet(state[n]) if state else spark.createDataFrame([], s) for n, s in schemas.items())
        self.last = state.get("last", 0)

    def _keep(self, df: DataFrame, name: str) -> tuple[DataFrame, str]:
        path = f"{self.root}/data/{name}-{uuid.uuid4().hex}" if self.root else new_path(self.spark, name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def add(self, snapshot: DataFrame, vid: int) -> None:
        if vid <= self.last:
            return
        top = self.files.agg(F.coalesce(F.max("fid"), F.lit(0))).first()[0]
        files, bridge, moved = apply_version(self.files, self.bridge, snapshot.select("path", "content", "ftype"), vid, top + 1)
        kept = {n: self._keep(df, n) for n, df in (("files", files), ("bridge", bridge), ("moved", self.moved.unionByName(moved)))}
        if self.root:
            publish(self.spark, f"{self.root}/state", self.generation + 1, {n: path for n, (_, path) in kept.items()} | {"last": vid})
            self.generation += 1
        self.files, self.bridge, self.moved, self.last = kept["files"][0], kept["bridge"][0], kept["moved"][0], vid

    def batch(self, df: DataFrame, _batch_id: int) -> None:
        """One micro-batch: its versions in order (there are few versions in a batch)."""
        for (vid,) in sorted(df.select("vid").filter("vid is not null").distinct().collect()):
            self.add(df.filter(F.col("vid") == vid), vid)

    def follow(self, folder: str, checkpoint: str) -> StreamingQuery:
        """Apply every snapshot file of a folder, one file per batch, and stop when all are done."""
        stream = self.spark.readStream.schema(SNAPSHOT).option("maxFilesPerTrigger", 1).parquet(folder)
        return stream.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

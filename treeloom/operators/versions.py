"""From one snapshot of a tree to the next: classification, renames, validity intervals, directories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treeloom.runtime import dense_ids, materialize


def classify(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """(key, op): A added, D deleted, M other content, = unchanged. Each side has one row per key; null contents are equal."""
    o = old.select(F.col(key).alias("ok"), F.col(content).alias("oc"))
    n = new.select(F.col(key).alias("nk"), F.col(content).alias("nc"))
    op = F.when(F.col("ok").isNull(), "A").when(F.col("nk").isNull(), "D").when(~F.col("oc").eqNullSafe(F.col("nc")), "M").otherwise("=")
    return o.join(n, F.col("ok") == F.col("nk"), "full").select(F.coalesce("nk", "ok").alias(key), op.alias("op"))


def renames(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """(old_key, new_key): added keys whose content a deleted key had. Of several deleted ones the smallest counts."""
    o, n = old.select(key, content), new.select(key, content)
    gone = o.join(n.select(key), key, "left_anti").groupBy(content).agg(F.min(key).alias("old_key"))
    come = n.join(o.select(key), key, "left_anti").select(F.col(key).alias("new_key"), content)
    return come.join(gone, content).select("old_key", "new_key")


def close_open(active: DataFrame, new: DataFrame, key: str, content: str, vid: int) -> DataFrame:
    """Validity rows after version ``vid``: (key, vid_s, vid_e, s_stat, e_stat).

    ``active`` are the open rows (key, content, vid_s, vid_e, s_stat, e_stat). A changed or deleted key is closed at
    ``vid - 1`` with M or D; a changed or added one opens at ``vid``; an unchanged one stays as it is.
    """
    n = new.select(F.col(key).alias("nk"), F.col(content).alias("nc"))
    changed = ~F.col(content).eqNullSafe(F.col("nc"))
    joined = active.join(n, F.col(key) == F.col("nk"), "left")
    gone = F.col("nk").isNull()
    kept = joined.select(
        key, "vid_s",
        F.when(gone | changed, F.lit(vid - 1)).otherwise(F.col("vid_e")).cast("int").alias("vid_e"), "s_stat",
        F.when(gone, "D").when(changed, "M").otherwise(F.col("e_stat")).alias("e_stat"),
    )
    a = active.select(F.col(key).alias("ak"), F.col(content).alias("ac"))
    opened = new.select(key, content).join(a, F.col(key) == F.col("ak"), "left").filter(F.col("ak").isNull() | ~F.col(content).eqNullSafe(F.col("ac")))
    return kept.unionByName(opened.select(key, F.lit(vid).cast("int").alias("vid_s"), F.lit(0).cast("int").alias("vid_e"), F.when(F.col("ak").isNull(), "A").otherwise("M").alias("s_stat"), F.lit("0").alias("e_stat")))


def unchanged(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """Keys with the same content on both sides (null contents are equal)."""
    n = new.select(F.col(key).alias("nk"), F.col(content).alias("nc"))
    return old.join(n, (F.col(key) == F.col("nk")) & F.col(content).eqNullSafe(F.col("nc"))).select(key)


def forgotten(a: DataFrame, b: DataFrame, reported: DataFrame, key: str) -> DataFrame:
    """Keys of ``a`` that neither ``b`` nor the reported changes hold: forgotten deletes (old, new) or news (new, old)."""
    return a.select(key).distinct().join(b.select(key), key, "left_anti").join(reported.select(key), key, "left_anti")


def valid_at(df: DataFrame, vid: int | Column) -> DataFrame:
    """Rows valid at a version: ends are inclusive, end 0 is open; a null bound is never valid."""
    v = F.lit(vid) if isinstance(vid, int) else vid
    return df.filter((F.col("vid_s") <= v) & ((F.col("vid_e") == 0) | (F.col("vid_e") >= v)))


def ancestors(paths: DataFrame, path: str) -> DataFrame:
    """(dir): every directory above a path, each once. The root has no row."""
    parts = F.split(F.col(path), "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return paths.filter(F.col(path).contains("/")).select(F.explode(ups).alias("dir")).distinct()


def directory_changes(old: DataFrame, new: DataFrame, path: str) -> DataFrame:
    """(dir, op) of the directories of two snapshots: ``=`` kept, A new, D deleted."""
    o, n = ancestors(old, path).withColumn("o", F.lit(1)), ancestors(new, path).withColumn("n", F.lit(1))
    op = F.when(F.col("o").isNull(), "A").when(F.col("n").isNull(), "D").otherwise("=")
    return o.join(n, "dir", "full").select("dir", op.alias("op"))


def register(v_main: DataFrame, name: str) -> DataFrame:
    """One row (vid, old_vid, vname, known): the version of a name, or the next one for a new name; old_vid is the one before.

    A known version is its own old one. Of several rows with the name the lowest vid counts.
    """
    found = v_main.agg(F.min(F.when(F.col("vname") == name, F.col("vid"))).alias("there"), F.coalesce(F.max("vid"), F.lit(0)).alias("top"))
    known = F.col("there").isNotNull()
    return found.select(F.coalesce("there", F.col("top") + 1).cast("int").alias("vid"), F.coalesce("there", "top").cast("int").alias("old_vid"), F.lit(name).alias("vname"), known.alias("known"))


def presence(snapshots: DataFrame, steps: DataFrame, key: str) -> DataFrame:
    """(key, vid_s, vid_e) of the runs of consecutive snapshots that hold a key; vid_e 0 if the last one does.

    ``snapshots`` (vid, key) may repeat rows; ``steps`` has (vid, i, nxt): each delivered vid with its number and the next
    vid, null for the last. A run ends before the next snapshot. The window of a key is as long as it has snapshots.
    """
    w = Window.partitionBy(key).orderBy("i")
    at = snapshots.select("vid", key).distinct().join(F.broadcast(steps), "vid")  # one row per version
    at = at.withColumn("run", F.col("i") - F.row_number().over(w))
    return at.groupBy(key, "run").agg(F.min("vid").alias("vid_s"), F.max(F.struct("i", "nxt")).getField("nxt").alias("nxt")).select(
        key, F.col("vid_s").cast("int").alias("vid_s"), F.coalesce(F.col("nxt") - 1, F.lit(0)).cast("int").alias("vid_e")
    )


def apply_version(files: DataFrame, bridge: DataFrame, snapshot: DataFrame, vid: int, first_fid: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One version of a tree: the new (files, bridge, moved) tables.

    files: (fid, path, content, vid_s, vid_e, ftype, s_stat, e_stat), bridge: (vid, path, fid), snapshot: (path, content,
    ftype) with one row per path. Deleted paths close with D, modified ones with M and reopen; an added path with the
    content of a deleted one is a rename (R on both ends and a moved row; a deleted path gives its content to one added
    path, by order); other added paths open with A; unchanged ones keep their fid. Ids follow the order of paths.
    """
    active = files.filter("vid_e = 0").select("fid", F.col("path").alias("opath"), F.col("content").alias("ocontent"))
    both = active.join(snapshot, F.col("opath") == F.col("path"), "full")
    op = F.when(F.col("opath").isNull(), "A").when(F.col("path").isNull(), "D").when(~F.col("ocontent").eqNullSafe(F.col("content")), "M").otherwise("=")
    both = materialize(both.withColumn("op", op), "diff")
    nth = lambda c, p: F.row_number().over(Window.partitionBy(c).orderBy(p))
    gone = both.filter("op = 'D' and ocontent is not null").select(F.col("fid").alias("s_fid"), F.col("ocontent").alias("c"), nth("ocontent", "opath").alias("i"))
    come = both.filter("op = 'A' and content is not null").select(F.col("path").alias("npath"), F.col("content").alias("c"), nth("content", "path").alias("i"))
    pairs = materialize(gone.join(come, ["c", "i"]).select("s_fid", "npath"), "renames")
    new = both.filter("op in ('A', 'M')").join(pairs, F.col("path") == F.col("npath"), "left")
    stat = F.when(F.col("npath").isNotNull(), "R").otherwise(F.col("op"))
    new = materialize(dense_ids(new.select("path", "content", "ftype", stat.alias("s_stat")), ["path"], "fid", first_fid), "new")
    opened = new.select("fid", "path", "content", F.lit(vid).cast("int").alias("vid_s"), F.lit(0).cast("int").alias("vid_e"), "ftype", "s_stat", F.lit("0").alias("e_stat"))
    ends = both.filter("op in ('D', 'M')").join(pairs.select("s_fid"), F.col("fid") == F.col("s_fid"), "left").select(F.col("fid").alias("efid"), F.when(F.col("s_fid").isNotNull(), "R").otherwise(F.col("op")).alias("end"))
    closed = files.join(ends, F.col("fid") == F.col("efid"), "left").select(
        "fid", "path", "content", "vid_s", F.when(F.col("end").isNotNull(), F.lit(vid - 1)).otherwise(F.col("vid_e")).cast("int").alias("vid_e"), "ftype", "s_stat", F.coalesce("end", "e_stat").alias("e_stat")
    )
    kept = both.filter("op = '='").select(F.lit(vid).cast("int").alias("vid"), "path", "fid")
    links = bridge.unionByName(kept).unionByName(new.select(F.lit(vid).cast("int").alias("vid"), "path", "fid"))
    moved = pairs.join(new.select(F.col("path").alias("npath"), F.col("fid").alias("e_fid")), "npath").select("s_fid", "e_fid")
    return closed.unionByName(opened), links, moved

"""A file tree as a table, with an overlay of changes over it.

nodes(path, kind, size): kind is file or dir, the root's path is "".
overlay(path, op, size): op is put, mkdir or whiteout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.operators.lineage import running_sums


def parent(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def nodes(files: DataFrame) -> DataFrame:
    """All files (path, size), and the folders that their paths imply; a path that is a file and a folder is the folder."""
    parts = files.select(F.split("path", "/").alias("p"))
    dirs = parts.select(F.explode(F.transform(F.sequence(F.lit(0), F.size("p") - 1), lambda i: F.array_join(F.slice("p", 1, i), "/"))).alias("path")).distinct()
    dirs = dirs.withColumn("kind", F.lit("dir")).withColumn("size", F.lit(4096).cast("long"))
    plain = files.groupBy("path").agg(F.max("size").cast("long").alias("size")).join(dirs.select("path"), "path", "left_anti")
    return dirs.unionByName(plain.withColumn("kind", F.lit("file")).select("path", "kind", "size"))


def attributes(tree: DataFrame) -> DataFrame:
    """parent, name, mode and number of 512-byte blocks of each node."""
    return tree.select("path", "kind", "size", parent(F.col("path")).alias("parent"), F.element_at(F.split("path", "/"), -1).alias("name"), F.when(F.col("kind") == "dir", 0o755).otherwise(0o644).alias("mode"), F.ceil(F.col("size") / 512).alias("blocks"))


def inodes(tree: DataFrame) -> DataFrame:
    """Nodes with inode (1 for the root, from 2 on in order of path) and parent_inode (null for the root)."""
    numbered = running_sums(tree, ["path"], {"_before": F.lit(1)}).withColumn("inode", F.col("_before") + 1).drop("_before")
    above = numbered.where("kind = 'dir'").select(F.col("path").alias("_up"), F.col("inode").alias("parent_inode"))
    up = F.when(F.col("path") != "", parent(F.col("path")))
    return numbered.join(above, up == F.col("_up"), "left").drop("_up")


def file_info(files: DataFrame) -> DataFrame:
    """path, stream, offset, size, mode and mtime of the manifest's files of stream main."""
    return files.where("stream = 'main'").select("path", "stream", "offset", "size", "mode", "mtime")


def lookup(tree: DataFrame, path: str) -> DataFrame:
    return tree.where(F.col("path") == path)


def children(tree: DataFrame) -> DataFrame:
    """parent, and its children's names in byte order as an array."""
    named = attributes(tree).where("path <> ''")
    return named.groupBy("parent").agg(F.sort_array(F.collect_list("name")).alias("names"))


def readdir(tree: DataFrame, path: str, skip: int = 0, count: int | None = None) -> DataFrame:
    """Entries of a folder in order, `.` and `..` first."""
    spark = tree.sparkSession
    dots = spark.createDataFrame([(0, "."), (0, "..")], "rank int, name string")
    own = attributes(tree).where((F.col("parent") == path) & (F.col("path") != "")).select(F.lit(1).alias("rank"), "name")
    out = dots.union(own).orderBy("rank", "name").select("name").offset(skip)
    return out if count is None else out.limit(count)


def rename(tree: DataFrame, old: str, new: str) -> DataFrame:
    """The tree with a path, and all below it, under another name."""
    below = F.col("path").startswith(old + "/") | (F.col("path") == old)
    return tree.withColumn("path", F.when(below, F.concat(F.lit(new), F.substr(F.col("path"), F.lit(len(old) + 1)))).otherwise(F.col("path")))


def remove(tree: DataFrame, path: str) -> DataFrame:
    return tree.where(~(F.col("path").startswith(path + "/") | (F.col("path") == path)))


def latest(events: DataFrame) -> DataFrame:
    """The overlay after a log of events (seq, path, op, size): the last one of each path."""
    return events.groupBy("path").agg(F.max_by(F.struct("op", "size"), "seq").alias("x")).select("path", "x.op", "x.size")


def merged(tree: DataFrame, overlay: DataFrame) -> DataFrame:
    """What a reader sees: files of the overlay before those of the base; whiteouts hide a base path and all below it."""
    gone = overlay.where("op = 'whiteout'").select(F.col("path").alias("hidden"))
    put = overlay.where("op <> 'whiteout'").select("path", F.when(F.col("op") == "mkdir", "dir").otherwise("file").alias("kind"), "size")
    # Each base path is held against the whiteouts of itself and of the folders above it by equality.
    ups = tree.select("path", "kind", "size", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda i: F.array_join(F.slice(F.split("path", "/"), 1, i), "/"))).alias("up"))
    covered = ups.join(gone, F.col("up") == F.col("hidden"), "left_semi").select("path").distinct()
    base = tree.join(covered, "path", "left_anti").join(put.select("path"), "path", "left_anti")
    return base.unionByName(put)


def status(tree: DataFrame, overlay: DataFrame) -> DataFrame:
    """path and state (added, modified, deleted) of what the overlay changes."""
    joined = overlay.join(tree.select("path", F.col("kind").alias("was")), "path", "left")
    state = F.when(F.col("op") == "whiteout", F.when(F.col("was").isNotNull(), "deleted")).when(F.col("was").isNull(), "added").when(F.col("was") == "file", "modified")
    return joined.select("path", state.alias("state")).where("state is not null")

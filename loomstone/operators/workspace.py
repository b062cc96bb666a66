"""Work on an archive: a log of changes over its files, what a reader sees through it, and commits.

events(seq, path, op, content, at, size, mode, mtime, target). op is one of
put (the file's whole content), write (content at a place), truncate (to size), link (the
content of the archive's file `target`), mkdir, symlink (to `target`), chmod and whiteout.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.functions import codecs
from loomstone.operators import archive as A
from loomstone.operators.catalog import Catalog, Files
from loomstone.operators.lineage import cut

EVENTS = "seq long, path string, op string, content binary, at long, size long, mode int, mtime long, target string"
#: The state of each changed path. op: put, link, mkdir, symlink or whiteout.
OVERLAY = "path string, op string, content binary, size long, mode int, mtime long, target string"
NEW_FILE, NEW_DIR = 0o644, 0o755


def fold(events: Iterable[dict]) -> dict | None:
    """The state of one path after its events, which are in order; writes to a path that has no content of its own begin with none."""
    state = None
    for e in events:
        op = e["op"]
        if op in ("put", "link", "mkdir", "symlink", "whiteout"):
            mode = e["mode"] if e["mode"] is not None else NEW_DIR if op == "mkdir" else NEW_FILE
            state = {**e, "mode": mode, "content": (e["content"] or b"") if op == "put" else None}
            continue
        if state is None or state["op"] == "whiteout":
            state = {**e, "op": "put", "content": b"", "mode": NEW_FILE}
        if op == "chmod":
            state["mode"] = e["mode"]
        elif op in ("write", "truncate") and state["op"] == "put":
            held = state["content"]
            if op == "truncate":
                held = held[: e["size"]].ljust(e["size"], b"\0")
            else:
                data, at = e["content"] or b"", e["at"] or 0
                held = held[:at].ljust(at, b"\0") + data + held[at + len(data) :]
            state["content"] = held
        elif op in ("write", "truncate"):
            raise ValueError(f"{e['path']} is no file that can be written to")
        else:
            raise ValueError(f"unknown change {op}")
        state["mtime"] = e["mtime"]
    if state and state["op"] == "put":
        state["size"] = len(state["content"])
    return state


def overlay(events: DataFrame) -> DataFrame:
    """The state of each path that a log changes. The changes of a path are one task's, where they are taken one after the other; paths follow each other in one stream of rows."""
    codecs.small_batches(events.sparkSession)
    kinds = pa.schema([("path", pa.string()), ("op", pa.string()), ("content", pa.binary()), ("size", pa.int64()), ("mode", pa.int32()), ("mtime", pa.int64()), ("target", pa.string())])

    def run(batches):
        states, held = [], 0
        rows = (row for batch in batches for row in batch.to_pylist())
        for _, changes in groupby(rows, key=lambda e: e["path"]):
            state = fold(changes)
            states.append({c: state[c] for c in kinds.names})
            held += len(state["content"] or b"")
            if len(states) >= 4096 or held >= codecs.BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(states, schema=kinds)
                states, held = [], 0
        yield pa.RecordBatch.from_pylist(states, schema=kinds)

    return events.repartition("path").sortWithinPartitions("path", "seq").mapInArrow(run, OVERLAY)


def hidden(files: DataFrame, over: DataFrame) -> DataFrame:
    """path of the archive's files that an overlay hides or replaces: whiteouts hide a path and all below it."""
    gone = over.where("op = 'whiteout'").select(F.col("path").alias("up"))
    ups = files.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda i: F.array_join(F.slice(F.split("path", "/"), 1, i), "/"))).alias("up"))
    covered = ups.join(gone, "up", "left_semi").select("path")
    return covered.union(files.select("path").join(over.where("op <> 'whiteout'"), "path", "left_semi")).distinct()


def view(files: DataFrame, over: DataFrame) -> DataFrame:
    """The files that a reader sees: path, stream, size, mode, mtime, content (of those put) and base_path (of those whose content is the archive's)."""
    nothing = F.lit(None).cast("binary").alias("content")
    base = files.join(hidden(files, over), "path", "left_anti").select("path", "stream", "size", "mode", "mtime", nothing, F.col("path").alias("base_path"))
    put = over.where("op = 'put'").select("path", F.lit("main").alias("stream"), "size", "mode", "mtime", "content", F.lit(None).cast("string").alias("base_path"))
    links = over.where("op = 'link'").select("path", "mode", "mtime", F.col("target").alias("base_path"))
    linked = links.join(files.select(F.col("path").alias("base_path"), "stream", "size"), "base_path").select("path", "stream", "size", "mode", "mtime", nothing, "base_path")
    return base.unionByName(put).unionByName(linked)


def read(archive: A.Archive, over: DataFrame, requests: DataFrame) -> DataFrame:
    """request_id and bytes of requests (request_id, path, first, n): of the overlay's content where it has one, else of the archive's; null where a reader sees no file."""
    seen = view(archive.files, over).select("path", "size", "content", "base_path")
    asked = cut(requests.join(seen, "path", "left"))
    own = asked.where("base_path is null").select("request_id", F.expr("substring(content, CAST(least(first, size) + 1 AS INT), CAST(n AS INT))").alias("bytes"))
    return own.unionByName(A.read_files(archive, asked.where("base_path is not null").select("request_id", F.col("base_path").alias("path"), "first", "n")))


def lookup(archive: A.Archive, over: DataFrame, path: str) -> DataFrame:
    """What stands at a path: a whiteout hides it, the overlay comes before the archive."""
    return view(archive.files, over).where(F.col("path") == path)


def commit(archive: A.Archive, over: DataFrame, archive_id: str, **more) -> A.Archive:
    """A new version of an archive with an overlay's changes, on the old one as its parent.

    Blocks of files that stay as they are are taken over by reference: neither read nor cut again. Only
    what was put is cut, and stored so far as the old version does not know it.
    """
    if archive.config.key:
        raise ValueError("an encrypted archive has no hashes to compare with others")
    config = replace(archive.config, archive_id=archive_id, **more)
    seen = cut(view(archive.files, over))
    put = seen.where("base_path is null").select("path", "stream", "content", "mode", "mtime")
    begins = archive.files.select(F.col("path").alias("base_path"), "stream", "offset")
    kept = seen.where("base_path is not null").select("path", "base_path", "stream").join(begins, ["base_path", "stream"])
    held = archive.blocks.select(F.col("path").alias("base_path"), "stream", "seq", "logical_start", "logical_len", "kind", "hash")
    held = held.join(kept, ["base_path", "stream"]).select("path", "stream", "seq", (F.col("logical_start") - F.col("offset")).alias("start"), "logical_len", (F.col("kind") == "zero").alias("zero"), F.unhex("hash").alias("hash"))
    index = cut(A.index_of(put, config)).unionByName(held)
    blocks, files = A.assemble(index, seen.select("path", "stream", "size", "mode", "mtime"), config, A.inherited([archive]))
    blocks = cut(blocks)
    owners = _Owners(archive)
    return A.Archive(config, blocks, A.stored(put, blocks, config, True), files, owners, (archive.id,))


class _Owners(dict):
    """The archive committed on, and those that it reads from."""

    def __init__(self, archive: A.Archive):
        super().__init__({archive.id: archive})
        self.archive = archive

    def __contains__(self, archive_id) -> bool:
        return super().__contains__(archive_id) or archive_id in self.archive.owners

    def __missing__(self, archive_id):
        return self.archive.owners[archive_id]

    def items(self):
        return [*self.archive.owners.items(), (self.archive.id, self.archive)]


@dataclass
class Workspace:
    """A folder with a log of changes and a file that names the archive they are made on; remotes are folders of archives by name."""

    spark: SparkSession
    root: str
    base: str | None = None
    catalog: str | None = None
    remotes: dict[str, str] = field(default_factory=dict)

    STATE, LOG = ".loom/workspace.json", ".loom/events"

    @classmethod
    def init(cls, spark: SparkSession, root: str, catalog: str | None = None, base: str | None = None) -> Workspace:
        """A new workspace; a folder that holds anything is an error."""
        if Files(spark, root).names():
            raise FileExistsError(f"{root} is not empty")
        w = cls(spark, root.rstrip("/"), base, catalog)
        if base is not None:
            Catalog(spark, catalog).header(base)
        w.save()
        return w

    @classmethod
    def checkout(cls, catalog: Catalog, archive_id: str, root: str) -> Workspace:
        return cls.init(catalog.spark, root, catalog.root, archive_id)

    @classmethod
    def find(cls, spark: SparkSession, path: str) -> Workspace:
        """The workspace that a path lies in: its own folder's, or the nearest one's above it."""
        scheme, sep, at = path.rpartition("://")
        while at := at.rstrip("/"):
            files = Files(spark, f"{scheme}{sep}{at}")
            if files.exists(cls.STATE):
                return cls(spark, files.root, **json.loads(files.read(cls.STATE)))
            at = at.rpartition("/")[0]
        raise FileNotFoundError(f"{path} lies in no workspace")

    def save(self) -> None:
        Files(self.spark, self.root).write(self.STATE, json.dumps({"base": self.base, "catalog": self.catalog, "remotes": self.remotes}, sort_keys=True).encode(), overwrite=True)

    # --- remotes ---

    def add_remote(self, name: str, url: str) -> None:
        if name in self.remotes:
            raise ValueError(f"remote {name} is there already")
        self.remotes[name] = url
        self.save()

    def remove_remote(self, name: str) -> None:
        if name not in self.remotes:
            raise KeyError(name)
        del self.remotes[name]
        self.save()

    def push(self, remote: str, archive_id: str | None = None) -> list[str]:
        return Catalog(self.spark, self.catalog).send(Catalog(self.spark, self.remotes[remote]), [archive_id or self.base])

    def pull(self, remote: str, archive_id: str) -> list[str]:
        return Catalog(self.spark, self.remotes[remote]).send(Catalog(self.spark, self.catalog), [archive_id])

    # --- changes ---

    def archive(self) -> A.Archive:
        if self.base is None:
            raise FileNotFoundError("the workspace is on no archive")
        return Catalog(self.spark, self.catalog).open(self.base)

    def events(self) -> DataFrame:
        """The changes since the last commit; none in a new workspace."""
        if not Files(self.spark, self.root).names(self.LOG):
            return self.spark.createDataFrame([], EVENTS)
        return self.spark.read.schema(EVENTS).parquet(f"{self.root}/{self.LOG}")

    def overlay(self) -> DataFrame:
        return overlay(self.events())

    def record(self, events: DataFrame) -> None:
        """Adds changes (columns of EVENTS; those that lack are null, seq among them: then they come after all before)."""
        last = self.events().agg(F.max("seq")).first()[0] or 0
        fields = [x.split() for x in EVENTS.split(", ")]
        if "seq" not in events.columns:
            events = events.withColumn("seq", F.monotonically_increasing_id() + last + 1)
        columns = [(F.col(c) if c in events.columns else F.lit(None)).cast(t).alias(c) for c, t in fields]
        events.select(columns).write.mode("append").parquet(f"{self.root}/{self.LOG}")

    def _one(self, path: str, op: str, content=None, at=None, size=None, mode=None, target=None) -> None:
        row = [(A.safe_path(path), op, content, at, size, mode, int(time.time()), target)]
        self.record(self.spark.createDataFrame(row, "path string, op string, content binary, at long, size long, mode int, mtime long, target string"))

    def put(self, path: str, content: bytes, mode: int | None = None) -> None:
        self._one(path, "put", content, mode=mode)

    def mkdir(self, path: str) -> None:
        self._one(path, "mkdir")

    def symlink(self, path: str, target: str) -> None:
        self._one(path, "symlink", target=target)

    def chmod(self, path: str, mode: int) -> None:
        self.copy_on_write(path)
        self._one(path, "chmod", mode=mode)

    def remove(self, path: str) -> None:
        self._one(path, "whiteout")

    def copy_on_write(self, path: str) -> None:
        """Puts the archive's content of a path into the log, unless the log has one of its own."""
        if self.base is None:
            return
        found = lookup(self.archive(), self.overlay(), path).select("base_path", "size", "mode").first()
        if found and found["base_path"] is not None:
            ask = self.spark.createDataFrame([(0, found["base_path"], 0, found["size"])], "request_id int, path string, first long, n long")
            content = A.read_files(self.archive(), ask).first()["bytes"]
            self._one(path, "put", bytes(content), mode=found["mode"])

    def write(self, path: str, content: bytes, at: int = 0) -> None:
        self.copy_on_write(path)
        self._one(path, "write", content, at=at)

    def truncate(self, path: str, size: int) -> None:
        self.copy_on_write(path)
        self._one(path, "truncate", size=size)

    def rename(self, old: str, new: str) -> None:
        """Moves a path, and all below it. Contents stay where they are: the archive's are linked, the log's put anew."""
        A.safe_path(new)
        over = self.overlay()
        below = F.col("path").startswith(old + "/") | (F.col("path") == old)
        to = F.concat(F.lit(new), F.substr(F.col("path"), F.lit(len(old) + 1))).alias("path")
        files = view(self.archive().files, over) if self.base else view(self.spark.createDataFrame([], "path string, stream string, size long, mode int, mtime long"), over)
        seen = files.where(below).select(to, F.when(F.col("base_path").isNull(), "put").otherwise("link").alias("op"), "content", "size", "mode", "mtime", F.col("base_path").alias("target"))
        others = over.where(below & F.col("op").isin("mkdir", "symlink")).select(to, "op", "content", "size", "mode", "mtime", "target")
        moved = cut(seen.unionByName(others))
        if moved.isEmpty():
            raise FileNotFoundError(old)
        gone = self.events().select("path").distinct().where(below).select("path").union(self.spark.createDataFrame([(old,)], "path string")).distinct()
        self.record(cut(gone.select("path", F.lit("whiteout").alias("op"))))
        self.record(moved)

    def status(self) -> DataFrame:
        """path and state (added, modified, deleted) of the changes since the last commit."""
        over = self.overlay()
        files = self.archive().files.select("path", F.lit(True).alias("was")) if self.base else self.spark.createDataFrame([], "path string, was boolean")
        joined = over.join(files, "path", "left")
        state = F.when(F.col("op") == "whiteout", F.when(F.col("was"), "deleted")).when(F.col("was"), "modified").otherwise("added")
        # a folder that is removed takes its files with it
        below = hidden(files, over.where("op = 'whiteout'")).join(over.select("path"), "path", "left_anti").select("path", F.lit("deleted").alias("state"))
        return joined.select("path", state.alias("state")).where("state is not null").union(below)

    def commit(self, archive_id: str, **more) -> A.Archive:
        """Saves a new version with the changes, and goes on from it with an empty log."""
        catalog, over = Catalog(self.spark, self.catalog), cut(self.overlay())
        if self.base is None:
            files = over.where("op = 'put'").select("path", F.lit("main").alias("stream"), "content", "mode", "mtime")
            made = A.pack(files, A.PackConfig(archive_id=archive_id, **more))
        else:
            made = commit(self.archive(), over, archive_id, **more)
        saved = catalog.save(made)
        self.base = archive_id
        self.save()
        files = Files(self.spark, self.root)
        files.remove(self.LOG)
        return saved

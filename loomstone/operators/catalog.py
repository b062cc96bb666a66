"""Archives kept in a folder of any store that Spark writes: saving, opening, listing, signing, and copying between folders.

An archive is a folder {root}/{archive_id}: tables below tables-*/, and a file HEADER, which is
written last and never changed: an archive is there once its HEADER is.
"""

from __future__ import annotations

import base64
import json
import re
import uuid
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.functions import codecs
from loomstone.operators import analysis, archive as A, chunking
from loomstone.operators.lineage import cut

MAGIC, VERSION, HEADER, SIGNATURE = "LOOM", 1, "HEADER", "SIGNATURE"
TABLES = ("blocks", "store", "files", "pages")
#: What a header says, as a type for from_json.
FIELDS = (
    "magic string, version int, archive_id string, tables string, parents array<string>, block int, params array<int>, compression string, level int, dictionary string, "
    "salt string, iterations int, encrypted boolean, page_blocks int, main_size long, aux_size long, n_blocks long, stored_bytes long, variable_blocks boolean, has_main boolean, has_aux boolean, metadata string"
)


class Files:
    """Small files and folders of a store, by the driver's Hadoop file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf, self.root = spark._jvm, spark._jsc.hadoopConfiguration(), root.rstrip("/")
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self.path(name))

    def read(self, name: str) -> bytes:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def write(self, name: str, data: bytes, overwrite: bool = False) -> None:
        """Writes a file as a whole; without overwrite, one that is there is an error."""
        stream = self.fs.create(self.path(name), overwrite)
        stream.write(bytearray(data))
        stream.close()

    def names(self, name: str = "") -> list[str]:
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self.path(name))) if self.exists(name) else []

    def below(self, name: str) -> list[tuple[str, int]]:
        """(path below the root, size) of all files under a folder."""
        found, out, base = self.fs.listFiles(self.path(name), True), [], self.fs.makeQualified(self.path("")).toUri().getPath()
        while found.hasNext():
            x = found.next()
            out.append((x.getPath().toUri().getPath()[len(base) + 1 :], x.getLen()))
        return sorted(out)

    def uri(self) -> str:
        found = self.fs.makeQualified(self.path("")).toUri().toString()
        return "file://" + found[5:] if found.startswith("file:/") and not found.startswith("file://") else found

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class Owners(Mapping):
    """The archives of a catalog by id, opened when asked for."""

    def __init__(self, catalog: Catalog):
        self.catalog, self.known = catalog, {}

    def __contains__(self, archive_id) -> bool:
        return archive_id is not None and self.catalog.has(archive_id)

    def __getitem__(self, archive_id):
        if archive_id not in self.known:
            if archive_id not in self:
                raise KeyError(archive_id)
            self.known[archive_id] = self.catalog.open(archive_id)
        return self.known[archive_id]

    def __iter__(self):
        return iter(self.catalog.ids())

    def __len__(self) -> int:
        return len(self.catalog.ids())


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files, self.root = spark, Files(spark, root), root.rstrip("/")

    def has(self, archive_id: str) -> bool:
        return self.files.exists(f"{_safe(archive_id)}/{HEADER}")

    def ids(self) -> list[str]:
        return [x for x in self.files.names() if self.files.exists(f"{x}/{HEADER}")]

    def save(self, a: A.Archive, metadata: str | None = None) -> A.Archive:
        """Writes an archive and returns it as it is read from there; one of that id that is there already is an error.

        Blocks lie in order of their places, so that a read of a range skips the files and row groups beside it.
        """
        c, folder = a.config, f"tables-{uuid.uuid4().hex}"
        if self.has(a.id):
            raise FileExistsError(f"archive {a.id} is there already")
        to = f"{self.root}/{_safe(a.id)}/{folder}"
        a.blocks.repartitionByRange("stream", "block_idx").sortWithinPartitions("stream", "block_idx").write.option("compression", "zstd").parquet(f"{to}/blocks")
        a.store.write.option("compression", "none" if c.compression or c.key else "zstd").parquet(f"{to}/store")
        a.files.write.parquet(f"{to}/files")
        blocks = self.spark.read.parquet(f"{to}/blocks")
        A.pages(blocks).write.parquet(f"{to}/pages")
        sizes = {r["stream"]: r["size"] for r in a.files.groupBy("stream").agg(F.sum("size").alias("size")).collect()}
        stored = self.spark.read.parquet(f"{to}/store").agg(F.coalesce(F.sum("stored_len"), F.lit(0))).first()[0]
        header = {
            "magic": MAGIC, "version": VERSION, "archive_id": a.id, "tables": folder, "parents": list(a.parents), "block": c.block, "params": [c.params.least, c.params.mean, c.params.most] if c.params else None,
            "compression": c.compression, "level": c.level, "dictionary": base64.b64encode(c.dictionary).decode() if c.dictionary else None, "salt": c.salt.hex() if c.salt else None, "iterations": c.iterations,
            "encrypted": c.key is not None, "page_blocks": c.page_blocks, "main_size": sizes.get("main", 0), "aux_size": sizes.get("aux", 0), "n_blocks": blocks.count(), "stored_bytes": stored,
            "variable_blocks": c.params is not None, "has_main": "main" in sizes, "has_aux": "aux" in sizes, "metadata": metadata,
        }
        self.files.write(f"{_safe(a.id)}/{HEADER}", json.dumps(header, sort_keys=True).encode())
        return self.open(a.id, key=c.key)

    def header(self, archive_id: str) -> dict:
        """An archive's header; an error if it is none, or of a version that is not read."""
        if not self.has(archive_id):
            raise FileNotFoundError(f"no archive {archive_id} in {self.root}")
        return parse_header(self.files.read(f"{_safe(archive_id)}/{HEADER}"))

    def open(self, archive_id: str, key: bytes | None = None, password: str | None = None) -> A.Archive:
        """An archive with its parents; an encrypted one needs its key or password."""
        h = self.header(archive_id)
        config = A.PackConfig(
            h["archive_id"], h["block"], chunking.ChunkParams(*h["params"]) if h["params"] else None, h["compression"], h["level"], base64.b64decode(h["dictionary"]) if h["dictionary"] else None,
            key, bytes.fromhex(h["salt"]) if h["salt"] else None, h["iterations"], h["page_blocks"],
        )
        if h["encrypted"] and password is not None:
            config = config.with_password(password, config.salt, config.iterations)
        if h["encrypted"] and config.key is None:
            raise PermissionError(f"archive {archive_id} is encrypted: a key is needed")
        blocks, store, files = (self.table(archive_id, t) for t in TABLES[:3])
        return A.Archive(config, blocks, store, files, Owners(self), tuple(h["parents"]))

    def table(self, archive_id: str, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{_safe(archive_id)}/{self.header(archive_id)['tables']}/{name}")

    def page(self, archive_id: str, stream: str, at: int) -> DataFrame:
        """The blocks of the page that holds a place of a stream: the page's row says which, and the scan skips the rest."""
        page = self.table(archive_id, "pages").where((F.col("stream") == stream) & (F.col("start_logical") <= at)).orderBy(F.desc("start_logical"), F.desc("start_block")).limit(1).collect()
        blocks = self.table(archive_id, "blocks")
        if not page:
            return blocks.limit(0)
        first = page[0]["start_block"]
        return blocks.where((F.col("stream") == stream) & F.col("block_idx").between(first, first + page[0]["n_blocks"] - 1))

    def headers(self) -> DataFrame:
        """A row for each archive, with the fields of its header."""
        if not self.ids():
            return self.spark.createDataFrame([], FIELDS)
        return self.spark.read.text(f"{self.root}/*/{HEADER}", wholetext=True).select(F.from_json("value", FIELDS).alias("h")).select("h.*")

    def parents(self) -> DataFrame:
        """archive_id, parent_id and ordinal; null for archives without parents."""
        return self.headers().select("archive_id", F.posexplode_outer("parents").alias("ordinal", "parent_id")).select("archive_id", "parent_id", "ordinal")

    def blocks(self) -> DataFrame | None:
        paths = [f"{self.root}/{x}/{self.header(x)['tables']}/blocks" for x in self.ids()]
        return self.spark.read.parquet(*paths) if paths else None

    def log(self) -> DataFrame:
        """Each archive's place below its first parent (depth, path), its blocks by kind and the bytes it stores; in order of path."""
        first = self.parents().where("ordinal is null or ordinal = 0")
        tree = analysis.lineage(self.spark, first)
        blocks = self.blocks()
        if blocks is None:
            blocks = self.spark.createDataFrame([], "archive_id string, kind string, store_id string")
        counts = blocks.groupBy("archive_id").agg(F.count_if(F.col("kind") == "data").alias("data_blocks"), F.count_if(F.col("kind") == "parent").alias("parent_blocks"), F.count_if(F.col("kind") == "zero").alias("zero_blocks"))
        sizes = self.headers().select("archive_id", "stored_bytes")
        zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        return tree.join(counts, "archive_id", "left").join(sizes, "archive_id").select("archive_id", "depth", "path", zero("data_blocks"), zero("parent_blocks"), zero("zero_blocks"), "stored_bytes").orderBy("path")

    def show(self, archive_id: str) -> DataFrame:
        """One row: the header, counts of blocks of both streams, total_uncompressed and compression_ratio; .toJSON() gives it as JSON."""
        stats = analysis.inspect(self.open_index(archive_id), ("main", "aux"))
        h = self.headers().where(F.col("archive_id") == archive_id).drop("stored_bytes")
        total = F.col("main_size") + F.col("aux_size")
        return h.join(stats).withColumn("total_uncompressed", total).withColumn("compression_ratio", analysis.compression_ratio(total, F.col("stored_bytes")))

    def open_index(self, archive_id: str) -> A.Archive:
        """An archive whose payloads are not read; needs no key."""
        h = self.header(archive_id)
        config = A.PackConfig(h["archive_id"], h["block"], compression=h["compression"] or ("sealed" if h["encrypted"] else None))
        return A.Archive(config, *(self.table(archive_id, t) for t in TABLES[:3]), parents=tuple(h["parents"]))

    # --- signatures ---

    def digest(self, archive_id: str) -> bytes:
        """One digest over the header, all blocks and places, the manifest, and all stored bytes."""
        index = self.open_index(archive_id)
        payloads = index.store.select("store_id", F.sha2("payload", 256).alias("h"))
        names = index.files.select("stream", "path", "size", "mode")
        parts = [self.files.read(f"{_safe(archive_id)}/{HEADER}").hex(), A.digest(index.blocks).first()[0], _digest(payloads, ["store_id"]), _digest(names, ["stream", "path"])]
        return self.spark.range(1).select(F.unhex(F.sha2(F.lit("\n".join(parts)), 256))).first()[0]

    def sign(self, archive_id: str, private: bytes) -> bytes:
        signature = codecs.sign(self.spark, private, bytes(self.digest(archive_id)))
        self.files.write(f"{_safe(archive_id)}/{SIGNATURE}", signature, overwrite=True)
        return signature

    def verify(self, archive_id: str, public: bytes) -> bool:
        """Whether the archive is as it was when it was signed; an archive without a signature is an error."""
        if not self.files.exists(f"{_safe(archive_id)}/{SIGNATURE}"):
            raise FileNotFoundError(f"archive {archive_id} is not signed")
        return codecs.verify(self.spark, public, bytes(self.digest(archive_id)), self.files.read(f"{_safe(archive_id)}/{SIGNATURE}"))

    # --- copies ---

    def send(self, other: Catalog, wanted: list[str]) -> list[str]:
        """Copies archives and all they build on, so far as the other catalog lacks them, and returns their ids, parents first.

        Tasks copy the files; headers follow in order, so that no archive is there before those it builds on.
        """
        ask = self.spark.createDataFrame([(x,) for x in wanted], "archive_id string")
        there = self.spark.createDataFrame([(x,) for x in other.ids()], "archive_id string")
        plan = analysis.copy_plan(self.spark, self.parents(), ask, there)
        order = [r["archive_id"] for r in plan.orderBy("step").collect()]
        absent = [x for x in order if not self.has(x)]
        if absent:
            raise FileNotFoundError(f"no archive {absent[0]} in {self.root}")
        names = [(n,) for x in order for n, _ in self.files.below(_safe(x)) if not n.endswith(f"/{HEADER}")]
        if names:
            source, target = self.files.uri(), other.files.uri()
            copied = self.spark.createDataFrame(names, "name string").repartition(min(len(names), 4096)).mapInArrow(_copy(source, target), "name string, size long")
            if cut(copied).count() != len(names):
                raise RuntimeError("not all files were copied")
        for x in order:
            other.files.write(f"{_safe(x)}/{HEADER}", self.files.read(f"{_safe(x)}/{HEADER}"))
        return order


def _copy(source: str, target: str):
    def run(batches):
        from pyarrow import fs

        a, root_a = fs.FileSystem.from_uri(source)
        b, root_b = fs.FileSystem.from_uri(target)
        for batch in batches:
            names, sizes = batch.column("name").to_pylist(), []
            for name in names:
                b.create_dir(f"{root_b}/{name}".rpartition("/")[0], recursive=True)
                size = 0
                with a.open_input_stream(f"{root_a}/{name}") as src, b.open_output_stream(f"{root_b}/{name}") as out:
                    while data := src.read(1 << 22):
                        out.write(data)
                        size += len(data)
                sizes.append(size)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["name", "size"])

    return run


def _safe(archive_id: str) -> str:
    """The id, or an error if it is no plain name of a folder."""
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", archive_id):
        raise ValueError(f"no name for an archive: {archive_id!r}")
    return archive_id


def parse_header(data: bytes) -> dict:
    """ValueError if the bytes are no header, or of a version that is not read."""
    try:
        h = json.loads(data)
    except ValueError as e:
        raise ValueError("not an archive's header") from e
    if not isinstance(h, dict) or h.get("magic") != MAGIC:
        raise ValueError("not an archive's header")
    if h.get("version") != VERSION:
        raise ValueError(f"version {h.get('version')} is not read: this is version {VERSION}")
    return h


def _digest(rows: DataFrame, order: list[str]) -> str:
    """One digest over all rows: of parts by hash, each in order, then of the parts'."""
    line = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns))
    keyed = rows.select(F.shiftrightunsigned(F.xxhash64(*order), 52).alias("part"), F.struct(*order, line.alias("line")).alias("x"))
    # 4096 parts by hash: each is some millionth of a large archive's rows.
    parts = keyed.groupBy("part").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n"), 256).alias("h"))
    return parts.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "h"))), lambda x: x["h"]), "\n"), 256)).first()[0]

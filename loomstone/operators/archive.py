"""Archives as tables: packing with deduplication against parents, reading ranges, checking and extracting.

Tables: blocks(archive_id, stream, path, seq, block_idx, page_in_file, logical_start,
logical_len, kind, hash, owner, store_id), store(archive_id, store_id, payload, stored_len, crc32)
and files(archive_id, path, stream, size, offset, first_block, mode, mtime). kind is data, zero or
parent; only data blocks, once for each hash, have a payload in the archive's own store. owner names
the archive whose store has a block's payload, so a chain of versions is never walked to read.
"""

from __future__ import annotations

import hashlib
import hmac
import os
from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.functions import codecs
from loomstone.functions import columns as C
from loomstone.operators import chunking
from loomstone.operators.lineage import cut, running_sums

PAGE_BLOCKS = 4096


@dataclass(frozen=True)
class PackConfig:
    """block: bytes of fixed blocks, or params for blocks cut by content; key: AES key, which turns deduplication off.

    No two archives seal with one key: each has a salt of its own, from which its key is derived.
    """

    archive_id: str = "archive"
    block: int | None = 65536
    params: chunking.ChunkParams | None = None
    compression: str | None = None
    level: int = 3
    dictionary: bytes | None = None
    key: bytes | None = field(default=None, repr=False)
    salt: bytes | None = None
    iterations: int | None = None
    page_blocks: int = PAGE_BLOCKS

    @classmethod
    def profile(cls, name: str, **more) -> PackConfig:
        """Presets: generic, eda, embedded; trains(name) tells which of them are meant to have a dictionary."""
        block, compression = {"generic": (64 << 10, "lz4"), "eda": (16 << 10, "zstd"), "embedded": (4 << 10, "zstd")}[name]
        return cls(block=block, compression=compression, **more)

    @staticmethod
    def trains(name: str) -> bool:
        return name in ("eda", "embedded")

    def with_password(self, password: str, salt: bytes | None = None, iterations: int = 600_000) -> PackConfig:
        key, salt = codecs.derive_key(password, salt, iterations)
        return replace(self, key=key, salt=salt, iterations=iterations)

    def sealing_key(self) -> bytes:
        return hmac.new(self.key, b"blocks of an archive" + self.salt, hashlib.sha256).digest()


@dataclass
class Archive:
    """owners gives the archives, by id, that hold the payloads of parent blocks."""

    config: PackConfig
    blocks: DataFrame
    store: DataFrame
    files: DataFrame
    owners: Mapping[str, Archive] = field(default_factory=dict)
    parents: tuple[str, ...] = ()

    @property
    def id(self) -> str:
        return self.config.archive_id


def sized(files: DataFrame) -> DataFrame:
    return files.withColumn("size", F.coalesce(F.octet_length("content"), F.lit(0)).cast("long")).drop("content")


def placed(meta: DataFrame, sums: dict) -> DataFrame:
    """Files (path, stream, size and more) with offset and running sums, in order of path within each stream; main comes before aux. Paths are unique within a stream."""
    order = meta.withColumn("_aux", (F.col("stream") == "aux").cast("int"))
    summed = running_sums(order, ["_aux", "path"], {"global_start": F.col("size"), **sums})
    main = summed.where("_aux = 0").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("_main"))
    return summed.join(F.broadcast(main)).withColumn("offset", F.col("global_start") - F.col("_aux") * F.col("_main")).drop("_aux", "_main", "global_start")


def file_offsets(files: DataFrame) -> DataFrame:
    """`files` (path, stream, content and more) with size and offset in place of the content."""
    return placed(sized(files), {})


def cuts_of(files: DataFrame, config: PackConfig) -> DataFrame:
    plain = files.select("path", "stream", "content")
    return chunking.content_blocks(plain, config.params) if config.params else chunking.fixed_blocks(plain, config.block)


def index_of(files: DataFrame, config: PackConfig) -> DataFrame:
    """path, stream, seq, start, logical_len and hash (its 32 bytes) of all blocks, without content; hash is null for zero blocks, and for all blocks of an encrypted archive."""
    zero = C.is_zero(F.col("content"))
    cuts = cuts_of(files, config).select("path", "stream", "seq", "start", F.octet_length("content").cast("long").alias("logical_len"), zero.alias("zero"), F.when(~zero, F.unhex(C.hash_expr(F.col("content")))).alias("hash"))
    return cuts.withColumn("hash", F.lit(None).cast("binary")) if config.key else cuts


def inherited(parents: list[Archive]) -> DataFrame:
    """hash (its 32 bytes) and owner of all blocks that the parents hold or refer to; of several owners, the first parent's."""
    rows = None
    for i, p in enumerate(parents):
        own = p.blocks.where("hash is not null and kind <> 'zero'").select(F.unhex("hash").alias("hash"), "owner", F.lit(i).alias("i"))
        rows = own if rows is None else rows.unionByName(own)
    return rows.groupBy("hash").agg(F.min_by("owner", F.struct("i", "owner")).alias("inherited"))


def assemble(index: DataFrame, meta: DataFrame, config: PackConfig, known: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(blocks, files) of an index and the files' sizes and modes. Only files are put in order; blocks take their places from their file's."""
    per = index.groupBy("path", "stream").agg(F.count(F.lit(1)).alias("n_blocks"))
    counted = meta.join(per, ["path", "stream"], "left").withColumn("n_blocks", F.coalesce("n_blocks", F.lit(0)))
    files = cut(placed(counted, {"first_block": F.col("n_blocks")}).drop("n_blocks"))
    b = index.join(files.select("path", "stream", "offset", "first_block"), ["path", "stream"])
    b = b.select("path", "stream", "seq", (F.col("first_block") + F.col("seq")).alias("block_idx"), F.floor(F.col("seq") / config.page_blocks).alias("page_in_file"), (F.col("offset") + F.col("start")).alias("logical_start"), "logical_len", "zero", "hash")
    if known is not None:
        # Zero blocks have no hash, and are not dealt by it.
        b = b.where("hash is not null").join(known, "hash", "left").unionByName(b.where("hash is null").withColumn("inherited", F.lit(None).cast("string")))
    else:
        b = b.withColumn("inherited", F.lit(None).cast("string"))
    kind = F.when(F.col("zero"), "zero").when(F.col("inherited").isNotNull(), "parent").otherwise("data")
    b = b.withColumn("kind", kind).withColumn("owner", F.when(F.col("kind") == "data", F.lit(config.archive_id)).otherwise(F.col("inherited")))
    b = b.withColumn("hash", F.lower(F.hex("hash")))
    place = F.col("block_idx").cast("string") if config.key else F.col("hash")
    b = b.select(
        F.lit(config.archive_id).alias("archive_id"), "stream", "path", "seq", "block_idx", "page_in_file", "logical_start", "logical_len", "kind", "hash", "owner", F.when(F.col("kind") != "zero", place).alias("store_id"),
    )
    return b, files.withColumn("archive_id", F.lit(config.archive_id))


def stored(files: DataFrame, blocks: DataFrame, config: PackConfig, thin: bool = False) -> DataFrame:
    """The payloads: one block of each store_id, cut again, then compressed and sealed. Made when it is read.

    Blocks are dealt by hash once, and lie so from then on; copies of a block within a task go as one. Only a
    thin archive, of whose blocks the parents have most, is compressed after that.
    """
    packed = codecs.compress(config.compression, config.level, config.dictionary) if config.compression else lambda x: x
    data, cuts = blocks.where("kind = 'data'"), cuts_of(files, config)
    if config.key is not None:
        rows = cuts.select("path", "stream", "seq", "content").join(data.select("path", "stream", "seq", "block_idx", "store_id"), ["path", "stream", "seq"])
        rows = rows.select("store_id", C.encrypt(packed(F.col("content")), F.lit(config.sealing_key()), F.col("block_idx")).alias("payload"))
    else:
        early, late = (lambda x: x, packed) if thin else (packed, lambda x: x)
        each = cuts.select(C.hash_expr(F.col("content")).alias("store_id"), early(F.col("content")).alias("payload"))
        rows = each.groupBy("store_id").agg(F.first("payload").alias("payload")).join(data.select("store_id").distinct(), "store_id", "left_semi")
        rows = rows.select("store_id", late(F.col("payload")).alias("payload"))
    return rows.select(F.lit(config.archive_id).alias("archive_id"), "store_id", "payload", F.octet_length("payload").cast("long").alias("stored_len"), F.crc32("payload").alias("crc32"))


def pack(files: DataFrame, config: PackConfig, parents: list[Archive] | Archive | None = None) -> Archive:
    """Packs `files` (path, stream, content, mode, mtime). Blocks whose hash a parent knows refer to its owner; others are stored once.

    The index is made first, from hashes alone; payloads are cut, compressed and encrypted when the store is
    read or saved, the first block of each hash only. With a key all blocks are stored, and their hash is null.
    A null content is an empty file.
    """
    parents = [parents] if isinstance(parents, Archive) else list(parents or ())
    if config.key is not None and parents or any(p.config.key for p in parents):
        raise ValueError("an encrypted archive has no hashes to compare with others")
    if config.key is not None and config.salt is None:
        config = replace(config, salt=os.urandom(16))
    blocks, placed_ = assemble(cut(index_of(files, config)), sized(files), config, inherited(parents) if parents else None)
    blocks = cut(blocks)
    owners = {k: v for p in reversed(parents) for k, v in [*p.owners.items(), (p.id, p)]}
    return Archive(config, blocks, stored(files, blocks, config, bool(parents)), placed_, owners, tuple(p.id for p in parents))


def train_dictionary(files: DataFrame, block: int, limit: int, size: int = 110 << 10, entropy: float = 6.0) -> bytes:
    """A zstd dictionary from blocks that are not zero and whose entropy is below a bound: evenly spaced ones, of about `limit` bytes in all, which is what the driver holds."""
    b = chunking.fixed_blocks(files.select("path", "stream", "content"), block)
    total = files.agg(F.sum(F.ceil(F.octet_length("content") / block))).first()[0] or 0
    stride = max(1, total * block // max(1, limit))
    every = b.where(F.pmod(F.xxhash64("path", "stream"), F.lit(stride)) == F.pmod(F.col("seq"), F.lit(stride)))
    kept = every.where(~C.is_zero(F.col("content"))).where(codecs.entropy("content") < entropy).select("content")
    most = max(1, 2 * limit // block)
    return codecs.train_dictionary([bytes(r[0]) for r in kept.limit(most).collect()], size)


def pages(blocks: DataFrame) -> DataFrame:
    """One row for each run of up to page_blocks blocks of a file: its first block and place, and how many blocks it holds."""
    return blocks.groupBy("archive_id", "stream", "path", "page_in_file").agg(F.min("block_idx").alias("start_block"), F.min("logical_start").alias("start_logical"), F.count(F.lit(1)).alias("n_blocks"))


def decoded(rows: DataFrame, archive: Archive, check: bool) -> DataFrame:
    """Blocks with the content that their owner, this archive, stores; a missing or damaged payload is an error."""
    c = archive.config
    joined = rows.join(archive.store.select(F.col("store_id").alias("_id"), "payload", "crc32"), F.col("store_id") == F.col("_id"), "left")
    fail = lambda what: F.raise_error(F.concat(F.lit(f"{what} block "), F.col("block_idx").cast("string"), F.lit(f" of {c.archive_id}"))).cast("binary")
    content = F.when(F.col("payload").isNull(), fail("no bytes of")).otherwise(F.col("payload"))
    if check:
        content = F.when(F.col("payload").isNotNull() & (F.crc32("payload") != F.col("crc32")), fail("corrupt")).otherwise(content)
    if c.key is not None:
        content = F.coalesce(C.decrypt(content, F.lit(c.sealing_key()), F.col("store_id").cast("long")), F.raise_error(F.lit("wrong key or damaged block")).cast("binary"))
    if c.compression:
        content = codecs.decompress(c.compression, c.level, c.dictionary)(content)
    return joined.select(*rows.columns, content.alias("content"))


def payloads(archive: Archive, blocks: DataFrame | None = None, check: bool = True, missing: str = "error") -> DataFrame:
    """Blocks (all of the archive's, or those given) with their content: data blocks from its store, parent blocks from their owners', zero blocks null.

    A block whose owner cannot be opened, or whose payload is missing or has a wrong checksum, is an
    error; with missing="zero" blocks without an owner read as zeros.
    """
    rows = archive.blocks if blocks is None else blocks
    nothing = F.lit(None).cast("binary").alias("content")
    parts = [rows.where("kind = 'zero'").select("*", nothing), decoded(rows.where("kind = 'data'"), archive, check)]
    heirs = rows.where("kind = 'parent'")
    # As many names as there are versions below this one.
    for owner in [r[0] for r in heirs.select("owner").distinct().collect()]:
        own = heirs.where(F.col("owner").eqNullSafe(F.lit(owner)))
        if owner in archive.owners:
            parts.append(decoded(own, archive.owners[owner], check))
        elif missing == "zero":
            parts.append(own.select("*", nothing))
        else:
            raise LookupError(f"archive {owner} is not there, which holds blocks of {archive.id}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def audit(archive: Archive) -> DataFrame:
    """Stored blocks whose checksum is not that of their bytes."""
    return archive.store.where(F.crc32("payload") != F.col("crc32")).select("archive_id", "store_id")


def resolve(blocks: DataFrame, all_blocks: DataFrame, parents: DataFrame) -> DataFrame:
    """Parent blocks with the nearest archive up the chain that stores their hash (found; null if none does), whatever owner they name.

    parents(archive_id, parent_id, ordinal). Chains of any length are followed; among equally near ones the first ordinal wins; a cycle exceeds the recursion level, which is an error.
    """
    spark = blocks.sparkSession
    parents = cut(parents.select("archive_id", "parent_id", F.col("ordinal").cast("int").alias("ordinal")))
    parents.createOrReplaceTempView("loomstone_parents")
    most = parents.count() + 2
    ancestors = spark.sql(f"""
        WITH RECURSIVE up(archive_id, ancestor, depth, route) MAX RECURSION LEVEL {most} AS (
            SELECT archive_id, parent_id, 1, lpad(CAST(ordinal AS STRING), 4, '0') FROM loomstone_parents
            UNION ALL
            SELECT up.archive_id, p.parent_id, up.depth + 1, concat(up.route, '/', lpad(CAST(p.ordinal AS STRING), 4, '0'))
            FROM up JOIN loomstone_parents p ON up.ancestor = p.archive_id
        )
        SELECT archive_id, ancestor, min(struct(depth, route)) AS near FROM up GROUP BY archive_id, ancestor
    """)
    owners = all_blocks.where("kind = 'data'").select(F.col("archive_id").alias("ancestor"), "hash").distinct()
    wanted = blocks.where("kind = 'parent'").select("archive_id", "hash").distinct()
    best = wanted.join(ancestors, "archive_id").join(owners, ["ancestor", "hash"]).groupBy("archive_id", "hash").agg(F.min_by("ancestor", "near").alias("found"))
    return blocks.where("kind = 'parent'").join(best, ["archive_id", "hash"], "left")


def overlaps(requests: DataFrame, blocks: DataFrame, bucket: int = 1 << 16) -> DataFrame:
    """Blocks that each request (request_id, stream, first, n) touches, with the part of the block asked for.

    An equi-join on the number of the stretch of `bucket` bytes; both sides are
    written out for each stretch they reach into, and a pair counts in the
    first stretch they share.
    """
    ask = requests.where("n > 0").withColumn("end", F.col("first") + F.col("n"))
    spread = lambda first, end: F.explode(F.sequence(F.floor(F.col(first) / bucket), F.floor((F.col(end) - 1) / bucket)))
    a = ask.select("request_id", "stream", "first", "end", spread("first", "end").alias("at"))
    b = blocks.where("logical_len > 0").withColumn("stop", F.col("logical_start") + F.col("logical_len"))
    b = b.select(*blocks.columns, "stop", spread("logical_start", "stop").alias("at_block"))
    b = b.withColumnRenamed("stream", "stream_block")
    met = a.join(b, (F.col("at") == F.col("at_block")) & (F.col("stream") == F.col("stream_block")) & (F.col("first") < F.col("stop")) & (F.col("logical_start") < F.col("end")))
    met = met.where(F.col("at") == F.floor(F.greatest("first", "logical_start") / bucket))
    begin = F.greatest("first", "logical_start")
    return met.select("request_id", *(c for c in blocks.columns if c != "stream"), F.col("stream_block").alias("stream"), (begin - F.col("logical_start")).alias("skip"), (F.least("end", "stop") - begin).alias("take"))


def part(skip: str = "skip", take: str = "take"):
    """The bytes of a block from `skip` on; those of a block without content are zeros."""
    return F.coalesce(F.expr(f"substring(content, CAST({skip} + 1 AS INT), CAST({take} AS INT))"), F.unhex(F.repeat(F.lit("00"), F.col(take).cast("int"))))


def read_ranges(archive: Archive, requests: DataFrame, pad: bool = False, missing: str = "error") -> DataFrame:
    """request_id and bytes of requests (request_id, stream, first, n), in order and clipped to what is there; past the end they are empty, or zeros with pad.

    Places are found in the index; only the payloads that a request touches are read.
    """
    met = cut(overlaps(requests, archive.blocks))
    pieces = payloads(archive, met, missing=missing).select("request_id", "logical_start", part().alias("part"))
    # Each request is one value: its pieces meet in one row.
    whole = pieces.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("logical_start", "part"))).alias("parts"))
    joined = F.aggregate(F.transform("parts", lambda x: x["part"]), F.unhex(F.lit("")), lambda a, x: F.concat(a, x))
    got = requests.join(whole.select("request_id", joined.alias("bytes")), "request_id", "left").withColumn("bytes", F.coalesce("bytes", F.unhex(F.lit(""))))
    if pad:
        got = got.withColumn("bytes", F.concat("bytes", F.unhex(F.repeat(F.lit("00"), F.greatest(F.lit(0), F.col("n") - F.octet_length("bytes")).cast("int")))))
    return got.select("request_id", "bytes")


def read_files(archive: Archive, requests: DataFrame) -> DataFrame:
    """request_id and bytes of requests (request_id, path, first, n) on files, clipped to their ends; a path that is no file gives null."""
    asked = requests.join(archive.files.select("path", "stream", "offset", "size"), "path", "left")
    first = F.least("first", "size")
    inside = cut(asked.select("request_id", "stream", (F.col("offset") + first).alias("first"), F.greatest(F.lit(0), F.least("n", F.col("size") - first)).alias("n")))
    got = read_ranges(archive, inside.where("stream is not null"))
    return inside.select("request_id").join(got, "request_id", "left")


def find_file(archive: Archive, path: str) -> DataFrame:
    return archive.files.where(F.col("path") == path)


def safe_path(path: str) -> str:
    """The path, or an error if it would leave the folder that files are extracted to."""
    p = PurePosixPath(path)
    if p.is_absolute() or ".." in p.parts or not p.parts:
        raise ValueError(f"unsafe path {path!r}")
    return str(p)


def extract(archive: Archive, uri: str) -> DataFrame:
    """Writes each file of the manifest below a folder, by tasks, with its mode where the store has modes, and returns (path, size, mode).

    Blocks of a file stream to its task in order. A file whose blocks do not make up its size is an error.
    """
    files = archive.files
    codecs.small_batches(files.sparkSession)
    unsafe = files.where(F.col("path").startswith("/") | F.col("path").rlike(r"(^|/)\.\.(/|$)") | (F.col("path") == ""))
    bad = unsafe.select("path").limit(1).collect()
    if bad:
        safe_path(bad[0][0])
    nothing = F.lit(None)
    blocks = payloads(archive).select("path", "stream", F.col("logical_start").alias("at"), part("0", "logical_len").alias("content"), nothing.cast("int").alias("mode"), nothing.cast("long").alias("size"))
    heads = files.select("path", "stream", F.lit(-1).cast("long").alias("at"), nothing.cast("binary").alias("content"), F.col("mode").cast("int").alias("mode"), "size")
    rows = heads.unionByName(blocks).repartition("path").sortWithinPartitions("path", "stream", "at")

    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(uri)
        done, out, head, size = [], None, None, 0

        def close():
            out.close()
            if size != head[1]:
                raise ValueError(f"{head[0]}: {size} bytes of {head[1]}")
            if isinstance(store, fs.LocalFileSystem) and head[2] is not None:
                os.chmod(f"{root}/{head[0]}", head[2])
            done.append(head)

        for batch in batches:
            for path, at, data, mode, want in zip(*(batch.column(c).to_pylist() for c in ("path", "at", "content", "mode", "size")), strict=True):
                if at < 0:
                    if out:
                        close()
                    head, size = (safe_path(path), want, mode), 0
                    target = f"{root}/{head[0]}"
                    store.create_dir(target.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(target)
                else:
                    out.write(data)
                    size += len(data)
        if out:
            close()
        columns = list(zip(*done, strict=True)) if done else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int32()), strict=True)], ["path", "size", "mode"])

    return cut(rows.select("path", "at", "content", "mode", "size").mapInArrow(run, "path string, size long, mode int"))


def file_digests(archive: Archive, check: bool = True) -> DataFrame:
    """path, stream, size and digest (SHA-256, hex) of each file as read back, taken block by block: no file is ever one value.

    A file without blocks has the digest of no bytes; one whose blocks do not make up its size is an error.
    """
    codecs.small_batches(archive.files.sparkSession)
    blocks = payloads(archive, check=check).select("path", "stream", F.col("logical_start").alias("at"), "logical_len", "content", F.lit(None).cast("long").alias("size"))
    heads = archive.files.select("path", "stream", F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("logical_len"), F.lit(None).cast("binary").alias("content"), F.col("size").cast("long").alias("size"))
    rows = heads.unionByName(blocks).repartition("path").sortWithinPartitions("path", "stream", "at")

    def run(batches):
        head = made = None
        zeros = bytes(1 << 16)

        def table(done):
            columns = list(zip(*done, strict=True)) if done else [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)], ["path", "stream", "size", "digest"])

        def closed():
            if got != head[2]:
                raise ValueError(f"{head[0]}: {got} bytes of {head[2]}")
            return (*head, made.hexdigest())

        got = 0
        for batch in batches:
            done = []
            for path, stream, at, n, content, size in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if at < 0:
                    if head:
                        done.append(closed())
                    head, made, got = (path, stream, size), hashlib.sha256(), 0
                elif content is not None:
                    made.update(content)
                    got += len(content)
                else:
                    for first in range(0, n, len(zeros)):
                        made.update(zeros[: n - first])
                    got += n
            yield table(done)
        if head:
            yield table([closed()])

    return rows.select("path", "stream", "at", "logical_len", "content", "size").mapInArrow(run, "path string, stream string, size long, digest string")


def digest(blocks: DataFrame) -> DataFrame:
    """One digest over all block hashes and places, for signing: hashes of parts, ordered, then one over them."""
    rows = blocks.select("stream", "block_idx", F.concat_ws("|", "stream", F.col("block_idx").cast("string"), "kind", F.coalesce("hash", F.lit("")), F.col("logical_len").cast("string")).alias("row"))
    # 4096 blocks to a part: an archive of 2**40 bytes has some ten thousand parts.
    parts = rows.groupBy("stream", F.floor(F.col("block_idx") / 4096).alias("part")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_idx", "row"))), lambda x: x["row"]), "\n"), 256).alias("h"))
    return parts.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("stream", "part", "h"))), lambda x: x["h"]), "\n"), 256).alias("digest"))

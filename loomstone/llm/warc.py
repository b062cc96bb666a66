"""WARC archives: writing records as gzip members, and a splittable reader."""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm.common import as_bytes

MAGIC = b"\x1f\x8b\x08"
#: Payloads shorter than this are never replaced by a revisit record.
LEAST_REVISIT = 100
#: Text files end each record with a separator; members are made to end in this byte, which is left to the writer.
LAST = b"\x00"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def _gzip(data: bytes) -> bytes:
    """One gzip member that ends in a zero byte: of 16 MiB and more, an empty member follows."""
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = c.compress(data) + c.flush()
    return out if out.endswith(LAST) else out + _gzip(b"")


def record_id(page_id) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def record(page_id, url: str, payload: bytes, digest: str, refers_to=None, revisit: bool = False) -> bytes:
    """A WARC/1.1 record as a gzip member; a revisit holds no payload, and its headers give the payload's length and digest."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/octet-stream",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
        payload = b""
    head.append(f"Content-Length: {len(payload)}")
    return _gzip("\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n")


def _members(batches):
    for batch in batches:
        ids, urls, htmls = batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), as_bytes(batch.column("html"))
        digests, refs, again = (batch.column(x).to_pylist() for x in ("digest", "refers_to", "revisit"))
        out = [record(*x)[:-1] for x in zip(ids, urls, htmls, digests, refs, again, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, refers_to and revisit for each row of `pages`.

    Of rows with equal payloads of at least LEAST_REVISIT bytes, the one with the least page_id
    is the response (a null page_id counts as the greatest; of rows that repeat that page_id, one).
    Who is first is settled on ids and digests alone. The rows are then joined with what was found by digest and
    page_id, so payloads are shuffled once, and copies of one payload are spread by their ids.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha2(F.encode(html, "UTF-8"), 256).alias("digest"))
    long_ = rows.where(F.octet_length("html") >= LEAST_REVISIT)
    by_page = long_.groupBy("digest", "page_id").agg(F.count(F.lit(1)).alias("n"))
    first = by_page.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.sum("n").alias("all")).where(F.col("all") > 1)
    marks = by_page.join(first.select("digest", "refers_to"), "digest").select(
        F.col("digest").alias("d"), F.col("page_id").alias("p"), "refers_to", F.when(F.col("page_id").eqNullSafe(F.col("refers_to")), F.col("n")).otherwise(0).alias("firsts")
    )
    joined = rows.join(marks, (F.col("digest") == F.col("d")) & F.col("page_id").eqNullSafe(F.col("p")), "left")
    revisit = F.coalesce(F.col("firsts") == 0, F.lit(False))
    plain = joined.where(F.coalesce(F.col("firsts"), F.lit(0)) <= 1).select("page_id", "url", "html", "digest", "refers_to", revisit.alias("revisit"))
    if marks.where("firsts > 1").isEmpty():
        return plain
    order = F.expr("row_number() OVER (PARTITION BY digest, page_id ORDER BY url)")
    tied = joined.where(F.col("firsts") > 1).select("page_id", "url", "html", "digest", "refers_to", (order > 1).alias("revisit"))
    return plain.unionByName(tied)


def write_archives(pages: DataFrame, path: str) -> None:
    """Writes a record for each row of `pages` (page_id, url, html) to archive files under `path`, in any store that Spark writes.

    Spark's own committer places the files, so lost tasks leave nothing behind.
    A null html is an empty payload. An empty table leaves no records.
    """
    members = plan_records(pages).mapInArrow(_members, "member binary")
    members.select(F.col("member").cast("string").alias("value")).write.option("lineSep", LAST.decode()).text(path)


# --- reading ---------------------------------------------------------------


class Source:
    """Reads of byte ranges of one file, in blocks."""

    BLOCK = 1 << 20

    def __init__(self, uri: str):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
        self.file = store.open_input_file(path)
        self.size = self.file.size()

    def read(self, at: int, n: int | None = None) -> bytes:
        return self.file.read_at(max(0, min(n or self.BLOCK, self.size - at)), at)


def starts_record(data: bytes) -> bool:
    """Whether a gzip member begins here whose content begins like a WARC record."""
    try:
        return zlib.decompressobj(31).decompress(data, 16).startswith(b"WARC/1.")
    except zlib.error:
        return False


def member(source: Source, at: int) -> tuple[bytes, int] | None:
    """The content of the gzip member at a place and where it ends; None if there is no sound one."""
    d, out = zlib.decompressobj(31), []
    try:
        while not d.eof:
            block = source.read(at)
            if not block:
                return None
            out.append(d.decompress(block))
            at += len(block) - len(d.unused_data)
    except zlib.error:
        return None
    return b"".join(out), at


def parse(content: bytes) -> tuple[dict, bytes]:
    """Headers (lower-case names) and block of a record; ValueError if it is not whole."""
    head, gap, rest = content.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(headers.get("content-length", -1))
    if not gap or not lines[0].startswith("WARC/1.") or n < 0 or len(rest) < n:
        raise ValueError("not a whole WARC record")
    return headers, rest[:n]


def records(source: Source, start: int, end: int, damaged=None):
    """(offset, headers, block) of the records that begin in [start, end).

    The place need not be a member's start: gzip magic is searched, and a
    candidate counts if what it holds begins like a record, the whole member
    passes its checksum, and the file ends there or another member follows.
    After a sound member the next one begins at its end. What begins like a record, or follows a
    sound one, and is not sound is passed over, and damaged(offset, why) called for it.
    """

    def report(why: str) -> None:
        if damaged:
            damaged(at, why)

    at, chained = start, False
    while at < end:
        if not chained:
            block = source.read(at, min(Source.BLOCK, end - at) + 2)
            found = block.find(MAGIC)
            if found < 0 or at + found >= end:
                at += max(1, len(block) - 2)
                continue
            at += found
        head = source.read(at, 4096)
        like = starts_record(head)
        if not head.startswith(MAGIC):
            report("no gzip member where one should begin")
            chained = False
            at += 1
            continue
        got = member(source, at) if chained or like else None
        follows = got and (got[1] >= source.size or source.read(got[1], 3) == MAGIC)
        if got is None or not (chained or follows):
            if chained or like:
                report("gzip member cut short or with a wrong checksum" if got is None else "something other than a gzip member follows")
            chained = False
            at += 1
            continue
        if got[0]:
            try:
                headers, block = parse(got[0])
            except ValueError as e:
                report(str(e))
            else:
                yield at, headers, block
        at, chained = got[1], True


COLUMNS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
DAMAGED = "damaged"


def _read(keep_damage: bool):
    names = [x.split()[0] for x in COLUMNS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def number(urn: str):
        tail = urn.strip("<>").rpartition(":")[2]
        return None if tail in ("", "none") else int(tail)

    def table(rows):
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def run(batches):
        for batch in batches:
            for uri, start, end in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                rows, size = [], 0

                def damaged(at, why, uri=uri):
                    if not keep_damage:
                        raise ValueError(f"{uri}, byte {at}: {why}")
                    rows.append((None, at, None, DAMAGED, None, uri, why.encode()))  # noqa: B023

                for at, headers, block in records(Source(uri), start, end, damaged):
                    kind, digest = headers.get("warc-type"), headers.get("warc-payload-digest", "")
                    if kind == "response":
                        found = hashlib.sha256(block).hexdigest()
                        if digest and digest != f"sha256:{found}":
                            damaged(at, f"{headers.get('warc-record-id')}: payload does not match its digest")
                            continue
                        rows.append((number(headers["warc-record-id"]), len(block), found, kind, None, headers.get("warc-target-uri"), block))
                    elif kind == "revisit":
                        rows.append((number(headers["warc-record-id"]), int(headers["x-payload-length"]), digest.rpartition(":")[2], kind, number(headers["warc-refers-to"]), headers.get("warc-target-uri"), None))
                    size += len(block)
                    if size > 1 << 23:
                        yield table(rows)
                        rows, size = [], 0
                yield table(rows)

    return run


def archive_files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(file, size) of the files under a path of any store that Spark reads."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(conf).listFiles(root, True)
    out = []
    while files.hasNext():
        f = files.next()
        if not f.getPath().getName().startswith(("_", ".")):
            uri, n = f.getPath().toUri().toString(), f.getLen()
            out.append(("file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri, n))
    return out


#: Bytes of archives to a task, and tasks at most: beyond, each takes more ranges.
TASK_BYTES, TASKS = 8 << 20, 20_000


def read_archives(spark: SparkSession, path: str, split_bytes: int = 8 << 20, keep_damage: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url and payload of all records under `path`.

    Files are cut into byte ranges without regard to records; a task owns the
    records that begin in its ranges. Executors open the files by URI (file, s3,
    gs, hdfs). Payloads are held against their digests. A member that is cut short, fails its checksum or is no
    record is an error; with keep_damage it is a row of record_type damaged, with the file as url, the place
    in it as payload_bytes and the reason as payload. No files, or only empty ones: no rows.
    """
    files = archive_files(spark, path)
    total = sum(n for _, n in files)
    df = spark.createDataFrame(files, "uri string, size long").where("size > 0")
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long")))
    ranges = df.select("uri", first.alias("first"), "size").select("uri", "first", F.least("size", F.col("first") + split_bytes).alias("last"))
    return ranges.repartition(max(1, min(TASKS, -(-total // min(TASK_BYTES, split_bytes)))), "uri", "first").mapInArrow(_read(keep_damage), COLUMNS)

"""Files as rows: folders, tar archives, and locations in remote stores."""

from __future__ import annotations

import http.client
import io
import ipaddress
import os
import re
import socket
import tarfile
from collections.abc import Callable
from typing import Protocol
from urllib.parse import unquote, urljoin, urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstone.operators import chunking
from loomstone.operators.catalog import Files


IGNORE = ".loomignore"


def ignore_pattern(line: str) -> tuple[str, bool] | None:
    """(regular expression over paths, whether it takes back earlier ones) of a line of an ignore file; None for blank lines and comments.

    * and ? stay within a name, ** does not; a slash at the beginning or within ties a pattern to the root, one at the end means folders.
    """
    line = line.strip()
    if not line or line.startswith("#"):
        return None
    back, line = line.startswith("!"), line.removeprefix("!")
    tied, folder_ = "/" in line.rstrip("/"), line.endswith("/")
    out, rest = "", line.strip("/")
    while rest:
        for mark, meant in (("**/", "(?:.*/)?"), ("**", ".*"), ("*", "[^/]*"), ("?", "[^/]")):
            if rest.startswith(mark):
                out, rest = out + meant, rest[len(mark) :]
                break
        else:
            out, rest = out + re.escape(rest[0]), rest[1:]
    return ("^" if tied else "(?:^|/)") + out + ("/" if folder_ else "(?:/|$)"), back


def local_mode(path: str):
    """Modes of local files, of which a task can see them."""

    @F.pandas_udf(T.IntegerType())
    def run(s: pd.Series) -> pd.Series:
        names = s.map(lambda p: unquote(urlsplit(p).path))
        return names.map(lambda p: os.stat(p).st_mode & 0o7777 if os.path.exists(p) else 0o644)

    return run(path)


def folder(spark: SparkSession, uri: str, ignore: list[str] | None = None) -> DataFrame:
    """path (below the folder), stream, content, mode and mtime of all files of any store that Spark reads, hidden and empty ones too.

    Files named memory are in stream aux. Left out are paths that the folder's .loomignore or `ignore`
    (lines of the same kind) name, and anything below a `.loom` folder. The driver lists the files, as Spark
    itself does; a file is one value, and files of 2 GiB and more are for content_blocks_of.
    """
    files = Files(spark, uri)
    root = files.fs.makeQualified(files.path("")).toUri().getPath().rstrip("/")
    lines = files.read(IGNORE).decode("utf-8", "replace").splitlines() if files.exists(IGNORE) else []
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(uri.rstrip("/"))
    plain = F.regexp_replace(F.col("path"), r"^[a-z0-9]+:/+", "/")
    path = F.substr(F.substr(plain, F.instr(plain, root + "/")), F.lit(len(root) + 2))
    mode = local_mode("path") if files.uri().startswith("file:") else F.lit(0o644)
    out = df.select(path.alias("path"), "content", mode.alias("mode"), F.col("modificationTime").cast("long").alias("mtime"))
    # Spark leaves out empty files, and such as begin with a dot or underscore.
    hidden = [(f"{files.uri()}/{n}", n) for n, size in files.below("") if not size or any(x.startswith((".", "_")) for x in n.split("/"))]
    if hidden:
        own = spark.createDataFrame(hidden, "uri string, path string").mapInArrow(_small, "path string, content binary, mode int, mtime long")
        out = out.join(F.broadcast(spark.createDataFrame([(n,) for _, n in hidden], "path string")), "path", "left_anti").unionByName(own)
    gone = F.lit(False)
    for pattern, back in [x for x in map(ignore_pattern, [*lines, *(ignore or [])]) if x]:
        gone = F.when(F.col("path").rlike(pattern), F.lit(not back)).otherwise(gone)
    out = out.where(~gone & ~F.col("path").rlike(r"(^|/)\.loom(/|$)"))
    return out.select("path", F.when(F.element_at(F.split("path", "/"), -1) == "memory", "aux").otherwise("main").alias("stream"), "content", "mode", "mtime")


def _small(batches):
    """Files that Spark's reader leaves out, by URI."""
    from pyarrow import fs

    for batch in batches:
        for uri, path in zip(batch.column("uri").to_pylist(), batch.column("path").to_pylist(), strict=True):
            store, name = fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
            with store.open_input_stream(name) as f:
                data = f.read()
            mode = os.stat(name).st_mode & 0o7777 if isinstance(store, fs.LocalFileSystem) else 0o644
            row = [[path], [data], [mode], [int(store.get_file_info(name).mtime.timestamp())]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.string(), pa.binary(), pa.int32(), pa.int64()), strict=True)], ["path", "content", "mode", "mtime"])


def tar(spark: SparkSession, uri: str) -> DataFrame:
    """path, stream, content, mode and mtime of the regular entries of tar files, whose names begin the paths."""
    rows = spark.read.format("binaryFile").load(uri).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with tarfile.open(fileobj=io.BytesIO(data)) as t:
                    for m in t:
                        if m.isfile():
                            row = [f"{name}/{m.name}", "main", t.extractfile(m).read(), m.mode, int(m.mtime)]
                            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, (pa.string(), pa.string(), pa.binary(), pa.int32(), pa.int64()), strict=True)], ["path", "stream", "content", "mode", "mtime"])

    return rows.mapInArrow(run, "path string, stream string, content binary, mode int, mtime long")


# --- locations ----------------------------------------------------------------


def restricted(address: str) -> bool:
    """Whether an IP address is not one of the public network."""
    a = ipaddress.ip_address(address)
    a = getattr(a, "ipv4_mapped", None) or a
    return not a.is_global or a.is_multicast or a.is_reserved


def resolve(host: str) -> list[str]:
    return sorted({x[4][0] for x in socket.getaddrinfo(host, None)})


def public_addresses(url: str, lookup: Callable[[str], list[str]] = resolve, allowed: Callable[[str], bool] = lambda address: not restricted(address)) -> list[str]:
    """The addresses that a URL's host has; ValueError if it is not http(s), or if one of them is not public."""
    parts = urlsplit(url)
    if parts.scheme not in ("http", "https") or not parts.hostname:
        raise ValueError("only http and https locations with a host are read")
    try:
        found = [str(ipaddress.ip_address(parts.hostname))]
    except ValueError:
        found = lookup(parts.hostname)
    if not found or not all(allowed(x) for x in found):
        raise ValueError(f"{parts.hostname} is not a public host")
    return found


def checked_url(url: str, lookup: Callable[[str], list[str]] = resolve) -> str:
    """The URL, or ValueError if it is not http(s) or leads to an address that is not public."""
    public_addresses(url, lookup)
    return url


class Backend(Protocol):
    """Reads of byte ranges of one file."""

    def read_exact(self, at: int, n: int) -> bytes: ...

    def size(self) -> int: ...

    def is_empty(self) -> bool: ...


class StoreFile:
    """A file of a store that pyarrow opens by URI: file, s3, gs, hdfs; s3a counts as s3. Local files are mapped where that is asked."""

    def __init__(self, uri: str, mapped: bool = False):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1) if "://" in uri else f"file://{uri}")
        self.file = pa.memory_map(path) if mapped and isinstance(store, fs.LocalFileSystem) else store.open_input_file(path)

    def size(self) -> int:
        return self.file.size()

    def is_empty(self) -> bool:
        return not self.size()

    def read_exact(self, at: int, n: int) -> bytes:
        if at < 0 or n < 0 or at + n > self.size():
            raise ValueError(f"bytes {at} to {at + n} are not all in a file of {self.size()}")
        return self.file.read_at(n, at)


class _Pinned(http.client.HTTPConnection):
    """A connection to an address that was checked, whatever the name leads to by then."""

    address: str | None = None

    def connect(self) -> None:
        self.sock = socket.create_connection((self.address or self.host, self.port), self.timeout)


class _PinnedTls(http.client.HTTPSConnection):
    address: str | None = None

    def connect(self) -> None:
        plain = socket.create_connection((self.address or self.host, self.port), self.timeout)
        self.sock = self._context.wrap_socket(plain, server_hostname=self.host)


class HttpFile:
    """Ranged reads of one file over HTTP. The location and each redirect is checked, and the connection goes to the address that was checked."""

    def __init__(self, url: str, lookup: Callable[[str], list[str]] = resolve, most_redirects: int = 10, timeout: float = 60, allowed: Callable[[str], bool] = lambda address: not restricted(address)):
        self.url, self.lookup, self.most, self.timeout, self.allowed = url, lookup, most_redirects, timeout, allowed

    def _open(self, method: str, headers: dict):
        url = self.url
        for _ in range(self.most + 1):
            parts = urlsplit(url)
            address = public_addresses(url, self.lookup, self.allowed)[0]
            c = (_PinnedTls if parts.scheme == "https" else _Pinned)(parts.hostname, parts.port, timeout=self.timeout)
            c.address = address
            c.request(method, (parts.path or "/") + (f"?{parts.query}" if parts.query else ""), headers=headers)
            r = c.getresponse()
            if r.status in (301, 302, 303, 307, 308) and r.headers.get("Location"):
                url = urljoin(url, r.headers["Location"])
                c.close()
                continue
            return r
        raise ValueError("too many redirects")

    def size(self) -> int:
        r = self._open("HEAD", {})
        if r.status != 200 or r.headers.get("Content-Length") is None:
            raise ValueError(f"no length of {self.url}: status {r.status}")
        return int(r.headers["Content-Length"])

    def is_empty(self) -> bool:
        return not self.size()

    def read_exact(self, at: int, n: int) -> bytes:
        if not n:
            return b""
        r = self._open("GET", {"Range": f"bytes={at}-{at + n - 1}"})
        if r.status != 206:
            raise ValueError(f"no range of {self.url}: status {r.status}")
        data = r.read(n + 1)
        if len(data) != n:
            raise ValueError("wrong amount of data")
        return data


def backend(uri: str) -> Backend:
    return HttpFile(uri) if urlsplit(uri).scheme in ("http", "https") else StoreFile(uri)


def read_uris(requests: DataFrame, opener: Callable[[str], Backend] = backend) -> DataFrame:
    """request_id and bytes of requests (request_id, uri, first, n), read by tasks; a range that is not all there is an error."""

    def run(batches):
        last, file = None, None
        for batch in batches:
            ids, uris, firsts, sizes = (batch.column(c).to_pylist() for c in ("request_id", "uri", "first", "n"))
            for i, uri, first, n in zip(ids, uris, firsts, sizes, strict=True):
                if uri != last:
                    last, file = uri, opener(uri)
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([file.read_exact(first, n)], pa.binary())], ["request_id", "bytes"])

    rows = requests.select(F.col("request_id").cast("long").alias("request_id"), "uri", F.col("first").cast("long").alias("first"), F.col("n").cast("long").alias("n"))
    return rows.repartition("uri").sortWithinPartitions("uri", "first").mapInArrow(run, "request_id long, bytes binary")


def content_blocks_of(files: DataFrame, params: chunking.ChunkParams, opener: Callable[[str], Backend] = backend) -> DataFrame:
    """path, stream, seq, start and content of the blocks of files (path, stream, uri) of any length, which tasks read and cut as a stream."""

    def run(batches):
        for batch in batches:
            for path, stream, uri in zip(*(batch.column(c).to_pylist() for c in ("path", "stream", "uri")), strict=True):
                file = opener(uri)
                at, size, start = 0, file.size(), 0

                def read(n, file=file, size=size):
                    nonlocal at
                    n = min(n, size - at)
                    data = file.read_exact(at, n)
                    at += n
                    return data

                for seq, data in enumerate(chunking.stream_chunks(read, params)):
                    row = [[path], [stream], [seq], [start], [data]]
                    start += len(data)
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["path", "stream", "seq", "start", "content"])

    return files.select("path", "stream", "uri").mapInArrow(run, "path string, stream string, seq int, start long, content binary")


# --- remote folders -------------------------------------------------------------


class Transport(Protocol):
    def list(self) -> list[tuple[str, int]]: ...

    def upload(self, local: str, name: str) -> None: ...

    def download(self, name: str, local: str) -> None: ...

    def exists(self, name: str) -> bool: ...


class Remote:
    """A folder of a store that Spark reads, for single files."""

    def __init__(self, spark: SparkSession, url: str):
        self.jvm, self.url = spark._jvm, url.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        if ".." in name.split("/"):
            raise ValueError(f"unsafe name {name!r}")
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.url}/{name}" if name else self.url)

    def list(self) -> list[tuple[str, int]]:
        """(name, size) of the files of the folder itself."""
        if not self.fs.exists(self._path("")):
            return []
        return sorted((x.getPath().getName(), x.getLen()) for x in self.fs.listStatus(self._path("")) if x.isFile())

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def upload(self, local: str, name: str) -> None:
        self.fs.copyFromLocalFile(False, True, self.jvm.org.apache.hadoop.fs.Path(local), self._path(name))

    def download(self, name: str, local: str) -> None:
        self.fs.copyToLocalFile(False, self._path(name), self.jvm.org.apache.hadoop.fs.Path(local), True)


def connect(spark: SparkSession, url: str) -> Transport:
    """The remote folder at a URL: s3 (read as s3a), or any other store of Spark's; http cannot be written to."""
    scheme = urlsplit(url).scheme
    if scheme in ("http", "https"):
        raise ValueError("http locations are no remotes")
    if scheme == "s3":
        if not urlsplit(url).netloc:
            raise ValueError("no bucket")
        url = "s3a" + url[2:]
    return Remote(spark, url)


def remote_listing(spark: SparkSession, uri: str, pattern: str = "*") -> DataFrame:
    """name and size of the files at a location of a store that Spark reads (s3a, hdfs, file); http locations cannot be listed."""
    if urlsplit(uri).scheme in ("http", "https"):
        raise ValueError("http locations cannot be listed")
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(uri)
    return df.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"))

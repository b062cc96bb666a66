"""Archives as Python objects: names, whole files, and files that are read in parts.

    from loomstone import api
    api.pack("/data/v1", "/archives/v1")
    api.pack("/data/v2", "/archives/v2", base="/archives/v1")
    with api.Archive("/archives/v2") as a:
        a.namelist(), a.read("x.txt"), a.open("x.txt").read(100)

An archive is a folder of a catalog: /archives is the catalog, v1 the archive's id.
"""

from __future__ import annotations

import io

from pyspark.sql import SparkSession

from loomstone import __version__ as version
from loomstone.operators import archive as A, chunking
from loomstone.operators.catalog import Catalog
from loomstone.sources import files as sources

__all__ = ["Archive", "File", "pack", "version"]


def _place(path: str) -> tuple[Catalog, str]:
    root, _, archive_id = path.rstrip("/").rpartition("/")
    return Catalog(SparkSession.active(), root or "."), archive_id


class File(io.RawIOBase):
    """A file of an archive. Each read is a read of the blocks that it touches."""

    def __init__(self, archive: Archive, path: str, size: int):
        self.archive, self.path, self.size, self.at = archive, path, size, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        at = offset + {io.SEEK_SET: 0, io.SEEK_CUR: self.at, io.SEEK_END: self.size}[whence]
        if at < 0:
            raise ValueError("place before the file's beginning")
        self.at = at
        return at

    def read(self, size: int | None = -1) -> bytes:
        left = max(0, self.size - self.at)
        n = left if size is None or size < 0 else min(size, left)
        data = self.archive.range(self.path, self.at, n) if n else b""
        self.at += len(data)
        return data

    def readinto(self, buffer) -> int:
        data = self.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)


class Archive:
    def __init__(self, path: str, key: bytes | None = None, password: str | None = None):
        catalog, archive_id = _place(path)
        self.inner = catalog.open(archive_id, key, password)
        self.spark = catalog.spark

    def __enter__(self) -> Archive:
        return self

    def __exit__(self, *_) -> None:
        return None

    def namelist(self) -> list[str]:
        return [r["path"] for r in self.inner.files.select("path").orderBy("path").collect()]

    def _size(self, path: str) -> int:
        found = A.find_file(self.inner, path).select("size").first()
        if found is None:
            raise KeyError(path)
        return found["size"]

    def range(self, path: str, first: int, n: int) -> bytes:
        ask = self.spark.createDataFrame([(0, path, first, n)], "request_id int, path string, first long, n long")
        return bytes(A.read_files(self.inner, ask).first()["bytes"])

    def read(self, path: str) -> bytes:
        return self.range(path, 0, self._size(path))

    def open(self, path: str) -> File:
        return File(self, path, self._size(path))


def pack(input: str, output: str, base: str | None = None, compression: str = "lz4", block: int | None = 65536, params: tuple | None = None) -> None:
    """Packs a folder into an archive, on another one if given."""
    catalog, archive_id = _place(output)
    parent = None
    if base:
        there, name = _place(base)
        if there.root != catalog.root:
            there.send(catalog, [name])
        parent = catalog.open(name)
    config = A.PackConfig(archive_id, None if params else block, chunking.ChunkParams(*params) if params else None, compression)
    catalog.save(A.pack(sources.folder(catalog.spark, input), config, parent))

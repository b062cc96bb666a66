"""Helpers shared by the operators of this package."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MASK64 = (1 << 64) - 1


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Texts to an Arrow batch, as some are long.
TEXTS = 1000


def small_batches(spark: SparkSession) -> None:
    """From now on, Arrow batches of the session hold TEXTS rows at most."""
    if not 0 < int(spark.conf.get(BATCH)) <= TEXTS:
        spark.conf.set(BATCH, str(TEXTS))


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str]) -> DataFrame:
    """The named columns of an input table, and no others; to be read with small Arrow batches."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def shared_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share, as spark.checkpoint.dir names it.

    A machine-local folder is used only where the setting is absent and the
    master is local, which is the case in single-machine tests.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        current = sc._jsc.sc().getCheckpointDir()
        if not current.isDefined() and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = current.get() if current.isDefined() else f"file://{tempfile.mkdtemp(prefix='loomstone-')}"
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame, batch_rows: int | None = None) -> DataFrame:
    """The same rows read from reliable checkpoint files: lineage ends here.

    batch_rows: rows to an Arrow batch meanwhile, for Python code that is given long values.
    """
    spark = df.sparkSession
    shared_dir(spark)
    before = spark.conf.get(BATCH)
    if batch_rows and not 0 < int(before) <= batch_rows:
        spark.conf.set(BATCH, str(batch_rows))
    try:
        return df.checkpoint(eager=True)
    finally:
        spark.conf.set(BATCH, before)


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/loomstone/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str, path: str | None = None) -> tuple[DataFrame, str]:
    """The same rows from a table written in the shared folder, and its path.

    Unlike a checkpoint, it tells the planner its true size: the estimates of a loop's joins are products
    of products, which take the driver longer and longer to write down.
    """
    path = path or scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Removes a table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


# --- words as arrays -------------------------------------------------------

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """Hashes all words of a batch of texts at once.

    A word's hash is a polynomial over its bytes modulo 2**64, taken as a
    difference of prefix sums and shifted back by the inverse of the base, then
    finalised: it depends on the word's bytes only.
    """

    BASE = 0x9E3779B97F4A7C15
    LEAST = 1 << 16

    def __init__(self) -> None:
        inverse = pow(self.BASE, -1, 1 << 64)
        self.base, self.inverse = np.uint64(self.BASE), np.uint64(inverse)
        self.pow = self.inv = np.ones(1, np.uint64)
        self.letters = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def _reach(self, n: int) -> None:
        if len(self.pow) < n:
            n = max(n, self.LEAST)
            for name, b in (("pow", self.base), ("inv", self.inverse)):
                a = np.full(n, b, np.uint64)
                a[0] = 1
                setattr(self, name, np.cumprod(a, dtype=np.uint64))

    def spans(self, buf: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes as an array, and the words' starts and ends; buf ends with white space."""
        a = np.frombuffer(buf, np.uint8)
        gap = SPACE[a]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if len(a) and not gap[0]:
            edge = np.concatenate(([0], edge))
        return a, edge[0::2], edge[1::2]

    def hashes(self, buf: bytes, prefixes: tuple = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, start and end of each word; with prefixes, rows of hashes: of the words, then of their first bytes, so many at most."""
        a, start, end = self.spans(buf)
        self._reach(len(a) + 1)
        sums = np.zeros(len(a) + 1, np.uint64)
        np.cumsum(self.letters[a] * self.pow[: len(a)], out=sums[1:])
        of = lambda stop: mix((sums[stop] - sums[start]) * self.inv[start])
        found = of(end)
        return (np.stack([found, *(of(np.minimum(start + n, end)) for n in prefixes)]) if prefixes else found), start, end


def pieces(texts: list, most: int = 1 << 19):
    """Slices (first, last) of a list of byte strings, each of about `most` bytes."""
    first = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= most:
            yield first, i + 1
            first, total = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def as_bytes(column) -> list[bytes]:
    """UTF-8 of an Arrow string column, nulls as empty."""
    return [x or b"" for x in column.cast("binary").to_pylist()]


def joined(texts: list[bytes], lower: bool = True) -> tuple[bytes, np.ndarray]:
    """The texts with a newline after each, A-Z in lower case if wished, and where each begins (and the end)."""
    buf = b"\n".join(texts) + b"\n"
    ends = np.cumsum([len(t) + 1 for t in texts])
    return (buf.lower() if lower else buf), np.concatenate(([0], ends))

"""Cutting file contents into blocks: at fixed places, or where the content says.

files: path, stream, content (binary). Blocks come as path, stream, seq (from 0),
start (in the file), content.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.functions import codecs
from loomstone.functions import columns as C


@dataclass(frozen=True)
class ChunkParams:
    """Least, mean and greatest chunk size in bytes."""

    least: int = 16 << 10
    mean: int = 64 << 10
    most: int = 256 << 10

    def __post_init__(self):
        if not 0 < self.least < self.mean < self.most:
            raise ValueError("0 < least < mean < most")

    @property
    def bits(self) -> int:
        return round(np.log2(self.mean))


def resolve_params(explicit: tuple | None = None, inherited: ChunkParams | None = None, modelled: tuple | None = None) -> ChunkParams:
    """Explicit sizes first (None for one leaves it to what follows), then those of the base, then modelled (f, m, z), then the defaults."""
    base = inherited or (ChunkParams(modelled[1], 1 << modelled[0], modelled[2]) if modelled else ChunkParams())
    if explicit is None:
        return base
    return ChunkParams(*(a if a is not None else b for a, b in zip(explicit, (base.least, base.mean, base.most), strict=True)))


def fixed_blocks(files: DataFrame, block: int = 65536) -> DataFrame:
    """Blocks of `block` bytes, the last of a file shorter; empty files have none."""
    at = files.select(*(c for c in files.columns), F.explode(C.cuts(F.octet_length("content"), block)).alias("seq"))
    return at.select(*(c for c in files.columns if c != "content"), "seq", (F.col("seq").cast("long") * block).alias("start"), C.block_at("content", "seq", block).alias("content"))


# A fixed table of 64-bit numbers, one for each byte, by the splitmix64 rule from seed 0.
def gear_table() -> np.ndarray:
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


GEAR = gear_table()


#: Bytes that the hash of a place covers.
REACH = 64


def places(data: bytes, p: ChunkParams) -> tuple[np.ndarray, np.ndarray]:
    """Where the stricter and the laxer test of the rolling gear hash hold, as ends of chunks.

    The hash of a place covers the REACH bytes before it, so it does not depend on
    where the chunk began: all places are tested at once.
    """
    # h[i] = sum of GEAR[data[i - k]] << k: built by doubling, 1, 2, 4, ... bytes
    h = GEAR[np.frombuffer(data, np.uint8)]
    for shift in (1, 2, 4, 8, 16, 32):
        more = h.copy()
        more[shift:] += h[:-shift] << np.uint64(shift)
        h = more
    strict = np.flatnonzero((h >> np.uint64(64 - min(63, p.bits + 2))) == 0) + 1
    lax = np.flatnonzero((h >> np.uint64(64 - max(1, p.bits - 2))) == 0) + 1
    return strict, lax


def next_end(strict: np.ndarray, lax: np.ndarray, at: int, n: int, p: ChunkParams) -> int:
    """The end of the chunk that begins at a place with n - at > p.least bytes from there on: a strict place up to the mean size, else a lax one."""
    middle, last = min(at + p.mean, n), min(at + p.most, n)
    i = np.searchsorted(strict, at + p.least)
    if i < len(strict) and strict[i] <= middle:
        return int(strict[i])
    i = np.searchsorted(lax, max(middle, at + p.least))
    return int(lax[i]) if i < len(lax) and lax[i] <= last else last


def cut_points(data: bytes, p: ChunkParams) -> list[int]:
    """Ends of the chunks of a whole file."""
    n = len(data)
    if not n:
        return []
    strict, lax = places(data, p)
    out, at = [], 0
    while n - at > p.least:
        at = next_end(strict, lax, at, n, p)
        out.append(at)
    if at < n:
        out.append(n)
    return out


def stream_chunks(read, p: ChunkParams, buffer: int = 1 << 20):
    """The chunks of a file of any length, the same that cut_points gives; read(n) gives its next bytes, none at its end.

    No more than about twice the greatest chunk, or twice `buffer`, is held.
    """
    data, at, ended = b"", 0, False
    while True:
        while not ended and len(data) - at < 2 * max(p.most, buffer):
            more = read(max(p.most, buffer))
            ended = not more
            data += more
        if at == len(data):
            return
        strict, lax = places(data, p)
        # REACH bytes before the chunk are kept, so that hashes are those of the whole file
        while len(data) - at >= p.most or (ended and at < len(data)):
            end = next_end(strict, lax, at, len(data), p) if len(data) - at > p.least else len(data)
            yield data[at:end]
            at = end
        first = max(0, at - REACH)
        data, at = data[first:], at - first


def content_blocks(files: DataFrame, params: ChunkParams = ChunkParams()) -> DataFrame:
    """Blocks cut by content. A file is one row and is cut whole within its task; files are spread over tasks, and come to Python a few at a time."""
    codecs.small_batches(files.sparkSession)
    keep = [c for c in files.columns if c != "content"]

    def run(batches):
        for batch in batches:
            contents = batch.column("content").to_pylist()
            rows, seq, start, parts = [], [], [], []
            for i, data in enumerate(contents):
                at = 0
                for k, end in enumerate(cut_points(data or b"", params)):
                    rows.append(i)
                    seq.append(k)
                    start.append(at)
                    parts.append(data[at:end])
                    at = end
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in keep), pa.array(seq, pa.int32()), pa.array(start, pa.int64()), pa.array(parts, pa.binary())], [*keep, "seq", "start", "content"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema if f.name != "content"), "seq int, start long, content binary"])
    return files.select(*keep, "content").mapInArrow(run, schema)


def stream_stats(blocks: DataFrame) -> DataFrame:
    """chunks, unique_chunks, total_bytes, unique_bytes of blocks with content; identity is the whole digest."""
    per = blocks.select(C.hash_expr(F.col("content")).alias("hash"), F.octet_length("content").cast("long").alias("n")).groupBy("hash").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("n"), F.sum("n").alias("all"))
    return per.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("chunks"), F.count(F.lit(1)).alias("unique_chunks"), F.coalesce(F.sum("all"), F.lit(0)).alias("total_bytes"), F.coalesce(F.sum("n"), F.lit(0)).alias("unique_bytes"))

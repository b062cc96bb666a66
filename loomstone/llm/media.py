"""PNG images in binary columns: encoding, checked decoding and perceptual hashes."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import as_bytes

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def filtered(rows: np.ndarray, bpp: int = 1) -> np.ndarray:
    """(5, height, stride) bytes: the rows under each filter of PNG (none, sub, up, average, Paeth)."""
    up, left, corner = np.zeros_like(rows), np.zeros_like(rows), np.zeros_like(rows)
    up[1:], left[:, bpp:], corner[1:, bpp:] = rows[:-1], rows[:, :-bpp], rows[:-1, :-bpp]
    mean = ((left.astype(np.int16) + up) >> 1).astype(np.uint8)
    return np.stack([rows, rows - left, rows - up, rows - mean, rows - paeth(left, up, corner)])


def paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of left, above and above left the one nearest to a + b - c, the first of equals."""
    x, y, z = a.astype(np.int16), b.astype(np.int16), c.astype(np.int16)
    pa_, pb, pc = np.abs(y - z), np.abs(x - z), np.abs(x + y - 2 * z)
    return np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))


def encode_png(rows: np.ndarray, filters: int | tuple = 0, level: int = 3) -> bytes:
    """An 8-bit greyscale PNG of a (height, width) array. filters: one for all rows, or those of which each row gets the one with the least sum of distances from 0."""
    height, width = rows.shape
    lines = np.empty((height, width + 1), np.uint8)
    allowed = (filters,) if isinstance(filters, int) else filters
    if not set(allowed) <= set(range(5)):
        raise ValueError(f"no encoder for filters {filters}")
    if allowed == (0,):
        lines[:, 0], lines[:, 1:] = 0, rows
    else:
        ways = filtered(rows)[list(allowed)]
        best = np.abs(ways.view(np.int8).astype(np.int16)).sum(axis=2).argmin(axis=0)
        lines[:, 0] = np.array(allowed, np.uint8)[best]
        lines[:, 1:] = ways[best, np.arange(height)]
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def chunks_of(data: bytes):
    """(kind, content) of each chunk; ValueError if the file is cut short or a checksum is wrong."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at = 8
    while at < len(data):
        if at + 12 > len(data):
            raise ValueError("chunk cut short")
        (n,) = struct.unpack_from(">I", data, at)
        kind, content = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if len(content) < n or at + 12 + n > len(data):
            raise ValueError("chunk cut short")
        if struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(kind + content):
            raise ValueError(f"wrong checksum in {kind!r}")
        yield kind, content
        if kind == b"IEND":
            return
        at += 12 + n
    raise ValueError("no IEND")


def _sums(lines: np.ndarray, types: np.ndarray, above: np.ndarray, bpp: int) -> np.ndarray:
    """Rows with the filters none, sub and up, all at once: a row under `up` is a sum of rows from the last one that is not."""
    x = lines.copy()
    sub = types == 1
    if sub.any():
        x[sub] = np.cumsum(x[sub].reshape(sub.sum(), -1, bpp), axis=1, dtype=np.uint8).reshape(sub.sum(), -1)
    if not (types == 2).any():
        return x
    total = np.cumsum(np.vstack((above[None], x)), axis=0, dtype=np.uint8)
    # row r is total[r + 1] less what stood before the row that its sum begins with; a sum may begin with the row above all
    begin = np.maximum.accumulate(np.where(types == 2, 0, np.arange(1, len(x) + 1)))
    before = np.where((begin > 0)[:, None], total[np.maximum(begin - 1, 0)], 0)
    return total[1:] - before


def _waves(lines: np.ndarray, types: np.ndarray, above: np.ndarray, bpp: int) -> np.ndarray:
    """Rows with the filters average and Paeth: all places of a diagonal together, as each needs only those left and above."""
    height, width = len(lines), lines.shape[1] // bpp
    out = np.zeros((height + 1, width + 1, bpp), np.uint8)  # a row and a column of zeros or of what is above
    out[0, 1:] = above.reshape(width, bpp)
    src, mean = lines.reshape(height, width, bpp), (types == 3)[:, None]
    for d in range(height + width - 1):
        r = np.arange(max(0, d - width + 1), min(height, d + 1))
        i = d - r
        a, b, c = out[r + 1, i], out[r, i + 1], out[r, i]
        out[r + 1, i + 1] = src[r, i] + np.where(mean[r], ((a.astype(np.int16) + b) >> 1).astype(np.uint8), paeth(a, b, c))
    return out[1:, 1:].reshape(height, -1)


def unfilter(lines: np.ndarray, types: np.ndarray, bpp: int) -> np.ndarray:
    """Undoes the row filters of PNG on (height, stride) bytes."""
    if (types > 4).any():
        raise ValueError(f"unknown filter {types[types > 4][0]}")
    out, above = np.empty_like(lines), np.zeros(lines.shape[1], np.uint8)
    edges = [0, *(np.flatnonzero(np.diff((types >= 3).astype(np.int8))) + 1).tolist(), len(types)]
    for first, last in zip(edges[:-1], edges[1:], strict=True) if len(types) else ():
        f = _waves if types[first] >= 3 else _sums
        out[first:last] = f(lines[first:last], types[first:last], above, bpp)
        above = out[last - 1]
    return out


def decode_png(data: bytes) -> np.ndarray:
    """Samples of an 8-bit PNG without interlace: (height, width) grey or (height, width, channels)."""
    head, body = None, []
    for kind, content in chunks_of(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", content)
        elif kind == b"IDAT":
            body.append(content)
    if head is None:
        raise ValueError("no IHDR")
    width, height, depth, colour, _, _, interlace = head
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or channels is None or interlace:
        raise ValueError("only 8-bit grey or colour without interlace is read")
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    if len(raw) != height * (width * channels + 1):
        raise ValueError("wrong amount of image data")
    lines = raw.reshape(height, -1)
    found = unfilter(lines[:, 1:], lines[:, 0], channels)
    return found if channels == 1 else found.reshape(height, width, channels)


SIDE, LOW = 32, 8
_k = np.arange(SIDE)
#: The first rows of the orthogonal cosine transform of size SIDE.
COSINES = np.cos(np.pi * (2 * _k[None, :] + 1) * _k[:LOW, None] / (2 * SIDE))


def _shrink(a: np.ndarray, axis: int) -> np.ndarray:
    """SIDE means over near-equal parts of an axis; a shorter axis is stretched."""
    n = a.shape[axis]
    if n < SIDE:
        return np.take(a, np.arange(SIDE) * n // SIDE, axis=axis)
    edges = np.arange(SIDE) * n // SIDE
    counts = np.diff(np.append(edges, n)).astype(float)
    return np.add.reduceat(a, edges, axis=axis) / (counts[:, None] if axis == 0 else counts)


def cosine_hash(samples: np.ndarray) -> str:
    """64 bits as hex: which of the 8 x 8 lowest cosine coefficients exceed their median, the mean's own left out of it."""
    grey = samples.astype(float) if samples.ndim == 2 else samples[..., : max(1, samples.shape[2] // 2 * 2 - 1)].mean(axis=2)
    low = COSINES @ _shrink(_shrink(grey, 0), 1) @ COSINES.T
    flat = np.round(low.ravel(), 6)
    return np.packbits(flat > np.median(flat[1:])).tobytes().hex()


#: Filters of which each row of a stored text gets one: those that are undone for all rows at once.
FILTERS = (0, 1, 2)


def store(data: bytes) -> bytes:
    """The bytes, padded with 0 to a positive multiple of WIDTH, as an image."""
    size = max(WIDTH, -(-len(data) // WIDTH) * WIDTH)
    return encode_png(np.frombuffer(data.ljust(size, b"\0"), np.uint8).reshape(-1, WIDTH), FILTERS)


STORED = "doc_id long, n_bytes long, media binary"
MEDIA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _encoded(batches):
    for batch in batches:
        texts = as_bytes(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in texts], pa.int64()), pa.array([store(x) for x in texts], pa.binary())], ["doc_id", "n_bytes", "media"])


def encode_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) for each row of `docs` (doc_id, text; other columns are ignored): the text in UTF-8 (null: empty) as a PNG in a binary column.

    The payload is the text with bytes 0 appended up to a positive multiple of 64, one image row for each 64 bytes.
    Equal texts give equal images; repeated and null doc_ids stay; an empty table gives none.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_encoded, STORED)


def _described(batches):
    names = [x.split()[0] for x in MEDIA.split(", ")]
    types = [pa.string() if "string" in x else pa.int64() for x in MEDIA.split(", ")]
    for batch in batches:
        rows = []
        for n, media in zip(batch.column("n_bytes").to_pylist(), batch.column("media").to_pylist(), strict=True):
            if media is None:
                rows.append((n, *[None] * (len(names) - 1)))
                continue
            samples = decode_png(media)
            payload = samples.tobytes()
            rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), cosine_hash(samples)))
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["doc_id", *names])


def describe(images: DataFrame) -> DataFrame:
    """Reads each image of `images` (doc_id, n_bytes, media; other columns are ignored) back, and gives its payload's digests and its cosine hash.

    A null image gives nulls, a damaged one is an error; rows that repeat are described each time, and an empty
    table gives none. Each row is handled alone, so memory follows the longest text.
    """
    return images.select("doc_id", "n_bytes", "media").mapInArrow(_described, "doc_id long, " + MEDIA)

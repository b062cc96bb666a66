"""Column functions over block bytes, sizes, ranges and locations: all of them run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest answer to one range request.
HTTP_LIMIT = 32 << 20
UNITS = {"": 0, "K": 10, "M": 20, "G": 30, "T": 40}


def hash_expr(content: Column) -> Column:
    """Identity of a block: 64 lower-case hex digits."""
    return F.sha2(content, 256)


def is_zero(content: Column) -> Column:
    """Whether all bytes are 0; true for no bytes."""
    return F.hex(content) == F.repeat(F.lit("0"), 2 * F.octet_length(content))


def cuts(size: Column, block: int) -> Column:
    """Numbers of the fixed-size blocks of so many bytes."""
    n = F.floor((size - 1) / block).cast("int")
    return F.when(size > 0, F.sequence(F.lit(0), F.greatest(n, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def block_at(content: str, index: str, block: int) -> Column:
    return F.expr(f"substring(`{content}`, `{index}` * {block} + 1, {block})")


def parse_size(text: Column) -> Column:
    """Bytes of texts such as 64K, 1.5MB or 2g; null if it is none."""
    number = F.regexp_extract(F.upper(F.trim(text)), r"^(\d+(?:\.\d+)?)\s*([KMGT]?)B?$", 1)
    unit = F.regexp_extract(F.upper(F.trim(text)), r"^(\d+(?:\.\d+)?)\s*([KMGT]?)B?$", 2)
    scale = F.lit(1).cast("double")
    for name, bits in UNITS.items():
        if name:
            scale = F.when(unit == name, F.lit(float(1 << bits))).otherwise(scale)
    return F.when(number != "", (number.try_cast("double") * scale).cast("long"))


def parse_range(header: Column, size: Column) -> Column:
    """struct(first, last) of `bytes=a-[b]`; null for suffix, several or inverted ranges, and beyond the end."""
    first = F.regexp_extract(header, r"^bytes=(\d+)-(\d*)$", 1).try_cast("long")
    last = F.coalesce(F.regexp_extract(header, r"^bytes=(\d+)-(\d*)$", 2).try_cast("long"), size - 1)
    return F.when(first.isNotNull() & (first <= last) & (last < size), F.struct(first.alias("first"), last.alias("last")))


def http_plan(header: Column, size: Column) -> Column:
    """struct(status, first, last) of the answer to a request with or without a range; an empty stream and a bad range give 416."""
    found = F.when(header.isNull(), F.struct(F.lit(0).cast("long").alias("first"), (size - 1).alias("last"))).otherwise(parse_range(header, size))
    good = found.isNotNull() & (size > 0)
    last = F.least(found["last"], found["first"] + HTTP_LIMIT - 1, size - 1)
    return F.struct(F.when(good, 206).otherwise(416).alias("status"), F.when(good, found["first"]).alias("first"), F.when(good, last).alias("last"))


def parse_s3_url(url: Column) -> Column:
    """struct(bucket, prefix); prefix ends in / unless it is empty; null without a bucket."""
    bucket = F.regexp_extract(url, r"^s3://([^/]+)/?(.*)$", 1)
    prefix = F.regexp_replace(F.regexp_extract(url, r"^s3://([^/]+)/?(.*)$", 2), r"/+$", "")
    return F.when(bucket != "", F.struct(bucket.alias("bucket"), F.when(prefix == "", F.lit("")).otherwise(F.concat(prefix, F.lit("/"))).alias("prefix")))


def version_status(version: Column, low: int = 1, high: int = 1) -> Column:
    return F.when(version < low, "too_old").when(version > high, "too_new").otherwise("full")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def readable_size(size: Column) -> Column:
    """1536 as 1.5 KiB."""
    out = F.concat(size.cast("string"), F.lit(" B"))
    for name, bits in UNITS.items():
        if name:
            out = F.when(size >= (1 << bits), F.concat(F.format_number(size / float(1 << bits), 1), F.lit(f" {name}iB"))).otherwise(out)
    return out


# --- encryption --------------------------------------------------------------


def nonce(block_idx: Column) -> Column:
    """12 bytes: four of 0, then the block's number, big-endian."""
    return F.unhex(F.lpad(F.hex(block_idx.cast("long")), 24, "0"))


def encrypt(content: Column, key: Column, block_idx: Column) -> Column:
    """AES-GCM cipher text and tag. Never use a key for two contents of one number."""
    return F.substring(F.aes_encrypt(content, key, F.lit("GCM"), F.lit("DEFAULT"), nonce(block_idx)), 13, 2147483647)


def decrypt(sealed: Column, key: Column, block_idx: Column) -> Column:
    """The content, or null if the key, number or bytes are not right."""
    return F.try_aes_decrypt(F.concat(nonce(block_idx), sealed), key, F.lit("GCM"))


def xor(a: Column, b: Column) -> Column:
    """Arrays of numbers, xor-ed; an error if their lengths differ."""
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))).otherwise(F.raise_error(F.lit("lengths differ")).cast("array<int>"))


# --- the analytic model of deduplication ---------------------------------------

#: Parameters of the baseline: bits, least and greatest chunk, window, overhead.
BASELINE = {"f": 13, "m": 2048, "z": 65536, "w": 48, "v": 52}


def expected_length(f: Column, m: Column, z: Column) -> Column:
    """Mean chunk length: a cut falls at each place after m with probability 2^-f, at z at the latest."""
    p = F.pow(F.lit(2.0), -f)
    return m + (1 - p) / p * (1 - F.pow(1 - p, z - m))


def expected_duplicate(f: Column, m: Column, z: Column, w: Column, c: Column) -> Column:
    """Mean bytes of a chunk that stays a duplicate when each byte changes with probability c."""
    p = F.pow(F.lit(2.0), -f)
    q, d, n = 1 - p, 1 - c, z - m
    r = q * d
    series = m * (1 - F.pow(r, n)) / (1 - r) + r * (1 - n * F.pow(r, n - 1) + (n - 1) * F.pow(r, n)) / F.pow(1 - r, F.lit(2))
    return F.pow(d, m + w) * p * series + F.pow(q, n) * z * F.pow(d, z + w)


def change_rate(total: Column, unique: Column, f: Column, m: Column, z: Column) -> Column:
    return F.when(unique >= total, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), unique / (total * expected_length(f, m, z)))))


def predicted_ratio(total: Column, f: Column, m: Column, z: Column, w: Column, v: Column, c: Column) -> Column:
    """Stored share of `total` bytes, v bytes of overhead for each chunk counted in."""
    length = expected_length(f, m, z)
    saved = total * expected_duplicate(f, m, z, w, c) / length
    overhead = v * (total / length + 1)
    left = total - (saved - overhead)
    return F.when(left < 0, (total + overhead) / total).otherwise(left / total)

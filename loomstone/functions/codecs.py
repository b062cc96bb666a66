"""Codecs, transforms, keys and signatures that Spark has no functions for, in Arrow batches or on the driver."""

from __future__ import annotations

import hashlib
import hmac
import os

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes to an Arrow batch. By Spark's own measure a batch has up to 10000 rows or 64 MB, and Python holds it several times over.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 1 << 20


def small_batches(spark: SparkSession | None = None) -> None:
    """From now on, Arrow batches of the session (the active one, if none is given) hold about BATCH_BYTES at most, or one row."""
    spark = spark or SparkSession.getActiveSession()
    if spark and spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH)) > BATCH_BYTES:
        spark.conf.set(BATCH, str(BATCH_BYTES))


#: A length before each LZ4 block; longer ones than this are not unpacked.
LZ4_LIMIT = 128 << 20


def _lz4(data: bytes) -> bytes:
    return len(data).to_bytes(4, "little") + pa.Codec("lz4_raw").compress(data, asbytes=True)


def _unlz4(data: bytes) -> bytes:
    n = int.from_bytes(data[:4], "little")
    if n > LZ4_LIMIT:
        raise ValueError("block too long")
    return pa.Codec("lz4_raw").decompress(data[4:], n, asbytes=True) if n else b""


def codec(name: str, level: int = 3, dictionary: bytes | None = None):
    """(compress, decompress) on bytes for lz4 or zstd."""
    if name == "lz4":
        return _lz4, _unlz4
    if name == "zstd":
        given = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        c, d = zstandard.ZstdCompressor(level=level, dict_data=given), zstandard.ZstdDecompressor(dict_data=given)
        return c.compress, d.decompress
    raise ValueError(f"unknown codec {name!r}")


def _each(make):
    """A pandas UDF on binary columns; make() gives the function of one value, once for each batch."""
    small_batches()

    @F.pandas_udf(T.BinaryType())
    def run(s: pd.Series) -> pd.Series:
        f = make()
        return s.map(lambda x: None if x is None else f(bytes(x)))

    return run


def compress(name: str, level: int = 3, dictionary: bytes | None = None):
    codec(name)
    return _each(lambda: codec(name, level, dictionary)[0])


def decompress(name: str, level: int = 3, dictionary: bytes | None = None):
    codec(name)
    return _each(lambda: codec(name, level, dictionary)[1])


def train_dictionary(samples: list[bytes], size: int = 110 << 10) -> bytes:
    """A zstd dictionary; too few samples give an empty one."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _entropy(data: bytes) -> float:
    if not data:
        return 0.0
    n = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    p = n[n > 0] / len(data)
    return float(-(p * np.log2(p)).sum()) + 0.0


def entropy(column):
    """Bits for each byte over the histogram of bytes; 0 for no bytes."""
    small_batches()

    @F.pandas_udf(T.DoubleType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else _entropy(bytes(x)))

    return run(column)


def _shuffle(data: bytes, size: int, back: bool) -> bytes:
    n = len(data) // size * size
    if size <= 1 or n <= size:
        return data
    shape = (size, n // size) if back else (n // size, size)
    return np.frombuffer(data[:n], np.uint8).reshape(shape).T.tobytes() + data[n:]


def byte_shuffle(size: int):
    """First bytes of all elements, then second ones, and so on; what is left over stays at the end."""
    return _each(lambda: lambda x: _shuffle(x, size, False))


def byte_unshuffle(size: int):
    return _each(lambda: lambda x: _shuffle(x, size, True))


def _xor(a: bytes, b: bytes) -> bytes:
    if len(a) != len(b):
        raise ValueError("lengths differ")
    return (np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)).tobytes()


def xor_bytes(a, b):
    """Bytes of two columns, xor-ed; null where one is null, an error where their lengths differ."""
    small_batches()

    @F.pandas_udf(T.BinaryType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else _xor(bytes(x), bytes(y)) for x, y in zip(a, b, strict=True)], dtype=object)

    return run(a, b)


def keyed_hash(key: bytes):
    """HMAC-SHA256 of each value."""
    return _each(lambda: lambda x: hmac.new(key, x, hashlib.sha256).digest())


def derive_key(password: str, salt: bytes | None = None, iterations: int = 600_000) -> tuple[bytes, bytes]:
    """(32-byte key, salt) by PBKDF2-HMAC-SHA256; at least 100000 rounds and 8 bytes of salt."""
    salt = os.urandom(16) if salt is None else salt
    if iterations < 100_000 or len(salt) < 8:
        raise ValueError("too few iterations or too short a salt")
    return hashlib.pbkdf2_hmac("sha256", password.encode(), salt, iterations, 32), salt


# --- signatures, by the JVM of the driver ----------------------------------------


def keypair(spark: SparkSession) -> tuple[bytes, bytes]:
    """(private, public) Ed25519 keys in their standard encodings."""
    jvm = spark._jvm
    pair, factory = jvm.java.security.KeyPairGenerator.getInstance("Ed25519").generateKeyPair(), jvm.java.security.KeyFactory.getInstance("Ed25519")
    spec = lambda key, name: bytes(factory.getKeySpec(key, jvm.java.lang.Class.forName(f"java.security.spec.{name}")).getEncoded())
    return spec(pair.getPrivate(), "PKCS8EncodedKeySpec"), spec(pair.getPublic(), "X509EncodedKeySpec")


def sign(spark: SparkSession, private: bytes, digest: bytes) -> bytes:
    jvm = spark._jvm
    key = jvm.java.security.KeyFactory.getInstance("Ed25519").generatePrivate(jvm.java.security.spec.PKCS8EncodedKeySpec(bytearray(private)))
    s = jvm.java.security.Signature.getInstance("Ed25519")
    s.initSign(key)
    s.update(bytearray(digest))
    return bytes(s.sign())


def verify(spark: SparkSession, public: bytes, digest: bytes, signature: bytes) -> bool:
    jvm = spark._jvm
    key = jvm.java.security.KeyFactory.getInstance("Ed25519").generatePublic(jvm.java.security.spec.X509EncodedKeySpec(bytearray(public)))
    s = jvm.java.security.Signature.getInstance("Ed25519")
    s.initVerify(key)
    s.update(bytearray(digest))
    try:
        return bool(s.verify(bytearray(signature)))
    except Exception as e:  # a malformed signature is raised, not answered
        if "SignatureException" in str(e):
            return False
        raise

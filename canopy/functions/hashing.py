"""Digests: md5 in the JVM, or the 128-bit XXH3 in Arrow batches, both as lower-case hex."""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ALGORITHMS = ("md5", "xxh3")
NO_HASH = "0" * 32


def xxh3_hex(data: bytes) -> str:
    """Hex of the digest's little-endian bytes."""
    import xxhash

    return xxhash.xxh3_128_digest(data)[::-1].hex()


def new_digest(algorithm: str):
    """A digest that takes bytes piece by piece."""
    import hashlib

    import xxhash

    return hashlib.md5() if algorithm == "md5" else xxhash.xxh3_128()


def digest_hex(digest, algorithm: str) -> str:
    return digest.hexdigest() if algorithm == "md5" else digest.digest()[::-1].hex()


@F.pandas_udf(T.StringType())
def _xxh3(data):
    return data.map(lambda x: None if x is None else xxh3_hex(bytes(x)))


def content_hash(data: Column, algorithm: str = "md5") -> Column:
    return F.md5(data) if algorithm == "md5" else _xxh3(data)


def target_hash(target: Column, algorithm: str = "md5") -> Column:
    """Hash of a link's target; zeros without one."""
    return F.coalesce(content_hash(target.cast("binary"), algorithm), F.lit(NO_HASH))


def hex_lower(data: Column) -> Column:
    return F.lower(F.hex(data))


def child_token(c) -> bytes:
    """A directory's child in binary: name, 0, kind, 16 bytes of hash, and the metadata, little-endian."""
    kind = {"file": 0, "directory": 1, "symlink": 2}[c["kind"]]
    own = bytes.fromhex(c["h"] or NO_HASH)
    numbers = struct.pack("<IIIqIQ", c["permissions"], c["uid"], c["gid"], c["mtime_sec"], c["mtime_nsec"], c["size"] if kind == 0 else 0)
    return c["name"].encode() + b"\0" + bytes([kind]) + own + numbers


@F.pandas_udf(T.StringType())
def xxh3_of_children(children):
    return children.map(lambda rows: xxh3_hex(b"".join(map(child_token, rows))))

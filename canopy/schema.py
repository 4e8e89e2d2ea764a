"""Tables of the engine: flat columns, so that filters and pruning reach the files."""

from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "binary": T.BinaryType()}


def _struct(fields: str) -> T.StructType:
    """A struct from "name type, ..."; unlike Spark's own parser this needs no session."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (f.split() for f in fields.split(", "))])


SNAPSHOT = _struct(
    "path string, kind string, size bigint, mtime_sec bigint, mtime_nsec int, permissions int, uid bigint, gid bigint, hash string, symlink_target string, dir_hash string"
)
#: op: removed, added or modified. A null new_* of a modification means "keep".
CHANGES = _struct(
    "path string, op string, old_kind string, new_kind string, has_content boolean, new_size bigint, new_mtime_sec bigint, new_mtime_nsec int, new_permissions int, new_uid bigint, new_gid bigint, new_hash string, new_symlink_target string"
)
#: A piece of a file's bytes; a file may have many, in any order.
CONTENT = _struct("path string, chunk_index int, frag_no int, offset bigint, length bigint, bytes binary")
DISCREPANCIES = _struct("path string, category string, detail string")

KINDS = ("file", "directory", "symlink")
METADATA = ("size", "mtime_sec", "mtime_nsec", "permissions", "uid", "gid")
FORMAT_VERSION = 2

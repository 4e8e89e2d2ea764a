"""Directory trees as a Spark data source: spark.read.format("tree").option("root", ...).load().

Entries are read without following links. Subtrees are read in parallel: the plan lists the upper
levels, and each partition walks some of the directories below, or a share of a wide one. Executors
must see the same files.
What can't be read is left out and, with option errors=rows, shows as a row of kind 'error'.
"""

from __future__ import annotations

import os
import stat
from itertools import islice
from zlib import crc32

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition, StringStartsWith

from ..errors import InvalidRoot
from ..functions.hashing import digest_hex, new_digest
from ..schema import SNAPSHOT

READ = 1 << 20
#: The plan lists no directory of more entries; tasks do, each for its share of the names.
LISTED = 256


def file_hash(path: str, algorithm: str) -> str:
    h = new_digest(algorithm)
    with open(path, "rb") as f:
        while block := f.read(READ):
            h.update(block)
    return digest_hex(h, algorithm)


def entry(root: str, path: str, algorithm: str | None) -> tuple | None:
    """A snapshot row, or None for what is neither file, directory nor link."""
    full = os.path.join(root, path) if path else root
    s = os.lstat(full)
    kind = "file" if stat.S_ISREG(s.st_mode) else "directory" if stat.S_ISDIR(s.st_mode) else "symlink" if stat.S_ISLNK(s.st_mode) else None
    if kind is None:
        return None
    sec, nsec = divmod(s.st_mtime_ns, 1_000_000_000)
    own = file_hash(full, algorithm) if kind == "file" and algorithm else None
    return path, kind, s.st_size if kind == "file" else 0, sec, nsec, s.st_mode & 0o777, s.st_uid, s.st_gid, own, os.readlink(full) if kind == "symlink" else None, None


class Subtrees(InputPartition):
    """shallow: paths of entries; deep: (directory, share, shares), of which all below is read."""

    def __init__(self, shallow: list[str], deep: list[tuple[str, int, int]]):
        self.shallow, self.deep = shallow, deep


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        root = options.get("root") or options.get("path") or ""
        if not os.path.isdir(root):
            raise InvalidRoot(f"not a directory: {root!r}")
        self.root = os.path.realpath(root)
        self.algorithm = {"none": None}.get(a := options.get("hash", "md5").lower(), a)
        self.partitions_wanted = int(options.get("partitions", 32))
        self.errors = options.get("errors", "skip").lower() == "rows"
        self.prefix = ""

    def pushFilters(self, filters):
        """Path prefixes and equal paths limit which subtrees are walked; Spark still applies them."""
        for f in filters:
            if isinstance(f, (StringStartsWith, EqualTo)) and f.attribute == ("path",) and isinstance(f.value, str) and len(f.value) > len(self.prefix):
                self.prefix = f.value
            yield f

    def may_hold(self, path: str, deep: bool) -> bool:
        """Whether path, or something below it, can begin with the prefix."""
        return path.startswith(self.prefix) or (deep and (path == "" or self.prefix.startswith(path + "/")))

    def partitions(self):
        shallow, frontier, lost, wide = [""], [""], [], []
        while frontier and len(frontier) < 4 * self.partitions_wanted:
            below = []
            for d in frontier:
                try:
                    with os.scandir(os.path.join(self.root, d)) as it:
                        found = [(e.name, e.is_dir(follow_symlinks=False)) for e in islice(it, LISTED + 1)]
                except OSError:
                    lost.append(d)  # a task tries again, and reports it
                    continue
                if len(found) > LISTED:
                    wide.append(d)
                    continue
                for name, is_dir in found:
                    path = f"{d}/{name}" if d else name
                    if self.may_hold(path, is_dir):
                        shallow.append(path)
                        if is_dir:
                            below.append(path)
            frontier = below
        whole = [(d, 0, 1) for d in frontier + lost]
        shares = -(-4 * self.partitions_wanted // max(1, len(whole) + len(wide)))
        deep = whole + [(d, i, shares) for d in wide for i in range(shares)]
        n = max(1, min(self.partitions_wanted, len(shallow) + len(deep)))
        return [Subtrees(shallow[i::n], deep[i::n]) for i in range(n)]

    def read(self, partition):
        def rows(path):
            try:
                row = entry(self.root, path, self.algorithm)
                if row is not None and self.may_hold(path, False):
                    yield row
            except OSError as e:
                if self.errors:
                    yield path, "error", 0, 0, 0, 0, 0, 0, None, str(e), None

        for path in partition.shallow:
            yield from rows(path)
        todo = list(partition.deep)
        while todo:
            d, share, shares = todo.pop()
            try:
                with os.scandir(os.path.join(self.root, d)) as it:
                    found = [(e.name, e.is_dir(follow_symlinks=False)) for e in it if shares == 1 or crc32(os.fsencode(e.name)) % shares == share]
            except OSError as e:
                if self.errors and share == 0:
                    yield d, "error", 0, 0, 0, 0, 0, 0, None, str(e), None
                continue
            for name, is_dir in found:
                path = f"{d}/{name}" if d else name
                if self.may_hold(path, is_dir):
                    yield from rows(path)
                    if is_dir:
                        todo.append((path, 0, 1))


class TreeSource(DataSource):
    @classmethod
    def name(cls):
        return "tree"

    def schema(self):
        return SNAPSHOT

    def reader(self, schema):
        return TreeReader(self.options)


def register(spark) -> None:
    """Make the format known to the session, and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TreeSource)


def contents(paths, root: str, fragment: int = 32 << 20):
    """CONTENT rows (chunk_index 0) of the given files, read in pieces by the executors; paths: DataFrame (path)."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            for path in batch.path:
                with open(os.path.join(root, path), "rb") as f:
                    offset = n = 0
                    while (block := f.read(fragment)) or n == 0:
                        yield pd.DataFrame({"path": [path], "chunk_index": [0], "frag_no": [n], "offset": [offset], "length": [len(block)], "bytes": [block]})
                        offset, n = offset + len(block), n + 1

    return paths.select("path").mapInPandas(run, "path string, chunk_index int, frag_no int, offset bigint, length bigint, bytes binary")

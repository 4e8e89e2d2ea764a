"""The four commands: snapshot, diff, apply, verify, over Parquet tables or the record format."""

from __future__ import annotations

import os
import shutil
import time
import uuid
from collections.abc import Iterable, Iterator
from itertools import batched

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import storage
from .errors import FormatError, InvalidRoot, MissingChunk, VerificationFailed
from .functions import paths
from .functions.sizes import parse_size
from .operators import diff as diffs
from .operators import merkle, reuse, simulate, verify
from .operators.filesystem import TreeWriter
from .operators.split import PREFIX, chunk_name, split_plan
from .schema import CHANGES, FORMAT_VERSION, SNAPSHOT
from .sources import tree, wire


#: Records in a batch that a task hands to Spark.
BATCH = 5000


def arrow_rows(rows: Iterable[dict], schema: T.StructType) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(list(rows), to_arrow_schema(schema))


def detect_chunks(path: str) -> list[str]:
    """The file itself if it exists, else path.001, path.002, ...; a gap of any width is an error."""
    if os.path.isfile(path):
        return [path]
    folder, name = os.path.split(path)
    found = sorted(int(x.rpartition(".")[2]) for x in os.listdir(folder or ".") if x.rpartition(".")[0] == name and x.rpartition(".")[2].isdigit()) if os.path.isdir(folder or ".") else []
    if not found:
        raise MissingChunk(f"no diff at {path}")
    if found != list(range(1, len(found) + 1)):
        missing = sorted(set(range(1, found[-1] + 1)) - set(found))
        raise MissingChunk(f"missing chunks of {path}: {missing[:10]}")
    return [chunk_name(path, i) for i in found]


class Engine:
    def __init__(self, spark: SparkSession, algorithm: str = "md5", magics=(wire.MAGIC, wire.MAGIC_ZSTD)):
        self.spark, self.algorithm, self.magics = spark, algorithm, magics
        tree.register(spark)

    # tables

    def scan(self, root: str, previous: DataFrame | None = None, rehash: bool = False, partitions: int = 32) -> DataFrame:
        """The tree under root with hashes and directory hashes. Files whose size and second are those
        of `previous` keep its hash, unless `rehash`. What can't be read is left out."""
        return self.walk(root, previous, rehash, partitions)[0]

    def walk(self, root: str, previous: DataFrame | None = None, rehash: bool = False, partitions: int = 32) -> tuple[DataFrame, DataFrame]:
        """scan(), and all rows of the walk: with `reused`, and those of kind 'error'."""
        if not os.path.isdir(root):
            raise InvalidRoot(f"not a directory: {root!r}")
        read = self.spark.read.format("tree").option("root", root).option("partitions", partitions).option("errors", "rows")
        if previous is None or rehash:
            walked = read.option("hash", self.algorithm).load().withColumn("reused", F.lit(False))
        else:
            bare = storage.save(read.option("hash", "none").load(), "walk")
            known, todo = reuse.split_by_reuse(bare, storage.save(previous, "previous"))
            root_, algorithm = os.path.realpath(root), self.algorithm

            @F.pandas_udf("hash string, problem string")
            def hashed(path):
                import pandas as pd

                found = []
                for p in path:
                    try:
                        found.append((tree.file_hash(os.path.join(root_, p), algorithm), None))
                    except OSError as e:
                        found.append((None, str(e)))
                return pd.DataFrame(found, columns=["hash", "problem"])

            fresh = todo.withColumn("h", hashed("path")).withColumn("hash", F.col("h.hash")).withColumn("reused", F.lit(False))
            gone = F.col("h.problem").isNotNull()
            fresh = fresh.withColumn("kind", F.when(gone, "error").otherwise(F.col("kind"))).withColumn("symlink_target", F.when(gone, F.col("h.problem")).otherwise(F.col("symlink_target")))
            walked = known.select(*SNAPSHOT.names, "reused").unionByName(fresh.select(*SNAPSHOT.names, "reused"))
        walked = storage.save(walked, "walk")
        return merkle.with_dir_hashes(walked.where("kind <> 'error'").select(*SNAPSHOT.names), self.algorithm), walked

    def load_snapshot(self, path: str) -> DataFrame:
        """A Parquet snapshot, or a file in the record format."""
        if os.path.isfile(path):
            magics = self.magics
            rows = self.spark.createDataFrame([(path,)], "file string")

            def read(batches):
                for b in batches:
                    for p in b.column(0).to_pylist():
                        for part in batched(wire.read_entries(p, magics=magics), BATCH):
                            yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary())], ["entry"])

            def run(batches):
                for b in batches:
                    yield arrow_rows((wire.entry_row(wire.unpack(e)) for e in b.column(0).to_pylist()), SNAPSHOT)

            # One task reads the file and compares its checksum; entries are unpacked by many.
            packed = storage.in_arrow(rows, read, "entry binary").repartition(4 * self.spark.sparkContext.defaultParallelism)
            return storage.in_arrow(packed, run, SNAPSHOT)
        return self._table(path, "snapshot", SNAPSHOT)

    def _table(self, path: str, kind: str, schema) -> DataFrame:
        header = self.spark.read.json(f"{path}/header").first()
        if header["file_type"] != kind or header["version"] != FORMAT_VERSION:
            raise FormatError(f"{path} is a {header['file_type']} of version {header['version']}; needed is a {kind} of version {FORMAT_VERSION}")
        return self.spark.read.schema(schema).parquet(f"{path}/rows")

    def _header(self, path: str, kind: str, **more) -> None:
        fields = {"file_type": kind, "version": FORMAT_VERSION, **{k: v for k, v in more.items() if v is not None}}
        self.spark.range(1).select(*[F.lit(v).alias(k) for k, v in fields.items()]).write.mode("overwrite").json(f"{path}/header")

    def save_snapshot(self, snapshot: DataFrame, path: str, root: str | None = None, record_format: bool = False, compress: bool = False) -> None:
        ordered = snapshot.select(*SNAPSHOT.names).withColumn("_key", paths.components(F.col("path"))).orderBy("_key").drop("_key")
        if record_format:
            self._write_entries(ordered, path, root, compress)
        else:
            ordered.write.mode("overwrite").option("compression", "zstd" if compress else "snappy").parquet(f"{path}/rows")
            self._header(path, "snapshot", root=root)

    def _write_entries(self, ordered: DataFrame, path: str, root: str | None, compress: bool) -> None:
        """A snapshot file: tasks pack the records of their ranges into files beside it, which are
        then joined. The executors must see its folder."""
        own = f"{os.path.abspath(path)}-{uuid.uuid4().hex}"
        os.makedirs(own)

        def run(batches):
            at = f"{own}/{uuid.uuid4().hex}"
            with open(at, "wb") as f:
                for b in batches:
                    f.writelines(map(wire.entry_record, b.to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([at])], ["part", "file"])

        def blocks(parts):
            for _, at in parts:
                with open(at, "rb") as f:
                    while b := f.read(tree.READ):
                        yield b

        try:
            parts = sorted(map(tuple, storage.in_arrow(ordered, run, "part int, file string").collect()))
            wire.write_runs(path, blocks(parts), root, compress, magics=self.magics)
        finally:
            shutil.rmtree(own, ignore_errors=True)

    # commands

    def snapshot(self, root: str, out: str, previous: str | None = None, compress: bool = False, record_format: bool = False) -> dict:
        before = self.load_snapshot(previous) if previous else None
        found, walked = self.walk(root, before)
        self.save_snapshot(storage.save(found, "snapshot"), out, root, record_format, compress)
        return reuse.stats(walked).first().asDict()

    def diff(self, root: str, snapshot_in: str, diff_out: str, snapshot_out: str, split_size: str | int | None = None, compress: bool = False, mode: str = "strict", record_format: bool = False) -> dict:
        """Changes from the snapshot to the tree; both diff and new snapshot are written, the diff first."""
        old = storage.save(self.load_snapshot(snapshot_in), "old")
        new = storage.save(self.scan(root, old), "new")
        found = storage.save(diffs.with_sequence(diffs.changes(old, new, mode)), "changes")
        if record_format:
            limit = parse_size(split_size) if isinstance(split_size, str) else split_size
            source = tree.file_hash(snapshot_in, "xxh3") if os.path.isfile(snapshot_in) else "0" * 32
            self._write_records(found, os.path.realpath(root), diff_out, source, limit, compress)
        else:
            found.write.mode("overwrite").parquet(f"{diff_out}/rows")
            tree.contents(found.where("has_content"), os.path.realpath(root)).write.mode("overwrite").option("compression", "zstd" if compress else "snappy").parquet(f"{diff_out}/content")
            self._header(diff_out, "diff", source=self.snapshot_digest(old))
        self.save_snapshot(new, snapshot_out, root, record_format, compress)
        # Only reference mode leaves anything out; the other modes compare every row.
        return diffs.summary(found).first().asDict() | {"skipped": diffs.skipped(old, new).count() if mode == "reference" else 0}

    def snapshot_digest(self, snapshot: DataFrame) -> str:
        """The same for any order of the rows: a sum of row digests, so nothing is sorted or gathered."""
        row = F.conv(F.substring(F.md5(F.to_json(F.struct(*SNAPSHOT.names))), 1, 12), 16, 10).cast("decimal(20,0)")
        n, total = snapshot.agg(F.count(F.lit(1)), F.coalesce(F.sum(row), F.lit(0))).first()
        return f"{n:x}-{int(total):x}"

    def _write_records(self, found: DataFrame, root: str, out: str, source: str, limit: int | None, compress: bool) -> None:
        """The files of a diff, each written by one task, as the split plan says; a task that is run
        again writes its files anew. The executors must see the tree and the folder of the diff."""
        now, magics, out = int(time.time()), self.magics, os.path.abspath(out)
        numbered = limit is not None
        if found.isEmpty():
            if not numbered:
                with open(out, "wb") as f:
                    wire.RecordWriter(f, "diff", source_hash=source, compress=compress, magics=magics, created_at=now).finish()
            return
        names = CHANGES.names

        def packed(batches):
            import pandas as pd

            for b in batches:
                rows = [{k: None if v is None or v is pd.NA or v != v else v for k, v in zip(b.columns, r)} for r in b.astype(object).itertuples(index=False)]
                whole = [{k: int(v) if isinstance(v, float) else v for k, v in r.items()} for r in rows]
                payload = [wire.pack(wire.change_value(r)) for r in whole]
                yield pd.DataFrame({"seq": b.seq, "path": b.path, "payload": payload, "record_bytes": [PREFIX + len(p) for p in payload], "content_bytes": pd.array([r["new_size"] if r["has_content"] else None for r in whole], "Int64")})

        records = storage.save(found.select("seq", *names).mapInPandas(packed, "seq bigint, path string, payload binary, record_bytes bigint, content_bytes bigint"), "records")
        size = lambda chunk: 9 + len(wire.header_bytes("diff", source, None, chunk if numbered else None, now))
        plan = split_plan(records, size, limit if numbered else 1 << 62)
        change = F.col("item") == "change"
        items = storage.save(plan, "plan").join(records.select("seq", "path", "payload"), "seq").select("chunk_index", change.alias("first"), "seq", "offset", "length", F.when(change, F.col("payload")).alias("payload"), "path")
        blocks = self._blocks

        def write(batches):
            import pandas as pd

            now_at, writer, f, done = None, None, None, []

            def end():
                writer.finish()
                f.close()
                os.replace(f.name, chunk_name(out, now_at) if numbered else out)
                done.append(now_at)

            try:
                for b in batches:
                    for r in b.itertuples(index=False):
                        if r.chunk_index != now_at:
                            if writer is not None:
                                end()
                            now_at = int(r.chunk_index)
                            f = open(f"{out}-{uuid.uuid4().hex}", "wb")
                            writer = wire.RecordWriter(f, "diff", source_hash=source, chunk_index=now_at if numbered else None, compress=compress, magics=magics, created_at=now)
                        if r.first:
                            writer.record(wire.CHANGE, bytes(r.payload))
                        else:
                            with open(os.path.join(root, r.path), "rb") as content:
                                content.seek(int(r.offset))
                                writer.content(int(r.length), blocks(content, int(r.length), r.path))
                if writer is not None:
                    end()
            except BaseException:
                if f is not None and os.path.exists(f.name):
                    f.close()
                    os.unlink(f.name)
                raise
            yield pd.DataFrame({"chunk_index": done})

        dealt = items.repartition("chunk_index").sortWithinPartitions("chunk_index", F.desc("first"), "seq", "offset")
        dealt.mapInPandas(write, "chunk_index int").agg(F.count("chunk_index")).first()

    @staticmethod
    def _blocks(f, n: int, path: str) -> Iterator[bytes]:
        while n:
            b = f.read(min(n, 1 << 20))
            if not b:
                raise FormatError(f"{path} became shorter while it was read")
            n -= len(b)
            yield b

    def load_changes(self, diff: str) -> DataFrame:
        """All changes of a diff: a Parquet folder, or the chunks of the record format."""
        if os.path.isdir(diff):
            return self._table(diff, "diff", CHANGES)
        magics = self.magics
        chunks = detect_chunks(diff)
        files = self.spark.createDataFrame([(p,) for p in chunks], "file string")

        def run(batches):
            rows = (r for b in batches for p in b.column(0).to_pylist() for r in wire.read_changes(p, magics=magics))
            for part in batched(rows, BATCH):
                yield arrow_rows(part, CHANGES)

        # Small files share a task; their number grows with the diff.
        return storage.in_arrow(files.repartition(min(len(chunks), 4 * self.spark.sparkContext.defaultParallelism)), run, CHANGES)

    def apply(self, root: str, diff: str, source: DataFrame | None = None) -> dict:
        """Change the tree under root; with `source`, only if the diff was made from that snapshot."""
        if not os.path.isdir(root):
            raise InvalidRoot(f"not a directory: {root!r}")
        if source is not None and os.path.isdir(diff):
            made_from = self.spark.read.json(f"{diff}/header").first()["source"]
            if made_from != self.snapshot_digest(source):
                raise FormatError("the diff was made from another snapshot")
        changes = [r.asDict() for r in self.load_changes(diff).collect()]
        return TreeWriter(os.path.realpath(root)).apply(changes, self._content(diff))

    def _content(self, diff: str) -> Iterator[tuple[str, int, bytes]]:
        if os.path.isdir(diff):
            rows = self.spark.read.parquet(f"{diff}/content").select("path", "offset", "bytes").orderBy("path", "offset")
            for r in rows.toLocalIterator():
                yield r["path"], r["offset"], bytes(r["bytes"])
            return
        # Records of content follow the order of the changes; a file is over when its size is reached.
        waiting: list[tuple[str, int]] = []
        done = 0
        for path in detect_chunks(diff):
            with open(path, "rb") as f:
                reader = wire.RecordReader(f, self.magics).expect("diff")
                for kind, payload in reader.records(stream=True):
                    if kind == wire.CHANGE:
                        r = wire.change_row(wire.unpack(payload))
                        if r["has_content"]:
                            waiting.append((r["path"], r["new_size"]))
                        continue
                    if not waiting:
                        raise FormatError("content without a change")
                    name, size = waiting[0]
                    empty = True
                    for b in payload:  # a block at a time, whatever the record's length
                        yield name, done, b
                        done += len(b)
                        empty = False
                    if empty:
                        yield name, done, b""
                    if done >= size:
                        waiting.pop(0)
                        done = 0

    def verify(self, root: str, diff: str, snapshot: str, mode: str = "strict", trust_target: bool = False) -> DataFrame:
        """Discrepancies between the snapshot and the tree after the diff, without changing the tree.

        With `trust_target` the tree's files keep the target's hashes where size and second agree."""
        target = storage.save(self.load_snapshot(snapshot), "target")
        current = storage.save(self.scan(root, target if trust_target else None), "current")
        changes = storage.save(self.load_changes(diff), "changes")
        return verify.verify(current, changes, target, mode, self.algorithm)

    def check(self, *args, **options) -> None:
        lines = verify.line_count(self.verify(*args, **options)).first()["lines"]
        if lines:
            raise VerificationFailed(lines)

    def simulate(self, state: DataFrame, diff: str) -> DataFrame:
        return simulate.apply_changes(state, self.load_changes(diff))

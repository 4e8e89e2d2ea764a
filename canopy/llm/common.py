"""What the operators of this package share: tables, the shared folder, size checks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if it has at most this many rows and bytes; beyond, the join shuffles.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 16 << 20
#: What a batch between Spark and a Python worker holds at most, if the session sets no bound.
ARROW_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir).

    Unset, a session in one JVM gets a temporary folder of its own; a cluster is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="canopy-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def save(df: DataFrame, name: str) -> DataFrame:
    """Write df into the shared folder and read it back: lineage ends here, and a lost
    executor costs no more than re-reading a file."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/canopy-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._canopy_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a table written by save(), once nothing reads it any more."""
    path = getattr(df, "_canopy_path", None)
    if path:
        spark = df.sparkSession
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def small(df: DataFrame, bytes_per_row: Column | int = 64) -> bool:
    """Whether df, a written table or a cheap plan, is small enough for a broadcast."""
    size = bytes_per_row if isinstance(bytes_per_row, Column) else F.lit(bytes_per_row)
    n, b = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return n <= BROADCAST_ROWS and b <= BROADCAST_BYTES


def maybe_broadcast(df: DataFrame, bytes_per_row: Column | int = 64) -> DataFrame:
    return F.broadcast(df) if small(df, bytes_per_row) else df


def free(df: DataFrame, name: str) -> str:
    """name, or one like it that no column of df has."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = "_" + name
    return name


def lean(run):
    """A mapInArrow function whose Python worker stays small.

    Workers outlive their tasks. Arrays of several MB and Arrow's buffers are kept out of the C heap or
    handed back at once, and the heap is trimmed at the task's end. (Lower thresholds save no memory
    and cost page faults: with 64 KB, encoding pieces took 2.5 times as long.)"""

    def wrapped(batches):
        import ctypes
        from contextlib import suppress

        import pyarrow as pa

        libc = None
        with suppress(OSError, AttributeError):  # another C library than glibc
            libc = ctypes.CDLL("libc.so.6")
            libc.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD: fixed, else it grows with what was freed
            libc.mallopt(-1, 32 << 20)  # M_TRIM_THRESHOLD
            libc.mallopt(-8, 1)  # M_ARENA_MAX
        pa.set_memory_pool(pa.system_memory_pool())
        yield from run(batches)
        if libc is not None:
            libc.malloc_trim(0)

    return wrapped


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, where its session sends Python a few MB at a time, unless it has a bound of its own."""
    spark = df.sparkSession
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return df


def in_arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema) by lean workers over small batches."""
    return bounded_batches(df).mapInArrow(lean(run), schema)


def slices(batches, column: int, size: int = 1 << 20, fixed: int = 64):
    """The batches in slices of about `size` bytes of the text in `column`, and whole rows.

    fixed: what a row counts beside its text."""
    import pyarrow.compute as pc

    for batch in batches:
        begin, n = 0, batch.num_rows
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        while begin < n:
            end, room = begin, size
            while end < n and (end == begin or room >= lengths[end] + fixed):
                room -= lengths[end] + fixed
                end += 1
            yield batch.slice(begin, end - begin)
            begin = end


def search(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are <= key: a binary search whose expression is as long as the
    bounds' logarithm, over one literal array."""
    if not bounds:
        return F.lit(0)
    at = F.array(*[F.lit(b).cast("long") for b in bounds])
    place = F.lit(0)
    step = 1 << (len(bounds).bit_length() - 1)
    steps = []
    while step:
        steps.append(F.lit(step))
        step >>= 1
    # place is the number found so far; it moves on by a step if that many bounds are <= key.
    return F.aggregate(F.array(*steps), place, lambda n, s: F.when(F.get(at, n + s - 1) <= key, n + s).otherwise(n))

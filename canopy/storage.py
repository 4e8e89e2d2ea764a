"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Beyond this many rows, or bytes as Spark holds them, a side is not broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20
#: What a batch between Spark and a Python worker holds at most, if the session sets no bound.
ARROW_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="canopy-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def posix(uri: str) -> str:
    """The path of a file: URI or a plain path; other stores have no files to open."""
    scheme, colon, rest = uri.partition(":")
    if not colon or "/" in scheme:
        return uri
    if scheme != "file":
        raise ValueError(f"trees and record files need a mounted folder, not {uri}")
    return "/" + rest.lstrip("/")


def save(df: DataFrame, name: str, by: tuple = ()) -> DataFrame:
    """df written and read again: its lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/canopy-{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def maybe_broadcast(df: DataFrame) -> DataFrame:
    """df, a written or otherwise cheap table, marked for a broadcast if its rows and bytes are few."""
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) if t in ("string", "binary") else F.lit(0) for c, t in df.dtypes), F.lit(16 + 8 * len(df.columns)))
    n, b = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if n <= BROADCAST_ROWS and b <= BROADCAST_BYTES else df


def in_arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema) over batches of a few MB, unless the session has a bound of its own."""
    conf, bound = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(bound, None) is None:
        conf.set(bound, ARROW_BYTES)
    return df.mapInArrow(run, schema)

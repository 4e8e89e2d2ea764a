"""Following a stream of change batches: each round's snapshot is the input of the next.

An extension: change batches arrive as a stream of rows in the changes schema with `seq`; each
micro-batch is applied to the latest version of the state and written as a new version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import simulate
from ..schema import SNAPSHOT


class StateTable:
    """Versions of a snapshot under one folder, version=0, 1, ...; a version is written whole or not at all."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, at.getFileSystem(conf), at

    def versions(self) -> list[int]:
        jvm, fs, at = self._fs()
        if not fs.exists(at):
            return []
        names = [(s.getPath().getName(), s.getPath().toString()) for s in fs.listStatus(at)]
        return sorted(int(n.removeprefix("version=")) for n, p in names if n.startswith("version=") and fs.exists(jvm.org.apache.hadoop.fs.Path(p + "/_SUCCESS")))

    def read(self, version: int | None = None) -> DataFrame:
        found = self.versions()
        if not found:
            return self.spark.createDataFrame([], SNAPSHOT)
        return self.spark.read.schema(SNAPSHOT).parquet(f"{self.path}/version={found[-1] if version is None else version}")

    def write(self, snapshot: DataFrame, version: int) -> None:
        snapshot.select(*SNAPSHOT.names).write.mode("overwrite").parquet(f"{self.path}/version={version}")

    def apply_batch(self, changes: DataFrame, batch: int) -> None:
        """State after the batch as version batch + 1; a batch that is sent again gives the same version."""
        before = self.read(batch) if batch in self.versions() else self.read()
        self.write(simulate.apply_changes(before, changes), batch + 1)


def follow(stream: DataFrame, table: StateTable, checkpoint: str, **trigger):
    """Start applying a stream of changes; returns the streaming query."""
    writer = stream.writeStream.foreachBatch(lambda df, i: table.apply_batch(df, i)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def fold(state: DataFrame, batches: DataFrame, batch_col: str = "batch") -> DataFrame:
    """All batches at once: their order is the leading part of seq, so one reduction replaces a loop."""
    order = F.struct(F.col(batch_col), F.col("seq")) if "seq" in batches.columns else F.struct(F.col(batch_col), F.when(F.col("op") == "removed", 0).otherwise(1))
    return simulate.apply_changes(state, batches.withColumn("seq", order))

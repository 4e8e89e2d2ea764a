"""Sharding by histogram sort.

Rows get a 63-bit key: a hash of the text, then one of the row, so that equal texts stand together
and even a group of copies of any size can be split. Exact bytes below candidate key boundaries are
counted across all partitions; only the bins that hold a wanted splitter are probed again, more
finely, until each splitter is within tolerance or its bin is one key wide. Then the rows are
exchanged once, into blocks of which a number that grows with the rows makes a shard.

Cases: a null text has no bytes (size = 16, crc32 of the empty text); a null doc_id is kept like any
other; repeated rows share the upper 43 bits of the key but differ in the lower 20; a very long text
is a row of its size, and a shard may exceed the mean by the longest; an empty table gives an empty
result; extra columns are ignored by assign() and kept by write_shards() unless they take the name
of a result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Probes counted in one pass.
PROBES = 4096
#: Blocks of a shard, the unit of the one exchange and of numbering slots: so many at least, and
#: as many as keep their rows near this number.
BLOCKS, BLOCK_ROWS = 4, 200_000
TIE_BITS = 20


def keyed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, size, text_crc32 and the sort key of each row; with `carry` the whole row as `row`.

    The lower bits differ between repeated rows by a number of the row, so this is written before use."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    spread = F.shiftrightunsigned(F.xxhash64(text), 1 + TIE_BITS)
    tie = F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.monotonically_increasing_id()), 64 - TIE_BITS)
    return df.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 16).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.shiftleft(spread, TIE_BITS).bitwiseOR(tie).alias("key"),
        *([F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")] if carry else []),
    )


def splitters(rows: DataFrame, parts: int, tolerance: float = 0.002, probes: int = PROBES) -> list[int]:
    """The parts - 1 keys that cut rows (key, size) into parts of near equal bytes.

    What comes to the driver is at most `probes` sums a pass."""
    total, lo, hi = rows.agg(F.sum("size"), F.min("key"), F.max("key")).first()
    if total is None:
        return []
    want = [total * i // parts for i in range(1, parts)]
    allowed = max(1.0, tolerance * total / parts)
    found: dict[int, int] = {}
    # Open intervals: (first key, end, bytes below it, the wanted splitters inside)
    todo = [(lo, hi + 1, 0, list(range(parts - 1)))]
    while todo:
        todo.sort()
        each = max(2, probes // len(todo))
        width = [max(1, -(-(b - a) // each)) for a, b, _, _ in todo]
        starts, ends = [t[0] for t in todo], [t[1] for t in todo]
        at = common.search(F.col("key"), starts) - 1
        array = lambda values: F.array(*[F.lit(v) for v in values])
        sums = (
            rows.where((F.col("key") >= starts[0]) & (F.col("key") < ends[-1]))
            .withColumn("part", at)
            .where(F.col("key") < F.get(array(ends), F.col("part")))
            .withColumn("gap", F.col("key") - F.get(array(starts), F.col("part")))
            .withColumn("bin", F.call_function("div", F.col("gap"), F.get(array(width), F.col("part"))))
        )
        counted: dict[int, dict[int, int]] = {}
        for r in sums.groupBy("part", "bin").agg(F.sum("size").alias("b")).collect():
            counted.setdefault(r["part"], {})[r["bin"]] = r["b"]
        again = []
        for i, (a, b, below, inside) in enumerate(todo):
            bins = sorted(counted.get(i, {}).items())
            k, cum = 0, below
            open_: dict[int, tuple] = {}
            for s in inside:
                while k < len(bins) and cum + bins[k][1] < want[s]:
                    cum += bins[k][1]
                    k += 1
                if k == len(bins):
                    found[s] = b
                    continue
                first, weight = a + bins[k][0] * width[i], bins[k][1]
                end = min(b, first + width[i])
                if weight <= allowed or width[i] == 1:
                    found[s] = first if want[s] - cum <= cum + weight - want[s] else end
                else:
                    open_.setdefault(first, (first, end, cum, []))[3].append(s)
            again += open_.values()
        todo = again
    return [found[s] for s in range(parts - 1)]


def placed(rows: DataFrame, shards: int, tolerance: float) -> DataFrame:
    """rows of keyed(), written, with shard and slot: the one exchange is by block."""
    n = rows.count()
    each = max(BLOCKS, -(-n // (shards * BLOCK_ROWS)))
    bounds = splitters(rows, shards * each, tolerance * each)
    if not bounds:
        return rows.withColumn("shard", F.lit(0)).withColumn("slot", F.lit(0).cast("long"))
    rows = rows.withColumn("block", common.search(F.col("key"), bounds))
    sizes = {r["block"]: r["count"] for r in rows.groupBy("block").count().collect()}
    before, offsets = 0, []
    for i in range(shards * each):
        before = 0 if i % each == 0 else before
        offsets.append(before)
        before += sizes.get(i, 0)
    within = F.row_number().over(W.partitionBy("block").orderBy("key", "doc_id", "text_crc32"))
    offset = F.get(F.array(*[F.lit(x).cast("long") for x in offsets]), F.col("block"))
    return rows.withColumn("n", within).withColumn("shard", F.floor(F.col("block") / each).cast("int")).withColumn("slot", offset + F.col("n") - 1).drop("n")


def assign(df: DataFrame, shards: int = 40, tolerance: float = 0.002, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: every row once, slots gapless from 0."""
    rows = common.save(keyed(df, id_col, text_col), "shard-keys")
    return placed(rows, shards, tolerance).select("doc_id", "size", "text_crc32", "shard", "slot")


def write_shards(df: DataFrame, path: str, shards: int = 40, tolerance: float = 0.002, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the rows of df as one folder a shard, with their slots; returns the table written.

    Whole rows travel with their keys, so that the exchange by block is the only one and ids may be
    null or repeated."""
    rows = common.save(keyed(df, id_col, text_col, carry=True), "shard-rows")
    kept = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    out = placed(rows, shards, tolerance).select(*[F.col("row").getField(c).alias(c) for c in kept], "slot", "shard")
    out.write.partitionBy("shard").parquet(path)
    common.forget(rows)
    return df.sparkSession.read.schema(out.schema).parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    out = assign(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

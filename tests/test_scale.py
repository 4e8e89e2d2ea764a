"""Memory and tasks that must not grow with the tree, the snapshot or the number of a diff's files."""

import os

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy import storage
from canopy.engine import Engine
from canopy.plans import fixtures as fx
from canopy.sources import tree

ROWS = 12_000


def snapshot(spark, n=ROWS):
    name = F.concat(F.lit("d/f"), F.lpad(F.col("id").cast("string"), 6, "0"))
    return fx.snapshot_rows(spark.range(n).select(name.alias("path"), F.col("id").alias("size"), F.md5(F.col("id").cast("string")).alias("hash")))


@pytest.mark.parametrize("compress", [False, True])
def test_record_snapshot_is_packed_and_unpacked_by_tasks(spark, tmp_path, monkeypatch, compress):
    engine, path = Engine(spark), str(tmp_path / "snapshot")

    def refuse(*args, **options):
        raise AssertionError("rows sent to the driver")

    monkeypatch.setattr(DataFrame, "toLocalIterator", refuse)
    engine.save_snapshot(snapshot(spark), path, record_format=True, compress=compress)
    monkeypatch.undo()
    assert os.listdir(tmp_path) == ["snapshot"]
    got = engine.load_snapshot(path)
    assert got.exceptAll(snapshot(spark)).isEmpty() and got.count() == ROWS
    assert got.select(F.spark_partition_id()).distinct().count() > 1
    paths = [r.path for r in snapshot(spark).select("path").orderBy("path").collect()]
    from canopy.sources import wire

    assert [r["path"] for r in wire.read_snapshot(path)] == paths


def test_record_snapshot_without_rows(spark, tmp_path):
    engine, path = Engine(spark), str(tmp_path / "snapshot")
    engine.save_snapshot(snapshot(spark, 0), path, record_format=True)
    assert engine.load_snapshot(path).isEmpty()


def test_plan_of_a_wide_directory_lists_few_entries(tmp_path):
    wide = tmp_path / "wide"
    (wide / "below" / "deeper").mkdir(parents=True)
    for i in range(2000):
        (wide / f"f{i}").write_text("")
    (wide / "below" / "deeper" / "x").write_text("")
    reader = tree.TreeReader({"root": str(tmp_path), "partitions": 4})
    parts = reader.partitions()
    assert sum(len(p.shallow) + len(p.deep) for p in parts) < 100
    each = [[r[0] for r in reader.read(p)] for p in parts]
    assert sorted(p for e in each for p in e) == sorted(["", "wide", "wide/below", "wide/below/deeper", "wide/below/deeper/x", *[f"wide/f{i}" for i in range(2000)]])
    assert max(map(len, each)) < 1000


def test_wide_directory_that_goes_is_reported_once(tmp_path):
    (tmp_path / "wide").mkdir()
    for i in range(300):
        (tmp_path / "wide" / f"f{i}").write_text("")
    reader = tree.TreeReader({"root": str(tmp_path), "partitions": 4, "errors": "rows", "hash": "none"})
    parts = reader.partitions()
    for i in range(300):
        (tmp_path / "wide" / f"f{i}").unlink()
    (tmp_path / "wide").rmdir()
    found = [r for p in parts for r in reader.read(p)]
    assert [r[0] for r in found if r[1] == "error" and "wide" in r[0] and r[0] == "wide"] == ["wide", "wide"]  # its own entry, and what it held


def test_small_files_of_a_diff_share_tasks(spark, tmp_path):
    engine, root, out = Engine(spark), tmp_path / "root", tmp_path / "out"
    root.mkdir(), out.mkdir()
    engine.snapshot(str(root), f"{out}/old", record_format=True)
    for i in range(150):
        (root / f"f{i}").write_text("x" * 100)
    engine.diff(str(root), f"{out}/old", f"{out}/diff", f"{out}/new", split_size=250, record_format=True)
    changes = engine.load_changes(f"{out}/diff")
    assert len([x for x in os.listdir(out) if x.startswith("diff.")]) > 64
    assert changes.where("op = 'added'").count() == 150
    assert changes.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism


def test_batches_of_texts_are_bounded(spark):
    texts = spark.range(400).repartition(1).select(F.repeat(F.lit("x"), 100_000).alias("text"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    assert storage.in_arrow(texts, run, "n long").agg(F.max("n")).first()[0] < 2 * storage.ARROW_BYTES

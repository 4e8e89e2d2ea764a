"""Round trips over real trees; listings of the trees are the oracle."""

import os
import shutil
import struct

import pytest
from pyspark.sql import functions as F
from trees import file, folder, link, listing, table, write

from canopy import cli
from canopy.engine import Engine, detect_chunks
from canopy.errors import ChecksumMismatch, FormatError, InvalidRoot, MissingChunk, VerificationFailed, VersionMismatch
from canopy.operators import diff, simulate
from canopy.operators.filesystem import TreeWriter
from canopy.sources import tree, wire
from canopy.streaming.sync import StateTable, fold, follow


@pytest.fixture
def engine(spark):
    return Engine(spark)


@pytest.fixture
def root(tmp_path):
    r = str(tmp_path / "tree")
    write(r, "a.txt", b"hello", 0o640)
    write(r, "a/b/c.txt", b"deep", 0o600)
    write(r, "a-b", b"dash")
    write(r, ".hidden", b"dot")
    write(r, "empty", b"")
    os.makedirs(f"{r}/void")
    os.symlink("a.txt", f"{r}/ln")
    os.symlink("nowhere", f"{r}/a/dangling")
    return r


def mutate(r):
    write(r, "a.txt", b"HELLO", 0o640, 1_700_000_100)
    write(r, "new/deep/file", os.urandom(100_000), 0o644)
    os.unlink(f"{r}/a-b")
    shutil.rmtree(f"{r}/a/b")
    write(r, "a/b", b"now a file")
    os.unlink(f"{r}/ln")
    os.makedirs(f"{r}/ln")
    os.rmdir(f"{r}/void")
    os.symlink("a", f"{r}/void")
    os.chmod(f"{r}/.hidden", 0o600)
    os.unlink(f"{r}/a/dangling")
    os.symlink("elsewhere", f"{r}/a/dangling")


def test_scan(spark, engine, root):
    os.mkfifo(f"{root}/pipe")
    rows = {r.path: r for r in engine.scan(root).collect()}
    assert set(rows) == {"", "a", "a/b", "a/b/c.txt", "a/dangling", "a-b", "a.txt", ".hidden", "empty", "void", "ln"}
    assert rows["a.txt"].permissions == 0o640 and rows["a.txt"].hash == "5d41402abc4b2a76b9719d911017c592" and rows["a.txt"].size == 5
    assert rows["ln"].symlink_target == "a.txt" and rows["ln"].hash is None and rows["a"].size == 0 and rows["a"].dir_hash
    for n in (1, 2, 100):
        assert {r.path for r in spark.read.format("tree").option("root", root).option("partitions", n).load().collect()} == set(rows)
    below = spark.read.format("tree").option("root", root).option("hash", "none").load().where(F.col("path").startswith("a/"))
    assert {r.path for r in below.collect()} == {"a/b", "a/b/c.txt", "a/dangling"} and all(r.hash is None for r in below.collect())
    with pytest.raises(InvalidRoot):
        engine.scan(root + "/none")


def test_snapshot_counts_what_it_reuses(engine, root, tmp_path):
    first = engine.snapshot(root, str(tmp_path / "first"))
    again = engine.snapshot(root, str(tmp_path / "again"), str(tmp_path / "first"))
    assert first["reused"] == 0 and first["hashed"] == first["files"] > 1
    assert (again["reused"], again["hashed"], again["errors"]) == (first["files"], 0, 0)


def test_scan_reuses_hashes(engine, root):
    first = engine.scan(root)
    seen = first.withColumn("hash", F.when(F.col("path") == "a.txt", F.lit("ff" * 16)).otherwise(F.col("hash")))
    assert {r.path: r.hash for r in engine.scan(root, seen).collect()}["a.txt"] == "ff" * 16
    assert {r.path: r.hash for r in engine.scan(root, seen, rehash=True).collect()}["a.txt"] == {r.path: r.hash for r in first.collect()}["a.txt"]


@pytest.mark.parametrize("records,compress,split", [(False, False, None), (True, False, None), (True, True, "20000"), (True, False, "1K")])
def test_round_trip(engine, root, tmp_path, records, compress, split):
    copy, out = str(tmp_path / "copy"), lambda n: str(tmp_path / n)
    shutil.copytree(root, copy, symlinks=True)
    stats = engine.snapshot(root, out("s1"), compress=compress, record_format=records)
    assert stats["files"] == 5 and stats["symlinks"] == 2
    mutate(root)
    s = engine.diff(root, out("s1"), out("d"), out("s2"), split_size=split, compress=compress, record_format=records)
    assert s["added"] == 6 + 0 and s["removed"] == 5 and s["with_content"] == 3
    assert engine.verify(copy, out("d"), out("s2")).collect() == []
    if split:
        assert len(detect_chunks(out("d"))) > 1
    done = engine.apply(copy, out("d"))
    assert done["errors"] == []
    assert listing(copy) == listing(root)
    assert [r for r in engine.load_snapshot(out("s2")).collect() if r.path == "a.txt"][0].size == 5


def test_verify_finds_what_differs(engine, root, tmp_path):
    copy, out = str(tmp_path / "copy"), lambda n: str(tmp_path / n)
    shutil.copytree(root, copy, symlinks=True)
    engine.snapshot(root, out("s1"))
    mutate(root)
    engine.diff(root, out("s1"), out("d"), out("s2"))
    write(copy, "void/stray", b"?")
    write(copy, "empty", b"full")
    got = {(r.path, r.category) for r in engine.verify(copy, out("d"), out("s2")).collect()}
    assert {("void/stray", "extra"), ("empty", "hash"), ("empty", "metadata")} <= got
    with pytest.raises(VerificationFailed):
        engine.check(copy, out("d"), out("s2"))
    # With hashes taken from the target, a file of the same size and second goes unseen; without, not.
    write(copy, ".hidden", b"dox")
    write(copy, "empty", b"")
    assert (".hidden", "hash") in {(r.path, r.category) for r in engine.verify(copy, out("d"), out("s2")).collect()}
    assert (".hidden", "hash") not in {(r.path, r.category) for r in engine.verify(copy, out("d"), out("s2"), trust_target=True).collect()}


def test_diff_knows_its_source(engine, root, tmp_path):
    out = lambda n: str(tmp_path / n)
    engine.snapshot(root, out("s1"))
    write(root, "more", b"1")
    engine.diff(root, out("s1"), out("d"), out("s2"))
    with pytest.raises(FormatError):
        engine.apply(root, out("d"), source=engine.load_snapshot(out("s2")))
    with pytest.raises(FormatError):
        engine.load_snapshot(out("d"))
    with pytest.raises(FormatError):
        engine.load_changes(out("s1"))


def test_failures_are_reported_and_the_rest_done(spark, root):
    changes = diff.changes(table(spark, [folder("void"), file("missing"), folder("a")]), table(spark, [file("ok", size=2, hash_="5d"), file("lost")]))
    rows = [r.asDict() for r in changes.collect()]
    got = TreeWriter(root).apply(rows, [("ok", 0, b"hi")])
    reasons = dict(got["errors"])
    assert set(reasons) == {"missing", "a", "ok", "lost"} and "hash" in reasons["ok"] and not os.path.exists(f"{root}/ok")
    assert got["removed"] == 1 and not os.path.exists(f"{root}/void") and os.listdir(root).count("a") == 1
    good = [r | {"new_hash": None} for r in rows if r["path"] == "ok"]
    assert TreeWriter(root).apply(good, [("ok", 0, b"h"), ("ok", 1, b"i")])["errors"] == []
    assert open(f"{root}/ok", "rb").read() == b"hi"
    assert "next" in TreeWriter(root).apply(good, [("ok", 0, b"h"), ("ok", 2, b"i")])["errors"][0][1]


def test_chunk_discovery(tmp_path):
    base = str(tmp_path / "d")
    with pytest.raises(MissingChunk):
        detect_chunks(base)
    for i in (1, 2, 4):
        open(f"{base}.{i:03d}", "wb").close()
    with pytest.raises(MissingChunk):
        detect_chunks(base)
    os.unlink(f"{base}.004")
    assert detect_chunks(base) == [f"{base}.001", f"{base}.002"]
    open(base, "wb").close()
    assert detect_chunks(base) == [base] and detect_chunks(f"{base}.001") == [f"{base}.001"]


VALUES = [None, True, False, 0, 127, 128, 255, 256, 65535, 65536, 2**32, 2**64 - 1, -1, -32, -33, -129, -40000, -(2**40), "", "é" * 10, "x" * 40, "y" * 300, "z" * 70000, [], [1, [2, None]], list(range(20)), {"Removed": "File"}]


def test_values():
    for v in VALUES:
        assert wire.unpack(wire.pack(v)) == v
    assert wire.pack([1, -1, 200, "a"]) == b"\x94\x01\xff\xcc\xc8\xa1a"
    for bad in (b"", b"\x92\x01", b"\xd9\x05ab", b"\x01\x02"):
        with pytest.raises(FormatError):
            wire.unpack(bad)


@pytest.mark.parametrize("compress", [False, True])
def test_record_files(spark, tmp_path, compress):
    path = str(tmp_path / "f")
    rows = [folder("", uid=4_294_967_294), file("a", mtime=-5, size=2**40), link("l", "ü")]
    wire.write_snapshot(path, rows, "/r", compress)
    assert list(wire.read_snapshot(path)) == rows
    with pytest.raises(FormatError):
        list(wire.read_changes(path))
    data = open(path, "rb").read()
    assert data[:9] == (wire.MAGIC_ZSTD if compress else wire.MAGIC)
    with pytest.raises(FormatError):
        list(wire.read_snapshot(path, magics=(b"123456789", b"987654321")))
    if not compress:
        at = data.index(b"a\xa4File") + 1
        for broken in (data[:-20], data[:40], data[:at] + b"\xa4Fill" + data[at + 5 :], data[:-1] + bytes([data[-1] ^ 1])):
            open(path, "wb").write(broken)
            with pytest.raises((FormatError, KeyError)):
                list(wire.read_snapshot(path))
        flipped = bytearray(data)
        flipped[data.index(struct.pack(">H", 1000)) + 1] ^= 1
        open(path, "wb").write(bytes(flipped))
        with pytest.raises(ChecksumMismatch):
            list(wire.read_snapshot(path))


def test_versions(tmp_path, monkeypatch):
    path = str(tmp_path / "f")
    monkeypatch.setattr(wire, "FORMAT_VERSION", 9)
    wire.write_snapshot(path, [])
    monkeypatch.undo()
    with pytest.raises(VersionMismatch):
        list(wire.read_snapshot(path))


def test_changes_as_records(spark):
    old, new = [file("m"), file("p"), link("l", "a"), folder("k")], [file("m", hash_="bb"), file("p", permissions=0), link("l", "b"), file("k"), folder("n")]
    for r in diff.changes(table(spark, old), table(spark, new)).collect():
        r = r.asDict()
        back = wire.change_row(wire.unpack(wire.pack(wire.change_value(r))))
        if r["op"] == "modified":  # records leave the kinds of a modification to the state
            r |= {"old_kind": None, "new_kind": None}
        assert back == r


def test_command_line(spark, root, tmp_path, capsys):
    out = lambda n: str(tmp_path / n)
    copy = out("copy")
    shutil.copytree(root, copy, symlinks=True)
    assert cli.main(["snapshot", root, out("s1")], spark) == 0
    mutate(root)
    assert cli.main(["diff", root, out("s1"), out("d"), out("s2")], spark) == 0
    assert cli.main(["verify", copy, out("d"), out("s2")], spark) == 0
    write(copy, "stray")
    assert cli.main(["verify", copy, out("d"), out("s2")], spark) == 1
    assert "EXTRA: stray" in capsys.readouterr().out
    os.unlink(f"{copy}/stray")
    assert cli.main(["apply", copy, out("d")], spark) == 0 and listing(copy) == listing(root)
    assert cli.main(["snapshot", out("nowhere"), out("s3")], spark) == 1


def test_rounds(engine, root, tmp_path):
    """The snapshot of one round is the input of the next."""
    copy, out = str(tmp_path / "copy"), lambda n: str(tmp_path / n)
    shutil.copytree(root, copy, symlinks=True)
    engine.snapshot(root, out("s0"))
    for i in range(2):
        mutate(root) if i == 0 else write(root, "new/deep/file", b"short", mtime=1_700_000_500)
        engine.diff(root, out(f"s{i}"), out(f"d{i}"), out(f"s{i + 1}"))
        assert engine.apply(copy, out(f"d{i}"))["errors"] == []
        assert listing(copy) == listing(root)


def test_stream_equals_fold(spark, tmp_path):
    steps = [[file("a"), file("b")], [file("a", permissions=0o600)], [file("a", permissions=0o600), file("c")], [file("c", hash_="dd")]]
    batches = []
    for i, (x, y) in enumerate(zip([[]] + steps[:-1], steps)):
        c = diff.changes(table(spark, x), table(spark, y)).withColumn("seq", F.lit(0).cast("long")).coalesce(1)
        c.write.parquet(f"{tmp_path}/in/{i}")
        batches.append(c.withColumn("batch", F.lit(i)))
    os.makedirs(f"{tmp_path}/flat")
    for i in range(len(steps)):
        part = next(p for p in os.listdir(f"{tmp_path}/in/{i}") if p.endswith(".parquet"))
        shutil.copy(f"{tmp_path}/in/{i}/{part}", f"{tmp_path}/flat/{i}.parquet")
        os.utime(f"{tmp_path}/flat/{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(batches[0].drop("batch").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/flat")
    state = StateTable(spark, f"{tmp_path}/state")
    follow(stream, state, f"{tmp_path}/ck").awaitTermination()
    all_ = batches[0]
    for b in batches[1:]:
        all_ = all_.unionByName(b)
    want = sorted(tuple(r) for r in fold(table(spark, []), all_).collect())
    assert sorted(tuple(r) for r in state.read().collect()) == want == [tuple(file("c", hash_="dd").values())]
    assert len(state.versions()) == 4
    state.apply_batch(batches[3].drop("batch"), 3)  # sent again
    assert sorted(tuple(r) for r in state.read().collect()) == want
    assert sorted(r.path for r in state.read(1).collect()) == ["a", "b"]
    assert simulate.reduced(all_.drop("batch")).count() == 3


def test_contents_in_pieces(spark, root):
    rows = tree.contents(spark.createDataFrame([("a.txt",), ("empty",)], "path string"), root, fragment=2).collect()
    assert sorted((r.path, r.frag_no, r.offset, bytes(r.bytes)) for r in rows) == [("a.txt", 0, 0, b"he"), ("a.txt", 1, 2, b"ll"), ("a.txt", 2, 4, b"o"), ("empty", 0, 0, b"")]


def test_record_file_bytes(tmp_path):
    """A whole snapshot file, byte by byte: the format must not drift."""
    import xxhash

    path = str(tmp_path / "s")
    wire.write_snapshot(path, [file("a", size=300, hash_="ab", mtime=7)], created_at=0)
    header = b"\x96\xa8snapshot" + bytes([wire.FORMAT_VERSION, 0]) + b"\xc0\xc0\xc0"
    entry = b"\x96\xa1a\xa4File\x96\xcd\x01\x2c\x07\x00\xcd\x01\xa4\xcd\x03\xe8\xcd\x03\xe8\xdc\x00\x10" + b"\xcc\xab" * 16 + b"\xc0\xc0"
    body = wire.MAGIC + struct.pack("<I", len(header)) + header + struct.pack("<QB", len(entry), 1) + entry + bytes(9)
    assert open(path, "rb").read() == body + xxhash.xxh3_128_digest(body)[::-1]


def test_files_of_a_diff_keep_to_the_limit(spark, engine, root, tmp_path):
    out = lambda n: str(tmp_path / n)
    engine.snapshot(root, out("s1"), record_format=True)
    write(root, "big", os.urandom(50_000))
    write(root, "none", b"")
    engine.diff(root, out("s1"), out("d"), out("s2"), split_size=3000, record_format=True)
    chunks = detect_chunks(out("d"))
    sizes = [os.path.getsize(c) for c in chunks]
    assert len(chunks) > 15 and set(sizes[1:-1]) == {3000 + 9 + 16}  # the end marker and the checksum come on top
    assert not [n for n in os.listdir(tmp_path) if n.startswith("d-")]
    got = {}
    for path, at, data in engine._content(out("d")):
        assert at == len(got.get(path, b""))
        got[path] = got.get(path, b"") + data
    assert got == {p: open(f"{root}/{p}", "rb").read() for p in ("big", "none")}


def test_a_failing_writer_leaves_no_file(engine, root, tmp_path):
    out = lambda n: str(tmp_path / n)
    engine.snapshot(root, out("s1"), record_format=True)
    write(root, "gone", b"12345")
    found = diff.with_sequence(diff.changes(engine.load_snapshot(out("s1")), engine.scan(root)))
    os.unlink(f"{root}/gone")
    with pytest.raises(Exception, match="gone"):
        engine._write_records(found, root, out("d"), "0" * 32, None, False)
    assert sorted(os.listdir(tmp_path)) == ["s1", "tree"]


def test_progress_is_for_terminals(spark):
    import io
    import time

    from canopy.progress import Progress

    quiet, shown = io.StringIO(), io.StringIO()
    with Progress(spark, "diff", quiet, every=0.01):
        time.sleep(0.05)
    with Progress(spark, "diff", shown, always=True, every=0.01):
        spark.range(1000).repartition(8).count()
        time.sleep(0.05)
    assert quiet.getvalue() == "" and "diff: " in shown.getvalue() and shown.getvalue().endswith("\r\x1b[K")

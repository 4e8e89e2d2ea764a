import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from trees import file, folder, link, row, table

from canopy.errors import InvalidSize
from canopy.operators import content, diff, merkle, reuse, simulate, split, verify
from canopy.schema import SNAPSHOT


def ops(spark, old, new, **options):
    rows = diff.changes(table(spark, old), table(spark, new), **({"mode": "off"} | options)).collect()
    return sorted(((r.path, r.op) for r in rows), key=lambda x: (x[0].split("/"), x[1] != "removed"))


def change(spark, old, new):
    (r,) = diff.changes(table(spark, [old]), table(spark, [new])).collect()
    return r


# diff


def test_nothing_and_everything(spark):
    tree = [folder(""), file("a"), link("l", "a")]
    assert ops(spark, tree, tree) == []
    assert ops(spark, [], tree) == [("", "added"), ("a", "added"), ("l", "added")]
    assert ops(spark, tree, []) == [("", "removed"), ("a", "removed"), ("l", "removed")]


def test_added_carries_its_entry(spark):
    rows = {r.path: r for r in diff.changes(table(spark, []), table(spark, [file("f", size=5, hash_="ab"), folder("d"), link("l", "t")])).collect()}
    f = rows["f"]
    assert (f.new_kind, f.has_content, f.new_size, f.new_hash, f.old_kind) == ("file", True, 5, "ab" * 16, None)
    assert not rows["d"].has_content and rows["d"].new_permissions == 0o755
    assert rows["l"].new_symlink_target == "t" and not rows["l"].has_content


def test_modified_is_sparse(spark):
    r = change(spark, file("a", hash_="aa"), file("a", hash_="bb"))
    assert (r.op, r.has_content, r.new_hash, r.new_size) == ("modified", True, "bb" * 16, 100)  # content brings metadata
    r = change(spark, file("a"), file("a", permissions=0o600))
    assert (r.has_content, r.new_hash, r.new_permissions) == (False, None, 0o600)
    r = change(spark, link("a", "x"), link("a", "y"))
    assert (r.has_content, r.new_symlink_target, r.new_size) == (False, "y", None)
    r = change(spark, file("a"), file("a", uid=5))
    assert r.new_uid == 5 and r.new_hash is None
    r = change(spark, folder("d"), folder("d", mtime=1_700_000_009))
    assert r.new_mtime_sec == 1_700_000_009 and r.new_kind == r.old_kind == "directory"


def test_times_within_a_second_are_equal(spark):
    assert ops(spark, [file("a", mtime=5)], [file("a", mtime=6)]) == []
    assert ops(spark, [file("a", mtime=5)], [file("a", mtime=7)]) == [("a", "modified")]


@pytest.mark.parametrize("old,new", [(file("p"), folder("p")), (folder("p"), link("p", "x")), (link("p", "x"), file("p"))])
def test_change_of_kind_is_two_changes(spark, old, new):
    assert ops(spark, [old], [new]) == [("p", "removed"), ("p", "added")]


def test_order_and_summary(spark):
    old = [file("a/b"), file("a-b"), folder("k"), file("m")]
    new = [file("a.txt"), file("a/c"), file("k"), file("m", hash_="cc")]
    rows = diff.with_sequence(diff.changes(table(spark, old), table(spark, new)))
    got = [(r.path, r.op) for r in rows.orderBy("seq").collect()]
    assert got == [("a/b", "removed"), ("a/c", "added"), ("a-b", "removed"), ("a.txt", "added"), ("k", "removed"), ("k", "added"), ("m", "modified")]
    assert sorted(r.seq for r in rows.collect()) == list(range(7))
    assert diff.summary(rows).first().asDict() == {"added": 3, "modified": 1, "removed": 3, "with_content": 4}
    assert sorted(r.path for r in diff.content_manifest(rows).collect()) == ["a.txt", "a/c", "k", "m"]


def test_few_changes_among_many(spark):
    old = [file(f"d{i % 10}/f{i}") for i in range(1000)]
    new = [r | ({"hash": "ee" * 16} if i in (17, 800) else {}) for i, r in enumerate(old)]
    assert ops(spark, old, new) == [("d0/f800", "modified"), ("d7/f17", "modified")]


# directory hashes

TREE = [folder(""), folder("d"), file("d/a"), file("d/b", hash_="bb"), folder("d/e"), link("l", "d/a")]


def root_hash(spark, rows, algorithm="md5"):
    return {r.path: r.dir_hash for r in merkle.dir_hashes(table(spark, rows), algorithm).collect()}


@pytest.mark.parametrize("algorithm", ["md5", "xxh3"])
def test_dir_hash_is_sensitive(spark, algorithm):
    base = root_hash(spark, TREE, algorithm)
    assert set(base) == {"", "d", "d/e"} and all(len(h) == 32 for h in base.values())
    assert root_hash(spark, TREE[::-1], algorithm) == base
    changed = [
        {"hash": "cc" * 16}, {"permissions": 0o600}, {"uid": 1}, {"gid": 1}, {"mtime_sec": 1}, {"mtime_nsec": 1}, {"size": 101}, {"path": "d/aa"},
    ]
    for c in changed:
        got = root_hash(spark, [TREE[2] | c if r["path"] == "d/a" else r for r in TREE], algorithm)
        assert got["d"] != base["d"] and got[""] != base[""] and got["d/e"] == base["d/e"], c
    for path, c in (("l", {"symlink_target": "other"}), ("d/e", {"permissions": 0o700})):
        assert root_hash(spark, [r | c if r["path"] == path else r for r in TREE], algorithm)[""] != base[""]
    # A directory's size and own metadata aren't in its own hash.
    same = root_hash(spark, [r | {"size": 4096, "permissions": 0o700} if r["path"] == "d" else r for r in TREE], algorithm)
    assert same["d"] == base["d"] and same[""] != base[""]
    assert root_hash(spark, [r for r in TREE if r["path"] != "d/b"], algorithm)["d"] != base["d"]


def test_dir_hash_of_nothing(spark):
    assert root_hash(spark, []) == {}
    assert root_hash(spark, [folder("")]) == {"": "d41d8cd98f00b204e9800998ecf8427e"}


def hashed(spark, rows):
    return merkle.with_dir_hashes(table(spark, rows))


def test_pruning_modes(spark):
    new = [r | ({"permissions": 0o700} if r["path"] == "d" else {}) for r in TREE]
    a, b = hashed(spark, TREE), hashed(spark, new)
    run = lambda **o: [(r.path, r.op) for r in diff.changes(a, b, **o).collect()]
    assert run(mode="off") == run(mode="strict") == run(mode="strict", prune=True) == [("d", "modified")]
    assert run(mode="reference") == []  # the equal directory takes its own change along
    assert sorted(r.path for r in diff.skipped(a, b).collect()) == ["d", "d/a", "d/b", "d/e"]
    with pytest.raises(ValueError):
        diff.changes(a, b, mode="other")


# simulation


def applied(spark, state, changes):
    return {r.path: r.asDict() for r in simulate.apply_changes(table(spark, state), changes).collect()}


def test_simulated_changes(spark):
    old = [folder(""), file("a", hash_="aa"), file("gone"), link("l", "x"), file("swap")]
    new = [folder(""), file("a", hash_="bb", size=7), file("fresh"), link("l", "y"), link("swap", "z")]
    got = applied(spark, old, diff.changes(table(spark, old), table(spark, new)))
    assert got == {r["path"]: r for r in new}


def test_modification_of_an_absent_path_does_nothing(spark):
    changes = diff.changes(table(spark, [file("a")]), table(spark, [file("a", permissions=0o600)]))
    assert applied(spark, [file("b")], changes) == {"b": file("b")}


def test_overlay_keeps_what_is_not_set(spark):
    changes = diff.changes(table(spark, [file("a")]), table(spark, [file("a", permissions=0o600)]))
    got = applied(spark, [file("a", hash_="dd")], changes)["a"]
    assert got["hash"] == "dd" * 16 and got["permissions"] == 0o600


def test_removal_takes_one_path(spark):
    changes = diff.changes(table(spark, [folder("d")]), table(spark, []))
    assert set(applied(spark, [folder("d"), file("d/a")], changes)) == {"d/a"}


def test_sequences_fold_in_order(spark):
    steps = [[file("a")], [file("a", permissions=0o600)], [], [file("a", hash_="cc")], [file("a", hash_="cc", uid=7)]]
    all_ = None
    for i, (x, y) in enumerate(zip([[]] + steps[:-1], steps)):
        c = diff.changes(table(spark, x), table(spark, y)).withColumn("seq", F.lit(i))
        all_ = c if all_ is None else all_.unionByName(c)
    assert applied(spark, [], all_) == {"a": steps[-1][0]}
    assert applied(spark, [], all_.where("seq <= 2")) == {}


def implicit(spark, state, old, new):
    return sorted(r.path for r in simulate.implicit_dirs(table(spark, state), diff.changes(table(spark, old), table(spark, new))).collect())


def test_implicit_directories(spark):
    base = [folder(""), folder("d"), file("d/a")]
    assert implicit(spark, base, base, [folder(""), folder("d"), file("d/a", hash_="bb")]) == ["d"]
    assert implicit(spark, base, base, [folder(""), folder("d", mtime=9), file("d/a", hash_="bb")]) == [""]
    assert implicit(spark, base, base, base + [folder("n"), file("n/x")]) == [""]
    assert implicit(spark, base, base, [folder("", mtime=5), folder("d"), file("d/a")]) == []


# verification


def found(spark, actual, target, implicit_=(), **o):
    i = spark.createDataFrame([(p,) for p in implicit_], "path string")
    return sorted((r.path, r.category) for r in verify.discrepancies(table(spark, actual), table(spark, target), i, **o).collect())


def test_discrepancies(spark):
    actual = [folder("", mtime=1), file("a", hash_="aa"), file("k"), file("more"), link("l", "x"), folder("d", mtime=5)]
    target = [folder(""), file("a", hash_="bb", size=3), folder("k"), file("less"), link("l", "y"), folder("d")]
    want = [("", "metadata"), ("a", "hash"), ("a", "metadata"), ("d", "metadata"), ("k", "hash"), ("k", "kind"), ("k", "metadata"), ("l", "symlink"), ("less", "missing"), ("more", "extra")]
    assert found(spark, actual, target) == want
    assert found(spark, actual, target, ["", "d"]) == [w for w in want if w not in (("", "metadata"), ("d", "metadata"))]
    lines = verify.line_count(verify.discrepancies(table(spark, actual), table(spark, target))).first().lines
    assert lines == sum(3 if c == "metadata" else 1 for _, c in want)
    assert found(spark, target, target) == [] and verify.line_count(verify.discrepancies(table(spark, target), table(spark, target))).first().lines == 0


def test_verify_reference_mode_is_blind_to_equal_directories(spark):
    new = [r | ({"permissions": 0o700} if r["path"] == "d" else {}) for r in TREE]
    a, b = hashed(spark, TREE), hashed(spark, new)
    assert [(r.path, r.category) for r in verify.discrepancies(a, b).collect()] == [("d", "metadata")]
    assert verify.discrepancies(a, b, mode="reference").collect() == []
    # An implicit directory is no root of pruning.
    kept = verify.discrepancies(a, b.withColumn("permissions", F.when(F.col("path") == "d/a", 0).otherwise(F.col("permissions"))), spark.createDataFrame([("d",)], "path string"), "reference")
    assert [(r.path, r.category) for r in kept.collect()] == [("d/a", "metadata")]


# hash reuse


def test_hash_reuse(spark):
    old = [file("same", hash_="aa"), file("moved", mtime=1, hash_="bb"), file("grown", size=1, hash_="cc"), file("bare", hash_=None or "dd"), link("was", "x")]
    walked = [r | {"hash": None} for r in (file("same", mtime_nsec=9), file("moved"), file("grown"), file("fresh"), file("was"), link("l", "x"), folder("d"))]
    fresh = spark.createDataFrame([(p, "ee" * 16) for p in ("moved", "grown", "fresh", "was")], "path string, content_hash string")
    out = reuse.with_hashes(table(spark, walked), table(spark, old), fresh)
    got = {r.path: (r.hash and r.hash[:2], r.reused) for r in out.collect()}
    assert got == {"same": ("aa", True), "moved": ("ee", False), "grown": ("ee", False), "fresh": ("ee", False), "was": ("ee", False), "l": (None, False), "d": (None, False)}
    s = reuse.stats(out, table(spark, [*walked, file("unread")])).first().asDict()
    assert s == {"files": 5, "directories": 1, "symlinks": 1, "hashed": 4, "reused": 1, "bytes": 500, "total_entries": 8, "errors": 1}


# transport


def test_split_plan_example(spark):
    rows = [(i, 100, c) for i, c in enumerate((None, 500, None, 0, 900))]
    want = [(1, "change", 0, 0, 0, 100), (1, "change", 1, 0, 0, 100), (1, "change", 2, 0, 0, 100), (1, "change", 3, 0, 0, 100), (2, "change", 4, 0, 0, 100), (2, "content", 1, 0, 0, 231),
            (3, "content", 1, 1, 231, 269), (3, "content", 3, 0, 0, 0), (3, "content", 4, 0, 0, 44), (4, "content", 4, 1, 44, 331), (5, "content", 4, 2, 375, 331), (6, "content", 4, 3, 706, 194)]
    assert list(split.pack(rows, 60, 400)) == want
    df = spark.createDataFrame(rows[::-1], "seq long, record_bytes long, content_bytes long")
    assert [tuple(r) for r in split.split_plan(df, 60, 400).collect()] == want
    for limit in (60, 69):
        with pytest.raises(InvalidSize):
            split.split_plan(df, 60, limit)
    assert list(split.pack([], 60, 400)) == [] and split.split_plan(df.limit(0), 60, 400).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 300), st.one_of(st.none(), st.integers(0, 2000))), max_size=30), st.integers(10, 60), st.integers(1, 600))
def test_split_plan_is_whole(sizes, header, room):
    rows = [(i, r, c) for i, (r, c) in enumerate(sizes)]
    limit = header + split.PREFIX + room
    plan = list(split.pack(rows, header, limit))
    assert [p[2] for p in plan if p[1] == "change"] == [r[0] for r in rows]
    for seq, _, c in rows:
        parts = [p for p in plan if p[1] == "content" and p[2] == seq]
        assert sum(p[5] for p in parts) == (c or 0) and bool(parts) == (c is not None)
        assert [p[3] for p in parts] == list(range(len(parts)))
    for chunk in {p[0] for p in plan}:
        mine = [p for p in plan if p[0] == chunk]
        last = max((i for i, p in enumerate(mine) if p[1] == "change"), default=-1)
        assert header + sum(p[5] for p in mine[:last]) < limit or last <= 0
        if last < len(mine) - 1:
            assert header + sum(p[5] + split.PREFIX * (p[1] == "content") for p in mine) <= limit
    assert sorted({p[0] for p in plan}) == list(range(1, len({p[0] for p in plan}) + 1))


def test_chunk_gaps(spark):
    gaps = lambda xs: tuple(split.chunk_gaps(spark.createDataFrame([(x,) for x in xs], "chunk_index int")).first())
    assert gaps([1]) == (1, 0) and gaps([1, 2, 3, 3]) == (3, 0) and gaps([1, 2, 4]) == (3, 1) and gaps([1, 4]) == (2, 2) and gaps([]) == (0, 0)
    assert split.chunk_name("d", 7) == "d.007"


def test_fragments(spark):
    data = [("a", b"0123456789"), ("e", b""), ("b", b"xy")]
    plan = [("a", 2, 1, 4, 6), ("a", 1, 0, 0, 4), ("e", 1, 0, 0, 0), ("b", 3, 0, 0, 2)]
    f = content.fragments(spark.createDataFrame(data, "path string, bytes binary"), spark.createDataFrame(plan, "path string, chunk_index int, frag_no int, offset bigint, length bigint"))
    assert {r.path: bytes(r.bytes) for r in content.reassembled(f).collect()} == dict(data)
    import hashlib

    manifest = spark.createDataFrame([(p, len(b), hashlib.md5(b).hexdigest()) for p, b in data] + [("none", 1, None)], "path string, size bigint, hash string")
    problems = lambda x: {r.path: r.problem for r in content.broken(x, manifest).collect()}
    assert problems(f) == {"none": "missing"}
    assert problems(f.where("NOT (path = 'a' AND frag_no = 1)")) == {"none": "missing", "a": "length"}
    assert problems(f.withColumn("bytes", F.when(F.col("path") == "b", F.lit(b"xz")).otherwise(F.col("bytes")))) == {"none": "missing", "b": "hash"}


# properties

NAMES = ["a", "b", "a/x", "a/y", "a-b", "a.t"]
ENTRY = st.one_of(
    st.builds(lambda s, t, h, p: ("file", s, t, h, None, p), st.integers(0, 2), st.integers(0, 3), st.sampled_from(["aa", "bb"]), st.sampled_from([420, 384])),
    st.builds(lambda t: ("directory", 0, t, None, None, 493), st.integers(0, 3)),
    st.builds(lambda t: ("symlink", 0, 0, None, t, 511), st.sampled_from(["x", "y"])),
)
SIDE = st.dictionaries(st.sampled_from(NAMES), ENTRY, max_size=6)


def build(side):
    return [row(p, k, size=s, mtime_sec=t, hash=h and h * 16, symlink_target=l, permissions=m) for p, (k, s, t, h, l, m) in side.items()]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(SIDE, SIDE)
def test_changes_turn_old_into_new(spark, old, new):
    o, n = table(spark, build(old)), table(spark, build(new))
    c = diff.changes(o, n)
    after = simulate.apply_changes(o, c)
    assert verify.discrepancies(after, n).collect() == []
    assert diff.changes(o, o).collect() == [] and diff.changes(after, n).collect() == []
    keys = [(r.path, r.op) for r in c.collect()]
    assert len(keys) == len(set(keys)) and after.columns == SNAPSHOT.names


def test_streamed_digests(spark):
    import hashlib

    rows = [("a", 3, 1, b"de"), ("a", 0, 0, b"abc"), ("gap", 0, 0, b"x"), ("gap", 2, 1, b"y"), ("over", 0, 0, b"xy"), ("over", 1, 1, b"z"), ("empty", 0, 0, b"")]
    df = spark.createDataFrame(rows, "path string, offset bigint, frag_no int, bytes binary")
    got = {r.path: (r.total, r.whole, r.hash) for r in content.digests(df).collect()}
    md5 = lambda b: hashlib.md5(b).hexdigest()
    assert got == {"a": (5, True, md5(b"abcde")), "gap": (2, False, md5(b"xy")), "over": (3, False, md5(b"xyz")), "empty": (0, True, md5(b""))}
    assert {r.path: bytes(r.bytes) for r in content.reassembled(df).collect()}["empty"] == b""
    assert content.digests(df.limit(0)).collect() == [] and content.digests(df, "xxh3").count() == 4

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from canopy.errors import InvalidSize
from canopy.functions import hashing, paths, predicates, sizes


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize("path,depth,parent,name", [("", 0, None, ""), ("a.txt", 1, "", "a.txt"), ("a/b/c.txt", 3, "a/b", "c.txt"), ("é/ü", 2, "é", "ü")])
def test_path_parts(spark, path, depth, parent, name):
    p = F.col("p")
    assert one(spark, F.struct(paths.depth(p), paths.parent(p), paths.base_name(p)), p=path) == (depth, parent, name)


def test_ancestors_and_containment(spark):
    p = F.col("p")
    assert one(spark, paths.ancestors(p, True), p="a/b/c") == ["", "a", "a/b", "a/b/c"]
    assert one(spark, paths.ancestors(p, False), p="a/b/c") == ["", "a", "a/b"]
    assert one(spark, paths.ancestors(p, True), p="") == [""] and one(spark, paths.ancestors(p, False), p="") == []
    has = lambda d, c: one(spark, paths.contains(F.col("d"), F.col("c")), d=d, c=c)
    assert has("", "a") and has("a", "a/b/c") and not has("", "") and not has("a", "a") and not has("a", "ab")


def test_order_is_by_component(spark):
    data = ["z", "a.txt", "a/b", "a", "é", "a-b", "a/b/c"]
    got = [r.p for r in spark.createDataFrame([(x,) for x in data], "p string").orderBy(paths.components(F.col("p"))).collect()]
    assert got == ["a", "a/b", "a/b/c", "a-b", "a.txt", "z", "é"]


def test_normalize(spark):
    assert one(spark, paths.normalize(F.col("p")), p="./a//b/./c") == "a/b/c"
    assert one(spark, paths.normalize(F.col("p")), p=".") == ""
    for bad in ("../x", "/x", "a/../b"):
        with pytest.raises(PySparkException, match="invalid path"):
            one(spark, paths.normalize(F.col("p")), p=bad)
    assert one(spark, paths.strip_root(F.col("p"), "/srv/t"), p="/srv/t/a/b") == "a/b" and one(spark, paths.strip_root(F.col("p"), "/srv/t"), p="/srv/t") == ""
    with pytest.raises(PySparkException, match="invalid path"):
        one(spark, paths.strip_root(F.col("p"), "/srv/t"), p="/srv/tx")
    assert one(spark, paths.full_path(F.col("r"), F.col("p")), r="/srv/", p="a") == "/srv/a"


S = 1_000_000_000
TIMES = [((5, 0), (5, 0), True), ((5, 999_999_999), (6, 0), True), ((5, 7), (6, 7), True), ((5, 7), (6, 8), False), ((5, 123_456_789), (5, 0), True), ((-3, 0), (-2, 0), True), ((-3, 0), (-1, 0), False), ((5, 0), (7, 0), False),
         ((2**63 - 1, 0), (2**63 - 1, 5), True), ((-(2**63), 0), (2**63 - 1, 0), False), ((2**63 - 2, 5), (2**63 - 1, 5), True)]


@pytest.mark.parametrize("a,b,same", TIMES)
def test_mtime_tolerance(spark, a, b, same):
    assert (abs(a[0] * S + a[1] - b[0] * S - b[1]) <= S) == same
    for x, y in ((a, b), (b, a)):
        side = lambda t: lambda c: F.lit(t[0] if c == "mtime_sec" else t[1]).cast("bigint")
        assert one(spark, predicates.mtime_matches(side(x), side(y)), z=1) == same


def test_metadata_matches(spark):
    base = {"size": 1, "permissions": 420, "uid": 4_294_967_294, "gid": 2, "mtime_sec": 9, "mtime_nsec": 0}
    side = lambda d: lambda c: F.lit(d[c]).cast("bigint")
    assert one(spark, predicates.metadata_matches(side(base), side(base | {"mtime_sec": 10})), z=1)
    for c in ("size", "permissions", "uid", "gid"):
        assert not one(spark, predicates.metadata_matches(side(base), side(base | {c: 7})), z=1)


SIZES = {"0": 0, "4096": 4096, "500KB": 512_000, "2 gb": 2 << 30, "1K": 1024, "1B": 1, "3m": 3 << 20, " 7 ": 7, "18446744073709551615": 2**64 - 1}
NOT_SIZES = ["1.5GB", "10KiB", "-1", "", "18446744073709551616", "17179869184G", "KB", "1T", "1" * 40]


def test_sizes(spark):
    assert {k: sizes.parse_size(k) for k in SIZES} == SIZES
    for bad in NOT_SIZES:
        with pytest.raises(InvalidSize):
            sizes.parse_size(bad)
    df = spark.createDataFrame([(x,) for x in [*SIZES, *NOT_SIZES]], "t string")
    got = {r.t: None if r.n is None else int(r.n) for r in df.select("t", sizes.size_column(F.col("t")).alias("n")).collect()}
    assert got == SIZES | dict.fromkeys(NOT_SIZES)


def test_hashes(spark):
    assert len(hashing.xxh3_hex(b"")) == 32
    import xxhash

    assert bytes.fromhex(hashing.xxh3_hex(b"abc"))[::-1] == xxhash.xxh3_128_digest(b"abc")
    assert one(spark, hashing.content_hash(F.col("b"), "xxh3"), b=b"abc") == hashing.xxh3_hex(b"abc")
    assert one(spark, hashing.target_hash(F.lit(None).cast("string")), z=1) == "0" * 32


def test_digests_and_bytes_that_must_not_change():
    """Digests of the public XXH3-128 test input "", and the layout of a child's token."""
    from canopy.functions import hashing

    assert hashing.xxh3_hex(b"") == bytes.fromhex("99aa06d3014798d86001c324468d497f")[::-1].hex()
    streamed = hashing.new_digest("xxh3")
    for piece in (b"ab", b"", b"c"):
        streamed.update(piece)
    assert hashing.digest_hex(streamed, "xxh3") == hashing.xxh3_hex(b"abc")
    child = {"name": "é", "kind": "file", "h": "00112233445566778899aabbccddeeff", "permissions": 0o644, "uid": 1, "gid": 2, "mtime_sec": -1, "mtime_nsec": 5, "size": 258}
    want = "c3a9" "00" "00" "00112233445566778899aabbccddeeff" "a4010000" "01000000" "02000000" "ffffffffffffffff" "05000000" "0201000000000000"
    assert hashing.child_token(child).hex() == want
    link = child | {"name": "l", "kind": "symlink", "h": None}
    assert hashing.child_token(link).hex() == "6c" "00" "02" + "00" * 16 + "a4010000" "01000000" "02000000" "ffffffffffffffff" "05000000" + "00" * 8


def test_posix_paths_of_the_shared_folder():
    import pytest

    from canopy import storage

    assert [storage.posix(x) for x in ("/a/b", "file:/a", "file:///a/b", "a/x:y")] == ["/a/b", "/a", "/a/b", "a/x:y"]
    with pytest.raises(ValueError):
        storage.posix("hdfs://host/a")

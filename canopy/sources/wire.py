"""A binary record format for snapshots and diffs, plain or zstd-compressed.

magic (9 bytes), then, inside the zstd frame if compressed: u32 header length, header, records of
u64 length, type byte and payload, an end marker of 9 zero bytes, and the XXH3-128 of all bytes
before it, uncompressed and with the magic. Numbers and digests are little-endian. Header and
entries are MessagePack arrays in field order. The two magics are parameters, so that files of
other programs with this layout can be read and written.

Compression, checksum and version belong to whole files, so a file is one task; chunks of a split
diff are read side by side.
"""

from __future__ import annotations

import io
import struct
import time
from collections.abc import Callable, Iterable, Iterator
from typing import BinaryIO

from ..errors import ChecksumMismatch, FormatError, VersionMismatch
from ..schema import FORMAT_VERSION

MAGIC, MAGIC_ZSTD = b"CANOPY\x00\x01\x00", b"CANOPYZ01"
ENTRY, CHANGE, CONTENT = 1, 2, 3
END = bytes(9)
KINDS = {"file": "File", "directory": "Directory", "symlink": "Symlink"}
KIND_NAMES = {v: k for k, v in KINDS.items()}


# MessagePack, as far as it is needed


def pack(x) -> bytes:
    if x is None:
        return b"\xc0"
    if x is True or x is False:
        return b"\xc3" if x else b"\xc2"
    if isinstance(x, int):
        if 0 <= x < 128:
            return bytes([x])
        if -32 <= x < 0:
            return struct.pack("b", x)
        for code, form, lo, hi in ((0xCC, ">B", 0, 2**8), (0xCD, ">H", 0, 2**16), (0xCE, ">I", 0, 2**32), (0xCF, ">Q", 0, 2**64), (0xD0, ">b", -(2**7), 0), (0xD1, ">h", -(2**15), 0), (0xD2, ">i", -(2**31), 0), (0xD3, ">q", -(2**63), 0)):
            if lo <= x < hi:
                return bytes([code]) + struct.pack(form, x)
    if isinstance(x, str):
        b = x.encode()
        n = len(b)
        head = bytes([0xA0 | n]) if n < 32 else b"\xd9" + bytes([n]) if n < 256 else b"\xda" + struct.pack(">H", n) if n < 2**16 else b"\xdb" + struct.pack(">I", n)
        return head + b
    if isinstance(x, (list, tuple)):
        n = len(x)
        head = bytes([0x90 | n]) if n < 16 else b"\xdc" + struct.pack(">H", n) if n < 2**16 else b"\xdd" + struct.pack(">I", n)
        return head + b"".join(map(pack, x))
    if isinstance(x, dict):
        return bytes([0x80 | len(x)]) + b"".join(pack(k) + pack(v) for k, v in x.items())
    raise TypeError(type(x))


NUMBERS = {0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q", 0xCA: ">f", 0xCB: ">d"}
SIZED = {0xD9: (">B", "s"), 0xDA: (">H", "s"), 0xDB: (">I", "s"), 0xC4: (">B", "b"), 0xC5: (">H", "b"), 0xC6: (">I", "b"), 0xDC: (">H", "a"), 0xDD: (">I", "a"), 0xDE: (">H", "m"), 0xDF: (">I", "m")}


def unpack(data: bytes):
    value, at = _unpack(memoryview(data), 0)
    if at != len(data):
        raise FormatError("bytes after a record's value")
    return value


def _unpack(d, at):
    try:
        c = d[at]
        at += 1
        if c < 0x80 or c >= 0xE0:
            return c - 256 * (c >= 0xE0), at
        if c in (0xC0, 0xC2, 0xC3):
            return {0xC0: None, 0xC2: False, 0xC3: True}[c], at
        if c in NUMBERS:
            n = struct.calcsize(NUMBERS[c])
            return struct.unpack_from(NUMBERS[c], d, at)[0], at + n
        if c in SIZED:
            form, kind = SIZED[c]
            n = struct.unpack_from(form, d, at)[0]
            at += struct.calcsize(form)
        else:
            kind, n = ("s", c & 31) if c >= 0xA0 else ("a", c & 15) if c >= 0x90 else ("m", c & 15)
        if kind in "sb":
            if at + n > len(d):
                raise IndexError
            raw = bytes(d[at : at + n])
            return (raw.decode() if kind == "s" else raw), at + n
        items = []
        for _ in range(n * (2 if kind == "m" else 1)):
            x, at = _unpack(d, at)
            items.append(x)
        return (items if kind == "a" else dict(zip(items[::2], items[1::2]))), at
    except (IndexError, struct.error, UnicodeDecodeError) as e:
        raise FormatError("a record's value is cut short or no MessagePack") from e


# Rows to values and back


def _digest(hex_: str | None):
    return None if hex_ is None else list(bytes.fromhex(hex_))


def _hex(value):
    return None if value is None else bytes(value).hex()


def _meta(r: dict, prefix: str = "") -> list:
    return [r[prefix + c] for c in ("size", "mtime_sec", "mtime_nsec", "permissions", "uid", "gid")]


def entry_value(r: dict) -> list:
    return [r["path"], KINDS[r["kind"]], _meta(r), _digest(r["hash"]), r["symlink_target"], _digest(r["dir_hash"])]


def entry_row(v: list) -> dict:
    size, sec, nsec, perm, uid, gid = v[2]
    return dict(path=v[0], kind=KIND_NAMES[v[1]], size=size, mtime_sec=sec, mtime_nsec=nsec, permissions=perm, uid=uid, gid=gid, hash=_hex(v[3]), symlink_target=v[4], dir_hash=_hex(v[5]))


def change_value(r: dict) -> list:
    if r["op"] == "removed":
        return [r["path"], {"Removed": KINDS[r["old_kind"]]}]
    if r["op"] == "added":
        own = [r["path"], KINDS[r["new_kind"]], _meta(r, "new_"), _digest(r["new_hash"]), r["new_symlink_target"], _digest(r.get("new_dir_hash"))]
        return [r["path"], {"Added": [own, r["has_content"]]}]
    meta = None if r["new_size"] is None else _meta(r, "new_")
    return [r["path"], {"Modified": [meta, _digest(r["new_hash"]), r["has_content"], r["new_symlink_target"]]}]


def change_row(v: list) -> dict:
    (what, body), *_ = v[1].items()
    out = dict.fromkeys(("old_kind", "new_kind", "new_size", "new_mtime_sec", "new_mtime_nsec", "new_permissions", "new_uid", "new_gid", "new_hash", "new_symlink_target"))
    out |= {"path": v[0], "op": what.lower(), "has_content": False}
    meta = None
    if what == "Removed":
        out["old_kind"] = KIND_NAMES[body]
    elif what == "Added":
        own = body[0]
        meta = own[2]
        out |= {"new_kind": KIND_NAMES[own[1]], "new_hash": _hex(own[3]), "new_symlink_target": own[4], "has_content": body[1]}
    elif what == "Modified":
        meta = body[0]
        out |= {"new_hash": _hex(body[1]), "has_content": body[2], "new_symlink_target": body[3]}
    else:
        raise FormatError(f"unknown change: {what}")
    if meta is not None:
        out |= dict(zip(("new_size", "new_mtime_sec", "new_mtime_nsec", "new_permissions", "new_uid", "new_gid"), meta))
    return out


# Files


def header_bytes(file_type: str, source_hash: str | None, root: str | None, chunk_index: int | None, created_at: int) -> bytes:
    header = pack([file_type, FORMAT_VERSION, created_at, _digest(source_hash), root, chunk_index])
    return struct.pack("<I", len(header)) + header


class RecordWriter:
    """Writes one file; `written` counts uncompressed bytes without end marker and checksum."""

    def __init__(self, f: BinaryIO, file_type: str, source_hash: str | None = None, root: str | None = None, chunk_index: int | None = None, compress: bool = False, magics=(MAGIC, MAGIC_ZSTD), created_at: int | None = None):
        import xxhash

        self.f, self.hash, self.written, self.compressed = f, xxhash.xxh3_128(), 0, compress
        magic = magics[1] if compress else magics[0]
        f.write(magic)
        self.hash.update(magic)
        self.written += len(magic)
        if compress:
            import zstandard

            self.f = zstandard.ZstdCompressor(level=3).stream_writer(f, closefd=False)
        self.put(header_bytes(file_type, source_hash, root, chunk_index, int(time.time()) if created_at is None else created_at))

    def put(self, data: bytes) -> None:
        self.f.write(data)
        self.hash.update(data)
        self.written += len(data)

    def record(self, kind: int, payload: bytes) -> None:
        self.put(struct.pack("<QB", len(payload), kind) + payload)

    def content(self, length: int, blocks) -> None:
        self.put(struct.pack("<QB", length, CONTENT))
        for b in blocks:
            self.put(b)

    def finish(self) -> None:
        self.f.write(END)
        self.hash.update(END)
        self.f.write(self.hash.digest()[::-1])
        if self.compressed:
            import zstandard

            self.f.flush(zstandard.FLUSH_FRAME)
        else:
            self.f.flush()


class RecordReader:
    """Reads one file: `header`, then records(); the checksum is compared at the end marker."""

    def __init__(self, f: BinaryIO, magics=(MAGIC, MAGIC_ZSTD)):
        import xxhash

        magic = f.read(9)
        if magic not in magics:
            raise FormatError("not in the record format")
        self.hash = xxhash.xxh3_128(magic)
        self.f = f
        if magic == magics[1]:
            import zstandard

            self.f = io.BufferedReader(zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=False))
        h = unpack(self.take(struct.unpack("<I", self.take(4))[0]))
        self.header = dict(zip(("file_type", "version", "created_at", "source_hash", "root", "chunk_index"), h))
        self.header["source_hash"] = _hex(self.header["source_hash"])

    def take(self, n: int) -> bytes:
        data = self.f.read(n)
        if len(data) != n:
            raise FormatError("the file is cut short")
        self.hash.update(data)
        return data

    def records(self, content: Callable[[int, Iterator[bytes]], None] | None = None, stop_at_content: bool = False, stream: bool = False) -> Iterator[tuple[int, bytes | Iterator[bytes] | None]]:
        """(type, payload); content goes to the callback in blocks and has no payload here, or, with
        `stream`, its payload is an iterator of blocks, of which the rest is skipped."""
        while True:
            head = self.take(9)
            if head == END:
                computed = self.hash.digest()[::-1].hex()
                stored = self.f.read(16).hex()
                if computed != stored:
                    raise ChecksumMismatch(stored, computed)
                return
            n, kind = struct.unpack("<QB", head)
            if kind not in (ENTRY, CHANGE, CONTENT):
                raise FormatError(f"unknown record type {kind}")
            if kind != CONTENT:
                yield kind, self.take(n)
                continue
            if stop_at_content:
                return

            def blocks(n=n):
                while n:
                    b = self.take(min(n, 1 << 20))
                    n -= len(b)
                    yield b

            it = blocks()
            if content:
                content(n, it)
            if stream:
                yield kind, it
            for _ in it:
                pass
            if not stream:
                yield kind, None

    def expect(self, file_type: str) -> RecordReader:
        if self.header["file_type"] != file_type:
            raise FormatError(f"a {self.header['file_type']} file where a {file_type} is needed")
        if self.header["version"] != FORMAT_VERSION:
            raise VersionMismatch(f"version {self.header['version']}; this reads {FORMAT_VERSION}")
        return self


def write_snapshot(path: str, rows, root: str | None = None, compress: bool = False, **options) -> None:
    """rows: dicts of the snapshot schema, in the order of their path keys."""
    write_runs(path, map(entry_record, rows), root, compress, **options)


def entry_record(r: dict) -> bytes:
    """A snapshot row as a record, with its length and type."""
    payload = pack(entry_value(r))
    return struct.pack("<QB", len(payload), ENTRY) + payload


def write_runs(path: str, runs: Iterable[bytes], root: str | None = None, compress: bool = False, **options) -> None:
    """runs: bytes of whole records or of parts of them, in the order of the file."""
    with open(path, "wb") as f:
        w = RecordWriter(f, "snapshot", root=root, compress=compress, **options)
        for b in runs:
            w.put(b)
        w.finish()


def read_entries(path: str, **options) -> Iterator[bytes]:
    """The entries of a snapshot file, as they are packed."""
    with open(path, "rb") as f:
        for kind, payload in RecordReader(f, **options).expect("snapshot").records():
            if kind == ENTRY:
                yield payload


def read_snapshot(path: str, **options) -> Iterator[dict]:
    for payload in read_entries(path, **options):
        yield entry_row(unpack(payload))


def read_changes(path: str, **options) -> Iterator[dict]:
    """The changes of one diff file; what follows its first content isn't read."""
    with open(path, "rb") as f:
        for kind, payload in RecordReader(f, **options).expect("diff").records(stop_at_content=True):
            if kind == CHANGE:
                yield change_row(unpack(payload))

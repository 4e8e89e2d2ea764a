"""Snapshot rows and real trees for tests."""

import os

from canopy.schema import SNAPSHOT


def file(path, size=100, mtime=1_700_000_000, hash_="aa", **more):
    return row(path, "file", size=size, mtime_sec=mtime, hash=hash_ * 16 if len(hash_) == 2 else hash_, **more)


def folder(path, mtime=1_700_000_000, **more):
    return row(path, "directory", mtime_sec=mtime, permissions=more.pop("permissions", 0o755), **more)


def link(path, target, **more):
    return row(path, "symlink", symlink_target=target, permissions=0o777, **more)


def row(path, kind, **more):
    base = {"path": path, "kind": kind, "size": 0, "mtime_sec": 1_700_000_000, "mtime_nsec": 0, "permissions": 0o644, "uid": 1000, "gid": 1000, "hash": None, "symlink_target": None, "dir_hash": None}
    assert not more.keys() - base.keys()
    return base | more


def table(spark, rows):
    return spark.createDataFrame([tuple(r[c] for c in SNAPSHOT.names) for r in rows], SNAPSHOT)


def listing(root):
    """path -> (kind, content or target, mode, mtime to the second) of everything below root."""
    out = {}
    for base, dirs, files in os.walk(root):
        for name in dirs + files:
            full = os.path.join(base, name)
            s = os.lstat(full)
            if os.path.islink(full):
                out[os.path.relpath(full, root)] = ("symlink", os.readlink(full))
            elif os.path.isdir(full):
                out[os.path.relpath(full, root)] = ("directory", s.st_mode & 0o777, int(s.st_mtime))
            else:
                with open(full, "rb") as f:
                    out[os.path.relpath(full, root)] = ("file", f.read(), s.st_mode & 0o777, int(s.st_mtime))
    return out


def write(root, path, data=b"x", mode=0o644, mtime=1_700_000_000):
    full = os.path.join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    if os.path.lexists(full):
        os.unlink(full)
    with open(full, "wb") as f:
        f.write(data)
    os.chmod(full, mode)
    os.utime(full, (mtime, mtime))

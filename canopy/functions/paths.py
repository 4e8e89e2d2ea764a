"""Relative paths as strings: '' is the root, components are joined by '/'."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def components(path: Column) -> Column:
    """The path's components, and the key by which paths are ordered: component by component."""
    return F.when(path == "", F.array().cast("array<string>")).otherwise(F.split(path, "/"))


def depth(path: Column) -> Column:
    return F.when(path == "", F.lit(0)).otherwise(F.size(F.split(path, "/")))


def parent(path: Column) -> Column:
    """'' for a top-level path, null for the root."""
    cut = F.length(path) - F.length(F.substring_index(path, "/", -1)) - 1
    return F.when(path == "", F.lit(None)).otherwise(F.substr(path, F.lit(1), F.greatest(cut, F.lit(0))))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def ancestors(path: Column, itself: bool) -> Column:
    """The root, all directories above, and the path itself if asked for; the root has no ancestor."""
    parts = F.split(path, "/")
    upto = F.when(path == "", F.lit(0)).otherwise(F.size(parts) + F.lit(int(itself) - 1))
    above = F.transform(F.sequence(F.lit(0), upto), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return above if itself else F.when(path == "", F.array().cast("array<string>")).otherwise(above)


def contains(directory: Column, child: Column) -> Column:
    """Whether child is strictly below directory; `a` doesn't contain `ab`."""
    return (child != directory) & ((directory == "") | F.startswith(child, F.concat(directory, F.lit("/"))))


def full_path(root: Column, path: Column) -> Column:
    return F.when(path == "", root).otherwise(F.concat(F.rtrim(root, F.lit("/")), F.lit("/"), path))


def is_valid(path: Column) -> Column:
    return ~F.startswith(path, F.lit("/")) & ~F.array_contains(F.split(path, "/"), "..")


def normalize(path: Column) -> Column:
    """The path without '.' and empty components; an absolute path or '..' is an error."""
    clean = F.array_join(F.filter(F.split(path, "/"), lambda c: (c != ".") & (c != "")), "/")
    return F.when(is_valid(path), clean).when(path.isNull(), F.lit(None)).otherwise(F.raise_error(F.concat(F.lit("invalid path: "), path)))


def strip_root(full: Column, root: str) -> Column:
    """The path below root; an error if it isn't below."""
    root = root.rstrip("/")
    inside = (full == root) | F.startswith(full, F.lit(root + "/"))
    return F.when(inside, normalize(F.ltrim(F.substr(full, F.lit(len(root) + 1)), F.lit("/")))).otherwise(F.raise_error(F.concat(F.lit("invalid path: "), full)))

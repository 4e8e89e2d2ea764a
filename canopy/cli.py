"""python -m canopy.cli snapshot|diff|apply|verify ..."""

from __future__ import annotations

import argparse
import sys

from .errors import CanopyError, VerificationFailed
from .progress import Progress


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="canopy", description="Snapshots of directory trees, and the changes between them.")
    p.add_argument("--algorithm", choices=("md5", "xxh3"), default="md5")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("snapshot", help="record a tree")
    s.add_argument("root")
    s.add_argument("out")
    s.add_argument("previous", nargs="?")
    d = sub.add_parser("diff", help="changes from a snapshot to the tree as it is")
    for a in ("root", "snapshot_in", "diff_out", "snapshot_out"):
        d.add_argument(a)
    d.add_argument("--split-size", help="such as 100MB; needs --records")
    d.add_argument("--mode", choices=("strict", "reference", "off"), default="strict")
    for x in (s, d):
        x.add_argument("-c", "--compress", action="store_true")
        x.add_argument("--records", action="store_true", help="write single files in the record format")
    a = sub.add_parser("apply", help="change a tree")
    a.add_argument("root")
    a.add_argument("diff")
    v = sub.add_parser("verify", help="what a diff would leave different from a snapshot")
    for x in ("root", "diff", "snapshot"):
        v.add_argument(x)
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    from pyspark.sql import SparkSession

    from .engine import Engine

    o = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("canopy").getOrCreate()
    try:
        with Progress(spark, o.command):
            out, found = run(Engine(spark, o.algorithm), o)
        if found is not None:
            report(found)
    except CanopyError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    print(", ".join(f"{k}: {v if not isinstance(v, list) else len(v)}" for k, v in out.items()), file=sys.stderr)
    return 0


def run(engine, o) -> tuple:
    """The command's figures, and for verify its findings."""
    from . import storage

    if o.command == "snapshot":
        return engine.snapshot(o.root, o.out, o.previous, o.compress, o.records), None
    if o.command == "diff":
        return engine.diff(o.root, o.snapshot_in, o.diff_out, o.snapshot_out, o.split_size, o.compress, o.mode, o.records), None
    if o.command == "apply":
        return engine.apply(o.root, o.diff), None
    return {"discrepancies": 0}, storage.save(engine.verify(o.root, o.diff, o.snapshot), "found")


def report(found) -> None:
    """Prints the findings; raises if there are any."""
    from .operators.verify import line_count

    for r in found.orderBy("path", "category").toLocalIterator():
        print(f"{r.category.upper()}: {r.path} ({r.detail})")
    if lines := line_count(found).first()["lines"]:
        raise VerificationFailed(lines)


if __name__ == "__main__":
    sys.exit(main())

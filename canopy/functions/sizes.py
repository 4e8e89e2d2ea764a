"""Byte sizes such as 500KB or 2 gb: whole numbers, units of 1024."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidSize

PATTERN = r"^\s*([0-9]+)\s*([KMG]?B?)\s*$"
LIMIT = 2**64


def parse_size(text: str) -> int:
    m = re.fullmatch(PATTERN.strip("^$"), text, re.I)
    if not m:
        raise InvalidSize(f"not a byte size: {text!r}")
    n = int(m[1]) * 1024 ** " KMG".index(m[2].upper().rstrip("B") or " ")
    if n >= LIMIT:
        raise InvalidSize(f"too large: {text!r}")
    return n


def size_column(text: Column) -> Column:
    """The same for a column, as decimal(20, 0); null where parse_size() would fail."""
    number, unit = F.regexp_extract(text, "(?i)" + PATTERN, 1), F.upper(F.regexp_extract(text, "(?i)" + PATTERN, 2))
    factor = F.when(F.startswith(unit, F.lit("K")), 1024).when(F.startswith(unit, F.lit("M")), 1024**2).when(F.startswith(unit, F.lit("G")), 1024**3).otherwise(1)
    digits = F.ltrim(number, F.lit("0"))
    n = F.when(F.length(digits) <= 20, F.concat(F.lit("0"), digits).cast("decimal(21,0)")) * factor.cast("decimal(10,0)")
    return F.when((number != "") & (n < F.lit(str(LIMIT)).cast("decimal(21,0)")), n.cast("decimal(20,0)"))

"""Semantic versions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _key(version: str) -> tuple:
    core, _, pre = version.split("+", 1)[0].lstrip("v").partition("-")
    numbers = tuple(int(x) for x in core.split("."))
    parts = tuple((0, int(p), "") if re.fullmatch(r"\d+", p) else (1, 0, p) for p in pre.split(".")) if pre else ()
    return numbers, not pre, parts


def compare(a: str, b: str) -> int:
    """-1, 0 or 1; pre-releases come before their release, build data doesn't count."""
    x, y = _key(a), _key(b)
    return (x > y) - (x < y)


def release_order(version: Column) -> Column:
    """An array by which plain releases (numbers between dots, a leading v allowed, build data ignored) sort; null for others."""
    plain = F.regexp_replace(F.split_part(version, F.lit("+"), F.lit(1)), "^v", "")
    return F.when(plain.rlike(r"^\d+(\.\d+)*$"), F.transform(F.split(plain, r"\."), lambda x: x.cast("int")))

"""Results of small queries kept as long as the log doesn't grow."""

from __future__ import annotations

import hashlib
import json
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, fields, replace
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def result_key(text: str, scopes: list[str], caller: dict[str, str], settings: dict[str, Any]) -> str:
    """The same for the same question: case, blanks and the order of scopes don't matter."""
    parts = [" ".join(text.lower().split()), sorted(scopes), sorted(caller.items()), settings]
    return hashlib.sha1(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


def log_position(ops: DataFrame) -> int:
    return ops.agg(F.max("seq")).first()[0] or 0


@dataclass
class _Entry:
    seq: int
    until: float
    rows: list[Row]


class ResultCache:
    """Up to ``size`` results, each for ``ttl`` seconds and one position of the log.

    ``clock`` gives seconds; degraded results aren't kept.
    """

    def __init__(self, clock: Callable[[], float], ttl: float = 60.0, size: int = 512) -> None:
        self.clock, self.ttl, self.size = clock, ttl, size
        self.held: OrderedDict[str, _Entry] = OrderedDict()
        self.hits = self.misses = 0

    def get(self, key: str, seq: int, make: Callable[[], tuple[list[Row], bool]]) -> list[Row]:
        e = self.held.get(key)
        if e and e.seq == seq and self.clock() < e.until:
            self.hits += 1
            self.held.move_to_end(key)
            return e.rows
        self.misses += 1
        rows, degraded = make()
        if not degraded:
            self.held[key] = _Entry(seq, self.clock() + self.ttl, rows)
            self.held.move_to_end(key)
            while len(self.held) > self.size:
                self.held.popitem(last=False)
        return rows


class RowCache:
    """Rows by id; ids that the log has changed are dropped, and everything if they are more than ``most``."""

    def __init__(self, most: int = 512) -> None:
        self.most, self.seq, self.rows = most, 0, {}

    def refresh(self, ops: DataFrame) -> None:
        new = ops.where(F.col("seq") > self.seq)
        changed = [r[0] for r in new.select("entity_id").distinct().limit(self.most + 1).collect()]
        self.rows = {} if len(changed) > self.most else {k: v for k, v in self.rows.items() if k not in set(changed)}
        self.seq = max(self.seq, new.agg(F.max("seq")).first()[0] or 0)


def with_settings(base: Any, section: dict[str, str]) -> Any:
    """A settings dataclass with the numbers of a config section; unknown and bad values leave the default."""
    got = {}
    for f in fields(base):
        if f.name in section:
            try:
                value = type(getattr(base, f.name))(section[f.name])
            except (TypeError, ValueError):
                continue
            if not isinstance(value, float) or value >= 0:
                got[f.name] = value
    return replace(base, **got)

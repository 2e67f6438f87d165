"""Personal information in free text: found by a trained tagger, replaced by typed placeholders.

Texts of any length are cut into overlapping windows, each is decoded by the
bidirectional LSTM with CRF of :mod:`pii_model`, and the windows are reconciled
over the whole text: each character takes the tag of the window in which it lies
most inside, so that every position has context on both sides, and items are
read off the one tag sequence that results.  An exact check then sets each item's
ends to whole words and to the item's own grammar, and rejects what can't be an
item of its type.

The weights are a file of the package (about 30 kB), trained by
:mod:`pii_training`; the driver reads them and executors get them once.

Defined results: null, empty and blank texts have no items and stay as they are;
positions count code points; items don't overlap; a text occurring in several
rows gives the same items in each; other columns are ignored; no limit on length.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.bpe import pieces
from graphloom.llm.pii_model import TYPES, Model, decode, symbols
from graphloom.staging import spread

WEIGHTS = str(Path(__file__).with_name("pii_weights.npz"))

#: Characters of a window, and of those at each end that another window decides.
LENGTH, MARGIN = 512, 24
_STEP = LENGTH - 2 * MARGIN
_AT_ONCE = 640

_DOT = r"(?: ?[\[(]dot[\])] ?| dot |\.)"
_GRAMMAR = {
    "email": regex.compile(rf"(?i)[\p{{L}}\d](?:[\p{{L}}\d._+'-]*[\p{{L}}\d_])?(?:@| ?[\[(]at[\])] ?| at )[\p{{L}}\d-]+(?:{_DOT}[\p{{L}}\d-]+)*{_DOT}\p{{L}}{{2,}}"),
    "phone": regex.compile(r"(?:[+＋]|\b|(?<!\w)\()\d[\d\s().‑–-]*\d"),
    "id_number": regex.compile(r"(?i)\b[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D]\b|(?:\b[A-Z]{1,2}-?)?\d[\d  -]*\d"),
}
_TITLE = regex.compile(r"(?i)^(?:mrs?|ms|dr|prof|herr|frau|hr|fr|sir|господин|госпожа|г-н|г-жа|др)\b\.?\s+")
_POSSESSIVE = regex.compile(r"['’]s?$")


def _word(ch: str) -> bool:
    return ch.isalnum() or ch in "_'’"


def snapped(text: str, kind: str, a: int, b: int) -> tuple[int, int] | None:
    """The exact ends of a found item, or None if it can't be one."""
    if kind in _GRAMMAR:
        low = max(0, a - 40)
        best = None
        for m in _GRAMMAR[kind].finditer(text, low, min(len(text), b + 40)):
            shared = min(b, m.end()) - max(a, m.start())
            if shared > 0 and (best is None or shared > best[0]):
                best = (shared, m.start(), m.end())
        if best is None or best[0] * 2 < b - a:
            return None
        a, b = best[1:]
        if kind != "email" and (text[b : b + 1].isalnum() or text[max(0, a - 1) : a].isalnum()):
            return None
        digits = sum(c.isdigit() for c in text[a:b])
        if kind == "phone" and not 7 <= digits <= 16 or kind == "id_number" and not 6 <= digits <= 14:
            return None
        if kind == "phone" and text[a] == "(" and ")" not in text[a:b]:
            a += 1
        return a, b
    while a > 0 and text[a - 1].isalnum() and text[a].isalnum():
        a -= 1
    while b < len(text) and text[b].isalnum() and text[b - 1].isalnum():
        b += 1
    while a < b and not (text[a].isalnum() or text[a] == "#"):
        a += 1
    while b > a and not text[b - 1].isalnum():
        b -= 1
    if kind == "name":
        if m := _TITLE.match(text[a:b]):
            a += m.end()
        if m := _POSSESSIVE.search(text[a:b]):
            b -= len(m.group())
        words = text[a:b].split()
        if len(words) < 2 or any(c.isdigit() for c in text[a:b]):
            return None
        return a, b
    part = text[a:b]
    return (a, b) if any(c.isdigit() for c in part) and any(c.isalpha() for c in part) else None


class Finder:
    """Finds items in lists of texts."""

    def __init__(self, model: Model) -> None:
        self.model = model

    def tags(self, texts: list[str]) -> list[np.ndarray]:
        """A tag for each code point of each text."""
        ids = [symbols(t) for t in texts]
        where = [(i, at) for i, x in enumerate(ids) for at in range(0, max(1, len(x) - 2 * MARGIN), _STEP)]
        where.sort(key=lambda w: min(LENGTH, len(ids[w[0]]) - w[1]))
        out = [np.zeros(len(x), np.int8) for x in ids]
        for k in range(0, len(where), _AT_ONCE):
            some = where[k : k + _AT_ONCE]
            longest = max(1, min(LENGTH, max(len(ids[i]) - at for i, at in some)))
            block = np.zeros((longest, len(some)), np.int64)
            for c, (i, at) in enumerate(some):
                part = ids[i][at : at + longest]
                block[: len(part), c] = part
            got = decode(self.model, block)
            for c, (i, at) in enumerate(some):
                n = min(LENGTH, len(ids[i]) - at)
                low = 0 if at == 0 else MARGIN
                high = n if at + n >= len(ids[i]) else LENGTH - MARGIN
                out[i][at + low : at + high] = got[low:high, c]
        return out

    def items(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """(type, start, end) of each item of each text, in order."""
        found = []
        for text, tags in zip(texts, self.tags(texts), strict=True):
            here: list[tuple[str, int, int]] = []
            kinds = (tags.astype(np.int64) + 1) // 2
            cuts = np.flatnonzero(np.r_[True, (kinds[1:] != kinds[:-1]) | ((tags[1:] % 2 == 1) & (tags[:-1] != 0))]) if len(tags) else tags
            for a, b in zip(cuts, np.r_[cuts[1:], len(tags)][: len(cuts)], strict=True):
                if kinds[a] and (ends := snapped(text, TYPES[kinds[a] - 1], int(a), int(b))):
                    if here and ends[0] < here[-1][2]:
                        if here[-1][0] == TYPES[kinds[a] - 1]:
                            here[-1] = (here[-1][0], min(here[-1][1], ends[0]), max(here[-1][2], ends[1]))
                        continue
                    here.append((TYPES[kinds[a] - 1], *ends))
            found.append(here)
        return found


def _distinct_items(finder: Finder, texts: list[str | None]) -> list[list[tuple[str, int, int]]]:
    """Items of each text; equal texts of a batch are read once."""
    different = list(dict.fromkeys(t for t in texts if t and not t.isspace()))
    known = dict(zip(different, finder.items(different), strict=True))
    return [known.get(t, []) for t in texts]


def find(documents: DataFrame, key: str = "doc_id", text: str = "text", weights: str = WEIGHTS) -> DataFrame:
    """(key, pii_type, start_at, end_at) of every item; one pass, no shuffle."""
    model = documents.sparkSession.sparkContext.broadcast(Model.load(weights).w)
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(Model(model.value))
        for batch in batches:
            for part in pieces(batch, "_text"):
                rows, kinds, starts, ends = [], [], [], []
                for r, items in enumerate(_distinct_items(finder, part.column("_text").to_pylist())):
                    for k, a, b in items:
                        rows.append(r)
                        kinds.append(k)
                        starts.append(a)
                        ends.append(b)
                keys = part.column(0).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], [key, "pii_type", "start_at", "end_at"])

    return spread(documents.select(F.col(key), F.col(text).alias("_text"))).mapInArrow(run, f"`{key}` {kind}, pii_type string, start_at int, end_at int")


def replaced(text: str | None, items: list[tuple[str, int, int]]) -> str | None:
    """The text with ``<TYPE>`` in place of each item."""
    if not text or not items:
        return text
    out, at = [], 0
    for kind, a, b in items:
        out += [text[at:a], f"<{kind.upper()}>"]
        at = b
    return "".join([*out, text[at:]])


def redact(documents: DataFrame, key: str = "doc_id", text: str = "text", weights: str = WEIGHTS) -> DataFrame:
    """(key, text) with placeholders, and the number of items replaced."""
    model = documents.sparkSession.sparkContext.broadcast(Model.load(weights).w)
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(Model(model.value))
        for batch in batches:
            for part in pieces(batch, "_text"):
                texts = part.column("_text").to_pylist()
                items = _distinct_items(finder, texts)
                done = pa.array([replaced(t, i) for t, i in zip(texts, items, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), done, pa.array([len(i) for i in items], pa.int32())], [key, "text", "n_items"])

    return spread(documents.select(F.col(key), F.col(text).alias("_text"))).mapInArrow(run, f"`{key}` {kind}, text string, n_items int")

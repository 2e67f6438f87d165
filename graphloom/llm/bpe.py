"""Byte-level BPE of a whole column by batched numpy merge rounds.

The words of a batch of texts are laid out in one flat array of symbols.  A
round looks up all neighbouring symbols at once by binary search over the
sorted pair keys, takes the lowest rank of each word, merges every occurrence
of it and closes the gaps; words without a pair left drop out.  Words that
occur several times in a batch are encoded once.

The vocabulary file is read by the driver; executors get it as two arrays of a
size fixed by the vocabulary (about 200 000 pairs), never by the data.

Defined results: null and empty texts give an empty list; blanks and control
characters are text like any other; a very long word without blanks takes as
many rounds as it has different merges; texts are never cut.
"""

from __future__ import annotations

import base64
import binascii
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.staging import spread

#: Where the public vocabulary files are.
VOCABULARY_FOLDER = "/opt/tokenizers"

#: Fixed value: the public pattern by which the byte-level vocabularies split text into words.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_NONE = np.int32(2**31 - 1)
#: Texts of a batch are encoded together up to so many characters, which bounds the memory of a worker.
_CHARS_AT_ONCE = 2_000_000


@dataclass(frozen=True)
class PairTable:
    """Sorted pair keys (left << 32 | right), the id each pair merges to, and the id of each byte."""

    keys: np.ndarray
    merged: np.ndarray
    byte_ids: np.ndarray


def read_ranks(path: str) -> dict[bytes, int]:
    """The tokens of a rank file with their ids."""
    ranks = {}
    with open(path, "rb") as f:
        for n, line in enumerate(f, 1):
            if line.strip():
                try:
                    token, rank = line.split()
                    ranks[base64.b64decode(token, validate=True)] = int(rank)
                except (ValueError, binascii.Error) as e:
                    raise ValueError(f"{path}, line {n}: not a token and its rank") from e
    return ranks


def pair_table(ranks: dict[bytes, int]) -> PairTable:
    """All ways in which two tokens make a third."""
    keys, merged = [], []
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                keys.append(left << 32 | right)
                merged.append(rank)
    k, m = np.array(keys, np.int64), np.array(merged, np.int32)
    order = np.argsort(k)
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"the vocabulary has no token for {len(missing)} of the 256 bytes")
    return PairTable(k[order], m[order], np.array([ranks[bytes([b])] for b in range(256)], np.int32))


@lru_cache(maxsize=4)
def load_vocabulary(name: str = "byte_bpe_50k", folder: str = VOCABULARY_FOLDER) -> PairTable:
    return pair_table(read_ranks(f"{folder}/{name}.tiktoken"))


def merge_words(words: list[bytes], table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words in one array, and where each word's ids begin (one more entry than words)."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    symbols = table.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    owner = np.repeat(np.arange(len(words), dtype=np.int64), lengths)
    done_symbols, done_owner = [], []
    while len(symbols):
        key = symbols[:-1].astype(np.int64) << 32 | symbols[1:]
        slot = np.minimum(np.searchsorted(table.keys, key), len(table.keys) - 1)
        rank = np.full(len(symbols), _NONE, np.int32)
        hit = (table.keys[slot] == key) & (owner[:-1] == owner[1:])
        rank[:-1][hit] = table.merged[slot[hit]]
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        sizes = np.diff(np.r_[starts, len(owner)])
        best = np.repeat(np.minimum.reduceat(rank, starts), sizes)
        at = (rank == best) & (best != _NONE)
        # in a run of overlapping occurrences the first, third, ... are merged
        where = np.flatnonzero(at)
        if len(where):
            fresh = np.r_[True, np.diff(where) != 1]
            run_start = where[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
            chosen = where[(where - run_start) % 2 == 0]
            symbols = symbols.copy()
            symbols[chosen] = rank[chosen]
            keep = np.ones(len(symbols), bool)
            keep[chosen + 1] = False
        else:
            keep = np.ones(len(symbols), bool)
        over = best == _NONE
        done_symbols.append(symbols[over])
        done_owner.append(owner[over])
        keep &= ~over
        symbols, owner = symbols[keep], owner[keep]
    if not done_symbols:
        return np.zeros(0, np.int32), np.zeros(len(words) + 1, np.int64)
    symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
    order = np.argsort(owner, kind="stable")
    bounds = np.r_[0, np.cumsum(np.bincount(owner, minlength=len(words)))]
    return symbols[order], bounds


class Encoder:
    """Encodes lists of texts with one vocabulary."""

    def __init__(self, table: PairTable) -> None:
        self.table = table
        self.find = regex.compile(WORD_PATTERN).findall

    def _words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Word number of every word of every text, words per text, and the different words."""
        numbers: dict[str, int] = {}
        flat: list[int] = []
        counts = np.zeros(len(texts), np.int64)
        number = numbers.setdefault
        for i, text in enumerate(texts):
            if text:
                found = self.find(text)
                counts[i] = len(found)
                flat += [number(w, len(numbers)) for w in found]
        return np.array(flat, np.int64), counts, [w.encode("utf-8", "surrogatepass") for w in numbers]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and where each text's ids begin."""
        flat, counts, words = self._words(texts)
        ids, bounds = merge_words(words, self.table)
        sizes = np.diff(bounds)[flat] if len(flat) else np.zeros(0, np.int64)
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        gather = np.arange(total) + np.repeat(bounds[flat] - (ends - sizes), sizes) if total else np.zeros(0, np.int64)
        text_ends = np.r_[0, ends][np.r_[0, np.cumsum(counts)]]
        return ids[gather] if total else np.zeros(0, np.int32), text_ends

    def count(self, texts: list[str | None]) -> np.ndarray:
        """The number of ids of each text."""
        flat, counts, words = self._words(texts)
        sizes = np.diff(merge_words(words, self.table)[1])[flat] if len(flat) else np.zeros(0, np.int64)
        return np.diff(np.r_[0, np.cumsum(sizes)][np.r_[0, np.cumsum(counts)]])


def pieces(batch: pa.RecordBatch, column: str, at_once: int = _CHARS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``at_once`` bytes of text, at least one row each."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(size):
        if held and held + n > at_once:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def encode_table(documents: DataFrame, key: str, text: str, vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARY_FOLDER) -> DataFrame:
    """(key, ids) of every row of ``documents``; no shuffle, one pass."""
    tables = documents.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary, folder))
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tables.value)
        for batch in batches:
            for part in pieces(batch, "_text"):
                ids, ends = encoder.encode(part.column("_text").to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["key", "ids"])

    out = spread(documents.select(F.col(key).alias("key"), F.col(text).alias("_text"))).mapInArrow(run, f"key {kind}, ids array<int>")
    return out.withColumnRenamed("key", key)


def count_table(documents: DataFrame, keep: list[str], text: str, vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARY_FOLDER) -> DataFrame:
    """The columns ``keep`` and ``n_tokens`` of every row of ``documents``."""
    tables = documents.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary, folder))
    kinds = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tables.value)
        for batch in batches:
            for part in pieces(batch, "_text"):
                n = encoder.count(part.column("_text").to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(n, pa.int64())], [*keep, "n_tokens"])

    return spread(documents.select(*keep, F.col(text).alias("_text"))).mapInArrow(run, f"{kinds}, n_tokens long")

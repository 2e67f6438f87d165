"""Texts to vectors: word pieces, pooling, and the checks around a model.

A model is any callable from (ids, mask) arrays to hidden states; it runs in
Arrow batches on the executors.
"""

from __future__ import annotations

import unicodedata
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Model = Callable[[np.ndarray, np.ndarray], np.ndarray]

#: Words of more characters than this are unknown.
LONGEST_WORD = 100


@dataclass(frozen=True)
class Embedding:
    """What makes vectors comparable: model, dimension, pooling and prefixes."""

    model: str
    dim: int
    pooling: str = "mean"
    query_prefix: str = "query: "
    passage_prefix: str = "passage: "
    longest: int = 512

    def fingerprint(self) -> str:
        return f"{self.model}:{self.dim}:{self.pooling}:{self.query_prefix}:{self.passage_prefix}"

    def check(self, stored: str) -> None:
        if stored != self.fingerprint():
            raise ValueError("the stored vectors were made by another model or setting")


def _basic(text: str) -> list[str]:
    """Lower case without marks; punctuation and CJK characters stand alone."""
    out: list[str] = []
    word = ""
    for ch in unicodedata.normalize("NFD", text.lower()):
        kind = unicodedata.category(ch)
        if kind == "Mn" or (kind[0] == "C" and not ch.isspace()):
            continue
        alone = kind[0] in "PS" or 0x4E00 <= ord(ch) <= 0x9FFF
        if alone or ch.isspace():
            if word:
                out.append(word)
            word = ""
            if alone:
                out.append(ch)
        else:
            word += ch
    return [*out, word] if word else out


class WordPieces:
    """Greedy longest pieces; a word with a part not in the vocabulary is unknown as a whole."""

    def __init__(self, tokens: list[str]) -> None:
        self.ids = {t: i for i, t in enumerate(dict.fromkeys(t.rstrip("\r") for t in tokens if t.rstrip("\r")))}
        if not {"[CLS]", "[SEP]", "[UNK]"} <= set(self.ids):
            raise ValueError("the vocabulary lacks [CLS], [SEP] or [UNK]")

    def word(self, word: str) -> list[int]:
        out, at = [], 0
        while at < len(word) <= LONGEST_WORD:
            end = next((e for e in range(len(word), at, -1) if ("##" if at else "") + word[at:e] in self.ids), None)
            if end is None:
                return [self.ids["[UNK]"]]
            out.append(self.ids[("##" if at else "") + word[at:end]])
            at = end
        return out or [self.ids["[UNK]"]]

    def encode(self, text: str, longest: int = 512) -> list[int]:
        inner = [i for w in _basic(text) for i in self.word(w)]
        return [self.ids["[CLS]"], *inner[: longest - 2], self.ids["[SEP]"]]


class UnigramPieces:
    """The likeliest split by scores of pieces; what no piece covers is unknown, character by character."""

    def __init__(self, scores: dict[str, float], unknown: int = 0) -> None:
        self.scores = scores
        self.ids = {p: i for i, p in enumerate(scores)}
        self.unknown = unknown
        self.longest = max(map(len, scores), default=1)
        self.penalty = min(scores.values(), default=0.0) - 10

    def encode(self, text: str) -> list[int]:
        t = "▁" + " ".join(unicodedata.normalize("NFKC", text).split()).replace(" ", "▁")
        best: list[tuple[float, int]] = [(0.0, 0)] + [(-np.inf, 0)] * len(t)
        for end in range(1, len(t) + 1):
            for at in range(max(0, end - self.longest), end):
                s = self.scores.get(t[at:end], self.penalty if end - at == 1 else None)
                if s is not None and best[at][0] + s > best[end][0]:
                    best[end] = (best[at][0] + s, at)
        out, end = [], len(t)
        while end:
            at = best[end][1]
            out.append(self.ids.get(t[at:end], self.unknown))
            end = at
        return out[::-1]


def pooled(hidden: np.ndarray, mask: np.ndarray, pooling: str = "mean") -> np.ndarray:
    """Unit vectors from (batch, time, dim) states: the first, or the mean over the mask; zeros stay zero."""
    if pooling == "cls":
        v = hidden[:, 0]
    else:
        m = mask[:, :, None]
        v = (hidden * m).sum(1) / np.maximum(m.sum(1), 1)
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, norm, out=np.zeros_like(v, dtype=float), where=norm > 0)


def embedded(rows: DataFrame, key: str, text: str, encode: Callable[[str], list[int]], model: Model, setting: Embedding, role: str = "passage") -> DataFrame:
    """(key, vector) of every row; a null text counts as empty."""
    prefix = setting.query_prefix if role == "query" else setting.passage_prefix
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = [encode(prefix + (t if isinstance(t, str) else ""))[: setting.longest] for t in b[text]]
            width = max(map(len, ids), default=1)
            block, mask = np.zeros((len(ids), width), np.int64), np.zeros((len(ids), width))
            for i, x in enumerate(ids):
                block[i, : len(x)], mask[i, : len(x)] = x, 1
            v = pooled(model(block, mask), mask, setting.pooling)
            if len(v) and v.shape[1] != setting.dim:
                raise ValueError(f"the model gives {v.shape[1]} dimensions, not {setting.dim}")
            yield pd.DataFrame({key: b[key], "vector": list(v.astype(np.float32))})

    return rows.select(F.col(key), F.col(text)).mapInPandas(run, f"`{key}` {kind}, vector array<float>")


class Recent:
    """The last used ``size`` values by key."""

    def __init__(self, size: int = 512) -> None:
        self.size, self.held = size, OrderedDict()

    def get(self, key: str, make: Callable[[], object]) -> object:
        if key in self.held:
            self.held.move_to_end(key)
        else:
            self.held[key] = make()
            if len(self.held) > self.size:
                self.held.popitem(last=False)
        return self.held[key]

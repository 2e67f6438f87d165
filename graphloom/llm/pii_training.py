"""Labelled spans to train the model of personal information, and its training.

    python -m graphloom.llm.pii_training documents.parquet weights.npz [seconds [start.npz]]

The labels are made by strict patterns that hold for the sample only: item
grammars tied to the words around them and to the syllables of the roster's
names.  So that the model doesn't learn these syllables and number ranges, most
copies of a text have their items replaced by invented ones and sentences put in
(:mod:`pii_shapes`).  The sample is bounded by ``SAMPLE`` documents.
"""

from __future__ import annotations

import sys

import numpy as np
import regex

from graphloom.llm.pii_model import TYPES, Model, symbols, train
from graphloom.llm.pii_shapes import Shapes

#: At most so many documents are labelled.
SAMPLE = 10_000
#: Characters of a window, and how far windows begin from each other in training.
LENGTH, STRIDE = 128, 96

_GIVEN = r"(?:Bren|Cal|Dre|Fen|Gal|Hes|Ilm|Jov|Kel|Lor|Mar|Nev|Ori|Pel|Quin|Ros|Sul|Tam|Tol|Ulr|Vex|Wyn|Ysa|Zel)(?:amir|andra|ane|dor|essa|ette|ika|isk|ius|olda|oth|ric|vin|wen)"
_STEM = r"(?:Bray|Cott|Drum|Ebb|Farn|Fen|Gorse|Hatt|Hol|Ink|Jarr|Kest|Lund|Marl|Nock|Orm|Pinn|Quar|Rusk|Sted|Thrap|Vard)(?:acre|ander|brandt|dersley|ellier|holme|ikovi[cć]|mquist|ovitz|renby|str[öo]m|tarsen|wick)"
_FAMILY = rf"{_STEM}(?:-{_STEM})?"
_RU_GIVEN = "(?:Остин|Мирава|Ярма|Никлава|Лежана|Гордан|Селва|Тордей|Брусар|Велсан)"
_RU_FAMILY = r"(?:Стедов|Пиндар|Лундин|Врядов|Жарцев|Кварин|Фендарь|Брайцев|Холмаев|Оркалин)а?"
_GAP = r"[  \t\n]+"
_LABEL = r"[\w-]+"
_TYPE = r"(?:Street|Avenue|Boulevard|Road|Lane|Drive|Court|Way|Place|Terrace|Square|Close|St|Ave|Blvd|Rd|Ln|Ct)"
_ANNOUNCED = r"(?:ssn|social security number|NI number|insurance (?:no\.?|number)|passport(?: no\.?)?|id card|taxpayer id|tax id|Steuer-ID|Steuernummer|Ausweis|Personalausweis|паспорт|СНИЛС|ИНН)"

PATTERNS = {
    "email": [
        r"(?<![\w.+/@-])(?!git@)(?<!://)[\p{L}\d][\p{L}\d._+-]*@(?:[\p{L}\d-]+\.)+\p{L}{2,}(?![\p{L}\d]|:\S)",
        rf"(?<![\w.+/@-])[\p{{L}}\d][\p{{L}}\d._+-]*(?: ?[\[(]at[\])] ?| at ){_LABEL}(?:(?: ?[\[(]dot[\])] ?| dot |\.){_LABEL})*(?: ?[\[(]dot[\])] ?| dot |\.)(?:example|test|invalid|com|org|net)\b",
    ],
    "phone": [
        r"(?<![\w.+-])(?:\+|＋|00(?=\d\d-\d\d-))\d[\d  ().\-‑–]{6,20}\d(?![\w-])",
        r"(?<![\w.+-])(?:1[-. ])?\(?\d{3}\)?[-. ]?555[-. ]?\d{4}(?![\w-])",
        r"(?<![\w.+-])0\d{3,4}[ -]?\d{3}[ -]?\d{3}(?![\w-])",
    ],
    "id_number": [
        rf"(?i)\b{_ANNOUNCED}[ :=]+\K(?:[A-Z]{{1,2}}-?)?\d[\d  -]{{4,14}}\d(?: [A-D])?(?![\w-])",
        r"(?<![\w-])9\d\d-\d\d-\d{4}(?![\w-])",
        r"(?i)\bNI number[ :=]+\K[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D](?!\w)",
    ],
    "address": [
        rf"(?i)\b(?:(?:Flat|Unit|Apt|Apartment|Suite)\.? \w{{1,4}}, )?\d{{1,4}}(?:-\d{{1,4}})?[a-z]? (?!the |day )(?:(?:St\.|(?!the |mb |rows )\p{{L}}[\p{{L}}'’]*)[ ]){{1,3}}{_TYPE}\b(?:\.?,? (?:#\d+|(?:Apt|Suite|Flat|Unit|Apartment)\.? ?\w{{1,4}}\b))?",
        r"ул\. [\p{L}-]+, (?:д\. ?)?\d+[a-zа-я]?(?:, кв\. ?\d+)?",
        r"[\p{Lu}][\p{L}-]+ улица, (?:дом|д\.) ?\d+[a-zа-я]?(?:, кв\. ?\d+)?",
        r"\p{Lu}\p{L}+(?:weg|straße|strasse|str\.|platz|allee|gasse|damm|ufer) \d+(?:-\d+)?[a-z]?\b",
    ],
    "name": [
        rf"(?i)\b(?:{_GIVEN}{_GAP}(?:\p{{L}}\.{_GAP}|(?:van|von|de|der|den|di|la|le){_GAP})*{_FAMILY}|{_FAMILY},{_GAP}{_GIVEN}|\p{{L}}\.{_GAP}{_FAMILY})\b",
        rf"(?i)\b(?:{_RU_GIVEN}{_GAP}{_RU_FAMILY}|{_RU_FAMILY},?{_GAP}{_RU_GIVEN}|\p{{L}}\.{_GAP}{_RU_FAMILY})\b",
    ],
}
_COMPILED = [(k, regex.compile(p)) for k in ("id_number", *(t for t in TYPES if t != "id_number")) for p in PATTERNS[k]]


def label(text: str) -> list[tuple[str, int, int]]:
    """(type, start, end) of the items of a text of the sample; earlier types win overlaps."""
    taken = np.zeros(len(text) + 1, bool)
    out = []
    for kind, find in _COMPILED:
        for m in find.finditer(text):
            a, b = m.start(), m.end()
            a = a + (len(m.group()) - len(m.group().lstrip()))
            if not taken[a:b].any():
                taken[a:b] = True
                out.append((kind, a, b))
    return sorted(out, key=lambda x: x[1])


def varied(text: str, items: list[tuple[str, int, int]], rng: np.random.Generator) -> str:
    """The text with some items in another case or with other blanks, all of the same length."""
    chars = list(text)
    for kind, a, b in items:
        part, dice = text[a:b], rng.random()
        if dice < 0.15 and len(part.upper()) == len(part):
            part = part.upper()
        elif dice < 0.3 and len(part.lower()) == len(part):
            part = part.lower()
        if kind == "name" and rng.random() < 0.25:
            part = part.replace(" ", str(rng.choice(["\n", "\u00a0", " "])))
        chars[a:b] = part
    return "".join(chars)


def _windows(told: tuple[list[str], int, int]) -> tuple[list, list]:
    """(windows with items, windows without) of some texts: as they are, varied, and ``copies`` times rewritten."""
    texts, seed, copies = told
    rng = np.random.default_rng(seed)
    shapes, rich, poor = Shapes(rng), [], []

    def cut(text: str, items: list[tuple[str, int, int]]) -> None:
        ids, tags = symbols(text), np.zeros(len(text), np.int8)
        for kind, a, b in items:
            k = TYPES.index(kind)
            tags[a], tags[a + 1 : b] = 1 + 2 * k, 2 + 2 * k
        for at in range(-int(rng.integers(0, STRIDE)), len(text), STRIDE):
            a, b = max(0, at), at + LENGTH
            w, t = np.zeros(LENGTH, np.int16), np.zeros(LENGTH, np.int8)
            part = ids[a:b]
            w[: len(part)], t[: len(part)] = part, tags[a:b]
            (rich if t.any() else poor).append((w, t))

    for text in texts:
        items = label(text)
        cut(text, items)
        if items:
            cut(varied(text, items, rng), items)
        for _ in range(copies if items else 1):
            cut(*shapes.rewritten(text, items))
        if rng.random() < 0.5:
            cut(*shapes.sentence())
    return rich, poor


def training_windows(texts: list[str], seed: int = 7, copies: int = 2, workers: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Windows with items, and half as many without."""
    import multiprocessing

    texts = texts[:SAMPLE]
    parts = [(texts[k :: 4 * workers], seed * 1000 + k, copies) for k in range(4 * workers)]
    with multiprocessing.get_context("fork").Pool(workers) as pool:
        got = pool.map(_windows, parts, chunksize=1)
    rich = [w for r, _ in got for w in r]
    poor = [w for _, p in got for w in p]
    few = [poor[i] for i in np.random.default_rng(seed).permutation(len(poor))[: len(rich) // 2]]
    both = rich + few
    return np.stack([w for w, _ in both]), np.stack([t for _, t in both])


def main() -> None:
    import pyarrow.parquet as pq

    source, target = sys.argv[1:3]
    seconds = float(sys.argv[3]) if len(sys.argv) > 3 else 900.0
    texts = [t for t in pq.read_table(source, columns=["text"])["text"].to_pylist() if t]
    windows, tags = training_windows(list(dict.fromkeys(texts)))
    print(len(windows), "windows", np.bincount(tags.ravel()).tolist(), flush=True)
    start = Model.load(sys.argv[4]) if len(sys.argv) > 4 else None
    train(windows, tags, seconds=seconds, rate=3e-3 if start else 1e-2, start=start).save(target)


if __name__ == "__main__":
    main()

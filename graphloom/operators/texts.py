"""Comparing, classifying and cutting texts.

What built-in functions can say stays in the JVM; Unicode normalisation and
word-level signals run in Arrow batches.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Word lists of the text signals.
NEGATION_BEFORE = ("не", "нельзя", "никогда", "никакой", "без", "вне", "not", "no", "never", "cannot", "dont", "doesnt", "isnt", "without")
NEGATION_AFTER = ("нет", "отсутствует", "отсутствуют")
FUNCTION_WORDS = (
    "и", "в", "во", "на", "с", "со", "к", "по", "а", "но", "же", "ли", "бы", "то", "что", "это", "как", "для", "от", "до", "из", "о", "об", "у", "за",
    "the", "a", "an", "of", "to", "in", "on", "at", "is", "are", "be", "it", "this", "that", "and", "or",
)
ANTONYMS = (
    ("включ", "выключ"), ("включ", "отключ"), ("enable", "disable"), ("разреш", "запрещ"), ("allow", "forbid"), ("allow", "deny"), ("всегда", "никогда"),
    ("always", "never"), ("синхрон", "асинхрон"), ("sync", "async"), ("обязател", "опционал"), ("required", "optional"), ("true", "false"), ("можно", "нельзя"),
    ("верно", "неверно"), ("быстр", "медлен"), ("fast", "slow"), ("безопас", "опас"), ("дёшев", "дорог"), ("дешев", "дорог"), ("cheap", "expensive"),
    ("увелич", "уменьш"), ("increase", "decrease"), ("больше", "меньше"), ("more", "less"), ("выше", "ниже"), ("above", "below"), ("до", "после"),
    ("before", "after"), ("внутри", "снаружи"), ("явно", "автомат"), ("explicit", "automatic"),
)
#: Words that announce a replacement; a trailing star leaves the end open.
UPDATE_WORDS = (
    "теперь", "больше не", "отныне", "обновл*", "замен(?:ён|ен|ил|яет|или)*", "вместо", "с версии", "устарел*", "пересмотр*", "поправк*", "уточнени*",
    "исправлен*", "измен(?:ен[ыоа]?|ён)", "now", "no longer", "updated?", "replaced?", "instead", "as of", "changed", "deprecated", "supersed*",
    "correct(?:ion|ed)", "revised",
)
THRESHOLDS = {"dup_cos": 0.99, "dup_jac": 0.7, "cand_cos": 0.845, "cand_jac": 0.2, "dup_jac_text": 0.9, "cand_jac_text": 0.2, "related": 3}
LEAST_COVERAGE = 0.35
INTENT_STEMS = {
    "fix": ("fix", "bug", "crash", "broke", "regre", "fail", "repai", "patch", "hotfi", "испра", "почин", "падае", "ошибк", "чинит", "слома", "дефек", "баг"),
    "feature": ("add", "imple", "suppo", "featu", "creat", "intro", "build", "enabl", "new", "добав", "реали", "сдела", "ввест", "завес", "созда", "постр", "научи"),
    "refactor": ("refac", "extra", "renam", "clean", "simpl", "inlin", "move", "split", "unify", "рефак", "вынес", "переи", "упрос", "перен", "разде", "приве", "почис"),
    "test": ("test", "spec", "cover", "fuzz", "mutat", "тест", "покры", "мутац", "прове"),
    "docs": ("doc", "readm", "comme", "guide", "chang", "докум", "описа", "комме", "поясн", "замет"),
    "config": ("ci", "deps", "bump", "upgra", "confi", "docke", "lint", "build", "relea", "packa", "завис", "обнов", "конфи", "сборк", "выкат", "релиз"),
    "investigate": ("inves", "why", "analy", "expla", "explo", "audit", "check", "resea", "разбо", "почем", "выясн", "объяс", "иссле", "понят", "сравн"),
}
INTENT_ORDER = ("fix", "config", "test", "docs", "refactor", "feature", "investigate")
SECTION_WORDS = (("claim|утвержд", "claim"), ("plan|план|todo|задач", "plan_item"), ("reference|источник|ссылк|citation", "reference"), ("risk|риск", "risk"))
PATH_PATTERN = r"(?<![\w./~-])((?:\./)?(?:(?:\.[A-Za-z_]|[A-Za-z0-9_@-])[A-Za-z0-9_@.-]*/)+(?:\.[A-Za-z_]|[A-Za-z0-9_@-])[A-Za-z0-9_@.-]*\.[A-Za-z][A-Za-z0-9]*)(?::\d+(?:-\d+)?)?(?![A-Za-z0-9_@/-])"

_WORDS = re.compile(r"\w+")
_NUMBERS = re.compile(r"\d+(?:[.,]\d+)?")
_UPDATES = [re.compile(rf"(?<![^\W_]){w.rstrip('*')}" + ("" if w.endswith("*") else r"(?![^\W_])")) for w in UPDATE_WORDS]


def level(text: str) -> str:
    """NFKC, single blanks, no end marks, lower case."""
    return re.sub(r"[\s.,;:!?…]+$", "", " ".join(unicodedata.normalize("NFKC", text).split())).lower()


def trigrams(text: str) -> set[str]:
    t = f" {level(text)} "
    return {t[i : i + 3] for i in range(len(t) - 2)} if len(t) >= 3 else set()


def jaccard(a: set[str], b: set[str]) -> float:
    if not a and not b:
        return 1.0
    both = len(a & b)
    return both / (len(a) + len(b) - both) if both else 0.0


def word_list(text: str) -> list[str]:
    return _WORDS.findall(re.sub("['’]", "", level(text)))


def _polarity(words: list[str]) -> tuple[set[str], set[str]]:
    negated, plain, skip = set(), set(), {*NEGATION_BEFORE, *NEGATION_AFTER, *FUNCTION_WORDS}
    for before, w, after in zip(["", *words], words, [*words[1:], ""], strict=False):
        if w not in skip:
            (negated if before in NEGATION_BEFORE or after in NEGATION_AFTER else plain).add(w[:5])
    return negated, plain


def signals(old: str, new: str) -> dict[str, float | bool]:
    """Coverage of the old words, growth, a declared update, a flip of polarity, a drift of numbers."""
    a, b = word_list(old), word_list(new)
    sa, sb = set(a), set(b)
    na, pa = _polarity(a)
    nb, pb = _polarity(b)
    only_a, only_b = sa - sb, sb - sa

    def has(side: set[str], stem: str) -> bool:
        return any(w.startswith(stem) for w in side)

    flip = bool(na & (pb - nb) or nb & (pa - na)) or any((has(only_a, x) and has(only_b, y)) or (has(only_a, y) and has(only_b, x)) for x, y in ANTONYMS)
    la, lb = level(old), level(new)
    numbers = [{m.replace(",", ".") for m in _NUMBERS.findall(unicodedata.normalize("NFKC", t))} for t in (old, new)]
    return {
        "coverage": len(sa & sb) / len(sa) if sa else 1.0,
        "growth": len(b) / len(a) if a else 1.0,
        "update": any(p.search(lb) and not p.search(la) for p in _UPDATES),
        "flip": flip,
        "drift": bool(numbers[0] and numbers[1] and numbers[0] != numbers[1]),
    }


FEATURES = "same boolean, jac double, coverage double, growth double, updates boolean, flip boolean, drift boolean"


def pair_features(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and the features of each (old, new); a null text counts as empty."""
    kinds = ", ".join(f"`{k}` {pairs.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for old, new in zip(batch["old"].fillna(""), batch["new"].fillna(""), strict=True):
                s = signals(old, new)
                rows.append((level(old) == level(new), jaccard(trigrams(old), trigrams(new)), s["coverage"], s["growth"], s["update"], s["flip"], s["drift"]))
            yield pd.concat([batch[keys].reset_index(drop=True), pd.DataFrame(rows, columns=["same", "jac", "coverage", "growth", "updates", "flip", "drift"])], axis=1)

    return pairs.select(*keys, "old", "new").mapInPandas(run, f"{kinds}, {FEATURES}")


def verdict(t: dict[str, float] = THRESHOLDS) -> Column:
    """duplicate, update, contradiction, related or new; ``cos`` is null without vectors."""
    cos, jac = F.col("cos"), F.col("jac")
    structural = F.col("coverage") >= LEAST_COVERAGE
    changed = F.col("updates") | (structural & (F.col("flip") | F.col("drift")))
    plain = F.when((jac >= t["dup_jac_text"]) & ~changed, "duplicate").when(jac >= t["cand_jac_text"], "related").otherwise("new")
    full = (
        F.when((cos >= t["dup_cos"]) & (jac >= t["dup_jac"]) & ~changed, "duplicate")
        .when((cos < t["cand_cos"]) & (jac < t["cand_jac"]), "new")
        .when(structural & F.col("updates"), "update")
        .when(structural & (F.col("flip") | F.col("drift")), "contradiction")
        .when((F.col("coverage") >= 0.9) & (F.col("growth") >= 1.2), "update")
        .otherwise("related")
    )
    return F.when(F.col("same"), "duplicate").when(cos.isNull(), plain).otherwise(full)


CLASS_RANK = {"duplicate": 0, "update": 1, "contradiction": 2, "related": 3}


def best_target(judged: DataFrame, key: str, target: str, related: int = 3) -> DataFrame:
    """Per incoming text the target of the best class and weight, and up to ``related`` others in order."""
    rank = F.coalesce(*(F.when(F.col("verdict") == c, F.lit(r)) for c, r in CLASS_RANK.items()))
    rows = judged.withColumn("rank", rank).where("rank is not null").withColumn("weight", F.coalesce("cos", "jac"))
    w = Window.partitionBy(key).orderBy("rank", F.desc("weight"), target)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= 1 + related).select(key, target, "verdict", "weight", "place")


def canonical_of(a: str, b: str) -> Column:
    """Of two records (structs of created_at, confidence, id) the older, then surer, then smaller id."""
    def order(x: str) -> Column:
        return F.struct(F.col(f"{x}.created_at"), (-F.col(f"{x}.confidence")).alias("c"), F.col(f"{x}.id"))

    return F.least(order(a), order(b))["id"]


def single_blanks(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)[\s\x{FEFF}]+", " "))


def excerpt(body: Column, most: int = 300) -> Column:
    """At most ``most`` code points, cut at a blank if that keeps four fifths; null gives an empty text."""
    flat = F.coalesce(single_blanks(body), F.lit(""))
    head = F.substring(flat, 1, most - 1)
    last = F.length(head) - F.instr(F.reverse(head), " ")
    cut = F.when(F.contains(head, F.lit(" ")) & (last >= int((most - 1) * 0.8)), F.rtrim(head.substr(F.lit(1), last))).otherwise(F.rtrim(head))
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(cut, F.lit("…")))


def content_hash(kind: Column, title: Column, body: Column) -> Column:
    flat = (single_blanks(F.coalesce(c, F.lit(""))) for c in (title, body))
    return F.sha2(F.concat_ws("\0", kind, *flat), 256)


# What paths of tests, documents and configuration look like.
TEST_FILE, TEST_FOLDER = r"(?i)(\.test\.|\.spec\.|_test\.|(^|/)test_)", r"(?i)(^|/)(__tests__|tests?|spec)/"
DOC_FILE = r"(?i)\.(md|mdx|rst|txt|adoc)$"
CONFIG_FILE = r"(?i)(\.(ya?ml|toml|json|lock|ini|cfg|conf|env)$)|((^|/)(dockerfile|makefile|\.gitignore|\.npmrc)$)"


def task_intent(title: Column, kind: Column | None = None, paths: Column | None = None, declared: Column | None = None) -> Column:
    """What a task is for: a declared intent, else fix for bugs, else by the title, else by its paths.

    By the title it is the first intent in order whose stem begins a word; by the
    paths test, docs or config if all of them are; feature where nothing tells.
    """
    words = F.transform(F.split(F.lower(F.coalesce(title, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: F.substring(w, 1, 5))

    def hit(stems: tuple[str, ...]) -> Column:
        def one(w: Column) -> Column:
            out = w.startswith(stems[0])
            for s in stems[1:]:
                out = out | w.startswith(s)
            return out

        return F.exists(words, one)

    out = F if declared is None else F.when(declared.isin(*INTENT_ORDER), declared)
    if kind is not None:
        out = out.when(kind == "bug", "fix")
    for intent in INTENT_ORDER:
        out = out.when(hit(INTENT_STEMS[intent]), intent)
    if paths is not None:
        some = F.size(paths) > 0
        out = out.when(some & F.forall(paths, lambda p: p.rlike(TEST_FILE) | p.rlike(TEST_FOLDER)), "test")
        out = out.when(some & F.forall(paths, lambda p: p.rlike(DOC_FILE)), "docs").when(some & F.forall(paths, lambda p: p.rlike(CONFIG_FILE)), "config")
    return out.otherwise("feature")


def task_scope(paths: Column) -> Column:
    """unknown without paths, local for one, module for up to five of one directory, else cross."""
    files = F.array_distinct(F.filter(F.coalesce(paths, F.array().cast("array<string>")), lambda p: F.trim(p) != ""))
    tops = F.array_distinct(F.transform(files, lambda p: F.substring_index(F.regexp_replace(p, r"^\.?/", ""), "/", 1)))
    return F.when(F.size(files) == 0, "unknown").when(F.size(files) == 1, "local").when((F.size(files) <= 5) & (F.size(tops) == 1), "module").otherwise("cross")


def paths_in(text: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PATH_PATTERN), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda p: F.regexp_replace(p, r"^\./", ""))))


def split_identifier(c: Column) -> Column:
    """camelCase, ABCWord, snake_case and paths as words with blanks."""
    c = F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2")
    return F.regexp_replace(F.regexp_replace(c, "([A-Z]+)([A-Z][a-z])", "$1 $2"), r"[_\-./\\]", " ")


def session_key(path: Column) -> Column:
    """The UUID in a transcript's path; empty without one."""
    return F.lower(F.regexp_extract(path, "(?i)([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})", 1))


_HEADER = re.compile(r"^#{1,6}[ \t]+(.+?)[ \t]*$", re.M)
_BULLET = re.compile(r"^[ \t]*(?:[-*+]|\d+[.)])[ \t]+(.+?)[ \t]*$", re.M)


def _short(text: str, most: int = 80) -> str:
    line = " ".join(text.splitlines()[0].split()) if text else ""
    return line if len(line) <= most else line[: most - 1] + "…"


def fragments(body: str) -> list[tuple[str, int, int, str]]:
    """(type, start, end, title) of a document's parts; bullets of known sections are parts of their own."""
    heads = list(_HEADER.finditer(body))
    parts = [(0, heads[0].start() if heads else len(body), None)] + [(h.end(), heads[i + 1].start() if i + 1 < len(heads) else len(body), h.group(1)) for i, h in enumerate(heads)]
    out = []
    for a, b, head in parts:
        text = body[a:b]
        if not text.strip():
            continue
        a += len(text) - len(text.lstrip())
        text = text.strip()
        kind = next((k for p, k in SECTION_WORDS if head is not None and re.search(p, head, re.I)), None)
        bullets = [m for m in _BULLET.finditer(text) if m.group(1).strip()] if kind else []
        if bullets:
            out += [(kind, a + m.start(1), a + m.end(1), _short(m.group(1))) for m in bullets]
        else:
            out.append((kind or "section", a, a + len(text), _short(head if head is not None else text)))
    return out


def fragment_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ord, frag_type, char_start, char_end, title) of every part of every text."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, i, *f) for k, t in zip(batch[key], batch[text], strict=True) if isinstance(t, str) for i, f in enumerate(fragments(t))]
            yield pd.DataFrame(rows, columns=[key, "ord", "frag_type", "char_start", "char_end", "title"])

    return docs.select(key, text).mapInPandas(run, f"`{key}` {kind}, ord int, frag_type string, char_start int, char_end int, title string")


# How many signals of a kind a transcript gives, and the order in which sections get room.
MOST_SIGNALS = {"decision": 40, "open": 20, "file": 30, "tool": 40}
FILL_ORDER = ("DECIDED", "ACTIVE", "OPEN", "NEXT", "FILES")
LABEL_WIDTH = 9


def transcript_signals(turns: DataFrame, key: str, text: str, decided: str, open_: str) -> DataFrame:
    """(key, kind, place, norm): what a transcript tells, at most ``MOST_SIGNALS`` of each kind.

    Lines that state a decision or an open point and tool calls (lines that begin
    with ``$``), once per normalised text, in order; files by how often they are named.
    """
    lines = turns.select(key, F.posexplode(F.split(text, "\n")).alias("at", "line")).where("length(line) >= 8")
    kind = F.when(F.col("line").startswith("$ "), "tool").when(F.col("line").rlike(decided), "decision").when(F.col("line").rlike(open_), "open")
    rows = lines.withColumn("kind", kind).where("kind is not null").withColumn("norm", F.lower(single_blanks(F.col("line"))))
    first = rows.groupBy(key, "kind", "norm").agg(F.min("at").cast("long").alias("at"))
    named = turns.select(key, F.explode(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PATH_PATTERN), F.lit(1))).alias("norm")).withColumn("norm", F.regexp_replace("norm", r"^\./", ""))
    files = named.groupBy(key, F.lit("file").alias("kind"), "norm").agg((-F.count("*")).alias("at"))
    w = Window.partitionBy(key, "kind").orderBy("at", "norm")
    most = F.coalesce(*(F.when(F.col("kind") == k, F.lit(n)) for k, n in MOST_SIGNALS.items()))
    return first.unionByName(files).withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select(key, "kind", "place", "norm")


def active_tasks(nodes: DataFrame, most: int) -> DataFrame:
    """(scope, place, id, line): the first tasks of each scope that are under way, then blocked, then open."""
    rank = F.when(F.col("status") == "in_progress", 0).when(F.col("status") == "blocked", 1).when(F.col("status") == "open", 2)
    rows = nodes.where("kind = 'task'").withColumn("rank", rank).where("rank is not null")
    w = Window.partitionBy("scope").orderBy("rank", "priority", F.desc("updated_at"), "id")
    who = F.when(F.coalesce("assignee", F.lit("")) != "", F.concat(F.lit(" @"), "assignee")).otherwise("")
    state = F.when(F.col("status") != "in_progress", F.concat(F.lit(" ["), "status", F.lit("]"))).otherwise("")
    line = F.concat("id", F.lit(" P"), "priority", F.lit(" "), F.coalesce("title", F.lit("")), who, state)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("scope", "place", "id", line.alias("line"))


def rescue_packets(items: DataFrame, key: str, budget: int) -> DataFrame:
    """(key, section, place, item, kept): which (section, place, item) of each packet fit its budget.

    Sections get room in ``FILL_ORDER``, whatever order they are printed in; an item
    that doesn't fit is left out and smaller ones after it may still fit.  A packet's
    sections are bounded (``MOST_SIGNALS``, tasks, steps), so a group is small.
    """
    kind = items.schema[key].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        left, kept = budget, {}
        rank = group["section"].map({s: i for i, s in enumerate(FILL_ORDER)})
        for i in group.assign(rank=rank).sort_values(["rank", "place"]).index:
            cost = len(group.at[i, "item"]) + LABEL_WIDTH + 1
            kept[i] = cost <= left
            left -= cost if kept[i] else 0
        return group.assign(kept=[kept[i] for i in group.index])

    rows = items.select(key, "section", F.col("place").cast("int").alias("place"), "item")
    return rows.groupBy(key).applyInPandas(run, f"`{key}` {kind}, section string, place int, item string, kept boolean")


def command_parts(line: str) -> list[str]:
    """The commands of a shell line, cut at ; | && || outside quotes."""
    out, part, quote, i = [], "", "", 0
    while i < len(line):
        ch = line[i]
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "'\"":
            quote = ch
        elif ch in ";|&":
            out.append(part)
            part = ""
            while i + 1 < len(line) and line[i + 1] in ";|&":
                i += 1
            i += 1
            continue
        part += ch
        i += 1
    return [p.strip() for p in [*out, part] if p.strip()]


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) between two listings (path, hash): added, removed or changed."""
    both = before.select("path", F.col("hash").alias("h0")).join(after.select("path", F.col("hash").alias("h1")), "path", "full")
    change = F.when(F.col("h0").isNull(), "added").when(F.col("h1").isNull(), "removed").when(F.col("h0") != F.col("h1"), "changed")
    return both.select("path", change.alias("change")).where("change is not null")

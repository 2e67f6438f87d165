"""Field-weighted full-text ranking with a ladder of relaxed matches.

Tokens are made inside the JVM.  One query is scored without postings: a scan
counts each query term per field, statistics are one aggregate row.  Many
queries at once go through :func:`postings`, joined by term.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.numbering import numbered
from graphloom.staging import stage

WEIGHTS = {"title": 10.0, "body": 1.0, "tags": 1.0}
K1, B = 1.2, 0.75
#: The steps of the ladder, strictest first.
STAGES = ("and", "prefix_and", "prefix_relaxed", "prefix_relaxed2", "or", "prefix_or")
TOKEN = r"[\p{L}\p{N}_.-]+"
_QUERY_TOKEN = re.compile(r"[^\W_][\w.-]*|_[\w.-]*")


def accent_pairs() -> tuple[str, str]:
    """Latin letters with marks, and the letters without, as two parallel texts."""
    marked = [chr(c) for c in range(0xC0, 0x250) if unicodedata.decomposition(chr(c)) and not unicodedata.decomposition(chr(c)).startswith("<")]
    plain = [unicodedata.normalize("NFD", c)[0] for c in marked]
    return "".join(marked), "".join(plain)


_MARKED, _PLAIN = accent_pairs()


def folded(c: Column) -> Column:
    """Lower case without accents on Latin letters."""
    return F.lower(F.translate(c, _MARKED, _PLAIN))


def tokens(c: Column) -> Column:
    """Index tokens of a text; null and empty texts have none."""
    return F.regexp_extract_all(F.coalesce(folded(c), F.lit("")), F.lit(f"({TOKEN})"), F.lit(1))


@dataclass(frozen=True)
class Term:
    words: tuple[str, ...]
    prefix: bool = False

    def stem(self) -> Term:
        """Single words of six letters or more lose their end and match as prefixes."""
        word = self.words[0]
        if self.prefix or len(self.words) != 1 or len(word) < 6:
            return self
        return Term((word[: max(5, len(word) - 3)],), True)


def parse(text: str) -> list[Term]:
    """Phrases in quotes, words with a trailing star, and words; in order, once each."""
    plain = "".join(dict(zip(_MARKED, _PLAIN, strict=True)).get(c, c) for c in text).lower()
    out: list[Term] = []
    for phrase, rest in re.findall(r'"([^"]*)"|([^"]+)', plain):
        if phrase:
            words = tuple(_QUERY_TOKEN.findall(phrase))
            if words:
                out.append(Term(words))
            continue
        for m in _QUERY_TOKEN.finditer(rest):
            out.append(Term((m.group(),), rest[m.end() : m.end() + 1] == "*"))
    return list(dict.fromkeys(out))


def is_anchor_token(token: str) -> bool:
    """Whether a query word looks like an identifier, a code or a path."""
    return bool(
        re.search(r"\d", token)
        or re.search(r"[_./-]", token)
        or re.search(r"[a-z][A-Z]", token)
        or (len(token) >= 3 and token == token.upper() and re.search(r"[A-Z]", token))
        or (len(token) >= 12 and re.fullmatch(r"[A-Za-z0-9]+", token))
    )


def anchor_token(c: Column) -> Column:
    """:func:`is_anchor_token` as a column."""
    return c.rlike(r"\d|[_./-]|[a-z][A-Z]") | ((F.length(c) >= 3) & (c == F.upper(c)) & c.rlike("[A-Z]")) | c.rlike("^[A-Za-z0-9]{12,}$")


def count_term(field: Column, term: Term) -> Column:
    """Occurrences of a term in an array of tokens."""
    words = term.words
    if len(words) == 1:
        word = F.lit(words[0])
        return F.size(F.filter(field, (lambda x: x.startswith(word)) if term.prefix else (lambda x: x == word)))
    n = len(words)
    starts = F.sequence(F.lit(1), F.greatest(F.size(field) - n + 1, F.lit(1)))
    return F.size(F.filter(starts, lambda i: F.slice(field, i, n) == F.array(*map(F.lit, words))))


def tokenised(records: DataFrame, fields: tuple[str, ...] = tuple(WEIGHTS)) -> DataFrame:
    """``records`` with an array of tokens ``t_<field>`` per field."""
    return records.withColumns({f"t_{f}": tokens(F.col(f)) for f in fields})


def scores(records: DataFrame, terms: list[Term], weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """(id, score, matched, matched_prefix) of the records that match any term.

    ``records`` has an id and the text fields.  The score is higher for better
    matches; ``matched`` counts the terms found as they are, ``matched_prefix``
    those found as stems.  Texts are cut into tokens once: the counts, a few numbers
    per record, are staged for the statistics, the scores and the ladder.
    """
    rows = tokenised(records, tuple(weights))
    length = sum((F.size(f"t_{f}") for f in weights), F.lit(0))
    columns = {"dl": length.cast("double")}
    for i, term in enumerate(terms):
        columns[f"f{i}"] = sum((F.lit(w) * count_term(F.col(f"t_{f}"), term) for f, w in weights.items()), F.lit(0.0))
        columns[f"p{i}"] = sum((count_term(F.col(f"t_{f}"), term.stem()) for f in weights), F.lit(0))
    counted = stage(rows.select("id", *(c.alias(k) for k, c in columns.items())), "terms")
    stats = counted.agg(
        F.count("*").cast("double").alias("n"), F.avg("dl").alias("avgdl"), *(F.count_if(F.col(f"f{i}") > 0).cast("double").alias(f"n{i}") for i in range(len(terms)))
    )
    joined = counted.join(F.broadcast(stats))

    def part(i: int) -> Column:
        f, n = F.col(f"f{i}"), F.col(f"n{i}")
        idf = F.greatest(F.log((F.col("n") - n + 0.5) / (n + 0.5)), F.lit(1e-6))
        return F.when(f > 0, idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))).otherwise(0.0)

    out = joined.select(
        "id",
        sum((part(i) for i in range(len(terms))), F.lit(0.0)).alias("score"),
        sum((F.when(F.col(f"f{i}") > 0, 1).otherwise(0) for i in range(len(terms))), F.lit(0)).alias("matched"),
        sum((F.when(F.col(f"p{i}") > 0, 1).otherwise(0) for i in range(len(terms))), F.lit(0)).alias("matched_prefix"),
    )
    return out.where((F.col("matched") > 0) | (F.col("matched_prefix") > 0))


def stage_of(terms: int) -> Column:
    """The strictest step of the ladder that a record satisfies, counted from 0."""
    exact, stem = F.col("matched"), F.col("matched_prefix")
    out = F.when(exact == terms, 0).when(stem == terms, 1)
    for drop, step in ((1, 2), (2, 3)):
        if terms - drop >= 2:
            out = out.when(stem >= terms - drop, step)
    return out.when(exact > 0, 4).otherwise(5)


def ranked(scored: DataFrame, terms: int, stages: tuple[str, ...] = ("and",), pool: int = 100) -> DataFrame:
    """(id, score, rank, stage) of the best ``pool`` records of the first step that has hits."""
    allowed = [STAGES.index(s) for s in stages]
    rows = scored.withColumn("stage", stage_of(terms))
    rows = rows.where(F.col("stage") <= max(allowed))
    first = rows.agg(F.min(F.when(F.col("stage") <= allowed[0], allowed[0]).otherwise(F.col("stage"))).alias("first"))
    kept = rows.join(F.broadcast(first)).where(F.col("stage") <= F.col("first")).drop("first")
    top = kept.orderBy(F.desc("score"), "id").limit(pool)
    return top.withColumn("rank", F.rank().over(Window.orderBy(F.desc(F.round("score", 9)))))


def postings(records: DataFrame, fields: tuple[str, ...] = tuple(WEIGHTS)) -> DataFrame:
    """(term, id, field, tf); counts are combined before they move."""
    rows = tokenised(records, fields)
    each = [rows.select("id", F.lit(f).alias("field"), F.explode(f"t_{f}").alias("term")) for f in fields]
    out = each[0]
    for x in each[1:]:
        out = out.unionByName(x)
    return out.groupBy("term", "id", "field").agg(F.count("*").alias("tf"))


#: Records whose postings lie in one row, and postings of such a block from which a term has a table of its records.
BLOCK, DENSE = 1 << 16, 1 << 11


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, bounds) of a list column."""
    return column.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]


def _best_of_block(best: np.ndarray, keep: int, terms: np.ndarray, bounds: np.ndarray, posts: np.ndarray, first: int, size: int = BLOCK, dense: int = DENSE) -> None:
    """Take the records of one block into ``best``, per question the least ``keep`` keys (-count, record).

    A record has to share more terms than the worst one kept, or as many with an
    earlier number; as it can't do so by the commonest terms alone, these are
    looked up for the records that the rarer ones leave.
    """
    term, at = posts >> 16, (posts & 0xFFFF).astype(np.intp)
    start = np.r_[0, np.cumsum(np.bincount(term, minlength=int(terms.max(initial=0)) + 2))]
    low, high = start[terms], start[terms + 1]
    counts = np.zeros(size, np.uint8 if np.diff(bounds).max() < 255 else np.int32)
    tables: dict[int, np.ndarray] = {}
    free = np.iinfo(np.int64).max
    for q in range(len(best)):
        a, b = bounds[q], bounds[q + 1]
        worst = best[q, keep - 1]
        need = 1 if worst == free else -(worst >> 32) + (first > (worst & 0xFFFFFFFF))
        if need > b - a:
            continue
        hot = b
        while b - hot < need - 1 and high[hot - 1] - low[hot - 1] >= dense:
            hot -= 1
        counts[:] = 0
        for x, y in zip(low[a:hot].tolist(), high[a:hot].tolist(), strict=True):
            if x < y:
                counts[at[x:y]] += 1
        some = np.flatnonzero(counts >= need - (b - hot))
        if not len(some):
            continue
        n = counts[some].astype(np.int64)
        for i in range(hot, b):
            t = int(terms[i])
            if t not in tables:
                tables[t] = np.zeros(size, bool)
                tables[t][at[low[i] : high[i]]] = True
            n += tables[t][some]
        fit = n >= need
        keys = np.r_[best[q], (-n[fit] << 32) | (first + some[fit])]
        if len(keys) > 4 * keep:
            keys = np.partition(keys, keep - 1)[:keep]
        best[q] = np.sort(keys)[:keep]


def most_shared(asked: DataFrame, records: DataFrame, key: str, keep: int = 24, block: int = 16_384, size: int = BLOCK, dense: int = DENSE) -> DataFrame:
    """(key, id, n, place): per question the ``keep`` records that share most of its terms, then by id.

    ``asked`` is (key, term); ``records`` is (id, terms), an id once, terms of a
    record distinct.  Terms are numbered from the rarest, records by id.  A task takes
    the questions of a block through the postings of all records, ``size`` records (up to
    ``BLOCK``) at a time, and keeps the best ones: what moves is the postings of asked terms, not
    the meetings of questions with records.
    """
    spark = asked.sparkSession
    asked = stage(asked.distinct(), "asked")
    records = stage(records.withColumn("m", F.monotonically_increasing_id()), "records")  # written, so that a record keeps its m
    placed = numbered(records.select("id", "m"), "id", name="r")
    post = records.select("m", F.explode("terms").alias("term"))
    used = post.groupBy("term").agg(F.count("*").alias("df")).join(asked.select("term").distinct(), "term")
    known = numbered(used, "df", "term", name="k").select("term", "k")
    r = F.col("r") - 1
    packed = post.join(known, "term").select("m", "k").join(placed.select("m", "r"), "m").groupBy(F.floor(r / size).alias("block"))
    blocks = stage(packed.agg(F.sort_array(F.collect_list(F.shiftleft("k", 16) + F.pmod(r, F.lit(size)))).alias("posts")), "postings")
    questions = stage(numbered(asked.join(known, "term").groupBy(key).agg(F.sort_array(F.collect_list("k")).alias("ks")), "ks", name="q"), "questions")
    n = questions.count()
    block = max(1, min(block, -(-n // (2 * spark.sparkContext.defaultParallelism))))
    parts = questions.groupBy(F.floor((F.col("q") - 1) / block).alias("part")).agg(F.collect_list("q").alias("qs"), F.collect_list("ks").alias("terms"))
    both = blocks.coalesce(1).crossJoin(parts.repartitionByRange(max(1, -(-n // block)), "part").hint("shuffle_replicate_nl"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for b in batches:
            for i in range(len(b)):
                row = b.slice(i, 1)
                part = row["part"][0].as_py()
                if part not in held:
                    terms, bounds = _lists(row["terms"].flatten())
                    held[part] = (_lists(row["qs"])[0], terms, bounds, np.full((len(bounds) - 1, keep), np.iinfo(np.int64).max))
                _, terms, bounds, best = held[part]
                _best_of_block(best, keep, terms, bounds, _lists(row["posts"])[0], row["block"][0].as_py() * size, size, dense)
        for qs, _, _, best in held.values():
            at, slot = np.nonzero(best != np.iinfo(np.int64).max)
            found = best[at, slot]
            yield pa.RecordBatch.from_arrays([pa.array(qs[at]), pa.array(found & 0xFFFFFFFF), pa.array(-(found >> 32))], ["q", "r", "n"])

    hits = both.mapInArrow(run, "q long, r long, n long")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("n"), "r"))
    kept = hits.withColumn("place", place).where(F.col("place") <= keep)
    return kept.join(placed.select((F.col("r") - 1).alias("r"), "id"), "r").join(questions.select("q", key), "q").select(key, "id", "n", "place")


def spread(scored: DataFrame, least: int = 3) -> DataFrame:
    """One row: hits, and how far the best score stands above the median; null for few hits."""
    order = F.sort_array(F.collect_list("score"), asc=False)
    row = scored.agg(F.count("*").alias("hits"), order.alias("s"))
    top, middle = F.element_at("s", 1), F.element_at("s", (F.floor(F.col("hits") / 2) + 1).cast("int"))
    value = F.when(F.col("hits") < least, F.lit(None)).when(top > 0, (top - middle) / top).otherwise(0.0)
    return row.select("hits", value.alias("spread"))


def trigger(hits: int, spread_value: float | None, text: str, fallback: bool = False, least: int = 5, least_spread: float = 0.15, short: int = 2) -> list[str]:
    """Why the vector search should run too, if it should."""
    words = re.findall(r"[^\W_][\w.-]*|_[\w.-]*", text)
    anchors = sum(map(is_anchor_token, words))
    reasons = []
    if hits < least and not (anchors and hits):
        reasons.append("few_results")
    if spread_value is not None and spread_value < least_spread:
        reasons.append("low_bm25_spread")
    if len(words) <= short and not anchors:
        reasons.append("short_query_no_anchor")
    if fallback:
        reasons.append("lexical_fallback")
    return reasons

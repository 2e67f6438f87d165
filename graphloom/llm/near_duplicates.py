"""Near-duplicate records by generalised pigeonhole over sketch codes.

Texts are normalised and sketched: each coordinate of the code holds sixteen bits
of one minimum over the hashes of the text's five-character pieces, which is
equal in two texts with the probability of their similarity.

1. Grouping.  The bits of a coordinate come from one minimum and so stay
   together; coordinates are grouped by the association of their bits, measured
   over all texts, ``width`` to a partition.
2. Allocation.  With threshold t a partition is hit by two texts that differ in at
   most t of its coordinates; -1 leaves it out.  A threshold adds to the chance
   that two similar texts meet and costs candidates, whose number is estimated
   from counts of fixed size over all texts.  A dynamic program picks for each
   partition the threshold so that the chance to miss a pair stays below ``miss``
   at the least estimated cost.
3. Probing.  A text has a key for each way to leave out as many coordinates of a
   partition as its threshold allows; texts that share a key meet.  Keys of cells
   that hold very many texts are extended by further coordinates, two at a time
   in sixteen ways.  A meeting counts only if the codes are near enough.
4. Verifying.  Candidates are compared by their exact three-character pieces.

Copies are collapsed before and put back after, so that a group of equal texts
is one record to steps 1 to 4.

Recall: a pair of five-character similarity 0.6 is missed with a chance of at most
``miss`` (0.005), of 0.7 with 0.0001; the limit on codes adds 0.0001 at 0.6.  Pairs of
three-character similarity 0.76 were seen from 0.61 on; README has measured
figures for each width.  There is no cap on buckets, candidates or partners.
Texts are taken as equal if 64-bit hashes of their normalised forms are.

Defined results: records with null text are left out; a text with nothing but
blanks and end marks has no pieces and no partner but is a copy of the like in
groups; a text of fewer than five characters is one piece; repeated rows of a
key count once, by the greatest clock; other columns are ignored; empty tables
give no rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.components import connected_components
from graphloom.staging import release, spread, stage

#: Characters of a piece for sketches; pieces for the exact comparison have three.
PIECE = 5
#: Coordinates of which a candidate row keeps three bits, 21 to a long.
CODED = 63
#: Counters of an estimate: cells, and two signs in each.
_BINS = 1 << 13
#: A cell of a key counts as hot beyond so many texts and so many times the mean.
_HOT, _TIMES = 2000, 8
#: Ways in which the keys of hot cells are extended, by two coordinates each.
_WAYS = 16
#: Up to so many needed keys are broadcast to pick their texts.
_FEW_KEYS = 200_000

_BLANK = "[\t-\r \xa0  -     　﻿]"
_BLANKS = re.compile(_BLANK + "+")
_END = re.compile(r"[ .,;:!?…]+$")


def normalised(text: str) -> str:
    """The form in which texts are compared, with one blank before and after."""
    t = _BLANKS.sub(" ", unicodedata.normalize("NFKC", text)).strip(" ")
    return f" {_END.sub('', t).lower()} "


def text_pieces(text: str) -> np.ndarray:
    """The three-character pieces of a normalised text, each as one number of 63 bits, ascending."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return np.unique(points[:-2] << np.uint64(42) | points[1:-1] << np.uint64(21) | points[2:])


def shared(x: np.ndarray, y: np.ndarray, least: float = 0.0) -> float:
    """What both have of what either has; 0 if their sizes alone keep it under ``least``."""
    small, large = sorted((len(x), len(y)))
    if not small or small < least * large:
        return 0.0
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (small + large - both)


def similarity(a: str, b: str) -> float:
    """Shared among all three-character pieces of two normalised texts."""
    return shared(text_pieces(a), text_pieces(b))


def _rid(text: str) -> int:
    """The 64-bit hash of a normalised text, as a signed number."""
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


class Sketcher:
    """Codes of lists of normalised texts."""

    def __init__(self, coordinates: int, seed: int = 11) -> None:
        r = np.random.default_rng(seed)
        self.a = r.integers(1, 2**32, coordinates, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
        self.b = r.integers(0, 2**32, coordinates, dtype=np.uint64).astype(np.uint32)
        self.power = _mix(np.arange(1, PIECE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

    def minima(self, texts: list[str]) -> np.ndarray:
        """(text, coordinate) minima; texts are at least one character long."""
        texts = [t if len(t) >= PIECE else t.ljust(PIECE) for t in texts]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        ends = np.cumsum(sizes)
        h = np.zeros(len(points) - PIECE + 1, np.uint64)
        for k in range(PIECE):
            h += points[k : len(points) - PIECE + 1 + k] * self.power[k]
        h = (_mix(h) >> np.uint64(16)).astype(np.uint32)
        inside = np.ones(len(points), bool)
        for k in range(1, PIECE):
            inside[ends - k] = False
        h = h[inside[: len(h)]]
        starts = np.r_[0, np.cumsum(sizes - PIECE + 1)[:-1]]
        out = np.empty((len(texts), len(self.a)), np.uint32)
        for j in range(len(self.a)):
            out[:, j] = np.minimum.reduceat(h * self.a[j] + self.b[j], starts)
        return out

    def codes(self, texts: list[str]) -> np.ndarray:
        """(text, coordinate) codes of 16 bits."""
        return ((self.minima(texts) * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


def meeting_chance(width: int, threshold: int, similar: float) -> float:
    """Chance that at most ``threshold`` of ``width`` coordinates differ."""
    return sum(math.comb(width, j) * similar ** (width - j) * (1 - similar) ** j for j in range(threshold + 1))


def allocate(costs: np.ndarray, gains: np.ndarray, need: float, steps: int = 1000) -> np.ndarray:
    """The threshold of each partition, from -1, so that gains add up to ``need`` at the least cost.

    ``costs`` is (partition, threshold), ``gains`` by threshold, both from 0 on;
    a threshold of -1 costs and gives nothing.  ``best[k]`` is the least cost of k of
    ``steps`` parts of the need with the partitions so far; gains are rounded down.
    """
    parts = np.minimum(np.floor(gains / need * steps).astype(int), steps)
    best, trail = np.full(steps + 1, np.inf), []
    best[0] = 0
    for row in costs:
        now, came, pick = best.copy(), np.arange(steps + 1), np.full(steps + 1, -1)
        for k in np.flatnonzero(np.isfinite(best)):
            for t, part in enumerate(parts):
                to = min(k + part, steps)
                if best[k] + row[t] < now[to]:
                    now[to], came[to], pick[to] = best[k] + row[t], k, t
        trail.append((came, pick))
        best = now
    if not np.isfinite(best[steps]):
        raise ValueError("the partitions can't give the recall asked for")
    out, at = np.full(len(costs), -1), steps
    for i in range(len(costs) - 1, -1, -1):
        came, pick = trail[i]
        out[i], at = pick[at], came[at]
    return out


def grouped(association: np.ndarray, width: int) -> np.ndarray:
    """(partition, width) coordinates: each partition begins with the one of most association and takes its nearest."""
    a = association.copy()
    np.fill_diagonal(a, 0)
    left, out = list(range(len(a))), []
    while left:
        first = left[int(np.argmax(a[np.ix_(left, left)].sum(1)))]
        mine = [first]
        left.remove(first)
        while len(mine) < width:
            near = left[int(np.argmax(a[np.ix_(left, mine)].sum(1)))]
            mine.append(near)
            left.remove(near)
        out.append(sorted(mine))
    return np.array(out)


@dataclass(frozen=True)
class Layout:
    """How many coordinates a partition has, how many partitions there are, and the greatest threshold."""

    width: int
    partitions: int
    greatest: int = 1

    @classmethod
    def for_records(cls, records: int) -> Layout:
        """Keys of three, four or five coordinates, so that chance meetings don't grow with the square."""
        return cls(4, 18) if records <= 1_000_000 else cls(5, 26) if records <= 100_000_000 else cls(6, 36)

    @property
    def coordinates(self) -> int:
        return max(CODED, self.width * self.partitions)

    def ways(self, threshold: int) -> list[tuple[int, ...]]:
        """The coordinates of a partition that keys of a threshold keep."""
        return list(combinations(range(self.width), self.width - threshold))


@dataclass(frozen=True)
class Plan:
    """The partitions' coordinates and thresholds, the estimated candidates, and (key set, bin) marks of hot cells."""

    layout: Layout
    groups: np.ndarray
    thresholds: np.ndarray
    estimated: np.ndarray
    hot: np.ndarray

    def key_sets(self) -> list[tuple[int, int, tuple[int, ...]]]:
        """(number, partition, coordinates) of the keys that are probed."""
        return [(n, i, c) for n, i, t, c in _all_key_sets(self.layout, self.groups) if t == self.thresholds[i]]


def _all_key_sets(layout: Layout, groups: np.ndarray) -> list[tuple[int, int, int, tuple[int, ...]]]:
    """(number, partition, threshold, coordinates) of all keys that thresholds may need."""
    sets = [(i, t, tuple(int(x) for x in group[list(way)])) for i, group in enumerate(groups) for t in range(layout.greatest + 1) for way in layout.ways(t)]
    return [(n, *x) for n, x in enumerate(sets)]


def _keys(codes: np.ndarray, number: int, coordinates: tuple[int, ...]) -> np.ndarray:
    h = np.full(len(codes), number + 1, np.uint64)
    for c in coordinates:
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + codes[:, c].astype(np.uint64) + np.uint64(1))
    return h


def _matrix(column: pa.Array, coordinates: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, coordinates)


def node_records(nodes: DataFrame) -> DataFrame:
    """(key, text, hlc, site_id) of the node rows with a body."""
    text = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), "body")
    return nodes.where("body is not null and id is not null").select(
        F.col("id").alias("key"), text.alias("text"), F.coalesce("hlc", F.lit(0)).alias("hlc"), F.coalesce("site_id", F.lit("")).alias("site_id")
    )


def pair_records(pairs: DataFrame) -> DataFrame:
    """(key, text, hlc, site_id) of the incoming texts; those that only name a node are left out."""
    names_node = F.col("new").rlike(r"^\s*\{") & F.get_json_object("new", "$.node").isNotNull()
    texts = pairs.where(F.col("new").isNotNull() & F.col("pair_id").isNotNull() & ~names_node)
    return texts.select(F.concat(F.lit("pair:"), F.col("pair_id").cast("string")).alias("key"), F.col("new").alias("text"), F.lit(0).cast("long").alias("hlc"), F.lit("").alias("site_id"))


def sketches(records: DataFrame, coordinates: int) -> DataFrame:
    """key, hlc, site_id, rid (hash of the normalised text), code and whether the text is empty, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(coordinates)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [normalised(t) for t in part.column(3).to_pylist()]
                rid = np.array([_rid(t) for t in texts], np.int64)
                codes = sketcher.codes(texts)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.array(rid), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([len(t) < 3 for t in texts])], ["key", "hlc", "site_id", "rid", "code", "empty"]
                )

    return spread(records.select("key", "hlc", "site_id", "text")).mapInArrow(run, "key string, hlc long, site_id string, rid long, code binary, empty boolean")


def _summed(rows: DataFrame, size: int, count) -> np.ndarray:
    """The sum over all batches of ``count(batch)``, an array of a fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                sums += count(batch)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["cell", "n"])

    total = np.zeros(size)
    found = rows.mapInArrow(run, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    total[found["cell"].to_numpy()] = found["n"].to_numpy()
    return total


def association(single: DataFrame, coordinates: int, bits: int = 2) -> np.ndarray:
    """(coordinate, coordinate) mean squared correlation of their lowest bits, over all texts."""
    wide = coordinates * bits

    def count(batch: pa.RecordBatch) -> np.ndarray:
        codes = _matrix(batch.column(0), coordinates)
        x = np.concatenate([np.where(codes >> np.uint16(k) & np.uint16(1), 1, -1).astype(np.float32) for k in range(bits)], 1)
        return np.r_[(x.T @ x).ravel(), x.sum(0), len(x)].astype(np.float64)

    total = _summed(single.select("code"), wide * wide + wide + 1, count)
    n, mean = max(total[-1], 1.0), total[wide * wide : -1] / max(total[-1], 1.0)
    cov = total[: wide * wide].reshape(wide, wide) / n - np.outer(mean, mean)
    spread_ = np.sqrt(np.maximum(np.diag(cov), 1e-9))
    r2 = (cov / np.outer(spread_, spread_)) ** 2
    return r2.reshape(bits, coordinates, bits, coordinates).sum((0, 2)) / bits


def make_plan(single: DataFrame, layout: Layout, similar: float = 0.6, miss: float = 0.005, row_cost: float = 2.0) -> Plan:
    """Groups and thresholds for the texts of ``single`` (rid, code); a key of a text costs as much as ``row_cost`` candidates."""
    n_coordinates = layout.coordinates
    groups = grouped(association(single, n_coordinates)[: layout.width * layout.partitions, : layout.width * layout.partitions], layout.width)
    sets = _all_key_sets(layout, groups)

    def count(batch: pa.RecordBatch) -> np.ndarray:
        codes = _matrix(batch.column(0), n_coordinates)
        return np.concatenate([np.bincount((_keys(codes, n, c) >> np.uint64(64 - 13)).astype(np.int64), minlength=_BINS) for n, _, _, c in sets]).astype(np.float64)

    bins = _summed(single.select("code"), len(sets) * _BINS, count).reshape(len(sets), _BINS)
    texts = bins[0].sum()
    # the sum of squares of signed cells estimates that of the buckets' sizes
    squares = ((bins[:, 0::2] - bins[:, 1::2]) ** 2).sum(1)
    pairs = np.maximum(squares - texts, 0) / 2
    costs = np.zeros((layout.partitions, layout.greatest + 1))
    for n, i, t, _ in sets:
        costs[i, t] += pairs[n] + row_cost * texts
    gains = np.array([-np.log1p(-meeting_chance(layout.width, t, similar)) for t in range(layout.greatest + 1)])
    thresholds = allocate(costs, gains, -np.log(miss))
    return Plan(layout, groups, thresholds, costs - row_cost * texts * np.array([len(layout.ways(t)) for t in range(layout.greatest + 1)]), bins > max(_HOT, _TIMES * texts / _BINS))


def probes(single: DataFrame, plan: Plan) -> DataFrame:
    """(bucket, rid, c0, c1, c2): a row per text and key."""
    shared_plan = single.sparkSession.sparkContext.broadcast(plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared_plan.value
        sets, wide = p.key_sets(), p.layout.coordinates
        order = np.random.default_rng(5).permutation(wide)
        for batch in (whole.slice(at, 2000) for whole in batches for at in range(0, whole.num_rows, 2000)):
            rid, codes = batch.column(0).to_numpy(), _matrix(batch.column(1), wide)
            bits = (codes[:, :CODED] & np.uint16(7)).astype(np.uint64).reshape(len(codes), 3, CODED // 3)
            words = (bits << (np.arange(CODED // 3, dtype=np.uint64) * np.uint64(3))).sum(2, dtype=np.uint64).view(np.int64)
            rows, keys = [], []
            for n, _, coordinates in sets:
                key = _keys(codes, n, coordinates)
                hot = p.hot[n][(key >> np.uint64(64 - 13)).astype(np.int64)]
                calm = np.flatnonzero(~hot)
                rows.append(calm)
                keys.append(key[calm])
                if len(busy := np.flatnonzero(hot)):
                    other = [c for c in order if c not in coordinates]
                    for way in range(_WAYS):
                        pair = (other[2 * way % len(other)], other[(2 * way + 1) % len(other)])
                        more = _keys(codes[busy], way, pair)
                        rows.append(busy)
                        keys.append(_mix(key[busy] * np.uint64(0x9E3779B97F4A7C15) + more))
            at, flat = np.concatenate(rows), np.concatenate(keys).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(rid[at]), *(pa.array(words[at, k]) for k in range(3))], ["bucket", "rid", "c0", "c1", "c2"])

    return single.select("rid", "code").mapInArrow(run, "bucket long, rid long, c0 long, c1 long, c2 long")


def _coordinates_apart(a: str, b: str) -> Column:
    """Of the coded coordinates those whose three bits differ."""
    out = None
    for k in range(3):
        x = F.col(f"{a}.c{k}").bitwiseXOR(F.col(f"{b}.c{k}"))
        folded = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2))
        n = F.bit_count(folded.bitwiseAND(F.lit(0x1249249249249249)))
        out = n if out is None else out + n
    return out


def _levelled(rows: DataFrame) -> DataFrame:
    """(rid, text) with normalised texts, each read once before it meets its candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [normalised(t) for t in batch.column(1).to_pylist()]
            same = [rid == _rid(t) for rid, t in zip(batch.column(0).to_pylist(), texts, strict=True)]  # not so where a key has two texts at one clock
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["rid", "text"]).filter(pa.array(same, pa.bool_()))

    return rows.select("rid", "text").mapInArrow(run, "rid long, text string")


def _slices(batch: pa.RecordBatch, columns: tuple[int, ...], most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have about ``most`` bytes together, at least a row each."""
    size = sum(pc.binary_length(batch.column(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
    part = (np.cumsum(size) - size) // most
    cuts = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(part)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def _verified(candidates: DataFrame, records: DataFrame, keyed: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of the candidate texts that are similar enough."""
    ends = candidates.select(F.explode(F.array("a", "b")).alias("rid")).distinct()
    needed = stage(ends.join(keyed.groupBy("rid").agg(F.min(F.struct("key", "hlc", "site_id")).alias("k")), "rid").select("rid", "k.*"), "needed")
    few = needed.limit(_FEW_KEYS + 1).count() <= _FEW_KEYS
    on = ["key", "hlc", "site_id"]
    texts = _levelled(records.join(F.broadcast(needed) if few else needed, on)).groupBy("rid").agg(F.max("text").alias("text"))
    both = candidates.join(texts.select(F.col("rid").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("rid").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _slices(whole, (2, 3))):
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            by_id = dict(zip(a, batch.column(2).to_pylist(), strict=True)) | dict(zip(b, batch.column(3).to_pylist(), strict=True))
            found = {k: text_pieces(t) for k, t in by_id.items()}
            near = np.array([shared(found[x], found[y], threshold) for x, y in zip(a, b, strict=True)], np.float64)
            keep = pa.array(near >= threshold) if len(near) else pa.array([], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near)], ["a", "b", "similarity"]).filter(keep)

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, similarity double")


def similar_texts(records: DataFrame, threshold: float = 0.7, layout: Layout | None = None, code_limit: int = 36) -> tuple[DataFrame, DataFrame]:
    """(a, b, similarity) of different texts, a < b, and (key, rid, empty) of every key.

    Codes of a candidate may differ in ``code_limit`` of their coordinates.
    """
    records = records.select("key", "text", "hlc", "site_id")
    layout = layout or Layout.for_records(records.count())
    rows = stage(sketches(records, layout.coordinates), "sketches")
    keyed = rows.groupBy("key").agg(F.max_by(F.struct("rid", "empty"), F.struct("hlc", "site_id", "rid")).alias("r")).select("key", "r.rid", "r.empty")
    keyed = stage(keyed, "keys")
    single = stage(rows.where("not empty").groupBy("rid").agg(F.first("code").alias("code")), "codes")
    met = probes(single, make_plan(single, layout))
    hits = (
        met.alias("x")
        .join(met.alias("y"), "bucket")
        .where((F.col("x.rid") < F.col("y.rid")) & (_coordinates_apart("x", "y") <= code_limit))
        .select(F.col("x.rid").alias("a"), F.col("y.rid").alias("b"))
        .distinct()
    )
    candidates = stage(hits, "candidates")
    release(single)
    return _verified(candidates, records, rows.select("key", "hlc", "site_id", "rid"), threshold), keyed


def similar_pairs(records: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(key_a, key_b) of all records that share most of their text, key_a the smaller."""
    texts, keyed = similar_texts(records, threshold)
    members = keyed.where("not empty").select("key", "rid")
    left, right = (members.select(F.col("key").alias(f"k{s}"), F.col("rid").alias(s)) for s in "ab")
    near = texts.select("a", "b").join(left, "a").join(right, "b").select(F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b"))
    copies = left.withColumnRenamed("a", "rid").join(right.withColumnRenamed("b", "rid"), "rid").where("ka < kb").select(F.col("ka").alias("key_a"), F.col("kb").alias("key_b"))
    return near.unionByName(copies)


def similar_groups(records: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(key, group_key, copies, links): the group of every record, its copies, and its text's links."""
    texts, keyed = similar_texts(records, threshold)
    links = stage(texts.select("a", "b"), "links")
    comp = connected_components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("rid")).groupBy("rid").agg(F.count("*").alias("links"))
    counts = keyed.groupBy("rid").agg(F.count("*").alias("copies"), F.min("key").alias("first"))
    placed = counts.join(comp.withColumnRenamed("id", "rid"), "rid", "left").join(degree, "rid", "left").withColumn("comp", F.coalesce("comp", "rid"))
    named = placed.join(placed.groupBy("comp").agg(F.min("first").alias("group_key")), "comp")
    return keyed.join(named.select("rid", "group_key", "copies", "links"), "rid").select("key", "group_key", "copies", F.coalesce("links", F.lit(0)).alias("links"))

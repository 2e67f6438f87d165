"""Queries of retrieval: full text, vectors, fusion, expansion and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.constants import NOW_MS
from graphloom.operators import caching, fusion, lexical, vectors
from graphloom.operators import visibility as vis
from graphloom.operators.current import current_edges, current_nodes
from graphloom.plans import sqltext as q
from graphloom.plans.registry import Query
from graphloom.sources.tables import table
from graphloom.staging import stage

TEXT = "drift digest packer"
LONG = "reconcile drifting snapshots packers"
VIEWER = vis.Viewer("u-007", "team-harbor", "agent-19")
_S = fusion.Settings()


def corpus(s: SparkSession, d: str) -> DataFrame:
    """Newest live records with their text fields; hidden and pending ones and old versions left out."""
    n = current_nodes(table(s, d, "nodes"), "title", "body", "attrs", "status", "head_id", "scope", "kind", "layer", "priority", "updated_at", "acl", "owner_id", "team_id", "agent_id")
    n = n.where(vis.history(False) & vis.live_status() & vis.not_pending())
    return n.withColumn("tags", F.array_join(F.from_json(F.get_json_object("attrs", "$.tags"), "array<string>"), " "))


def _scored(s: SparkSession, d: str, text: str = TEXT) -> tuple[DataFrame, list[lexical.Term]]:
    terms = lexical.parse(text)
    return lexical.scores(corpus(s, d).select("id", "title", "body", "tags"), terms), terms


def _pool(s: SparkSession, d: str, text: str = TEXT, stages: tuple[str, ...] = ("or",)) -> DataFrame:
    scored, terms = _scored(s, d, text)
    return lexical.ranked(scored, len(terms), stages)


_MARKED, _PLAIN = lexical.accent_pairs()
_CORPUS = f"c AS (SELECT *, CASE WHEN json_type(attrs, '$.tags') = 'ARRAY' THEN array_to_string(CAST(json_extract(attrs, '$.tags') AS VARCHAR[]), ' ') END AS tags FROM n WHERE head_id IS NULL AND status NOT IN {q.HIDDEN} AND {q.attr('state')} IS DISTINCT FROM 'pending_review')"


def _tok(field: str) -> str:
    return f"regexp_extract_all(lower(translate(coalesce({field}, ''), '{_MARKED}', '{_PLAIN}')), '{lexical.TOKEN}')"


def _bm25(text: str = TEXT, extra: str = "true") -> tuple[str, ...]:
    """CTEs tok, cnt, st and sc: token lists, term counts, statistics and scores."""
    terms = lexical.parse(text)

    def has(t: lexical.Term, x: str) -> str:
        w = t.words[0]
        return f"starts_with({x}, '{w}')" if t.prefix else f"{x} = '{w}'"

    def count(t: lexical.Term, f: str) -> str:
        return f"len(list_filter(t_{f}, lambda x: {has(t, 'x')}))"

    f = ", ".join(f"{' + '.join(f'{w}::DOUBLE * {count(t, k)}' for k, w in lexical.WEIGHTS.items())} AS f{i}" for i, t in enumerate(terms))
    p = ", ".join(f"{' + '.join(count(t.stem(), k) for k in lexical.WEIGHTS)} AS p{i}" for i, t in enumerate(terms))
    stats = ", ".join(f"count(*) FILTER (f{i} > 0)::DOUBLE AS n{i}" for i in range(len(terms)))
    parts = " + ".join(
        f"CASE WHEN f{i} > 0 THEN greatest(ln((nn - n{i} + 0.5) / (n{i} + 0.5)), 1e-6) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / avgdl)) ELSE 0 END" for i in range(len(terms))
    )
    hit = " + ".join(f"CAST(f{i} > 0 AS INT)" for i in range(len(terms)))
    stem = " + ".join(f"CAST(p{i} > 0 AS INT)" for i in range(len(terms)))
    return (
        f"tok AS (SELECT id, {', '.join(f'{_tok(k)} AS t_{k}' for k in lexical.WEIGHTS)} FROM c WHERE {extra})",
        f"cnt AS (SELECT id, ({' + '.join(f'len(t_{k})' for k in lexical.WEIGHTS)})::DOUBLE AS dl, {f}, {p} FROM tok)",
        f"st AS (SELECT count(*)::DOUBLE AS nn, avg(dl) AS avgdl, {stats} FROM cnt)",
        f"sc AS (SELECT * FROM (SELECT id, {parts} AS score, {hit} AS matched, {stem} AS matched_prefix FROM cnt, st) WHERE matched > 0 OR matched_prefix > 0)",
    )


_BASE = (q.N, _CORPUS, *_bm25())
_POOL = "pool AS (SELECT *, rank() OVER (ORDER BY round(score, 9) DESC) AS rank FROM (SELECT id, score FROM sc WHERE matched > 0 ORDER BY score DESC, id LIMIT 100))"


def _stage_sql(terms: int) -> str:
    return f"CASE WHEN matched = {terms} THEN 0 WHEN matched_prefix = {terms} THEN 1 WHEN {terms - 1} >= 2 AND matched_prefix >= {terms - 1} THEN 2 WHEN {terms - 2} >= 2 AND matched_prefix >= {terms - 2} THEN 3 WHEN matched > 0 THEN 4 ELSE 5 END"


# ---- vectors ----

QUERY_STEP = 50


def _vectors(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = table(s, d, "embeddings")
    return v, v.where(F.col("vec_id") % QUERY_STEP == 0)


def _placed(v: DataFrame) -> DataFrame:
    return v.withColumns({"scope": F.concat(F.lit("s"), F.col("vec_id") % 5), "layer": (F.col("vec_id") % 4).cast("int")})


def _neighbours(s: SparkSession, d: str, k: int = 20) -> DataFrame:
    rows, asked = _vectors(s, d)
    return vectors.nearest(rows, asked, k=k)


_Q8 = "q8 AS (SELECT vec_id, label, embedding, list_transform(embedding, lambda x: greatest(-127, least(127, floor(x::DOUBLE / m * 127 + 0.5)))::INT) AS v FROM (SELECT *, list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) AS m FROM embeddings))"
_DOT = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"


def _knn_sql(k: int) -> str:
    return f"""nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, id) AS place FROM (
      SELECT a.vec_id AS query, b.vec_id AS id, 1 - {_DOT.format(a='a.v', b='b.v')} / sqrt({_DOT.format(a='a.v', b='a.v')} * {_DOT.format(a='b.v', b='b.v')}) AS distance
      FROM q8 a, q8 b WHERE a.vec_id % {QUERY_STEP} = 0)) WHERE place <= {k})"""


_RERANK = f"""rr AS (SELECT query, nn.id, 1 - {_DOT.format(a='a.embedding', b='b.embedding')} / sqrt({_DOT.format(a='a.embedding', b='a.embedding')} * {_DOT.format(a='b.embedding', b='b.embedding')}) AS distance
  FROM nn JOIN embeddings a ON a.vec_id = query JOIN embeddings b ON b.vec_id = nn.id)"""

# ---- hybrid: a record's vector is the one its id hashes to; the query's is vector 0 ----


def _vector_ranks(s: SparkSession, d: str, c: DataFrame) -> DataFrame:
    v = table(s, d, "embeddings")
    n = v.count()
    found = vectors.reranked(vectors.nearest(v, v.where("vec_id = 0"), k=200), v)
    slot = c.select("id", (F.conv(F.substring(F.md5("id"), 1, 8), 16, 10).cast("long") % n).alias("vec_id"))
    near = slot.join(F.broadcast(found.select(F.col("id").alias("vec_id"), "distance")), "vec_id")
    top = near.orderBy("distance", "id").limit(200)
    from pyspark.sql import Window

    return top.withColumn("vec_rank", F.row_number().over(Window.orderBy("distance", "id"))).select("id", "vec_rank")


def _fused(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The corpus, the fused list with scores, and the lexical pool."""
    c = stage(corpus(s, d).select("id", "title", "body", "tags", "priority", "updated_at", "layer"), "corpus")
    terms = lexical.parse(TEXT)
    pool = stage(lexical.ranked(lexical.scores(c.select("id", "title", "body", "tags"), terms), len(terms), ("or",)).select("id", "rank"), "pool")
    both = pool.join(_vector_ranks(s, d, c), "id", "full")
    rows = both.join(c.select("id", "priority", "updated_at", "layer"), "id")
    fused = rows.withColumn("rrf", fusion.rrf(F.col("rank"), F.col("vec_rank"), _S)).withColumn("score", F.col("rrf") * fusion.boost(NOW_MS, _S))
    return c, stage(fused.select("id", "rank", "vec_rank", "rrf", "score"), "fused"), pool


_VEC = (
    _Q8,
    f"nv AS (SELECT b.vec_id, 1 - {_DOT.format(a='a.v', b='b.v')} / sqrt({_DOT.format(a='a.v', b='a.v')} * {_DOT.format(a='b.v', b='b.v')}) AS d8, 1 - {_DOT.format(a='a.embedding', b='b.embedding')} / sqrt({_DOT.format(a='a.embedding', b='a.embedding')} * {_DOT.format(a='b.embedding', b='b.embedding')}) AS distance FROM q8 a, q8 b WHERE a.vec_id = 0 ORDER BY d8, b.vec_id LIMIT 200)",
    "vr AS (SELECT id, row_number() OVER (ORDER BY distance, id) AS vec_rank FROM (SELECT c.id, nv.distance FROM c JOIN nv ON nv.vec_id = ('0x' || substr(md5(c.id), 1, 8))::BIGINT % (SELECT count(*) FROM embeddings) ORDER BY nv.distance, c.id LIMIT 200))",
    f"""fu AS (SELECT id, rank, vec_rank, rrf, rrf * (CASE priority WHEN 0 THEN 1.3::DOUBLE WHEN 1 THEN 1.15::DOUBLE WHEN 3 THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END)
      * (1 + 0.25::DOUBLE * exp(-greatest(0, floor(({NOW_MS} - updated_at) / 86400000)) / 90.0::DOUBLE)) AS score
      FROM (SELECT id, rank, vec_rank, 1.0::DOUBLE / (60 + coalesce(rank, 1000)) + 1.0::DOUBLE / (60 + coalesce(vec_rank, 1000)) AS rrf FROM pool FULL JOIN vr USING (id)) JOIN c USING (id))""",
)


def _hop_sql(name: str, seeds: str, known: str) -> str:
    return f"""{name} AS (SELECT id, via, type, weight, via_rank FROM (
      SELECT *, row_number() OVER (PARTITION BY id ORDER BY via_rank, weight DESC, via, type) rn FROM (
        SELECT s.id AS via, e.dst AS id, e.type, e.weight, s.rank AS via_rank FROM e JOIN {seeds} s ON s.id = e.src WHERE e.weight >= 0.3
        UNION ALL SELECT s.id, e.src, e.type, e.weight, s.rank FROM e JOIN {seeds} s ON s.id = e.dst WHERE e.weight >= 0.3)
      WHERE id NOT IN (SELECT id FROM {known})) WHERE rn = 1 ORDER BY via_rank, weight DESC, id LIMIT 64)"""


_HOPS = (
    "seeds AS (SELECT id, rank FROM pool WHERE rank <= 15)",
    _hop_sql("h1", "seeds", "pool"),
    "s2 AS (SELECT id, row_number() OVER (ORDER BY via_rank, weight DESC, id) AS rank FROM h1 ORDER BY rank LIMIT 12)",
    "k2 AS (SELECT id FROM pool UNION ALL SELECT id FROM h1)",
    _hop_sql("h2", "s2", "k2"),
)


def _hops(s: SparkSession, d: str, pool: DataFrame) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql import Window

    e = current_edges(table(s, d, "edges"), "weight")
    h1 = stage(fusion.hop(pool.where(F.col("rank") <= _S.seeds), e, pool, _S), "hop1")
    order = Window.orderBy("via_rank", F.desc("weight"), "id")
    seeds = h1.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= _S.hop2_seeds)
    return h1, fusion.hop(seeds, e, pool.select("id").unionByName(h1.select("id")), _S)


def _hybrid(s: SparkSession, d: str) -> DataFrame:
    c, fused, pool = _fused(s, d)
    h1, h2 = _hops(s, d, pool)
    shown = c.select("id")
    new1 = h1.join(shown, "id", "left_semi").join(fused.select("id"), "id", "left_anti").withColumn("anchor_weight", F.lit(1.0))
    g1 = stage(fusion.graph_score(new1, fused, 1, _S).select("id", "score", "depth"), "graph1")
    new2 = h2.join(shown, "id", "left_semi").join(fused.select("id"), "id", "left_anti").withColumn("anchor_weight", F.lit(1.0))
    g2 = fusion.graph_score(new2, g1.select("id", "score").unionByName(fused.select("id", "score")), 2, _S).select("id", "score", "depth")
    grown = g1.unionByName(g2).orderBy(F.desc("score"), "id").limit(2 * (_S.seeds + _S.hop2_seeds))
    out = fused.select("id", "score", F.lit(0).alias("depth")).unionByName(grown)
    return out.orderBy(F.desc("score"), "id").limit(20).select("id", F.round("score", 9).alias("score"), "depth")


_TYPE_W = "CASE WHEN type IN ('mentions', 'touches') THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END"
_HYBRID = (
    q.with_(q.N, q.E, _CORPUS, *_bm25(), _POOL, *_VEC, *_HOPS)
    + f""", g1 AS (SELECT h.id, f.score * 0.5::DOUBLE * h.weight * {_TYPE_W} AS score, 1 AS depth FROM h1 h JOIN fu f ON f.id = h.via WHERE h.id IN (SELECT id FROM c) AND h.id NOT IN (SELECT id FROM fu)),
g2 AS (SELECT h.id, f.score * 0.5::DOUBLE * h.weight * {_TYPE_W} AS score, 2 AS depth FROM h2 h JOIN (SELECT id, score FROM g1 UNION ALL SELECT id, score FROM fu) f ON f.id = h.via WHERE h.id IN (SELECT id FROM c) AND h.id NOT IN (SELECT id FROM fu)),
gr AS (SELECT * FROM (SELECT * FROM g1 UNION ALL SELECT * FROM g2) ORDER BY score DESC, id LIMIT 54)
SELECT id, round(score, 9) AS score, depth FROM (SELECT id, score, 0 AS depth FROM fu UNION ALL SELECT * FROM gr) ORDER BY score DESC, id LIMIT 20"""
)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _spread(s: SparkSession, d: str) -> DataFrame:
    return _rounded(lexical.spread(_pool(s, d)), "spread")


def _trigger(s: SparkSession, d: str) -> DataFrame:
    row = lexical.spread(_pool(s, d)).first()
    reasons = lexical.trigger(row["hits"], row["spread"], TEXT)
    return s.createDataFrame([(row["hits"], ",".join(reasons))], "hits long, reasons string")


def _federated(s: SparkSession, d: str) -> DataFrame:
    c = corpus(s, d).select("id", "title", "body", "tags", "scope")
    terms = lexical.parse(TEXT)
    lists = []
    for suffix, weight in (("core", 1.0), ("ops", 1.0), ("web", 0.99)):
        part = c.where(F.col("scope").endswith(f"-{suffix}")).drop("scope")
        lists.append((lexical.ranked(lexical.scores(part, terms), len(terms), ("or",), pool=60), weight))
    return _rounded(fusion.federated(lists).orderBy(F.desc("score"), "id").limit(20), "score")


def _federated_sql() -> str:
    parts, union = [], []
    for i, (suffix, w) in enumerate((("core", 1.0), ("ops", 1.0), ("web", 0.99))):
        tok, cnt, st, sc = _bm25(extra=f"scope LIKE '%-{suffix}'")
        for cte in (tok, cnt, st, sc):
            for name in ("tok", "cnt", "st", "sc"):
                cte = cte.replace(f" {name} ", f" {name}{i} ").replace(f" {name})", f" {name}{i})").replace(f" {name},", f" {name}{i},").replace(f"{name} AS (", f"{name}{i} AS (", 1) if name in cte else cte
            parts.append(cte)
        union.append(f"SELECT id, rank() OVER (ORDER BY round(score, 9) DESC) AS rank, {i} AS l FROM (SELECT * FROM sc{i} WHERE matched > 0 ORDER BY score DESC, id LIMIT 60)")
    score = " + ".join(f"{w}::DOUBLE / (60 + coalesce(min(rank) FILTER (l = {i}), 1000))" for i, w in enumerate((1.0, 1.0, 0.99)))
    return q.with_(q.N, _CORPUS, *parts, f"u AS ({' UNION ALL '.join(union)})") + f"SELECT id, round(score, 6) AS score FROM (SELECT id, {score} AS score FROM u GROUP BY id) ORDER BY score DESC, id LIMIT 20"


def _answers(s: SparkSession, d: str) -> DataFrame:
    """The pool as one answer per scope, cut to a budget."""
    c = current_nodes(table(s, d, "nodes"), "scope", "excerpt", "body")
    pool = _pool(s, d).select("id", F.col("rank").cast("int").alias("rank"))
    rows = pool.join(c, "id").select(F.col("scope").alias("answer"), "rank", "id", "excerpt", F.col("body").alias("content"))
    return fusion.assembled(rows, 1200)


def _access(s: SparkSession, d: str) -> DataFrame:
    c = corpus(s, d).withColumn("granted", F.lit(False)).where(vis.access_retrieval(VIEWER))
    terms = lexical.parse(TEXT)
    return lexical.ranked(lexical.scores(c.select("id", "title", "body", "tags"), terms), len(terms), ("or",), pool=12).select("id", "rank")


def _dedup(s: SparkSession, d: str) -> DataFrame:
    c = corpus(s, d).select("id", "kind", "title")
    rows = _pool(s, d).select("id", "rank").join(c, "id").withColumn("name", F.lower("title"))
    return fusion.first_of(rows, ["kind", "name"], ["rank", "id"]).select("id", "kind", "rank")


def _second_page(s: SparkSession, d: str) -> DataFrame:
    """The page after the first ten hits by its cursor, titles looked up for its rows alone."""
    pool = stage(_pool(s, d).select("id", "rank"), "pool")
    last = fusion.page(pool, 10).orderBy(F.desc("rank"), F.desc("id")).first()
    rows = fusion.page(pool, 10, (last["rank"], last["id"]) if last else None)
    return corpus(s, d).select("id", "title").join(F.broadcast(rows), "id").select("id", "rank", "title")


def _cached(s: SparkSession, d: str) -> DataFrame:
    """A question asked twice with the log unchanged: the second answer is the kept one."""
    cache = caching.ResultCache(lambda: 0.0)
    seq = caching.log_position(table(s, d, "oplog"))
    for asked in (TEXT, f"  {TEXT.upper()} "):
        rows = cache.get(caching.result_key(asked, ["all"], {}, {}), seq, lambda: (_pool(s, d).orderBy("rank", "id").limit(12).select("id", "rank").collect(), False))  # a page of 12
    return s.createDataFrame([(r["id"], int(r["rank"]), cache.hits, cache.misses) for r in rows], "id string, rank int, hits long, misses long")


def _changed(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "oplog").where("seq > 300").select("entity_id").distinct()


def _coverage(s: SparkSession, d: str) -> DataFrame:
    scored, _ = _scored(s, d)
    return _rounded(scored.where("matched > 0").orderBy(F.desc("matched"), F.desc("score"), "id").limit(30).select("id", "matched", "score"), "score")


def _ladder(s: SparkSession, d: str) -> DataFrame:
    scored, terms = _scored(s, d, LONG)
    return scored.withColumn("stage", lexical.stage_of(len(terms))).groupBy("stage").agg(F.count("*").alias("n"))


def _separation(s: SparkSession, d: str) -> DataFrame:
    """How near stated queries are to vectors of their own and of other labels, and how these rank."""
    per = vectors.separation(*_vectors(s, d)).where("best is not null")
    rank = 1 + F.col("better")
    return per.agg(F.round(F.avg("near"), 4).alias("near"), F.round(F.avg("far"), 4).alias("far"), F.count_if(rank == 1).alias("top1"), F.count_if(rank <= 3).alias("top3"), F.round(F.avg(1.0 / rank), 4).alias("mrr"))


_SEP = q.with_(_Q8, _knn_sql(10**9), "r AS (SELECT nn.query, 1 - distance AS cos, a.label = b.label AS near FROM nn JOIN q8 a ON a.vec_id = nn.id JOIN q8 b ON b.vec_id = nn.query WHERE nn.query <> nn.id)",
  "p AS (SELECT query, max(cos) FILTER (near) AS best, avg(cos) FILTER (near) AS c, avg(cos) FILTER (NOT near) AS f FROM r GROUP BY 1)",
  "x AS (SELECT p.*, 1 + (SELECT count(*) FROM r WHERE r.query = p.query AND NOT near AND cos > best) AS rank FROM p WHERE best IS NOT NULL)") + "SELECT round(avg(c), 4) AS near, round(avg(f), 4) AS far, count(*) FILTER (rank = 1) AS top1, count(*) FILTER (rank <= 3) AS top3, round(avg(1.0::DOUBLE / rank), 4) AS mrr FROM x"

_POOLED = q.with_(*_BASE, _POOL)

QUERIES = {
    "ret1_postings": Query(
        lambda s, d: lexical.postings(corpus(s, d).select("id", "title", "body", "tags")).groupBy("field").agg(F.count_distinct("term").alias("terms"), F.sum("tf").alias("tokens")),
        q.with_(q.N, _CORPUS) + " UNION ALL ".join(f"SELECT '{f}' AS field, count(DISTINCT t) AS terms, count(t) AS tokens FROM (SELECT unnest({_tok(f)}) AS t FROM c)" for f in lexical.WEIGHTS),
    ),
    "ret2_query_tokens": Query(lambda s, d: s.createDataFrame([(t.words[0], t.stem().words[0]) for t in lexical.parse(LONG)], "word string, stem string"), "SELECT * FROM (VALUES ('reconcile', 'reconc'), ('drifting', 'drift'), ('snapshots', 'snapsh'), ('packers', 'packe')) t(word, stem)"),
    "ret5_ladder": Query(_ladder, q.with_(q.N, _CORPUS, *_bm25(LONG)) + f"SELECT {_stage_sql(4)} AS stage, count(*) AS n FROM sc GROUP BY 1"),
    "ret6_bm25": Query(lambda s, d: _rounded(_scored(s, d)[0].select("id", "score", "matched"), "score"), q.with_(*_BASE) + "SELECT id, round(score, 6) AS score, matched FROM sc"),
    "ret7_search": Query(lambda s, d: _pool(s, d).orderBy("rank", "id").limit(12).select("id", "rank"), _POOLED + "SELECT id, rank FROM pool ORDER BY rank, id LIMIT 12"),
    "ret7_search_access": Query(
        _access,
        q.with_(q.N, _CORPUS, *_bm25(extra="((acl = 'team' AND team_id = 'team-harbor') OR (acl = 'private' AND owner_id = 'u-007') OR (acl = 'agent' AND agent_id = 'agent-19'))"))
        + "SELECT id, rank() OVER (ORDER BY round(score, 9) DESC) AS rank FROM (SELECT * FROM sc WHERE matched > 0 ORDER BY score DESC, id LIMIT 12)",
    ),
    "ret9_quantised": Query(
        lambda s, d: table(s, d, "embeddings").select("vec_id", F.aggregate(vectors.quantised(F.col("embedding")), F.lit(0), lambda a, x: a + x).alias("total"), F.array_max(vectors.quantised(F.col("embedding"))).alias("top")),
        q.with_(_Q8) + "SELECT vec_id, CAST(list_sum(v) AS BIGINT) AS total, list_max(v) AS top FROM q8",
    ),
    "ret10_dequantised": Query(
        lambda s, d: table(s, d, "embeddings").select("vec_id", vectors.quantised(F.col("embedding")).alias("v"), "embedding").select(
            "vec_id", F.round(F.aggregate(F.zip_with(vectors.dequantised(F.col("v"), F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double"))))), "embedding", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, x: F.greatest(a, x)), 4).alias("error")
        ),
        q.with_(_Q8) + "SELECT vec_id, round(list_max(list_transform(range(1, len(v) + 1), lambda i: abs(v[i] * list_max(list_transform(embedding, lambda y: abs(y::DOUBLE))) / 127 - embedding[i]::DOUBLE))), 4) AS error FROM q8",
    ),
    "ret12_normalised": Query(
        lambda s, d: table(s, d, "embeddings").select("vec_id", F.round(F.aggregate(vectors.normalised(F.col("embedding")), F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm")), "SELECT vec_id, 1.0::DOUBLE AS norm FROM embeddings"
    ),
    "ret13_neighbours": Query(lambda s, d: _rounded(_neighbours(s, d, 10), "distance"), q.with_(_Q8, _knn_sql(10)) + "SELECT query, id, round(distance, 6) AS distance FROM nn"),
    "ret13_scoped": Query(
        lambda s, d: _rounded(vectors.nearest_in(_placed(_vectors(s, d)[0]), _vectors(s, d)[1], ["s1", "s3"], (1, 2), k=5), "distance"),
        q.with_(_Q8) + f"""SELECT query, id, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, id) AS place FROM (
          SELECT a.vec_id AS query, b.vec_id AS id, 1 - {_DOT.format(a='a.v', b='b.v')} / sqrt({_DOT.format(a='a.v', b='a.v')} * {_DOT.format(a='b.v', b='b.v')}) AS distance
          FROM q8 a, q8 b WHERE a.vec_id % {QUERY_STEP} = 0 AND b.vec_id % 5 IN (1, 3) AND b.vec_id % 4 BETWEEN 1 AND 2)) WHERE place <= 5""",
    ),
    "ret14_reranked": Query(
        lambda s, d: _rounded(vectors.reranked(_neighbours(s, d), table(s, d, "embeddings")), "distance"),
        q.with_(_Q8, _knn_sql(20), _RERANK) + "SELECT query, id, round(distance, 6) AS distance, row_number() OVER (PARTITION BY query ORDER BY distance, id) AS rank FROM rr",
    ),
    "ret15_confidence": Query(
        lambda s, d: _rounded(vectors.confidence(_neighbours(s, d)).select("query", "id", "z"), "z"),
        q.with_(_Q8, _knn_sql(20)) + "SELECT query, id, round((avg(distance) OVER (PARTITION BY query) - distance) / stddev_pop(distance) OVER (PARTITION BY query), 6) AS z FROM nn",
    ),
    "ret17_hop1": Query(
        lambda s, d: _hops(s, d, stage(_pool(s, d).select("id", "rank"), "pool"))[0].select("id", "via", "type", "weight"), q.with_(q.N, q.E, _CORPUS, *_bm25(), _POOL, *_HOPS) + "SELECT id, via, type, weight FROM h1"
    ),
    "ret19_hop2": Query(
        lambda s, d: _hops(s, d, stage(_pool(s, d).select("id", "rank"), "pool"))[1].select("id", "via", "type", "weight"), q.with_(q.N, q.E, _CORPUS, *_bm25(), _POOL, *_HOPS) + "SELECT id, via, type, weight FROM h2"
    ),
    "ret20_coverage_order": Query(_coverage, q.with_(*_BASE) + "SELECT id, matched, round(score, 6) AS score FROM sc WHERE matched > 0 ORDER BY matched DESC, score DESC, id LIMIT 30"),
    "ret21_fused": Query(lambda s, d: _rounded(_fused(s, d)[1], "rrf", "score"), q.with_(*_BASE, _POOL, *_VEC) + "SELECT id, rank, vec_rank, round(rrf, 6) AS rrf, round(score, 6) AS score FROM fu"),
    "ret22_boost": Query(
        lambda s, d: _rounded(corpus(s, d).select("id", fusion.boost(NOW_MS, fusion.Settings(profile="prime")).alias("boost")), "boost"),
        q.with_(q.N, _CORPUS)
        + f"SELECT id, round((CASE priority WHEN 0 THEN 1.3::DOUBLE WHEN 1 THEN 1.15::DOUBLE WHEN 3 THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END) * (1 + 0.25::DOUBLE * exp(-greatest(0, floor(({NOW_MS} - updated_at) / 86400000)) / 90.0::DOUBLE)) * ([0.9, 1.0, 1.1, 1.2][layer + 1])::DOUBLE, 6) AS boost FROM c",
    ),
    "ret26_hybrid": Query(_hybrid, _HYBRID),
    "ret27_spread": Query(_spread, _POOLED + "SELECT count(*) AS hits, round((max(score) - list_sort(list(score), 'DESC')[count(*)::INT // 2 + 1]) / max(score), 6) AS spread FROM pool"),
    "ret28_trigger": Query(_trigger),
    "ret29_anchor_tokens": Query(
        lambda s, d: corpus(s, d).select(F.explode(F.regexp_extract_all("title", F.lit(r"([\p{L}\p{N}_][\p{L}\p{N}_.-]*)"), F.lit(1))).alias("t")).groupBy(lexical.anchor_token(F.col("t")).alias("anchor")).agg(F.count("*").alias("n")),
        q.with_(q.N, _CORPUS)
        + r"SELECT regexp_matches(t, '\d|[_./-]|[a-z][A-Z]') OR (length(t) >= 3 AND t = upper(t) AND regexp_matches(t, '[A-Z]')) OR regexp_full_match(t, '[A-Za-z0-9]{12,}') AS anchor, count(*) AS n FROM (SELECT unnest(regexp_extract_all(title, '[\p{L}\p{N}_][\p{L}\p{N}_.-]*')) AS t FROM c) GROUP BY 1",
    ),
    "ret30_first_stage": Query(
        lambda s, d: lexical.ranked(*(lambda x: (x[0], len(x[1])))(_scored(s, d, LONG)), ("and", "prefix_and", "prefix_relaxed", "prefix_relaxed2")).select("id", "stage", "rank"),
        q.with_(q.N, _CORPUS, *_bm25(LONG), f"sg AS (SELECT *, {_stage_sql(4)} AS stage FROM sc)")
        + "SELECT id, stage, rank() OVER (ORDER BY round(score, 9) DESC) AS rank FROM (SELECT * FROM sg WHERE stage <= 3 AND stage <= (SELECT min(stage) FROM sg) ORDER BY score DESC, id LIMIT 100)",
    ),
    "ret31_corpus_size": Query(lambda s, d: s.createDataFrame([(corpus(s, d).limit(1001).count(),)], "n long"), q.with_(q.N, _CORPUS) + "SELECT least(count(*), 1001) AS n FROM c"),
    "ret33_federated": Query(_federated, _federated_sql()),
    "ret35_changed_since": Query(_changed, "SELECT DISTINCT entity_id FROM oplog WHERE seq > 300"),
    "ret36_budgeted_answers": Query(_answers),
    "ret38_deduplicated": Query(
        _dedup, _POOLED + "SELECT id, kind, rank FROM (SELECT p.id, c.kind, p.rank, row_number() OVER (PARTITION BY c.kind, lower(c.title) ORDER BY p.rank, p.id) rn FROM pool p JOIN c ON c.id = p.id) WHERE rn = 1"
    ),
    "ret38_second_page": Query(
        _second_page, _POOLED + "SELECT p.id, p.rank, c.title FROM (SELECT id, rank FROM pool ORDER BY rank, id LIMIT 10 OFFSET 10) p JOIN c ON c.id = p.id"
    ),
    "ret34_cached": Query(_cached, _POOLED + "SELECT id, rank, 1::BIGINT AS hits, 1::BIGINT AS misses FROM pool ORDER BY rank, id LIMIT 12"),
    "agg28_separation": Query(_separation, _SEP),
}

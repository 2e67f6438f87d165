"""Queries of the training-data operators, with SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe, mixing, near_duplicates, pii, survivors
from graphloom.plans.registry import Query
from graphloom.sources.tables import table


def _p2_records(spark: SparkSession, d: str) -> DataFrame:
    nodes = near_duplicates.node_records(table(spark, d, "nodes"))
    return nodes.unionByName(near_duplicates.pair_records(table(spark, d, "absorb_pairs")))


def _p7(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sizes = mixing.sized(table(spark, d, "documents"))
    plans = mixing.plan(sizes, table(spark, d, "mix_targets"))
    return mixing.mixed(sizes, plans), plans


def _p7_shares(spark: SparkSession, d: str) -> DataFrame:
    uses, plans = _p7(spark, d)
    return mixing.shares(uses, plans)


_P5_SQL = """
WITH r AS (
  SELECT id, scope, kind, lower(split_part(content_hash, ':', 1)) AS content_hash, attrs,
    CASE WHEN updated_at < 100000000000 THEN updated_at * 1000 WHEN updated_at < 100000000000000 THEN updated_at ELSE updated_at // 1000 END AS instant
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY hlc DESC, site_id DESC) rn FROM nodes) WHERE rn = 1 AND deleted_at IS NULL
), g AS (
  SELECT scope, kind, content_hash FROM r GROUP BY ALL HAVING count(*) >= 2
), k AS (
  SELECT r.*, unnest(json_keys(attrs)) AS field FROM r SEMI JOIN g USING (scope, kind, content_hash)
), v AS (
  SELECT *, json_extract(attrs, '$."' || field || '"') AS value, json_extract_string(attrs, '$."' || field || '"') AS said FROM k
)
SELECT scope, kind, content_hash, field, arg_max(id, (instant, -rank)) AS id
FROM (SELECT *, row_number() OVER (PARTITION BY scope, kind, content_hash, field ORDER BY id) AS rank FROM v
      WHERE said IS NOT NULL AND CAST(value AS VARCHAR) NOT IN ('[]', '{}')
        AND lower(trim(said)) NOT IN ('', '-', '--', '?', '??', 'n/a', 'na', 'nan', 'nil', 'none', 'null', 'not known', 'tba', 'tbd', 'undefined', 'unknown', 'unset'))
GROUP BY scope, kind, content_hash, field
"""

QUERIES = {
    "p2_found": Query(lambda s, d: near_duplicates.similar_pairs(_p2_records(s, d))),
    "p2_groups": Query(lambda s, d: near_duplicates.similar_groups(_p2_records(s, d))),
    "p5_found": Query(lambda s, d: survivors.last_filled(table(s, d, "nodes")).drop("value"), _P5_SQL),
    "p5_records": Query(lambda s, d: survivors.surviving_records(table(s, d, "nodes"))),
    "p5_fused": Query(lambda s, d: survivors.fused(table(s, d, "nodes"))),
    "p6_ids": Query(lambda s, d: bpe.encode_table(table(s, d, "documents"), "doc_id", "text")),
    "p6_counts": Query(
        lambda s, d: bpe.count_table(table(s, d, "documents"), ["doc_id", "source"], "text").groupBy("source").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"))
    ),
    "p7_mix": Query(lambda s, d: _p7(s, d)[0]),
    "p7_shares": Query(_p7_shares),
    "p8_found": Query(lambda s, d: pii.find(table(s, d, "documents"))),
    "p8_redacted": Query(lambda s, d: pii.redact(table(s, d, "documents"))),
}

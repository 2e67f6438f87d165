"""Current state of a table from a feed of inserts, updates and deletes.

Column-wise last writer wins, in SQL: each field takes the change with the
greatest clock (max_by), counters take the greatest total of each site, edges
are observed-remove sets of tags, and a purged entity keeps nothing.  All three
merges ignore order and repeats, so no sort and no separate removal of repeated
op_ids is needed: an op_id that arrives again changes no maximum.

The feed is scanned once for all three, and once more, two columns of it, for
purges.  Shuffles: one on (entity, field, part), where part is the site of a counter or
the tag of an edge, and one on (entity, field), both after map-side
aggregation, so that a hot entity is reduced before it moves; purges are
removed from the reduced rows only.

Defined results: an operation without entity_id, op or op_id is ignored; a null
field is read as an empty one; a counter value that isn't a number is ignored,
and a counter without a number is no case; an edge_add whose JSON has no tag
counts with its op_id as tag; malformed edge_del JSON removes nothing; columns
other than the named ones are ignored; an empty feed gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

STATE_SQL = """
WITH ops AS (
  SELECT op_id, entity_id, op, coalesce(field, '') AS field, value, site_id,
         struct(hlc.ts AS ts, hlc.ctr AS ctr, site_id AS site, op_id AS op_id) AS clock
  FROM {feed}
  WHERE entity_id IS NOT NULL AND op_id IS NOT NULL
), parts AS (
  SELECT entity_id, field, p.*
  FROM ops LATERAL VIEW explode(CASE op
    WHEN 'set' THEN array(named_struct(
      'what', 'set', 'part', '', 'clock', clock, 'total', CAST(NULL AS DECIMAL(38, 0)), 'gone', false))
    WHEN 'inc' THEN array(named_struct(
      'what', 'inc', 'part', coalesce(site_id, ''), 'clock', CAST(NULL AS STRUCT<ts: BIGINT, ctr: INT, site: STRING, op_id: STRING>),
      'total', try_cast(trim(BOTH '" ' FROM value) AS DECIMAL(38, 0)), 'gone', false))
    WHEN 'edge_add' THEN array(named_struct(
      'what', 'edge', 'part', coalesce(get_json_object(value, '$.tag'), op_id), 'clock', clock, 'total', CAST(NULL AS DECIMAL(38, 0)), 'gone', false))
    WHEN 'edge_del' THEN transform(from_json(get_json_object(value, '$.tags'), 'array<string>'), tag -> named_struct(
      'what', 'edge', 'part', tag, 'clock', CAST(NULL AS STRUCT<ts: BIGINT, ctr: INT, site: STRING, op_id: STRING>),
      'total', CAST(NULL AS DECIMAL(38, 0)), 'gone', true))
    END) AS p
  WHERE op IN ('set', 'inc', 'edge_add', 'edge_del')
), merged AS (
  SELECT entity_id, field, what, part, max(clock) AS clock, max(total) AS total
  FROM parts
  GROUP BY entity_id, field, what, part
  HAVING NOT bool_or(gone)
), fields AS (
  SELECT entity_id, field, what, max(clock).op_id AS last_op, CAST(sum(total) AS STRING) AS total
  FROM merged
  GROUP BY entity_id, field, what
), purged AS (
  SELECT DISTINCT entity_id AS dead FROM ops WHERE op = 'purge'
), cases AS (
  SELECT entity_id, field, what, CASE WHEN what = 'inc' THEN total ELSE last_op END AS result,
         substring_index(entity_id, '|', 1) AS src, substring_index(entity_id, '|', -1) AS dst
  FROM fields
)
SELECT entity_id, field, what, result
FROM cases c
LEFT ANTI JOIN purged p ON c.entity_id = p.dead
LEFT ANTI JOIN purged p ON CASE WHEN c.what = 'edge' THEN c.src END = p.dead
LEFT ANTI JOIN purged p ON CASE WHEN c.what = 'edge' THEN c.dst END = p.dead
WHERE result IS NOT NULL
"""


def current_state(feed: DataFrame) -> DataFrame:
    """(entity_id, field, what, result) that remain after the whole feed.

    ``what`` is ``set``, ``inc`` or ``edge``; ``result`` is the op_id that won,
    or the total of a counter as decimal text.
    """
    return feed.sparkSession.sql(STATE_SQL, feed=feed)

"""Registry of the core queries: name -> (query, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagewright.operators import nested, timestamps
from pagewright.plans import times_sql
from pagewright.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        SQL[name] = sql


_TREE_SQL = """
WITH RECURSIVE trees AS (SELECT DISTINCT snapshot_id, tree FROM snapshots WHERE json_valid(tree)),
nodes AS (
  SELECT snapshot_id, tree::JSON AS j, []::BIGINT[] AS path, 0::BIGINT AS depth FROM trees WHERE json_type(tree) = 'OBJECT'
  UNION ALL
  SELECT snapshot_id, c.x, list_append(path, c.i), depth + 1
  FROM (SELECT snapshot_id, path, depth, CASE json_type(j, '$.children') WHEN 'ARRAY' THEN json_extract(j, '$.children[*]') WHEN 'OBJECT' THEN [json_extract(j, '$.children')] END AS kids FROM nodes) p,
    LATERAL (SELECT unnest(kids) AS x, unnest(range(len(kids))) AS i) c
  WHERE json_type(c.x) = 'OBJECT'),
numbered AS (SELECT snapshot_id, path, depth, row_number() OVER (PARTITION BY snapshot_id ORDER BY path) - 1 AS preorder FROM nodes)
SELECT n.snapshot_id, n.preorder, coalesce(p.preorder, -1) AS parent_preorder, n.depth
FROM numbered n LEFT JOIN numbered p ON n.snapshot_id = p.snapshot_id AND len(n.path) > 0 AND p.path = n.path[1:len(n.path) - 1] AND p.depth = n.depth - 1
"""

register("p4_found", lambda s, d: nested.tree_links(table(s, d, "snapshots")), _TREE_SQL)
register("p4_nodes", lambda s, d: nested.tree_nodes(table(s, d, "snapshots")))


def _times(s: SparkSession, d: str, **how) -> DataFrame:
    return timestamps.normalised_times(table(s, d, "ldjson_blocks"), table(s, d, "extractions"), table(s, d, "page_in"), table(s, d, "domain_cfg"), **how)


register("p7_found", lambda s, d: _times(s, d).filter("utc_micros is not null").select("field", "record_id", "pos", "utc_micros"), times_sql.FOUND)
#: Here the locale is a hint only, and without one the source's counts decide.
register("p7_times", lambda s, d: _times(s, d, weight=timestamps.HINT_WEIGHT, day_first=False).withColumn("utc", timestamps.utc_text("utc_micros")).drop("utc_micros"))

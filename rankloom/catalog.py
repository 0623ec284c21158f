"""Every query of the library by name, and the SQL that it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    from rankloom.operators.nested import answer_titles, record_children

    return answer_titles(spark.read.parquet(f"{d}/pasa_like_sample.parquet")).unionByName(
        record_children(spark.read.parquet(f"{d}/papers_with_duplicates.parquet"))
    )


P4_SQL = r"""
WITH decoded AS (
  SELECT row_id, CASE WHEN json_valid(answer) AND json_type(answer) = 'VARCHAR'
                       AND json_valid(answer->>'$') AND json_type(answer->>'$') IN ('ARRAY', 'OBJECT')
                      THEN answer->>'$' ELSE answer END AS doc
  FROM pasa_like_sample WHERE json_valid(answer)),
nodes AS (
  SELECT d.row_id, t.id, t.type, t.value FROM decoded d, json_tree(d.doc) t
  WHERE regexp_full_match(t.fullkey, '\$(\[\d+\])*') AND t.type <> 'ARRAY'),
items AS (
  SELECT row_id, type, value, row_number() OVER (PARTITION BY row_id ORDER BY id) - 1 AS pos FROM nodes),
titles AS (
  SELECT row_id, pos, CASE
    WHEN type = 'VARCHAR' THEN value->>'$'
    WHEN type = 'OBJECT' AND json_type(value, '$.title') = 'VARCHAR' AND regexp_matches(value->>'$.title', '[^\s\p{Z}\p{C}]') THEN value->>'$.title'
    WHEN type = 'OBJECT' AND json_type(value, '$.paper.title') = 'VARCHAR' THEN value->>'$.paper.title' END AS val
  FROM items),
names AS (
  SELECT rec_id, generate_subscripts(authorships, 1) - 1 AS pos, unnest(authorships).author.display_name AS val
  FROM papers_with_duplicates)
SELECT 'answer' AS kind, row_id AS parent_id, CAST(pos AS INTEGER) AS item_pos, val FROM titles
WHERE regexp_matches(val, '[^\s\p{Z}\p{C}]')
  AND NOT regexp_full_match(val, '(?i)\s*(https?://\S*/(abs|pdf)/)?(arxiv\s*[:./]?\s*)?\d{4}\.\d{4,5}(v\d+)?(\.pdf)?\s*')
UNION ALL
SELECT 'author', rec_id, CAST(pos AS INTEGER), val FROM names WHERE regexp_matches(val, '[^\s\p{Z}\p{C}]')
UNION ALL
SELECT 'doi', rec_id, 0, externalids.doi FROM papers_with_duplicates WHERE regexp_matches(externalids.doi, '[^\s\p{Z}\p{C}]')
"""


def _registered() -> tuple[dict[str, Query], dict[str, str]]:
    from rankloom import registry
    from rankloom.plans import diagnosis, evaluation, extra, planner, ranking, records, rerank, scalars, service, understand  # noqa: F401

    return registry.QUERIES, registry.SQL


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Every question's candidates reranked, explained and cut to the best 20."""
    return _registered()[0]["H07_flagship"](spark, d)


def queries() -> dict[str, Query]:
    return {"p4_found": p4_found} | _registered()[0]


def oracle_sql() -> dict[str, str]:
    return {"p4_found": P4_SQL} | _registered()[1]

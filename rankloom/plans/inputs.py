"""Ranked candidates, gold items and records as plain tables, and the same in SQL.

Every ranking here has its rank as a column; row order means nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.functions.text import ascii_words, letters_key
from rankloom.functions.ident import paper_key
from rankloom.operators.nested import answer_titles


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """(qid, source, rank, pred_id, item_pos, title, doi, arxiv_id, openalex_id, abstract, score, nsrc, key).

    Items of a page that was delivered twice count once; rank runs within qid and source.
    """
    p = F.col("p")
    score = p["raw"]["day8_final_score"]
    items = (
        table(spark, d, "predictions")
        .select("qid", "source", "pred_id", F.posexplode("papers").alias("item_pos", "p"))
        .select(
            "qid", "source", "pred_id", "item_pos", p["title"].alias("title"), p["doi"].alias("doi"), p["arxiv_id"].alias("arxiv_id"),
            p["openalex_id"].alias("openalex_id"), p["abstract"].alias("abstract"),
            F.when(~F.isnan(score), score).alias("score"), p["raw"]["b4_source_count"].alias("nsrc"),
        )
        .distinct()
    )
    ranked = items.withColumn("rank", F.row_number().over(Window.partitionBy("qid", "source").orderBy("pred_id", "item_pos")))
    place = F.concat_ws("-", "pred_id", "item_pos")
    return ranked.withColumn("key", paper_key(F.col("doi"), F.col("arxiv_id"), F.col("openalex_id"), ascii_words(F.col("title")), place))


def gold(spark: SparkSession, d: str) -> DataFrame:
    """(qid, gold_index, title, tkey): distinct answer titles of each question, in the order of its first row."""
    questions = table(spark, d, "pasa_like_sample").where("qid is not null").select(F.col("row_id").alias("parent_id"), "qid")
    titles = answer_titles(table(spark, d, "pasa_like_sample")).join(questions, "parent_id")
    first = titles.groupBy("qid", letters_key(F.col("val")).alias("tkey")).agg(F.min(F.struct("parent_id", "item_pos", "val")).alias("f"))
    at = Window.partitionBy("qid").orderBy("f.parent_id", "f.item_pos")
    return first.where("tkey <> ''").select("qid", (F.row_number().over(at) - 1).alias("gold_index"), F.col("f.val").alias("title"), "tkey")


# ---- the same in SQL

def norm(c: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]+', ' ', 'g'))"


def ident(c: str) -> str:
    t = f"trim(coalesce({c}, ''))"
    for p in ("https://doi.org/", "http://doi.org/", "https://arxiv.org/abs/", "arXiv:", "arxiv:"):
        t = f"replace({t}, '{p}', '')"
    return f"trim(lower(regexp_replace({t}, '(?i)v\\d+$', '')))"


def key_sql() -> str:
    tried = ", ".join(f"CASE WHEN {ident(c)} <> '' THEN '{p}:' || {ident(c)} END" for p, c in (("doi", "doi"), ("arxiv", "arxiv_id"), ("openalex", "openalex_id")))
    return f"coalesce({tried}, CASE WHEN {norm('title')} <> '' THEN 'title:' || {norm('title')} END, 'place:' || pred_id || '-' || item_pos)"


CAND = f"""items0 AS (
  SELECT qid, source, pred_id, unnest(papers) AS p, generate_subscripts(papers, 1) - 1 AS item_pos FROM predictions),
items AS (
  SELECT DISTINCT qid, source, pred_id, item_pos, p.title AS title, p.doi AS doi, p.arxiv_id AS arxiv_id, p.openalex_id AS openalex_id,
    p.abstract AS abstract, CASE WHEN NOT isnan(p.raw.day8_final_score) THEN p.raw.day8_final_score END AS score, p.raw.b4_source_count AS nsrc FROM items0),
cand AS (
  SELECT *, row_number() OVER (PARTITION BY qid, source ORDER BY pred_id, item_pos) AS rank, {key_sql()} AS key FROM items)"""

LETTERS = "lower(regexp_replace(coalesce({c}, ''), '[^\\p{{L}}]', '', 'g'))"


def letters(c: str) -> str:
    return LETTERS.format(c=c)


ANSWERS = r"""decoded AS (
  SELECT row_id, CASE WHEN json_valid(answer) AND json_type(answer) = 'VARCHAR' AND json_valid(answer->>'$')
      AND json_type(answer->>'$') IN ('ARRAY', 'OBJECT') THEN answer->>'$' ELSE answer END AS doc
  FROM pasa_like_sample WHERE json_valid(answer)),
nodes AS (
  SELECT d.row_id, t.id, t.type, t.value FROM decoded d, json_tree(d.doc) t
  WHERE regexp_full_match(t.fullkey, '\$(\[\d+\])*') AND t.type <> 'ARRAY'),
jitems AS (SELECT row_id, type, value, row_number() OVER (PARTITION BY row_id ORDER BY id) - 1 AS pos FROM nodes),
titles0 AS (
  SELECT row_id, pos, CASE
    WHEN type = 'VARCHAR' THEN value->>'$'
    WHEN type = 'OBJECT' AND json_type(value, '$.title') = 'VARCHAR' AND regexp_matches(value->>'$.title', '[^\s\p{Z}\p{C}]') THEN value->>'$.title'
    WHEN type = 'OBJECT' AND json_type(value, '$.paper.title') = 'VARCHAR' THEN value->>'$.paper.title' END AS val
  FROM jitems),
answers AS (
  SELECT row_id, pos, val FROM titles0 WHERE regexp_matches(val, '[^\s\p{Z}\p{C}]')
    AND NOT regexp_full_match(val, '(?i)\s*(https?://\S*/(abs|pdf)/)?(arxiv\s*[:./]?\s*)?\d{4}\.\d{4,5}(v\d+)?(\.pdf)?\s*'))"""

GOLD = f"""{ANSWERS},
gold0 AS (
  SELECT q.qid, {letters('a.val')} AS tkey, a.row_id, a.pos, a.val,
    row_number() OVER (PARTITION BY q.qid, {letters('a.val')} ORDER BY a.row_id, a.pos) AS n
  FROM answers a JOIN pasa_like_sample q USING (row_id) WHERE q.qid IS NOT NULL),
gold AS (
  SELECT qid, tkey, val AS title, row_number() OVER (PARTITION BY qid ORDER BY row_id, pos) - 1 AS gold_index
  FROM gold0 WHERE n = 1 AND tkey <> '')"""

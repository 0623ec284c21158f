"""Smaller operators: residual text rules, coverage of hits, audits, folds and roll-ups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rankloom.functions.text import GENERIC, ascii_words
from rankloom.plans.evaluation import _CURVE, _REL, PER, curve, labelled, per_query
from rankloom import lexicon as L
from rankloom.plans.inputs import CAND, candidates, norm, table
from rankloom.plans.ranking import STRONG, SUBQUERY, by_source, case, place, strong_id
from rankloom.plans.scalars import questions as by_qid
from rankloom.plans.understand import _CON, _Q, constraints, questions
from rankloom.registry import query

@query("D12_near_matches_by_author")
def d12(spark, d):
    """Unmatched gold most like each unmatched candidate: letter ratio 0.97 or word jaccard 0.94.

    Ratio 0.90 beside the same first author and near years would do too, but neither table has authors or years.
    """
    from rankloom.plans.records import d11

    best = F.struct(F.round("ratio", 4), -F.col("gold_index"))
    return d11(spark, d).where("ratio >= 0.97 or jaccard >= 0.94").groupBy("qid", "rank").agg(F.max_by("gold_index", best).alias("gold_index"), F.max_by("jaccard", best).alias("jaccard"))


@query("D14_relevance_vector", f"WITH {_REL} SELECT qid, string_agg(rel::VARCHAR, '' ORDER BY rank) AS vector FROM rel WHERE rank <= 20 GROUP BY qid")
def d14(spark, d):
    r = labelled(spark, d).where("rank <= 20").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "rel"))).alias("v"))
    return r.select("qid", F.array_join(F.transform("v", lambda x: x["rel"].cast("string")), "").alias("vector"))


_GEN = "[" + ", ".join(repr(g) for g in GENERIC) + "]"


_FOLD = "CAST(('0x' || substr(sha256('13:' || qid), 1, 12)) AS BIGINT) % 5"


@query("Q02_plan_targets", f"WITH {PER} SELECT per.qid, q.question FROM per JOIN (SELECT qid, min(question) AS question FROM predictions WHERE question IS NOT NULL GROUP BY qid) q USING (qid) WHERE tp = 0")
def q02(spark, d):
    return per_query(spark, d).where("tp = 0").select("qid").join(by_qid(spark, d), "qid")


@query("Q03_plan_coverage", f"WITH {_CON} SELECT row_id, string_agg(DISTINCT kind, ';' ORDER BY kind) AS kinds, min(text) FILTER (idx = 0) AS plan_1, min(text) FILTER (idx = 1) AS plan_2 FROM con GROUP BY row_id")
def q03(spark, d):
    at = lambda i: F.min(F.when(F.col("idx") == i, F.col("text")))
    return constraints(spark, d).groupBy("row_id").agg(F.array_join(F.array_sort(F.collect_set("kind")), ";").alias("kinds"), at(0).alias("plan_1"), at(1).alias("plan_2"))



"""Aggregation of hits, fusion of ranked lists, cut-offs and de-duplication per query.

The three sources of the candidate table stand for the search channels of the formulas:
semantic_scholar is the raw channel, openalex the cleaned one, arxiv the keyword one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.ident import light_ident
from rankloom.functions.text import ascii_words
from rankloom.plans.inputs import CAND, candidates, ident, norm, table
from rankloom.registry import query
from rankloom.scratch import grown, stage

# Weight and rank offset of a search channel.
WEIGHT = {"semantic_scholar": 1.00, "openalex": 0.95, "arxiv": 0.90}
ANCHOR = {"semantic_scholar": (1.20, 3), "openalex": (1.00, 4), "arxiv": (0.35, 8)}
SUBQUERY = {"semantic_scholar": 1.00, "openalex": 1.10, "arxiv": 0.95}
NEVER = 999_999


def by_source(values: dict[str, float], other: float) -> Column:
    out = F.lit(other)
    for k, v in values.items():
        out = F.when(F.col("source") == k, v).otherwise(out)
    return out


def case(values: dict[str, float], other: float) -> str:
    return "CASE source " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + f" ELSE {other} END"


def strong_id() -> Column:
    return (light_ident(F.col("doi")) != "") | (light_ident(F.col("arxiv_id")) != "") | (light_ident(F.col("openalex_id")) != "")


STRONG = f"({ident('doi')} <> '' OR {ident('arxiv_id')} <> '' OR {ident('openalex_id')} <> '')"


def place(df: DataFrame, *order: Column, by: str = "qid", name: str = "place") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order)))


@query("F01_weighted_hits", f"""WITH {CAND}, a AS (
  SELECT qid, key, round(sum({case(WEIGHT, 0.75)} / (rank + 4)), 9) AS score, count(*) AS occurrences, min(rank) AS best_rank, min(lower(title)) AS t FROM cand GROUP BY qid, key)
SELECT qid, key, score, occurrences, best_rank, row_number() OVER (PARTITION BY qid ORDER BY score DESC, occurrences DESC, best_rank, t, key) AS place FROM a""")
def f01(spark, d):
    a = candidates(spark, d).groupBy("qid", "key").agg(
        F.round(F.sum(by_source(WEIGHT, 0.75) / (F.col("rank") + 4)), 9).alias("score"), F.count("*").alias("occurrences"),
        F.min("rank").alias("best_rank"), F.min(F.lower("title")).alias("t"))
    return place(a, F.desc("score"), F.desc("occurrences"), F.asc("best_rank"), F.asc("t"), F.asc("key")).drop("t")


_AW, _AO = {k: v[0] for k, v in ANCHOR.items()}, {k: v[1] for k, v in ANCHOR.items()}


@query("F02_anchored_hits", f"""WITH {CAND}, a AS (
  SELECT qid, key, round(sum({case(_AW, 0.10)} / (rank + {case(_AO, 12)})) + CASE WHEN count(*) >= 2 THEN 0.04 * (count(*) - 1) ELSE 0 END + CASE WHEN bool_or({STRONG}) THEN 0.015 ELSE 0 END, 9) AS score,
    coalesce(min(rank) FILTER (source IN ('semantic_scholar', 'openalex')), {NEVER}) AS anchor, coalesce(min(rank) FILTER (source = 'semantic_scholar'), {NEVER}) AS raw,
    count(*) AS occurrences, min(rank) AS best_rank, min(lower(title)) AS t FROM cand GROUP BY qid, key)
SELECT qid, key, score, anchor, raw, row_number() OVER (PARTITION BY qid ORDER BY score DESC, anchor, raw, occurrences DESC, best_rank, t, key) AS place FROM a""")
def f02(spark, d):
    a = anchored(candidates(spark, d))
    return place(a, F.desc("score"), F.asc("anchor"), F.asc("raw"), F.desc("occurrences"), F.asc("best_rank"), F.asc("t"), F.asc("key")).select(
        "qid", "key", "score", "anchor", "raw", "place")


def anchored(c: DataFrame) -> DataFrame:
    n = F.count("*")
    score = F.sum(by_source(_AW, 0.10) / (F.col("rank") + by_source(_AO, 12)))
    score = score + F.when(n >= 2, 0.04 * (n - 1)).otherwise(0.0) + F.when(F.bool_or(strong_id()), 0.015).otherwise(0.0)
    least = lambda *s: F.coalesce(F.min(F.when(F.col("source").isin(*s), F.col("rank"))), F.lit(NEVER))
    return c.groupBy("qid", "key").agg(
        F.round(score, 9).alias("score"), least("semantic_scholar", "openalex").alias("anchor"), least("semantic_scholar").alias("raw"),
        n.alias("occurrences"), F.min("rank").alias("best_rank"), F.min(F.lower("title")).alias("t"))


@query("F03_enriched_candidates", f"""WITH {CAND}
SELECT qid, key, arg_min(doi, (rank, source, pred_id, item_pos)) FILTER (doi IS NOT NULL) AS doi, arg_min(arxiv_id, (rank, source, pred_id, item_pos)) FILTER (arxiv_id IS NOT NULL) AS arxiv_id,
  arg_min(openalex_id, (rank, source, pred_id, item_pos)) FILTER (openalex_id IS NOT NULL) AS openalex_id FROM cand GROUP BY qid, key""")
def f03(spark, d):
    at = F.struct("rank", "source", "pred_id", "item_pos")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), at)).alias(c)
    return candidates(spark, d).groupBy("qid", "key").agg(first("doi"), first("arxiv_id"), first("openalex_id"))


@query("F06_rescue_hits", f"""WITH {CAND}, a AS (
  SELECT qid, key, round(sum((0.55 + 0.35 * {case({'semantic_scholar': 0.94, 'openalex': 0.86, 'arxiv': 0.4}, 0.4)} + 0.10 * coalesce(least(1.0, greatest(0.0, score)), 0.0)) / log2(rank + 2))
      + CASE WHEN count(*) >= 2 THEN least(0.20, 0.08 * (count(*) - 1)) ELSE 0 END + CASE WHEN bool_or({STRONG}) THEN 0.02 ELSE 0 END, 9) AS score,
    count(*) AS occurrences, min(rank) AS best_rank, min(lower(title)) AS t, bool_or({STRONG}) AS strong FROM cand GROUP BY qid, key)
SELECT qid, key, score, array_to_string(list_filter(['anchor_rescue_source', CASE WHEN occurrences >= 2 THEN 'multi_plan_supported' END, CASE WHEN best_rank <= 10 THEN 'high_rank_rescue_hit' WHEN best_rank <= 20 THEN 'top20_rescue_hit' END, CASE WHEN strong THEN 'strong_identifier_available' END], lambda x: x IS NOT NULL), ',') AS tags,
  row_number() OVER (PARTITION BY qid ORDER BY score DESC, occurrences DESC, best_rank, t, key) AS place FROM a""")
def f06(spark, d):
    n, s = F.count("*"), F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score"))), F.lit(0.0))
    weight = 0.55 + 0.35 * by_source({"semantic_scholar": 0.94, "openalex": 0.86, "arxiv": 0.4}, 0.4) + 0.10 * s
    score = F.sum(weight / F.log2(F.col("rank") + 2)) + F.when(n >= 2, F.least(F.lit(0.20), 0.08 * (n - 1))).otherwise(0.0)
    a = candidates(spark, d).groupBy("qid", "key").agg(
        F.round(score + F.when(F.bool_or(strong_id()), 0.02).otherwise(0.0), 9).alias("score"), n.alias("n"), F.min("rank").alias("best"),
        F.min(F.lower("title")).alias("t"), F.bool_or(strong_id()).alias("strong"))
    tags = F.array_compact(F.array(
        F.lit("anchor_rescue_source"), F.when(F.col("n") >= 2, "multi_plan_supported"),
        F.when(F.col("best") <= 10, "high_rank_rescue_hit").when(F.col("best") <= 20, "top20_rescue_hit"), F.when(F.col("strong"), "strong_identifier_available")))
    return place(a, F.desc("score"), F.desc("n"), F.asc("best"), F.asc("t"), F.asc("key")).select("qid", "key", "score", F.array_join(tags, ",").alias("tags"), "place")


@query("F07_local_search", f"""WITH q AS (SELECT DISTINCT row_id, unnest(list_distinct(string_split({norm('question')}, ' '))) AS t FROM pasa_like_sample WHERE question IS NOT NULL),
docs AS (SELECT DISTINCT doc_id, unnest(list_distinct(string_split({norm('text')}, ' '))) AS t FROM documents WHERE doc_kind = 'question' AND text IS NOT NULL),
n AS (SELECT count(DISTINCT doc_id) AS n FROM docs), idf AS (SELECT t, ln((SELECT n FROM n) / count(*)) AS w FROM docs WHERE len(t) > 3 GROUP BY t),
s AS (SELECT row_id, doc_id, round(sum(w), 9) AS score FROM q JOIN docs USING (t) JOIN idf USING (t) GROUP BY ALL)
SELECT * FROM (SELECT row_id, doc_id, score, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, doc_id) AS place FROM s) WHERE place <= 10""")
def f07(spark, d):
    """Local search over the documents of kind question, the subset that the SQL names."""
    return local_search(spark, d, "doc_kind = 'question'")


@query("F07_local_search_all")
def f07_all(spark, d):
    """Local search over every document that has a text."""
    return local_search(spark, d)


#: Questions and documents that one task scores together.
ASKED_PART, DOCUMENT_PART = 20_000, 16_000


def local_search(spark, d, which: str = "true") -> DataFrame:
    """Inverted index over documents: the ten best of each question.

    Only tokens of more than three characters that occur on both sides weigh anything.
    Questions with the same of these are scored once. A grid of tasks scores every
    document that shares a token, with one addition a token and document in arrays.
    """
    split = lambda c: F.explode(F.filter(F.array_distinct(F.split(ascii_words(F.col(c)), " ")), lambda t: F.length(t) > 3)).alias("t")
    kept = table(spark, d, "documents").where(which).where("text is not null")
    q = table(spark, d, "pasa_like_sample").where("question is not null").select("row_id", split("question")).distinct()
    docs = kept.select("doc_id", split("text")).join(grown(q.select("t").distinct()), "t", "left_semi").distinct()
    docs = stage(docs.groupBy("doc_id").agg(F.collect_list("t").alias("ts")), "search-docs")
    total = kept.agg(F.count_distinct("doc_id").alias("n"))
    idf = docs.select(F.explode("ts").alias("t")).groupBy("t").agg(F.count("*").alias("df")).join(F.broadcast(total)).select("t", F.log(F.col("n") / F.col("df")).alias("w"))
    asked = q.join(grown(idf), "t").groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("t", "w"))).alias("terms"))
    asked = stage(asked.withColumn("asked", F.xxhash64("terms.t")), "search-asked")
    sets = stage(asked.groupBy("asked").agg(F.first("terms").alias("terms")), "search-sets")

    rows = max(1, -(-sets.measured["rows"] // ASKED_PART))
    columns = max(-(-docs.measured["rows"] // DOCUMENT_PART), min(8, docs.measured["rows"]), 1)
    hashed = lambda ts: F.transform(ts, lambda t: F.xxhash64(t))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = sets.select(F.pmod("asked", F.lit(rows)).alias("r"), every(columns).alias("c"), "asked", hashed(F.col("terms.t")).alias("ts"), F.col("terms.w").alias("ws"))
    right = docs.select(every(rows).alias("r"), F.pmod(F.xxhash64("doc_id"), F.lit(columns)).alias("c"), "doc_id", hashed(F.col("ts")).alias("ts"))
    left, right = (x.select((F.col("r") * columns + F.col("c")).cast("long").alias("cell"), *x.columns[2:]).repartition(rows * columns, "cell") for x in (left, right))
    kind = kept.schema["doc_id"].dataType.simpleString()
    found = left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(_best_documents, f"asked long, doc_id {kind}, score double")
    found = found.withColumn("score", F.round("score", 9))
    best = place(found, F.desc("score"), F.asc("doc_id"), by="asked").where("place <= 10")
    return asked.select("row_id", "asked").join(grown(best), "asked").select("row_id", "doc_id", "score", "place")


def _best_documents(asked, docs):
    """(asked, doc_id, score): of these documents the ten best of each set of tokens, ties by doc_id."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    docs = docs.take(pc.sort_indices(docs, sort_keys=[("doc_id", "ascending")], null_placement="at_start")).combine_chunks()
    ids, ts = docs.column("doc_id").combine_chunks(), docs.column("ts").combine_chunks()
    of = np.repeat(np.arange(len(ts)), np.diff(ts.offsets.to_numpy()))
    tokens, at = np.unique(ts.flatten().to_numpy(), return_inverse=True)
    order = np.argsort(at, kind="stable")
    bounds = np.searchsorted(at[order], np.arange(len(tokens) + 1))
    lists = {t: of[order[b:e]] for t, b, e in zip(tokens.tolist(), bounds[:-1].tolist(), bounds[1:].tolist())}

    score, out_a, out_d, out_s = np.zeros(len(ids)), [], [], []
    for a, terms, weights in zip(*(asked.column(c).to_pylist() for c in ("asked", "ts", "ws"))):
        met = [(lists[t], w) for t, w in zip(terms, weights) if t in lists]
        if not met:
            continue
        score[:] = 0.0
        for where, w in met:
            score[where] += w
        if min(w for _, w in met) > 0:
            some = np.flatnonzero(score)
        else:  # a token of every document weighs nothing, but its documents are found
            some = np.unique(np.concatenate([where for where, _ in met]))
        s = score[some]
        if len(s) > 10:
            near = np.flatnonzero(s >= np.partition(s, -10)[-10] - 2e-9)
            # As they are rounded, so they are tied; documents are in order.
            some, s = some[near], s[near]
            top = np.argsort(-np.floor(s * 1e9 + 0.5), kind="stable")[:10]
            some, s = some[top], s[top]
        out_a.append(np.full(len(some), a, np.int64))
        out_d.append(some)
        out_s.append(s)
    none = [np.zeros(0, np.int64)]
    return pa.table({"asked": np.concatenate(out_a or none), "doc_id": ids.take(pa.array(np.concatenate(out_d or none))), "score": np.concatenate(out_s or [np.zeros(0)])})


_G1 = f"""fused AS (
  SELECT qid, key, sum(s) + 0.08 * (count(*) - 1) + CASE WHEN bool_or(strong) THEN 0.02 ELSE 0 END
      + CASE WHEN min(r) <= 10 THEN 0.04 WHEN min(r) <= 20 THEN 0.025 WHEN min(r) <= 50 THEN 0.01 ELSE 0 END AS score0, count(*) AS sources, min(r) AS best_rank, min(t) AS t,
      string_agg(source, ',' ORDER BY source) AS names
  FROM (SELECT qid, key, source, min(rank) AS r, max(1.0 / log2(rank + 2)) AS s, bool_or({STRONG}) AS strong, min(lower(title)) AS t FROM cand GROUP BY qid, key, source) GROUP BY qid, key),
fused_ranked AS (SELECT qid, key, round(score0, 9) AS score, sources, best_rank, names, t, row_number() OVER (PARTITION BY qid ORDER BY round(score0, 9) DESC, sources DESC, best_rank, t, key) AS place FROM fused)"""


def fused(c: DataFrame, weights: dict[str, float] | None = None, keep: int = 200) -> DataFrame:
    """Multi-source fusion: (qid, key, score, sources, best_rank, names, place), at most ``keep`` a query."""
    w = by_source(weights or {}, 1.0)
    per = c.groupBy("qid", "key", "source").agg(
        F.min("rank").alias("r"), F.max(w / F.log2(F.col("rank") + 2)).alias("s"), F.bool_or(strong_id()).alias("strong"), F.min(F.lower("title")).alias("t"))
    best = F.min("r")
    bonus = F.when(best <= 10, 0.04).when(best <= 20, 0.025).when(best <= 50, 0.01).otherwise(0.0)
    a = per.groupBy("qid", "key").agg(
        F.round(F.sum("s") + 0.08 * (F.count("*") - 1) + F.when(F.bool_or("strong"), 0.02).otherwise(0.0) + bonus, 9).alias("score"),
        F.count("*").alias("sources"), best.alias("best_rank"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("names"), F.min("t").alias("t"))
    return place(a, F.desc("score"), F.desc("sources"), F.asc("best_rank"), F.asc("t"), F.asc("key")).where(F.col("place") <= keep)


@query("G01_source_fusion", f"WITH {CAND}, {_G1} SELECT qid, key, score, sources, best_rank, place FROM fused_ranked WHERE place <= 200")
def g01(spark, d):
    return fused(candidates(spark, d)).select("qid", "key", "score", "sources", "best_rank", "place")


@query("G01_fusion_counts", f"""WITH {CAND}, {_G1} SELECT qid, count(*) AS kept, count(*) FILTER (sources >= 2) AS multi, count(*) FILTER (names = 'openalex') AS only_openalex, count(*) FILTER (names = 'arxiv') AS only_arxiv FROM fused_ranked WHERE place <= 200 GROUP BY qid""")
def g01_counts(spark, d):
    return fused(candidates(spark, d)).groupBy("qid").agg(
        F.count("*").alias("kept"), F.count_if(F.col("sources") >= 2).alias("multi"), F.count_if(F.col("names") == "openalex").alias("only_openalex"),
        F.count_if(F.col("names") == "arxiv").alias("only_arxiv"))


_CONF = f"""m AS (
  SELECT qid, key, sum({case(_AW, 0.10)} / (rank + {case(_AO, 12)})) AS s0, count(*) AS occ, coalesce(min(rank) FILTER (source IN ('semantic_scholar', 'openalex')), {NEVER}) AS anchor,
    min(rank) AS best, bool_or(source = 'semantic_scholar') AS has_raw, bool_or(source = 'openalex') AS has_clean, bool_or({STRONG}) AS strong, min({norm('title')}) AS nt FROM cand GROUP BY qid, key),
conf AS (SELECT *, round(s0 + CASE WHEN occ >= 2 THEN 0.05 * (occ - 1) ELSE 0 END + CASE WHEN anchor <= 20 THEN 0.04 WHEN anchor <= 50 THEN 0.02 ELSE 0 END
    + CASE WHEN has_raw THEN 0.03 ELSE 0 END + CASE WHEN has_clean THEN 0.02 ELSE 0 END + CASE WHEN strong THEN 0.015 ELSE 0 END, 9) AS conf,
  occ >= 2 OR (anchor <= 50 AND (has_raw OR has_clean)) OR (s0 >= 0.025 AND strong) AS sure FROM m)"""


@query("G02_fallback_fusion", f"""WITH {CAND}, {_CONF},
base AS (SELECT qid, key, rank, rank <= 45 AS head FROM cand WHERE source = 'semantic_scholar'),
heads AS (SELECT DISTINCT qid, key FROM base WHERE head),
sup AS (SELECT DISTINCT ON (qid, key) qid, key, rank FROM cand WHERE source = 'openalex' ORDER BY qid, key, rank),
slots AS (SELECT s.qid, s.key, row_number() OVER (PARTITION BY s.qid ORDER BY c.conf DESC, c.anchor, c.best, c.nt, s.key) AS n
  FROM sup s JOIN conf c USING (qid, key) LEFT JOIN heads h USING (qid, key) WHERE h.key IS NULL AND c.sure),
tiers AS (SELECT qid, key, CASE WHEN head THEN 1 ELSE 3 END AS tier, rank AS n FROM base UNION ALL SELECT qid, key, 2, n FROM slots WHERE n <= 5 UNION ALL SELECT qid, key, 4, rank FROM sup),
firsts AS (SELECT qid, key, min((tier, n)) AS f FROM tiers GROUP BY qid, key)
SELECT * FROM (SELECT qid, key, CAST(f[1] AS INTEGER) AS tier, row_number() OVER (PARTITION BY qid ORDER BY f, key) AS place FROM firsts) WHERE place <= 100""")
def g02(spark, d):
    """Base top 45, up to five sure supplements, the rest of the base, the rest of the supplement; at most 100."""
    c = candidates(spark, d)
    least = F.coalesce(F.min(F.when(F.col("source").isin("semantic_scholar", "openalex"), F.col("rank"))), F.lit(NEVER))
    m = c.groupBy("qid", "key").agg(
        F.sum(by_source(_AW, 0.10) / (F.col("rank") + by_source(_AO, 12))).alias("s0"), F.count("*").alias("occ"), least.alias("anchor"), F.min("rank").alias("best"),
        F.bool_or(F.col("source") == "semantic_scholar").alias("has_raw"), F.bool_or(F.col("source") == "openalex").alias("has_clean"), F.bool_or(strong_id()).alias("strong"),
        F.min(ascii_words(F.col("title"))).alias("nt"))
    add = lambda cond, v: F.when(cond, v).otherwise(0.0)
    conf = F.col("s0") + add(F.col("occ") >= 2, 0.05 * (F.col("occ") - 1)) + F.when(F.col("anchor") <= 20, 0.04).when(F.col("anchor") <= 50, 0.02).otherwise(0.0)
    conf = F.round(conf + add(F.col("has_raw"), 0.03) + add(F.col("has_clean"), 0.02) + add(F.col("strong"), 0.015), 9)
    sure = (F.col("occ") >= 2) | ((F.col("anchor") <= 50) & (F.col("has_raw") | F.col("has_clean"))) | ((F.col("s0") >= 0.025) & F.col("strong"))
    base = c.where("source = 'semantic_scholar'").select("qid", "key", "rank", (F.col("rank") <= 45).alias("head"))
    sup = c.where("source = 'openalex'").groupBy("qid", "key").agg(F.min("rank").alias("rank"))
    open_ = sup.join(base.where("head").select("qid", "key"), ["qid", "key"], "left_anti").join(m.withColumn("conf", conf).where(sure), ["qid", "key"])
    slots = place(open_, F.desc("conf"), F.asc("anchor"), F.asc("best"), F.asc("nt"), F.asc("key"), name="n").where("n <= 5")
    tiers = (
        base.select("qid", "key", F.when(F.col("head"), 1).otherwise(3).alias("tier"), F.col("rank").alias("n"))
        .unionByName(slots.select("qid", "key", F.lit(2).alias("tier"), "n"))
        .unionByName(sup.select("qid", "key", F.lit(4).alias("tier"), F.col("rank").alias("n")))
    )
    firsts = tiers.groupBy("qid", "key").agg(F.min(F.struct("tier", "n")).alias("f"))
    return place(firsts, F.asc("f"), F.asc("key")).where("place <= 100").select("qid", "key", F.col("f.tier").alias("tier"), "place")


@query("G03_merged_metadata", f"""WITH {CAND}
SELECT qid, key, max(len(abstract)) AS abstract_chars, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM cand GROUP BY qid, key""")
def g03(spark, d):
    a = candidates(spark, d).groupBy("qid", "key").agg(F.max_by("abstract", F.length("abstract")).alias("a"), F.array_sort(F.collect_set("source")).alias("s"))
    return a.select("qid", "key", F.length("a").cast("bigint").alias("abstract_chars"), F.array_join("s", ",").alias("sources"))


@query("G04_weighted_fusion", f"""WITH {CAND}, p AS (
  SELECT qid, key, source, max(CASE source WHEN 'semantic_scholar' THEN 1.0 ELSE 1.15 END / log2(rank + 2)) AS s FROM cand GROUP BY ALL)
SELECT qid, key, round(sum(s), 9) AS score FROM p GROUP BY qid, key""")
def g04(spark, d):
    w = F.when(F.col("source") == "semantic_scholar", 1.0).otherwise(1.15)
    per = candidates(spark, d).groupBy("qid", "key", "source").agg(F.max(w / F.log2(F.col("rank") + 2)).alias("s"))
    return per.groupBy("qid", "key").agg(F.round(F.sum("s"), 9).alias("score"))


@query("D15_first_of_key", f"WITH {CAND} SELECT qid, source, key, min(rank) AS rank FROM cand GROUP BY ALL")
def d15(spark, d):
    first = Window.partitionBy("qid", "source", "key").orderBy("rank")
    return candidates(spark, d).withColumn("n", F.row_number().over(first)).where("n = 1").select("qid", "source", "key", F.col("rank").cast("bigint").alias("rank"))


@query("I12_top_k", f"WITH {CAND} SELECT qid, source, rank, key FROM cand WHERE rank <= 20")
def i12(spark, d):
    return candidates(spark, d).where("rank <= 20").select("qid", "source", F.col("rank").cast("bigint").alias("rank"), "key")


@query("C05_missing_queries", "SELECT DISTINCT qid FROM pasa_like_sample WHERE qid IS NOT NULL EXCEPT SELECT qid FROM predictions")
def c05(spark, d):
    return table(spark, d, "pasa_like_sample").where("qid is not null").select("qid").subtract(table(spark, d, "predictions").select("qid"))


@query("C04_stage_alignment", """WITH a AS (SELECT DISTINCT qid FROM pasa_like_sample WHERE qid IS NOT NULL), b AS (SELECT DISTINCT qid FROM predictions WHERE qid IS NOT NULL)
SELECT 'missing' AS side, a.qid FROM a ANTI JOIN b USING (qid) UNION ALL SELECT 'extra', b.qid FROM b ANTI JOIN a USING (qid)""")
def c04(spark, d):
    a = table(spark, d, "pasa_like_sample").where("qid is not null").select("qid").distinct()
    b = table(spark, d, "predictions").where("qid is not null").select("qid").distinct()
    return a.join(b, "qid", "left_anti").select(F.lit("missing").alias("side"), "qid").unionByName(b.join(a, "qid", "left_anti").select(F.lit("extra").alias("side"), "qid"))


@query("C06_source_difference", f"""WITH {CAND}, a AS (SELECT DISTINCT qid FROM cand WHERE source = 'arxiv'), b AS (SELECT DISTINCT qid FROM cand WHERE source = 'openalex')
(SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def c06(spark, d):
    c = candidates(spark, d)
    a, b = c.where("source = 'arxiv'").select("qid").distinct(), c.where("source = 'openalex'").select("qid").distinct()
    return a.exceptAll(b).unionByName(b.exceptAll(a))


@query("C07_target_replacement", f"""WITH {CAND}, b AS (SELECT * FROM cand WHERE source = 'semantic_scholar'), r AS (SELECT * FROM cand WHERE source = 'openalex' AND nsrc >= 3), t AS (SELECT DISTINCT qid FROM r)
SELECT qid, rank, key FROM b ANTI JOIN t USING (qid) WHERE rank <= 100 UNION ALL SELECT qid, rank, key FROM r WHERE rank <= 100""")
def c07(spark, d):
    c = candidates(spark, d)
    base, new = c.where("source = 'semantic_scholar'"), c.where("source = 'openalex' and nsrc >= 3")
    kept = base.join(new.select("qid").distinct(), "qid", "left_anti").unionByName(new)
    return kept.where("rank <= 100").select("qid", F.col("rank").cast("bigint").alias("rank"), "key")



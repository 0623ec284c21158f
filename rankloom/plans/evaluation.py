"""Matching of ranked lists with gold items, retrieval metrics, diagnosis and calibration.

Gold is read here only; no ranking plan imports this module.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.text import f1, letters_key, ratio
from rankloom.plans.inputs import ANSWERS, CAND, GOLD, candidates, gold, letters, table
from rankloom.plans.ranking import place
from rankloom.registry import query

KS = (20, 50, 100)
RANKED = f"""{CAND}, one AS (
  SELECT qid, key, max(score) AS score, min(title) AS title, max(nsrc) AS nsrc, min(rank) AS best FROM cand GROUP BY qid, key),
ranked AS (SELECT qid, key, score, title, nsrc, best, {letters('title')} AS tkey, row_number() OVER (PARTITION BY qid ORDER BY score DESC NULLS LAST, title, key) AS rank FROM one)"""
HITS = f"""{RANKED}, {GOLD},
pk AS (SELECT *, row_number() OVER (PARTITION BY qid, tkey ORDER BY rank) AS n FROM ranked WHERE tkey <> ''),
gk AS (SELECT *, row_number() OVER (PARTITION BY qid, tkey ORDER BY gold_index) AS n FROM gold),
hits AS (SELECT pk.qid, pk.rank, gk.gold_index FROM pk JOIN gk USING (qid, tkey, n))"""
PER = f"""{HITS}, pn AS (SELECT qid, count(*) AS predicted FROM ranked GROUP BY qid), gn AS (SELECT qid, count(*) AS gold_count FROM gold GROUP BY qid),
hn AS (SELECT qid, count(*) AS tp, min(rank) AS first_hit FROM hits GROUP BY qid),
per0 AS (SELECT qid, gold_count, coalesce(predicted, 0) AS predicted, coalesce(tp, 0) AS tp, first_hit FROM gn LEFT JOIN pn USING (qid) LEFT JOIN hn USING (qid)),
per1 AS (SELECT *, predicted - tp AS fp, gold_count - tp AS fn, CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END AS p, tp / gold_count AS r FROM per0),
per AS (SELECT *, CASE WHEN p + r > 0 THEN 2.0 * p * r / (p + r) ELSE 0.0 END AS f FROM per1)"""


def ranked(spark, d) -> DataFrame:
    """One list a query: (qid, key, score, title, nsrc, best, tkey, rank), best score first."""
    one = candidates(spark, d).groupBy("qid", "key").agg(
        F.max("score").alias("score"), F.min("title").alias("title"), F.max("nsrc").alias("nsrc"), F.min("rank").alias("best"))
    one = one.withColumn("tkey", letters_key(F.col("title")))
    return place(one, F.desc_nulls_last("score"), F.asc("title"), F.asc("key"), name="rank")


def title_hits(pred: DataFrame, golds: DataFrame) -> DataFrame:
    """(qid, rank, gold_index): the n-th prediction of a title meets its n-th gold item."""
    n = lambda o: F.row_number().over(Window.partitionBy("qid", "tkey").orderBy(o))
    a = pred.where("tkey <> ''").select("qid", "tkey", "rank", n("rank").alias("n"))
    return a.join(golds.select("qid", "tkey", "gold_index", n("gold_index").alias("n")), ["qid", "tkey", "n"]).select("qid", "rank", "gold_index")


def hits(spark, d) -> DataFrame:
    return title_hits(ranked(spark, d), gold(spark, d))


def per_query(spark, d) -> DataFrame:
    r, g = ranked(spark, d), gold(spark, d)
    h = title_hits(r, g).groupBy("qid").agg(F.count("*").alias("tp"), F.min("rank").alias("first_hit"))
    p = r.groupBy("qid").agg(F.count("*").alias("predicted"))
    out = g.groupBy("qid").agg(F.count("*").alias("gold_count")).join(p, "qid", "left").join(h, "qid", "left").fillna(0, ["predicted", "tp"])
    out = out.withColumn("fp", F.col("predicted") - F.col("tp")).withColumn("fn", F.col("gold_count") - F.col("tp"))
    out = out.withColumn("p", ratio(F.col("tp"), F.col("predicted"))).withColumn("r", ratio(F.col("tp"), F.col("gold_count")))
    return out.withColumn("f", f1(F.col("p"), F.col("r")))


def rnd(c: str | Column, name: str | None = None) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 9).alias(name or c)


@query("A02_gold_items", f"WITH {GOLD} SELECT qid, gold_index, title FROM gold")
def a02(spark, d):
    return gold(spark, d).select("qid", F.col("gold_index").cast("bigint").alias("gold_index"), "title")


@query("A03_prediction_items", f"WITH {CAND} SELECT qid, source, rank, title FROM cand")
def a03(spark, d):
    return candidates(spark, d).select("qid", "source", F.col("rank").cast("bigint").alias("rank"), "title")


@query("A04_first_record_wins", "SELECT qid, arg_min(question, pred_id) AS question FROM (SELECT DISTINCT pred_id, qid, question FROM predictions WHERE question IS NOT NULL) GROUP BY qid")
def a04(spark, d):
    return table(spark, d, "predictions").where("question is not null").groupBy("qid").agg(F.min_by("question", "pred_id").alias("question"))


@query("A05_last_record_wins", "SELECT qid, max(delivered_at) AS delivered_at, arg_max(pred_id, (delivered_at, pred_id)) AS pred_id FROM predictions WHERE delivered_at IS NOT NULL GROUP BY qid")
def a05(spark, d):
    p = table(spark, d, "predictions").where("delivered_at is not null")
    return p.groupBy("qid").agg(F.max("delivered_at").alias("delivered_at"), F.max_by("pred_id", F.struct("delivered_at", "pred_id")).alias("pred_id"))


@query("A06_gold_report", f"""WITH {ANSWERS}, n AS (SELECT row_id, count(*) AS titles, count(DISTINCT val) AS kinds FROM answers GROUP BY row_id)
SELECT count(*) AS rows, count(*) FILTER (p.qid IS NULL) AS no_qid, count(*) FILTER (n.titles IS NULL) AS no_title, coalesce(sum(titles - kinds), 0)::BIGINT AS repeated FROM pasa_like_sample p LEFT JOIN n USING (row_id)""")
def a06(spark, d):
    from rankloom.operators.nested import answer_titles

    p = table(spark, d, "pasa_like_sample")
    n = answer_titles(p).groupBy(F.col("parent_id").alias("row_id")).agg(F.count("*").alias("titles"), F.count_distinct("val").alias("kinds"))
    return p.join(n, "row_id", "left").agg(
        F.count("*").alias("rows"), F.count_if(F.col("qid").isNull()).alias("no_qid"), F.count_if(F.col("titles").isNull()).alias("no_title"),
        F.coalesce(F.sum(F.col("titles") - F.col("kinds")), F.lit(0)).alias("repeated"))


@query("D10_title_match", f"WITH {HITS} SELECT qid, rank, gold_index FROM hits")
def d10(spark, d):
    return hits(spark, d).select("qid", F.col("rank").cast("bigint").alias("rank"), F.col("gold_index").cast("bigint").alias("gold_index"))


@query("D13_identity_audit", f"""WITH {CAND}, n AS (SELECT qid, count(DISTINCT key) AS by_key, count(DISTINCT {letters('title')}) AS by_title, count(*) AS items FROM cand GROUP BY qid) SELECT * FROM n""")
def d13(spark, d):
    c = candidates(spark, d)
    return c.groupBy("qid").agg(F.count_distinct("key").alias("by_key"), F.count_distinct(letters_key(F.col("title"))).alias("by_title"), F.count("*").alias("items"))


@query("L01_per_query", f"WITH {PER} SELECT qid, gold_count, predicted, tp, fp, fn, round(p, 9) AS p, round(r, 9) AS r, round(f, 9) AS f FROM per")
def l01(spark, d):
    return per_query(spark, d).select("qid", "gold_count", "predicted", "tp", "fp", "fn", rnd("p"), rnd("r"), rnd("f"))


@query("L02_recall_at_k", f"""WITH {PER}, k AS (SELECT unnest([20, 50, 100]) AS k)
SELECT per.qid, k, round(count(h.rank) / any_value(gold_count), 9) AS recall FROM per CROSS JOIN k LEFT JOIN hits h ON h.qid = per.qid AND h.rank <= k GROUP BY per.qid, k""")
def l02(spark, d):
    """Every prefix is matched anew, as an earlier cut can free a gold item for a later title."""
    g = gold(spark, d)
    prefix = ranked(spark, d).withColumn("k", F.explode(F.array(*map(F.lit, KS)))).where(F.col("rank") <= F.col("k"))
    both = prefix.withColumn("qid", F.concat_ws("\x1f", "qid", "k"))
    goldk = g.withColumn("k", F.explode(F.array(*map(F.lit, KS))))
    h = title_hits(both, goldk.withColumn("qid", F.concat_ws("\x1f", "qid", "k"))).groupBy("qid").agg(F.count("*").alias("tp"))
    n = goldk.groupBy("qid", "k").agg(F.count("*").alias("n")).withColumn("id", F.concat_ws("\x1f", "qid", "k"))
    return n.join(h.withColumnRenamed("qid", "id"), "id", "left").select("qid", "k", rnd(ratio(F.coalesce("tp", F.lit(0)), F.col("n")), "recall"))


@query("L03_macro_micro", f"""WITH {PER}, s AS (SELECT count(*) AS queries, avg(p) AS mp, avg(r) AS mr, avg(f) AS macro_f1, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM per)
SELECT queries, round(mp, 9) AS macro_p, round(mr, 9) AS macro_r, round(macro_f1, 9) AS macro_f1, round(CASE WHEN mp + mr > 0 THEN 2 * mp * mr / (mp + mr) ELSE 0 END, 9) AS harmonic,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END, 9) AS micro_f1 FROM s""")
def l03(spark, d):
    s = per_query(spark, d).agg(F.count("*").alias("queries"), F.avg("p").alias("mp"), F.avg("r").alias("mr"), F.avg("f").alias("macro_f1"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    micro = ratio(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return s.select("queries", rnd("mp", "macro_p"), rnd("mr", "macro_r"), rnd("macro_f1"), rnd(f1(F.col("mp"), F.col("mr")), "harmonic"), rnd(micro, "micro_f1"))


_REL = f"""{PER}, rel AS (SELECT r.qid, r.rank, CASE WHEN h.rank IS NULL THEN 0 ELSE 1 END AS rel FROM ranked r LEFT JOIN hits h ON h.qid = r.qid AND h.rank = r.rank)"""


def labelled(spark, d) -> DataFrame:
    h = hits(spark, d).select("qid", "rank", F.lit(1).alias("rel"))
    return ranked(spark, d).join(h, ["qid", "rank"], "left").fillna(0, ["rel"])


@query("L05_ndcg_of_labels", f"""WITH {_REL}, a AS (SELECT qid, sum((pow(2, rel) - 1) / log2(rank + 1)) AS dcg FROM rel WHERE rank <= 10 GROUP BY qid),
i AS (SELECT qid, sum((pow(2, rel) - 1) / log2(n + 1)) AS ideal FROM (SELECT qid, rel, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, rank) AS n FROM rel) WHERE n <= 10 GROUP BY qid)
SELECT qid, round(CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0 END, 9) AS ndcg FROM a JOIN i USING (qid)""")
def l05(spark, d):
    r = place(labelled(spark, d), F.desc("rel"), F.asc("rank"), name="n")
    gain = lambda at: F.sum(F.when(F.col(at) <= 10, (F.pow(F.lit(2.0), "rel") - 1) / F.log2(F.col(at) + 1)).otherwise(0.0))
    return r.groupBy("qid").agg(gain("rank").alias("dcg"), gain("n").alias("ideal")).select("qid", rnd(ratio(F.col("dcg"), F.col("ideal")), "ndcg"))


@query("L06_ndcg_of_gold", f"""WITH {PER}, a AS (SELECT qid, sum(1 / log2(rank + 1)) AS dcg FROM hits WHERE rank <= 10 GROUP BY qid)
SELECT qid, round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(gold_count, 10) + 1), lambda x: 1 / log2(x + 1))), 9) AS ndcg FROM per LEFT JOIN a USING (qid)""")
def l06(spark, d):
    a = hits(spark, d).where("rank <= 10").groupBy("qid").agg(F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("gold_count"), F.lit(10)).cast("int")), F.lit(0.0), lambda s, x: s + 1 / F.log2(x + 1))
    return per_query(spark, d).join(a, "qid", "left").select("qid", rnd(F.coalesce("dcg", F.lit(0.0)) / ideal, "ndcg"))


@query("L07_zero_recall", f"WITH {PER} SELECT count(*) FILTER (tp = 0) AS zero, sum(tp)::BIGINT AS tp FROM per")
def l07(spark, d):
    return per_query(spark, d).agg(F.count_if(F.col("tp") == 0).alias("zero"), F.sum("tp").alias("tp"))


GRID = (1, 2, 3, 4, 5, 6, 8, 10, 12, 15, 20, 25, 30, 40, 50, 60, 80, 100)
_CURVE = f"""{PER}, k AS (SELECT unnest([{', '.join(map(str, GRID))}]) AS k),
at_k AS (SELECT per.qid, k, any_value(gold_count) AS g, least(any_value(predicted), k) AS n, count(h.rank) AS tp FROM per CROSS JOIN k LEFT JOIN hits h ON h.qid = per.qid AND h.rank <= k GROUP BY per.qid, k),
curve AS (SELECT *, CASE WHEN n + g > 0 THEN 2.0 * tp / (n + g) ELSE 0 END AS f FROM at_k)"""


def curve(spark, d) -> DataFrame:
    """(qid, k, f): F1 of every prefix length of the grid; the grid is small, so hits are counted in one aggregation."""
    h = hits(spark, d).groupBy("qid").agg(F.array_sort(F.collect_list("rank")).alias("hit_ranks"))
    p = per_query(spark, d).join(h, "qid", "left").withColumn("k", F.explode(F.array(*map(F.lit, GRID))))
    tp = F.size(F.filter(F.coalesce("hit_ranks", F.array().cast("array<int>")), lambda x: x <= F.col("k")))
    n = F.least("predicted", F.col("k"))
    return p.select("qid", "k", tp.alias("tp"), ratio(2.0 * tp, n + F.col("gold_count")).alias("f"))


def oracle(spark, d, most: int = 100) -> DataFrame:
    """(qid, best_k, best_f1) over every prefix length up to ``most``, the shortest of the best; 0 without predictions.

    Between two hits a longer prefix only loses, so the best one is 1 or ends at a hit.
    """
    h = hits(spark, d).where(F.col("rank") <= most).groupBy("qid").agg(F.array_sort(F.collect_list("rank")).alias("hit_ranks"))
    at = lambda r, i: F.struct(F.round(2.0 * (i + 1) / (r + F.col("gold_count")), 12).alias("f"), (-r).alias("k"))
    found = per_query(spark, d).join(h, "qid", "left").withColumn("best", F.array_max(F.transform("hit_ranks", at)))
    none = F.when(F.col("predicted") > 0, 1).otherwise(0)
    return found.select("qid", F.coalesce(-F.col("best.k"), none).alias("best_k"), F.round(F.coalesce("best.f", F.lit(0.0)), 9).alias("best_f1"))


@query("L11_run_log", """SELECT count(*) AS total, count(*) FILTER (event_type = 'error') AS failed, round(avg(value), 9) AS mean_ms, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS max_ms FROM events""")
def l11(spark, d):
    e = table(spark, d, "events")
    pct = lambda q: F.expr(f"percentile_disc({q}) within group (order by value)")
    return e.agg(F.count("*").alias("total"), F.count_if(F.col("event_type") == "error").alias("failed"), F.round(F.avg("value"), 9).alias("mean_ms"),
                 pct(0.5).alias("p50"), pct(0.95).alias("p95"), F.max("value").alias("max_ms"))


@query("L12_merged_stats", f"WITH {CAND} SELECT qid, count(*) AS hits, count(DISTINCT pred_id) AS pages, count(DISTINCT source) AS sources FROM cand GROUP BY qid")
def l12(spark, d):
    return candidates(spark, d).groupBy("qid").agg(F.count("*").alias("hits"), F.count_distinct("pred_id").alias("pages"), F.count_distinct("source").alias("sources"))


_BY_SOURCE = f"""{CAND}, {GOLD}, st AS (SELECT qid, source, rank, {letters('title')} AS tkey FROM cand),
sk AS (SELECT *, row_number() OVER (PARTITION BY qid, source, tkey ORDER BY rank) AS n FROM st),
sh AS (SELECT sk.qid, sk.source, sk.rank FROM sk JOIN gold USING (qid, tkey) WHERE sk.n = 1 AND tkey <> ''),
sq AS (SELECT source, g.qid, count(sh.rank) AS tp, min(sh.rank) AS best FROM (SELECT DISTINCT qid FROM gold) g CROSS JOIN (SELECT DISTINCT source FROM cand) s LEFT JOIN sh USING (qid, source) GROUP BY ALL)"""


def by_stage(spark, d) -> DataFrame:
    """(source, qid, tp, best): matched gold of every source as a stage of its own."""
    c, g = candidates(spark, d).withColumn("tkey", letters_key(F.col("title"))), gold(spark, d)
    first = Window.partitionBy("qid", "source", "tkey").orderBy("rank")
    h = c.where("tkey <> ''").withColumn("n", F.row_number().over(first)).where("n = 1").join(g.select("qid", "tkey"), ["qid", "tkey"])
    h = h.groupBy("qid", "source").agg(F.count("*").alias("tp"), F.min("rank").alias("best"))
    grid = g.select("qid").distinct().withColumn("source", F.explode(F.array(*map(F.lit, ("semantic_scholar", "openalex", "arxiv")))))
    return grid.join(h, ["qid", "source"], "left").fillna(0, ["tp"])


@query("L13_best_run", f"WITH {_BY_SOURCE} SELECT arg_max(source, (tp, source)) AS best_source, max(tp)::BIGINT AS tp FROM (SELECT source, sum(tp) AS tp FROM sq GROUP BY source)")
def l13(spark, d):
    s = by_stage(spark, d).groupBy("source").agg(F.sum("tp").alias("tp"))
    return s.agg(F.max_by("source", F.struct("tp", "source")).alias("best_source"), F.max("tp").alias("tp"))


@query("L14_baseline_deltas", f"""WITH {_BY_SOURCE}, w AS (SELECT qid, sum(tp) FILTER (source = 'semantic_scholar') AS a, sum(tp) FILTER (source = 'openalex') AS b FROM sq GROUP BY qid)
SELECT sum(b - a)::BIGINT AS delta, count(*) FILTER (b > a) AS better, count(*) FILTER (b < a) AS worse, bool_and(b >= a) AS adopt FROM w""")
def l14(spark, d):
    w = by_stage(spark, d).groupBy("qid").pivot("source", ["semantic_scholar", "openalex"]).agg(F.sum("tp"))
    diff = F.col("openalex") - F.col("semantic_scholar")
    return w.agg(F.sum(diff).alias("delta"), F.count_if(diff > 0).alias("better"), F.count_if(diff < 0).alias("worse"), F.bool_and(diff >= 0).alias("adopt"))


@query("L15_recovered_queries", f"""WITH {_BY_SOURCE}, w AS (SELECT qid, sum(tp) FILTER (source = 'semantic_scholar') AS a, sum(tp) FILTER (source = 'openalex') AS b FROM sq GROUP BY qid)
SELECT qid, CASE WHEN b > 0 THEN 'recovered' ELSE 'still_zero' END AS state FROM w WHERE a = 0""")
def l15(spark, d):
    w = by_stage(spark, d).groupBy("qid").pivot("source", ["semantic_scholar", "openalex"]).agg(F.sum("tp"))
    return w.where("semantic_scholar = 0").select("qid", F.when(F.col("openalex") > 0, "recovered").otherwise("still_zero").alias("state"))


@query("M01_stage_coverage", f"WITH {_BY_SOURCE} SELECT source, qid, tp, best FROM sq")
def m01(spark, d):
    return by_stage(spark, d).select("source", "qid", "tp", F.col("best").cast("bigint").alias("best"))


@query("M04_stage_summary", f"WITH {_BY_SOURCE} SELECT source, count(*) FILTER (tp > 0) AS queries_hit, sum(tp)::BIGINT AS tp, min(best) AS best FROM sq GROUP BY source")
def m04(spark, d):
    return by_stage(spark, d).groupBy("source").agg(F.count_if(F.col("tp") > 0).alias("queries_hit"), F.sum("tp").alias("tp"), F.min("best").cast("bigint").alias("best"))


@query("M05_query_lists", f"""WITH {PER} SELECT 'zero_recall' AS list, qid, row_number() OVER (ORDER BY gold_count DESC, qid) AS n FROM per WHERE tp = 0
UNION ALL SELECT 'late_recall', qid, row_number() OVER (ORDER BY first_hit DESC, qid) FROM per WHERE first_hit > 20
UNION ALL SELECT 'high_fp', qid, row_number() OVER (ORDER BY fp DESC, qid) FROM per WHERE fp >= 20""")
def m05(spark, d):
    p = per_query(spark, d).select("*", F.explode(F.array_compact(F.array(
        F.when(F.col("tp") == 0, F.struct(F.lit("zero_recall").alias("list"), F.col("gold_count").alias("by"))),
        F.when(F.col("first_hit") > 20, F.struct(F.lit("late_recall").alias("list"), F.col("first_hit").cast("bigint").alias("by"))),
        F.when(F.col("fp") >= 20, F.struct(F.lit("high_fp").alias("list"), F.col("fp").alias("by")))))).alias("l"))
    n = F.row_number().over(Window.partitionBy("l.list").orderBy(F.desc("l.by"), F.asc("qid")))
    return p.select(F.col("l.list").alias("list"), "qid", n.cast("bigint").alias("n"))


def numbered(rows: DataFrame, by: str) -> DataFrame:
    """Rows with ``n`` from 1 in the order of a unique column, without one task that sorts them all.

    A range partition is sorted by itself; its rows are numbered from the counts of the
    partitions before it, of which there are as many as partitions.
    """
    parts = rows.repartitionByRange(by).select("*", F.spark_partition_id().alias("part"))
    own = parts.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy(by)))
    counts = own.groupBy("part").agg(F.max("k").alias("size"))
    before = counts.withColumn("before", F.sum("size").over(Window.partitionBy(F.lit(1)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    numbered_ = own.join(F.broadcast(before), "part").withColumn("n", F.col("k") + F.coalesce("before", F.lit(0)))
    return numbered_.drop("part", "k", "size", "before")


def folds_by_order(qids: DataFrame, n: int = 5) -> DataFrame:
    """(qid, fold): queries dealt to folds in the order of their names."""
    return numbered(qids.select("qid"), "qid").select("qid", ((F.col("n") - 1) % n).alias("fold"))


@query("N01_folds", """WITH q AS (SELECT DISTINCT qid FROM predictions WHERE qid IS NOT NULL)
SELECT qid, (row_number() OVER (ORDER BY qid) - 1) % 5 AS by_order, (row_number() OVER (ORDER BY sha256(qid), qid) - 1) % 5 AS by_hash, CAST(('0x' || substr(sha256('13:' || qid), 1, 12)) AS BIGINT) % 5 AS by_seed FROM q""")
def n01(spark, d):
    q = table(spark, d, "predictions").where("qid is not null").select("qid").distinct()
    hashed = numbered(q.withColumn("h", F.concat(F.sha2("qid", 256), "qid")), "h").select("qid", ((F.col("n") - 1) % 5).cast("bigint").alias("by_hash"))
    seed = F.conv(F.substring(F.sha2(F.concat(F.lit("13:"), F.col("qid")), 256), 1, 12), 16, 10).cast("bigint") % 5
    return folds_by_order(q).join(hashed, "qid").select("qid", F.col("fold").cast("bigint").alias("by_order"), "by_hash", seed.alias("by_seed"))


BETAS = (0.0, 0.02, 0.04, 0.06, 0.08, 0.10)
_BLEND = f"""{_REL}, mm AS (SELECT qid, key, rank, best, coalesce(score, 0.0) AS s, min(coalesce(score, 0.0)) OVER (PARTITION BY qid) AS lo, max(coalesce(score, 0.0)) OVER (PARTITION BY qid) AS hi FROM ranked),
bl AS (SELECT mm.qid, key, mm.rank, rel, b AS beta, CASE WHEN b = 0 THEN -mm.rank::DOUBLE ELSE round((1 - b) * CASE WHEN hi > lo THEN (s - lo) / (hi - lo) ELSE 0 END + b / log2(best + 1), 12) END AS v
  FROM mm JOIN rel ON rel.qid = mm.qid AND rel.rank = mm.rank CROSS JOIN (SELECT unnest([{', '.join(map(str, BETAS))}])::DOUBLE AS b)),
br AS (SELECT *, row_number() OVER (PARTITION BY qid, beta ORDER BY v DESC, rank) AS n FROM bl)"""


def blended(spark, d) -> DataFrame:
    """(qid, key, rank, rel, beta, n): every list reordered for every blend of the grid in one pass."""
    w = Window.partitionBy("qid")
    s = F.coalesce("score", F.lit(0.0))
    r = labelled(spark, d).withColumn("lo", F.min(s).over(w)).withColumn("hi", F.max(s).over(w)).withColumn("beta", F.explode(F.array(*map(F.lit, BETAS))))
    norm = F.when(F.col("hi") > F.col("lo"), (s - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    v = F.when(F.col("beta") == 0, -F.col("rank").cast("double")).otherwise(F.round((1 - F.col("beta")) * norm + F.col("beta") / F.log2(F.col("best") + 1), 12))
    return r.withColumn("v", v).withColumn("n", F.row_number().over(Window.partitionBy("qid", "beta").orderBy(F.desc("v"), F.asc("rank"))))


@query("H08_protected_blend", f"WITH {_BLEND} SELECT qid, key, beta, n FROM br WHERE n <= 10")
def h08(spark, d):
    return blended(spark, d).where("n <= 10").select("qid", "key", "beta", F.col("n").cast("bigint").alias("n"))


@query("Q01_stage_matrix", f"WITH {_BY_SOURCE} SELECT qid, sum(tp) FILTER (source = 'semantic_scholar')::BIGINT AS semantic_scholar, sum(tp) FILTER (source = 'openalex')::BIGINT AS openalex, sum(tp) FILTER (source = 'arxiv')::BIGINT AS arxiv FROM sq GROUP BY qid")
def q01(spark, d):
    return by_stage(spark, d).groupBy("qid").pivot("source", ["semantic_scholar", "openalex", "arxiv"]).agg(F.sum("tp"))


@query("D08_greedy_match")
def d08(spark, d):
    """Two-phase greedy 1:1 matching in rank order: shared identifiers first, then equal titles without conflict.

    Records of papers_with_duplicates stand for the gold side. Only pairs that share an
    identifier or a title reach the fold, one small group a query.
    """
    from rankloom.functions import ident as I

    c = candidates(spark, d)
    pred = c.select("qid", "source", "rank", I.normalize_doi(F.col("doi")).alias("d"), I.extract_openalex(F.col("openalex_id")).alias("o"), letters_key(F.col("title")).alias("t"))
    rec = table(spark, d, "papers_with_duplicates").where("source = 'openalex'").select(
        "rec_id", I.normalize_doi(F.col("doi")).alias("gd"), I.extract_openalex(F.col("id")).alias("go"), letters_key(F.col("display_name")).alias("gt"))
    by_id = pred.join(rec, F.col("o") == F.col("go")).unionByName(pred.join(rec, F.col("d") == F.col("gd")))
    by_title = pred.where("t <> ''").join(rec, F.col("t") == F.col("gt")).where(~I.ids_conflict([F.col("d"), F.col("o")], [F.col("gd"), F.col("go")]))
    pairs = by_id.select("qid", "source", "rank", "rec_id", F.lit(1).alias("phase")).unionByName(by_title.select("qid", "source", "rank", "rec_id", F.lit(2).alias("phase")))
    return greedy_match(pairs.distinct(), ["qid", "source"])


def greedy_match(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by, rank, rec_id, phase): within phase 1, then 2, each rank takes its lowest free item."""
    listed = pairs.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("phase", "rank", "rec_id"))).alias("ps"))
    empty = F.array().cast("array<struct<phase:int,rank:int,rec_id:bigint>>")

    def take(acc: Column, x: Column) -> Column:
        free = ~F.exists(acc, lambda a: (a["rank"] == x["rank"]) | (a["rec_id"] == x["rec_id"]))
        return F.when(free, F.concat(acc, F.array(x))).otherwise(acc)

    return listed.select(*by, F.inline(F.aggregate("ps", empty, take)))

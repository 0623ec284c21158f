"""Cut-offs, failure diagnosis, ranking attribution and leakage-safe calibration.

These plans read gold; nothing that ranks imports them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.text import letters_key, ratio
from rankloom.plans.evaluation import _BLEND, _REL, BETAS, GRID, HITS, PER, RANKED, blended, hits, labelled, oracle, per_query, ranked, title_hits
from rankloom.plans.inputs import GOLD, candidates, gold, letters, table
from rankloom.plans.planner import _AN, anchored
from rankloom.plans.ranking import place
from rankloom.plans.rerank import _GA, _Q as _ASKED, _QQ, _QUALITY, READ, b3_score, evidence_quality, guard_aware, read, total_of, _B3S, _W
from rankloom.plans.scalars import questions
from rankloom.registry import query
from rankloom.scratch import stage

_G = ", ".join(map(str, GRID))
_BEHIND = _REL.split(RANKED + ", ")[1]  # gold, hits, per and rel, after a ranked list

# ---- L08..L10, Q09: cut-offs

_RAW = f"""{RANKED}, {GOLD}, it AS (SELECT qid, key, {letters('title')} AS tkey, row_number() OVER (PARTITION BY qid ORDER BY score DESC NULLS LAST, title, key, pred_id, item_pos) AS at_ FROM cand),
fk AS (SELECT qid, key, min(at_) AS rank, arg_min(tkey, at_) AS tkey FROM it GROUP BY qid, key), fn_ AS (SELECT *, row_number() OVER (PARTITION BY qid, tkey ORDER BY rank) AS n FROM fk WHERE tkey <> ''),
rh AS (SELECT f.qid, f.rank FROM fn_ f JOIN gold g ON g.qid = f.qid AND g.tkey = f.tkey WHERE f.n = 1),
rc AS (SELECT g.qid, k, any_value(g.gc) AS g, (SELECT count(*) FROM fk WHERE fk.qid = g.qid AND fk.rank <= k) AS n, (SELECT count(*) FROM rh WHERE rh.qid = g.qid AND rh.rank <= k) AS tp FROM (SELECT qid, count(*) AS gc FROM gold GROUP BY qid) g CROSS JOIN (SELECT unnest([{_G}]) AS k) GROUP BY g.qid, k),
rcurve AS (SELECT *, CASE WHEN n + g > 0 THEN 2.0 * tp / (n + g) ELSE 0 END AS f FROM rc)"""


def raw_curve(spark, d) -> DataFrame:
    """(qid, k, tp, f): every list cut at each length of the grid as it was delivered, repeated papers and all, and made distinct after that."""
    c = candidates(spark, d)
    at = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc_nulls_last("score"), "title", "key", "pred_id", "item_pos"))
    first = c.select("qid", "key", letters_key(F.col("title")).alias("tkey"), at.alias("at")).groupBy("qid", "key").agg(F.min("at").alias("rank"), F.min_by("tkey", "at").alias("tkey"))
    g = gold(spark, d)
    hit = title_hits(first, g).groupBy("qid").agg(F.array_sort(F.collect_list("rank")).alias("hit_ranks"))
    shown = first.where(F.col("rank") <= max(GRID)).groupBy("qid").agg(F.array_sort(F.collect_list("rank")).alias("ranks"))
    none = F.array().cast("array<int>")
    q = g.groupBy("qid").agg(F.count("*").alias("gold_count")).join(shown, "qid", "left").join(hit, "qid", "left").withColumn("k", F.explode(F.array(*map(F.lit, GRID))))
    upto = lambda c: F.size(F.filter(F.coalesce(c, none), lambda x: x <= F.col("k")))
    q = q.select("qid", "k", "gold_count", upto("hit_ranks").alias("tp"), upto("ranks").alias("n"))
    return q.select("qid", "k", "tp", ratio(2.0 * F.col("tp"), F.col("n") + F.col("gold_count")).alias("f"))


@query("L08_fixed_k_curve", f"WITH {_RAW} SELECT k, round(avg(f), 9) AS macro_f1, sum(tp)::BIGINT AS tp FROM rcurve GROUP BY k")
def l08(spark, d):
    return raw_curve(spark, d).groupBy("k").agg(F.round(F.avg("f"), 9).alias("macro_f1"), F.sum("tp").cast("bigint").alias("tp"))


_OR = f"""{PER}, o0 AS (SELECT per.qid, k, gold_count, predicted, count(h.rank) AS tp FROM per CROSS JOIN (SELECT unnest(range(1, 101)) AS k) LEFT JOIN hits h ON h.qid = per.qid AND h.rank <= k WHERE k <= predicted GROUP BY ALL),
o1 AS (SELECT qid, arg_max(k, (round(2.0 * tp / (k + gold_count), 12), -k)) AS best_k, max(round(2.0 * tp / (k + gold_count), 12)) AS best_f1 FROM o0 GROUP BY qid),
orc AS (SELECT per.qid, coalesce(best_k, 0) AS best_k, coalesce(best_f1, 0.0) AS best_f1 FROM per LEFT JOIN o1 USING (qid))"""


@query("L09_oracle_k", f"WITH {_OR} SELECT qid, CAST(best_k AS INTEGER) AS best_k, round(best_f1, 9) AS best_f1 FROM orc")
def l09(spark, d):
    """The best of every cut-off up to 100 of the distinct list, the shortest of the best."""
    return oracle(spark, d)


_BUCKETS = "CASE WHEN best_k <= 5 THEN '1-5' WHEN best_k <= 10 THEN '6-10' WHEN best_k <= 20 THEN '11-20' WHEN best_k <= 50 THEN '21-50' ELSE '51-100' END"


@query("L10_best_fixed_k", f"""WITH {_RAW}, m AS (SELECT k, avg(f) AS f FROM rcurve GROUP BY k), {_OR.split(GOLD + ',')[1].strip()},
b AS (SELECT {_BUCKETS} AS bucket, count(*) AS n FROM orc GROUP BY 1)
SELECT (SELECT arg_max(k, (round(f, 12), -k)) FROM m) AS fixed_k, (SELECT round(max(f), 9) FROM m) AS fixed_f1, min(best_k) AS min_k, median(best_k) AS median_k, round(avg(best_k), 9) AS mean_k, max(best_k) AS max_k, round(avg(best_f1), 9) AS oracle_f1,
  (SELECT list(bucket || '=' || n ORDER BY bucket) FROM b) AS buckets FROM orc""")
def l10(spark, d):
    m = raw_curve(spark, d).groupBy("k").agg(F.avg("f").alias("f")).agg(F.max_by("k", F.struct(F.round("f", 12), -F.col("k"))).cast("bigint").alias("fixed_k"), F.round(F.max("f"), 9).alias("fixed_f1"))
    k = F.col("best_k")
    o = oracle(spark, d).withColumn("bucket", F.when(k <= 5, "1-5").when(k <= 10, "6-10").when(k <= 20, "11-20").when(k <= 50, "21-50").otherwise("51-100"))
    n = o.groupBy("bucket").agg(F.count("*").alias("n")).agg(F.array_sort(F.collect_list(F.concat("bucket", F.lit("="), "n"))).alias("buckets"))
    s = o.agg(F.min(k).cast("bigint").alias("min_k"), F.median(k).alias("median_k"), F.round(F.avg(k), 9).alias("mean_k"), F.max(k).cast("bigint").alias("max_k"), F.round(F.avg("best_f1"), 9).alias("oracle_f1"))
    return m.join(F.broadcast(s)).join(F.broadcast(n))


@query("Q09_metric_bundle", f"""WITH {_RAW} SELECT round(avg(f) FILTER (k = 5), 9) AS f1_5, round(avg(f) FILTER (k = 20), 9) AS f1_20, sum(tp) FILTER (k = 100)::BIGINT AS tp_100, count(*) FILTER (k = 100 AND tp = 0) AS zero FROM rcurve""")
def q09(spark, d):
    at = lambda k, c: F.when(F.col("k") == k, c)
    return raw_curve(spark, d).agg(F.round(F.avg(at(5, F.col("f"))), 9).alias("f1_5"), F.round(F.avg(at(20, F.col("f"))), 9).alias("f1_20"),
                                   F.sum(at(100, F.col("tp"))).cast("bigint").alias("tp_100"), F.count_if((F.col("k") == 100) & (F.col("tp") == 0)).alias("zero"))


# ---- M02, M03, M14: where a query's gold was lost

#: Stage at which each target's list stands, in the order of the pipeline.
TARGETS = ("top20", "top50", "top100", "guard", "selector", "guard_aware")
_FAIL = """CASE WHEN hit THEN 'success' WHEN target IN ('guard', 'selector', 'guard_aware') AND top100 THEN target || '_drop' WHEN pool AND target NOT IN ('guard', 'selector', 'guard_aware') THEN 'ranking_loss_' || target WHEN pool THEN 'ranking_loss_top100' WHEN retrieved THEN 'fusion_pool_miss' ELSE 'retrieval_miss' END"""


def stages(spark, d) -> DataFrame:
    """(qid, target, hit, pool, retrieved, top100): whether gold is in the lists of each target, in the pool, and in any source."""
    rel = labelled(spark, d).where("rel = 1").select("qid", "rank", "key")
    aware = guard_aware(spark, d, "precision").select("qid", "key", (F.col("decision") != "reject").alias("g"), F.col("label").isin("highly_relevant", "partially_relevant", "weakly_relevant").alias("s"), F.col("verdict").isin("strong_keep", "keep").alias("w"))
    hit = rel.join(aware, ["qid", "key"], "left").groupBy("qid").agg(
        *(F.max(F.when(F.col("rank") <= k, True)).alias(f"top{k}") for k in (20, 50, 100)), *(F.max(F.when((F.col("rank") <= 100) & F.col(c), True)).alias(t) for t, c in (("guard", "g"), ("selector", "s"), ("guard_aware", "w"))),
        F.lit(True).alias("pool"))
    # Any source's own list, before the lists were made one.
    c = candidates(spark, d).select("qid", letters_key(F.col("title")).alias("tkey")).where("tkey <> ''").distinct()
    found = c.join(gold(spark, d).select("qid", "tkey"), ["qid", "tkey"]).select("qid").distinct().withColumn("retrieved", F.lit(True))
    q = gold(spark, d).select("qid").distinct().join(hit, "qid", "left").join(found, "qid", "left").fillna(False)
    cells = F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).alias("hit")) for t in TARGETS])
    return q.select("qid", "pool", "retrieved", "top100", F.inline(cells))


def failure() -> Column:
    late = F.col("target").isin("guard", "selector", "guard_aware")
    return (F.when(F.col("hit"), "success").when(late & F.col("top100"), F.concat("target", F.lit("_drop"))).when(F.col("pool") & ~late, F.concat(F.lit("ranking_loss_"), "target"))
            .when(F.col("pool"), "ranking_loss_top100").when(F.col("retrieved"), "fusion_pool_miss").otherwise("retrieval_miss"))


_STAGES = f"""{_GA.replace("p.* FROM gj g CROSS JOIN", "p.* FROM gj g CROSS JOIN")}, {_BEHIND}, aw AS (SELECT qid, key, decision <> 'reject' AS g, label <> 'low_relevance' AS s, verdict IN ('strong_keep', 'keep') AS w FROM ga WHERE mode = 'precision'),
sh AS (SELECT r.qid, bool_or(r.rank <= 20) AS top20, bool_or(r.rank <= 50) AS top50, bool_or(r.rank <= 100) AS top100, bool_or(r.rank <= 100 AND g) AS guard, bool_or(r.rank <= 100 AND s) AS selector, bool_or(r.rank <= 100 AND w) AS guard_aware FROM rel JOIN ranked r USING (qid, rank) LEFT JOIN aw ON aw.qid = r.qid AND aw.key = r.key WHERE rel.rel = 1 GROUP BY r.qid),
sr AS (SELECT DISTINCT c.qid FROM (SELECT qid, {letters('title')} AS tkey FROM cand) c JOIN gold USING (qid, tkey) WHERE tkey <> ''),
st AS (SELECT g.qid, sh.qid IS NOT NULL AS pool, sr.qid IS NOT NULL AS retrieved, coalesce(top20, false) AS top20, coalesce(top50, false) AS top50, coalesce(top100, false) AS top100, coalesce(guard, false) AS guard, coalesce(selector, false) AS selector, coalesce(guard_aware, false) AS guard_aware FROM (SELECT DISTINCT qid FROM gold) g LEFT JOIN sh USING (qid) LEFT JOIN sr USING (qid)),
su AS ({' UNION ALL '.join(f"SELECT qid, pool, retrieved, top100, '{t}' AS target, {t} AS hit FROM st" for t in TARGETS)}), sf AS (SELECT qid, target, {_FAIL} AS failure FROM su)"""


@query("M02_failure_taxonomy", f"WITH {_STAGES} SELECT qid, target, failure FROM sf")
def m02(spark, d):
    return stages(spark, d).select("qid", "target", failure().alias("failure"))


@query("M02_failures_with_near_matches")
def m02_near(spark, d):
    """The same, a failure being a possible matching issue where an unmatched title is nearly that of an unmatched gold item (D12)."""
    from rankloom.plans.extra import d12

    near = d12(spark, d).select("qid").distinct().withColumn("near", F.lit(True))
    f = stages(spark, d).join(near, "qid", "left")
    return f.select("qid", "target", F.when(~F.col("hit") & F.coalesce("near", F.lit(False)), "possible_matching_issue").otherwise(failure()).alias("failure"))


# Kinds of anchors that a rescue can build on, and what is advised for each failure.
ENTITIES = ("benchmark", "method", "model", "paper_title", "named_entity")
ADVICE = {
    "ranking_loss": ("inspect B4 semantic reranking features and score components", "increase exact title/entity anchor weight without adding API calls", "compare the gold candidate rank before and after semantic reranking"),
    "fusion_pool_miss": ("inspect candidate identity normalization during B4 fusion", "check source caps and fusion truncation", "verify that a correct upstream candidate was not removed as a duplicate"),
    "drop": ("compare the paper before and after filtering", "inspect relevance labels and hard-constraint evidence", "add a regression case before changing selector or guard thresholds"),
    "entity": ("build anchor-aware rescue queries from explicit academic entities",), "comparison": ("convert comparison relations into paired benchmark or method queries",),
    "negative": ("apply negative constraints after recall rather than inside broad retrieval",),
    "rest": ("generate at most two targeted rescue queries for this query", "consider controlled citation expansion only from a high-confidence seed"),
}


@query("M03_actions", f"""WITH {_STAGES}, {_AN.replace(_ASKED, _QQ).replace('q AS (SELECT qid AS row_id', 'qz AS (SELECT qid AS row_id').replace('FROM q)', 'FROM qz)')}, kinds AS (SELECT row_id AS qid, list(DISTINCT kind) AS kinds FROM an GROUP BY 1),
f AS (SELECT sf.qid, failure, coalesce(kinds, []) AS kinds, len(list_intersect(coalesce(kinds, []), {list(ENTITIES)})) > 0 AS named FROM sf LEFT JOIN kinds USING (qid) WHERE target = 'top100')
SELECT qid, CASE WHEN starts_with(failure, 'ranking_loss') THEN 'P0' WHEN failure = 'retrieval_miss' AND named THEN 'P1' WHEN failure IN ('fusion_pool_miss', 'guard_drop', 'selector_drop', 'guard_aware_drop') THEN 'P2' ELSE 'P3' END AS priority,
  CASE WHEN starts_with(failure, 'ranking_loss') THEN {list(ADVICE['ranking_loss'])} WHEN failure = 'fusion_pool_miss' THEN {list(ADVICE['fusion_pool_miss'])} WHEN ends_with(failure, '_drop') THEN {list(ADVICE['drop'])}
  ELSE list_concat(list_concat(list_concat(CASE WHEN named THEN {list(ADVICE['entity'])} ELSE [] END, CASE WHEN list_contains(kinds, 'comparison') THEN {list(ADVICE['comparison'])} ELSE [] END), CASE WHEN list_contains(kinds, 'negative_constraint') THEN {list(ADVICE['negative'])} ELSE [] END), {list(ADVICE['rest'])}) END AS actions FROM f""")
def m03(spark, d):
    """Priority and advice for each query, from its failure at the first hundred and the anchors of its question."""
    asked = questions(spark, d).withColumnRenamed("qid", "row_id")
    kinds = anchored(asked).select(F.col("row_id").alias("qid"), F.array_distinct(F.transform("anchors", lambda a: a["kind"])).alias("kinds"))
    f = stages(spark, d).where("target = 'top100'").select("qid", failure().alias("f")).join(kinds, "qid", "left").withColumn("kinds", F.coalesce("kinds", F.array().cast("array<string>")))
    named = F.arrays_overlap("kinds", F.array(*map(F.lit, ENTITIES)))
    texts = lambda k: F.array(*map(F.lit, ADVICE[k]))
    when = lambda c, k: F.when(c, texts(k)).otherwise(F.array().cast("array<string>"))
    loss, drop = F.col("f").startswith("ranking_loss"), F.col("f").endswith("_drop")
    rest = F.concat(when(named, "entity"), when(F.array_contains("kinds", "comparison"), "comparison"), when(F.array_contains("kinds", "negative_constraint"), "negative"), texts("rest"))
    actions = F.when(loss, texts("ranking_loss")).when(F.col("f") == "fusion_pool_miss", texts("fusion_pool_miss")).when(drop, texts("drop")).otherwise(rest)
    priority = F.when(loss, "P0").when((F.col("f") == "retrieval_miss") & named, "P1").when((F.col("f") == "fusion_pool_miss") | drop, "P2").otherwise("P3")
    return f.select("qid", priority.alias("priority"), actions.alias("actions"))


_KIND = "CASE WHEN failure = 'success' THEN 'success' WHEN failure = 'retrieval_miss' THEN 'retrieval' WHEN failure = 'fusion_pool_miss' THEN 'fusion' WHEN starts_with(failure, 'ranking_loss') THEN 'ranking' WHEN ends_with(failure, '_drop') THEN 'post_ranking_filter' ELSE 'other' END"


@query("M14_recovery_rollup", f"""WITH {_STAGES}, k AS (SELECT qid, target, {_KIND} AS family FROM sf), t AS (SELECT target, family, count(*) AS queries FROM k GROUP BY ALL), a AS (SELECT qid, max(family) FILTER (target = 'top20') AS f20, max(family) FILTER (target = 'top100') AS f100 FROM k GROUP BY qid)
SELECT target, family, queries, round(queries / sum(queries) OVER (PARTITION BY target), 9) AS share FROM t
UNION ALL SELECT 'recovery', CASE WHEN f100 = 'success' THEN 'recovered' ELSE 'still_missing' END, count(*), round(count(*) / sum(count(*)) OVER (), 9) FROM a WHERE f20 <> 'success' GROUP BY 2""")
def m14(spark, d):
    """Families of failures at every target with their shares, and how many of those lost at 20 are there at 100."""
    f = F.col("failure")
    family = (F.when(f == "success", "success").when(f == "retrieval_miss", "retrieval").when(f == "fusion_pool_miss", "fusion").when(f.startswith("ranking_loss"), "ranking")
              .when(f.endswith("_drop"), "post_ranking_filter").otherwise("other"))
    k = m02(spark, d).select("qid", "target", family.alias("family"))
    share = lambda df, by: df.withColumn("share", F.round(F.col("queries") / F.sum("queries").over(Window.partitionBy(by)), 9))
    t = share(k.groupBy("target", "family").agg(F.count("*").alias("queries")), "target")
    at = lambda x: F.max(F.when(F.col("target") == x, F.col("family")))
    a = k.groupBy("qid").agg(at("top20").alias("f20"), at("top100").alias("f100")).where("f20 <> 'success'")
    r = a.groupBy(F.lit("recovery").alias("target"), F.when(F.col("f100") == "success", "recovered").otherwise("still_missing").alias("family")).agg(F.count("*").alias("queries"))
    return t.unionByName(share(r, "target")).select("target", "family", "queries", "share")


# ---- M06..M08


@query("M06_samples", f"""WITH {HITS}, fp AS (SELECT 'false_positive' AS what, r.qid, r.rank AS at_, r.title, row_number() OVER (PARTITION BY r.qid ORDER BY r.rank) AS n FROM ranked r ANTI JOIN hits h ON h.qid = r.qid AND h.rank = r.rank WHERE r.qid IN (SELECT qid FROM gold)),
fn AS (SELECT 'false_negative' AS what, g.qid, g.gold_index AS at_, g.title, row_number() OVER (PARTITION BY g.qid ORDER BY g.gold_index) AS n FROM gold g ANTI JOIN hits h ON h.qid = g.qid AND h.gold_index = g.gold_index)
SELECT what, qid, at_ AS place, title FROM (SELECT * FROM fp UNION ALL SELECT * FROM fn) WHERE n <= 5""")
def m06(spark, d):
    """The first five wrong results and the first five missed items of every query."""
    g, h = gold(spark, d), hits(spark, d)
    fp = ranked(spark, d).join(g.select("qid").distinct(), "qid", "left_semi").join(h.select("qid", "rank"), ["qid", "rank"], "left_anti").select(F.lit("false_positive").alias("what"), "qid", F.col("rank").cast("bigint").alias("place"), "title")
    fn = g.join(h.select("qid", "gold_index"), ["qid", "gold_index"], "left_anti").select(F.lit("false_negative").alias("what"), "qid", F.col("gold_index").cast("bigint").alias("place"), "title")
    n = F.row_number().over(Window.partitionBy("what", "qid").orderBy("place"))
    return fp.unionByName(fn).withColumn("n", n).where("n <= 5").drop("n")


@query("M06_rank_histogram", f"WITH {HITS} SELECT CASE WHEN rank <= 10 THEN '1-10' WHEN rank <= 20 THEN '11-20' WHEN rank <= 50 THEN '21-50' WHEN rank <= 100 THEN '51-100' ELSE '>100' END AS bucket, count(*) AS matches FROM hits GROUP BY 1")
def m06_histogram(spark, d):
    r = F.col("rank")
    bucket = F.when(r <= 10, "1-10").when(r <= 20, "11-20").when(r <= 50, "21-50").when(r <= 100, "51-100").otherwise(">100")
    return hits(spark, d).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("matches"))


# The fixed cut-off, the shallow one, and the gap that counts as none; what each family leaves to gain.
FIXED_K, SHALLOW_K, EPSILON = 5, 20, 0.02
SOURCE = {"retrieval_ceiling": "retrieval", "deep_ranked_hit": "ranking", "mid_ranked_hit": "ranking", "cutoff_mismatch": "selection", "already_good": "freeze"}
_FAM = f"""{_OR}, hr AS (SELECT qid, list(rank ORDER BY rank) AS rs FROM hits GROUP BY qid),
f0 AS (SELECT per.qid, gold_count, first_hit, coalesce(rs, []) AS rs, best_k, best_f1 FROM per JOIN orc USING (qid) LEFT JOIN hr USING (qid)),
f1_ AS (SELECT *, len(list_filter(rs, lambda x: x <= 5)) AS tp5, len(list_filter(rs, lambda x: x <= 20)) AS tp20, len(list_filter(rs, lambda x: x <= 100)) AS tp100 FROM f0),
f2_ AS (SELECT *, round(2.0 * tp5 / ({FIXED_K} + gold_count), 9) AS fixed_f1, round(2.0 * tp20 / ({SHALLOW_K} + gold_count), 9) AS top20_f1 FROM f1_),
fam0 AS (SELECT *, round(best_f1 - fixed_f1, 9) AS gap, CASE WHEN first_hit IS NULL OR first_hit > 100 THEN 'retrieval_ceiling' WHEN first_hit > {SHALLOW_K} THEN 'deep_ranked_hit' WHEN first_hit > {FIXED_K} THEN 'mid_ranked_hit' WHEN round(best_f1 - fixed_f1, 9) <= {EPSILON} THEN 'already_good' ELSE 'cutoff_mismatch' END AS family FROM f2_),
fam AS (SELECT *, CASE family {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in SOURCE.items())} END AS source FROM fam0)"""


def families(spark, d) -> DataFrame:
    """One row a query: hits at the cut-offs, F1 at the fixed ones and at the best, and what kind of loss that is."""
    rs = hits(spark, d).groupBy("qid").agg(F.array_sort(F.collect_list("rank")).alias("rs"))
    p = per_query(spark, d).select("qid", "gold_count", "first_hit").join(oracle(spark, d), "qid").join(rs, "qid", "left")
    tp = lambda k: F.size(F.filter(F.coalesce("rs", F.array().cast("array<int>")), lambda x: x <= k))
    p = p.select("*", tp(5).alias("tp5"), tp(20).alias("tp20"), tp(100).alias("tp100"))
    at = lambda c, k: F.round(2.0 * F.col(c) / (k + F.col("gold_count")), 9)
    p = p.select("*", at("tp5", FIXED_K).alias("fixed_f1"), at("tp20", SHALLOW_K).alias("top20_f1"))
    h, gap = F.col("first_hit"), F.round(F.col("best_f1") - F.col("fixed_f1"), 9)
    fam = (F.when(h.isNull() | (h > 100), "retrieval_ceiling").when(h > SHALLOW_K, "deep_ranked_hit").when(h > FIXED_K, "mid_ranked_hit").when(gap <= EPSILON, "already_good").otherwise("cutoff_mismatch"))
    p = p.select("*", gap.alias("gap"), fam.alias("family"))
    return p.withColumn("source", F.create_map(*[F.lit(x) for kv in SOURCE.items() for x in kv])[F.col("family")])


@query("M07_failure_family", f"WITH {_FAM} SELECT qid, gold_count, tp5, tp20, tp100, fixed_f1, top20_f1, CAST(best_k AS INTEGER) AS best_k, round(best_f1, 9) AS best_f1, gap, family, source FROM fam")
def m07(spark, d):
    f = families(spark, d)
    return f.select("qid", "gold_count", *(F.col(c).cast("bigint").alias(c) for c in ("tp5", "tp20", "tp100")), "fixed_f1", "top20_f1", "best_k", "best_f1", "gap", "family", "source")


@query("M08_family_summary", f"WITH {_FAM} SELECT family, source, count(*) AS queries, round(sum(gap), 9) AS gap, round(avg(gap), 9) AS mean_gap, round(avg(gold_count), 9) AS mean_gold, round(count(*) / (SELECT count(*) FROM fam), 9) AS share, round(sum(gap) / (SELECT count(*) FROM fam), 9) AS contribution FROM fam GROUP BY family, source")
def m08(spark, d):
    g = families(spark, d).groupBy("family", "source").agg(F.count("*").alias("queries"), F.sum("gap").alias("g"), F.round(F.avg("gap"), 9).alias("mean_gap"), F.round(F.avg("gold_count"), 9).alias("mean_gold"))
    total = F.sum("queries").over(Window.partitionBy(F.lit(1)))  # five rows
    return g.select("family", "source", "queries", F.round("g", 9).alias("gap"), "mean_gap", "mean_gold", F.round(F.col("queries") / total, 9).alias("share"), F.round(F.col("g") / total, 9).alias("contribution"))


@query("M08_priority_queries", f"WITH {_FAM} SELECT qid, family, n FROM (SELECT qid, family, row_number() OVER (ORDER BY CASE WHEN family = 'retrieval_ceiling' THEN 2 ELSE 1 END DESC, CASE WHEN family = 'retrieval_ceiling' THEN gold_count ELSE gap END DESC, CASE WHEN family = 'retrieval_ceiling' THEN 0 ELSE tp100 END DESC, qid DESC) AS n FROM fam) WHERE n <= 15")
def m08_priority(spark, d):
    """The fifteen queries to look at first: what was never retrieved by its gold, the rest by what the best cut-off would gain."""
    lost = F.col("family") == "retrieval_ceiling"
    keys = [F.when(lost, 2).otherwise(1), F.when(lost, F.col("gold_count").cast("double")).otherwise(F.col("gap")), F.when(lost, 0).otherwise(F.col("tp100")), F.col("qid")]
    top = families(spark, d).select("qid", "family", *(k.alias(f"k{i}") for i, k in enumerate(keys))).orderBy(*(F.desc(f"k{i}") for i in range(4))).limit(15)
    return top.select("qid", "family", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*(F.desc(f"k{i}") for i in range(4)))).alias("n"))


# ---- M09..M12: which features would have moved a hit up

#: Feature of a candidate, and whether more of it is better.
FEATURES = (
    ("day8_final_score", True), ("query_overlap", True), ("expanded_query_overlap", True), ("title_overlap", True), ("abstract_signal", True), ("canonical_constraint_coverage", True), ("raw_constraint_coverage", True),
    ("b3_semantic_score", True), ("b3_final_score", True), ("b4_pre_rerank_score", True), ("b4_source_count", True), ("b4_best_source_rank", False), ("evidence_match_rate", True), ("evidence_mean_confidence", True),
)
_FSQL = ("pure", "qo", "eo", "tov", "abs", "cov", "cov1", "semantic", _B3S("semantic_first"), "coalesce(score, 0)", "coalesce(nsrc, 0)", "-coalesce(best, 999)", "CASE WHEN len(ev) > 0 THEN len(hit) / len(ev) ELSE 0 END", f"CASE WHEN len(hit) > 0 THEN {_W('hit', 'x.h.confidence')} / len(hit) ELSE 0 END")
_FV = f"""{READ}, {_BEHIND}, fr AS (SELECT f.*, rel.rel FROM feat f JOIN rel ON rel.qid = f.qid AND rel.rank = f.rank WHERE f.rank <= 100), fl AS (SELECT qid, rank, rel, {', '.join(f'round({x}, 9)::DOUBLE AS v{i}' for i, x in enumerate(_FSQL))} FROM fr),
fh AS (SELECT qid, min(rank) AS at_ FROM fl WHERE rel = 1 GROUP BY qid HAVING min(rank) > {FIXED_K}),
fx AS ({' UNION ALL '.join(f"SELECT qid, rank, rel, at_, '{n}' AS feature, v{i} AS v FROM fl JOIN fh USING (qid)" for i, (n, _) in enumerate(FEATURES))})"""


def featured(spark, d) -> DataFrame:
    """(qid, rank, rel, at, feature, v) of the first hundred candidates of queries whose first hit is below the fixed cut-off; more is better."""
    f = read(spark, d).where("rank <= 100").withColumn("final", b3_score("semantic_first")).join(labelled(spark, d).select("qid", "rank", "rel"), ["qid", "rank"])
    c = F.col
    values = ["pure", "qo", "eo", "tov", "abs", "cov", "cov1", "semantic", "final", F.coalesce("score", F.lit(0.0)), F.coalesce("nsrc", F.lit(0)), -F.coalesce("best", F.lit(999)),
              ratio(F.size("hit"), F.size("ev")), ratio(total_of(c("hit"), lambda x: x["confidence"]), F.size("hit"))]
    cells = F.array(*[F.struct(F.lit(n).alias("feature"), F.round((c(v) if isinstance(v, str) else v).cast("double"), 9).alias("v")) for (n, _), v in zip(FEATURES, values)])
    at = F.min(F.when(c("rel") == 1, c("rank"))).over(Window.partitionBy("qid"))
    return f.withColumn("at", at).where(c("at") > FIXED_K).select("qid", "rank", "rel", "at", F.inline(cells))


@query("M09_first_hit_attribution", f"""WITH {_FV} SELECT qid, feature, round(max(v) FILTER (rank = at_), 9) AS hit, round(coalesce(avg(v) FILTER (rank < at_ AND rel = 0), 0), 9) AS blockers, round(max(v) FILTER (rank = at_) - coalesce(avg(v) FILTER (rank < at_ AND rel = 0), 0), 9) AS advantage FROM fx GROUP BY qid, feature""")
def m09(spark, d):
    """Each feature of the first hit against its mean over the misses above it."""
    f = featured(spark, d)
    hit, block = F.max(F.when(F.col("rank") == F.col("at"), F.col("v"))), F.coalesce(F.avg(F.when((F.col("rank") < F.col("at")) & (F.col("rel") == 0), F.col("v"))), F.lit(0.0))
    return f.groupBy("qid", "feature").agg(F.round(hit, 9).alias("hit"), F.round(block, 9).alias("blockers"), F.round(hit - block, 9).alias("advantage"))


_WINS = f"""pw AS (SELECT t.feature, count(*) AS pairs, count(*) FILTER (t.v - b.v > 1e-12) AS wins, count(*) FILTER (abs(t.v - b.v) <= 1e-12) AS ties FROM fx t JOIN fx b ON b.qid = t.qid AND b.feature = t.feature AND b.rank < t.rank AND b.rel = 0 WHERE t.rel = 1 GROUP BY t.feature),
pr AS (SELECT feature, pairs, round((wins + 0.5 * ties) / pairs, 9) AS win_rate FROM pw)"""


def win_rates(f: DataFrame) -> DataFrame:
    """(feature, pairs, win_rate) of hits over the misses above them, ties counting half.

    Only the hits, of which a query has no more than gold items, are joined with the
    misses of their query; pairs are counted on the map side.
    """
    t = f.where("rel = 1").select("qid", "feature", F.col("rank").alias("r"), F.col("v").alias("x"))
    p = f.where("rel = 0").join(t, ["qid", "feature"]).where("rank < r")
    won, tied = F.count_if(F.col("x") - F.col("v") > 1e-12), F.count_if(F.abs(F.col("x") - F.col("v")) <= 1e-12)
    return p.groupBy("feature").agg(F.count("*").alias("pairs"), F.round((won + 0.5 * tied) / F.count("*"), 9).alias("win_rate"))


@query("M10_pairwise_wins", f"WITH {_FV}, {_WINS} SELECT * FROM pr")
def m10(spark, d):
    return win_rates(featured(spark, d))


_ALONE = f"""fo AS (SELECT *, row_number() OVER (PARTITION BY qid, feature ORDER BY v DESC, rank) AS n FROM fx), fq AS (SELECT qid, feature, sum(rel) FILTER (n <= 5) AS a5, sum(rel) FILTER (n <= 20) AS a20, sum(rel) FILTER (rank <= 5) AS b5, sum(rel) FILTER (rank <= 20) AS b20 FROM fo GROUP BY ALL),
fd AS (SELECT feature, sum(coalesce(a5, 0))::BIGINT AS at5, sum(coalesce(a20, 0))::BIGINT AS at20, (sum(coalesce(a5, 0)) - sum(coalesce(b5, 0)))::BIGINT AS delta5, (sum(coalesce(a20, 0)) - sum(coalesce(b20, 0)))::BIGINT AS delta20, count(*) FILTER (coalesce(a20, 0) > coalesce(b20, 0)) AS improved, count(*) FILTER (coalesce(a20, 0) < coalesce(b20, 0)) AS worsened FROM fq GROUP BY feature)"""


def alone(f: DataFrame) -> DataFrame:
    """What each feature by itself would bring into the first 5 and 20, ties in the order as it is."""
    o = f.withColumn("n", F.row_number().over(Window.partitionBy("qid", "feature").orderBy(F.desc("v"), F.asc("rank"))))
    got = lambda at, k: F.sum(F.when(F.col(at) <= k, F.col("rel")).otherwise(0))
    q = o.groupBy("qid", "feature").agg(got("n", 5).alias("a5"), got("n", 20).alias("a20"), got("rank", 5).alias("b5"), got("rank", 20).alias("b20"))
    return q.groupBy("feature").agg(F.sum("a5").alias("at5"), F.sum("a20").alias("at20"), (F.sum("a5") - F.sum("b5")).alias("delta5"), (F.sum("a20") - F.sum("b20")).alias("delta20"),
                                    F.count_if(F.col("a20") > F.col("b20")).alias("improved"), F.count_if(F.col("a20") < F.col("b20")).alias("worsened"))


@query("M11_single_feature_order", f"WITH {_FV}, {_ALONE} SELECT * FROM fd")
def m11(spark, d):
    return alone(featured(spark, d))


# Least win rate of a signal that is worth a trial.
LEAST_WIN = 0.58


@query("M12_ranking_decision", f"""WITH {_FV}, {_WINS}, {_ALONE}, s AS (SELECT feature, win_rate, delta20, delta5 FROM pr JOIN fd USING (feature) WHERE feature <> 'day8_final_score' AND win_rate >= {LEAST_WIN} AND delta20 > 0)
SELECT CAST(row_number() OVER (ORDER BY delta20 DESC, win_rate DESC, delta5 DESC, feature) AS INTEGER) AS n, feature, win_rate, delta20, delta5, 'small_blended_calibration_ablation_warranted' AS decision FROM s UNION ALL SELECT 0, NULL, NULL, NULL, NULL, 'freeze_ranking' WHERE (SELECT count(*) FROM s) = 0""")
def m12(spark, d):
    """Signals that tell hits from the misses above them and bring more hits into the first 20, best first; else the ranking stays as it is."""
    f = stage(featured(spark, d), "featured")
    s = win_rates(f).join(alone(f), "feature").where(f"feature <> 'day8_final_score' and win_rate >= {LEAST_WIN} and delta20 > 0")
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("delta20"), F.desc("win_rate"), F.desc("delta5"), "feature")  # at most 13 rows
    s = s.select(F.row_number().over(order).alias("n"), "feature", "win_rate", "delta20", "delta5", F.lit("small_blended_calibration_ablation_warranted").alias("decision"))
    none = s.agg(F.count("*").alias("k")).where("k = 0").select(F.lit(0).alias("n"), *(F.lit(None).cast(t).alias(c) for c, t in (("feature", "string"), ("win_rate", "double"), ("delta20", "bigint"), ("delta5", "bigint"))), F.lit("freeze_ranking").alias("decision"))
    return s.unionByName(none)


# ---- N03, N04, N07: blends chosen on the other folds

_FOLD = "CAST(('0x' || substr(sha256('13:' || qid), 1, 12)) AS BIGINT) % 5"


def fold_of(qid: str = "qid") -> Column:
    """One of five folds by the query's name; no task sees all queries."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit("13:"), F.col(qid)), 256), 1, 12), 16, 10).cast("bigint") % 5


def _scored_sql(src: str) -> str:
    """Per query and blend: F1@5, NDCG@10 (ideal from the gold count), hits and items, from (qid, beta, n, rel)."""
    ideal = "list_sum(list_transform(range(1, least(gold_count, 10) + 1), lambda x: 1 / log2(x + 1)))"
    return f"""sq_ AS (SELECT b.qid, beta, {_FOLD.replace('qid', 'b.qid')} AS fold, round(2.0 * coalesce(sum(rel) FILTER (n <= 5), 0) / (least(count(*), 5) + any_value(gold_count)), 12) AS f5, round(coalesce(sum(rel / log2(n + 1)) FILTER (n <= 10), 0) / any_value({ideal}), 12) AS ndcg, coalesce(sum(rel) FILTER (n <= 100), 0) AS tp, count(*) AS items
  FROM {src} b JOIN gn ON gn.qid = b.qid GROUP BY b.qid, beta),
tr_ AS (SELECT f.fold, beta, round(avg(f5), 12) AS f5, round(avg(ndcg), 12) AS ndcg FROM (SELECT DISTINCT fold FROM sq_) f JOIN sq_ ON sq_.fold <> f.fold GROUP BY f.fold, beta),
ch_ AS (SELECT fold, arg_max(beta, (f5, ndcg, -beta)) AS beta, max(f5) AS train_f5 FROM tr_ GROUP BY fold), oof_ AS (SELECT sq_.* FROM sq_ JOIN ch_ ON ch_.fold = sq_.fold AND ch_.beta = sq_.beta)"""


def scored(b: DataFrame, golds: DataFrame) -> DataFrame:
    """(qid, beta, fold, f5, ndcg, tp, items) of reordered lists (qid, beta, n, rel)."""
    g = golds.groupBy("qid").agg(F.count("*").alias("gold_count"))
    upto = lambda k, v: F.sum(F.when(F.col("n") <= k, v).otherwise(0))
    s = b.groupBy("qid", "beta").agg(upto(5, F.col("rel")).alias("t5"), F.sum(F.when(F.col("n") <= 10, F.col("rel") / F.log2(F.col("n") + 1)).otherwise(0.0)).alias("dcg"), upto(100, F.col("rel")).alias("tp"), F.count("*").alias("items")).join(g, "qid")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("gold_count"), F.lit(10)).cast("int")), F.lit(0.0), lambda s, x: s + 1 / F.log2(x + 1))
    f5 = 2.0 * F.col("t5") / (F.least(F.col("items"), F.lit(5)) + F.col("gold_count"))
    return s.select("qid", "beta", fold_of().alias("fold"), F.round(f5, 12).alias("f5"), F.round(F.col("dcg") / ideal, 12).alias("ndcg"), "tp", "items")


def chosen(s: DataFrame) -> DataFrame:
    """(fold, beta, train_f5): of every fold the blend that is best on the other folds: F1@5, then NDCG@10, then the smaller blend."""
    own = s.groupBy("fold", "beta").agg(F.sum("f5").alias("f"), F.sum("ndcg").alias("g"), F.count("*").alias("k"))
    train = own.join(F.broadcast(own.select(F.col("fold").alias("held")).distinct())).where("fold <> held").groupBy("held", "beta").agg(F.round(F.sum("f") / F.sum("k"), 12).alias("f5"), F.round(F.sum("g") / F.sum("k"), 12).alias("ndcg"))
    return train.groupBy(F.col("held").alias("fold")).agg(F.max_by("beta", F.struct("f5", "ndcg", -F.col("beta"))).alias("beta"), F.max("f5").alias("train_f5"))


def by_fold(s: DataFrame) -> DataFrame:
    c = chosen(s)
    held = s.join(F.broadcast(c), ["fold", "beta"]).groupBy("fold").agg(F.count("*").alias("queries"), F.max("beta").alias("beta"), F.round(F.max("train_f5"), 9).alias("train_f5"), F.round(F.avg("f5"), 9).alias("f5"), F.round(F.avg("ndcg"), 9).alias("ndcg"))
    return held.select("fold", "queries", "beta", "train_f5", "f5", "ndcg")


_BY_FOLD = "SELECT o.fold, count(*) AS queries, any_value(o.beta) AS beta, round(any_value(ch_.train_f5), 9) AS train_f5, round(avg(f5), 9) AS f5, round(avg(ndcg), 9) AS ndcg FROM oof_ o JOIN ch_ ON ch_.fold = o.fold GROUP BY o.fold"


@query("N03_beta_selection", f"WITH {_BLEND}, {_scored_sql('br')} {_BY_FOLD}")
def n03(spark, d):
    """Of every fold the blend chosen on the other folds and what it gives on the fold itself."""
    return by_fold(scored(blended(spark, d), gold(spark, d)))


# How much NDCG a blend may cost.
NDCG_TOLERANCE = 0.005
_PROTECT = f"""b0_ AS (SELECT avg(f5) AS f5, avg(ndcg) AS ndcg, sum(tp) AS tp, count(*) FILTER (tp = 0) AS zero, sum(items) AS items FROM sq_ WHERE beta = 0), o0_ AS (SELECT avg(f5) AS f5, avg(ndcg) AS ndcg, sum(tp) AS tp, count(*) FILTER (tp = 0) AS zero, sum(items) AS items FROM oof_),
ok_ AS (SELECT o0_.items = b0_.items AS same_items, o0_.tp = b0_.tp AS same_tp, o0_.zero = b0_.zero AS same_zero, round(o0_.f5, 12) > round(b0_.f5, 12) AS f1_up, round(o0_.ndcg, 9) >= round(b0_.ndcg - {NDCG_TOLERANCE}, 9) AS ndcg_kept FROM o0_, b0_)"""


def protected(s: DataFrame) -> DataFrame:
    """Whether the blends chosen out of fold keep items, hits, zero-recall queries and NDCG, and raise F1@5; accepted if all hold."""
    of = lambda df, p: df.agg(F.avg("f5").alias(f"{p}f5"), F.avg("ndcg").alias(f"{p}ndcg"), F.sum("tp").alias(f"{p}tp"), F.count_if(F.col("tp") == 0).alias(f"{p}zero"), F.sum("items").alias(f"{p}items"))
    o = of(s.join(F.broadcast(chosen(s)), ["fold", "beta"]), "o_").join(F.broadcast(of(s.where("beta = 0"), "b_")))
    same = lambda c: F.col(f"o_{c}") == F.col(f"b_{c}")
    ok = o.select(same("items").alias("same_items"), same("tp").alias("same_tp"), same("zero").alias("same_zero"), (F.round("o_f5", 12) > F.round("b_f5", 12)).alias("f1_up"), (F.round("o_ndcg", 9) >= F.round(F.col("b_ndcg") - NDCG_TOLERANCE, 9)).alias("ndcg_kept"))
    return ok.withColumn("accepted", F.col("same_items") & F.col("same_tp") & F.col("same_zero") & F.col("f1_up") & F.col("ndcg_kept"))


_ACCEPT = "SELECT *, same_items AND same_tp AND same_zero AND f1_up AND ndcg_kept AS accepted FROM ok_"


@query("N04_protection_checks", f"WITH {_BLEND}, {_scored_sql('br')}, {_PROTECT} {_ACCEPT}")
def n04(spark, d):
    return protected(scored(blended(spark, d), gold(spark, d)))


_EBLEND = f"""{READ}, {_BEHIND}, eb0 AS (SELECT f.qid, f.rank, rel.rel, f.pure AS s, {_QUALITY} AS q, min(pure) OVER (PARTITION BY f.qid) AS lo, max(pure) OVER (PARTITION BY f.qid) AS hi FROM feat f JOIN rel ON rel.qid = f.qid AND rel.rank = f.rank),
eb1 AS (SELECT qid, rank, rel, b_ AS beta, round((1 - b_) * CASE WHEN hi > lo THEN (s - lo) / (hi - lo) ELSE 0 END + b_ * q, 9) AS v FROM eb0 CROSS JOIN (SELECT unnest([{', '.join(map(str, BETAS))}])::DOUBLE AS b_)),
eb AS (SELECT qid, rank, rel, beta, row_number() OVER (PARTITION BY qid, beta ORDER BY v DESC, rank) AS n FROM eb1)"""


def evidence_blended(spark, d) -> DataFrame:
    """(qid, beta, n, rel): lists reordered by text semantics blended with the quality of their evidence."""
    w = Window.partitionBy("qid")
    f = read(spark, d).select("qid", "rank", "pure", evidence_quality().alias("q")).join(labelled(spark, d).select("qid", "rank", "rel"), ["qid", "rank"])
    f = f.withColumn("lo", F.min("pure").over(w)).withColumn("hi", F.max("pure").over(w)).withColumn("beta", F.explode(F.array(*map(F.lit, BETAS))))
    norm = F.when(F.col("hi") > F.col("lo"), (F.col("pure") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    f = f.withColumn("v", F.round((1 - F.col("beta")) * norm + F.col("beta") * F.col("q"), 9))
    return f.select("qid", "beta", "rel", F.row_number().over(Window.partitionBy("qid", "beta").orderBy(F.desc("v"), F.asc("rank"))).alias("n"))


@query("N07_evidence_blend", f"WITH {_EBLEND}, {_scored_sql('eb')} {_BY_FOLD}")
def n07(spark, d):
    """The same cross-validation for a blend with the quality of evidence."""
    return by_fold(scored(evidence_blended(spark, d), gold(spark, d)))


@query("N07_evidence_blend_accepted", f"WITH {_EBLEND}, {_scored_sql('eb')}, {_PROTECT} {_ACCEPT}")
def n07_accepted(spark, d):
    return protected(scored(evidence_blended(spark, d), gold(spark, d)))


# ---- I09..I11, N06: cut-offs learned from like queries

CUTOFF = ("tokens", "chars", "constraints", "candidates", "top1", "top3", "top5", "top10", "top20", "std10", "gap_1_2", "gap_1_5", "gap_5_10", "gap_10_20", "cov5", "cov10", "rawcov5", "sources10")
_GAP = lambda a, b: f"CASE WHEN count(*) >= {b} THEN coalesce(max(s) FILTER (rank = {a}), 0) - coalesce(max(s) FILTER (rank = {b}), 0) ELSE 0 END"
_TOP = lambda c, k: f"coalesce(avg({c}) FILTER (rank <= {k}), 0)"
_CF = f"""{READ}, cf0 AS (SELECT qid, rank, question, coalesce(score, 0) AS s, coalesce(nsrc, 0) AS nsrc, cov, cov1, len(canon) AS cons FROM feat),
cf AS (SELECT qid, len(regexp_extract_all(lower(any_value(question)), '[a-z0-9]+'))::DOUBLE AS tokens, len(any_value(question))::DOUBLE AS chars, any_value(cons)::DOUBLE AS constraints, count(*)::DOUBLE AS candidates, coalesce(max(s) FILTER (rank = 1), 0) AS top1, {', '.join(f"{_TOP('s', k)} AS top{k}" for k in (3, 5, 10, 20))},
  CASE WHEN count(*) >= 2 THEN coalesce(stddev_pop(s) FILTER (rank <= 10), 0) ELSE 0 END AS std10, {_GAP(1, 2)} AS gap_1_2, {_GAP(1, 5)} AS gap_1_5, {_GAP(5, 10)} AS gap_5_10, {_GAP(10, 20)} AS gap_10_20, {_TOP('cov', 5)} AS cov5, {_TOP('cov', 10)} AS cov10, {_TOP('cov1', 5)} AS rawcov5, {_TOP('nsrc', 10)} AS sources10 FROM cf0 GROUP BY qid)"""


def cutoff_features(spark, d) -> DataFrame:
    """Eighteen gold-free features of a query's list, one row a query."""
    f = read(spark, d).select("qid", "rank", "question", F.coalesce("score", F.lit(0.0)).alias("s"), F.coalesce("nsrc", F.lit(0)).alias("nsrc"), "cov", "cov1", F.size("canon").alias("cons"))
    r, s = F.col("rank"), F.col("s")
    at = lambda k: F.coalesce(F.max(F.when(r == k, s)), F.lit(0.0))
    mean = lambda c, k: F.coalesce(F.avg(F.when(r <= k, F.col(c))), F.lit(0.0))
    gap = lambda a, b: F.when(F.count("*") >= b, at(a) - at(b)).otherwise(0.0)
    q = F.first("question")
    return f.groupBy("qid").agg(
        F.size(F.regexp_extract_all(F.lower(q), F.lit("[a-z0-9]+"), F.lit(0))).cast("double").alias("tokens"), F.length(q).cast("double").alias("chars"), F.max("cons").cast("double").alias("constraints"), F.count("*").cast("double").alias("candidates"), at(1).alias("top1"),
        *(mean("s", k).alias(f"top{k}") for k in (3, 5, 10, 20)), F.when(F.count("*") >= 2, F.coalesce(F.stddev_pop(F.when(r <= 10, s)), F.lit(0.0))).otherwise(0.0).alias("std10"), gap(1, 2).alias("gap_1_2"), gap(1, 5).alias("gap_1_5"),
        gap(5, 10).alias("gap_5_10"), gap(10, 20).alias("gap_10_20"), mean("cov", 5).alias("cov5"), mean("cov", 10).alias("cov10"), mean("cov1", 5).alias("rawcov5"), mean("nsrc", 10).alias("sources10"))


@query("I09_cutoff_features", f"WITH {_CF} SELECT qid, {', '.join(f'round({c}, 9) AS {c}' for c in CUTOFF)} FROM cf")
def i09(spark, d):
    return cutoff_features(spark, d).select("qid", *(F.round(c, 9).alias(c) for c in CUTOFF))


_UNP = f"u AS ({' UNION ALL '.join(f"SELECT qid, '{c}' AS feature, round({c}, 9) AS v FROM cf" for c in CUTOFF)})"


def long_features(spark, d) -> DataFrame:
    return i09(spark, d).unpivot(["qid"], list(CUTOFF), "feature", "v")


def scaler(long: DataFrame, *by: str) -> DataFrame:
    """(by, feature, med, scale): median and median absolute deviation of each feature; a deviation of nothing counts as 1."""
    med = long.groupBy(*by, "feature").agg(F.median("v").alias("med"))
    mad = long.join(F.broadcast(med), [*by, "feature"]).groupBy(*by, "feature").agg(F.first("med").alias("med"), F.median(F.abs(F.col("v") - F.col("med"))).alias("mad"))
    return mad.select(*by, "feature", "med", F.when(F.col("mad") > 1e-9, F.col("mad")).otherwise(1.0).alias("scale"))


_SCALE = f"""{_CF}, {_UNP}, md AS (SELECT feature, median(v) AS med FROM u GROUP BY feature),
sc AS (SELECT feature, any_value(med) AS med, CASE WHEN median(abs(v - med)) > 1e-9 THEN median(abs(v - med)) ELSE 1.0 END AS scale FROM u JOIN md USING (feature) GROUP BY feature)"""


@query("I10_robust_scaler", f"WITH {_SCALE} SELECT feature, round(med, 9) AS med, round(scale, 9) AS scale FROM sc")
def i10(spark, d):
    return scaler(long_features(spark, d)).select("feature", F.round("med", 9).alias("med"), F.round("scale", 9).alias("scale"))


def nearest(z: DataFrame, train: DataFrame, n: int = 7, block: int = 4_000) -> DataFrame:
    """(fold, qid, near): the n nearest (d, k) of ``train`` (fold, qid, z, k) in the same fold by root mean square distance, itself left out.

    A task compares one block of queries with one of ``train``; queries that have no other to meet are left out.
    """
    width = len(CUTOFF)
    parts = lambda df: max(1, -(-df.count() // block))
    of = lambda m: F.pmod(F.xxhash64("qid"), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    asked, known = parts(z), parts(train)
    left = z.select("fold", "qid", "z", F.lit(None).cast("int").alias("k"), of(asked).alias("i"), every(known).alias("j"))
    right = train.select("fold", "qid", "z", F.col("k").cast("int").alias("k"), every(asked).alias("i"), of(known).alias("j"))

    def compare(group):
        import numpy as np
        import pyarrow as pa

        a, b = group.filter(group.column("k").is_null()), group.filter(group.column("k").is_valid())
        points = lambda t: np.array(t.column("z").to_pylist(), float).reshape(-1, width)
        ids, ks = np.array(b.column("qid").to_pylist(), object), np.array(b.column("k").to_pylist(), np.int64)
        placed, out = points(b), []
        for fold, qid, v in zip(a.column("fold").to_pylist(), a.column("qid").to_pylist(), points(a)):
            dist = np.round(np.sqrt(((placed - v) ** 2).sum(1) / width), 9)
            at = np.nonzero(ids != qid)[0]
            at = at[np.lexsort((ks[at], dist[at]))[:n]]
            out += [(fold, qid, float(dist[t]), int(ks[t])) for t in at]
        cols = list(zip(*out)) or [(), (), (), ()]
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.float64(), pa.int64()))], names=["fold", "qid", "d", "k"])

    best = left.unionByName(right).groupBy("fold", "i", "j").applyInArrow(compare, "fold long, qid string, d double, k long")
    return best.groupBy("fold", "qid").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "k"))), 1, n).alias("near"))


def snapped() -> list[Column]:
    """weighted_k and k: the neighbours' cut-offs with weights 1 / (distance + 0.25), and the allowed one nearest to their mean, the smaller of two."""
    total = lambda f: F.aggregate("near", F.lit(0.0), f)
    k = F.round(total(lambda s, x: s + x["k"] / (x["d"] + 0.25)) / total(lambda s, x: s + 1 / (x["d"] + 0.25)), 6)
    at = F.array_min(F.transform(F.array(*map(F.lit, GRID)), lambda g: F.struct(F.abs(g - k).alias("d"), g.alias("k"))))["k"]
    return [k.alias("weighted_k"), at.alias("k")]


def points(long: DataFrame, sc: DataFrame) -> DataFrame:
    """(fold, qid, z): scaled features in a fixed order."""
    z = F.round((F.col("v") - F.col("med")) / F.col("scale"), 9)
    order = F.create_map(*[F.lit(x) for i, c in enumerate(CUTOFF) for x in (c, i)])[F.col("feature")]
    return long.join(F.broadcast(sc), "feature").groupBy("fold", "qid").agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), z.alias("z")))), lambda x: x["z"]).alias("z"))


_NEAR = lambda z, train: f"""nd_ AS (SELECT a.fold, a.qid, b.k, round(sqrt(list_sum(list_transform(list_zip(a.z, b.z), lambda p: pow(p[1] - p[2], 2))) / {len(CUTOFF)}), 9) AS d FROM {z} a JOIN {train} b ON b.fold = a.fold AND b.qid <> a.qid),
nn_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fold, qid ORDER BY d, k) AS n FROM nd_) WHERE n <= 7), nk_ AS (SELECT fold, qid, round(sum(k / (d + 0.25)) / sum(1 / (d + 0.25)), 6) AS weighted_k FROM nn_ GROUP BY fold, qid),
ns_ AS (SELECT fold, qid, weighted_k, (SELECT arg_min(g, (abs(g - weighted_k), g)) FROM (SELECT unnest([{_G}]) AS g)) AS k FROM nk_)"""  # noqa: E731
_ORDER = "CASE feature " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(CUTOFF)) + " END"
_I11 = f"""{_SCALE}, {_OR.split(RANKED + ', ')[1]}, zz AS (SELECT 0 AS fold, qid, list(round((v - med) / scale, 9) ORDER BY {_ORDER}) AS z FROM u JOIN sc USING (feature) GROUP BY qid), zt AS (SELECT zz.*, best_k AS k FROM zz JOIN orc USING (qid)), {_NEAR('zz', 'zt')}"""


@query("I11_neighbour_cutoff", f"WITH {_I11} SELECT qid, weighted_k, CAST(k AS INTEGER) AS k FROM ns_")
def i11(spark, d):
    """Cut-off of a query from the seven nearest of all queries that have gold; targets are the best of every K."""
    long = stage(long_features(spark, d), "features")
    z = points(long.withColumn("fold", F.lit(0).cast("bigint")), scaler(long))
    near = nearest(z, z.join(oracle(spark, d).select("qid", F.col("best_k").alias("k")), "qid"))
    return near.select("qid", *snapped())


_N06 = f"""{_CF}, {_UNP}, {_OR.split(RANKED + ', ')[1]}, fq AS (SELECT qid, {_FOLD} AS fold, best_k AS k FROM orc JOIN cf USING (qid)), ff AS (SELECT DISTINCT fold FROM fq),
um AS (SELECT ff.fold, feature, median(v) AS med FROM u JOIN fq USING (qid) JOIN ff ON ff.fold <> fq.fold GROUP BY ALL), us AS (SELECT ff.fold, u.feature, any_value(med) AS med, CASE WHEN median(abs(v - med)) > 1e-9 THEN median(abs(v - med)) ELSE 1.0 END AS scale FROM u JOIN fq USING (qid) JOIN ff ON ff.fold <> fq.fold JOIN um ON um.fold = ff.fold AND um.feature = u.feature GROUP BY ALL),
za AS (SELECT us.fold, u.qid, fq.fold AS own, fq.k, list(round((v - med) / scale, 9) ORDER BY {_ORDER.replace('feature', 'u.feature')}) AS z FROM u JOIN us USING (feature) JOIN fq USING (qid) GROUP BY ALL), zv AS (SELECT fold, qid, z FROM za WHERE fold = own), zt AS (SELECT fold, qid, z, k FROM za WHERE fold <> own), {_NEAR('zv', 'zt')},
hr AS (SELECT qid, list(rank ORDER BY rank) AS rs FROM hits GROUP BY qid), tk AS (SELECT ff.fold, g.k, round(avg(2.0 * len(list_filter(coalesce(rs, []), lambda x: x <= g.k)) / (g.k + gold_count)), 12) AS f FROM fq JOIN ff ON ff.fold <> fq.fold JOIN per USING (qid) LEFT JOIN hr USING (qid) CROSS JOIN (SELECT unnest([{_G}]) AS k) g GROUP BY ff.fold, g.k),
tb AS (SELECT fold, arg_max(k, (f, -k)) AS fixed_k FROM tk GROUP BY fold)"""


@query("N06_out_of_fold_k", f"""WITH {_N06} SELECT fq.qid, fq.fold, CAST(fixed_k AS INTEGER) AS fixed_k, CAST(coalesce(ns_.k, fixed_k) AS INTEGER) AS k, round(2.0 * len(list_filter(coalesce(rs, []), lambda x: x <= coalesce(ns_.k, fixed_k))) / (coalesce(ns_.k, fixed_k) + gold_count), 9) AS f1,
  round(2.0 * len(list_filter(coalesce(rs, []), lambda x: x <= fixed_k)) / (fixed_k + gold_count), 9) AS fixed_f1 FROM fq JOIN tb ON tb.fold = fq.fold JOIN per ON per.qid = fq.qid LEFT JOIN ns_ ON ns_.qid = fq.qid AND ns_.fold = fq.fold LEFT JOIN hr ON hr.qid = fq.qid""")
def n06(spark, d):
    """Cut-off of every query from the nearest queries of the other folds, scaled by those folds alone; beside it their best fixed cut-off.

    No query's own gold reaches its scaler, its neighbours or its fixed cut-off.
    """
    long = stage(long_features(spark, d), "features")
    own = stage(oracle(spark, d), "oracle").join(long.select("qid").distinct(), "qid").select("qid", fold_of().alias("own"), F.col("best_k").alias("target"))
    labelled_long = long.join(own, "qid")
    each = labelled_long.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(4)).cast("array<bigint>")))
    sc = scaler(each.where("fold <> own"), "fold")
    z = F.round((F.col("v") - F.col("med")) / F.col("scale"), 9)
    order = F.create_map(*[F.lit(x) for i, c in enumerate(CUTOFF) for x in (c, i)])[F.col("feature")]
    made = each.join(F.broadcast(sc), ["fold", "feature"]).groupBy("fold", "qid", "own", "target").agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), z.alias("z")))), lambda x: x["z"]).alias("z"))
    near = nearest(made.where("fold = own").select("fold", "qid", "z"), made.where("fold <> own").select("fold", "qid", "z", F.col("target").alias("k"))).select("fold", "qid", *snapped())
    rs = hits(spark, d).groupBy("qid").agg(F.array_sort(F.collect_list("rank")).alias("rs"))
    q = own.join(per_query(spark, d).select("qid", "gold_count"), "qid").join(rs, "qid", "left").withColumn("rs", F.coalesce("rs", F.array().cast("array<int>")))
    f1 = lambda k: 2.0 * F.size(F.filter("rs", lambda x: x <= k)) / (k + F.col("gold_count"))
    per_k = q.withColumn("k", F.explode(F.array(*map(F.lit, GRID)))).groupBy("own", "k").agg(F.sum(f1(F.col("k"))).alias("s"), F.count("*").alias("n"))
    rest = per_k.join(F.broadcast(per_k.select(F.col("own").alias("fold")).distinct())).where("own <> fold").groupBy("fold", "k").agg(F.round(F.sum("s") / F.sum("n"), 12).alias("f"))
    fixed = rest.groupBy("fold").agg(F.max_by("k", F.struct("f", -F.col("k"))).alias("fixed_k"))
    q = q.withColumnRenamed("own", "fold").join(F.broadcast(fixed), "fold").join(near.drop("weighted_k"), ["fold", "qid"], "left").withColumn("k", F.coalesce("k", "fixed_k"))
    return q.select("qid", "fold", "fixed_k", "k", F.round(f1(F.col("k")), 9).alias("f1"), F.round(f1(F.col("fixed_k")), 9).alias("fixed_f1"))

"""Constraint evidence, reranking, guards, selection and explanations of ranked candidates.

What a question brings (tokens, constraints, guard rules) is made once a question; each
candidate is then one row, and its evidence, coverage and features are arrays and numbers
of that row, so the whole of H, I and J is one join by qid and windows over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom import lexicon as L
from rankloom.functions.text import ascii_words, clamp, evidence_words, ratio, soft_overlap, tokens
from rankloom.plans import guard as G
from rankloom.plans.evaluation import RANKED, _REL, labelled, ranked
from rankloom.plans.inputs import candidates, norm
from rankloom.plans.planner import CANON, _evidence_sql, _peeled_expr, canonical_constraints, peeled
from rankloom.plans.ranking import NEVER, STRONG, SUBQUERY, by_source, case, place, strong_id
from rankloom.plans.scalars import _tok_sql, questions, soft_sql
from rankloom.plans.understand import _CON, _Q, _lst, _table, _table_sql, clean_keywords, constraint_id, constraints_of, is_fragment, _fragment_sql, suspicions, _SUSPECT
from rankloom.plans.understand import constraints as plain_constraints
from rankloom.plans.understand import questions as asked_questions
from rankloom.registry import query

CORE = ("performance_relation", "data_condition", "method_or_property")
# Confidence of a match by field and kind.
CONFIDENCE = {
    "title": {"phrase": 1.00, "alias": 0.95, "token": 0.90}, "abstract": {"phrase": 0.90, "alias": 0.86, "token": 0.82}, "concept": {"phrase": 0.75, "alias": 0.72, "token": 0.68},
}
# Phrases and what they are also searched as.
SYNONYMS = {
    "large language model": ["llm", "language model", "transformer"],
    "large language models": ["llm", "language models", "transformer"],
    "pre training": ["pretraining", "pre train", "pretrained"],
    "pretraining": ["pre training", "pre train", "pretrained"],
    "smaller dataset": ["small dataset", "less data", "fewer data", "data efficient"],
    "bigger dataset": ["larger dataset", "more data", "large dataset"],
    "better models": ["better performance", "outperform", "improved performance"],
    "scaling law": ["scaling laws", "scaling behavior"],
    "scaling laws": ["scaling law", "scaling behavior"],
    "video text": ["video language", "video-text", "video and text"],
    "image text": ["vision language", "image-text", "image and text"],
    "retrieval augmented generation": ["rag", "retrieval generation"],
    "text to sql": ["text-to-sql", "nl2sql", "natural language to sql"],
}
_SYN_ROWS = [{"k": k, "v": v} for k, v in SYNONYMS.items()]
_GEN = _lst(L.EVIDENCE_GENERIC)
_QQ = "q AS (SELECT qid AS row_id, min(question) AS question FROM predictions WHERE question IS NOT NULL GROUP BY qid)"


def r9(*cs: str) -> list[Column]:
    return [F.round(c, 9).alias(c) for c in cs]


_R = lambda *cs: ", ".join(f"round({c}, 9) AS {c}" for c in cs)


# ---- what a question brings


def needed(n: Column) -> Column:
    """How many of a constraint's distinct words a text must have."""
    return F.when(n <= 2, n).otherwise(F.greatest(F.lit(2), F.ceil(0.8 * n))).cast("int")


def _matchable(text: Column, others: Column, *more: Column) -> Column:
    """A constraint made ready for ``evidence_of``: its words, how many of them are needed, what may be looked for as a phrase."""
    ws = F.array_distinct(F.split(text, " "))
    generic = lambda t: t.isin(*L.EVIDENCE_GENERIC)
    need = F.when(generic(text), F.lit(999)).otherwise(needed(F.size(ws)))
    return F.struct(*more, text.alias("text"), (~generic(text)).alias("whole"), F.filter(others, lambda o: ~generic(o)).alias("others"), ws.alias("ws"), need.alias("need"))


def asked_with_concepts(spark, d) -> DataFrame:
    """(qid, question, raws, singles, canon, qt, xt, rules): one row a question."""
    asked = questions(spark, d).withColumnRenamed("qid", "row_id")
    plain = constraints_of(asked).withColumn("id", constraint_id())
    cell = F.struct("idx", "id", "text", "kind", "weight", clean_keywords(ascii_words(F.col("text")), 100_000).alias("terms"))
    single = F.struct("idx", F.concat(F.lit("raw"), F.col("idx") + 1, F.lit("_"), "id").alias("id"), "kind", "weight", _matchable(peeled(F.col("text")), F.array().cast("array<string>")).alias("m"))
    raws = plain.groupBy("row_id").agg(F.array_sort(F.collect_list(cell)).alias("raws"), F.array_sort(F.collect_list(single)).alias("singles"))
    others = F.array_except(F.transform("aliases", peeled), F.array("text"))
    canon = canonical_constraints(asked, constraints_of(asked)).select("row_id", F.struct("n", "id", "kind", "weight", _matchable(F.col("text"), others).alias("m")).alias("c"))
    canon = canon.groupBy("row_id").agg(F.array_sort(F.collect_list("c")).alias("canon"))
    q = asked.join(raws, "row_id", "left").join(canon, "row_id", "left")
    for c in ("raws", "singles", "canon"):
        q = q.withColumn(c, F.coalesce(c, F.array().cast(dict(q.dtypes)[c])))
    q = q.withColumn("w", ascii_words(F.col("question")))
    texts = F.transform("raws", lambda r: ascii_words(r["text"]))
    more = F.filter(_table(_SYN_ROWS), lambda s: F.col("w").contains(s["k"]) | F.array_contains(texts, s["k"]))
    phrases = F.concat(F.array("w"), texts, F.transform(more, lambda s: s["k"]), F.flatten(F.transform(more, lambda s: s["v"])))
    expanded = F.array_distinct(F.flatten(F.transform(phrases, tokens)))
    return q.select(F.col("row_id").alias("qid"), "question", "raws", "singles", "canon", tokens(F.col("question")).alias("qt"), expanded.alias("xt"), G.asked_rules(F.col("question")).alias("rules"))


_CANON_Q = CANON.replace(_Q, _QQ)
_MATCH = lambda text, others: f"{{'text': {text}, 'whole': NOT list_contains({_GEN}, {text}), 'others': list_filter({others}, lambda o: NOT list_contains({_GEN}, o)), 'ws': list_distinct(string_split({text}, ' ')), 'need': CASE WHEN list_contains({_GEN}, {text}) THEN 999 WHEN len(list_distinct(string_split({text}, ' '))) <= 2 THEN len(list_distinct(string_split({text}, ' '))) ELSE greatest(2, ceil(0.8 * len(list_distinct(string_split({text}, ' '))))) END::INTEGER}}"
_TERMS = f"list_distinct(list_filter(regexp_extract_all({norm('text')}, '[a-z][a-z0-9]*|\\d+[a-z]*'), lambda t: len(t) >= 2 AND NOT list_contains({_lst(L.PROMPT_NOISE)}, t)))"
CONCEPTS = f"""{_CANON_Q},
rl AS (SELECT row_id, list({{'idx': idx, 'id': id, 'text': text, 'kind': kind, 'weight': weight, 'terms': {_TERMS}}} ORDER BY idx) AS raws, list({{'id': 'raw' || (idx + 1) || '_' || id, 'kind': kind, 'weight': weight, 'm': {_MATCH(_peeled_expr('text'), '[]::VARCHAR[]')}}} ORDER BY idx) AS singles FROM ci GROUP BY row_id),
kl AS (SELECT row_id, list({{'n': n, 'id': id, 'kind': kind, 'weight': weight, 'm': {_MATCH('text', f"list_filter(list_distinct(list_transform(aliases, lambda a: {_peeled_expr('a')})), lambda a: a <> text)")}}} ORDER BY n) AS canon FROM can GROUP BY row_id),
qc0 AS (SELECT q.row_id AS qid, question, coalesce(raws, []) AS raws, coalesce(singles, []) AS singles, coalesce(canon, []) AS canon, {norm('question')} AS qw, list_transform(coalesce(raws, []), lambda r: {norm('r.text')}) AS texts FROM q LEFT JOIN rl USING (row_id) LEFT JOIN kl USING (row_id)),
qc1 AS (SELECT *, list_filter({_table_sql(_SYN_ROWS)}, lambda s: contains(qw, s.k) OR list_contains(texts, s.k)) AS syn FROM qc0),
qc AS (SELECT *, {_tok_sql('question')} AS qt, list_distinct(flatten(list_transform(list_concat(list_concat(list_concat([qw], texts), list_transform(syn, lambda s: s.k)), flatten(list_transform(syn, lambda s: s.v))), lambda p: {_tok_sql('p')}))) AS xt, {G.asked_sql('question')} AS rules FROM qc1)"""


# ---- candidates with all that is read off their texts

_FOUND = "struct<field:string,how:string,said:string,coverage:double>"


def _looked_for(m: Column, text: Column, field: str) -> Column:
    """The match of a constraint in one normalised text: phrase, else alias, else enough words; null if none."""
    padded, own = F.concat(F.lit(" "), text, F.lit(" ")), F.split(text, " ")
    inside = lambda p: padded.contains(F.concat(F.lit(" "), p, F.lit(" ")))
    aliases, said = F.filter(m["others"], inside), F.filter(m["ws"], lambda w: F.array_contains(own, w))
    cell = lambda how, what, cov: F.struct(F.lit(field).alias("field"), F.lit(how).alias("how"), what.alias("said"), cov.alias("coverage"))
    found = F.when(m["whole"] & inside(m["text"]), cell("phrase", m["text"], F.lit(1.0)))
    found = found.when(F.size(aliases) > 0, cell("alias", F.element_at(aliases, 1), F.lit(1.0)))
    return F.when(text != "", found.when(F.size(said) >= m["need"], cell("token", F.array_join(said, " "), F.size(said) / F.size(m["ws"]))))


def evidence_of(constraints: str, title: str, abstract: str, concepts: str) -> Column:
    """The best evidence of each constraint: title before abstract before each concept by itself; unmatched ones stay."""

    def best(c: Column) -> Column:
        m = c["m"]
        named = F.filter(F.transform(concepts, lambda x: _looked_for(m, x, "concept")), lambda x: x.isNotNull())
        hit = F.coalesce(_looked_for(m, F.col(title), "title"), _looked_for(m, F.col(abstract), "abstract"), F.when(F.size(named) > 0, named[0]))
        conf = F.lit(0.0)
        for f, kinds in CONFIDENCE.items():
            for k, v in kinds.items():
                conf = F.when((hit["field"] == f) & (hit["how"] == k), v).otherwise(conf)
        return F.struct(c["id"].alias("id"), m["text"].alias("text"), c["kind"].alias("kind"), c["weight"].alias("weight"), hit["field"].alias("field"), hit["how"].alias("how"),
                        hit["said"].alias("said"), F.coalesce(hit["coverage"], F.lit(0.0)).alias("coverage"), conf.alias("confidence"))

    return F.transform(constraints, best)


def total_of(cells: Column, value) -> Column:
    return F.aggregate(cells, F.lit(0.0), lambda s, x: s + value(x))


def papers(spark, d) -> DataFrame:
    """Ranked candidates with abstract, identifier flag, what the search channels said, and all of their question.

    ``venue`` and ``concepts`` (display names) are read where the candidates have them.
    """
    c = candidates(spark, d)
    least = lambda *s: F.coalesce(F.min(F.when(F.col("source").isin(*s), F.col("rank"))), F.lit(NEVER))
    more = c.groupBy("qid", "key").agg(
        F.max("abstract").alias("abstract"), F.bool_or(strong_id()).alias("strong"), F.count("*").alias("occ"), least("semantic_scholar", "openalex").alias("anchor"),
        F.bool_or(F.col("source") == "semantic_scholar").alias("is_raw"), F.bool_or(F.col("source") == "openalex").alias("is_cleaned"),
        (F.max("venue") if "venue" in c.columns else F.lit(None).cast("string")).alias("venue"),
        (F.max("concepts") if "concepts" in c.columns else F.array().cast("array<string>")).alias("concepts"))
    return ranked(spark, d).join(more, ["qid", "key"]).join(asked_with_concepts(spark, d), "qid")


def read(spark, d) -> DataFrame:
    """``papers`` with evidence, coverage and features: the one table of H, I and J."""
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit("")), F.coalesce("venue", F.lit("")), F.array_join("concepts", " "))
    p = papers(spark, d).select("*", evidence_words(F.col("title")).alias("t"), evidence_words(F.col("abstract")).alias("a"), F.transform("concepts", evidence_words).alias("cs"),
                                ascii_words(text).alias("all_"), tokens(text).alias("dt"), tokens(F.col("title")).alias("tt"), tokens(F.col("abstract")).alias("at"), F.array_union("qt", "xt").alias("both"))
    padded = F.concat(F.lit(" "), "all_", F.lit(" "))

    def phrase(w: Column) -> Column:
        """A word or phrase as whole words, with a plural s unless it ends in one."""
        return (w != "") & (padded.contains(F.concat(F.lit(" "), w, F.lit(" "))) | (~w.endswith("s") & padded.contains(F.concat(F.lit(" "), w, F.lit("s ")))))

    enough = lambda r, n: n >= F.when(F.size(r["terms"]) <= 2, F.size(r["terms"])).otherwise(F.greatest(F.lit(2), F.size(r["terms"]) - 1))
    alike = lambda t: F.array_contains("dt", t) | ((F.length(t) >= 4) & F.exists("dt", lambda x: (F.length(x) >= 4) & (x.startswith(t) | t.startswith(x))))
    covered = F.filter("raws", lambda r: (F.size(r["terms"]) > 0) & (F.size(F.filter(r["terms"], phrase)) > 0) & enough(r, F.size(F.filter(r["terms"], phrase))))
    said = F.filter("raws", lambda r: phrase(ascii_words(r["text"])) | ((F.size(r["terms"]) > 0) & enough(r, F.size(F.filter(r["terms"], alike)))))
    p = p.select("*", covered.alias("cov_raws"), said.alias("said_raws"), evidence_of("canon", "t", "a", "cs").alias("ev"), evidence_of("singles", "t", "a", "cs").alias("ev1"),
                 soft_overlap(F.col("qt"), F.col("dt")).alias("qo"), soft_overlap(F.col("xt"), F.col("dt")).alias("eo"), soft_overlap(F.col("both"), F.col("tt")).alias("tov"), soft_overlap(F.col("both"), F.col("at")).alias("abs"))
    core = lambda cells: F.size(F.filter(cells, lambda r: r["kind"].isin(*CORE)))
    hit = F.filter("ev", lambda e: e["how"].isNotNull())
    weigh = lambda cells: total_of(cells, lambda x: x["weight"])
    p = p.select("*", F.size("raws").alias("total"), F.size("cov_raws").alias("covered"), weigh(F.col("cov_raws")).alias("covered_weight"), core("cov_raws").alias("core"),
                 (F.size("said_raws") / F.greatest(F.size("raws"), F.lit(1))).alias("pc"), (core("said_raws") / F.greatest(core("raws"), F.lit(1))).alias("cc"), hit.alias("hit"),
                 ratio(weigh(hit), weigh(F.col("ev"))).alias("cov"), ratio(weigh(F.filter("ev1", lambda e: e["how"].isNotNull())), weigh(F.col("ev1"))).alias("cov1"))
    c = F.col
    semantic = 0.28 * c("qo") + 0.25 * c("eo") + 0.22 * c("tov") + 0.15 * c("pc") + 0.07 * c("cc") + 0.03 * c("abs")
    pure = clamp(0.38 * c("qo") + 0.30 * c("eo") + 0.24 * c("tov") + 0.08 * c("abs"))
    p = p.select("*", semantic.alias("semantic"), pure.alias("pure"), support().alias("support"))
    return p.withColumn("b2", b2_score(*PRESETS["hybrid"]))


def support() -> Column:
    """What the search channels say for a candidate."""
    occ = F.when(F.col("occ") >= 2, F.least(F.lit(0.05), 0.02 * (F.col("occ") - 1))).otherwise(0.0)
    near = F.when(F.col("anchor") <= 20, 0.03).when(F.col("anchor") <= 50, 0.015).otherwise(0.0)
    return occ + near + F.when(F.col("is_raw"), 0.015).otherwise(0.0) + F.when(F.col("is_cleaned"), 0.010).otherwise(0.0)


# Presets of the constraint reranker: rank, constraint, occurrence, core bonus, missing penalty.
PRESETS = {"conservative": (0.85, 0.15, 0.03, 0.03, 0.02), "hybrid": (0.70, 0.30, 0.05, 0.05, 0.04), "coverage_first": (0.50, 0.50, 0.05, 0.08, 0.06)}


def b2_score(r: float, c: float, o: float, b: float, m: float) -> Column:
    total, core = F.col("total"), F.col("core")
    cov = F.when(total > 0, 0.50 * F.col("covered") / total + 0.35 * F.col("covered_weight") / F.greatest(F.lit(1.0), total) + 0.15 * F.least(F.lit(1.0), core / 2)).otherwise(0.0)
    bonus = F.when(core > 0, b).when(total > 0, -m).otherwise(0.0)
    return r / (F.col("rank") + 4) + c * cov + o * F.col("support") + bonus + F.when(F.col("strong"), 0.01).otherwise(0.0)


# The same in SQL.
_PAD = "(' ' || all_ || ' ')"
_PHR = lambda w: f"({w} <> '' AND (contains({_PAD}, ' ' || {w} || ' ') OR (NOT {w} LIKE '%s' AND contains({_PAD}, ' ' || {w} || 's '))))"
_ENOUGH = lambda n: f"{n} >= CASE WHEN len(r.terms) <= 2 THEN len(r.terms) ELSE greatest(2, len(r.terms) - 1) END"
_NT = f"len(list_filter(r.terms, lambda t: {_PHR('t')}))"
_NA = "len(list_filter(r.terms, lambda t: list_contains(dt, t) OR (len(t) >= 4 AND len(list_filter(dt, lambda x: len(x) >= 4 AND (starts_with(x, t) OR starts_with(t, x)))) > 0)))"
_CORE = _lst(CORE)


def _found_sql(field: str, col: str) -> str:
    padded, own = f"(' ' || {col} || ' ')", f"string_split({col}, ' ')"
    inside = lambda p: f"contains({padded}, ' ' || {p} || ' ')"
    aliases, said = f"list_filter(c.m.others, lambda o: {inside('o')})", f"list_filter(c.m.ws, lambda w: list_contains({own}, w))"
    cell = lambda how, what, cov: f"{{'field': '{field}', 'how': '{how}', 'said': {what}, 'coverage': {cov}::DOUBLE, 'confidence': {CONFIDENCE[field][how]}::DOUBLE}}"
    return f"WHEN {col} <> '' AND c.m.whole AND {inside('c.m.text')} THEN {cell('phrase', 'c.m.text', '1.0')} WHEN {col} <> '' AND len({aliases}) > 0 THEN {cell('alias', aliases + '[1]', '1.0')} WHEN {col} <> '' AND len({said}) >= c.m.need THEN {cell('token', f'array_to_string({said}, chr(32))', f'len({said}) / len(c.m.ws)')}"


_EV = lambda cs: f"list_transform({cs}, lambda c: {{'c': c, 'h': CASE {_found_sql('title', 't')} {_found_sql('abstract', 'a')} END}})"
_B2 = lambda r, c, o, b, m: f"({r} / (rank + 4) + {c} * CASE WHEN total > 0 THEN 0.50 * covered / total + 0.35 * covered_weight / greatest(1.0, total) + 0.15 * least(1.0, core / 2) ELSE 0 END + {o} * support + CASE WHEN core > 0 THEN {b} WHEN total > 0 THEN -{m} ELSE 0 END + CASE WHEN strong THEN 0.01 ELSE 0 END)"
_W = lambda cells, v: f"coalesce(list_sum(list_transform({cells}, lambda x: {v})), 0)"
READ = f"""{RANKED}, {CONCEPTS},
ab AS (SELECT qid, key, max(abstract) AS abstract, bool_or({STRONG}) AS strong, count(*) AS occ, coalesce(min(rank) FILTER (source IN ('semantic_scholar', 'openalex')), {NEVER}) AS anchor, bool_or(source = 'semantic_scholar') AS is_raw, bool_or(source = 'openalex') AS is_cleaned FROM cand GROUP BY qid, key),
p0 AS (SELECT r.*, ab.* EXCLUDE (qid, key), qc.* EXCLUDE (qid), coalesce(title, '') || ' ' || coalesce(abstract, '') AS full_ FROM ranked r JOIN ab USING (qid, key) JOIN qc USING (qid)),
p1 AS (SELECT *, {_evidence_sql('title')} AS t, {_evidence_sql('abstract')} AS a, {norm('full_')} AS all_, {_tok_sql('full_')} AS dt, {_tok_sql('title')} AS tt, {_tok_sql('abstract')} AS atk, list_distinct(list_concat(qt, xt)) AS both_ FROM p0),
p2 AS (SELECT *, list_filter(raws, lambda r: {_NT} > 0 AND {_ENOUGH(_NT)}) AS cov_raws, list_filter(raws, lambda r: {_PHR(norm('r.text'))} OR (len(r.terms) > 0 AND {_ENOUGH(_NA)})) AS said_raws, {_EV('canon')} AS ev, {_EV('singles')} AS ev1,
  {soft_sql('qt', 'dt')} AS qo, {soft_sql('xt', 'dt')} AS eo, {soft_sql('both_', 'tt')} AS tov, {soft_sql('both_', 'atk')} AS abs FROM p1),
p3 AS (SELECT *, len(raws) AS total, len(cov_raws) AS covered, {_W('cov_raws', 'x.weight')}::DOUBLE AS covered_weight, len(list_filter(cov_raws, lambda r: list_contains({_CORE}, r.kind))) AS core, len(said_raws) / greatest(len(raws), 1) AS pc,
  len(list_filter(said_raws, lambda r: list_contains({_CORE}, r.kind))) / greatest(len(list_filter(raws, lambda r: list_contains({_CORE}, r.kind))), 1) AS cc, list_filter(ev, lambda e: e.h IS NOT NULL) AS hit,
  CASE WHEN len(ev) > 0 THEN {_W('list_filter(ev, lambda e: e.h IS NOT NULL)', 'x.c.weight')} / {_W('ev', 'x.c.weight')} ELSE 0 END::DOUBLE AS cov, CASE WHEN len(ev1) > 0 THEN {_W('list_filter(ev1, lambda e: e.h IS NOT NULL)', 'x.c.weight')} / {_W('ev1', 'x.c.weight')} ELSE 0 END::DOUBLE AS cov1 FROM p2),
p4 AS (SELECT *, 0.28 * qo + 0.25 * eo + 0.22 * tov + 0.15 * pc + 0.07 * cc + 0.03 * abs AS semantic, greatest(0.0, least(1.0, 0.38 * qo + 0.30 * eo + 0.24 * tov + 0.08 * abs)) AS pure,
  CASE WHEN occ >= 2 THEN least(0.05, 0.02 * (occ - 1)) ELSE 0 END + CASE WHEN anchor <= 20 THEN 0.03 WHEN anchor <= 50 THEN 0.015 ELSE 0 END + CASE WHEN is_raw THEN 0.015 ELSE 0 END + CASE WHEN is_cleaned THEN 0.010 ELSE 0 END AS support FROM p3),
feat AS (SELECT *, {_B2(*PRESETS['hybrid'])} AS b2 FROM p4)"""
READ = "RECURSIVE " + READ


@query("J01_constraint_evidence", f"WITH {READ}, e AS (SELECT qid, key, unnest(hit) AS e FROM feat) SELECT qid, key, e.c.id AS id, e.c.kind AS kind, e.h.field AS field, e.h.how AS how, e.h.said AS said, round(e.h.coverage, 9) AS coverage, e.h.confidence AS confidence FROM e")
def j01(spark, d):
    return read(spark, d).select("qid", "key", F.explode("hit").alias("e")).select("qid", "key", "e.id", "e.kind", "e.field", "e.how", "e.said", F.round("e.coverage", 9).alias("coverage"), "e.confidence")


@query("J04_weighted_coverage", f"WITH {READ} SELECT qid, key, {_R('cov', 'cov1')} FROM feat")
def j04(spark, d):
    """Weighted coverage by canonical constraints, and by the plain ones."""
    return read(spark, d).select("qid", "key", *r9("cov", "cov1"))


@query("H01_constraint_coverage", f"WITH {READ} SELECT qid, key, list_transform(cov_raws, lambda r: r.id) AS ids, list_transform(cov_raws, lambda r: r.kind) AS kinds, covered, {_R('covered_weight')}, core FROM feat")
def h01(spark, d):
    return read(spark, d).select("qid", "key", F.transform("cov_raws", lambda r: r["id"]).alias("ids"), F.transform("cov_raws", lambda r: r["kind"]).alias("kinds"),
                                 F.col("covered").cast("bigint").alias("covered"), *r9("covered_weight"), F.col("core").cast("bigint").alias("core"))


_B2S = ", ".join(f"round({_B2(*p)}, 9) AS {k}" for k, p in PRESETS.items())


@query("H02_constraint_rerank", f"""WITH {READ}, s AS (SELECT qid, key, rank, title, core, covered, {_B2S} FROM feat)
SELECT qid, key, conservative, hybrid, coverage_first, row_number() OVER (PARTITION BY qid ORDER BY hybrid DESC, core DESC, covered DESC, rank, {norm('title')}) AS place FROM s""")
def h02(spark, d):
    s = read(spark, d).select("qid", "key", "rank", "title", "core", "covered", *(F.round(b2_score(*p), 9).alias(k) for k, p in PRESETS.items()))
    return place(s, F.desc("hybrid"), F.desc("core"), F.desc("covered"), F.asc("rank"), ascii_words(F.col("title"))).select("qid", "key", *PRESETS, "place")


@query("H03_semantic_features", f"WITH {READ} SELECT qid, key, {_R('qo', 'eo', 'tov', 'abs', 'pc', 'cc', 'semantic')} FROM feat")
def h03(spark, d):
    return read(spark, d).select("qid", "key", *r9("qo", "eo", "tov", "abs", "pc", "cc", "semantic"))


@query("H06_pure_semantic", f"WITH {READ} SELECT qid, key, {_R('pure')} FROM feat")
def h06(spark, d):
    return read(spark, d).select("qid", "key", *r9("pure"))


# Presets of the semantic reranker: rank, constraint, semantic, title, core, low evidence.
B3 = {"conservative": (0.70, 0.15, 0.15, 0.05, 0.03, 0.02), "hybrid": (0.55, 0.15, 0.30, 0.08, 0.05, 0.04), "semantic_first": (0.35, 0.20, 0.45, 0.10, 0.07, 0.06)}
_B3S = lambda k: f"({B3[k][0]} / log2(greatest(2, rank + 1)) + {B3[k][1]} * b2 + {B3[k][2]} * semantic + {B3[k][3]} * tov + {B3[k][4]} * cc - CASE WHEN semantic < 0.08 AND cc = 0 THEN {B3[k][5]} ELSE 0 END + CASE WHEN strong THEN 0.01 ELSE 0 END)"
_B3 = f"{READ}, b3 AS (SELECT *, {_B3S('semantic_first')} AS final FROM feat)"


def b3_score(mode: str) -> Column:
    w = B3[mode]
    final = w[0] / F.log2(F.greatest(F.lit(2), F.col("rank") + 1)) + w[1] * F.col("b2") + w[2] * F.col("semantic") + w[3] * F.col("tov") + w[4] * F.col("cc")
    return final - F.when((F.col("semantic") < 0.08) & (F.col("cc") == 0), w[5]).otherwise(0.0) + F.when(F.col("strong"), 0.01).otherwise(0.0)


def b3(spark, d, mode: str = "semantic_first") -> DataFrame:
    return read(spark, d).withColumn("final", b3_score(mode))


@query("H04_semantic_rerank", f"""WITH {READ}, m AS ({' UNION ALL '.join(f"SELECT qid, key, rank, title, round(semantic, 9) AS sem, '{k}' AS mode, round({_B3S(k)}, 9) AS final FROM feat" for k in B3)})
SELECT qid, key, mode, final, row_number() OVER (PARTITION BY qid, mode ORDER BY final DESC, sem DESC, rank, {norm('title')}) AS place FROM m""")
def h04(spark, d):
    modes = F.array(*[F.struct(F.lit(k).alias("mode"), F.round(b3_score(k), 9).alias("final")) for k in B3])
    m = read(spark, d).select("qid", "key", "rank", "title", F.round("semantic", 9).alias("sem"), F.inline(modes))
    w = Window.partitionBy("qid", "mode").orderBy(F.desc("final"), F.desc("sem"), F.asc("rank"), ascii_words(F.col("title")))
    return m.select("qid", "key", "mode", "final", F.row_number().over(w).alias("place"))


_E = f"""{_B3}, mm AS (SELECT *, min(final) OVER (PARTITION BY qid) AS lo, max(final) OVER (PARTITION BY qid) AS hi FROM b3),
ex AS (SELECT *, CASE WHEN hi > lo THEN greatest(0.0, least(1.0, (final - lo) / (hi - lo))) ELSE 0.5 END AS nb FROM mm)"""


def variants(spark, d) -> DataFrame:
    w = Window.partitionBy("qid")
    e = b3(spark, d).withColumn("lo", F.min("final").over(w)).withColumn("hi", F.max("final").over(w))
    return e.withColumn("nb", F.when(F.col("hi") > F.col("lo"), clamp((F.col("final") - F.col("lo")) / (F.col("hi") - F.col("lo")))).otherwise(0.5))


def variant_scores(alpha: Column) -> list[tuple[str, Column]]:
    """E0 keeps the order it got; E1 blends with plain coverage, E2 with canonical coverage, E3 blends text alone with canonical coverage."""
    c, beta = F.col, 1 - alpha
    return [("E0", -c("rank").cast("double")), ("E1", alpha * c("nb") + beta * c("cov1")), ("E2", alpha * c("nb") + beta * c("cov")), ("E3", alpha * c("pure") + beta * c("cov"))]


_VS = (("E0", "-rank::DOUBLE"), ("E1", "{a} * nb + (1 - {a}) * cov1"), ("E2", "{a} * nb + (1 - {a}) * cov"), ("E3", "{a} * pure + (1 - {a}) * cov"))


@query("H05_evidence_variants", f"""WITH {_E}, v AS ({' UNION ALL '.join(f"SELECT qid, key, rank, '{k}' AS variant, round({s.format(a=0.7)}, 9) AS score FROM ex" for k, s in _VS)})
SELECT qid, key, variant, score, row_number() OVER (PARTITION BY qid, variant ORDER BY score DESC, rank) AS place FROM v""")
def h05(spark, d):
    cells = F.array(*[F.struct(F.lit(k).alias("variant"), F.round(s, 9).alias("score")) for k, s in variant_scores(F.lit(0.7))])
    v = variants(spark, d).select("qid", "key", "rank", F.inline(cells))
    return v.select("qid", "key", "variant", "score", F.row_number().over(Window.partitionBy("qid", "variant").orderBy(F.desc("score"), F.asc("rank"))).alias("place"))


# Worth of a field and of a type as evidence; what one match of a broad entity alone costs.
FIELD_QUALITY, SPECIFIC, BROAD_ALONE = {"title": 1.00, "abstract": 0.92, "concept": 0.78}, {"model_or_entity": 0.82, "topic": 1.00}, 0.15


def evidence_quality() -> Column:
    """Coverage times confidence, field quality and specificity of the matched constraints, less a penalty for one broad entity alone."""
    pick = lambda table, key, other: F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key], F.lit(other))
    w = total_of(F.col("hit"), lambda x: x["weight"])
    mean = lambda f: ratio(total_of(F.col("hit"), lambda x: x["weight"] * f(x)), w)
    made = F.col("cov") * mean(lambda x: x["confidence"] * x["coverage"]) * mean(lambda x: pick(FIELD_QUALITY, x["field"], 0.70)) * mean(lambda x: pick(SPECIFIC, x["kind"], 0.95))
    return clamp(made - F.when((F.size("hit") == 1) & (F.col("hit")[0]["kind"] == "model_or_entity"), BROAD_ALONE).otherwise(0.0))


_MEAN = lambda v: f"CASE WHEN len(hit) > 0 THEN {_W('hit', f'x.c.weight * {v}')} / {_W('hit', 'x.c.weight')} ELSE 0 END"
_CASE = lambda c, table, other: f"(CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + f" ELSE {other} END)"
_QUALITY = f"""greatest(0.0, least(1.0, cov * {_MEAN('x.h.confidence * x.h.coverage')} * {_MEAN(_CASE('x.h.field', FIELD_QUALITY, 0.70))} * {_MEAN(_CASE('x.c.kind', SPECIFIC, 0.95))} - CASE WHEN len(hit) = 1 AND hit[1].c.kind = 'model_or_entity' THEN {BROAD_ALONE} ELSE 0 END))"""


@query("H09_evidence_quality", f"WITH {READ} SELECT qid, key, round({_QUALITY}, 9) AS quality FROM feat")
def h09(spark, d):
    return read(spark, d).select("qid", "key", F.round(evidence_quality(), 9).alias("quality"))


# ---- J06: reasons

# Tag of a type and of a field, and how a field is called.
TYPE_TAG = {k: f"{k}_match" for k in ("model_or_entity", "task_or_modality", "method_or_property", "topic")}
FIELD_NAME = {"title": "paper title", "abstract": "paper abstract", "concept": "OpenAlex concepts"}


def listed(items: Column) -> Column:
    """Items as an English list."""
    n = F.size(items)
    many = F.concat(F.array_join(F.slice(items, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(", and "), F.element_at(items, -1))
    return F.when(n == 0, "").when(n == 1, items[0]).when(n == 2, F.array_join(items, " and ")).otherwise(many)


def reasons() -> list[Column]:
    """tags, text, matched, unmatched of a candidate's evidence."""
    hit, n, total = F.col("hit"), F.size("hit"), F.size("ev")
    tag = F.create_map(*[F.lit(x) for kv in TYPE_TAG.items() for x in kv])
    fields = F.filter(F.array(*map(F.lit, FIELD_NAME)), lambda f: F.exists(hit, lambda e: e["field"] == f))
    called = F.create_map(*[F.lit(x) for kv in FIELD_NAME.items() for x in kv])
    tags = F.concat(F.array_distinct(F.array_compact(F.transform(hit, lambda e: tag[e["kind"]]))), F.transform(fields, lambda f: F.concat(f, F.lit("_evidence"))))
    names = listed(F.transform(hit, lambda e: F.concat(F.lit("“"), e["text"], F.lit("”"))))
    opening = F.when(n == 1, F.concat(F.lit("Matches the query constraint "), names)).when(n == 2, F.concat(F.lit("Matches the query constraints "), names)).otherwise(
        F.concat(F.lit("Matches "), n, F.lit(" of "), total, F.lit(" query constraints, including "), names))
    text = F.concat(opening, F.lit("; supporting evidence is present in the "), listed(F.transform(fields, lambda f: called[f])), F.lit("."))
    text = F.when(total == 0, "").when(n == 0, "No verifiable constraint-matching evidence was found.").otherwise(text)
    return [tags.alias("tags"), text.alias("reason"), F.transform(hit, lambda e: e["text"]).alias("matched"), F.transform(F.filter("ev", lambda e: e["how"].isNull()), lambda e: e["text"]).alias("unmatched")]


_LISTED = lambda xs: f"CASE len({xs}) WHEN 0 THEN '' WHEN 1 THEN {xs}[1] WHEN 2 THEN {xs}[1] || ' and ' || {xs}[2] ELSE array_to_string({xs}[1:len({xs}) - 1], ', ') || ', and ' || {xs}[-1] END"
_REASONS = f"""rs0 AS (SELECT *, list_filter({_lst(FIELD_NAME)}, lambda f: len(list_filter(hit, lambda e: e.h.field = f)) > 0) AS fields, list_transform(hit, lambda e: '“' || e.c.m.text || '”') AS names FROM feat),
rs AS (SELECT *, list_concat(list_distinct(list_filter(list_transform(hit, lambda e: {_CASE('e.c.kind', {k: f"'{v}'" for k, v in TYPE_TAG.items()}, 'NULL')}), lambda x: x IS NOT NULL)), list_transform(fields, lambda f: f || '_evidence')) AS tags,
  CASE WHEN len(ev) = 0 THEN '' WHEN len(hit) = 0 THEN 'No verifiable constraint-matching evidence was found.' ELSE CASE WHEN len(hit) = 1 THEN 'Matches the query constraint ' WHEN len(hit) = 2 THEN 'Matches the query constraints ' ELSE 'Matches ' || len(hit) || ' of ' || len(ev) || ' query constraints, including ' END
  || {_LISTED('names')} || '; supporting evidence is present in the ' || {_LISTED(f"list_transform(fields, lambda f: {_CASE('f', {k: repr(v) for k, v in FIELD_NAME.items()}, 'NULL')})")} || '.' END AS reason,
  list_transform(hit, lambda e: e.c.m.text) AS matched, list_transform(list_filter(ev, lambda e: e.h IS NULL), lambda e: e.c.m.text) AS unmatched FROM rs0)"""


@query("J06_reasons", f"WITH {READ}, {_REASONS.replace('rs0 AS', 'rz0 AS').replace('FROM rs0)', 'FROM rz0)').replace('rs AS', 'rz AS')} SELECT qid, key, list_sort(tags) AS tags, reason, matched, unmatched FROM rz")
def j06(spark, d):
    return read(spark, d).select("qid", "key", *reasons()).withColumn("tags", F.array_sort("tags"))


_RZ = _REASONS.replace("rs0 AS", "rz0 AS").replace("FROM rs0)", "FROM rz0)").replace("rs AS", "rz AS")


@query("H07_flagship", f"""WITH {READ}, {_RZ}, s AS (SELECT qid, key, rank, round(pure, 9) AS score, list_sort(tags) AS tags, reason FROM rz)
SELECT * FROM (SELECT qid, key, score, tags, reason, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rank) AS place FROM s) WHERE place <= 20""")
def h07(spark, d):
    """Search of every question over its candidates: rerank by text semantics, attach evidence and a reason, keep 20."""
    s = read(spark, d).select("qid", "key", "rank", F.round("pure", 9).alias("score"), *reasons())
    kept = place(s, F.desc("score"), F.asc("rank")).where("place <= 20")
    return kept.select("qid", "key", "score", F.array_sort("tags").alias("tags"), "reason", "place")


@query("J07_evidence_rates", f"""WITH {READ}, k AS (SELECT unnest([20, 50, 100]) AS k) SELECT k, count(*) AS papers, count(*) FILTER (len(ev) > 0) AS eligible, sum(len(ev))::BIGINT AS constraints, sum(len(hit))::BIGINT AS matched, round(sum(len(hit)) / sum(len(ev)), 9) AS match_rate,
  round(count(*) FILTER (len(hit) > 0) / count(*) FILTER (len(ev) > 0), 9) AS support_rate, round(count(*) FILTER (coalesce(abstract, '') <> '') / count(*), 9) AS abstract_rate FROM feat JOIN k ON rank <= k GROUP BY k""")
def j07(spark, d):
    c = read(spark, d).select("rank", F.size("ev").alias("n"), F.size("hit").alias("h"), (F.coalesce("abstract", F.lit("")) != "").alias("told"))
    c = c.withColumn("k", F.explode(F.array(F.lit(20), F.lit(50), F.lit(100)))).where("rank <= k")
    some = F.count_if(F.col("n") > 0)
    return c.groupBy("k").agg(F.count("*").alias("papers"), some.alias("eligible"), F.sum("n").alias("constraints"), F.sum("h").alias("matched"), F.round(F.sum("h") / F.sum("n"), 9).alias("match_rate"),
                              F.round(F.count_if(F.col("h") > 0) / some, 9).alias("support_rate"), F.round(F.count_if("told") / F.count("*"), 9).alias("abstract_rate"))


# ---- J02, J03, J05, J08, J09


def canonical(spark, d) -> DataFrame:
    asked = asked_questions(spark, d)
    return canonical_constraints(asked, plain_constraints(spark, d))


_CANP = f"RECURSIVE {CANON}"


@query("J02_phrase_eligibility", f"WITH {_CANP} SELECT row_id, CAST(n AS INTEGER) AS n, text, NOT list_contains({_GEN}, text) AS eligible FROM can")
def j02(spark, d):
    """Whether a canonical constraint may be looked for as a phrase: one broad word may not."""
    return canonical(spark, d).select("row_id", "n", "text", (~F.col("text").isin(*L.EVIDENCE_GENERIC)).alias("eligible"))


@query("J03_needed_tokens", f"WITH {_CANP}, t AS (SELECT row_id, n, text, len(list_distinct(string_split(text, ' '))) AS k FROM can) SELECT row_id, CAST(n AS INTEGER) AS n, CAST(k AS INTEGER) AS words, CASE WHEN list_contains({_GEN}, text) THEN NULL WHEN k <= 2 THEN k ELSE greatest(2, ceil(0.8 * k)) END::INTEGER AS needed FROM t")
def j03(spark, d):
    """How many distinct words of a canonical constraint a text must have; none will do for one broad word."""
    n = F.size(F.array_distinct(F.split("text", " ")))
    return canonical(spark, d).select("row_id", "n", n.alias("words"), F.when(~F.col("text").isin(*L.EVIDENCE_GENERIC), needed(n)).alias("needed"))


@query("J05_raw_constraints", f"WITH {_CANP} SELECT row_id, 'raw' || (idx + 1) || '_' || id AS id, {_peeled_expr('text')} AS text FROM ci WHERE {_peeled_expr('text')} <> ''")
def j05(spark, d):
    """Constraints as they are, repeated ones too, made ready to be matched."""
    c = plain_constraints(spark, d).withColumn("id", constraint_id())
    return c.select("row_id", F.concat(F.lit("raw"), F.col("idx") + 1, F.lit("_"), "id").alias("id"), peeled(F.col("text")).alias("text")).where("text <> ''")


_AUDIT = f"""{READ}, {_REL.split(RANKED + ', ')[1]}, au AS (SELECT f.qid, f.key, f.rank, CASE WHEN rel = 1 THEN 'TP' ELSE 'FP' END AS label, len(hit) AS m, len(ev) AS n, CASE WHEN len(ev) > 0 THEN len(hit) / len(ev) ELSE 0 END AS raw_cov, cov,
  CASE WHEN len(hit) > 0 THEN {_W('hit', 'x.h.confidence')} / len(hit) ELSE 0 END AS conf, len(hit) = 1 AND hit[1].c.kind = 'model_or_entity' AS broad, len(hit) > 0 AND len(list_filter(hit, lambda e: e.h.field <> 'title')) = 0 AS title_only
  FROM feat f JOIN rel ON rel.qid = f.qid AND rel.rank = f.rank)"""
_BUCKET = "CASE WHEN n <= 0 THEN 'no_constraints' WHEN m <= 0 THEN '0/N' WHEN m = 1 THEN '1/N' WHEN m = 2 THEN '2/N' ELSE '3+/N' END"


def audited(spark, d) -> DataFrame:
    """One row a candidate: hit or miss, and what its evidence is like."""
    f = read(spark, d).join(labelled(spark, d).select("qid", "rank", "rel"), ["qid", "rank"])
    hit = F.col("hit")
    return f.select("qid", "key", "rank", F.when(F.col("rel") == 1, "TP").otherwise("FP").alias("label"), F.size(hit).alias("m"), F.size("ev").alias("n"), ratio(F.size(hit), F.size("ev")).alias("raw_cov"), "cov",
                    ratio(total_of(hit, lambda x: x["confidence"]), F.size(hit)).alias("conf"), ((F.size(hit) == 1) & F.coalesce(hit[0]["kind"] == "model_or_entity", F.lit(False))).alias("broad"),
                    ((F.size(hit) > 0) & ~F.exists(hit, lambda e: e["field"] != "title")).alias("title_only"))


@query("J08_evidence_audit", f"""WITH {_AUDIT} SELECT label, {_BUCKET} AS bucket, count(*) AS papers, round(avg(raw_cov), 9) AS raw_cov, round(avg(cov), 9) AS cov, round(median(cov), 9) AS median_cov, round(avg(conf), 9) AS conf, count(*) FILTER (broad) AS broad, count(*) FILTER (title_only) AS title_only FROM au GROUP BY GROUPING SETS ((label), (label, {_BUCKET}))""")
def j08(spark, d):
    """Evidence of hits against misses, in all (bucket null) and by how many constraints match."""
    m, n = F.col("m"), F.col("n")
    bucket = F.when(n <= 0, "no_constraints").when(m <= 0, "0/N").when(m == 1, "1/N").when(m == 2, "2/N").otherwise("3+/N")
    a = audited(spark, d).withColumn("bucket", bucket)
    figures = [F.count("*").alias("papers"), *(F.round(F.avg(c), 9).alias(c) for c in ("raw_cov", "cov")), F.round(F.median("cov"), 9).alias("median_cov"), F.round(F.avg("conf"), 9).alias("conf"),
               F.count_if("broad").alias("broad"), F.count_if("title_only").alias("title_only")]
    return a.groupBy("label").agg(*figures).withColumn("bucket", F.lit(None).cast("string")).unionByName(a.groupBy("label", "bucket").agg(*figures))


# Limits of the audit's decision.
LIMITS = {"suspicious": 0.20, "queries": 0.30, "delta": 0.05, "ratio": 1.20, "broad": 0.05}
_SUS = f"""sus AS (SELECT row_id, count(*) AS n, count(*) FILTER (len(reasons) > 0) AS bad FROM (SELECT row_id, {_SUSPECT} AS reasons FROM (SELECT row_id, text, kind, string_split({norm('text')}, ' ') AS ws, len(string_split({norm('text')}, ' ')) AS n FROM can)) GROUP BY row_id)"""


@query("J08_audit_decision", f"""WITH {_AUDIT}, {_SUS}, s AS (SELECT round(sum(bad) / sum(n), 9) AS suspicious, round(count(*) FILTER (bad > 0) / (SELECT count(*) FROM qc), 9) AS queries FROM sus),
l AS (SELECT round(coalesce(avg(cov) FILTER (label = 'TP'), 0), 9) AS tp_cov, round(coalesce(avg(cov) FILTER (label = 'FP'), 0), 9) AS fp_cov, round(coalesce(avg(broad::INTEGER) FILTER (label = 'TP'), 0), 9) AS tp_broad, round(coalesce(avg(broad::INTEGER) FILTER (label = 'FP'), 0), 9) AS fp_broad FROM au)
SELECT *, CASE WHEN suspicious > {LIMITS['suspicious']} OR queries > {LIMITS['queries']} THEN 'repair_constraint_decomposition_first' WHEN tp_cov - fp_cov >= {LIMITS['delta']} AND (fp_cov = 0 OR tp_cov / fp_cov >= {LIMITS['ratio']}) AND fp_broad - tp_broad >= {LIMITS['broad']} THEN 'proceed_to_comprehensive_score_ablation' ELSE 'repair_constraint_evidence_first' END AS status FROM s, l""")
def j08_decision(spark, d):
    asked = questions(spark, d).withColumnRenamed("qid", "row_id")
    c = canonical_constraints(asked, constraints_of(asked)).withColumn("bad", (F.size(suspicions(F.col("text"), F.col("kind"))) > 0).cast("int"))
    per = asked.select("row_id").join(c.groupBy("row_id").agg(F.count("*").alias("n"), F.sum("bad").alias("bad")), "row_id", "left").fillna(0, ["n", "bad"])
    s = per.agg(F.round(F.sum("bad") / F.sum("n"), 9).alias("suspicious"), F.round(F.count_if(F.col("bad") > 0) / F.count("*"), 9).alias("queries"))
    mean = lambda label, x: F.round(F.coalesce(F.avg(F.when(F.col("label") == label, x)), F.lit(0.0)), 9)
    a = audited(spark, d).agg(mean("TP", F.col("cov")).alias("tp_cov"), mean("FP", F.col("cov")).alias("fp_cov"), mean("TP", F.col("broad").cast("int")).alias("tp_broad"), mean("FP", F.col("broad").cast("int")).alias("fp_broad"))
    both = s.join(F.broadcast(a))
    c = F.col
    tells = (c("tp_cov") - c("fp_cov") >= LIMITS["delta"]) & ((c("fp_cov") == 0) | (c("tp_cov") / c("fp_cov") >= LIMITS["ratio"])) & (c("fp_broad") - c("tp_broad") >= LIMITS["broad"])
    unstable = (c("suspicious") > LIMITS["suspicious"]) | (c("queries") > LIMITS["queries"])
    return both.withColumn("status", F.when(unstable, "repair_constraint_decomposition_first").when(tells, "proceed_to_comprehensive_score_ablation").otherwise("repair_constraint_evidence_first"))


@query("J09_repair_regression", f"""WITH {_AUDIT} SELECT (SELECT count(*) FROM can) AS constraints, (SELECT count(*) FROM can WHERE {_fragment_sql(norm('text'))}) AS fragments, round((SELECT count(*) FROM can WHERE {_fragment_sql(norm('text'))}) / (SELECT count(*) FROM can), 9) AS fragment_rate,
  round(avg(cov) FILTER (label = 'TP'), 9) AS tp_cov, round(avg(cov) FILTER (label = 'FP'), 9) AS fp_cov, round(avg(cov) FILTER (label = 'TP') - avg(cov) FILTER (label = 'FP'), 9) AS delta FROM au""")
def j09(spark, d):
    asked = questions(spark, d).withColumnRenamed("qid", "row_id")
    bad = is_fragment(ascii_words(F.col("text")))
    c = canonical_constraints(asked, constraints_of(asked)).agg(F.count("*").alias("constraints"), F.count_if(bad).alias("fragments"), F.round(F.count_if(bad) / F.count("*"), 9).alias("fragment_rate"))
    tp, fp = (F.avg(F.when(F.col("label") == x, F.col("cov"))) for x in ("TP", "FP"))
    return c.join(F.broadcast(audited(spark, d).agg(F.round(tp, 9).alias("tp_cov"), F.round(fp, 9).alias("fp_cov"), F.round(tp - fp, 9).alias("delta"))))


# ---- selection

# Selector presets: semantic, rank, constraint, core, title; thresholds of the labels; least and most results.
SELECTOR = {
    "ranking": (0.40, 0.30, 0.15, 0.10, 0.05, 0.70, 0.48, 0.28, 100, 100), "balanced": (0.45, 0.25, 0.15, 0.10, 0.05, 0.68, 0.44, 0.26, 20, 100),
    "precision": (0.52, 0.18, 0.14, 0.11, 0.05, 0.72, 0.52, 0.34, 8, 60), "recall_safe": (0.38, 0.36, 0.14, 0.08, 0.04, 0.70, 0.46, 0.22, 50, 100),
}
_SEL_ROWS = [dict(zip(("mode", "ws", "wr", "wb", "wc", "wt", "hi_", "mid_", "low_", "least_", "most_"), (k, *v))) for k, v in SELECTOR.items()]
_SEMEV = "greatest(0.0, least(1.0, 0.42 * semantic + 0.22 * tov + 0.16 * eo + 0.10 * abs + 0.10 * pc))"
_B2EV = "greatest(0.0, least(1.0, 0.55 * b2 + 0.25 * least(1.0, covered / 4) + 0.20 * least(1.0, covered_weight / 5)))"
_COEV = "greatest(0.0, least(1.0, 0.60 * least(1.0, core / 2) + 0.40 * cc))"
_SEL = f"""{_B3}, sv AS (SELECT *, {_SEMEV} AS sev, {_COEV} AS cev, {_B2EV} AS bev, 1 / (1 + rank / 10) AS rev FROM b3),
sl0 AS (SELECT sv.*, m.*, round(greatest(0.0, least(1.0, ws * sev + wr * rev + wb * bev + wc * cev + wt * least(1.0, tov) + CASE WHEN strong THEN 0.015 ELSE 0 END
  - CASE WHEN sev < 0.04 AND cev = 0 THEN 0.06 WHEN sev < 0.08 AND cev = 0 THEN 0.03 ELSE 0 END)), 9) AS sel FROM sv CROSS JOIN (SELECT unnest({_table_sql(_SEL_ROWS)}, recursive := true)) m),
sl AS (SELECT *, CASE WHEN sel >= hi_ THEN 'highly_relevant' WHEN sel >= mid_ THEN 'partially_relevant' WHEN sel >= low_ THEN 'weakly_relevant' ELSE 'low_relevance' END AS label FROM sl0)"""


def selector(spark, d, *modes: str) -> DataFrame:
    """Every candidate scored and labelled under each preset."""
    c = F.col
    f = b3(spark, d)
    f = f.select("*", clamp(0.42 * c("semantic") + 0.22 * c("tov") + 0.16 * c("eo") + 0.10 * c("abs") + 0.10 * c("pc")).alias("sev"), (1 / (1 + c("rank") / 10)).alias("rev"),
                 clamp(0.55 * c("b2") + 0.25 * F.least(F.lit(1.0), c("covered") / 4) + 0.20 * F.least(F.lit(1.0), c("covered_weight") / 5)).alias("bev"),
                 clamp(0.60 * F.least(F.lit(1.0), c("core") / 2) + 0.40 * c("cc")).alias("cev"), F.inline(_table([r for r in _SEL_ROWS if not modes or r["mode"] in modes])))
    score = c("ws") * c("sev") + c("wr") * c("rev") + c("wb") * c("bev") + c("wc") * c("cev") + c("wt") * F.least(F.lit(1.0), c("tov")) + F.when(c("strong"), 0.015).otherwise(0.0)
    score = score - F.when((c("sev") < 0.04) & (c("cev") == 0), 0.06).when((c("sev") < 0.08) & (c("cev") == 0), 0.03).otherwise(0.0)
    f = f.withColumn("sel", F.round(clamp(score), 9))
    label = F.when(c("sel") >= c("hi_"), "highly_relevant").when(c("sel") >= c("mid_"), "partially_relevant").when(c("sel") >= c("low_"), "weakly_relevant").otherwise("low_relevance")
    return f.withColumn("label", label)


@query("I04_selector_score", f"WITH {_SEL} SELECT qid, key, mode, sel, label FROM sl")
def i04(spark, d):
    return selector(spark, d).select("qid", "key", "mode", "sel", "label")


def refilled(df: DataFrame, wanted: Column, fill: list[Column], allowed: Column | None = None) -> DataFrame:
    """Per (qid, mode): the wanted rows and, up to ``least_`` rows in all, the first others that are allowed, in the order of ``fill``."""
    df = df.withColumn("wanted", wanted)
    if allowed is not None:
        df = df.where(F.col("wanted") | allowed)
    df = df.withColumn("have", F.count_if("wanted").over(Window.partitionBy("qid", "mode"))).withColumn("n", F.row_number().over(Window.partitionBy("qid", "mode", "wanted").orderBy(*fill)))
    return df.where(F.col("wanted") | (F.col("n") <= F.col("least_") - F.col("have")))


def cut(df: DataFrame, *order: Column) -> DataFrame:
    """``place`` within (qid, mode), and no more than ``most_`` rows."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy("qid", "mode").orderBy(*order))).where(F.col("place") <= F.col("most_"))


_WANT = "CASE mode WHEN 'ranking' THEN true WHEN 'precision' THEN label IN ('highly_relevant', 'partially_relevant') ELSE label <> 'low_relevance' END"


@query("I05_selector_modes", f"""WITH {_SEL}, w AS (SELECT *, {_WANT} AS wanted, round(final, 9) AS fin, {norm('title')} AS tn FROM sl),
n AS (SELECT *, count(*) FILTER (wanted) OVER (PARTITION BY qid, mode) AS have, row_number() OVER (PARTITION BY qid, mode, wanted ORDER BY sel DESC, fin DESC, rank, tn) AS n FROM w)
SELECT qid, key, mode, label, place FROM (SELECT *, row_number() OVER (PARTITION BY qid, mode ORDER BY wanted DESC, sel DESC, fin DESC, rank, tn) AS place FROM n WHERE wanted OR n <= least_ - have) WHERE place <= most_""")
def i05(spark, d):
    """Four modes: the labels that a mode wants, filled up with the best others to its least number."""
    label, mode = F.col("label"), F.col("mode")
    wanted = F.when(mode == "ranking", True).when(mode == "precision", label.isin("highly_relevant", "partially_relevant")).otherwise(label != "low_relevance")
    order = [F.desc("sel"), F.desc(F.round("final", 9)), F.asc("rank"), ascii_words(F.col("title"))]
    return cut(refilled(selector(spark, d), wanted, order), F.desc("wanted"), *order).select("qid", "key", "mode", "label", "place")


# What labels and tags are called in the explanation.
LABEL_TEXT = {"highly_relevant": "高度相关", "partially_relevant": "部分相关", "weakly_relevant": "弱相关", "low_relevance": "低相关"}
TAG_TEXT = {
    "semantic_score_high": "语义相似度较高", "semantic_score_medium": "语义相似度中等", "title_matches_query": "标题与查询关键词/短语匹配", "core_constraints_covered": "覆盖核心约束", "partial_core_constraint_coverage": "覆盖部分核心约束",
    "constraint_coverage_supported": "约束覆盖分提供支持", "ranked_high_by_previous_reranker": "前序Reranker排序较靠前", "strong_identifier_available": "具有强标识符",
    "low_semantic_evidence": "语义证据偏弱", "weak_title_match": "标题匹配较弱", "missing_core_constraints": "核心约束覆盖不足",
}
_TAGS = [("round(sev, 9) >= 0.18", "semantic_score_high"), ("round(sev, 9) >= 0.10 AND round(sev, 9) < 0.18", "semantic_score_medium"), ("round(tov, 9) >= 0.20", "title_matches_query"), ("round(cev, 9) >= 0.50", "core_constraints_covered"),
         ("cev > 0 AND round(cev, 9) < 0.50", "partial_core_constraint_coverage"), ("round(bev, 9) >= 0.30", "constraint_coverage_supported"), ("round(rev, 9) >= 0.40", "ranked_high_by_previous_reranker"), ("strong", "strong_identifier_available")]
_LACKS = [("round(sev, 9) < 0.10", "low_semantic_evidence"), ("round(tov, 9) <= 0.04", "weak_title_match"), ("cev <= 0", "missing_core_constraints")]


def _flags(rules) -> Column:
    return F.array_compact(F.array(*[F.when(F.expr(w), F.lit(t)) for w, t in rules]))


_FLAGS = lambda rules: "list_filter([" + ", ".join(f"CASE WHEN {w} THEN '{t}' END" for w, t in rules) + "], lambda x: x IS NOT NULL)"
_TOLD = lambda xs, n: f"array_to_string(list_transform({xs}[1:{n}], lambda x: {_CASE('x', {k: repr(v) for k, v in TAG_TEXT.items()}, 'x')}), '; ')"


@query("I06_selector_tags", f"""WITH {_SEL}, g AS (SELECT qid, key, label, {_FLAGS(_TAGS)} AS tags, {_FLAGS(_LACKS)} AS lacks FROM sl WHERE mode = 'balanced')
SELECT qid, key, tags, lacks, {_CASE('label', {k: repr(v) for k, v in LABEL_TEXT.items()}, 'label')} || '：' || CASE WHEN len(tags) > 0 AND len(lacks) > 0 THEN {_TOLD('tags', 4)} || '；但' || {_TOLD('lacks', 2)} WHEN len(tags) > 0 THEN {_TOLD('tags', 4)} WHEN len(lacks) > 0 THEN {_TOLD('lacks', 2)} ELSE '证据不足' END || '。' AS reason FROM g""")
def i06(spark, d):
    g = selector(spark, d, "balanced").select("qid", "key", "label", _flags(_TAGS).alias("tags"), _flags(_LACKS).alias("lacks"))
    name = lambda table: F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    told = lambda xs, n: F.array_join(F.transform(F.slice(xs, 1, n), lambda x: name(TAG_TEXT)[x]), "; ")
    good, bad = F.size("tags") > 0, F.size("lacks") > 0
    body = F.when(good & bad, F.concat(told("tags", 4), F.lit("；但"), told("lacks", 2))).when(good, told("tags", 4)).when(bad, told("lacks", 2)).otherwise("证据不足")
    return g.select("qid", "key", "tags", "lacks", F.concat(name(LABEL_TEXT)[F.col("label")], F.lit("："), body, F.lit("。")).alias("reason"))


# ---- guard

# Guard presets: violations reject, rejects are dropped, downranked are dropped, least score, most and least results, weight of the score, cost of a violation and of a missing condition.
GUARD = {
    "annotate": (False, False, False, 0.0, 100, 100, 0.20, 0.35, 0.08), "balanced": (True, True, False, 0.25, 100, 15, 0.26, 0.45, 0.10),
    "precision": (True, True, True, 0.45, 50, 0, 0.32, 0.60, 0.13), "recall_safe": (True, False, False, 0.12, 100, 50, 0.18, 0.30, 0.06),
}
_GUARD_ROWS = [dict(zip(("mode", "rejects", "drop_reject", "drop_down", "least_score", "most_", "least_", "gw", "vp", "mp"), (k, *v))) for k, v in GUARD.items()]
_GROW_SQL = "[" + ", ".join("{" + ", ".join(f"'{k}': {repr(v) if isinstance(v, str) else str(v).lower()}" for k, v in r.items()) + "}" for r in _GUARD_ROWS) + "]"
DECISION_TEXT = {"pass": "通过硬约束校验", "soft_pass": "部分通过硬约束校验", "downrank": "硬约束证据不足，建议降权", "reject": "违反硬约束，建议过滤"}


def judged(spark, d, base: DataFrame | None = None, *modes: str) -> DataFrame:
    """Every candidate's verdicts and decision under each guard preset; ``base`` has qid, key, rank, title, abstract, rules and a score ``final``."""
    b = base if base is not None else b3(spark, d)
    own = G.text_of(F.coalesce("title", F.lit("")))
    full = G.text_of(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit(""))))
    b = b.select("*", own.alias("gt"), full.alias("gf"))
    b = b.select("*", G.verdicts(F.col("rules"), G.padded(F.col("gt")), G.padded(F.col("gf"))).alias("vs"))
    good, bad = F.filter("vs", lambda v: v["ok"]), F.filter("vs", lambda v: ~v["ok"])
    lack = lambda v: F.when(v["kind"] == "exclusion", v["label"]).otherwise(F.concat(v["label"], F.lit("｜缺失："), F.array_join(v["missing"], "; ")))
    tags = F.flatten(F.transform(good, lambda v: F.concat(F.array(F.concat(F.lit("satisfy_"), v["id"])), F.transform(v["hits"], lambda h: F.concat(F.lit("evidence_"), v["id"], F.lit(":"), h)))))
    b = b.select("*", F.transform(good, lambda v: v["label"]).alias("satisfied"), F.transform(bad, lack).alias("missing"), F.transform(F.filter(bad, lambda v: v["kind"] == "exclusion"), lambda v: F.concat(F.lit("violates_"), v["id"])).alias("violations"),
                 F.when(F.size("vs") == 0, F.array(F.lit("no_explicit_hard_constraint"))).otherwise(tags).alias("gtags"),
                 F.when(F.size("vs") == 0, 1.0).otherwise(ratio(total_of(good, lambda v: v["weight"]), total_of(F.col("vs"), lambda v: v["weight"]))).alias("gscore"),
                 F.inline(_table([r for r in _GUARD_ROWS if not modes or r["mode"] in modes])))
    c = F.col
    decision = F.when(F.size("vs") == 0, "pass").when((F.size("violations") > 0) & c("rejects"), "reject").when((c("gscore") >= 0.75) & (F.size("missing") == 0), "pass")
    b = b.withColumn("decision", decision.when(c("gscore") >= c("least_score"), "soft_pass").otherwise("downrank"))
    return b.withColumn("gfinal", c("final") + c("gw") * c("gscore") - c("vp") * F.size("violations") - c("mp") * F.size("missing"))


_JUDGED = f"""gj0 AS (SELECT *, ' ' || {G.text_sql("coalesce(title, '')")} || ' ' AS gt, ' ' || {G.text_sql("(coalesce(title, '') || ' ' || coalesce(abstract, ''))")} || ' ' AS gf FROM b3),
gj1 AS (SELECT *, {G.verdicts_sql('rules', 'gt', 'gf')} AS vs FROM gj0),
gj2 AS (SELECT *, list_filter(vs, lambda v: v.ok) AS good, list_filter(vs, lambda v: NOT v.ok) AS bad FROM gj1),
gj3 AS (SELECT gj2.*, g.*, list_transform(good, lambda v: v.label) AS satisfied, list_transform(bad, lambda v: CASE WHEN v.kind = 'exclusion' THEN v.label ELSE v.label || '｜缺失：' || array_to_string(v.missing, '; ') END) AS missing,
  list_transform(list_filter(bad, lambda v: v.kind = 'exclusion'), lambda v: 'violates_' || v.id) AS violations, CASE WHEN len(vs) = 0 THEN ['no_explicit_hard_constraint'] ELSE flatten(list_transform(good, lambda v: list_concat(['satisfy_' || v.id], list_transform(v.hits, lambda h: 'evidence_' || v.id || ':' || h)))) END AS gtags,
  CASE WHEN len(vs) = 0 THEN 1.0 ELSE {_W('good', 'x.weight')} / {_W('vs', 'x.weight')} END::DOUBLE AS gscore FROM gj2 CROSS JOIN (SELECT unnest({_GROW_SQL}, recursive := true)) g),
gj AS (SELECT *, CASE WHEN len(vs) = 0 THEN 'pass' WHEN len(violations) > 0 AND rejects THEN 'reject' WHEN gscore >= 0.75 AND len(missing) = 0 THEN 'pass' WHEN gscore >= least_score THEN 'soft_pass' ELSE 'downrank' END AS decision,
  final + gw * gscore - vp * len(violations) - mp * len(missing) AS gfinal FROM gj3)"""
_GJ = f"{_B3}, {_JUDGED}"


@query("E20_guard_constraints", f"WITH {_QQ}, a AS (SELECT row_id, {G.asked_sql('question')} AS rules FROM q) SELECT row_id AS qid, list_transform(rules, lambda i: ({_lst(r.id for r in G.RULES)})[i + 1]) AS rules FROM a")
def e20(spark, d):
    """The hard conditions that each question states, in the order of the rules."""
    ids = F.array(*[F.lit(r.id) for r in G.RULES])
    q = questions(spark, d).select("qid", G.asked_rules(F.col("question")).alias("rules"))
    return q.select("qid", F.transform("rules", lambda i: ids[i]).alias("rules"))


@query("I01_guard", f"WITH {_GJ} SELECT qid, key, round(gscore, 9) AS gscore, decision, satisfied, missing, violations, gtags FROM gj WHERE mode = 'balanced'")
def i01(spark, d):
    return judged(spark, d, None, "balanced").select("qid", "key", *r9("gscore"), "decision", "satisfied", "missing", "violations", "gtags")


@query("I02_guard_score", f"WITH {_GJ} SELECT qid, key, mode, {_R('gfinal')} FROM gj")
def i02(spark, d):
    return judged(spark, d).select("qid", "key", "mode", *r9("gfinal"))


@query("I03_guard_filter", f"""WITH {_GJ}, w AS (SELECT *, CASE WHEN mode = 'annotate' THEN true ELSE NOT (drop_reject AND decision = 'reject') AND NOT (drop_down AND decision = 'downrank') AND NOT (drop_down AND len(vs) > 0 AND gscore < least_score) END AS wanted, NOT (drop_reject AND decision = 'reject') AS allowed FROM gj),
n AS (SELECT *, count(*) FILTER (wanted) OVER (PARTITION BY qid, mode) AS have, row_number() OVER (PARTITION BY qid, mode, wanted ORDER BY rank) AS n FROM w WHERE wanted OR allowed)
SELECT qid, key, mode, decision, place FROM (SELECT *, row_number() OVER (PARTITION BY qid, mode ORDER BY round(gfinal, 9) DESC, round(gscore, 9) DESC, lower(title), rank) AS place FROM n WHERE wanted OR n <= least_ - have) WHERE place <= most_""")
def i03(spark, d):
    """Four modes: what a mode keeps, filled up in the given order to its least number without rejected ones, then sorted."""
    c = F.col
    rejected = c("drop_reject") & (c("decision") == "reject")
    wanted = F.when(c("mode") == "annotate", True).otherwise(~rejected & ~(c("drop_down") & (c("decision") == "downrank")) & ~(c("drop_down") & (F.size("vs") > 0) & (c("gscore") < c("least_score"))))
    kept = refilled(judged(spark, d), wanted, [F.asc("rank")], ~rejected)
    return cut(kept, F.desc(F.round("gfinal", 9)), F.desc(F.round("gscore", 9)), F.asc(F.lower("title")), F.asc("rank")).select("qid", "key", "mode", "decision", "place")


def guard_reason() -> Column:
    """The guard's verdict in words, with the first three conditions of each kind."""
    some = lambda name, c: F.when(F.size(c) > 0, F.concat(F.lit(name), F.array_join(F.slice(c, 1, 3), "；")))
    told = F.create_map(*[F.lit(x) for kv in DECISION_TEXT.items() for x in kv])[F.col("decision")]
    parts = F.concat_ws("。", F.concat(told, F.lit("，规则分="), F.format_string("%.3f", F.col("gscore"))), some("满足：", "satisfied"), some("缺失：", "missing"), some("违规：", "violations"))
    return F.when(F.size("vs") == 0, "未检测到明确硬约束，保持原排序证据。").otherwise(F.concat(parts, F.lit("。")))


_SOME = lambda name, c: f"CASE WHEN len({c}) > 0 THEN '{name}' || array_to_string({c}[1:3], '；') END"
_GREASON = f"CASE WHEN len(vs) = 0 THEN '未检测到明确硬约束，保持原排序证据。' ELSE concat_ws('。', {_CASE('decision', {k: repr(v) for k, v in DECISION_TEXT.items()}, 'decision')} || '，规则分=' || printf('%.3f', gscore), {_SOME('满足：', 'satisfied')}, {_SOME('缺失：', 'missing')}, {_SOME('违规：', 'violations')}) || '。' END"


@query("Q11_guard_text", f"WITH {_GJ} SELECT qid, key, {_GREASON} AS text FROM gj WHERE mode = 'balanced'")
def q11(spark, d):
    return judged(spark, d, None, "balanced").select("qid", "key", guard_reason().alias("text"))


# Presets that join selector and guard: weights of selector, guard and guard's final score; bonus of pass and soft pass; cost of downrank, reject, a missing condition, a violation; least score; most and least results; rejects dropped; downranked dropped.
AWARE = {
    "ranking": (0.58, 0.25, 0.17, 0.04, 0.015, 0.04, 0.20, 0.012, 0.08, -999.0, 100, 100, False, False), "balanced": (0.60, 0.26, 0.14, 0.045, 0.018, 0.06, 0.25, 0.014, 0.10, 0.18, 100, 20, True, False),
    "precision": (0.66, 0.26, 0.08, 0.06, 0.02, 0.12, 0.40, 0.022, 0.16, 0.30, 50, 0, True, True), "precision_safe": (0.64, 0.24, 0.12, 0.055, 0.02, 0.10, 0.35, 0.018, 0.14, 0.26, 60, 8, True, True),
}
_AWARE_ROWS = [dict(zip(("mode", "a_sel", "a_guard", "a_final", "a_pass", "a_soft", "a_down", "a_reject", "a_missing", "a_violation", "a_least", "most_", "least_", "a_drop", "a_drop_down"), (k, *v))) for k, v in AWARE.items()]
_AROW_SQL = "[" + ", ".join("{" + ", ".join(f"'{k}': {repr(v) if isinstance(v, str) else str(v).lower()}" for k, v in r.items()) + "}" for r in _AWARE_ROWS) + "]"


def guard_aware(spark, d, *modes: str) -> DataFrame:
    """Selector and guard (both balanced) joined in one score and decision under each preset."""
    c = F.col
    s = selector(spark, d, "balanced").drop("mode", "least_", "most_")
    j = judged(spark, d, s, "balanced").drop("mode", "least_", "most_").select("*", F.inline(_table([r for r in _AWARE_ROWS if not modes or r["mode"] in modes])))
    bonus = F.when(c("decision") == "pass", c("a_pass")).when(c("decision") == "soft_pass", c("a_soft")).when(c("decision") == "downrank", -c("a_down")).otherwise(-c("a_reject"))
    signal = F.when(c("gfinal") <= 0, 0.0).otherwise(F.least(F.lit(1.0), c("gfinal") / 1.5))
    score = c("a_sel") * c("sel") + c("a_guard") * c("gscore") + c("a_final") * signal + bonus - c("a_missing") * F.size("missing") - c("a_violation") * F.size("violations")
    score = score - F.when((c("sel") < 0.10) & (c("decision") != "pass"), 0.035).otherwise(0.0) - F.when(c("sel") < 0.06, 0.035).otherwise(0.0)
    j = j.withColumn("aware", F.round(score, 9))
    kept = F.when((c("aware") >= 0.46) & c("decision").isin("pass", "soft_pass"), "strong_keep").when((c("aware") >= c("a_least")) & (c("decision") != "reject"), "keep")
    return j.withColumn("verdict", kept.when(c("decision") == "reject", "reject").otherwise("drop"))


_GA = f"""{_SEL}, {_JUDGED.replace('FROM b3)', "FROM (SELECT * EXCLUDE (mode, least_, most_) FROM sl WHERE mode = 'balanced'))")},
ga0 AS (SELECT g.* EXCLUDE (mode, least_, most_), p.* FROM gj g CROSS JOIN (SELECT unnest({_AROW_SQL}, recursive := true)) p WHERE g.mode = 'balanced'),
ga1 AS (SELECT *, round(a_sel * sel + a_guard * gscore + a_final * CASE WHEN gfinal <= 0 THEN 0 ELSE least(1.0, gfinal / 1.5) END + CASE decision WHEN 'pass' THEN a_pass WHEN 'soft_pass' THEN a_soft WHEN 'downrank' THEN -a_down ELSE -a_reject END - a_missing * len(missing) - a_violation * len(violations)
  - CASE WHEN sel < 0.10 AND decision <> 'pass' THEN 0.035 ELSE 0 END - CASE WHEN sel < 0.06 THEN 0.035 ELSE 0 END, 9) AS aware FROM ga0),
ga AS (SELECT *, CASE WHEN aware >= 0.46 AND decision IN ('pass', 'soft_pass') THEN 'strong_keep' WHEN aware >= a_least AND decision <> 'reject' THEN 'keep' WHEN decision = 'reject' THEN 'reject' ELSE 'drop' END AS verdict FROM ga1)"""


@query("I07_guard_aware", f"""WITH {_GA}, w AS (SELECT *, CASE WHEN mode = 'ranking' THEN true ELSE NOT (a_drop AND decision = 'reject') AND NOT (a_drop_down AND decision = 'downrank') AND (verdict IN ('strong_keep', 'keep') OR aware >= a_least) END AS wanted FROM ga),
n AS (SELECT *, count(*) FILTER (wanted) OVER (PARTITION BY qid, mode) AS have, row_number() OVER (PARTITION BY qid, mode, wanted ORDER BY rank) AS n FROM w WHERE wanted OR NOT (a_drop AND decision = 'reject'))
SELECT qid, key, mode, aware, verdict, place FROM (SELECT *, row_number() OVER (PARTITION BY qid, mode ORDER BY aware DESC, sel DESC, round(gscore, 9) DESC, lower(title), rank) AS place FROM n WHERE wanted OR n <= least_ - have) WHERE place <= most_""")
def i07(spark, d):
    """Four modes: what score and decision keep, filled up in the given order to the least number, then sorted."""
    c = F.col
    rejected = c("a_drop") & (c("decision") == "reject")
    wanted = F.when(c("mode") == "ranking", True).otherwise(~rejected & ~(c("a_drop_down") & (c("decision") == "downrank")) & (c("verdict").isin("strong_keep", "keep") | (c("aware") >= c("a_least"))))
    kept = refilled(guard_aware(spark, d), wanted, [F.asc("rank")], ~rejected)
    return cut(kept, F.desc("aware"), F.desc("sel"), F.desc(F.round("gscore", 9)), F.asc(F.lower("title")), F.asc("rank")).select("qid", "key", "mode", "aware", "verdict", "place")


VERDICT_TEXT = {"strong_keep": "强保留", "keep": "保留", "drop": "丢弃", "reject": "过滤"}
_THREE = lambda c: f"printf('%.3f', {c})"
_SCORETAG = "CASE WHEN sel >= 0.30 THEN 'selector_score_high' WHEN sel >= 0.18 THEN 'selector_score_medium' ELSE 'selector_score_low' END"


@query("I08_guard_reason", f"""WITH {_GA} SELECT qid, key, list_filter([{_SCORETAG}, 'guard_' || decision, CASE WHEN len(missing) > 0 THEN 'missing_constraints_' || len(missing) END, CASE WHEN len(violations) > 0 THEN 'violations_' || len(violations) END], lambda x: x IS NOT NULL) AS tags,
  concat_ws('；', {_CASE('verdict', {k: repr(v) for k, v in VERDICT_TEXT.items()}, 'verdict')} || '：综合分=' || {_THREE('aware')}, 'Selector=' || label || '(' || {_THREE('sel')} || ')', 'Guard=' || decision || '(' || {_THREE('gscore')} || ')', '规则原因：' || {_GREASON},
  CASE WHEN len(missing) > 0 THEN '仍有' || len(missing) || '项硬约束缺失' END, CASE WHEN len(violations) > 0 THEN '存在' || len(violations) || '项违规约束' END) || '。' AS reason FROM ga WHERE mode = 'balanced'""")
def i08(spark, d):
    three = lambda c: F.format_string("%.3f", F.col(c))
    n = lambda c: F.size(c)
    tags = F.array_compact(F.array(F.when(F.col("sel") >= 0.30, "selector_score_high").when(F.col("sel") >= 0.18, "selector_score_medium").otherwise("selector_score_low"), F.concat(F.lit("guard_"), "decision"),
                                   F.when(n("missing") > 0, F.concat(F.lit("missing_constraints_"), n("missing"))), F.when(n("violations") > 0, F.concat(F.lit("violations_"), n("violations")))))
    told = F.create_map(*[F.lit(x) for kv in VERDICT_TEXT.items() for x in kv])[F.col("verdict")]
    parts = F.concat_ws("；", F.concat(told, F.lit("：综合分="), three("aware")), F.concat(F.lit("Selector="), "label", F.lit("("), three("sel"), F.lit(")")), F.concat(F.lit("Guard="), "decision", F.lit("("), three("gscore"), F.lit(")")),
                        F.concat(F.lit("规则原因："), guard_reason()), F.when(n("missing") > 0, F.concat(F.lit("仍有"), n("missing"), F.lit("项硬约束缺失"))), F.when(n("violations") > 0, F.concat(F.lit("存在"), n("violations"), F.lit("项违规约束"))))
    return guard_aware(spark, d, "balanced").select("qid", "key", tags.alias("tags"), F.concat(parts, F.lit("。")).alias("reason"))


@query("Q08_reason_samples", f"""WITH {_GA}, {_RZ}, g AS (SELECT qid, key, rank, decision, verdict, label FROM ga WHERE mode = 'balanced'), f AS (SELECT qid FROM (SELECT DISTINCT qid FROM g) ORDER BY qid LIMIT 5)
SELECT qid, key, decision, verdict, label, reason, n FROM (SELECT g.*, rz.reason, row_number() OVER (PARTITION BY g.qid ORDER BY g.rank) AS n FROM g JOIN rz USING (qid, key) WHERE g.qid IN (SELECT qid FROM f)) WHERE n <= 3""")
def q08(spark, d):
    """What guard, selector and evidence say of the first three candidates of the first five queries."""
    g = guard_aware(spark, d, "balanced").select("qid", "key", "rank", "decision", "verdict", "label", *reasons())
    first = g.select("qid").distinct().orderBy("qid").limit(5)
    return place(g.join(F.broadcast(first), "qid"), F.asc("rank"), name="n").where("n <= 3").select("qid", "key", "decision", "verdict", "label", "reason", "n")


# ---- F04, F05, Q13


@query("F04_textual_coverage", f"WITH {READ} SELECT qid, key, list_transform(cov_raws, lambda r: r.id) AS ids FROM feat")
def f04(spark, d):
    """Constraints whose terms a candidate's text has: all of one or two, all but one of more."""
    return read(spark, d).select("qid", "key", F.transform("cov_raws", lambda r: r["id"]).alias("ids"))


@query("F05_constraint_hits", f"""WITH {READ}, h AS (SELECT c.qid, c.key, c.source, c.rank AS hr, {STRONG} AS sure, f.cov_raws FROM cand c JOIN feat f USING (qid, key)),
s AS (SELECT qid, key, round(sum({case(SUBQUERY, 0.6)} / (hr + 5) + 0.04 * len(cov_raws) + CASE WHEN sure THEN 0.015 ELSE 0 END), 9) AS score, count(*) AS occ, min(hr) AS best, any_value(len(cov_raws)) AS covered FROM h GROUP BY qid, key)
SELECT qid, key, score, row_number() OVER (PARTITION BY qid ORDER BY covered DESC, occ DESC, score DESC, best, key) AS place FROM s""")
def f05(spark, d):
    """Hits summed with what each brings: decayed rank, covered constraints (the plan's and the text's, once each), an identifier."""
    c = candidates(spark, d).withColumn("sure", strong_id()).join(read(spark, d).select("qid", "key", F.size("cov_raws").alias("covered")), ["qid", "key"])
    each = by_source(SUBQUERY, 0.6) / (F.col("rank") + 5) + 0.04 * F.col("covered") + F.when(F.col("sure"), 0.015).otherwise(0.0)
    s = c.groupBy("qid", "key").agg(F.round(F.sum(each), 9).alias("score"), F.count("*").alias("occ"), F.min("rank").alias("best"), F.max("covered").alias("covered"))
    return place(s, F.desc("covered"), F.desc("occ"), F.desc("score"), F.asc("best"), F.asc("key")).select("qid", "key", "score", "place")


@query("Q13_anchored_with_constraints", f"""WITH {READ}, s AS (SELECT qid, key, round(b2, 9) AS score, core, covered, rank, title FROM feat) SELECT * FROM (SELECT qid, key, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, core DESC, covered DESC, rank, {norm('title')}) AS place FROM s) WHERE place <= 100""")
def q13(spark, d):
    s = read(spark, d).select("qid", "key", F.round("b2", 9).alias("score"), "core", "covered", "rank", "title")
    return place(s, F.desc("score"), F.desc("core"), F.desc("covered"), F.asc("rank"), ascii_words(F.col("title"))).where("place <= 100").select("qid", "key", "score", "place")


# ---- N02, N05, N07

ALPHAS = (1.0, 0.9, 0.8, 0.7, 0.6, 0.5)
_GRID = f"""{_E}, {_REL.split(RANKED + ', ')[1]}, qs AS (SELECT DISTINCT qid FROM gold JOIN feat USING (qid)), el AS (SELECT ex.*, rel.rel FROM ex JOIN rel ON rel.qid = ex.qid AND rel.rank = ex.rank JOIN qs ON qs.qid = ex.qid),
gr AS ({' UNION ALL '.join(f"SELECT qid, rank, rel, al_ AS alpha, '{k}' AS variant, round({s.format(a='al_')}, 9) AS s FROM el CROSS JOIN (SELECT unnest([{', '.join(map(str, ALPHAS))}])::DOUBLE AS al_)" for k, s in _VS)}),
gp AS (SELECT *, row_number() OVER (PARTITION BY qid, variant, alpha ORDER BY s DESC, rank) AS n, row_number() OVER (PARTITION BY qid, variant, alpha ORDER BY rel DESC, rank) AS i FROM gr),
nd AS (SELECT qid, variant, alpha, CASE WHEN sum(rel / log2(i + 1)) FILTER (i <= 10) > 0 THEN round(coalesce(sum(rel / log2(n + 1)) FILTER (n <= 10), 0) / sum(rel / log2(i + 1)) FILTER (i <= 10), 12) ELSE 0 END AS ndcg, coalesce(sum(rel) FILTER (n <= 20), 0) AS tp20 FROM gp GROUP BY ALL)"""


def graded(spark, d) -> DataFrame:
    """(qid, variant, alpha, ndcg, tp20): NDCG@10 of every variant and blend, in one pass over the exploded grid."""
    from rankloom.plans.inputs import gold

    v = variants(spark, d).join(gold(spark, d).select("qid").distinct(), "qid", "left_semi").join(labelled(spark, d).select("qid", "rank", "rel"), ["qid", "rank"])
    v = v.select("qid", "rank", "rel", "nb", "cov", "cov1", "pure", F.explode(F.array(*map(F.lit, ALPHAS))).alias("alpha"))
    v = v.select("qid", "rank", "rel", "alpha", F.inline(F.array(*[F.struct(F.lit(k).alias("variant"), F.round(s, 9).alias("s")) for k, s in variant_scores(F.col("alpha"))])))
    over = lambda *o: F.row_number().over(Window.partitionBy("qid", "variant", "alpha").orderBy(*o))
    v = v.withColumn("n", over(F.desc("s"), F.asc("rank"))).withColumn("i", over(F.desc("rel"), F.asc("rank")))
    gain = lambda at: F.sum(F.when(F.col(at) <= 10, F.col("rel") / F.log2(F.col(at) + 1)).otherwise(0.0))
    g = v.groupBy("qid", "variant", "alpha").agg(gain("n").alias("dcg"), gain("i").alias("ideal"), F.sum(F.when(F.col("n") <= 20, F.col("rel")).otherwise(0)).alias("tp20"))
    return g.select("qid", "variant", "alpha", F.round(ratio(F.col("dcg"), F.col("ideal")), 12).alias("ndcg"), "tp20")


@query("N05_variant_grid", f"WITH {_GRID}, m AS (SELECT variant, alpha, round(avg(ndcg), 9) AS ndcg, sum(tp20)::BIGINT AS tp20 FROM nd GROUP BY ALL) SELECT *, row_number() OVER (ORDER BY ndcg DESC, tp20 DESC, variant, alpha DESC) = 1 AS recommended FROM m")
def n05(spark, d):
    """Mean NDCG@10 and hits of every variant and blend, and the one to be taken."""
    m = graded(spark, d).groupBy("variant", "alpha").agg(F.round(F.avg("ndcg"), 9).alias("ndcg"), F.sum("tp20").alias("tp20"))
    first = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("ndcg"), F.desc("tp20"), F.asc("variant"), F.desc("alpha")))  # 24 rows
    return m.withColumn("recommended", first == 1)


@query("N02_alpha_selection", f"""WITH {_GRID}, fo AS (SELECT qid, (row_number() OVER (ORDER BY qid) - 1) % 5 AS fold FROM qs), fm AS (SELECT alpha, fold, avg(ndcg) AS v FROM nd JOIN fo USING (qid) WHERE variant = 'E3' GROUP BY ALL),
m AS (SELECT alpha, round(avg(v), 9) AS mean, round(stddev_pop(v), 9) AS std FROM fm GROUP BY alpha) SELECT alpha, mean, std, alpha = (SELECT max(alpha) FROM m WHERE (SELECT max(mean) FROM m) - mean <= 0.005) AS chosen FROM m""")
def n02(spark, d):
    """Mean of the folds' mean NDCG@10 for each blend of E3; among those within 0.005 of the best the largest is chosen."""
    from rankloom.plans.evaluation import folds_by_order

    g = graded(spark, d).where("variant = 'E3'")
    g = g.join(folds_by_order(g.select("qid").distinct()), "qid").groupBy("alpha", "fold").agg(F.avg("ndcg").alias("v"))
    m = g.groupBy("alpha").agg(F.round(F.avg("v"), 9).alias("mean"), F.round(F.stddev_pop("v"), 9).alias("std"))
    all_ = Window.partitionBy(F.lit(1))  # six rows
    m = m.withColumn("near", F.max("mean").over(all_) - F.col("mean") <= 0.005)
    return m.select("alpha", "mean", "std", (F.col("alpha") == F.max(F.when(F.col("near"), F.col("alpha"))).over(all_)).alias("chosen"))

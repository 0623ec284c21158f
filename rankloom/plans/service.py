"""Text functions with their companions, profiles, seeds, manifests and the search service over a local index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom import lexicon as L
from rankloom.functions import ident as I
from rankloom.functions import text as X
from rankloom.plans import guard as G
from rankloom.plans.evaluation import HITS, PER, RANKED, gold, per_query, ranked
from rankloom.plans.inputs import ANSWERS, CAND, candidates, norm, table
from rankloom.plans.planner import gold_columns
from rankloom.plans.ranking import place
from rankloom.plans.rerank import _GA, READ, guard_aware, reasons
from rankloom.plans.rerank import read as featured
from rankloom.plans.scalars import _ARX, _IDS, _T, arx, doi, record_ids, title
from rankloom.plans.understand import _compact_sql, _lst, compact, not_redundant, suppressed
from rankloom.plans.understand import candidates_of, questions
from rankloom.registry import query
from rankloom.scratch import stage

# ---- B: text


@query("B13_ascii_words", f"SELECT rec_id, {norm(_T)} AS value FROM papers_with_duplicates")
def b13(spark, d):
    """Words of titles after compatibility forms are unified and dashes are spaces."""
    return table(spark, d, "papers_with_duplicates").select("rec_id", X.ascii_words(X.compatible(title())).alias("value"))


@query("B14_guard_words", f"SELECT rec_id, {G.text_sql(_T)} AS value FROM papers_with_duplicates")
def b14(spark, d):
    return table(spark, d, "papers_with_duplicates").select("rec_id", X.guard_words(X.compatible(X.decoded(title()))).alias("value"))


def seed_tokens(c: Column) -> Column:
    """Distinct telling tokens of three characters and more, with the dots and hyphens inside them."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9][a-z0-9.+_-]*"), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(found, lambda t: (F.length(t) >= 3) & ~t.isin(*L.SEED_STOPS))))


_SEED = lambda c: f"list_sort(list_distinct(list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9][a-z0-9.+_-]*'), lambda t: len(t) >= 3 AND NOT list_contains({_lst(L.SEED_STOPS)}, t))))"


@query("B21_seed_tokens", f"WITH {CAND} SELECT qid, pred_id, item_pos, {_SEED('title')} AS tokens FROM cand")
def b21(spark, d):
    return candidates(spark, d).select("qid", "pred_id", "item_pos", seed_tokens(F.col("title")).alias("tokens"))


_ANY, _WORD = G.has_any_of("study", "survey", "library catalogue"), G.has_word("survey study")
_GROUPS = (("retrieval", "search"), ("learning", "training"))


@query("B30_guard_phrases", f"""WITH {CAND}, p AS (SELECT qid, pred_id, item_pos, ' ' || {G.text_sql('title')} || ' ' AS w FROM cand)
SELECT qid, pred_id, item_pos, {G.holds_sql(_ANY, 'w')} AS any_phrase, {G.holds_sql(_WORD, 'w')} AS any_word, list_filter([{', '.join(f"CASE WHEN {G.holds_sql(G.has_any_of(*g), 'w')} THEN '{'/'.join(g)}' END" for g in _GROUPS)}], lambda x: x IS NOT NULL) AS groups, {' AND '.join(G.holds_sql(G.has_any_of(*g), 'w') for g in _GROUPS)} AS all_groups FROM p""")
def b30(spark, d):
    """Any phrase, any word, which groups have a member and whether all have, plurals allowed."""
    p = candidates(spark, d).select("qid", "pred_id", "item_pos", G.padded(G.text_of(F.col("title"))).alias("w"))
    w = F.col("w")
    got = [(G.holds(G.has_any_of(*g), w), "/".join(g)) for g in _GROUPS]
    return p.select("qid", "pred_id", "item_pos", G.holds(_ANY, w).alias("any_phrase"), G.holds(_WORD, w).alias("any_word"), F.array_compact(F.array(*[F.when(h, F.lit(n)) for h, n in got])).alias("groups"), (got[0][0] & got[1][0]).alias("all_groups"))


_TYPES = "CASE json_type(v) WHEN 'VARCHAR' THEN 'str' WHEN 'OBJECT' THEN 'dict' WHEN 'ARRAY' THEN 'list' WHEN 'BOOLEAN' THEN 'bool' WHEN 'NULL' THEN 'null' WHEN 'DOUBLE' THEN 'float' ELSE 'int' END"
_ITEM = f"""CASE WHEN json_type(v) = 'VARCHAR' THEN CASE WHEN regexp_full_match(trim(v->>'$'), '(?i)(arxiv:\\s*)?\\d{{4}}\\.\\d{{4,5}}(v\\d+)?') THEN 'arxiv_id' WHEN regexp_full_match(trim(v->>'$'), '(?i)10\\.\\d{{4,9}}/\\S+') THEN 'doi' WHEN regexp_matches(trim(v->>'$'), '^https?://') THEN 'url' ELSE 'title_string' END
  WHEN json_type(v) = 'OBJECT' THEN CASE WHEN list_contains(ks, 'doi') THEN 'dict_with_doi' WHEN list_contains(ks, 'arxiv_id') OR list_contains(ks, 'arxiv') THEN 'dict_with_arxiv' WHEN list_contains(ks, 'title') THEN 'dict_with_title' WHEN list_contains(ks, 'id') THEN 'dict_with_id' ELSE 'dict_other' END ELSE 'other_' || {_TYPES} END"""


@query("B34_answer_items", f"""WITH a AS (SELECT row_id, answer FROM pasa_like_sample WHERE json_valid(answer) AND json_type(answer) = 'ARRAY'), i AS (SELECT row_id, unnest(json_extract(answer, '$[*]')) AS v FROM a),
k AS (SELECT v, CASE WHEN json_type(v) = 'OBJECT' THEN list_transform(json_keys(v), lambda x: lower(x)) ELSE [] END AS ks FROM i) SELECT {_TYPES} AS json_type, {_ITEM} AS kind, count(*) AS n FROM k GROUP BY ALL""")
def b34(spark, d):
    """Items of the answers that are lists, by JSON type and by what they hold."""
    v = F.try_variant_get(F.try_parse_json("answer"), "$", "array<variant>")
    i = table(spark, d, "pasa_like_sample").where(F.ltrim("answer").startswith("[")).select(F.explode(F.when(F.try_parse_json(F.concat(F.lit("["), "answer", F.lit("]"))).isNotNull(), v)).alias("v"))
    kind = F.schema_of_variant("v")
    s = F.trim(F.try_variant_get("v", "$", "string"))
    keys = F.transform(F.map_keys(F.try_variant_get("v", "$", "map<string,variant>")), lambda k: F.lower(k))
    has = lambda k: F.array_contains(keys, k)
    text = F.when(s.rlike(r"(?i)^(?:arxiv:\s*)?\d{4}\.\d{4,5}(?:v\d+)?$"), "arxiv_id").when(s.rlike(r"(?i)^10\.\d{4,9}/\S+$"), "doi").when(s.rlike("^https?://"), "url").otherwise("title_string")
    obj = F.when(has("doi"), "dict_with_doi").when(has("arxiv_id") | has("arxiv"), "dict_with_arxiv").when(has("title"), "dict_with_title").when(has("id"), "dict_with_id").otherwise("dict_other")
    name = (F.when(kind == "STRING", "str").when(kind.startswith("OBJECT"), "dict").when(kind.startswith("ARRAY"), "list").when(kind == "BOOLEAN", "bool").when(kind == "VOID", "null")
            .when(kind.isin("DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), "float").otherwise("int"))
    return i.select(name.alias("json_type"), F.when(kind == "STRING", text).when(kind.startswith("OBJECT"), obj).otherwise(F.concat(F.lit("other_"), name)).alias("kind")).groupBy("json_type", "kind").agg(F.count("*").alias("n"))


_ARX_FULL = lambda c: f"CASE WHEN regexp_full_match(trim({c}), '(?i)(arxiv:\\s*)?\\d{{4}}\\.\\d{{4,5}}(v\\d+)?(\\.pdf)?') THEN nullif(lower(regexp_extract({c}, '(?i)(\\d{{4}}\\.\\d{{4,5}})', 1)), '') END"
_INFER = f"""i0 AS (SELECT rec_id, {_IDS}, source_record_id, id, paperid FROM papers_with_duplicates),
i1 AS (SELECT *, coalesce(a, {_ARX_FULL('source_record_id')}) AS a2, coalesce(o, nullif(upper(regexp_extract(source_record_id, '(?i)(W\\d+)', 1)), '')) AS o2 FROM i0)"""


def inferred(spark, d) -> DataFrame:
    """Identifiers of each record, direct (d, a, o, s) and with what its DOI and its source's identifier tell (d2, a2, o2)."""
    r = table(spark, d, "papers_with_duplicates").select("rec_id", "source_record_id")
    own = F.col("source_record_id")
    r = record_ids(spark, d).join(r, "rec_id")
    return r.select("*", F.coalesce("d", I.extract_doi(own)).alias("d2"), F.coalesce("a", I.arxiv_from_doi(F.col("d")), I.extract_arxiv(own)).alias("a2"), F.coalesce("o", I.extract_openalex(own)).alias("o2"))


@query("B36_identity_keys", f"""WITH {_INFER} SELECT rec_id, coalesce('doi:' || d, 'arxiv:' || a, 'openalex:' || o, 's2:' || s, 'title:' || t) AS canonical_id,
  coalesce(CASE WHEN a2 IS NOT NULL AND d IS NULL THEN 'arxiv:' || a2 END, 'doi:' || d, 'arxiv:' || a2, 'openalex:' || o2, 's2:' || s, 'title:' || t) AS canonical_id_v2,
  list_filter(['doi:' || d, 'arxiv:' || a2, 'openalex:' || o2, 's2:' || s], lambda x: x IS NOT NULL) AS keys FROM i1""")
def b36(spark, d):
    """Canonical identifier, the same with inferred identifiers, and all identity keys."""
    r = inferred(spark, d)
    c = F.col
    tag = lambda p, x: F.concat(F.lit(p), x)
    keys = F.array_compact(F.array(tag("doi:", c("d2")), tag("arxiv:", c("a2")), tag("openalex:", c("o2")), tag("s2:", c("s"))))
    of_arxiv = F.when(c("a2").isNotNull() & (c("d2").isNull() | I.arxiv_from_doi(c("d2")).isNotNull()), tag("arxiv:", c("a2")))
    v2 = F.coalesce(of_arxiv, tag("doi:", c("d2")), tag("arxiv:", c("a2")), tag("openalex:", c("o2")), tag("s2:", c("s")), tag("title:", c("t")))
    return r.select("rec_id", I.canonical_id(*[c(x) for x in "daost"]).alias("canonical_id"), v2.alias("canonical_id_v2"), keys.alias("keys"))


@query("C08_identifier_coverage", f"""WITH {_INFER}, c AS (SELECT count(*) AS n, count(d) AS doi, count(a) AS arxiv, count(o) AS openalex, count(s) AS s2, count(d) AS doi2, count(a2) AS arxiv2, count(o2) AS openalex2, count(*) FILTER (coalesce(d, a, o, s) IS NOT NULL) AS any1, count(*) FILTER (coalesce(d, a2, o2, s) IS NOT NULL) AS any2 FROM i1)
UNPIVOT c ON n, doi, arxiv, openalex, s2, doi2, arxiv2, openalex2, any1, any2 INTO NAME field VALUE records""".replace("WITH ", "WITH ", 1))
def c08(spark, d):
    """How many records have each identifier, directly and with inferred ones, and any at all."""
    some = lambda *cs: F.count_if(F.coalesce(*cs).isNotNull())
    c = inferred(spark, d).agg(F.count("*").alias("n"), F.count("d").alias("doi"), F.count("a").alias("arxiv"), F.count("o").alias("openalex"), F.count("s").alias("s2"), F.count("d2").alias("doi2"), F.count("a2").alias("arxiv2"),
                               F.count("o2").alias("openalex2"), some("d", "a", "o", "s").alias("any1"), some("d2", "a2", "o2", "s").alias("any2"))
    return c.unpivot([], c.columns, "field", "records")


@query("B38_merged_lists", f"""WITH {CAND} SELECT qid, key, {_compact_sql("list(title ORDER BY source, rank, pred_id, item_pos)", 100000)} AS titles, max(len(coalesce(abstract, ''))) AS chars FROM cand GROUP BY qid, key""")
def b38(spark, d):
    """Titles of a candidate united in order, letter case aside, and the length of its longest abstract."""
    c = candidates(spark, d).groupBy("qid", "key").agg(F.array_sort(F.collect_list(F.struct("source", "rank", "pred_id", "item_pos", "title"))).alias("ts"), F.max(F.length(F.coalesce("abstract", F.lit("")))).cast("bigint").alias("chars"))
    return c.select("qid", "key", compact(F.filter(F.transform("ts", lambda t: t["title"]), lambda t: t.isNotNull()), 100_000).alias("titles"), "chars")


@query("B39_buckets", f"""WITH {READ} SELECT CASE WHEN rank <= 10 THEN '1-10' WHEN rank <= 20 THEN '11-20' WHEN rank <= 50 THEN '21-50' WHEN rank <= 100 THEN '51-100' ELSE '>100' END AS rank_bucket, CASE WHEN rank <= 5 THEN '1-5' WHEN rank <= 10 THEN '6-10' WHEN rank <= 20 THEN '11-20' WHEN rank <= 50 THEN '21-50' ELSE '51-100' END AS oracle_bucket,
  CASE WHEN len(ev) <= 0 THEN 'no_constraints' WHEN len(hit) <= 0 THEN '0/N' WHEN len(hit) = 1 THEN '1/N' WHEN len(hit) = 2 THEN '2/N' ELSE '3+/N' END AS coverage_bucket, count(*) AS n FROM feat GROUP BY ALL""")
def b39(spark, d):
    r, m, n = F.col("rank"), F.size("hit"), F.size("ev")
    ranks = F.when(r <= 10, "1-10").when(r <= 20, "11-20").when(r <= 50, "21-50").when(r <= 100, "51-100").otherwise(">100")
    ks = F.when(r <= 5, "1-5").when(r <= 10, "6-10").when(r <= 20, "11-20").when(r <= 50, "21-50").otherwise("51-100")
    cov = F.when(n <= 0, "no_constraints").when(m <= 0, "0/N").when(m == 1, "1/N").when(m == 2, "2/N").otherwise("3+/N")
    return featured(spark, d).groupBy(ranks.alias("rank_bucket"), ks.alias("oracle_bucket"), cov.alias("coverage_bucket")).agg(F.count("*").alias("n"))


@query("B38_suppressed_phrases")
def b38_suppressed(spark, d):
    """Phrases of each question that are left once fragments, repetitions and what two others say together are gone."""
    q = candidates_of(questions(spark, d), "row_id").select("row_id", suppressed(F.col("all_")).alias("cells"))
    return q.select("row_id", F.transform(not_redundant(F.col("cells")), lambda x: x["text"]).alias("texts"))


# ---- A, C: loading and checking


@query("C03_gold_leak_guard", "SELECT * FROM (VALUES ('predictions', []::VARCHAR[]), ('documents', []), ('events', []), ('papers_with_duplicates', []), ('pasa_like_sample', ['answer'])) t(table_name, leaks)")
def c03(spark, d):
    """Columns, at any depth, of each table that only the evaluation may read; no production plan may have one."""
    names = ("predictions", "documents", "events", "papers_with_duplicates", "pasa_like_sample")
    rows = [(n, gold_columns(table(spark, d, n).schema)) for n in names]
    return spark.createDataFrame(rows, "table_name string, leaks array<string>")


@query("A02_gold_checks", f"""WITH {ANSWERS}, n AS (SELECT row_id, count(*) AS titles FROM answers GROUP BY row_id), j AS (SELECT row_id, qid, CASE WHEN json_valid(answer) AND json_type(answer) = 'ARRAY' THEN json_array_length(answer) END AS items FROM pasa_like_sample)
SELECT j.row_id, coalesce(titles, 0) AS titles, items IS NOT NULL AND items <> coalesce(titles, 0) AS mismatch, qid IS NOT NULL AND count(*) OVER (PARTITION BY qid) > 1 AS repeated FROM j LEFT JOIN n USING (row_id)""")
def a02(spark, d):
    """Checks before gold is loaded: titles of each row, lists of another length than their titles, queries given twice."""
    from rankloom.operators.nested import answer_titles

    p = table(spark, d, "pasa_like_sample")
    n = answer_titles(p).groupBy(F.col("parent_id").alias("row_id")).agg(F.count("*").alias("titles"))
    whole = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), "answer", F.lit("]"))), "$", "array<variant>")
    items = F.when((F.size(whole) == 1) & F.schema_of_variant(whole[0]).startswith("ARRAY"), F.size(F.try_variant_get(whole[0], "$", "array<variant>")))
    j = p.select("row_id", "qid", items.alias("items")).join(n, "row_id", "left").withColumn("titles", F.coalesce("titles", F.lit(0)))
    again = p.where("qid is not null").groupBy("qid").agg((F.count("*") > 1).alias("repeated"))
    return j.join(again, "qid", "left").select("row_id", "titles", (F.col("items").isNotNull() & (F.col("items") != F.col("titles"))).alias("mismatch"), F.coalesce("repeated", F.lit(False)).alias("repeated"))


def require_gold(rows: DataFrame) -> DataFrame:
    """Gold rows (qid, answer, answer_arxiv_id?: lists) as they are, or an error that names the first repeated query or unequal lists."""
    twice = rows.groupBy("qid").count().where("count > 1").orderBy("qid").limit(1).collect()
    if twice:
        raise ValueError(f"gold of {twice[0]['qid']!r} is given {twice[0]['count']} times")
    if "answer_arxiv_id" in rows.columns:
        unequal = rows.where("answer_arxiv_id is not null and size(answer) <> size(answer_arxiv_id)").select("qid").orderBy("qid").limit(1).collect()
        if unequal:
            raise ValueError(f"answer and answer_arxiv_id of {unequal[0]['qid']!r} differ in length")
    return rows


def prediction_lists(rows: DataFrame) -> DataFrame:
    """(qid, rank, paper) of prediction rows, the list read from papers, else predictions, results or answer."""
    names = [c for c in ("papers", "predictions", "results", "answer") if c in rows.columns]
    if not names:
        raise ValueError("no list of papers in the prediction rows")
    return rows.select("qid", F.posexplode(F.coalesce(*names)).alias("rank", "paper")).withColumn("rank", F.col("rank") + 1)


@query("A16_manifest", """WITH p AS (SELECT *, concat_ws('|', coalesce(qid, ''), coalesce(question, ''), coalesce(source, '')) AS t FROM predictions) SELECT source, count(*) AS rows, sum(octet_length(encode(t)))::BIGINT AS bytes, count(*) - count(DISTINCT pred_id) AS repeated, count(*) FILTER (qid IS NULL) AS no_qid, sha256(string_agg(sha256(t), '' ORDER BY pred_id, delivered_at, sha256(t))) AS digest FROM p GROUP BY source""")
def a16(spark, d):
    """Rows, bytes, repeated keys, rows without query and one digest of each source, for comparing a frozen copy with a new one."""
    p = table(spark, d, "predictions").withColumn("t", F.concat_ws("|", *(F.coalesce(c, F.lit("")) for c in ("qid", "question", "source"))))
    g = p.groupBy("source").agg(F.count("*").alias("rows"), F.sum(F.octet_length("t")).alias("bytes"), (F.count("*") - F.count_distinct("pred_id")).alias("repeated"), F.count_if(F.col("qid").isNull()).alias("no_qid"),
                                F.array_sort(F.collect_list(F.struct("pred_id", "delivered_at", F.sha2("t", 256).alias("h")))).alias("hs"))
    return g.select("source", "rows", "bytes", "repeated", "no_qid", F.sha2(F.array_join(F.transform("hs", lambda x: x["h"]), ""), 256).alias("digest"))


def file_manifest(spark: SparkSession, root: str) -> DataFrame:
    """(path, bytes, digest) of every file below ``root``; a path that leads out of it is an error."""
    if ".." in root.split("/"):
        raise ValueError("the path leads out of the folder")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("digest"))


def verified(now: DataFrame, frozen: DataFrame) -> DataFrame:
    """(path, state): same, changed, missing or new, of a manifest against a frozen one."""
    j = now.select("path", F.col("digest").alias("a")).join(frozen.select("path", F.col("digest").alias("b")), "path", "full")
    return j.select("path", F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "missing").when(F.col("a") == F.col("b"), "same").otherwise("changed").alias("state"))


@query("A11_budgeted_calls", "SELECT qid, CAST(n AS INTEGER) AS n, CAST((n - 1) // 10 AS INTEGER) AS batch, CASE WHEN n <= 48 THEN 'planned' ELSE 'budget_exceeded' END AS state FROM (SELECT qid, row_number() OVER (ORDER BY qid) AS n FROM (SELECT DISTINCT qid FROM predictions WHERE qid IS NOT NULL))")
def a11(spark, d):
    """Every call with its batch of ten and whether the budget of 48 has room for it, in a fixed order, before any is made."""
    from rankloom.plans.evaluation import numbered

    q = numbered(table(spark, d, "predictions").where("qid is not null").select("qid").distinct(), "qid")
    n = F.col("n").cast("int")
    return q.select("qid", n.alias("n"), F.floor((n - 1) / 10).cast("int").alias("batch"), F.when(n <= 48, "planned").otherwise("budget_exceeded").alias("state"))


@query("F08_page_sizes", "SELECT kind, mode, CASE WHEN kind = 'raw' AND mode = 'raw_anchor' THEN 100 ELSE 50 END AS page_size FROM (SELECT unnest(['raw', 'cleaned', 'keyword_core', 'expanded', 'phrase_focus']) AS kind), (SELECT unnest(['weighted', 'raw_anchor']) AS mode)")
def f08(spark, d):
    """Page size of every variant under either way of aggregating."""
    kinds, modes = ("raw", "cleaned", "keyword_core", "expanded", "phrase_focus"), ("weighted", "raw_anchor")
    grid = spark.createDataFrame([(k, m) for k in kinds for m in modes], "kind string, mode string")
    return grid.select("kind", "mode", page_size(F.col("kind"), F.col("mode"), 50, None, 100).alias("page_size"))


def page_size(kind: Column, mode: Column, per_variant: int, raw_page: int | None, most: int) -> Column:
    """1 to 100 rows a page; the raw variant of the anchored mode asks for its own size, or for all that is wanted."""
    clip = lambda n: F.lit(max(1, min(100, int(n))))
    return F.when((kind == "raw") & (mode == "raw_anchor"), clip(raw_page if raw_page is not None else max(most, per_variant))).otherwise(clip(per_variant))


def planned(spec: DataFrame) -> DataFrame:
    """Plans (text, priority?, confidence?, plan_type?) brought into range; a plan without a text is an error."""
    have = lambda c, other: F.coalesce(F.col(c), F.lit(other)) if c in spec.columns else F.lit(other)
    text = F.trim(F.coalesce("text", F.lit("")))
    return spec.withColumns({
        "text": F.when(text == "", F.raise_error(F.lit("a plan has no text"))).otherwise(text), "priority": F.greatest(F.lit(0), F.least(F.lit(100), have("priority", 50).cast("int"))),
        "confidence": X.clamp(have("confidence", 0.5).cast("double")), "plan_type": F.coalesce(F.nullif(F.trim(have("plan_type", "anchor_query")), F.lit("")), F.lit("anchor_query")),
    })


@query("Q12_clamped_plans", f"WITH {PER} SELECT qid, 'anchor_query' AS plan_type, greatest(0, least(100, 40 + 10 * fn))::INTEGER AS priority, greatest(0.0, least(1.0, round(1.5 * f, 9)))::DOUBLE AS confidence FROM per")
def q12(spark, d):
    """Plans made from what each query misses, brought into the ranges of a plan."""
    p = per_query(spark, d).select("qid", F.concat(F.lit("more of "), "qid").alias("text"), (40 + 10 * F.col("fn")).alias("priority"), F.round(1.5 * F.col("f"), 9).alias("confidence"))
    return planned(p).select("qid", "plan_type", "priority", "confidence")


# ---- K01: seeds

SEED_RANK, SEEDS, SEED_TERMS, SEED_SCORE = 15, 3, 2, 0.15
_SD = f"""{_GA}, sd0 AS (SELECT qid, key, rank, lower(title) AS t, decision, sel, semantic, occ, {_SEED('question')} AS qt, {_SEED("(coalesce(title, '') || ' ' || coalesce(abstract, ''))")} AS pt, (SELECT bool_or(openalex_id IS NOT NULL AND regexp_matches(openalex_id, '(?i)W\\d+')) FROM cand WHERE cand.qid = ga.qid AND cand.key = ga.key) AS known,
  (SELECT count(DISTINCT source) FROM cand WHERE cand.qid = ga.qid AND cand.key = ga.key) AS srcs FROM ga WHERE mode = 'balanced' AND rank <= 40),
sd1 AS (SELECT *, list_sort(list_intersect(qt, pt)) AS m FROM sd0), sd2 AS (SELECT *, CASE WHEN len(qt) = 0 OR len(pt) = 0 THEN 0 ELSE least(1.0, len(m) / greatest(1, least(len(qt), 8))) END AS lex FROM sd1),
sd3 AS (SELECT *, round(greatest(0.0, least(1.0, 0.45 * least(1.0, greatest(semantic, 1 / (1 + 0.12 * (rank - 1)))) + 0.25 * lex + 0.20 * least(1.0, sel) + CASE WHEN occ >= 2 THEN 0.05 ELSE 0 END + CASE WHEN srcs >= 2 THEN 0.05 ELSE 0 END)), 9) AS seed_score,
  list_filter([CASE WHEN rank > {SEED_RANK} THEN 'rank_outside_gate' END, CASE WHEN NOT coalesce(known, false) THEN 'missing_openalex_id' END, CASE WHEN decision = 'reject' THEN 'guard_reject' END, CASE WHEN len(m) < {SEED_TERMS} THEN 'insufficient_query_term_coverage' WHEN lex < {SEED_SCORE} THEN 'low_query_overlap_score' END], lambda x: x IS NOT NULL) AS why FROM sd2),
sd4 AS (SELECT *, row_number() OVER (PARTITION BY qid, len(why) = 0 ORDER BY seed_score DESC, rank, t) AS n FROM sd3)"""


@query("K01_seed_gate", f"WITH {_SD} SELECT qid, key, seed_score, len(why) = 0 AND n <= {SEEDS} AS accepted, CASE WHEN len(why) = 0 AND n > {SEEDS} THEN ['seed_budget_exceeded'] ELSE why END AS why FROM sd4")
def k01(spark, d):
    """The first forty candidates of a query judged as seeds: score, and why each is refused; three are accepted, the rest exceed the budget."""
    c = candidates(spark, d).groupBy("qid", "key").agg(F.max(F.coalesce(F.col("openalex_id").rlike(r"(?i)W\d+"), F.lit(False))).alias("known"), F.count_distinct("source").alias("srcs"))
    s = guard_aware(spark, d, "balanced").where("rank <= 40").join(c, ["qid", "key"])
    s = s.select("qid", "key", "rank", F.lower("title").alias("t"), "decision", "sel", "semantic", "occ", "known", "srcs", seed_tokens(F.col("question")).alias("sq"), seed_tokens(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit("")))).alias("sp"))
    s = s.withColumn("m", F.array_intersect("sq", "sp"))
    s = s.withColumn("lex", F.when((F.size("sq") == 0) | (F.size("sp") == 0), 0.0).otherwise(F.least(F.lit(1.0), F.size("m") / F.greatest(F.lit(1), F.least(F.size("sq"), F.lit(8))))))
    one, col = F.lit(1.0), F.col
    score = 0.45 * F.least(one, F.greatest("semantic", 1 / (1 + 0.12 * (col("rank") - 1)))) + 0.25 * col("lex") + 0.20 * F.least(one, "sel") + F.when(col("occ") >= 2, 0.05).otherwise(0.0) + F.when(col("srcs") >= 2, 0.05).otherwise(0.0)
    why = F.array_compact(F.array(F.when(col("rank") > SEED_RANK, "rank_outside_gate"), F.when(~col("known"), "missing_openalex_id"), F.when(col("decision") == "reject", "guard_reject"),
                                  F.when(F.size("m") < SEED_TERMS, "insufficient_query_term_coverage").when(col("lex") < SEED_SCORE, "low_query_overlap_score")))
    s = s.select("*", F.round(X.clamp(score), 9).alias("seed_score"), why.alias("why"))
    s = s.withColumn("n", F.row_number().over(Window.partitionBy("qid", F.size("why") == 0).orderBy(F.desc("seed_score"), "rank", "t")))
    fits = F.size("why") == 0
    return s.select("qid", "key", "seed_score", (fits & (col("n") <= SEEDS)).alias("accepted"), F.when(fits & (col("n") > SEEDS), F.array(F.lit("seed_budget_exceeded"))).otherwise(col("why")).alias("why"))


# ---- D17, M13


@query("D17_same_candidates", f"""WITH {RANKED}, a AS (SELECT qid, key FROM ranked), b AS (SELECT qid, key FROM cand GROUP BY qid, key), x AS ((SELECT qid, key FROM a EXCEPT ALL SELECT qid, key FROM b) UNION ALL (SELECT qid, key FROM b EXCEPT ALL SELECT qid, key FROM a)) SELECT count(*) AS differing, count(*) = 0 AS same FROM x""")
def d17(spark, d):
    """Whether reordering kept every candidate: the multisets before and after, compared both ways."""
    a, b = ranked(spark, d).select("qid", "key"), candidates(spark, d).select("qid", "key").distinct()
    return a.exceptAll(b).unionByName(b.exceptAll(a)).agg(F.count("*").alias("differing"), (F.count("*") == 0).alias("same"))


# Words of a question that are no concepts, and groups of words that stand for one.
CONCEPT_STOPS = "the a an for of and with using research paper papers".split()
CONCEPTS = (("image", "visual", "pixel", "vision"), ("encoding", "encoder", "compression", "entropy", "latent", "representation"), ("distribution", "probability", "density", "prior", "generative"), ("model", "network", "architecture"))
_CW = lambda c: f"list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[a-z][a-z\\-]+'), lambda t: NOT list_contains({_lst(CONCEPT_STOPS)}, t))"
_CSET = "CASE " + " ".join(f"WHEN list_contains({_lst(g)}, t) THEN {_lst(g)}" for g in CONCEPTS) + " ELSE [t] END"


@query("M13_missing_concepts", f"""WITH q AS (SELECT qid, min(question) AS question FROM pasa_like_sample WHERE qid IS NOT NULL AND question IS NOT NULL GROUP BY qid), {HITS},
lost AS (SELECT g.qid, list_distinct(flatten(list({_CW('g.title')}))) AS gt FROM gold g ANTI JOIN hits h ON h.qid = g.qid AND h.gold_index = g.gold_index GROUP BY g.qid)
SELECT lost.qid, list_filter({_CW('question')}, lambda t: len(list_intersect({_CSET}, gt)) = 0) AS missing, CASE WHEN len({_CW('question')}) <= 4 THEN 'underspecified academic query with vocabulary mismatch' ELSE 'query terminology does not cover gold paper concepts' END AS reason FROM lost JOIN q USING (qid)""")
def m13(spark, d):
    """Concepts of a question that no missed gold title speaks of, words of one concept standing for each other."""
    from rankloom.plans.evaluation import hits

    words = lambda c: F.filter(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[a-z][a-z\-]+"), F.lit(0)), lambda t: ~t.isin(*CONCEPT_STOPS))
    lost = gold(spark, d).join(hits(spark, d).select("qid", "gold_index"), ["qid", "gold_index"], "left_anti")
    lost = lost.groupBy("qid").agg(F.array_distinct(F.flatten(F.collect_list(words(F.col("title"))))).alias("gt"))
    q = table(spark, d, "pasa_like_sample").where("qid is not null and question is not null").groupBy("qid").agg(F.min("question").alias("question"))

    def said(t: Column) -> Column:
        group = F.array(t)
        for g in CONCEPTS:
            group = F.when(t.isin(*g), F.array(*map(F.lit, g))).otherwise(group)
        return F.arrays_overlap(group, "gt")

    j = lost.join(q, "qid").withColumn("ws", words(F.col("question")))
    reason = F.when(F.size("ws") <= 4, "underspecified academic query with vocabulary mismatch").otherwise("query terminology does not cover gold paper concepts")
    return j.select("qid", F.filter("ws", lambda t: ~said(t)).alias("missing"), reason.alias("reason"))


# ---- O, Q: the service


class RequestError(ValueError):
    """A request that can't be served; ``status`` is that of the service."""

    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status = status


def checked_request(text: str, top_k: int = 20, mode: str = "benchmark", qid: str | None = None) -> tuple[str, int, str, str | None]:
    """The request in order, or a ``RequestError`` of status 422: 3 to 2000 characters, 20, 50 or 100 results, a known mode."""
    text = " ".join((text or "").split())
    if not 3 <= len(text) <= 2000:
        raise RequestError(422, "query must have 3 to 2000 characters")
    if top_k not in (20, 50, 100):
        raise RequestError(422, "top_k must be 20, 50 or 100")
    if mode not in ("benchmark", "live"):
        raise RequestError(422, "mode must be benchmark or live")
    if qid is not None and len(qid) > 128:
        raise RequestError(422, "qid is too long")
    return text, top_k, mode, qid


class Engine:
    """Search over the tables of one folder: fixed candidates of known questions, or a local index of records for any question."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def health(self) -> dict[str, object]:
        """Whether each table can be read, and the versions in use."""
        tables = {}
        for name in ("predictions", "pasa_like_sample", "papers_with_duplicates"):
            try:
                table(self.spark, self.folder, name).schema
                tables[name] = "ok"
            except Exception as problem:
                tables[name] = type(problem).__name__
        return {"status": "ok" if set(tables.values()) == {"ok"} else "degraded", "tables": tables, "spark": self.spark.version}

    def search_benchmark(self, qid: str, top_k: int = 20) -> DataFrame:
        """(place, key, title, score, reason) over the fixed candidates of a known question; 404 for an unknown one."""
        checked_request("known question", top_k, "benchmark", qid)
        own = featured(self.spark, self.folder).where(F.col("qid") == qid)
        if not candidates(self.spark, self.folder).where(F.col("qid") == qid).limit(1).collect():
            raise RequestError(404, f"no candidates of {qid!r}")
        s = own.select("qid", "key", "title", "rank", F.round("pure", 9).alias("score"), *reasons())
        return place(s, F.desc("score"), F.asc("rank")).where(F.col("place") <= top_k).select("place", "key", "title", "score", "reason")

    def search(self, question: str, top_k: int = 20) -> DataFrame:
        """(place, rec_id, title, score, plans) for any question over all records: plan, retrieve by every plan, keep each work once, rank by text."""
        from rankloom.plans.planner import plans

        text, top_k, _, _ = checked_request(question, top_k, "live")
        asked = self.spark.createDataFrame([(1, text)], "row_id long, question string")
        found = retrieved(plans(asked).select("n", "text"), table(self.spark, self.folder, "papers_with_duplicates"))
        want = asked.select(X.tokens(F.col("question")).alias("qt"))
        s = found.join(F.broadcast(want)).select("rec_id", "title", "plans", F.round(X.soft_overlap(F.col("qt"), X.tokens(F.col("title"))) + 0.1 * F.col("best"), 9).alias("score"))
        top = s.orderBy(F.desc("score"), "rec_id").limit(top_k)
        return top.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), "rec_id"))).select("place", "rec_id", "title", "score", "plans")


def retrieved(plan: DataFrame, records: DataFrame) -> DataFrame:
    """(rec_id, title, best, plans): records that share a telling word with a plan, one of each title, by the share of the plan's words found.

    The plans' words, a few, meet the index of words by join; the plan that comes first wins.
    """
    words = plan.select("n", F.explode(X.tokens(F.col("text"))).alias("w"), F.size(X.tokens(F.col("text"))).alias("size"))
    r = records.select("rec_id", F.coalesce("title", "display_name").alias("title")).where("title is not null")
    index = r.select("rec_id", F.explode(X.tokens(F.col("title"))).alias("w"))
    hit = index.join(F.broadcast(words), "w").groupBy("rec_id", "n", "size").agg(F.count("*").alias("k"))
    best = hit.groupBy("rec_id").agg(F.max(F.col("k") / F.col("size")).alias("best"), F.array_sort(F.collect_set("n")).alias("plans"))
    both = best.join(r, "rec_id").withColumn("tk", X.letters_key(F.col("title")))
    one = both.groupBy("tk").agg(F.max_by(F.struct("rec_id", "title", "best", "plans"), F.struct("best", -F.col("rec_id"))).alias("x"))
    return one.select("x.*")


@query("O04_live_search")
def o04(spark, d):
    """One live search, from the plans of a question to its ranked records."""
    return Engine(spark, d).search("Find papers that use contrastive pretraining for machine reading", 20)


@query("O05_diagnosis", f"WITH {PER}, nq AS (SELECT qid, min(question) AS question FROM predictions WHERE question IS NOT NULL GROUP BY qid), sq AS (SELECT c.qid, list(DISTINCT source ORDER BY source) AS sources FROM cand c GROUP BY c.qid) SELECT per.qid, nq.question, tp, fn, first_hit, coalesce(sources, []) AS sources, CASE WHEN first_hit <= 20 THEN 'success' WHEN first_hit IS NOT NULL THEN 'ranking' ELSE 'retrieval' END AS stage FROM per LEFT JOIN nq USING (qid) LEFT JOIN sq USING (qid)")
def o05(spark, d):
    from rankloom.plans.scalars import questions as by_qid

    s = candidates(spark, d).groupBy("qid").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    h = F.col("first_hit")
    stage = F.when(h <= 20, "success").when(h.isNotNull(), "ranking").otherwise("retrieval")
    p = per_query(spark, d).join(by_qid(spark, d), "qid", "left").join(s, "qid", "left")
    return p.select("qid", "question", "tp", "fn", h.cast("bigint").alias("first_hit"), F.coalesce("sources", F.array().cast("array<string>")).alias("sources"), stage.alias("stage"))


# The stages of the pipeline in order, by the names under which their lists are found.
STAGES = ("b0_raw", "b1_weighted", "b1_raw_anchor", "b2_multi", "b2_1_hybrid", "b3_semantic", "b4_pool", "b4_top20", "b4_top50", "b4_top100", "b5_1_balanced", "b5_precision", "b5_2_ranking", "b5_2_balanced")


def stage_list(*overrides: str) -> list[tuple[int, str, str]]:
    """(order, name, path) of the stages; an override ``NAME=PATH`` names another path or adds a stage at the end."""
    paths = {name: f"{name}.parquet" for name in STAGES}
    for text in overrides:
        name, sign, path = text.partition("=")
        if not sign or not name.strip() or not path.strip():
            raise ValueError(f"not of the form NAME=PATH: {text!r}")
        paths[name.strip()] = path.strip()
    return [(i, name, path) for i, (name, path) in enumerate(paths.items())]


@query("Q05_stage_list", "SELECT CAST(i - 1 AS INTEGER) AS n, s AS stage, s || '.parquet' AS path FROM (SELECT unnest([{0}]) AS s, generate_subscripts([{0}], 1) AS i)".format(", ".join(f"'{s}'" for s in STAGES)))
def q05(spark, d):
    return spark.createDataFrame(stage_list(), "n int, stage string, path string")


@query("Q06_headline_metrics", f"""WITH {PER}, f AS (SELECT count(*) AS queries, round(avg(f), 9) AS macro_f1, round(avg(r), 9) AS macro_recall, sum(tp)::BIGINT AS tp, count(*) FILTER (tp = 0) AS zero FROM per) UNPIVOT (SELECT queries::DOUBLE AS queries, macro_f1::DOUBLE AS macro_f1, macro_recall::DOUBLE AS macro_recall, tp::DOUBLE AS tp, zero::DOUBLE AS zero FROM f) ON COLUMNS(*) INTO NAME metric VALUE value""")
def q06(spark, d):
    """Headline metrics as rows of a report."""
    p = per_query(spark, d).agg(F.count("*").cast("double").alias("queries"), F.round(F.avg("f"), 9).alias("macro_f1"), F.round(F.avg("r"), 9).alias("macro_recall"), F.sum("tp").cast("double").alias("tp"), F.count_if(F.col("tp") == 0).cast("double").alias("zero"))
    return p.unpivot([], p.columns, "metric", "value")


def rendered(frame: DataFrame, heading: str, most: int = 50) -> str:
    """A report's section: the heading and the first ``most`` rows as a Markdown table."""
    rows = frame.limit(most).collect()
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"## {heading}", "", "| " + " | ".join(frame.columns) + " |", "|" + "---|" * len(frame.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]) + "\n"


@query("Q07_report")
def q07(spark, d):
    """The headline metrics rendered as text, one row a line."""
    text = rendered(q06(spark, d).orderBy("metric"), "Metrics")
    return spark.createDataFrame(list(enumerate(text.splitlines())), "n int, line string")


class Artifacts:
    """Tables of a folder by name, read again only when their files have changed."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.seen = spark, folder, {}

    def stamp(self, name: str) -> tuple:
        """Latest change and size of a table's files, asked of the file system that holds them; empty if there are none."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        try:
            r = files.load(f"{self.folder}/{name}.parquet").agg(F.max("modificationTime"), F.sum("length"), F.count("*")).first()
        except Exception:
            return ()
        return tuple(r) if r[2] else ()

    def table(self, name: str) -> DataFrame:
        now = self.stamp(name)
        if not now:
            raise RequestError(503, f"no table {name!r}")
        if self.seen.get(name, (None,))[0] != now:
            self.spark.catalog.refreshByPath(f"{self.folder}/{name}.parquet")
            self.seen[name] = now, self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self.seen[name][1]

    def grouped(self, name: str, *columns: str) -> DataFrame:
        """(qid, rows): the rows of a table by query, as the service hands them out."""
        return self.table(name).where("qid is not null").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("rows"))

    def health(self, *names: str) -> dict[str, str]:
        return {n: "ok" if self.stamp(n) else "missing" for n in names}


@query("Q14_plans_by_query", "SELECT qid, list({'source': source, 'pred_id': pred_id} ORDER BY source, pred_id) AS rows FROM (SELECT qid, source, pred_id FROM predictions WHERE qid IS NOT NULL) GROUP BY qid")
def q14(spark, d):
    return Artifacts(spark, d).grouped("predictions", "source", "pred_id")


@query("A12_artifact_health", "SELECT * FROM (VALUES ('documents', 'ok'), ('gone', 'missing'), ('predictions', 'ok')) t(name, state)")
def a12(spark, d):
    return spark.createDataFrame(sorted(Artifacts(spark, d).health("predictions", "documents", "gone").items()), "name string, state string")


# ---- C01, I13, L04

_DATES = ("%Y%m%d", "%Y-%m-%d", "%Y/%m/%d", "%Y-%m-%dT%H:%M:%S")
_DATE_SHAPES = (r"^\d{8}$", r"^\d{4}-\d{2}-\d{2}$", r"^\d{4}/\d{2}/\d{2}$", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$")
_PARSED = "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(pt, '{s}') THEN try_strptime(pt, '{f}') END" for s, f in zip(_DATE_SHAPES, _DATES)) + ")"
PROFILE = ("rows", "valid_json", "invalid_json", "not_a_list", "empty_lists", "least_items", "most_items", "mean_items", "median_items", "p90_items", "invalid_questions", "repeated_questions", "dates_read", "dates_unread", "dates_missing", "errors", "warnings")


@query("C01_dataset_profile", f"""WITH p AS (SELECT row_id, question, trim(source_meta.published_time) AS pt, answer IS NOT NULL AND json_valid(answer) AS ok, CASE WHEN json_valid(answer) AND json_type(answer) = 'ARRAY' THEN json_array_length(answer) END AS items FROM pasa_like_sample),
d AS (SELECT *, pt IS NULL AS nodate, {_PARSED} IS NOT NULL AS dated, question IS NULL OR trim(question) = '' AS noq FROM p),
r AS (SELECT coalesce(sum(n - 1), 0) AS repeated FROM (SELECT count(*) AS n FROM d WHERE NOT noq GROUP BY trim(question))),
s AS (SELECT count(*)::DOUBLE AS rows, count(*) FILTER (ok)::DOUBLE AS valid_json, count(*) FILTER (NOT ok)::DOUBLE AS invalid_json, count(*) FILTER (ok AND items IS NULL)::DOUBLE AS not_a_list, count(*) FILTER (items = 0)::DOUBLE AS empty_lists, min(items)::DOUBLE AS least_items, max(items)::DOUBLE AS most_items,
  round(avg(items), 9)::DOUBLE AS mean_items, median(items)::DOUBLE AS median_items, quantile_disc(items, 0.9)::DOUBLE AS p90_items, count(*) FILTER (noq)::DOUBLE AS invalid_questions, (SELECT repeated FROM r)::DOUBLE AS repeated_questions, count(*) FILTER (dated)::DOUBLE AS dates_read, count(*) FILTER (NOT nodate AND NOT dated)::DOUBLE AS dates_unread,
  count(*) FILTER (nodate)::DOUBLE AS dates_missing, (count(*) FILTER (NOT ok) + count(*) FILTER (ok AND items IS NULL) + count(*) FILTER (noq))::DOUBLE AS errors, (count(*) FILTER (items = 0) + count(*) FILTER (NOT dated))::DOUBLE AS warnings FROM d)
UNPIVOT s ON {', '.join(PROFILE)} INTO NAME measure VALUE value""")
def c01(spark, d):
    """What a benchmark file is like: JSON, lists and their lengths, questions, dates, and how many errors and warnings that makes."""
    pt = F.trim("source_meta.published_time")
    formats = ("yyyyMMdd", "yyyy-MM-dd", "yyyy/MM/dd", "yyyy-MM-dd'T'HH:mm:ss")
    dated = F.coalesce(*[F.when(pt.rlike(s), F.try_to_timestamp(pt, F.lit(f))) for s, f in zip(_DATE_SHAPES, formats)]).isNotNull()
    whole = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), "answer", F.lit("]"))), "$", "array<variant>")
    ok = F.coalesce(F.size(whole) == 1, F.lit(False))
    items = F.when(ok & F.schema_of_variant(whole[0]).startswith("ARRAY"), F.size(F.try_variant_get(whole[0], "$", "array<variant>")))
    p = table(spark, d, "pasa_like_sample").select("question", ok.alias("ok"), items.alias("items"), dated.alias("dated"), pt.isNull().alias("nodate"), (F.coalesce(F.trim("question"), F.lit("")) == "").alias("noq"))
    n = lambda c: F.count_if(c).cast("double")
    c = F.col
    s = p.agg(F.count("*").cast("double").alias("rows"), n(c("ok")).alias("valid_json"), n(~c("ok")).alias("invalid_json"), n(c("ok") & c("items").isNull()).alias("not_a_list"), n(c("items") == 0).alias("empty_lists"), F.min("items").cast("double").alias("least_items"), F.max("items").cast("double").alias("most_items"),
              F.round(F.avg("items"), 9).alias("mean_items"), F.median("items").cast("double").alias("median_items"), F.expr("percentile_disc(0.9) within group (order by items)").cast("double").alias("p90_items"), n(c("noq")).alias("invalid_questions"),
              (F.count_if(~c("noq")) - F.count_distinct(F.when(~c("noq"), F.trim("question")))).cast("double").alias("repeated_questions"), n(c("dated")).alias("dates_read"), n(~c("nodate") & ~c("dated")).alias("dates_unread"), n(c("nodate")).alias("dates_missing"),
              (n(~c("ok")) + n(c("ok") & c("items").isNull()) + n(c("noq"))).alias("errors"), (n(c("items") == 0) + n(~c("dated"))).alias("warnings"))
    return s.unpivot([], list(PROFILE), "measure", "value")


@query("L04_missing_and_extra", f"WITH {PER}, g AS (SELECT DISTINCT qid FROM gold) SELECT 'missing' AS what, qid, gold_count AS n, 0.0::DOUBLE AS f1 FROM per WHERE predicted = 0 UNION ALL SELECT 'extra', r.qid, count(*), NULL FROM ranked r ANTI JOIN g USING (qid) GROUP BY r.qid")
def l04(spark, d):
    """Queries with gold and no results, which score nothing, and queries with results and no gold, which don't score."""
    missing = per_query(spark, d).where("predicted = 0").select(F.lit("missing").alias("what"), "qid", F.col("gold_count").alias("n"), F.lit(0.0).alias("f1"))
    extra = ranked(spark, d).join(gold(spark, d).select("qid").distinct(), "qid", "left_anti").groupBy("qid").agg(F.count("*").alias("n"))
    return missing.unionByName(extra.select(F.lit("extra").alias("what"), "qid", "n", F.lit(None).cast("double").alias("f1")))


def _stats_sql() -> str:
    from rankloom.registry import SQL

    parts = [(SQL["I05_selector_modes"], "label", "label"), (SQL["I03_guard_filter"], "decision", "decision"), (SQL["I07_guard_aware"], "verdict", "verdict")]
    counted = [f"SELECT '{w}' AS what, mode, {c} AS name, count(*)::DOUBLE AS n FROM ({q}) GROUP BY mode, {c}" for q, w, c in parts]
    sizes = [f"SELECT '{w}_output' AS what, mode, unnest(['min', 'mean', 'max']) AS name, unnest([min(k), round(avg(k), 9), max(k)])::DOUBLE AS n FROM (SELECT mode, qid, count(*) AS k FROM ({q}) GROUP BY ALL) GROUP BY mode" for q, w, _ in parts]
    tags = f"SELECT 'tag' AS what, 'balanced' AS mode, t AS name, count(*)::DOUBLE AS n FROM (SELECT unnest(list_concat(tags, lacks)) AS t FROM ({SQL['I06_selector_tags']})) GROUP BY t"
    return " UNION ALL ".join([*counted, *sizes, tags])


@query("I13_selection_stats", _stats_sql())
def i13(spark, d):
    """Results by label, decision and verdict in every mode, how many a query gets, and how often each tag stands."""
    from rankloom.plans.rerank import i03, i05, i06, i07

    out = None
    for made, name in ((i05(spark, d), "label"), (i03(spark, d), "decision"), (i07(spark, d), "verdict")):
        made = stage(made.select("qid", "mode", name), "selected")
        by = made.groupBy("mode", F.col(name).alias("name")).agg(F.count("*").cast("double").alias("n")).select(F.lit(name).alias("what"), "mode", "name", "n")
        k = made.groupBy("mode", "qid").agg(F.count("*").alias("k")).groupBy("mode").agg(F.min("k").cast("double").alias("min"), F.round(F.avg("k"), 9).alias("mean"), F.max("k").cast("double").alias("max"))
        part = by.unionByName(k.unpivot(["mode"], ["min", "mean", "max"], "name", "n").select(F.lit(f"{name}_output").alias("what"), "mode", "name", "n"))
        out = part if out is None else out.unionByName(part)
    tags = i06(spark, d).select(F.explode(F.concat("tags", "lacks")).alias("name")).groupBy("name").agg(F.count("*").cast("double").alias("n"))
    return out.unionByName(tags.select(F.lit("tag").alias("what"), F.lit("balanced").alias("mode"), "name", "n"))

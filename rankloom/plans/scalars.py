"""Queries of the scalar functions, over records, candidates and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.functions import ident as I
from rankloom.functions import text as X
from rankloom.plans.inputs import CAND, candidates, norm, table
from rankloom.registry import query

_TR = r"[ \t\r\n.,;:)\]}>\"'']+$"


def _one(name, fn, sql=None, extra=""):
    """Register a function of one text column of papers_with_duplicates as (rec_id, value)."""

    def q(spark, d):
        return table(spark, d, "papers_with_duplicates").select("rec_id", fn().alias("value"))

    query(name, sql and f"SELECT rec_id, {sql} AS value FROM papers_with_duplicates{extra}")(q)


_DOI = "coalesce(doi, externalids.doi)"
_dec = f"trim(url_decode(replace(replace(replace({_DOI}, '+', '%2B'), '&amp;', '&'), '&lt;', '<')))"
_bare = f"regexp_extract(regexp_replace({_dec}, '{_TR}', ''), '(?i)(10\\.\\d{{4,9}}/[^\\s\"<>]+)', 1)"
_SQL_DOI = f"nullif(lower(regexp_replace({_bare}, '{_TR}', '')), '')"
doi = lambda: F.coalesce("doi", "externalids.doi")
title = lambda: F.coalesce("title", "display_name")
_T = "coalesce(title, display_name)"
_ARX = "coalesce(arxiv_id, externalids.arxiv)"
arx = lambda: F.coalesce("arxiv_id", "externalids.arxiv")
_SQL_ARX = f"""nullif(lower(regexp_extract({_ARX}, '(?i)(\\d{{4}}\\.\\d{{4,5}})', 1)), '')"""

_one("B01_extract_doi", lambda: I.extract_doi(doi()), _SQL_DOI)
_one("B02_normalize_doi", lambda: I.normalize_doi(doi()), _SQL_DOI)
_one("B03_arxiv_from_doi", lambda: I.arxiv_from_doi(F.concat(F.lit("https://doi.org/10.48550/arXiv."), I.extract_arxiv(arx()))),
     f"CASE WHEN regexp_full_match(lower({_ARX}), '(https://arxiv.example/abs/)?(arxiv:)?\\d{{4}}\\.\\d{{4,5}}(v\\d+)?') AND NOT lower({_ARX}) LIKE 'https://arxiv.example%' THEN {_SQL_ARX} END")
_one("B04_extract_arxiv", lambda: I.extract_arxiv(arx()),
     f"CASE WHEN regexp_full_match(trim({_ARX}), '(?i)(arxiv:\\s*)?\\d{{4}}\\.\\d{{4,5}}(v\\d+)?(\\.pdf)?') THEN {_SQL_ARX} END")
_one("B05_openalex_id", lambda: I.extract_openalex(F.col("id")), "nullif(upper(regexp_extract(id, '(?i)(W\\d+)', 1)), '')")
_one("B06_s2_id", lambda: I.normalize_s2(F.col("paperid")), "lower(trim(paperid))")
_one("B07_normalize_url", lambda: I.normalize_url(F.concat(F.lit("HTTPS://Data.Example//sets/"), F.col("rec_id").cast("string"), F.lit("/?utm_source=a&b=2&a=1#x"))),
     "'https://data.example/sets/' || rec_id || '?a=1&b=2'")
_one("B08_normalize_title", lambda: X.fold_title(title()))
_one("B09_title_fingerprint", lambda: F.substring(F.sha1(X.ascii_words(title())), 1, 16), f"substr(sha1({norm(_T)}), 1, 16)")
_one("B10_first_author_key", lambda: X.ascii_words(F.try_element_at(F.coalesce("authors.name", "authorships.author.display_name"), F.lit(1))),
     norm("coalesce(authors[1].name, CASE WHEN authors IS NULL THEN authorships[1].author.display_name END)"))
_one("B11_letters_key", lambda: X.letters_key(title()), f"lower(regexp_replace(coalesce({_T}, ''), '[^\\p{{L}}]', '', 'g'))")
_one("B12_light_identifier", lambda: I.light_ident(arx()), f"trim(lower(regexp_replace(replace(replace(trim(coalesce({_ARX}, '')), 'arXiv:', ''), 'arxiv:', ''), '(?i)v\\d+$', '')))")
_one("B15_key_words", lambda: X.key_words(F.col("source")), "trim(regexp_replace(lower(replace(source, '_', ' ')), '[^a-z0-9]+', ' ', 'g'))")
_SING = "CASE t " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in X.SINGULAR.items()) + " ELSE t END"
_one("B16_evidence_words", lambda: X.evidence_words(title()), f"array_to_string(list_transform(string_split({norm(_T)}, ' '), lambda t: {_SING}), ' ')")
_one("B20_tokens", lambda: F.array_join(X.tokens(title()), " "),
     f"array_to_string(list_filter(regexp_extract_all({norm(_T)}, '[a-z][a-z0-9]*|\\d+[a-z]*'), lambda t, i: len(t) > 1 AND NOT list_contains([{', '.join(repr(w) for w in X.STOPWORDS)}], t) AND list_position(regexp_extract_all({norm(_T)}, '[a-z][a-z0-9]*|\\d+[a-z]*'), t) = i), ' ')")
_one("B25_slug", lambda: X.slug(title(), 40),
     f"coalesce(nullif(substr(regexp_replace(regexp_replace(lower({_T}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 40), ''), CASE WHEN {_T} IS NOT NULL THEN 'constraint' ELSE 'constraint' END)")
_one("B32_search_query", lambda: F.trim(F.regexp_replace(F.regexp_replace(title(), r"[^\p{L}\p{N}]+", " "), " +", " ")),
     f"trim(regexp_replace({_T}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))")
_one("B33_cutoff_date", lambda: F.date_format(F.date_sub(F.try_to_date("publication_date", "yyyyMMdd"), 7), "yyyy-MM-dd"),
     "CASE WHEN regexp_full_match(publication_date, '\\d{8}') THEN strftime(try_strptime(publication_date, '%Y%m%d') - INTERVAL 7 DAY, '%Y-%m-%d') END")
_one("B34_parse_date", lambda: F.date_format(F.coalesce(*[F.try_to_date("publication_date", f) for f in ("yyyyMMdd", "yyyy-MM-dd", "yyyy/MM/dd")]), "yyyy-MM-dd"),
     "strftime(coalesce(CASE WHEN regexp_full_match(publication_date, '\\d{8}') THEN try_strptime(publication_date, '%Y%m%d') END, CASE WHEN regexp_full_match(publication_date, '\\d{4}-\\d{2}-\\d{2}') THEN try_strptime(publication_date, '%Y-%m-%d') END, CASE WHEN regexp_full_match(publication_date, '\\d{4}/\\d{2}/\\d{2}') THEN try_strptime(publication_date, '%Y/%m/%d') END), '%Y-%m-%d')")


@query("B26_token_jaccard", f"""WITH {CAND}, t AS (
  SELECT qid, pred_id, item_pos, list_distinct(string_split({norm('title')}, ' ')) AS a, list_distinct(string_split({norm('abstract')}, ' ')) AS b FROM cand)
SELECT qid, pred_id, item_pos, CASE WHEN a = [''] OR b = [''] THEN 0.0 ELSE round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 9) END AS jaccard FROM t""")
def b26(spark, d):
    words = lambda c: F.filter(F.array_distinct(F.split(X.ascii_words(F.col(c)), " ")), lambda t: t != "")
    return candidates(spark, d).select("qid", "pred_id", "item_pos", F.round(X.jaccard(words("title"), words("abstract")), 9).alias("jaccard"))


_QT = """q AS (SELECT qid, min(question) AS question FROM predictions WHERE question IS NOT NULL GROUP BY qid)"""


def _tok_sql(c):
    stop = ", ".join(repr(w) for w in X.STOPWORDS)
    return f"list_distinct(list_filter(regexp_extract_all({norm(c)}, '[a-z][a-z0-9]*|\\d+[a-z]*'), lambda t: len(t) > 1 AND NOT list_contains([{stop}], t)))"


def soft_sql(q, t):
    near = f"list_filter({q}, lambda x: NOT list_contains({t}, x) AND len(x) >= 4 AND len(list_filter({t}, lambda y: len(y) >= 4 AND (starts_with(y, x) OR starts_with(x, y)))) > 0)"
    return f"CASE WHEN len({q}) = 0 OR len({t}) = 0 THEN 0.0 ELSE (len(list_intersect({q}, {t})) + 0.5 * len({near})) / len({q}) END"


def questions(spark, d):
    return table(spark, d, "predictions").where("question is not null").groupBy("qid").agg(F.min("question").alias("question"))


@query("B28_soft_overlap", f"""WITH {CAND}, {_QT}, t AS (
  SELECT c.qid, pred_id, item_pos, {_tok_sql('q.question')} AS a, {_tok_sql('c.title')} AS b FROM cand c JOIN q USING (qid))
SELECT qid, pred_id, item_pos, round({soft_sql('a', 'b')}, 9) AS overlap FROM t""")
def b28(spark, d):
    c = candidates(spark, d).join(questions(spark, d), "qid")
    return c.select("qid", "pred_id", "item_pos", F.round(X.soft_overlap(X.tokens(F.col("question")), X.tokens(F.col("title"))), 9).alias("overlap"))


@query("B29_phrase_match", f"""WITH {CAND}
SELECT qid, pred_id, item_pos FROM cand WHERE contains(' ' || {norm('title')} || ' ', ' benchmark ') OR contains(' ' || {norm('title')} || ' ', ' benchmarks ')""")
def b29(spark, d):
    return candidates(spark, d).where(X.has_phrase(X.ascii_words(F.col("title")), F.lit("benchmark"))).select("qid", "pred_id", "item_pos")


@query("B27_sequence_ratio")
def b27(spark, d):
    c = candidates(spark, d).where("abstract is not null")
    return c.select("qid", "pred_id", "item_pos", F.round(X.sequence_ratio(F.col("title"), F.col("abstract")), 9).alias("ratio"))


@query("B31_inverted_index", """WITH w AS (
  SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) - 1 AS p FROM documents WHERE doc_kind = 'question' AND text IS NOT NULL)
SELECT doc_id, string_agg(w, ' ' ORDER BY p, w) AS text FROM w GROUP BY doc_id""")
def b31(spark, d):
    """Texts of the documents of kind question, the subset that the SQL names."""
    return rebuilt(spark, d, "doc_kind = 'question'")


@query("B31_inverted_index_all")
def b31_all(spark, d):
    """Texts of every document that has one, abstracts and full texts too."""
    return rebuilt(spark, d)


def rebuilt(spark, d, which: str = "true"):
    """(doc_id, text) from the word -> positions map of each text."""
    w = table(spark, d, "documents").where(which).where("text is not null").select("doc_id", F.posexplode(F.split("text", " ")).alias("p", "w"))
    index = w.groupBy("doc_id", "w").agg(F.collect_list("p").alias("ps"))
    index = index.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("index"))
    return index.select("doc_id", X.inverted_index_text(F.col("index")).alias("text"))


@query("B35_safe_numbers", f"""WITH {CAND}
SELECT qid, pred_id, item_pos, greatest(0.0, least(1.0, coalesce(score, 0.0))) AS clamped, CASE WHEN coalesce(nsrc, 0) = 0 THEN 0.0 ELSE round(coalesce(score, 0.0) / nsrc, 9) END AS per_source FROM cand""")
def b35(spark, d):
    s = F.coalesce("score", F.lit(0.0))
    return candidates(spark, d).select("qid", "pred_id", "item_pos", X.clamp(s).alias("clamped"), F.round(X.ratio(s, F.coalesce("nsrc", F.lit(0))), 9).alias("per_source"))


_IDS = f"{_SQL_DOI} AS d, CASE WHEN regexp_full_match(trim({_ARX}), '(?i)(arxiv:\\s*)?\\d{{4}}\\.\\d{{4,5}}(v\\d+)?(\\.pdf)?') THEN {_SQL_ARX} END AS a, nullif(upper(regexp_extract(id, '(?i)(W\\d+)', 1)), '') AS o, lower(trim(paperid)) AS s, substr(sha1({norm(_T)}), 1, 16) AS t"


def record_ids(spark, d):
    return table(spark, d, "papers_with_duplicates").select(
        "rec_id", I.extract_doi(doi()).alias("d"), I.extract_arxiv(arx()).alias("a"), I.extract_openalex(F.col("id")).alias("o"), I.normalize_s2(F.col("paperid")).alias("s"),
        F.substring(F.sha1(X.ascii_words(title())), 1, 16).alias("t"))


@query("B37_candidate_keys", f"""WITH {CAND} SELECT qid, pred_id, item_pos, key FROM cand""")
def b37(spark, d):
    return candidates(spark, d).select("qid", "pred_id", "item_pos", "key")



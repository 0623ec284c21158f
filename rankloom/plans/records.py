"""Entity resolution, citation graph, sources, sinks and the service's views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions import ident as I
from rankloom.functions.alike import alike_titles, common_letters_of
from rankloom.functions.text import ascii_words, letters_key, ratio, sequence_ratio, tokens
from rankloom.plans.evaluation import PER, RANKED, per_query, ranked
from rankloom.plans.inputs import CAND, candidates, gold, letters, norm, table
from rankloom.plans.ranking import STRONG, place, strong_id
from rankloom.plans.scalars import _IDS, arx, doi, questions, record_ids, title
from rankloom.registry import query

_T = "coalesce(title, display_name)"
_A1 = "coalesce(authors[1].name, CASE WHEN authors IS NULL THEN authorships[1].author.display_name END)"
REC = f"""r0 AS (SELECT rec_id, {_IDS}, {norm(_T)} AS nt, {norm(_A1)} AS au, coalesce(year, publication_year) AS yr FROM papers_with_duplicates)"""


def records(spark, d) -> DataFrame:
    """Identifiers, normalised title, first author and year of every record."""
    r = table(spark, d, "papers_with_duplicates")
    more = r.select("rec_id", ascii_words(title()).alias("nt"), ascii_words(F.try_element_at(F.coalesce("authors.name", "authorships.author.display_name"), F.lit(1))).alias("au"),
                    F.coalesce("year", "publication_year").alias("yr"))
    return record_ids(spark, d).join(more, "rec_id")


def title_pairs(spark, d) -> DataFrame:
    """(a, b, reason): records of one normalised title that author and year don't part, no identifier in conflict.

    Records meet under title and first author, or under title and year where an author
    is missing, so a common title alone gives no pair.
    """
    r = records(spark, d).where("length(nt) >= 12")
    x, y = r.select(*(F.col(c).alias(f"{c}_a") for c in r.columns)), r.select(*(F.col(c).alias(f"{c}_b") for c in r.columns))
    c = F.col
    free = ~I.ids_conflict([c(f"{k}_a") for k in "daos"], [c(f"{k}_b") for k in "daos"])
    by_author = x.join(y, (c("nt_a") == c("nt_b")) & (c("au_a") == c("au_b")) & (c("au_a") != "") & (c("rec_id_a") < c("rec_id_b")) & free)
    gap = F.abs(c("yr_a") - c("yr_b"))
    same = by_author.where(gap.isNull() | (gap <= 2)).select(
        c("rec_id_a").alias("a"), c("rec_id_b").alias("b"), F.when(gap.isNull(), "author").otherwise("author_year").alias("reason"))
    by_year = x.join(y, (c("nt_a") == c("nt_b")) & (c("yr_a") == c("yr_b")) & (c("rec_id_a") < c("rec_id_b")) & free & ((c("au_a") == "") | (c("au_b") == "")))
    return same.unionByName(by_year.select(c("rec_id_a").alias("a"), c("rec_id_b").alias("b"), F.lit("year").alias("reason")))


_CONF = " AND ".join(f"NOT coalesce(x.{k} <> y.{k}, false)" for k in "daos")
TPAIRS = f"""{REC}, tp AS (SELECT x.rec_id AS a, y.rec_id AS b, CASE WHEN x.au = y.au AND x.au <> '' THEN CASE WHEN x.yr IS NULL OR y.yr IS NULL THEN 'author' ELSE 'author_year' END ELSE 'year' END AS reason
  FROM r0 x JOIN r0 y ON x.nt = y.nt AND x.rec_id < y.rec_id WHERE len(x.nt) >= 12 AND {_CONF}
  AND ((x.au = y.au AND x.au <> '' AND (x.yr IS NULL OR y.yr IS NULL OR abs(x.yr - y.yr) <= 2)) OR (x.yr = y.yr AND (x.au = '' OR y.au = ''))))"""


@query("D02_title_pairs", f"WITH {TPAIRS} SELECT a, b, reason FROM tp")
def d02(spark, d):
    return title_pairs(spark, d)


@query("D03_identifier_conflicts", f"""WITH {REC} SELECT x.rec_id AS a, y.rec_id AS b FROM r0 x JOIN r0 y ON x.nt = y.nt AND x.au = y.au AND x.rec_id < y.rec_id WHERE len(x.nt) >= 12 AND x.au <> '' AND NOT ({_CONF})""")
def d03(spark, d):
    r = records(spark, d).where("length(nt) >= 12 and au <> ''")
    x, y = r.select(*(F.col(c).alias(f"{c}_a") for c in r.columns)), r.select(*(F.col(c).alias(f"{c}_b") for c in r.columns))
    c = F.col
    hit = I.ids_conflict([c(f"{k}_a") for k in "daos"], [c(f"{k}_b") for k in "daos"])
    return x.join(y, (c("nt_a") == c("nt_b")) & (c("au_a") == c("au_b")) & (c("rec_id_a") < c("rec_id_b")) & hit).select(c("rec_id_a").alias("a"), c("rec_id_b").alias("b"))


def entities(spark, d) -> DataFrame:
    """(rec_id, entity): records linked by a shared identifier or a title pair; the smallest record names the entity.

    Labels spread over links, with identifiers as nodes of their own, and jump to their
    label's label each round, until nothing changes; every round is a written table.
    """
    from rankloom.scratch import drop, stage

    ids = record_ids(spark, d).select("rec_id", F.explode(I.identity_keys(*(F.col(k) for k in "daos"))).alias("k"))
    star = ids.join(ids.groupBy("k").agg(F.min("rec_id").alias("hub")), "k").select(F.col("rec_id").alias("a"), F.col("hub").alias("b"))
    pairs = star.unionByName(title_pairs(spark, d).select("a", "b")).where("a <> b")
    links = stage(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    label = stage(record_ids(spark, d).select("rec_id", F.col("rec_id").alias("entity")), "labels")
    while True:
        near = links.join(label, F.col("b") == F.col("rec_id")).groupBy(F.col("a").alias("rec_id")).agg(F.min("entity").alias("m"))
        moved = label.join(near, "rec_id", "left").select("rec_id", F.least("entity", F.coalesce("m", "entity")).alias("entity"), F.col("entity").alias("was"))
        up = moved.select(F.col("rec_id").alias("e"), F.col("entity").alias("top"))
        jumped = moved.join(up, F.col("entity") == F.col("e")).select("rec_id", F.least("top", "entity").alias("entity"), "was")
        new = stage(jumped, "labels", changed=F.count_if(F.col("entity") != F.col("was")))
        drop(label)
        label = new.select("rec_id", "entity")
        label._rankloom_path = new._rankloom_path
        if not new.measured["changed"]:
            return label


_CC = f"""WITH RECURSIVE {TPAIRS}, ks AS (SELECT rec_id, unnest([CASE WHEN d IS NOT NULL THEN 'd' || d END, CASE WHEN a IS NOT NULL THEN 'a' || a END, CASE WHEN o IS NOT NULL THEN 'o' || o END, CASE WHEN s IS NOT NULL THEN 's' || s END]) AS k FROM r0),
hub AS (SELECT k, min(rec_id) AS h FROM ks WHERE k IS NOT NULL GROUP BY k), e0 AS (SELECT rec_id AS a, h AS b FROM ks JOIN hub USING (k) UNION SELECT a, b FROM tp),
e AS (SELECT a, b FROM e0 UNION SELECT b, a FROM e0), reach AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b),
ent AS (SELECT r0.rec_id, least(r0.rec_id, coalesce(min(reach.b), r0.rec_id)) AS entity FROM r0 LEFT JOIN reach ON reach.a = r0.rec_id GROUP BY r0.rec_id)"""


@query("D01_entities", f"{_CC} SELECT rec_id, entity FROM ent")
def d01(spark, d):
    return entities(spark, d)


_VEN = "CASE WHEN source = 'openalex' THEN CASE WHEN json_valid(venue) THEN venue->>'$.display_name' END ELSE venue END"
_LONG = lambda c: f"arg_max({c}, (len({c}), -rec_id)) FILTER ({c} IS NOT NULL)"
_FIRST = lambda c: f"arg_min({c}, rec_id) FILTER ({c} IS NOT NULL)"


@query("D04_survivorship", f"""{_CC}, pv AS (SELECT ent.entity, p.rec_id, {_T} AS t, {_VEN} AS v, abstract AS ab, publication_date AS pd, CASE WHEN authors IS NOT NULL THEN len(authors) ELSE len(authorships) END AS na, coalesce(year, publication_year) AS y, citation_count AS cc, r0.d, r0.a, r0.o, r0.s FROM ent JOIN papers_with_duplicates p USING (rec_id) JOIN r0 USING (rec_id))
SELECT entity, count(*) AS members, {_LONG('t')} AS title, {_LONG('v')} AS venue, {_LONG('ab')} AS abstract, {_LONG('pd')} AS published, max(na) AS authors, min(y) AS year, max(cc) AS citations, {_FIRST('d')} AS doi, {_FIRST('a')} AS arxiv, {_FIRST('o')} AS openalex, {_FIRST('s')} AS s2 FROM pv GROUP BY entity""")
def d04(spark, d):
    """One record an entity: longest title, venue, abstract and date, most authors, first year and identifiers, most citations; ties to the smallest record."""
    p = table(spark, d, "papers_with_duplicates")
    venue = F.when(F.col("source") == "openalex", F.get_json_object("venue", "$.display_name")).otherwise(F.col("venue"))
    count = F.when(F.col("authors").isNotNull(), F.size("authors")).when(F.col("authorships").isNotNull(), F.size("authorships"))
    p = p.select("rec_id", title().alias("t"), venue.alias("v"), F.col("abstract").alias("ab"), F.col("publication_date").alias("pd"), count.cast("bigint").alias("na"), F.coalesce("year", "publication_year").alias("y"), "citation_count")
    j = entities(spark, d).join(p, "rec_id").join(record_ids(spark, d).select("rec_id", *"daos"), "rec_id")
    longest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(F.length(c), -F.col("rec_id"))))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("rec_id")))
    return j.groupBy("entity").agg(F.count("*").alias("members"), longest("t").alias("title"), longest("v").alias("venue"), longest("ab").alias("abstract"), longest("pd").alias("published"), F.max("na").alias("authors"), F.min("y").alias("year"),
                                   F.max("citation_count").alias("citations"), first("d").alias("doi"), first("a").alias("arxiv"), first("o").alias("openalex"), first("s").alias("s2"))


@query("D05_review_pairs")
def d05(spark, d):
    """Records whose normalised titles are alike but not equal, for review; neither author nor year matters.

    Distinct titles are compared once, in blocks of like length, after lossless bounds.
    """
    r = records(spark, d).where("nt <> ''").select("rec_id", "nt")
    found = alike_titles(r.select(F.col("nt").alias("t")).distinct(), 0.93)
    x, y = r.toDF("x", "ta"), r.toDF("y", "tb")
    pairs = found.join(x, "ta").join(y, "tb")
    first = F.col("x") < F.col("y")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.when(first, F.col("ab")).otherwise(F.col("ba")).alias("ratio")).where("ratio >= 0.93")


@query("D06_keep_first", f"""WITH {CAND} SELECT qid, source, min(rank) AS rank, count(*) - 1 AS removed FROM cand GROUP BY qid, source, key""")
def d06(spark, d):
    return candidates(spark, d).groupBy("qid", "source", "key").agg(F.min("rank").cast("bigint").alias("rank"), (F.count("*") - 1).alias("removed")).drop("key")


@query("D07_keep_first_v2", f"""WITH {CAND} SELECT qid, source, {letters('title')} AS tkey, min(rank) AS rank FROM cand GROUP BY ALL""")
def d07(spark, d):
    return candidates(spark, d).groupBy("qid", "source", letters_key(F.col("title")).alias("tkey")).agg(F.min("rank").cast("bigint").alias("rank"))


@query("D11_near_matches")
def d11(spark, d):
    """Unmatched candidates beside unmatched gold of the same query: letter ratio 0.88 or word jaccard 0.75, with both.

    Every two titles of a query meet; the ratio is taken unless its bounds (lengths, longest
    common subsequence) keep it below 0.88 and the jaccard doesn't reach 0.75 either.
    """
    c, g = ranked(spark, d), gold(spark, d)
    told = lambda t, p: (ascii_words(F.col(t)).alias(f"{p}n"), tokens(F.col(t)).alias(f"{p}t"))
    a = c.join(g.select("qid", "tkey"), ["qid", "tkey"], "left_anti").select("qid", "rank", *told("title", "a")).where("an <> ''")
    b = g.join(c.select("qid", "tkey"), ["qid", "tkey"], "left_anti").select("qid", "gold_index", *told("title", "b")).where("bn <> ''")
    jac = ratio(F.size(F.array_intersect("at", "bt")), F.size(F.array_union("at", "bt")))
    long = F.length("an") + F.length("bn")
    pairs = a.join(b, "qid").withColumn("jaccard", F.round(jac, 9)).where((F.col("jaccard") >= 0.75) | (2 * F.least(F.length("an"), F.length("bn")) >= 0.88 * long - 1e-6))
    pairs = pairs.where((F.col("jaccard") >= 0.75) | (2 * common_letters_of(F.col("an"), F.col("bn")) >= 0.88 * long - 1e-6))
    pairs = pairs.withColumn("ratio", F.round(sequence_ratio(F.col("an"), F.col("bn")), 9))
    return pairs.where("ratio >= 0.88 or jaccard >= 0.75").select("qid", "rank", "gold_index", "jaccard", "ratio")


@query("D16_left_join", f"WITH {CAND} SELECT g.qid, count(c.key) AS items FROM (SELECT DISTINCT qid FROM pasa_like_sample WHERE qid IS NOT NULL) g LEFT JOIN cand c USING (qid) GROUP BY g.qid")
def d16(spark, d):
    g = table(spark, d, "pasa_like_sample").where("qid is not null").select("qid").distinct()
    return g.join(candidates(spark, d).select("qid", "key"), "qid", "left").groupBy("qid").agg(F.count("key").alias("items"))


@query("F09_first_wins", f"""WITH {CAND} SELECT qid, key, arg_min(source, (source, rank)) AS source, count(*) AS seen FROM cand GROUP BY qid, key""")
def f09(spark, d):
    return candidates(spark, d).groupBy("qid", "key").agg(F.min_by("source", F.struct("source", "rank")).alias("source"), F.count("*").alias("seen"))


# ---- citations: order lines stand for one-hop edges, from the order to the part

EDGES = """ed0 AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem),
ed AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS out_rank, row_number() OVER (PARTITION BY dst ORDER BY src) AS in_rank FROM ed0)"""


def edges(spark, d) -> DataFrame:
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
    return place(place(e, F.asc("dst"), by="src", name="out_rank"), F.asc("src"), by="dst", name="in_rank")


@query("K02_one_hop", f"WITH {EDGES} SELECT src AS seed, dst AS node, 'reference' AS edge_type, out_rank AS edge_rank FROM ed WHERE out_rank <= 15 UNION ALL SELECT dst, src, 'cited_by', in_rank FROM ed WHERE in_rank <= 15")
def k02(spark, d):
    e = edges(spark, d)
    out = e.where("out_rank <= 15").select(F.col("src").alias("seed"), F.col("dst").alias("node"), F.lit("reference").alias("edge_type"), F.col("out_rank").alias("edge_rank"))
    return out.unionByName(e.where("in_rank <= 15").select(F.col("dst").alias("seed"), F.col("src").alias("node"), F.lit("cited_by").alias("edge_type"), F.col("in_rank").alias("edge_rank")))


@query("K03_path_bonus", f"WITH {EDGES} SELECT dst AS node, count(DISTINCT src) AS support, round(least(0.15, 0.06 * max(1.0 / out_rank) + 0.04 * least(count(DISTINCT src), 2)), 9) AS bonus FROM ed WHERE out_rank <= 15 GROUP BY dst")
def k03(spark, d):
    support = F.count_distinct("src")
    bonus = F.least(F.lit(0.15), 0.06 * F.max(1.0 / F.col("out_rank")) + 0.04 * F.least(support, F.lit(2)))
    return edges(spark, d).where("out_rank <= 15").groupBy(F.col("dst").alias("node")).agg(support.alias("support"), F.round(bonus, 9).alias("bonus"))


@query("K04_merged_bonus", f"WITH {EDGES}, b AS (SELECT dst AS node, list((0.10 / out_rank)::DOUBLE ORDER BY src) AS bs FROM ed WHERE out_rank <= 15 GROUP BY dst) SELECT node, round(list_reduce(bs, lambda a, x: least(0.15::DOUBLE, greatest(a, x) + 0.02::DOUBLE)), 9) AS bonus FROM b")
def k04(spark, d):
    """Bonus of a node over its paths in order: each further path lifts the best so far by 0.02, up to 0.15."""
    e = edges(spark, d).where("out_rank <= 15").groupBy(F.col("dst").alias("node")).agg(F.array_sort(F.collect_list(F.struct("src", (0.10 / F.col("out_rank")).alias("b")))).alias("bs"))
    rest = F.slice("bs", F.lit(2), F.size("bs"))
    return e.select("node", F.round(F.aggregate(rest, F.col("bs")[0]["b"], lambda acc, x: F.least(F.lit(0.15), F.greatest(acc, x["b"]) + 0.02)), 9).alias("bonus"))


@query("K05_shown_path", f"WITH {EDGES} SELECT p.p_partkey AS node, coalesce(min(ed.src) FILTER (in_rank = 1), -1) AS shown FROM part p LEFT JOIN ed ON ed.dst = p.p_partkey GROUP BY p.p_partkey")
def k05(spark, d):
    first = edges(spark, d).where("in_rank = 1").select(F.col("dst").alias("p_partkey"), "src")
    return table(spark, d, "part").join(first, "p_partkey", "left").select(F.col("p_partkey").alias("node"), F.coalesce("src", F.lit(-1)).alias("shown"))


@query("K06_path_override", f"WITH {EDGES}, a AS (SELECT dst AS node, min(src) AS src FROM ed WHERE src % 2 = 0 GROUP BY dst), b AS (SELECT dst AS node, min(src) AS src FROM ed WHERE src % 2 = 1 GROUP BY dst) SELECT coalesce(a.node, b.node) AS node, coalesce(b.src, a.src) AS src FROM a FULL JOIN b ON a.node = b.node")
def k06(spark, d):
    e = edges(spark, d)
    side = lambda k: e.where(F.col("src") % 2 == k).groupBy(F.col("dst").alias("node")).agg(F.min("src").alias(f"s{k}"))
    return side(0).join(side(1), "node", "full").select("node", F.coalesce("s1", "s0").alias("src"))


@query("K07_budgeted_expansion", f"""WITH {EDGES}, n AS (SELECT src, count(*) AS calls FROM ed GROUP BY src), c AS (SELECT src, calls, sum(calls) OVER (ORDER BY src ROWS UNBOUNDED PRECEDING) AS used FROM n)
SELECT src, calls, CASE WHEN used <= 20000 THEN 'done' ELSE 'skipped' END AS state FROM c""")
def k07(spark, d):
    n = edges(spark, d).groupBy("src").agg(F.count("*").alias("calls")).repartitionByRange("src").select("*", F.spark_partition_id().alias("part"))
    # Running sums within range partitions, from the sums of the partitions before.
    sums = n.groupBy("part").agg(F.sum("calls").alias("s"))
    before = sums.select("part", F.coalesce(F.sum("s").over(Window.partitionBy(F.lit(1)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    n = n.join(F.broadcast(before), "part")
    used = F.col("before") + F.sum("calls").over(Window.partitionBy("part").orderBy("src").rowsBetween(Window.unboundedPreceding, 0))
    return n.select("src", "calls", F.when(used <= 20000, "done").otherwise("skipped").alias("state"))


@query("K08_path_coverage", f"WITH {EDGES} SELECT src, count(*) AS paths FROM ed WHERE in_rank <= 15 GROUP BY ROLLUP (src)")
def k08(spark, d):
    return edges(spark, d).where("in_rank <= 15").rollup("src").agg(F.count("*").alias("paths"))


# ---- sources and sinks

@query("A01_json_lines", "SELECT row_id, json_valid(answer) AS valid, CASE WHEN json_valid(answer) THEN json_type(answer) END AS kind FROM pasa_like_sample WHERE answer IS NOT NULL")
def a01(spark, d):
    v = F.try_parse_json(F.concat(F.lit("["), "answer", F.lit("]")))
    one = F.try_variant_get(v, "$", "array<variant>")
    kind = F.upper(F.regexp_extract(F.schema_of_variant(one[0]), r"^(\w+)", 1))
    ok = F.coalesce(F.size(one) == 1, F.lit(False))
    return table(spark, d, "pasa_like_sample").where("answer is not null").select("row_id", ok.alias("valid"), F.when(ok, F.replace(kind, F.lit("STRING"), F.lit("VARCHAR"))).alias("kind"))


@query("A09_cache_misses", """WITH k AS (SELECT DISTINCT sha256(question || '|50') AS k FROM predictions WHERE question IS NOT NULL), c AS (SELECT DISTINCT sha256(question || '|50') AS k FROM pasa_like_sample WHERE question IS NOT NULL) SELECT k FROM k ANTI JOIN c USING (k)""")
def a09(spark, d):
    key = lambda t: table(spark, d, t).where("question is not null").select(F.sha2(F.concat("question", F.lit("|50")), 256).alias("k")).distinct()
    return key("predictions").join(key("pasa_like_sample"), "k", "left_anti")


@query("A10_works_to_papers", f"""SELECT rec_id, display_name AS title, publication_year AS year, nullif(upper(regexp_extract(id, '(?i)(W\\d+)', 1)), '') AS openalex_id, CASE WHEN json_valid(venue) THEN venue->>'$.display_name' END AS venue, len(authorships) AS authors FROM papers_with_duplicates WHERE source = 'openalex'""")
def a10(spark, d):
    return table(spark, d, "papers_with_duplicates").where("source = 'openalex'").select(
        "rec_id", F.col("display_name").alias("title"), F.col("publication_year").alias("year"), I.extract_openalex(F.col("id")).alias("openalex_id"),
        F.get_json_object("venue", "$.display_name").alias("venue"), F.when(F.col("authorships").isNotNull(), F.size("authorships")).cast("bigint").alias("authors"))


@query("A13_error_rows", f"WITH {PER} SELECT qid, fp, fn FROM per WHERE fp > 0 OR fn > 0")
def a13(spark, d):
    return per_query(spark, d).where("fp > 0 or fn > 0").select("qid", "fp", "fn")


@query("A14_written_and_read", f"WITH {CAND} SELECT k, count(*) AS items FROM cand JOIN (SELECT unnest([20, 50, 100]) AS k) ON rank <= k GROUP BY k")
def a14(spark, d):
    """Top-k tables are written, one folder a k, and counted from what was written."""
    from rankloom.sources.sinks import write_top_k

    return write_top_k(candidates(spark, d)).groupBy("k").agg(F.count("*").alias("items"))


@query("A15_upsert", """SELECT row_id, question, true AS fresh FROM pasa_like_sample WHERE row_id % 3 = 0 UNION ALL SELECT row_id, question, false FROM pasa_like_sample WHERE row_id % 3 <> 0""")
def a15(spark, d):
    from rankloom.sources.sinks import upsert

    p = table(spark, d, "pasa_like_sample").select("row_id", "question")
    old, new = p.withColumn("fresh", F.lit(False)), p.where("row_id % 3 = 0").withColumn("fresh", F.lit(True))
    return upsert(old, new, ["row_id"])


# ---- the service's views

@query("O02_query_list", """SELECT p.qid, min(p.question) AS question, bool_or(g.qid IS NOT NULL) AS is_target FROM predictions p LEFT JOIN (SELECT DISTINCT qid FROM pasa_like_sample) g USING (qid) WHERE p.qid IS NOT NULL GROUP BY p.qid""")
def o02(spark, d):
    g = table(spark, d, "pasa_like_sample").select("qid").distinct().withColumn("t", F.lit(True))
    p = table(spark, d, "predictions").where("qid is not null").groupBy("qid").agg(F.min("question").alias("question"))
    return p.join(g, "qid", "left").select("qid", "question", F.coalesce("t", F.lit(False)).alias("is_target"))


@query("O03_benchmark_search", f"WITH {RANKED} SELECT qid, key, title, rank FROM ranked WHERE rank <= 20")
def o03(spark, d):
    return ranked(spark, d).where("rank <= 20").select("qid", "key", "title", F.col("rank").cast("bigint").alias("rank"))


@query("O06_experiments", f"WITH {CAND} SELECT source, count(*) AS items, count(DISTINCT qid) AS queries, round(avg(score), 9) AS mean_score FROM cand GROUP BY source")
def o06(spark, d):
    return candidates(spark, d).groupBy("source").agg(F.count("*").alias("items"), F.count_distinct("qid").alias("queries"), F.round(F.avg("score"), 9).alias("mean_score"))


@query("O08_score_precedence", f"WITH {RANKED} SELECT qid, key, round(coalesce(score, nsrc / 10.0, 0), 9) AS shown FROM ranked")
def o08(spark, d):
    return ranked(spark, d).select("qid", "key", F.round(F.coalesce("score", F.col("nsrc") / 10.0, F.lit(0.0)), 9).alias("shown"))


@query("Q04_identifier_structure", "SELECT CASE WHEN doi IS NULL THEN 'null' WHEN trim(doi) = '' THEN 'blank' WHEN regexp_matches(doi, '10\\.\\d{4,9}/\\S') THEN 'doi' ELSE 'other' END AS kind, count(*) AS n FROM papers_with_duplicates GROUP BY ALL")
def q04(spark, d):
    c = F.col("doi")
    kind = F.when(c.isNull(), "null").when(F.trim(c) == "", "blank").when(c.rlike(r"10\.\d{4,9}/\S"), "doi").otherwise("other")
    return table(spark, d, "papers_with_duplicates").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("Q10_identifier_predicates", f"WITH {CAND} SELECT qid, count(*) FILTER ({STRONG}) AS strong, count(*) FILTER (abstract IS NOT NULL) AS abstracts FROM cand GROUP BY qid")
def q10(spark, d):
    return candidates(spark, d).groupBy("qid").agg(F.count_if(strong_id()).alias("strong"), F.count("abstract").alias("abstracts"))



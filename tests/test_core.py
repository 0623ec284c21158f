"""Functions and plans of the core against literal cases and SQL."""

import json
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from rankloom import catalog
from rankloom.functions import ident as I
from rankloom.functions import text as X
from rankloom.operators.nested import answer_titles, record_children
from rankloom.plans.evaluation import greedy_match, title_hits
from rankloom.plans.rerank import refilled
from rankloom.sources.sinks import upsert

SF = "/root/testdata/sf0.001"


def one(spark, fn, *values):
    rows = spark.createDataFrame([(v,) for v in values], "v string").select(fn(F.col("v"))).collect()
    return [r[0] for r in rows]


def test_identifiers(spark):
    assert one(spark, I.normalize_doi, "doi: 10.1234/AbC.", "https://doi.org/10.1234/x%2Fy", "none", None) == ["10.1234/abc", "10.1234/x/y", None, None]
    assert one(spark, I.extract_arxiv, "arXiv:1234.56789v2", "https://arxiv.org/pdf/1234.5678v1.pdf", "10.48550/arXiv.1234.56789", "10.1234/5678.12345", None) == [
        "1234.56789", "1234.5678", "1234.56789", None, None]
    assert one(spark, I.extract_openalex, "https://openalex.org/w12", "x", None) == ["W12", None, None]
    assert one(spark, I.normalize_url, "HTTP://A.org//b/?utm_source=x&b=1&a=2#f", "http://dx.doi.org/10.1234/Q") == ["http://a.org/b?a=2&b=1", "https://doi.org/10.1234/q"]


def test_texts(spark):
    assert one(spark, X.ascii_words, "Ab-C  d!", None) == ["ab c d", ""]
    assert one(spark, X.letters_key, "GPT-4 é", None) == ["gpté", ""]
    assert one(spark, X.fold_title, "\\textit{Ab} &amp; ﬁn", None) == ["ab fin", ""]
    assert one(spark, lambda c: X.has_phrase(c, F.lit("scaling law")), "on scaling laws of", "scaling lawn") == [True, False]
    assert one(spark, lambda c: F.array_join(X.tokens(c), " "), "The GPT4 and 3d of x") == ["gpt4 3d"]


ANSWERS = [
    (1, '[1,2] x', []), (2, '["a"],["b"]', []), (3, "[1,]", []), (4, '"abc"', [(0, "abc")]), (5, None, []), (6, "", []), (7, '{"title":"T"}', [(0, "T")]),
    (8, '[["a",[]],{"paper":{"title":"T"}},null,{"title":" "},[[["z"]]],"arXiv:1234.56789v2"]', [(0, "a"), (1, "T"), (4, "z")]),
    (9, json.dumps(json.dumps(["x", "x"])), [(0, "x"), (1, "x")]), (10, "[" * 30 + '"d"' + "]" * 30, [(0, "d")]),
]


def test_answer_titles(spark):
    df = spark.createDataFrame([(i, a, "clash") for i, a, _ in ANSWERS], "row_id long, answer string, val string")
    got = {}
    for r in answer_titles(df).collect():
        got.setdefault(r["parent_id"], []).append((r["item_pos"], r["val"]))
    assert {i: sorted(v) for i, v in got.items()} == {i: e for i, _, e in ANSWERS if e}


def test_record_children(spark):
    schema = "rec_id long, authorships array<struct<author_position:string,author:struct<id:string,display_name:string>>>, externalids struct<doi:string,arxiv:string>, kind string"
    rows = [(1, [("first", ("i", "Ann")), None, ("x", (None, " ")), ("x", ("j", "Bo"))], ("10.1/x", None), "k"), (2, None, None, None), (3, [], (" ", "a"), None)]
    got = sorted(tuple(r) for r in record_children(spark.createDataFrame(rows, schema)).collect())
    assert got == [("author", 1, 0, "Ann"), ("author", 1, 3, "Bo"), ("doi", 1, 0, "10.1/x")]
    assert record_children(spark.createDataFrame([], schema)).count() == 0


def test_greedy_match_takes_lowest_free(spark):
    pairs = spark.createDataFrame([("q", 1, 10, 1), ("q", 2, 10, 1), ("q", 2, 11, 1), ("q", 3, 11, 2), ("q", 3, 12, 2)], "qid string, rank int, rec_id long, phase int")
    got = sorted((r["rank"], r["rec_id"]) for r in greedy_match(pairs, ["qid"]).collect())
    assert got == [(1, 10), (2, 11), (3, 12)]


def test_title_hits_pair_nth_with_nth(spark):
    p = spark.createDataFrame([("q", "a", 1), ("q", "a", 2), ("q", "a", 3), ("q", "", 4)], "qid string, tkey string, rank int")
    g = spark.createDataFrame([("q", "a", 0), ("q", "a", 5)], "qid string, tkey string, gold_index int")
    assert sorted(tuple(r) for r in title_hits(p, g).collect()) == [("q", 1, 0), ("q", 2, 5)]


def test_refill_keeps_minimum(spark):
    df = spark.createDataFrame([("q", "m", 3, i, i == 3) for i in range(5)], "qid string, mode string, least_ int, rank int, ok boolean")
    got = [r["rank"] for r in refilled(df, F.col("ok"), [F.asc("rank")]).orderBy(F.desc("wanted"), "rank").collect()]
    assert got == [3, 0, 1]


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c")], "k int, v string")
    assert sorted(tuple(r) for r in upsert(old, new, ["k"]).collect()) == [(1, "a"), (2, "c")]


CHECKED = ["p4_found", "F01_weighted_hits", "G02_fallback_fusion", "D01_entities", "L01_per_query", "M10_pairwise_wins", "E10_decomposition", "H02_constraint_rerank", "I03_guard_filter"]


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", CHECKED)
def test_plan_equals_sql(spark, name):
    db = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        db.sql(f"create view {f.stem} as select * from '{f}'")
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)

    def same(v):
        return round(v, 6) if isinstance(v, float) else v

    got = sorted(repr(tuple(same(r[c]) for c in cols)) for r in df.collect())
    want = sorted(repr(tuple(map(same, r))) for r in db.sql(f"select {', '.join(cols)} from ({catalog.oracle_sql()[name]})").fetchall())
    assert got == want


def test_every_query_is_registered_once():
    names = catalog.queries()
    assert len(names) > 150 and all(callable(f) for f in names.values())
    assert set(catalog.oracle_sql()) <= set(names)

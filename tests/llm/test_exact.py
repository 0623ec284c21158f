"""Operators with one right answer, on small tables with nulls, ties, repeats and clashing columns."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from rankloom.functions.cells import canonical
from rankloom.llm.components import connected_components, record_groups
from rankloom.llm.containers import best_fit_decreasing, lower_bound, pack
from rankloom.llm.format_dups import distinct_records, format_copies
from rankloom.llm.survivor import pivoted, states_abstract, states_doi, states_venue, survivors
from rankloom.llm.tokens import Encoder, count_tokens, default_vocabulary, encode_corpus, merge_long, merge_short
from rankloom.llm.topn import best_items, top_n

PAGES = "pred_id long, qid string, question string, source string, delivered_at timestamp, papers array<struct<title:string,arxiv_id:string,doi:string,openalex_id:string,abstract:string,raw:struct<day8_final_score:double,b4_source_count:int>>>"
RECORDS = (
    "rec_id long, source string, source_record_id string, paperid string, id string, title string, display_name string, authors array<struct<name:string>>,"
    "authorships array<struct<author_position:string,author:struct<id:string,display_name:string>>>, year int, publication_year int, publication_date string,"
    "externalids struct<doi:string,arxiv:string>, doi string, arxiv_id string, venue string, abstract string, citation_count long, ingested_at timestamp"
)
LINKS = "match_id long, left_ref string, right_ref string, is_match boolean, score double, evidence string, matched_at timestamp"


def page(pred, qid, items, at=1):
    papers = None if items is None else [None if t is None else (t[0], None, None, None, None, t[1]) for t in items]
    return (pred, qid, None, "s", datetime(2024, 1, at), papers)


def record(rec, source="generic", **k):
    names = [x.split()[0] for x in RECORDS.replace("struct<author_position:string,author:struct<id:string,display_name:string>>", "x").replace("struct<doi:string,arxiv:string>", "x").split(",")]
    row = dict.fromkeys(names) | {"rec_id": rec, "source": source} | k
    return tuple(row[n] for n in names)


def test_best_items(spark):
    nan = float("nan")
    rows = [
        page(1, "q", [("b", (0.5, 1)), ("a", (0.5, 1)), ("z", (nan, 1)), ("n", None), None, (None, (0.5, 1))]),
        page(1, "q", [("b", (0.5, 1)), ("a", (0.5, 1)), ("z", (nan, 1)), ("n", None), None, (None, (0.5, 1))], 2),
        page(2, "q", [("a", (0.5, 1)), ("top", (0.9, 1))]), page(3, "r", None), page(4, "r", []), page(5, None, [("x", (0.1, 1))]),
    ]
    got = {(r["qid"], r["place"]): (r["pred_id"], r["item_pos"]) for r in best_items(spark.createDataFrame(rows, PAGES), salts=3).collect()}
    assert got == {("q", 1): (2, 1), ("q", 2): (1, 1), ("q", 3): (2, 0), ("q", 4): (1, 0), ("q", 5): (1, 5), (None, 1): (5, 0)}
    assert best_items(spark.createDataFrame([], PAGES)).count() == 0


def test_top_n_equals_sort_and_refuses_clashes(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice("aaab"), rnd.randrange(9), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, s int, i int")
    got = {(r["g"], r["place"]): r["i"] for r in top_n(df, "g", [F.desc("s"), F.asc("i")], ["i"], 10, 7).collect()}
    for g in "ab":
        want = [i for _, i in sorted((-s, i) for x, s, i in rows if x == g)][:10]
        assert [got[g, k + 1] for k in range(10)] == want
    with pytest.raises(ValueError):
        top_n(df.withColumn("_salt", F.lit(1)), "g", [F.asc("i")], ["i"], 1)


def test_format_copies(spark):
    recs = [
        record(1, title="On  Größe!", authors=[("B. C",), ("A",)], year=2020, doi="10.1/X", venue=" "),
        record(2, title="on GRÖSSE​", authors=[("a",), (" ",), ("b c",)], year=2020, doi="10.1 x", abstract="."),
        record(3, title="on größe 2", authors=[("a",), ("b c",)], year=2020, doi="10.1/x"),
        record(4, "openalex", display_name="T", venue='{"a": "x", "b": "Y"}'), record(5, "openalex", display_name="t", venue='{"b":"y.","a":"X"}'),
        record(6), record(7),
    ]
    pages = [page(1, "q", [("A-b", None), ("ab", None)]), page(1, "q", [("A-b", None), ("ab", None)], 2), page(2, "q", [("a<i>b</i>", None)]), page(3, "r", [("AB", None)])]
    r, p = spark.createDataFrame(recs, RECORDS), spark.createDataFrame(pages, PAGES)
    got = sorted(tuple(x) for x in format_copies(r, p).collect())
    assert got == [("papers", 1, 0, 2, 0), ("papers", 4, 0, 5, 0), ("papers", 6, 0, 7, 0), ("predictions", 1, 0, 1, 1)]
    assert sorted(x["copies"] for x in distinct_records(r, p).where("tab = 'papers'").collect()) == [1, 2, 2, 2]
    assert format_copies(r.limit(0), p.limit(0)).count() == 0


def brute(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    return {x: root(x) for x in up}


@pytest.mark.parametrize("edges", [
    [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 80)], [(5, 3), (3, 5), (3, 3), (None, 1), (1, None), (9, 8), (8, 7), (5, 3)],
    [(random.Random(i).randrange(300), random.Random(i + 999).randrange(300)) for i in range(170)], [(1, 1)]])
def test_components(spark, edges):
    df = spark.createDataFrame([(a, b, "x") for a, b in edges], "a long, b long, label string")
    assert {r["node"]: r["group_id"] for r in connected_components(df).collect()} == brute(edges)


def test_record_groups(spark):
    recs = [record(1, paperid="ab" * 20), record(2, "openalex", id="https://openalex.example/W7"), record(3, "arxiv", source_record_id="arXiv:1234.56789v2"), record(4, source_record_id="gen-4")]
    links = [(1, "https://s.example/paper/" + "AB" * 20, "w7", True, 1.0, "e", None), (2, "W7", "https://arxiv.example/abs/1234.56789v9", True, None, None, None),
             (3, "gen-4", "w7", False, 1.0, "e", None), (4, "gen-4", "w7", None, 1.0, "e", None), (5, "gone-1", "gen-4", True, 1.0, "e", None), (6, None, "w7", True, 1.0, "e", None)]
    got = {r["rec_id"]: r["group_id"] for r in record_groups(spark.createDataFrame(links, LINKS), spark.createDataFrame(recs, RECORDS)).collect()}
    assert got == {1: 1, 2: 1, 3: 1}


def test_shared_identifiers_hang_on_a_hub(spark):
    """A thousand records of one identifier linked with a thousand of another: an edge a record."""
    from rankloom.llm.components import record_links

    recs = spark.createDataFrame([record(i, paperid="p1" if i % 2 else "p2") for i in range(2000)] + [record(9000, paperid="p3"), record(9001, paperid="p3")], RECORDS)
    links = spark.createDataFrame([(1, "p1", "p2", True, 1.0, "e", None), (2, "p3", "gone", True, 1.0, "e", None)], LINKS)
    assert record_links(links, recs).count() <= 2001
    assert {tuple(r) for r in record_groups(links, recs).select("rec_id", "group_id").collect()} == {(i, 0) for i in range(2000)}


def test_stand_ins(spark):
    def ask(fn, *values):
        return [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(fn(F.col("v"))).collect()]

    assert ask(states_doi, "doi:10.1234/x", "https://doi.example/10.1234%2Fx", "10.1234/", "pending", None, "10.00000/", "10.") == [True, True, False, False, False, False, False]
    form = lambda fn: lambda c: fn(canonical(c))
    assert ask(form(states_abstract), "." * 600 + " We study.", "There is no abstract" + "." * 600) == [True, False]
    assert ask(form(states_abstract), "We study.", "No abstract available.", "[Abstract removed]", "—", None, "Sin resumen", "Abstract: we test") == [True, False, False, False, False, False, True]
    assert ask(form(states_venue), "J. Data", "misc.", "(venue missing)", "?", None, "Unknown") == [True, False, False, False, False, False]


def test_survivors(spark):
    at = datetime(2024, 1, 1)
    recs = [
        record(1, "generic", abstract="Long words here", venue="V one", ingested_at=at), record(2, "arxiv", abstract="Short", doi="10.1234/a", ingested_at=at),
        record(3, "arxiv", abstract="Short", venue="none", ingested_at=datetime(2024, 2, 1)), record(4, "other", venue="V two", ingested_at=None), record(9, "arxiv", abstract="Alone"),
    ]
    trust = spark.createDataFrame([("arxiv", "abstract", 4), ("generic", "abstract", 1), ("generic", "venue", 4), ("arxiv", "doi", 1)], "source string, field_name string, trust int")
    groups = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 1)], "rec_id long, group_id long")
    r = spark.createDataFrame(recs, RECORDS)
    for policy in ("priority", "votes"):
        won = survivors(r, groups, trust, policy)
        assert {(x["field_name"], x["rec_id"]) for x in won.collect()} == {("abstract", 3), ("venue", 1), ("doi", 2)}
    assert tuple(pivoted(r, groups, trust).collect()[0]) == (1, 2, 3, 1)
    # Two records of less trust outvote one of more, but not under the fixed order.
    recs = [record(1, "a", venue="One", ingested_at=at), record(2, "b", venue="Two", ingested_at=at), record(3, "b", venue="TWO!", ingested_at=at)]
    trust = spark.createDataFrame([("a", "venue", 4), ("b", "venue", 3)], "source string, field_name string, trust int")
    groups = spark.createDataFrame([(i, 1) for i in (1, 2, 3)], "rec_id long, group_id long")
    pick = lambda policy: survivors(spark.createDataFrame(recs, RECORDS), groups, trust, policy).collect()[0]["rec_id"]
    assert (pick("priority"), pick("votes")) == (1, 2)
    assert survivors(r.limit(0), groups, trust).count() == 0


TEXTS = [None, "", " ", "Hello  world!\n\n", "<|endoftext|> it's 2024", "日本語 и русский", "a" * 5000, "x" * 199 + "é" * 60, "​\U0001f469‍\U0001f52c", "ab " * 3000]


def test_ids_equal_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(default_vocabulary().replace(".tiktoken", ".json"))
    lib.encode_special_tokens = True
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("ids", F.lit(1))
    got = {r["doc_id"]: r["ids"] for r in encode_corpus(df).collect()}
    assert got == {i: lib.encode(t, add_special_tokens=False).ids if t else [] for i, t in enumerate(TEXTS)}
    assert {r[0]: r[1] for r in count_tokens(df).collect()} == {i: len(v) for i, v in got.items()}
    assert encode_corpus(df.limit(0)).count() == 0


def test_both_merges_agree():
    enc = Encoder(default_vocabulary())
    rnd = random.Random(3)
    for _ in range(300):
        word = bytes(rnd.choice(b"aeinrst lo\xc3\xa9") for _ in range(rnd.randrange(1, 60)))
        assert merge_short(word, enc.ranks.get) == merge_long(word, enc.ranks.get)


def test_packing(spark):
    import numpy as np

    rnd = random.Random(2)
    sizes = np.array([rnd.randrange(0, 40) for _ in range(400)])
    bins, fills = best_fit_decreasing(sizes, 50)
    assert max(fills) <= 50 and lower_bound(sizes, 50) <= len(fills) and sum(fills) == sizes.sum()
    assert [int(sizes[bins == b].sum()) for b in range(len(fills))] == fills.tolist()
    assert lower_bound(np.array([26] * 7), 50) == 7
    rows = [(i, None if n is None else int(n)) for i, n in enumerate([0, None, 51, 100, 120, 50, *sizes])]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long")
    for part in (1000, 60):
        got = pack(df, 50, part).collect()
        assert sum(r["size"] for r in got) == sum(n or 0 for _, n in rows) and {r["doc_id"] for r in got} == {i for i, _ in rows}
        fill = {}
        for r in got:
            fill[r["container_id"]] = fill.get(r["container_id"], 0) + r["size"]
        assert max(fill.values()) <= 50 and all(fill[r["container_id"]] == r["fill"] for r in got)
        assert all(len([r for r in got if r["doc_id"] == i]) == max(1, -(-(n or 0) // 50)) for i, n in rows)
    assert pack(df.limit(0), 50).count() == 0

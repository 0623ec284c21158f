"""Near titles against a comparison of every pair."""

import random
from difflib import SequenceMatcher

from rankloom import catalog
from rankloom.functions.alike import alike, alike_titles, common_letters

RECORDS = (
    "rec_id long, source string, source_record_id string, paperid string, id string, title string, display_name string, authors array<struct<name:string>>,"
    "authorships array<struct<author:struct<display_name:string>>>, year int, publication_year int, externalids struct<doi:string,arxiv:string>, doi string, arxiv_id string"
)


def titles(n=90):
    rnd = random.Random(3)
    words = ["dense", "retrieval", "of", "robust", "museum", "catalogues", "x", "graphs", "2"]
    out = {"ab", "a", "abcdefghij", "jihgfedcba"}
    for _ in range(n):
        t = " ".join(rnd.choices(words, k=rnd.randrange(1, 9)))
        out |= {t, *(t[:i] + rnd.choice(["", "q", "ä"]) + t[i + rnd.randrange(2) :] for i in rnd.choices(range(len(t)), k=3))}
    return sorted(out)


def brute(ts, least):
    out = set()
    for i, a in enumerate(ts):
        for b in ts[i + 1 :]:
            ab, ba = (round(SequenceMatcher(None, *p).ratio(), 9) for p in ((a, b), (b, a)))
            if max(ab, ba) >= least:
                out.add(frozenset({(a, ab), (b, ba)}))
    return out


def test_alike_loses_no_pair(spark):
    ts = titles()
    for least in (0.93, 0.88):
        want = brute(ts, least)
        assert {frozenset({(a, ab), (b, ba)}) for a, b, ab, ba in alike(ts, None, least)} == want and len(want) > 50
        assert {frozenset(p[:2]) for p in alike(ts[::2], ts[1::2], least)} == {frozenset((ts[i], ts[j])) for i in range(0, len(ts), 2) for j in range(1, len(ts), 2)} & {frozenset(x for x, _ in p) for p in want}
    got = alike_titles(spark.createDataFrame([(t,) for t in ts], "t string"), 0.93, size=40).collect()
    assert {frozenset({(r["ta"], r["ab"]), (r["tb"], r["ba"])}) for r in got} == brute(ts, 0.93) and len(got) == len(brute(ts, 0.93))
    assert common_letters("abcab", "acb") == 3 and common_letters("", "a") == 0


def test_review_pairs_need_no_author_or_year(spark, tmp_path):
    rows = [(1, "Dense retrieval of museum catalogues", [("Dr. Ann Lee",)], 2020), (2, "Dense retrieval of museum catalogue", [("Ann Lee",)], 2019),
            (3, "dense retrieval of museum catalogues!", None, None), (4, "Graphs", None, None), (5, None, None, None)]
    df = spark.createDataFrame([(i, "generic", None, None, None, t, None, a, None, y, None, None, None, None) for i, t, a, y in rows], RECORDS)
    df.write.parquet(str(tmp_path / "papers_with_duplicates.parquet"))
    assert sorted((r["a"], r["b"]) for r in catalog.queries()["D05_review_pairs"](spark, str(tmp_path)).collect()) == [(1, 2), (2, 3)]

"""Plans on small fixtures, where a subset, a prefix or a grid would give less."""

from difflib import SequenceMatcher

from rankloom import catalog

DOCS = "doc_id long, text string, doc_kind string"
ASKED = "row_id long, qid string, question string, answer string"
PREDS = (
    "pred_id long, qid string, source string, question string,"
    "papers array<struct<title:string,doi:string,arxiv_id:string,openalex_id:string,abstract:string,raw:struct<day8_final_score:double,b4_source_count:long>>>"
)


def run(spark, d, name):
    return catalog.queries()[name](spark, str(d)).collect()


def write(spark, d, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(d / f"{name}.parquet"))


def paper(title, score=None, abstract=None):
    return (title, None, None, None, abstract, (score, 1))


def test_search_and_index_take_every_kind(spark, tmp_path):
    docs = [(1, "sparse retrieval", "question"), (2, "graph  pruning study\nof graph", "fulltext"), (3, None, "note"), (4, "graph tables", "abstract")]
    write(spark, tmp_path, documents=(docs, DOCS), pasa_like_sample=([(7, "q", "graph pruning", None)], ASKED))
    assert [(r["doc_id"], r["place"]) for r in run(spark, tmp_path, "F07_local_search_all")] == [(2, 1), (4, 2)]
    assert {r["doc_id"]: r["text"] for r in run(spark, tmp_path, "B31_inverted_index_all")} == {i: t for i, t, _ in docs if t}


def test_search_scores_in_parts(spark, tmp_path, monkeypatch):
    from math import log

    from rankloom.plans import ranking

    monkeypatch.setattr(ranking, "ASKED_PART", 2, raising=False)
    monkeypatch.setattr(ranking, "DOCUMENT_PART", 5, raising=False)
    words = "that with graph sparse tables prune the of".split()
    docs = [(i, " ".join(["every", *(w for b, w in enumerate(words) if i * 7 >> b & 1)]), "note") for i in range(40)]
    asked = [(i, "q", " ".join(w for b, w in enumerate(["every", *words]) if i * 5 >> b & 1), None) for i in range(30)] + [(30, "q", "every", None), (31, "q", "the of", None)]
    # A row that is delivered twice counts once.
    write(spark, tmp_path, documents=(docs + docs[:9] + [(90, None, "note")], DOCS), pasa_like_sample=(asked + asked[5:7], ASKED))
    has = {i: {t for t in text.split() if len(t) > 3} for i, text, _ in docs}
    df = {t: sum(t in ts for ts in has.values()) for ts in has.values() for t in ts}
    want = set()
    for i, _, question, _ in asked:
        met = {d: sorted(ts & set(question.split())) for d, ts in has.items()}
        scores = sorted((-round(sum(log(40 / df[t]) for t in ts), 9), d) for d, ts in met.items() if ts)
        want |= {(i, d, abs(s), n) for n, (s, d) in enumerate(scores[:10], 1)}
    got = [tuple(r) for r in run(spark, tmp_path, "F07_local_search_all")]
    assert len(got) == len(want) and set(got) == want and any(s == 0 for _, _, s, _ in want)


def test_ratio_of_whole_texts(spark, tmp_path):
    t, a = "dense retrieval", "x" * 190 + " a study of dense retrieval"
    write(spark, tmp_path, predictions=([(1, "q", "arxiv", "w", [paper(t, abstract=a)])], PREDS))
    assert [r["ratio"] for r in run(spark, tmp_path, "B27_sequence_ratio")] == [round(SequenceMatcher(None, t, a).ratio(), 9)]


def lists(ranks_of_hits, n, qid="q"):
    """A list of n items of which those at the ranks are gold."""
    word = lambda i: "".join("abcdefghij"[int(c)] for c in f"{i:04d}") + qid.translate(str.maketrans("0123456789", "klmnopqrst"))
    pred = (sum(map(ord, qid)), qid, "arxiv", "w", [paper(word(i), score=1 - i / 1000) for i in range(1, n + 1)])
    return pred, (pred[0], qid, "w", "[" + ",".join(f'"{word(i)}"' for i in ranks_of_hits) + "]")


def test_oracle_takes_every_k(spark, tmp_path):
    cases = {"qa": ([1, 2, 3, 4, 5, 6, 7], 12), "qb": ([*range(1, 24)], 40), "qc": ([9], 9), "qd": ([150], 160), "qe": ([3, 7, 8], 30)}
    both = [lists(*c, qid=q) for q, c in cases.items()]
    write(spark, tmp_path, predictions=([p for p, _ in both], PREDS), pasa_like_sample=([g for _, g in both] + [(1, "qn", "w", '["zz"]')], ASKED))
    want = {"qn": (0, 0.0)}
    for q, (hit, n) in cases.items():
        f = {k: round(2 * sum(h <= k for h in hit) / (k + len(hit)), 9) for k in range(1, min(n, 100) + 1)}
        best = max(f.values())
        want[q] = (min(k for k in f if f[k] == best), best)
    assert {r["qid"]: (r["best_k"], r["best_f1"]) for r in run(spark, tmp_path, "L09_oracle_k")} == want
    assert want["qa"] == (7, 1.0) and want["qb"] == (23, 1.0)


def test_neighbours_among_all_labelled(spark):
    from rankloom.plans.diagnosis import CUTOFF, nearest

    width = len(CUTOFF)
    points = {f"q{i:05d}": ([float(i % 97), float(i)] + [0.0] * (width - 2), i % 30 + 1) for i in range(2300)}
    train = spark.createDataFrame([(0, q, z, k) for q, (z, k) in points.items()], "fold long, qid string, z array<double>, k int")
    got = {r["qid"]: [tuple(x) for x in r["near"]] for r in nearest(train.select("fold", "qid", "z"), train, block=700).collect()}
    for q in ("q00000", "q01999", "q02299"):
        dist = lambda z: round((sum((a - b) ** 2 for a, b in zip(z, points[q][0])) / width) ** 0.5, 9)
        assert got[q] == sorted((dist(z), k) for o, (z, k) in points.items() if o != q)[:7]
    assert len(got) == 2300


def test_neighbour_cutoff_sees_labels_beyond_a_prefix(spark, tmp_path):
    """2,000 labelled questions with best K 1 come first by qid; those like the asked one, with best K 3, come last."""
    far, near = [lists([1], 2, qid=f"a{i:04d}") for i in range(2000)], [lists([1, 2, 3], 9, qid=f"z{i}") for i in range(9)]
    preds = [(i, *p[1:]) for i, (p, _) in enumerate(far + near)]
    write(spark, tmp_path, predictions=(preds, PREDS), pasa_like_sample=([(i, *g[1:]) for i, (_, g) in enumerate(far + near)], ASKED))
    got = {r["qid"]: (r["weighted_k"], r["k"]) for r in run(spark, tmp_path, "I11_neighbour_cutoff")}
    assert len(got) == 2009 and {got[f"z{i}"] for i in range(9)} == {(3.0, 3)} and got["a0000"] == (1.0, 1)


def test_near_matches_by_letters_alone(spark, tmp_path):
    """Two changed words of five leave a jaccard below a half; so does a missing space."""
    given = ["Bilushtune: Robuste Verfahren zur Zitationsanalyoe", "deepretrieval", "other thing", "graph pruning of tables"]
    gold = ["momishtune robuste verfahrem zur zitationsanalyse", "deep retrievel", "日本", "tables pruning of graph"]
    answer = "[" + ",".join(f'"{g}"' for g in gold) + "]"
    write(spark, tmp_path, predictions=([(1, "q", "arxiv", "w", [paper(t, 1 - i / 10) for i, t in enumerate([*given, "中文"])])], PREDS), pasa_like_sample=([(1, "q", "w", answer)], ASKED))
    norm = ["bilushtune robuste verfahren zur zitationsanalyoe", *given[1:]]
    want = {(i + 1, i): round(SequenceMatcher(None, norm[i], gold[i]).ratio(), 9) for i in (0, 1)}
    got = {(r["rank"], r["gold_index"]): (r["ratio"], r["jaccard"]) for r in run(spark, tmp_path, "D11_near_matches")}
    assert {k: r for k, (r, j) in got.items() if j < 0.5} == {k: v for k, v in want.items() if v >= 0.88} and want[2, 1] >= 0.88
    assert got[4, 3][1] == 1.0 and set(got) <= {(1, 0), (2, 1), (4, 3)}
    assert {(r["rank"], r["gold_index"]) for r in run(spark, tmp_path, "D12_near_matches_by_author")} == {(4, 3)}

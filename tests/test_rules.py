"""Question understanding, guard, service and checks on literal cases."""

import pytest
from pyspark.sql import functions as F

from rankloom.plans import guard as G
from rankloom.plans import planner as P
from rankloom.plans import service as S
from rankloom.plans import understand as U


def asked(spark, *questions):
    return spark.createDataFrame(list(enumerate(questions)), "row_id long, question string")


def test_constraints(spark):
    q = asked(spark, "Give me papers which show that using smaller dataset can result in better models than bigger datasets", "Find papers about RLHF for large language models", "graph", "")
    got = {}
    for r in U.constraints_of(q).orderBy("row_id", "idx").collect():
        got.setdefault(r["row_id"], []).append((r["text"], r["kind"], r["weight"]))
    assert [c[0] for c in got[0]][:3] == ["smaller dataset", "bigger dataset", "better models"] and all(c[2] == 1.30 for c in got[0][:3])
    texts = [c[0] for c in got[1]]
    assert "RLHF" in texts and "large language model" in texts and "language model" not in texts
    assert 2 not in got and 3 not in got and all(len(v) <= U.MOST_CONSTRAINTS for v in got.values())


def test_phrases(spark):
    df = spark.createDataFrame([(x,) for x in ("supporting the claim that models scale", "looking for research papers that prune", "dense retrieval note", "  (x) ")], "v string")
    assert [r[0] for r in df.select(U.cleaned_phrase(F.col("v"))).collect()] == ["models scale", "prune", "dense retrieval", "x"]
    keys = spark.createDataFrame([(k,) for k in ("do not", "relationships between multiple", "data", "data model", "dense retrieval of", "dense retrieval", "rag")], "k string")
    assert [r[0] for r in keys.select(U.is_complete(F.col("k"), F.lit("topic"))).collect()] == [False, False, False, False, False, True, True]


def test_redundant_phrase_is_suppressed(spark):
    df = spark.createDataFrame([([("a b", "topic"), ("c d", "topic"), ("a b c d", "topic"), ("A B", "topic"), ("e f", "topic")],)], "cells array<struct<text:string,kind:string>>")
    cells = df.select(U.suppressed(F.col("cells")).alias("cells"))
    assert [x["text"] for x in cells.select(U.not_redundant(F.col("cells")).alias("c")).first()["c"]] == ["a b", "c d", "e f"]


def test_anchors_have_places():
    q = "Papers on LoRA for text-to-SQL harder than MBPP but easier than CodeContests after 2020, excluding surveys, like XyzNet"
    found = P.spans_of(q)
    kinds = {(x[2], x[3]) for x in found}
    assert {("method", "LoRA"), ("task", "text-to-SQL"), ("benchmark", "MBPP"), ("benchmark", "CodeContests"), ("temporal_constraint", "after 2020"), ("negative_constraint", "excluding surveys"), ("named_entity", "XyzNet")} <= kinds
    assert all(q[a:b].strip(P._STRIP) == t for a, b, _, t, *_ in found) and found == sorted(found, key=lambda x: (x[0], -x[1], x[2]))
    assert next(x for x in found if x[2] == "temporal_constraint")[6] == [2020] and any(x[2] == "comparison" for x in found)
    assert P.spans_of("") == [] and P.spans_of('the paper titled "Deep Walks on Graphs" by X')[0][2] == "paper_title"


def test_plans(spark):
    got = P.plans(asked(spark, "in-context learning that emerges in pre-training", "code generation with RLHF", "so what")).orderBy("row_id", "n").collect()
    by = {(r["row_id"], r["n"]): (r["plan_type"], r["priority"]) for r in got}
    assert by[0, 1] == ("method_alias", 98) and by[0, 2] == ("method_alias", 97) and by[1, 1] == ("task_method", 86)
    assert by[2, 1] == ("keyword_fallback", 40) and all(n <= 2 for _, n in by)


def test_canonical_constraints_merge(spark):
    rows = [(1, 0, "c1", "model_or_entity", 1.1, "LLMs"), (1, 1, "c2", "topic", 1.0, "large language model"), (1, 2, "c3", "topic", 1.3, "dense passage retrieval for open question sets"), (1, 3, "c4", "topic", 1.0, "dense passage retrieval open question sets"), (1, 4, "c5", "topic", 1.0, "other")]
    df = spark.createDataFrame(rows, "row_id long, idx int, id string, kind string, weight double, text string")
    got = [(r["text"], r["weight"], r["ids"]) for r in P.merged(df, "row_id").orderBy("n").collect()]
    assert got[0] == ("large language model", 1.1, ["c1", "c2"]) and got[1][2] == ["c3", "c4"] and got[1][1] == 1.3 and got[2][0] == "other"


def test_guard_rules(spark):
    rules = {r.id: i for i, r in enumerate(G.RULES)}
    df = spark.createDataFrame([("RLHF on HotPot QA, exclude surveys",), ("llm agents for audio and video",), ("plain",)], "q string").select(G.asked_rules(F.col("q")).alias("r"))
    first, second, third = (set(r["r"]) for r in df.collect())
    assert {rules["exclude_survey_or_review"], rules["dataset_hotpotqa"], rules["method_RLHF"]} == first
    assert {rules["method_llm_agent"], rules["modality_visual_audio"]} <= second and not third


def test_requests_and_checks(spark):
    assert S.checked_request("  deep   walks ", 50, "live")[0] == "deep walks"
    for bad in (("ab",), ("x" * 2001,), ("fine one", 30), ("fine one", 20, "other")):
        with pytest.raises(S.RequestError) as e:
            S.checked_request(*bad)
        assert e.value.status == 422
    gold = spark.createDataFrame([("a", ["x"], ["1", "2"]), ("b", ["x"], None)], "qid string, answer array<string>, answer_arxiv_id array<string>")
    with pytest.raises(ValueError, match="'a'"):
        S.require_gold(gold)
    with pytest.raises(ValueError, match="2 times"):
        S.require_gold(gold.union(gold))
    rows = spark.createDataFrame([("q", None, ["x", "y"])], "qid string, papers array<string>, results array<string>")
    assert [(r["rank"], r["paper"]) for r in S.prediction_lists(rows).collect()] == [(1, "x"), (2, "y")]
    plans = spark.createDataFrame([(" t ", 200, 1.7)], "text string, priority int, confidence double")
    assert tuple(S.planned(plans).select("text", "priority", "confidence", "plan_type").first()) == ("t", 100, 1.0, "anchor_query")
    with pytest.raises(Exception, match="no text"):
        S.planned(plans.withColumn("text", F.lit(" "))).collect()
    with pytest.raises(ValueError):
        P.require_plans(spark.createDataFrame([("q", ["a", "b", "c"])], "qid string, planned_queries array<string>"))
    assert S.stage_list("b4_pool=x.parquet", "new=y")[6][2] == "x.parquet" and S.stage_list("new=y")[-1] == (14, "new", "y")


def test_live_search_and_artifacts(spark, tmp_path):
    rows = [(i, t, None) for i, t in enumerate(["Contrastive pretraining for machine reading", "contrastive  Pretraining for machine reading", "Graph walks", None])]
    spark.createDataFrame(rows, "rec_id long, title string, display_name string").write.parquet(f"{tmp_path}/papers_with_duplicates.parquet")
    got = S.Engine(spark, str(tmp_path)).search("Find papers that use contrastive pretraining for machine reading", 20).collect()
    assert [r["rec_id"] for r in got] == [0]
    store = S.Artifacts(spark, str(tmp_path))
    assert store.health("papers_with_duplicates", "gone") == {"papers_with_duplicates": "ok", "gone": "missing"}
    assert store.table("papers_with_duplicates") is store.table("papers_with_duplicates")
    assert S.verified(spark.createDataFrame([("a", "1"), ("b", "2")], "path string, digest string"), spark.createDataFrame([("a", "1"), ("c", "3")], "path string, digest string")).orderBy("path").collect() == [("a", "same"), ("b", "new"), ("c", "missing")]


def test_folds_are_numbered_in_order(spark):
    from rankloom.plans.evaluation import folds_by_order

    names = [f"q{i:03d}" for i in range(57)]
    got = {r["qid"]: r["fold"] for r in folds_by_order(spark.createDataFrame([(n,) for n in reversed(names)], "qid string")).collect()}
    assert got == {n: i % 5 for i, n in enumerate(names)}


def test_deeply_nested_answer(spark):
    from rankloom.operators.nested import answer_titles

    df = spark.createDataFrame([(1, "[" * 105 + '"deep [[["' + "]" * 105)], "row_id long, answer string")
    assert [(r["item_pos"], r["val"]) for r in answer_titles(df).collect()] == [(0, "deep [[[")]

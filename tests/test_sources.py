"""The local search source and the streaming summary."""

import json

import pytest

from rankloom.sources.local_search import LocalSearch, request_key, sanitized, wait_before
from rankloom.streaming.run_log import windowed_log


def test_local_search(spark, tmp_path):
    spark.dataSource.register(LocalSearch)
    page = {"results": [{"id": "W1", "title": "A"}, {"id": "W2", "display_name": "B"}, {"id": "W3"}]}
    (tmp_path / f"{request_key('x', 2)}.json").write_text(json.dumps(page), encoding="utf-8-sig")
    (tmp_path / f"{request_key('bad', 2)}.json").write_text("{")
    (tmp_path / f"{request_key('busy', 2)}.json").write_text(json.dumps({"status": 503, "results": []}))
    (tmp_path / f"{request_key('a:b', 2)}.json").write_text(json.dumps({"status": 400}))
    dated = [{"id": "W4", "title": "C", "publication_date": "2019-05-01"}, {"id": "W5", "title": "D", "publication_date": "2021-05-01"}]
    (tmp_path / f"{request_key('a b', 2)}.json").write_text(json.dumps({"results": dated}))

    def load(*queries, **more):
        return spark.read.format("local_search").options(path=str(tmp_path), queries=json.dumps(queries), size=str(more.pop("size", 2)), base="0.01", **more).load()

    assert [tuple(r) for r in load("x").orderBy("rank").collect()] == [("x", 1, "W1", "A"), ("x", 2, "W2", "B")]
    # A refused query is asked once more with its letters only; dates out of range are left out.
    assert [tuple(r) for r in load("a:b", since="2020").collect()] == [("a:b", 1, "W5", "D")]
    for query, why in (("none", "no cached page"), ("bad", "broken page"), ("busy", "status 503")):
        with pytest.raises(Exception, match=why):
            load(query).collect()
    with pytest.raises(Exception, match="1 to 100"):
        load("x", size=101).collect()
    assert 2.0 <= wait_before(2, None) <= 2.25 and wait_before(2, "7") == 7.0 and sanitized("a:(b)") == "a b"


def test_windowed_log_batch_equals_stream(spark, tmp_path):
    rows = [("2024-01-01 00:05:00", "error", 3.0), ("2024-01-01 00:59:00", "view", 9.0), ("2024-01-01 01:00:00", "view", 1.0), ("2024-01-02 09:00:00", "view", 1.0)]
    df = spark.createDataFrame(rows, "ts string, event_type string, value double")
    df.write.parquet(str(tmp_path / "in"))
    batch = {tuple(r) for r in windowed_log(df).collect()}
    stream = windowed_log(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("log").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {tuple(r) for r in spark.table("log").collect()} == batch and len(batch) == 3

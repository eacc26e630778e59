import json

import toy

from lexigraph.streaming import service
from lexigraph.streaming.session import SessionStream


def test_session_stream(spark, tmp_path):
    stream = SessionStream(spark, toy.analyzer(spark), f"file://{tmp_path}/out")
    schema = "session string, seq bigint, text string"
    first = spark.createDataFrame([("a", 1, "house ran"), ("b", 1, "ran")], schema)
    second = spark.createDataFrame([("a", 2, "xyz"), ("b", 2, ""), ("c", 1, "ran")], schema)
    stream.process(first, 0)
    stream.process(second, 1)
    stream.process(second, 1)  # a repeated batch gives the same
    rows = spark.read.parquet(f"{tmp_path}/out/rows").collect()
    assert sorted((r["session"], r["seq"], r["start_node"], r["end_node"]) for r in rows) == [("a", 1, 0, 1), ("a", 1, 1, 2), ("a", 2, 2, 3), ("b", 1, 0, 1), ("c", 1, 0, 1)]


def test_service(spark):
    lines = ['{"text": "house"}', "just text", '{"mode": "generate", "lemma": "house"}', '{"mode": "generate", "lemma": "a b"}', '{"mode": "dance"}', " "]
    df = spark.createDataFrame(list(enumerate(lines)), "id bigint, value string")
    got = {r["id"]: json.loads(r["response"]) for r in service.serve(df, toy.analyzer(spark), toy.generator(spark)).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4]
    assert got[0]["ok"] and got[0]["results"][0]["lemma"] == "house" and got[0]["error"] is None
    assert [r["orth"] for r in got[1]["results"]] == ["just", "text"]
    assert {r["orth"] for r in got[2]["results"]} == {"house", "houses"}
    assert not got[3]["ok"] and "whitespace" in got[3]["error"]
    assert not got[4]["ok"]

import duckdb
import pytest

import __spark_entry__ as entry
from lexigraph.operators import analyze as an


def test_names_agree():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert queries and set(oracles) <= set(queries)
    assert "analyze_documents" in queries


@pytest.mark.parametrize("name", ["tag_counts", "unknown_words"])
def test_counts_number_no_tokens(spark, monkeypatch, tmp_path, name):
    """Counts of words come from the distinct words, with the rows of the SQL where ids repeat or are null."""
    monkeypatch.setattr(an, "_numbered_texts", None)
    texts = [(1, "Alpha beta9,gamma. gamma x9", "en"), (1, "beta9 alpha", "de"), (2, "x9 x9", None), (None, "delta, delta", "en"), (3, None, "en"), (4, " ", "fr"), (5, "gamma, 7 x9,x9", "en")]
    spark.createDataFrame(texts, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = db.execute(entry.oracle_sql()[name]).fetchall()
    got = [tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).collect()]
    assert len(got) > 2 and sorted(got, key=str) == sorted(want, key=str)

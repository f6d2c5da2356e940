"""Searches rank narrow rows: no table of ranked rows or pairs holds a chunk's texts, and all modes share one scan."""

from lexloom.operators import retrieval
from lexloom.sources.chunks import chunk_table
from test_retrieval import DEFINITION, DUTY, LAWS, PART, UNIT

WIDE = {"text", "text_lower", "text_words", "embedding", "names", "opening"}


def test_only_winners_have_their_chunks_columns(spark, monkeypatch):
    seen = []

    def recorded(df, name, known=retrieval.written):
        seen.append((name, WIDE & set(df.columns)))
        return known(df, name)

    monkeypatch.setattr(retrieval, "written", recorded)
    queries = spark.createDataFrame([(i, q, [0.0, 0.0, 1.0]) for i, q in enumerate((UNIT, PART, DEFINITION, DUTY))], "query_id long, query string, query_vector array<double>")
    for rows in retrieval.search_modes(chunk_table(spark, LAWS), queries, 2, ("hybrid", "hybrid_rerank")).values():
        assert rows.where("rank = 1").count() == 4
    assert {name for name, wide in seen if wide} <= {"chunks", "candidates", "pool"}
    assert [name for name, _ in seen].count("pairs") == [name for name, _ in seen].count("chunks") == 1

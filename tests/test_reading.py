"""Texts are read once, for phrases and words of questions, on batches; vectors meet questions once, not once a chunk."""

import pytest
from pyspark.sql import functions as F

from lexloom.operators import retrieval
from lexloom.plans import features
from lexloom.plans.query_context import contexts
from lexloom.sources.chunks import chunk_table
from test_retrieval import LAWS

TEXTS = [None, "", "notice of termination; a partial wage-list", "Wages\x0bof the SECTION 12a, Überpart duties", "ii new section"]


def test_phrases_words_and_counts_of_texts(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")
    forms = ["wage", "wages", "duties", "part", "list", "berpart"]
    read = features.reading([*features._SOUGHT, "ii"], forms)
    out = rows.select("i", "text", read(F.lower("text")).alias("r"), F.greatest(F.lit(1), F.regexp_count("text", F.lit(r"\S+"))).alias("n")).orderBy("i").collect()
    assert out[0]["r"]["phrases"] is None and out[0]["r"]["n_words"] is None
    for r in out[1:]:
        assert set(r["r"]["phrases"]) == {p for p in [*features._SOUGHT, "ii"] if p in r["text"].lower()}
        assert max(1, r["r"]["n_words"]) == r["n"]
    assert [sorted(r["r"]["words"]) for r in out[1:]] == [[], ["list", "wage"], ["berpart", "duties", "wages"], []]


@pytest.mark.parametrize("most", [0, 2_000])
def test_the_words_of_questions_are_kept(spark, monkeypatch, most):
    monkeypatch.setattr(retrieval, "ASKED_WORDS", most)
    ctx = contexts(spark.createDataFrame([(0, "what does Part II say of consent and wages?")], "query_id long, query string"))
    out = retrieval.narrowed(chunk_table(spark, LAWS), ctx)
    asked = ctx.first()["tokens"]
    plain = features.prepare(chunk_table(spark, LAWS).crossJoin(features.sought_phrases(ctx)), F.col("sought"))
    kept = lambda rows: {r["chunk_id"]: (set(r["text_words"]) & set(asked), set(r["text_has"])) for r in rows.collect()}
    assert kept(out) == kept(plain) and "text" not in out.columns


def test_a_vector_meets_each_question_once(spark):
    queries = spark.createDataFrame([(7, "consent", [1.0, 0.0]), (8, "wages", [0.0, 2.0])], "query_id long, query string, query_vector array<double>")
    vectors = spark.createDataFrame([(0, [3.0, 0.0]), (1, [0.0, 0.0])], "vec_id long, embedding array<double>")
    chunks = spark.createDataFrame([(i, i % 3) for i in range(6)], "chunk int, vec_id long")
    out = retrieval.with_semantics(chunks, queries, vectors).orderBy("chunk").collect()
    assert [r["semantics"] for r in out] == [{7: 1.0, 8: 0.0}, {7: 0.0, 8: 0.0}, None] * 2
    assert retrieval._few_ids(queries) and not retrieval._few_ids(queries.union(queries))

"""Vectors in a table of their own meet prepared chunks, not their texts; texts are read for phrases once."""

import pytest
from pyspark.sql import functions as F

from lexloom.operators import graph, retrieval
from lexloom.plans import features
from lexloom.plans.query_context import contexts
from lexloom.sources.chunks import chunk_table
from test_retrieval import CONSENT, DEFINITION, DUTY, LAWS

QUERIES = [(0, "consent lawful basis", [0.95, 0.05, 0.0]), (1, DEFINITION, [0.0, 0.0, 1.0]), (2, DUTY, [0.5, 0.5, 0.0])]
COLUMNS = "query_id long, query string, query_vector array<double>"


def test_pairs_shuffle_no_texts(spark):
    queries = spark.createDataFrame(QUERIES, COLUMNS)
    ctx = contexts(queries).join(queries.select("query_id", "query_vector"), "query_id")
    vectors = spark.createDataFrame([(0, [1.0, 0.0, 0.0])], "vec_id long, embedding array<double>")
    chunks = chunk_table(spark, LAWS).drop("embedding").withColumn("vec_id", F.lit(0))
    prepared = features.prepare(chunks).withColumn("row_key", F.monotonically_increasing_id()).localCheckpoint()
    none = spark.createDataFrame([], "query_id long, ref_document string, ref_path string, ref_names array<struct<words:array<string>,normal:string,compact:string>>")
    pairs = retrieval.general_pairs(prepared, ctx, none, ("hybrid",), vectors)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("LogicalRDD [")]  # what is read lies below
    assert "text_lower" not in above and "text_has" in above
    assert pairs.count() == len(LAWS) * len(QUERIES)


@pytest.mark.parametrize("mode", ["embedding", "hybrid"])
def test_results_are_those_of_chunks_with_their_vectors(spark, mode):
    rows = chunk_table(spark, CONSENT + LAWS).withColumn("vec_id", F.col("entry_ord"))
    # two chunks have no vector
    vectors = rows.where("entry_ord > 1").select("vec_id", "embedding")
    own = rows.withColumn("embedding", F.when(F.col("entry_ord") > 1, F.col("embedding"))).drop("vec_id")
    queries = spark.createDataFrame(QUERIES, COLUMNS)
    order = lambda found: [tuple(r) for r in found.orderBy("query_id", "rank").collect()]
    want = order(retrieval.search(own, queries, 3, mode))
    assert want and order(retrieval.search(rows.drop("embedding"), queries, 3, mode, vectors)) == want


def test_phrases_and_matches_of_a_text(spark):
    texts = ["", "PARTS and a May. Shall we? section 12A, SECTION 3", "Part II\n x must\trequired", "New Section on data portability", "Wages are no part; bab 3\nBAB 3\n"]
    rows = spark.createDataFrame([{"chunk_id": str(i), "document_id": "d", "section_heading": "", "section_id": "1", "text": t, "source_path": "p", "act_title": "", "source_file": "", "chunk_index": i, "unit_id": "", "document_aliases": []} for i, t in enumerate(texts)], "chunk_id string, document_id string, section_heading string, section_id string, text string, source_path string, act_title string, source_file string, chunk_index int, unit_type string, unit_id string, subsection_id string, document_aliases array<string>")
    ctx = contexts(spark.createDataFrame([(0, "What does section 12a of Part II say?")], "query_id long, query string"))
    out = features.prepare(rows.crossJoin(features.sought_phrases(ctx)), F.col("sought")).orderBy("chunk_index").collect()
    expected = {*features._SOUGHT, "ii", "section 12a"}
    assert [set(r["text_has"]) for r in out] == [{p for p in expected if p in t.lower()} for t in texts]
    assert [(r["references"], r["obligations"], [(m["label"], m["id"]) for m in r["markers"]]) for r in out] == [(0, 0, []), (2, 1, []), (0, 2, [("part", "II")]), (0, 0, []), (0, 0, [("bab", "3")])]
    found = graph.of_text(rows).orderBy("chunk_index").collect()
    assert [r["references"] for r in found] == [[], ["section:12A", "section:3"], [], [], []]
    assert [[m["label"] for m in r["marks"]] for r in found] == [[], [], ["part"], [], ["bab"]]
    with pytest.raises(ValueError):
        features.in_text("never looked for")

"""Exact nearest vectors, block by block."""

from pyspark.sql import functions as F

from lexloom.functions.text import cosine
from lexloom.operators import overlap


def test_blocks_give_what_all_pairs_give(spark, monkeypatch):
    monkeypatch.setattr(overlap, "BLOCK", 7)
    rows = [(i, [float((i * 7 + j * j) % 11 - 5) for j in range(4)]) for i in range(40)]
    rows += [(100 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(9)] + [(200, [0.0] * 4), (201, None), (202, [1.0, None]), (203, [1.0, 2.0, 3.0]), (204, []), (205, [float("nan"), 1.0, 0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, v array<double>")
    queries = vectors.where("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    every = vectors.join(queries).where("vec_id <> query_id").withColumn("score", F.greatest(F.lit(0.0), cosine(F.col("q"), F.col("v")))).where("score > 0").collect()
    expected = []
    above = lambda r: float("inf") if r["score"] != r["score"] else r["score"]
    for query_id in {r["query_id"] for r in every}:
        own = sorted((r for r in every if r["query_id"] == query_id), key=lambda r: (-above(r), r["vec_id"]))[:3]
        expected += [(query_id, i, r["vec_id"], repr(r["score"])) for i, r in enumerate(own, 1)]
    found = overlap.cosine_topk(vectors, queries, 3)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], repr(r["score"])) for r in found.collect()) == sorted(expected)
    # pairs of rows meet inside blocks of both sides, not in a product of all rows
    assert "BroadcastNestedLoopJoin" not in found._jdf.queryExecution().toString() and "CartesianProduct" not in found._jdf.queryExecution().toString()

"""Graph-supported search: hybrid results and graph results of the same questions, brought together per question."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import fixed_values as V
from lexloom.functions.text import first_of, has
from lexloom.operators import graph as graphs
from lexloom.operators import retrieval
from lexloom.plans.query_context import contexts
from lexloom.sources.tables import written

c = F.col
MODES = ("graph_supported", "hybrid_plus_graph", "hybrid_plus_graph_with_graph_rerank")
# Words of structure, after which a blank follows.
STRUCTURE_CUES = ["part ", "chapter ", "division ", "bahagian ", "bab ", "schedule ", "jadual "]
LEAST = 6


def path_strength(reason):
    return first_of((reason.contains("amendment linkage"), 2.4), (reason.contains("explicit reference"), 2.0), (reason.contains("hierarchy"), 1.6), (F.lit(True), 1.0))


def merge(base: DataFrame, linked: DataFrame, k: int) -> DataFrame:
    """The k best of both; a graph result weighs 5 more, and a chunk found twice has its better score (the base row wins a tie)."""
    both = base.withColumn("_from", F.lit(0)).unionByName(linked.withColumn("score", c("score") + 5.0).withColumn("_from", F.lit(1)))
    once = F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy(c("score").desc(), "_from"))
    return retrieval.top(both.withColumn("_nth", once).where("_nth = 1").drop("_nth", "_from", "rank"), k)


def search(chunks: DataFrame, queries: DataFrame, k: int = 3, mode: str = "graph_supported", graph: graphs.Graph | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """query_id, rank, score and chunk of the k best results of each question.

    Questions of parts and chapters, without graph results, or whose best graph result is of another document than
    the best hybrid one, have plain results: hybrid, or (in the reranking mode) filtered and reranked. vectors: as in retrieval.search.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    graph = graph or graphs.build(chunks)
    ctx = written(contexts(queries).join(queries.select("query_id", "query_vector"), "query_id"), "questions")
    reranking = mode == MODES[2]
    pool = max(k, V.FILTER_POOL if reranking else LEAST)
    scan = retrieval.scan(retrieval.prepared_chunks(chunks, ctx), ctx, pool, ("hybrid",), vectors)
    prepared = scan.prepared
    hybrid = written(retrieval.base_search(scan, pool, "hybrid"), "hybrid")
    narrower = hybrid if pool == max(k, LEAST) else written(retrieval.base_search(scan, max(k, LEAST), "hybrid"), "hybrid")
    found = written(graphs.search(graph, queries, max(k, LEAST)), "graph-results")
    first = narrower.where("rank = 1").select("query_id", c("document_id").alias("hybrid_document"))
    first_linked = found.where("rank = 1").select("query_id", c("document_id").alias("graph_document"))
    plain_kind = has(c("lowered"), *STRUCTURE_CUES)
    routes = ctx.select("query_id", plain_kind.alias("structure")).join(first, "query_id", "left").join(first_linked, "query_id", "left")
    use = ~c("structure") & c("graph_document").isNotNull() & (c("hybrid_document").isNull() | (c("hybrid_document") == c("graph_document")))
    routes = retrieval.few(written(routes.select("query_id", use.alias("use_graph"), F.coalesce("hybrid_document", "graph_document").alias("target"), "hybrid_document"), "routes"))
    with_graph = routes.where("use_graph").select("query_id", "target", "hybrid_document")
    others = queries.join(routes.where("NOT use_graph"), "query_id", "left_semi")
    if reranking:
        plain = retrieval.finished(written(hybrid.join(others.select("query_id"), "query_id", "left_semi"), "candidates"), k, "hybrid_filtered_rerank")
    else:
        plain = narrower.join(others.select("query_id"), "query_id", "left_semi").where(c("rank") <= k).select(*retrieval.RESULT)
    mine = found.join(with_graph, "query_id")
    if mode == MODES[0]:
        named = prepared.select("chunk_id", "section_heading", "section_id", "chunk_index")
        linked = mine.where(c("rank") <= k).drop("reason", "target", "hybrid_document").join(named, "chunk_id").select(*retrieval.RESULT)
        return plain.unionByName(linked)
    safe = mine.where(c("document_id") == c("target")).withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    rows = prepared.join(retrieval.few(written(safe.select("query_id", c("chunk_id").alias("_chunk"), "score"), "linked")), c("chunk_id") == c("_chunk")).drop("_chunk").join(ctx, "query_id").withColumn("rank", F.lit(0))
    base = (hybrid if reranking else narrower).join(with_graph.select("query_id"), "query_id", "left_semi")
    if not reranking:
        return plain.unionByName(merge(base, rows.select(*base.columns), k).select(*retrieval.RESULT))
    merged = written(merge(retrieval.filter_candidates(base), rows.select(*base.columns), V.RERANK_POOL), "merged")
    # signals count where the question's hybrid document is the chunk's (or there is none)
    signals = safe.where(c("hybrid_document").isNull() | (c("document_id") == c("hybrid_document"))).select("query_id", "chunk_id", path_strength(c("reason")).alias("strength"), "position", "reason")
    return plain.unionByName(retrieval.rerank(merged, k, signals).select(*retrieval.RESULT))

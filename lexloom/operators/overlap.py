"""Token overlap of many short questions with many texts, by an inverted index; exact cosines of many vectors, by blocks."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.text import cosine, tokens

c = F.col
BROADCAST_POSTINGS = 200_000
#: Vectors, or queries, of a block.
BLOCK = 4096
#: Cosines may differ by as much from order of summing alone.
ROUNDING = 1e-9


def coverage_topk(texts: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, doc_id, score: half the share of a question's words, repeats counted, that a text has; ties by doc_id.

    texts(doc_id, text), queries(query_id, query). Distinct words of a text meet the questions' postings (broadcast
    behind a size check), so texts are not paired with questions they share nothing with; sums are combined in the
    map tasks, where all words of a text are, and only the k best of a question leave a task.
    """
    words = queries.select("query_id", tokens(c("query")).alias("words"))
    postings = words.select("query_id", F.size("words").alias("n"), F.explode("words").alias("word")).groupBy("query_id", "n", "word").agg(F.count("*").alias("times"))
    hint = F.broadcast(postings) if postings.limit(BROADCAST_POSTINGS + 1).count() <= BROADCAST_POSTINGS else postings
    of_text = texts.select("doc_id", F.explode(F.array_distinct(tokens(c("text")))).alias("word"))
    hits = of_text.join(hint, "word").groupBy("query_id", "doc_id", "n").agg(F.sum("times").alias("hits"))
    scored = hits.select("query_id", "doc_id", (c("hits") / c("n") * 0.5).alias("score"))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(c("score").desc(), "doc_id"))
    return scored.withColumn("rank", best).where(c("rank") <= k).select("query_id", "rank", "doc_id", "score")


def _near(k: int):
    """A function of a block of vectors and one of queries: of each query the k vectors of the block with the greatest cosines, and what rounding cannot tell from them.

    Of equal vectors only the k + 1 with the smallest ids can be results of any query, so no more of them are given out.
    """

    def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
        rows = column.to_pylist()
        out = np.zeros((len(rows), width))  # missing components add nothing to a product or a norm
        for i, row in enumerate(rows):
            out[i, : len(row)] = row
        return out

    def near(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        ids, asked = vectors.column("vec_id").to_numpy(), queries.column("query_id").to_numpy()
        found: list[tuple] = []
        if len(ids) and len(asked):
            width = max(pc.max(pc.list_value_length(x)).as_py() for x in (vectors.column("v"), queries.column("q")))
            v, q = matrix(vectors.column("v"), width), matrix(queries.column("q"), width)
            order = np.argsort(ids, kind="stable")
            ids, v = ids[order], v[order]
            same = np.unique(v, axis=0, return_inverse=True)[1].ravel()
            with np.errstate(all="ignore"):
                size = np.linalg.norm(v, axis=1)
                for i, query_id in enumerate(asked):
                    score = v @ q[i] / (size * np.linalg.norm(q[i]))
                    unknown = np.isnan(score) & (size * np.linalg.norm(q[i]) != 0)
                    score[(ids == query_id) | (np.isnan(score) & ~unknown)] = -1.0
                    score[unknown] = 2.0  # not a number is above all numbers
                    least = np.partition(score, -k)[-k] if len(score) > k else -1.0
                    times: Counter = Counter()
                    for at in np.flatnonzero((score >= least - ROUNDING) & (score > -ROUNDING)):
                        kind = -1 if unknown[at] else same[at]
                        times[kind] += 1
                        if times[kind] <= k + 1:
                            found.append((query_id, ids[at], score[at]))
        columns = list(zip(*found, strict=True)) or [[], [], []]
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=["query_id", "vec_id", "near"])

    return near


def cosine_topk(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: exact nearest vectors by cosine; scores below 0 count as 0, which is no result.

    vectors(vec_id, v), queries(query_id, q). Blocks of vectors meet blocks of queries, one pair of blocks a group; each gives out the few
    best of a query. Those that are among the k best of all blocks, as far as rounding tells, are scored by `cosine` and ranked.
    """
    whole = lambda name: F.coalesce(~F.exists(name, lambda x: x.isNull()), F.lit(False))
    vectors, queries = vectors.where(whole("v") & c("vec_id").isNotNull()), queries.where(whole("q") & c("query_id").isNotNull())
    n_v, n_q = (max(1, -(-rows.count() // BLOCK)) for rows in (vectors, queries))
    block = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = vectors.select(c("vec_id").cast("long").alias("vec_id"), "v", block("vec_id", n_v).alias("v_block"), every(n_q).alias("q_block"))
    asking = queries.select(c("query_id").cast("long").alias("query_id"), "q", block("query_id", n_q).alias("q_block"), every(n_v).alias("v_block"))
    blocks = ["v_block", "q_block"]
    found = held.groupBy(*blocks).cogroup(asking.groupBy(*blocks)).applyInArrow(_near(k), "query_id long, vec_id long, near double")
    by_near = Window.partitionBy("query_id").orderBy(c("near").desc())
    least = F.min(F.when(c("nth") <= k, c("near"))).over(Window.partitionBy("query_id"))
    ranked = found.withColumn("nth", F.row_number().over(by_near)).withColumn("least", least)
    close = ranked.where(c("near") >= c("least") - ROUNDING).select("query_id", "vec_id").distinct()
    pairs = close.join(vectors, "vec_id").join(queries, "query_id").withColumn("score", F.greatest(F.lit(0.0), cosine(c("q"), c("v")))).where("score > 0")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(c("score").desc(), "vec_id"))
    return pairs.withColumn("rank", best).where(c("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Approximate nearest neighbours by a permutation index.

A bounded set of pivots (vectors drawn by a hash of their value) orders every vector: its permutation is its PREFIX
nearest pivots, nearest first. A vector is posted in the inverted files of its first POSTED pivots, with its
permutation. A query asks the files of its first `probes` pivots and ranks what it finds by footrule distance,
the sum over pivots of how far apart its places are in both permutations (a pivot outside a prefix has place
PREFIX). What is as near as the nearest `share` of all vectors is reranked by the exact cosine, each vector once,
in the first file that it has in common with the query.

Pivots, probes, share and the sizes of files are fitted on a documented sample of SAMPLE vectors; every vector is
indexed. probes and share are the smallest that keep KEPT of the nearest neighbours that CALIBRATING queries of
the sample have in the sample. For n vectors in all, the k nearest have about k * SAMPLE / n members in the
sample, so as many (one at least) of each query count. The distance up to which a query reranks is that
below which `share` of the sample lies.

Files are kept in bundles of BUNDLE. Bundles are cut into blocks, and so are the queries that ask a bundle, each by
a hash, so a bundle that many vectors are near stays spread; a (bundle, vector block, query block) is one small
group and returns the few best of each query. Of equal vectors only the k + 1 with the smallest ids can be among the
k nearest of any query, so only they are candidates. A query that finds fewer than k asks all files.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm._shared import durable

PREFIX = 128
POSTED = 3
BUNDLE = 16
VECTOR_BLOCK, QUERY_BLOCK = 8192, 2048
SAMPLE, CALIBRATING, KEPT = 4096, 256, 0.995
#: Pivots at least and at most (places are 16-bit numbers).
FEWEST_PIVOTS, MOST_PIVOTS = 256, 1 << 14


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and v array<double>: rows with an id and a vector that is not null, empty or zero and has finite components only."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & F.forall("v", finite) & F.exists("v", lambda x: x != 0))


def n_pivots(n: int) -> int:
    """About twice the square root of the number of vectors, as a power of two within bounds; no more than there are vectors."""
    return min(n, MOST_PIVOTS, max(FEWEST_PIVOTS, 1 << (2 * round(n**0.5) - 1).bit_length()))


def permutations(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The PREFIX nearest pivots of each row, nearest first (by cosine; ties by pivot number)."""
    near = -((v / np.linalg.norm(v, axis=1, keepdims=True)) @ pivots.T)
    return np.argsort(near, axis=1, kind="stable")[:, :PREFIX].astype(np.int16)


def places(permutation: np.ndarray, n_pivots: int) -> np.ndarray:
    """The place of every pivot in a permutation; PREFIX (or how many pivots there are) if outside."""
    place = np.full(n_pivots, len(permutation), np.int16)
    place[permutation] = np.arange(len(permutation), dtype=np.int16)
    return place


def footrules(place: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """Footrule distances of a query (its places) to permutations, less a constant.

    Over a permutation's own pivots, |place - i| is added; a pivot that only the query's prefix has adds its place's
    distance to the end. That second sum is a constant less what the common pivots have in it.
    """
    x = place[orders]
    return (np.abs(x - np.arange(orders.shape[1], dtype=np.int16)) + x).sum(axis=1, dtype=np.int32)


class Fitted(NamedTuple):
    pivots: np.ndarray
    probes: int
    share: float
    sample: np.ndarray  # the sample's permutations
    posted: np.ndarray  # share of the vectors that each bundle holds
    asked: np.ndarray  # share of the queries that ask each bundle

    def cutoff(self, place: np.ndarray, k: int) -> int:
        """The footrule distance (less its constant) up to which a query reranks."""
        near = footrules(place, self.sample)
        take = min(len(near), max(int(np.ceil(self.share * len(near))), 4 * k))
        return int(np.partition(near, take - 1)[take - 1]) if take < len(near) else np.iinfo(np.int32).max


def fit(sample: np.ndarray, n: int, k: int) -> Fitted:
    """The index's parameters from distinct sample vectors (in the order drawn) that stand for n vectors."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    m = n_pivots(len(unit) if n <= len(unit) else n)
    pivots = unit[: min(m, len(unit))]
    m = len(pivots)
    own = unit[-SAMPLE:]  # pivots are drawn first: the others speak for the rest
    orders = permutations(own, pivots)
    counted = max(1, round(k * len(own) / max(n, len(own))))
    needed_files, needed_rows = [1], [1]
    asking = range(max(0, len(own) - CALIBRATING), len(own))  # as few pivots as there can be
    for i in asking:
        score = own @ own[i]
        score[i] = -2
        nearest = np.argsort(-score, kind="stable")[: min(counted, len(own) - 1)]
        place = places(orders[i], m)
        near = footrules(place, orders)
        near[i] = np.iinfo(np.int32).max
        rank = np.empty(len(own), np.int64)
        rank[np.argsort(near, kind="stable")] = np.arange(len(own))
        full = places(np.argsort(-(pivots @ own[i]), kind="stable").astype(np.int16), m)
        needed_files += (full[orders[nearest][:, :POSTED]].min(axis=1) + 1).tolist()
        needed_rows += (rank[nearest] + 1).tolist()
    probes = int(np.quantile(needed_files, KEPT, method="higher"))
    share = float(np.quantile(needed_rows, KEPT, method="higher")) / len(own)
    bundles = -(-m // BUNDLE)
    spread = lambda files: np.bincount(np.concatenate([np.unique(row // BUNDLE) for row in files]), minlength=bundles) / len(files)
    asked = np.argsort(-(own[asking] @ pivots.T), axis=1, kind="stable")[:, :probes]
    return Fitted(pivots, probes, share, orders, spread(orders[:, :POSTED]), spread(asked))


def _blocks(shares: np.ndarray, n: int, block: int) -> list[int]:
    return [max(1, int(np.ceil(n * x / block))) for x in shares]


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _spread(rows: DataFrame, own: list[int], other: list[int], own_name: str, other_name: str) -> DataFrame:
    """Each row has one block of its bundle by hash, and is copied to all blocks of the other side."""
    of = lambda counts: F.element_at(F.array(*map(F.lit, counts)), F.col("bundle") + 1)
    block = F.pmod(F.xxhash64("vec_id", "bundle"), of(own)).cast("int")
    return rows.withColumns({own_name: block, other_name: F.explode(F.sequence(F.lit(0), of(other) - 1))})


POSTING = T.StructType([T.StructField("bundle", T.IntegerType()), T.StructField("vec_id", T.LongType()), T.StructField("permutation", T.BinaryType()), T.StructField("v", T.BinaryType())])


def post(rows: DataFrame, fitted: Fitted) -> DataFrame:
    """The postings of rows(vec_id, v): a row for each bundle that holds one of a vector's first POSTED files."""
    size = fitted.pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 1024) for i in range(0, whole.num_rows, 1024)):
                v = _matrix(batch.column(1), size)
                orders = permutations(v.astype(np.float64), fitted.pivots)
                ids = batch.column(0).to_pylist()
                out = [(bundle, ids[i], orders[i].tobytes(), v[i].tobytes()) for i in range(len(ids)) for bundle in sorted(set((orders[i, :POSTED] // BUNDLE).tolist()))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=POSTING.names)

    return rows.select("vec_id", "v").mapInArrow(run, POSTING)


ASKING = T.StructType([*POSTING.fields, T.StructField("cutoff", T.LongType())])


def ask(rows: DataFrame, fitted: Fitted, k: int, whole: bool) -> DataFrame:
    """The queries' rows: one for each bundle that holds one of a query's first files, with the whole order of the pivots asked.

    `whole` asks all files and reranks all they hold.
    """
    size, m = fitted.pivots.shape[1], len(fitted.pivots)
    probes = m if whole else fitted.probes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for batch in (whole_batch.slice(i, 256) for i in range(0, whole_batch.num_rows, 256)):
                v = _matrix(batch.column(1), size)
                double = v.astype(np.float64)
                files = np.argsort(-((double / np.linalg.norm(double, axis=1, keepdims=True)) @ fitted.pivots.T), axis=1, kind="stable")[:, : max(probes, PREFIX)].astype(np.int16)
                out = []
                for i, query_id in enumerate(batch.column(0).to_pylist()):
                    cutoff = np.iinfo(np.int32).max if whole else fitted.cutoff(places(files[i, :PREFIX], m), k)
                    for bundle in np.unique(files[i, :probes] // BUNDLE).tolist():
                        out.append((bundle, query_id, files[i].tobytes(), v[i].tobytes(), cutoff))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64()))], names=ASKING.names)

    return rows.select("vec_id", "v").mapInArrow(run, ASKING)


def _best(queries: pd.DataFrame, vectors: pd.DataFrame, k: int, m: int, probes: int, kind: np.dtype) -> pd.DataFrame:
    """The k best of each query in one group: footrule over the rows that it meets here first, then the exact cosine of the near ones."""
    out: list[tuple[np.ndarray, ...]] = []
    if len(queries) and len(vectors):
        vectors = vectors.sort_values("vec_id", kind="stable")
        bundle = int(queries["bundle"].iloc[0])
        ids = vectors["vec_id"].to_numpy()
        v = np.stack([np.frombuffer(x, kind) for x in vectors["v"]]).astype(np.float64)
        norm = np.sqrt((v * v).sum(axis=1))
        orders = np.stack([np.frombuffer(x, np.int16) for x in vectors["permutation"]])
        own = orders[:, :POSTED]
        here = own // BUNDLE == bundle
        for query_id, raw_files, raw, cutoff in zip(queries["vec_id"], queries["permutation"], queries["v"], queries["cutoff"], strict=True):
            q, files = np.frombuffer(raw, kind).astype(np.float64), np.frombuffer(raw_files, np.int16)
            turn = np.full(m, m, np.int32)
            turn[files[:probes]] = np.arange(min(probes, len(files)))
            turns = turn[own]
            first = turns.min(axis=1)
            rows = np.flatnonzero((first < m) & (np.where(here, turns, m).min(axis=1) == first) & (ids != query_id))
            if len(rows) and cutoff < np.iinfo(np.int32).max:
                rows = rows[footrules(places(files[:PREFIX], m), orders[rows]) <= cutoff]
            if len(rows):
                score = (v[rows] * q).sum(axis=1) / (norm[rows] * np.sqrt((q * q).sum()))
                best = np.argsort(-score, kind="stable")[:k]
                out.append((np.full(len(best), query_id), ids[rows][best], score[best]))
    columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.array([], np.int64), np.array([], np.int64), np.array([], np.float64)]
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))


def search(vectors: DataFrame, k: int = 5, query_rule: str = "vec_id % 50 = 0", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k nearest found of every query; ties go to the smaller vec_id.

    Queries are the rows that query_rule names (on vec_id). All vectors must have one length: rows of another
    length than the most common one's (the smallest at a tie) take no part. A query is not its own
    candidate; rows that repeat a vec_id count as one, the first by vector. No usable rows: no rows.
    """
    rows = usable(vectors, id_col, vector_col)
    rows = durable(rows.groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    spark = vectors.sparkSession
    sizes = rows.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n"), F.count_if(F.expr(query_rule)).alias("queries")).orderBy(F.desc("n"), "size").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    size, n, n_queries = sizes[0]
    rows = rows.where(F.size("v") == size)
    by_id = Window.partitionBy("v").orderBy("vec_id")
    candidates = durable(rows.withColumn("nth", F.row_number().over(by_id)).where(F.col("nth") <= k + 1), "candidates")
    # equal vectors are drawn once: a vector's first row stands for all
    wanted = n_pivots(n) + SAMPLE
    drawn = candidates.where("nth = 1").select("v").orderBy(F.xxhash64(F.lit("pivot"), "v"), "v").limit(wanted).collect()
    fitted = fit(np.array([r["v"] for r in drawn], np.float64), n, k)
    m = len(fitted.pivots)
    kind = np.dtype(np.float32 if _is_float(vectors, vector_col) else np.float64)
    typed = F.col("v").cast("array<float>" if kind == np.float32 else "array<double>").alias("v")
    queries = rows.where(query_rule).select("vec_id", typed)
    vector_blocks = _blocks(fitted.posted, n, VECTOR_BLOCK)
    keys = ["bundle", "vector_block", "query_block"]

    def found_by(asking: DataFrame, n_asking: int, whole: bool) -> DataFrame:
        probes = m if whole else fitted.probes
        query_blocks = _blocks(np.ones(len(fitted.asked)) if whole else fitted.asked, n_asking, QUERY_BLOCK)
        posted = _spread(post(candidates.select("vec_id", typed), fitted), vector_blocks, query_blocks, "vector_block", "query_block")
        asked = _spread(ask(asking, fitted, k, whole), query_blocks, vector_blocks, "query_block", "vector_block")

        def best(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
            return _best(q, v, k, m, probes, kind)

        return asked.groupBy(*keys).cogroup(posted.groupBy(*keys)).applyInPandas(best, "query_id long, vec_id long, score double")

    def ranked(found: DataFrame) -> DataFrame:
        window = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    near = durable(ranked(found_by(queries, n_queries, False)), "nearest")
    enough = near.where(F.col("rank") == min(k, n - 1)).select(F.col("query_id").alias("vec_id"))
    short = durable(queries.join(enough, "vec_id", "left_anti"), "short") if n > 1 else queries.limit(0)
    n_short = short.count()
    if not n_short:
        return near
    rest = ranked(found_by(short, n_short, True))
    return near.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(rest)


def _is_float(vectors: DataFrame, vector_col: str) -> bool:
    kind = vectors.schema[vector_col].dataType
    return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)

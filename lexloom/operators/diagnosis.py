"""Why judged questions fail: the parts of their scores, and what each part alone decides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions import fixed_values as V
from lexloom.functions.text import cosine, norm
from lexloom.operators.retrieval import boosts, few
from lexloom.sources.tables import written

c = F.col
#: Scores are compared to so many decimals.
DECIMALS = 6


def failure_parts(prepared: DataFrame, ctx: DataFrame, benchmark: DataFrame, mode: str = "hybrid") -> DataFrame:
    """query_id, part, expected, winning, rank, rank_without for every failed question and every part of the mode's score.

    benchmark: query_id, expected_doc, expected_unit. A question fails if the best chunk of its general scan is not of the expected unit; the expected
    chunk is the best of that unit (questions whose unit has none have no rows). expected and winning are what the part adds to the scores of the two
    chunks; rank is the expected chunk's, rank_without the one it would have if no chunk had the part. Chunks of equal scores go by
    chunk_index, chunk_id and entry_ord.

    Chunks are scored once, into a narrow table; all ranks are counts over it, so that nothing is sorted and a task gives out one row of counts a question.
    """
    semantic = F.greatest(F.lit(0.0), cosine(c("query_vector"), c("embedding"), (c("query_norm"), c("embedding_norm"))))
    weighed = {n: F.coalesce(v, F.lit(0.0)) * V.MODE_WEIGHTS[mode][n] for n, v in (boosts() | {"semantic": semantic}).items() if V.MODE_WEIGHTS[mode][n]}
    asked = ctx.join(benchmark.where("expected_doc IS NOT NULL AND expected_unit IS NOT NULL").select("query_id", "expected_doc", "expected_unit"), "query_id")
    fits = F.coalesce((c("act_title") == c("expected_doc")) & (c("unit") == c("expected_unit")), F.lit(False))
    place = F.struct("chunk_index", "chunk_id", "entry_ord")
    asked = written(asked.withColumn("query_norm", norm(c("query_vector"))), "asked")
    scored = prepared.withColumn("embedding_norm", norm(c("embedding"))).join(few(asked)).select("query_id", place.alias("place"), fits.alias("fits"), F.array(*weighed.values()).alias("parts"))
    total = lambda parts: F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    scored = written(scored.withColumn("total", total(c("parts"))), "parts")
    order = F.struct(-F.round("total", DECIMALS), "place")
    row = F.struct("parts", "total", "place", "fits")
    best = scored.groupBy("query_id").agg(F.min_by(row, order).alias("won"), F.min_by(F.when(c("fits"), row), F.when(c("fits"), order)).alias("wanted"))
    failed = best.where(c("wanted").isNotNull() & ~c("won.fits"))
    met = scored.join(few(written(failed, "failed")), "query_id")

    def ahead(i: int | None):
        """Is a chunk before the expected one, without part i?"""
        mine, theirs = ((c(f"{p}total") - (F.lit(0.0) if i is None else c(f"{p}parts")[i])) for p in ("", "wanted."))
        mine, theirs = F.round(mine, DECIMALS), F.round(theirs, DECIMALS)
        return (mine > theirs) | ((mine == theirs) & (c("place") < c("wanted.place")))

    counts = met.groupBy("query_id").agg(F.count_if(ahead(None)).alias("before"), F.array(*(F.count_if(ahead(i)) for i in range(len(weighed)))).alias("without"))
    names = F.array(*map(F.lit, weighed))
    each = counts.join(failed, "query_id").select("query_id", "before", F.posexplode(F.arrays_zip(names.alias("part"), c("wanted.parts").alias("expected"), c("won.parts").alias("winning"), c("without"))).alias("i", "p"))
    value = lambda name: (F.round(c(f"p.{name}"), DECIMALS) + 0.0).alias(name)  # noqa: E731  (no negative zero)
    return each.select("query_id", "p.part", value("expected"), value("winning"), (c("before") + 1).alias("rank"), (c("p.without") + 1).alias("rank_without"))


def attribution(parts: DataFrame) -> DataFrame:
    """query_id, part, rank, rank_without, gap: per failed question the part without which the expected chunk would stand best (the first by name at a tie).

    gap is what the winning chunk has of it more than the expected one.
    """
    best = F.min_by(F.struct("part", "rank", "rank_without", (F.round(c("winning") - c("expected"), DECIMALS) + 0.0).alias("gap")), F.struct("rank_without", "part"))
    return parts.groupBy("query_id").agg(best.alias("best")).select("query_id", "best.*")

"""Failed questions taken apart, index builds and cleaned texts over all documents, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import fixed_values as V
from lexloom.operators import diagnosis, embedding, retrieval
from lexloom.plans.query_context import contexts
from lexloom.registry import query
from lexloom.report_queries import _BENCHMARK, _benchmark
from lexloom.search_queries import _PARTS, inputs, materialized, scored_sql
from lexloom.sources.tables import table, written

c = F.col
_NAMES = [n for n in _PARTS if V.MODE_WEIGHTS["hybrid"][n]]
_FAILED = f"""{materialized(scored_sql("hybrid"))}, {_BENCHMARK},
fp0 AS MATERIALIZED (
  SELECT query_id, chunk_id, chunk_index, entry_ord, coalesce(act_title = expected_doc AND unit = expected_unit, false) AS fits, [{', '.join(f'{V.MODE_WEIGHTS["hybrid"][n]} * {_PARTS[n]}' for n in _NAMES)}]::DOUBLE[] AS parts
  FROM sc JOIN bench USING (query_id) WHERE expected_doc IS NOT NULL AND expected_unit IS NOT NULL),
fp1 AS MATERIALIZED (SELECT *, list_reduce(list_prepend(0.0::DOUBLE, parts), lambda a, x: a + x) AS total FROM fp0),
fp2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(total, 6) DESC, chunk_index, chunk_id, entry_ord) AS place, row_number() OVER (PARTITION BY query_id, fits ORDER BY round(total, 6) DESC, chunk_index, chunk_id, entry_ord) AS own FROM fp1),
pair AS MATERIALIZED (
  SELECT w.query_id, w.parts AS winning, e.parts AS expected, e.total, e.chunk_index, e.chunk_id, e.entry_ord, e.place AS rank FROM fp2 w JOIN fp2 e USING (query_id) WHERE w.place = 1 AND NOT w.fits AND e.fits AND e.own = 1),
np AS (SELECT unnest(range(1, {len(_NAMES) + 1})) AS i),
parts AS MATERIALIZED (
  SELECT pair.query_id, ({_NAMES!r})[i] AS part, round(any_value(expected[i]), 6) + 0.0 AS expected, round(any_value(winning[i]), 6) + 0.0 AS winning, any_value(pair.rank) AS rank,
    1 + count(*) FILTER (round(fp1.total - fp1.parts[i], 6) > round(pair.total - pair.expected[i], 6)
      OR (round(fp1.total - fp1.parts[i], 6) = round(pair.total - pair.expected[i], 6) AND (fp1.chunk_index, fp1.chunk_id, fp1.entry_ord) < (pair.chunk_index, pair.chunk_id, pair.entry_ord))) AS rank_without
  FROM pair JOIN fp1 USING (query_id), np GROUP BY 1, 2, i)"""


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, asked, known = inputs(spark, sf_dir)
    ctx = written(contexts(asked).join(asked.select("query_id", "query_vector"), "query_id"), "questions")
    return diagnosis.failure_parts(retrieval.with_vectors(retrieval.narrowed(chunks, ctx), known), ctx, _benchmark(spark))


@query(f"WITH {_FAILED} SELECT query_id, part, expected, winning, rank, rank_without FROM parts")
def q_failure_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of the scores of all failed questions, and the rank that each part alone would change."""
    return _parts(spark, sf_dir)


@query(f"""WITH {_FAILED} SELECT query_id, part, rank, rank_without, round(winning - expected, 6) + 0.0 AS gap FROM parts QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank_without, part) = 1""")
def q_failure_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per failed question the part that costs it most places."""
    return diagnosis.attribution(_parts(spark, sf_dir))


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


@query(rf"""
WITH w AS (SELECT doc_id, {_WORDS} AS words FROM documents),
b AS (SELECT doc_id, words, list_transform(words, lambda w: (31 * unicode(w[1]) + 17 * unicode(w[-1]) + length(w)) % 8) AS places FROM w)
SELECT doc_id, CASE WHEN len(words) = 0 THEN 'failed' ELSE 'encoded' END AS way, CASE WHEN len(words) = 0 THEN 'a blank text has no vector' END AS error,
  CASE WHEN len(words) > 0 THEN array_to_string(list_transform(range(0, 8), lambda i: len(list_filter(places, lambda p: p = i))), ',') END AS vector
FROM b
""")
def q_index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of all documents by the deterministic encoder, each different text encoded once; blank texts are failures."""
    built = embedding.build(table(spark, sf_dir, "documents").select("doc_id", "text"), embedding.WordShapes())
    return built.select("doc_id", "way", "error", F.when(c("embedding").isNotNull(), F.array_join(F.transform("embedding", lambda x: x.cast("long").cast("string")), ",")).alias("vector"))


_MAPPED = "coalesce(text, '')"
for _char, _plain in embedding.PUNCTUATION.items():
    _MAPPED = f"replace({_MAPPED}, '{_char}', '{_plain.replace(chr(39), chr(39) * 2)}')"


@query(rf"""
WITH f AS (SELECT doc_id, regexp_replace(strip_accents({_MAPPED}), '[^\x00-\x7F\pN]', ' ', 'g') AS t FROM documents),
r AS (
  SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(t, '\.{{4,}}|-{{4,}}|_{{4,}}', ' ... ', 'g'), '={{4,}}|\*{{4,}}|~{{4,}}', ' ', 'g'), '[\s\x0B\x1C-\x1F]+', ' ', 'g')) AS t FROM f)
SELECT doc_id, CASE WHEN length(t) <= 2400 THEN t ELSE coalesce(nullif(regexp_extract(left(t, 2400), '(?s)^(.*) ', 1), ''), left(t, 2400)) END AS cleaned FROM r
""")
def q_clean_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' texts as encoders take them."""
    return table(spark, sf_dir, "documents").select("doc_id", embedding.clean(F.coalesce("text", F.lit(""))).alias("cleaned"))

"""Refresh and curation summaries of the gold set, kinds by source, JSON properties and latencies of events, with SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.feature_queries import RULES, rules
from lexloom.gold_queries import _SET, CANDIDATES, q_gold_candidates, q_gold_set
from lexloom.operators import gold, properties, refresh
from lexloom.registry import query
from lexloom.report_queries import _BENCHMARK, _benchmark
from lexloom.sources.tables import shared_dir, table, written
from lexloom.streaming import frames

c = F.col
_COUNTS = lambda name, source: f"""{name} AS (
  SELECT 'category' AS kind, category AS name, count(*) AS n FROM {source} GROUP BY 2 UNION ALL SELECT 'document', coalesce(expected_doc, 'negative/none'), count(*) FROM {source} GROUP BY 2
  UNION ALL SELECT 'language', language, count(*) FROM {source} GROUP BY 2 UNION ALL SELECT 'all', 'all', count(*) FROM {source})"""  # noqa: E731
_CATEGORIES = [*gold.PRIORITY, "negative"]


@query(f"""
WITH {RULES}, {CANDIDATES}, {_SET}, pool AS (SELECT * FROM pos UNION ALL SELECT * FROM neg), {_COUNTS("b", "pool")}, {_COUNTS("a", "goldset")}
SELECT kind, name, coalesce(b.n, 0) AS before, coalesce(a.n, 0) AS after, coalesce(a.n, 0) - coalesce(b.n, 0) AS delta, b.n IS NULL AS newly,
  coalesce(a.n, 0) > 0 AND ((kind = 'category' AND a.n < 15) OR (kind = 'document' AND name <> 'negative/none' AND a.n < 18)) AS low
FROM b FULL JOIN a USING (kind, name)
""")
def q_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What balancing changed: the whole pool of candidates before, the gold set after; totals and categories are taken while these are written."""
    sides = []
    for candidates in (q_gold_candidates(spark, sf_dir), q_gold_set(spark, sf_dir)):
        kept, totals = refresh.stored(candidates, _CATEGORIES)
        sides.append(totals.where("n > 0").unionByName(refresh.counted(kept, ("document", "language"))))
    return refresh.compared(*sides)


@query(f"""
WITH {RULES}, {CANDIDATES}, {_SET}, {_BENCHMARK}, pool AS (SELECT * FROM pos UNION ALL SELECT * FROM neg),
final AS (SELECT query, category, language, expected_doc FROM goldset UNION ALL SELECT query, category, 'en', expected_doc FROM bench WHERE trim(query) <> ''), {_COUNTS("f", "final")}
SELECT * FROM f
UNION ALL SELECT 'origin', CASE WHEN trim(query) IN (SELECT trim(query) FROM pool) THEN 'generated' ELSE 'supplemented' END, count(*) FROM final GROUP BY 2
UNION ALL SELECT 'origin', 'removed', count(DISTINCT trim(query)) FROM pool WHERE trim(query) NOT IN (SELECT trim(query) FROM final)
""")
def q_curation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gold set with the stated questions as supplements: its counts, and where its questions come from."""
    own = ["query", "category", "language", "expected_doc"]
    stated = _benchmark(spark).where("trim(query) <> ''").withColumn("language", F.lit("en")).select(*own)
    final = written(gold.build(rules(spark, sf_dir)).select(*own).unionByName(stated), "final")
    return refresh.curation(final, q_gold_candidates(spark, sf_dir))


@query("""
WITH n AS (SELECT coalesce(source, '') AS file, coalesce(lang, '') AS kind, count(*) AS n FROM documents GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY n DESC, kind) AS nth, sum(n) OVER (PARTITION BY file) AS chunks, count(*) OVER (PARTITION BY file) AS kinds, string_agg(kind || ':' || n, ',' ORDER BY kind || ':' || n) OVER (PARTITION BY file) AS counts FROM n)
SELECT file, CAST(chunks AS BIGINT) AS chunks, kind AS dominant, round(n / chunks, 6) AS share, kinds > 1 AS mixed, counts FROM r WHERE nth = 1
""")
def q_dominant_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language that most documents of a source have, and whether it has several."""
    return refresh.dominant_types(table(spark, sf_dir, "documents"), "source", "lang")


@query("""
SELECT event_type, count(*) AS rows, count(*) FILTER (json_valid(props)) AS valid, count(k) AS present, CAST(sum(k) AS BIGINT) AS total, min(k) AS least, max(k) AS greatest, 'OBJECT<k: BIGINT>' AS schema
FROM (SELECT *, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1
""")
def q_event_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the JSON properties of all events hold, by type of event."""
    return properties.field_sums(table(spark, sf_dir, "events"), "event_type", "props", "$.k")


@query("""
WITH p AS (
  SELECT s.ts AS start_ts, date_diff('microsecond', s.ts, e.ts) AS us FROM events s JOIN events e ON e.user_id = s.user_id AND s.event_type = 'view' AND e.event_type = 'purchase' AND e.ts BETWEEN s.ts AND s.ts + INTERVAL 6 HOUR)
SELECT date_trunc('day', start_ts) AS window_start, count(*) AS n, CAST(sum(us) AS BIGINT) AS total_us, min(us) AS least_us, max(us) AS greatest_us FROM p GROUP BY 1
""")
def q_request_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a view to the purchases of its user within six hours, by day: a stream of all events joined with itself; exact columns only."""
    # A pattern, as a stream takes a table that is one file for a folder of files otherwise.
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/[e]vents.parquet")
    pairs = frames.request_latency(events.where("event_type = 'view'"), events.where("event_type = 'purchase'"))
    out = f"{shared_dir(spark)}/latency-{uuid.uuid4().hex}"
    pairs.writeStream.format("parquet").option("path", f"{out}/pairs").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return frames.latency_windows(spark.read.schema(pairs.schema).parquet(f"{out}/pairs")).drop("median_us", "p95_us")

"""Gold-question candidates of rules made of all documents, with SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.feature_queries import RULES, rules
from lexloom.operators import gold as G
from lexloom.registry import query
from lexloom.sql_text import contains_any, one_of, quoted

c = F.col
_TRIM = "' ' || chr(9)"
_count = lambda name, pattern: f"len(regexp_extract_all({name}, '{pattern}'))"
_usable = rf"""(NOT list_contains({one_of(G.GENERIC)}, lower(heading)) AND length(heading) >= 4 AND NOT regexp_matches(lower(heading), '{G.NOISY}')
    AND {_count("heading", "[0-9]")} / greatest(length(heading), 1) <= 0.25 AND {_count("lower(heading)", "[^" + chr(92) + "p{L}" + chr(92) + "p{N}" + chr(92) + "s&,/" + chr(92) + "-]")} / greatest(length(heading), 1) < 0.12)"""
UNITS = rf"""
gu0 AS (
  SELECT chunk_id, document_id, chunk_unit_type AS unit_type, unit, act_title, section_heading, document_id || '.pdf' AS source_file, text, given, chunk_index,
    lower(act_title || ' ' || section_heading) AS title, lower(act_title || ' ' || document_id || '.pdf') AS named,
    list_filter(list_transform(regexp_split_to_array(text, '\r\n|\n|\r')[1:4], lambda x: trim(x, {_TRIM})), lambda x: regexp_matches(x, '{G.MARKER}'))[1] AS marker_line FROM rules),
gu1 AS (
  SELECT *, CASE WHEN {contains_any("title", G.MALAY)} THEN 'ms' ELSE 'en' END AS language,
    CASE WHEN {contains_any("named", ["amendment", "pindaan"])} OR regexp_matches(named, '\bact[- ]?a\d+\b') THEN 'amendment' WHEN {contains_any("named", ["p.u.", "gazette", "order", "perintah"])} THEN 'gazette'
      WHEN {contains_any("named", ["constitution", "perlembagaan"])} THEN 'constitution' ELSE 'act' END AS kind,
    trim(regexp_replace(regexp_replace(trim(section_heading), '{G.UNIT_PREFIX}', ''), '\s+', ' ', 'g'), ' -—:;') AS heading,
    list_filter(given, lambda a: a <> '' AND a <> act_title) AS aliases, CASE WHEN unit_type = 'article' THEN 'Article' WHEN unit_type = 'perkara' THEN 'Perkara' ELSE 'Section' END AS en_label,
    regexp_extract(marker_line, '{G.MARKER}', 1) AS marker_word, trim(regexp_replace(regexp_extract(marker_line, '{G.MARKER}', 2), '^[\s—:.\-]+', '')) AS topic, CAST(unit AS BIGINT) AS number FROM gu0),
gu AS MATERIALIZED (
  SELECT *, coalesce(CASE WHEN language = 'ms' THEN list_filter(aliases, lambda a: {contains_any("lower(a)", G.MALAY)})[1] END, list_filter(aliases, lambda a: length(a) <= 10 OR {contains_any("a", ["Act", "PDPA", "Akta"])})[1], act_title) AS alias,
    CASE WHEN topic <> '' THEN upper(marker_word[1]) || lower(substr(marker_word, 2)) END AS marker, CASE WHEN language = 'ms' AND en_label = 'Section' THEN 'Seksyen' ELSE en_label END AS label FROM gu1
  WHERE NOT regexp_matches(act_title, '{G.NOISY}') AND NOT regexp_matches(section_heading, '{G.NOISY}') AND NOT (kind = 'gazette' AND {_count("text", chr(92) + "S+")} < 20))"""
_capable = ["appeal", "application", "power", "right", "offence"]


def _first_capable(name: str) -> str:
    earlier = _capable[: _capable.index(name)]
    return f"contains(lower(heading), '{name}')" + "".join(f" AND NOT contains(lower(heading), '{x}')" for x in earlier)


# the order in which the first capability counts is that of the rules
_RULES = {n: _first_capable(n) for n in _capable} | {
    "always": "true",
    "usable": f"heading <> '' AND {_usable}",
    "definition": f"heading <> '' AND {contains_any('lower(heading)', G.DEFINITION)}",
    "obligation": f"heading <> '' AND {contains_any('lower(heading)', G.OBLIGATION)}",
    "marked": f"marker IS NOT NULL AND {_usable}",
    "amendment": "kind = 'amendment'",
    "gazette": "kind = 'gazette'",
    "perkara": "language = 'ms' AND unit_type = 'perkara'",
}
_NAMES = {"doc": "act_title", "unit": "unit", "alias": "alias", "heading": "heading", "lower_heading": "lower(heading)", "label": "label", "lower_label": "lower(label)", "en_label": "en_label", "marker": "marker", "other": "other"}


def _filled(template: str) -> str:
    parts = [_NAMES[p[1:-1]] if p.startswith("{") else quoted(p) for p in re.split(r"(\{\w+\})", template) if p]
    return f"trim({' || '.join(parts)})" if parts else "NULL"


def _text(english: str, malay: str) -> str:
    return f"CASE WHEN language = 'ms' THEN {_filled(malay)} ELSE {_filled(english)} END"


_made = " UNION ALL ".join(
    f"SELECT {_text(en, ms)} AS query, '{category}' AS category, '{method}' AS generation_method, CAST({confidence} AS DOUBLE) AS confidence, {str(review).lower()} AS needs_review, language, act_title AS expected_doc, unit AS expected_unit, chunk_id AS source_chunk_id FROM gu WHERE {_RULES[rule]}"
    for method, category, confidence, review, rule, en, ms in G.TEMPLATES
)
_none = " UNION ALL ".join(
    f"SELECT {_text(en, ms)} AS query, 'negative' AS category, '{method}' AS generation_method, CAST({confidence} AS DOUBLE) AS confidence, true AS needs_review, language, CAST(NULL AS VARCHAR) AS expected_doc, CAST(NULL AS VARCHAR) AS expected_unit, CAST(NULL AS VARCHAR) AS source_chunk_id FROM gn WHERE {_RULES[rule]}"
    for method, confidence, rule, en, ms in G.NEGATIVES
)
CANDIDATES = f"""{UNITS},
gn0 AS (SELECT *, row_number() OVER (PARTITION BY act_title ORDER BY unit_type, number, unit, chunk_id) AS nth, count(*) OVER (PARTITION BY act_title) AS of FROM gu),
gt AS (SELECT act_title, coalesce(lead(act_title) OVER (ORDER BY act_title), min(act_title) OVER ()) AS other FROM (SELECT DISTINCT act_title FROM gu)),
gn AS (SELECT * FROM gn0 JOIN gt USING (act_title) WHERE nth = least(2, of)),
pos AS MATERIALIZED (SELECT * FROM ({_made}) WHERE query IS NOT NULL),
neg AS ({_none})"""


@query(f"WITH {RULES}, {CANDIDATES} SELECT * FROM pos UNION ALL SELECT * FROM neg")
def q_gold_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates of all templates, and questions without an answer."""
    units = G.unit_records(rules(spark, sf_dir))
    found = G.positives(units)
    return found.unionByName(G.negatives(units))


_SET = rf"""
alln AS (SELECT * FROM pos UNION ALL SELECT * FROM neg),
once AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trim(regexp_replace(lower(query), '\s+', ' ', 'g')) ORDER BY confidence DESC, category, coalesce(expected_doc, ''), coalesce(expected_unit, ''), generation_method) AS best FROM alln) WHERE best = 1),
t0 AS (SELECT *, row_number() OVER (PARTITION BY expected_doc, category ORDER BY confidence DESC, query) AS turn FROM once WHERE category <> 'negative'),
t1 AS (SELECT *, row_number() OVER (PARTITION BY expected_doc ORDER BY turn, list_position({one_of(G.PRIORITY)}, category)) AS place FROM t0 WHERE turn <= 6),
t2 AS (SELECT * FROM t1 WHERE place <= 24),
n0 AS (SELECT *, row_number() OVER (ORDER BY language, query) AS nth FROM once WHERE category = 'negative'),
goldset AS (
  SELECT query, category, generation_method, confidence, needs_review, language, expected_doc, expected_unit FROM t2
  UNION ALL SELECT query, category, generation_method, confidence, needs_review, language, expected_doc, expected_unit FROM n0 WHERE nth <= (SELECT greatest(8, count(*) // 6) FROM t2))"""


@query(f"WITH {RULES}, {CANDIDATES}, {_SET} SELECT * FROM goldset")
def q_gold_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deduplicated and balanced candidates."""
    return G.build(rules(spark, sf_dir)).drop("source_chunk_id")


@query(f"""
WITH {RULES}, {CANDIDATES}, {_SET}
SELECT category, expected_doc, language, GROUPING(category, expected_doc, language) AS gid, count(*) AS candidates, count(*) FILTER (confidence >= 0.8 AND NOT needs_review) AS sure, count(*) FILTER (needs_review) AS review
FROM goldset GROUP BY GROUPING SETS ((category), (expected_doc), (language), ())
""")
def q_gold_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by category, document and language, and how many of them are sure or need a review."""
    return G.stats(G.build(rules(spark, sf_dir)))


_PLACED = f"""goldplaced AS (SELECT *, row_number() OVER (ORDER BY coalesce(expected_doc, 'zzz-negative'), category, language, query) AS place FROM goldset)"""


@query(f"WITH {RULES}, {CANDIDATES}, {_SET}, {_PLACED} SELECT place, query, category FROM goldplaced")
def q_gold_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The final order: by document (questions without one last), category, language, text."""
    return G.in_final_order(G.build(rules(spark, sf_dir))).select(c("place").cast("long").alias("place"), "query", "category")

"""Searches of stated questions over rules made of all documents, in all modes, with SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.feature_queries import ASKED, CONTEXTS, PREPARED, RULES, SCORES, rules
from lexloom.functions import fixed_values as V
from lexloom.operators import retrieval
from lexloom.registry import ORACLES, query
from lexloom.sources.tables import table
from lexloom.sql_text import quoted

c = F.col
K = 4
#: A question has the vector of vec_id 50 times its number, a chunk that of its number mod the number of vectors.
EVERY = 50


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", c("embedding").cast("array<double>").alias("embedding"))


def inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks with vec_id, the stated questions with their vectors, and the vectors."""
    known = vectors(spark, sf_dir)
    chunks = rules(spark, sf_dir).drop("embedding").withColumn("vec_id", F.pmod("entry_ord", F.lit(max(1, known.count()))))
    asked = F.broadcast(spark.createDataFrame([(i, q, EVERY * i) for i, q in enumerate(ASKED)], "query_id long, query string, vec_id long"))
    theirs = known.join(asked.select("vec_id"), "vec_id", "left_semi")
    return chunks, asked.join(theirs, "vec_id", "left").select("query_id", "query", F.coalesce("embedding", F.array(F.lit(0.0))).alias("query_vector")), known


_ORDER = "chunk_index, chunk_id, entry_ord"
_mentions = SCORES["outside_penalty"].replace("(SELECT names FROM acts WHERE document_id = 'act1')", "ref_names")
_INNER = "lower(chunk_unit_type) IN ('article', 'perkara')"
#: General scores by name of their weight.
_PARTS = {
    "lexical": "lexical", "document": "document", "subsection": "subsection", "definition": "defines", "recall": "recall", "hierarchy": "hierarchy_match", "obligation_text": "obligation_text",
    "obligation_heading": "obligation_heading", "obligation_internal": "obligation_internal", "obligation_definition": "obligation_definition", "agreement": "agreement_score", "semantic": "semantic",
}


def scored_sql(mode: str) -> str:
    semantic = "0" if mode == "lexical" else "greatest(0, coalesce(list_cosine_similarity(qv.vector, cv.vector), 0))"
    names = [n for n in SCORES if n not in ("outside_penalty", "graph_boost")]
    return f"""{RULES}, {PREPARED}, {CONTEXTS},
vec AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vector, count(*) OVER () AS n FROM embeddings),
sc AS MATERIALIZED (
  SELECT prep.*, ctx.*, {', '.join(f'CAST({SCORES[n]} AS DOUBLE) AS {n}' for n in names)}, {semantic} AS semantic FROM prep, ctx
  LEFT JOIN vec qv ON qv.vec_id = {EVERY} * query_id LEFT JOIN vec cv ON cv.vec_id = entry_ord % cv.n),
ref AS MATERIALIZED (
  SELECT query_id, document_id AS ref_document FROM (
    SELECT query_id, document_id, row_number() OVER (PARTITION BY query_id ORDER BY document + tie_break DESC, entry_ord) AS nth FROM sc
    WHERE document + tie_break >= 1.0 AND (document_id, entry_ord) IN (SELECT (document_id, min(entry_ord)) FROM prep GROUP BY document_id)) WHERE nth = 1),
never AS (
  SELECT query_id FROM ctx JOIN ref USING (query_id) JOIN prep p ON p.document_id = ref_document AND lower(p.chunk_unit_type) = ctx.unit_type WHERE has_unit
  GROUP BY query_id, ctx.unit_id HAVING CAST(regexp_replace(ctx.unit_id, '[^0-9]', '', 'g') AS BIGINT) > max(p.number)),
sr0 AS (SELECT sc.*, ref_document, rn.names AS ref_names FROM sc LEFT JOIN ref USING (query_id) LEFT JOIN acts rn ON rn.document_id = ref_document WHERE query_id NOT IN (SELECT query_id FROM never)),
sr AS MATERIALIZED (
  SELECT *, document_id = ref_document AS inside, CASE WHEN ref_document IS NULL THEN 0 WHEN document_id = ref_document THEN 0.75 + gazette_document + amendment_document + heading_intent ELSE -({_mentions}) END AS moved FROM sr0)"""


def base_sql(mode: str, k: int) -> str:
    """CTEs up to base: the k best of lexical, embedding or hybrid, with rank and score."""
    return f"{scored_sql(mode)},\n{_ranked_sql(mode, k)}"


def _ranked_sql(mode: str, k: int) -> str:
    """The CTEs of base_sql after those that score."""
    general = " + ".join(f"{V.MODE_WEIGHTS[mode][n]} * {column}" for n, column in _PARTS.items() if V.MODE_WEIGHTS[mode][n])
    special = "true" if mode != "embedding" else "false"
    calls = ("hierarchy AND hierarchy_match > 0", "obligation AND obligation_text > 0 AND obligation_definition <= 0", "recall > 0")
    steps, before = "", "i0"
    for n, call in enumerate(calls, 1):
        steps += f""",
m{n} AS (SELECT *, min(CASE WHEN n_ranked > {k} AND any_named AND slot IS NULL AND document >= 1.0 AND ({call}) THEN place END) OVER (PARTITION BY query_id) AS chosen FROM {before}),
n{n} AS (SELECT *, (slot IS NOT NULL AND (chosen IS NULL OR slot < {k})) OR coalesce(place = chosen, false) AS member FROM m{n}),
i{n} AS (
  SELECT * EXCLUDE (slot, chosen, member, anew), CASE WHEN member THEN CASE WHEN chosen IS NULL THEN slot ELSE anew END END AS slot FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN member THEN 0 ELSE 1 END, score DESC, {_ORDER}) AS anew FROM n{n}))"""
        before = f"i{n}"
    chosen = before if mode == "hybrid" else "i0"
    return f"""e0 AS (SELECT *, 10.0 + document * 2 - obligation_definition + subsection + defines + recall + hierarchy_match + obligation_text + obligation_heading + obligation_internal + lexical AS first_score FROM sr
  WHERE {special} AND exact_lookup AND lower(chunk_unit_type) = unit_type AND upper(unit) = unit_id),
e1 AS (SELECT *, first_score + moved AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first_score DESC, {_ORDER}) AS nth FROM e0) WHERE nth <= {k}),
exact AS MATERIALIZED (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {_ORDER}) AS rank FROM e1),
o0 AS (SELECT chunk_id, document_id, row_number() OVER d AS ord, len(markers) > 0 AS has_markers, coalesce(unit IS DISTINCT FROM lag(unit) OVER d, true) AS new_run FROM prep WINDOW d AS (PARTITION BY document_id ORDER BY {_ORDER})),
o1 AS (
  SELECT chunk_id, ord, has_markers, max(CASE WHEN has_markers THEN ord END) OVER (PARTITION BY document_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS open_marker,
    min(CASE WHEN new_run THEN ord END) OVER (PARTITION BY document_id ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_run FROM o0),
h0 AS MATERIALIZED (
  SELECT *, 3 * document + lexical AS named, position_bonus - xref_penalty * 2 + CASE WHEN marked_tail THEN 0.75 ELSE 0 END AS reliability,
    1.5 - CASE WHEN starts_with_heading THEN 2 ELSE 0 END - CASE WHEN compact_tail THEN 1 ELSE 0 END + CASE WHEN lower(chunk_unit_type) = 'section' THEN 1 ELSE 0 END - CASE WHEN {_INNER} THEN 1.5 ELSE 0 END AS opening_bonus,
    CASE WHEN starts_with_heading AND compact_tail THEN 0.5 WHEN starts_with_heading THEN 1.25 WHEN compact_tail THEN 3.0 ELSE 0.75 END + CASE WHEN {_INNER} THEN 1.5 ELSE 0 END - xref_penalty * 1.5 AS lead_bonus
  FROM sr JOIN o1 USING (chunk_id) WHERE {special} AND hierarchy AND inside AND query_id NOT IN (SELECT query_id FROM exact)),
anchor AS (SELECT * FROM h0 WHERE hierarchy_match > 0),
scope1 AS (
  SELECT * FROM (
    SELECT h0.*, row_number() OVER (PARTITION BY h0.query_id, h0.open_marker, h0.unit ORDER BY h0.ord) AS nth FROM h0 JOIN anchor a ON a.query_id = h0.query_id AND a.ord = h0.open_marker WHERE h0.definition AND NOT h0.has_markers)
  WHERE nth = 1 AND scope_definition > 0),
next1 AS (SELECT h0.*, a.lead_bonus AS a_lead FROM h0 JOIN anchor a ON a.query_id = h0.query_id AND h0.ord = a.next_run WHERE h0.begins),
h1 AS (
  SELECT query_id, chunk_id, chunk_index, entry_ord, ord, 7.0 + named + reliability + CASE WHEN begins THEN opening_bonus ELSE 0 END AS score FROM anchor
  UNION ALL SELECT query_id, chunk_id, chunk_index, entry_ord, ord, 8.5 + named + scope_definition FROM scope1
  UNION ALL SELECT query_id, chunk_id, chunk_index, entry_ord, ord, 6.0 + named + position_bonus + a_lead FROM next1),
h2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY score DESC, ord) AS nth FROM h1) WHERE nth = 1),
parts AS (SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {_ORDER}) AS rank FROM h2) WHERE rank <= {k}),
g0 AS (SELECT *, {general} AS first_score FROM sr WHERE query_id NOT IN (SELECT query_id FROM exact) AND query_id NOT IN (SELECT query_id FROM parts)),
g1 AS (SELECT *, first_score + moved AS score FROM g0 WHERE first_score > 0),
g2 AS MATERIALIZED (SELECT *, count(*) OVER q AS n_ranked, max(document >= 1.0) OVER q AS any_named, max(coalesce(inside, false)) OVER q AS any_inside, score + obligation_internal * 1.5 + document * 2 AS duty FROM g1 WINDOW q AS (PARTITION BY query_id)),
i0 AS (
  SELECT *, CASE WHEN place <= {k} THEN place END AS slot FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN obligation AND coalesce(inside, false) THEN 0 ELSE 1 END, CASE WHEN obligation AND inside IS NOT NULL AND any_inside THEN -duty ELSE -score END, score DESC, {_ORDER}) AS place FROM g2)){steps if mode == "hybrid" else ""},
base AS MATERIALIZED (
  SELECT query_id, chunk_id, score, rank FROM exact UNION ALL SELECT query_id, chunk_id, score, rank FROM parts
  UNION ALL SELECT query_id, chunk_id, score, slot FROM {chosen} WHERE slot IS NOT NULL)"""


_RESULT = "SELECT query_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score, chunk_id"


def _filtered(pool: str) -> str:
    """CTEs that filter the candidates of `pool` to f9."""
    return f""",
f0 AS (
  SELECT p.score, p.rank, sr.*, (lexical < 0.2) AND (heading_match <= 0) AS f_weak FROM {pool} p JOIN sr USING (query_id, chunk_id)),
f1 AS (
  SELECT *, score * 0.45 + lexical * 2.4 + heading_match * 2.8 + rerank_document * 3 + defines * 1.5 + exact_unit * 1.5 - xref_penalty * 1.5 + agreement_score * 2
    - CASE WHEN definition AND defines <= 0 THEN 1.0 ELSE 0 END - CASE WHEN f_weak THEN 0.5 ELSE 0 END AS pre_rank,
    count(*) FILTER (rerank_document >= 1.0) OVER q AS n_named, max(heading_match > 0) OVER q AS any_heading, max(defines > 0) OVER q AS any_defines FROM f0 WINDOW q AS (PARTITION BY query_id)),
f2 AS (
  SELECT *, NOT (n_named >= 2 AND rerank_document = 0 AND heading_match <= 0 AND exact_unit <= 0) AND NOT (definition AND any_defines AND defines <= 0 AND heading_match <= 0 AND rerank_document <= 0) AS kept,
    any_heading AND heading_match <= 0 AND lexical < 0.2 AND rerank_document <= 0 AND exact_unit <= 0 AS weak FROM f1),
f3 AS (SELECT *, sum(CASE WHEN kept AND weak THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY pre_rank DESC, {_ORDER} ROWS UNBOUNDED PRECEDING) AS nth_weak FROM f2),
f4 AS (SELECT *, max(stays) OVER (PARTITION BY query_id) AS any_kept FROM (SELECT *, kept AND (NOT weak OR nth_weak <= {V.WEAK_KEPT}) AS stays FROM f3)),
f5 AS (SELECT query_id, chunk_id, {_ORDER.replace('chunk_id, ', '')}, CASE WHEN any_kept THEN pre_rank ELSE score END AS score FROM f4 WHERE stays OR NOT any_kept),
f9 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {_ORDER}) AS rank FROM f5) WHERE rank <= {V.RERANK_POOL})"""


def _reranked(pool: str, signals: str | None = None, settle: bool = True) -> str:
    """CTEs that rerank the ranked rows of `pool` to z9 (with all their rows)."""
    graph = "coalesce(graph_support, 0)" if signals else "0"
    join = f" LEFT JOIN {signals} s USING (query_id, chunk_id)" if signals else ""
    extra = ", s.graph_support" if signals else ""
    settled = (
        f"""coalesce(NOT apply_rerank OR (definition AND NOT any_defines) OR n < 2 OR ((heading_lookup OR amendment OR hierarchy OR obligation) AND NOT (refine_headings AND n_same >= 2) AND s1 - s2 >= {V.CONFIDENT_MARGIN}), false)"""
        if settle
        else "false"
    )
    return f""",
z0 AS (SELECT p.score, p.rank, sr.*{extra} FROM {pool} p JOIN sr USING (query_id, chunk_id){join}),
z1 AS (SELECT *, first_value(document_id) OVER (PARTITION BY query_id ORDER BY rank) AS first_document, max(defines > 0) OVER q AS any_defines, count(*) OVER q AS n, max(CASE WHEN rank = 1 THEN score END) OVER q AS s1, max(CASE WHEN rank = 2 THEN score END) OVER q AS s2 FROM z0 WINDOW q AS (PARTITION BY query_id)),
z2 AS (SELECT *, count(*) FILTER (document_id = first_document) OVER (PARTITION BY query_id) AS n_same FROM z1),
z3 AS (SELECT *, {settled} AS settled FROM z2),
z4 AS (
  SELECT * EXCLUDE (score, rank), score * CASE WHEN heading_lookup OR amendment THEN 0.5 ELSE 0.35 END + heading_match * CASE WHEN heading_lookup THEN 2.2 ELSE 1.4 END + defines * 1.6
    + unit_position * CASE WHEN heading_lookup OR amendment THEN 0.25 ELSE 0.9 END + exact_unit * 1.6 + rerank_document * 2 + amendment_rerank + {graph} - xref_penalty * CASE WHEN amendment THEN 0.45 ELSE 1.1 END
    - definition_mismatch * 2 - (rank - 1) * 0.01 + CASE WHEN any_defines AND definition THEN CASE WHEN defines > 0 THEN 2.0 ELSE -0.75 END ELSE 0 END AS score FROM z3 WHERE NOT settled),
z5 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {_ORDER}) AS rank FROM z4),
z6 AS (SELECT *, refine_headings AND document_id = first_value(document_id) OVER (PARTITION BY query_id ORDER BY rank) AS focus0 FROM z5),
z7 AS (SELECT *, focus0 AND max(CASE WHEN focus0 THEN abs(alignment) END) OVER (PARTITION BY query_id) > 0 AS focus FROM z6),
z8 AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, focus ORDER BY rank) AS place, row_number() OVER (PARTITION BY query_id, focus ORDER BY score * 0.35 + alignment * 2.5 + specificity * 1.5 DESC, {_ORDER}) AS new_place FROM z7),
z9 AS (SELECT a.query_id, a.chunk_id, a.score, CASE WHEN a.focus THEN b.rank ELSE a.rank END AS rank FROM z8 a LEFT JOIN z8 b ON a.query_id = b.query_id AND a.focus AND b.focus AND b.place = a.new_place)"""


def _mode_sql(mode: str, k: int) -> tuple[str, str]:
    """The CTEs of a mode after those that score, and the one with its rows."""
    if mode in ("lexical", "embedding", "hybrid"):
        return _ranked_sql(mode, k), "base"
    pool = max(k, V.FILTER_POOL if mode == "hybrid_filtered_rerank" else V.RERANK_POOL)
    filtered = _filtered("pooled") if mode == "hybrid_filtered_rerank" else ""
    last = "f9" if filtered else "pooled"
    return f"""{_ranked_sql('hybrid', pool)},
pooled AS MATERIALIZED (SELECT base.* FROM base JOIN ctx USING (query_id) WHERE apply_rerank){filtered}{_reranked(last)},
every AS (
  SELECT base.query_id, rank, score, chunk_id FROM base JOIN ctx USING (query_id) WHERE NOT apply_rerank
  UNION ALL SELECT query_id, rank, score, chunk_id FROM z3 WHERE settled UNION ALL SELECT query_id, rank, score, chunk_id FROM z9)""", "every"


def search_sql(mode: str, k: int = K) -> str:
    steps, last = _mode_sql(mode, k)
    return f"WITH {scored_sql('lexical' if mode == 'lexical' else 'hybrid')},\n{steps} {_RESULT} FROM {last} WHERE rank <= {k}"


def materialized(sql: str) -> str:
    """Every CTE is worked out once: else those of scores are put in again wherever they are used."""
    return re.sub(r"(?m)^(\w+) AS \(", r"\1 AS MATERIALIZED (", sql)


def modes_sql(modes: tuple[str, ...], k: int = K) -> str:
    """CTEs up to searched(mode, query_id, rank, score, chunk_id): chunks are scored once for all modes, whose own CTEs have their number."""
    every, found = [scored_sql("hybrid")], []
    for i, mode in enumerate(modes):
        steps, last = _mode_sql(mode, k)
        for name in re.findall(r"(?m)^(\w+) AS (?:MATERIALIZED )?\(", steps):
            steps, last = (re.sub(rf"(?<![.\w]){name}(?!\w)(?! AS (?!MATERIALIZED)\w)", f"{name}_{i}", x) for x in (steps, last))
        every.append(steps)
        found.append(f"SELECT '{mode}' AS mode, query_id, rank, score, chunk_id FROM {last} WHERE rank <= {k}")
    return materialized(",\n".join([*every, f"searched AS MATERIALIZED ({' UNION ALL '.join(found)})"]))


def _search(mode: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        chunks, asked, known = inputs(spark, sf_dir)
        return retrieval.search(chunks, asked, K, mode, known).select("query_id", "rank", F.round("score", 6).alias("score"), "chunk_id")

    run.__name__ = f"q_rules_{mode}"
    run.__doc__ = f"Search of the stated questions over all rules in mode {mode}."
    query(search_sql(mode))(run)


for _mode in retrieval.MODES:
    _search(_mode)


def _document_sql(mode: str, k: int) -> str:
    """The same search over the word windows of all documents, for the questions of the q_search queries."""
    from lexloom.queries import QUESTIONS

    step = V.CHUNK_WORDS - V.OVERLAP_WORDS
    windows = f"""
w0 AS (SELECT doc_id, source, regexp_extract_all(coalesce(text, ''), '\\S+') AS words FROM documents),
w1 AS (SELECT doc_id, source, start // {step} AS i, array_to_string(words[start + 1:start + {V.CHUNK_WORDS}], ' ') AS text, words[start + 1:start + 4] AS opening_words FROM (SELECT *, unnest(range(0, len(words), {step})) AS start FROM w0)),
rules AS (
  SELECT doc_id || ':' || (i + 1) || ':' || i AS chunk_id, CAST(doc_id AS VARCHAR) AS document_id, 'Section ' || (i + 1) || ' ' || array_to_string(opening_words, ' ') AS section_heading, CAST(i + 1 AS VARCHAR) AS section_id, CAST(NULL AS VARCHAR) AS chunk_subsection, text,
    'Records of ' || coalesce(source, 'none') AS act_title, CAST(i AS INTEGER) AS chunk_index, 'section' AS chunk_unit_type, CAST(i + 1 AS VARCHAR) AS unit, []::VARCHAR[] AS given, doc_id * 100000 + i AS entry_ord FROM w1)
"""
    asked = "c0 AS (SELECT * FROM (VALUES " + ", ".join(f"(CAST({i} AS BIGINT), {quoted(q)})" for i, q in enumerate(QUESTIONS)) + ") AS t(query_id, raw)),\n"
    sql = search_sql(mode, k).replace(RULES, windows).replace(CONTEXTS, asked + CONTEXTS[CONTEXTS.index("c1 AS") :])
    sql = sql.replace("document_id || '.pdf'", "document_id || '.txt'").replace("entry_ord % cv.n", "(CAST(document_id AS BIGINT) + chunk_index) % cv.n")
    return f"WITH {windows} SELECT s.query_id, s.rank, s.score, chunk_id, rules.document_id, rules.section_heading, rules.section_id, rules.chunk_index FROM ({sql}) s JOIN rules USING (chunk_id)"


for _mode in retrieval.MODES:
    ORACLES[f"q_search_{_mode}"] = _document_sql(_mode, 5)

"""Answers, context blocks and graph paths for the stated questions over rules made of all documents, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.feature_queries import CONTEXTS, RULES, rules
from lexloom.functions import answer_texts as A
from lexloom.functions import fixed_values as V
from lexloom.graph_queries import graph_search_sql
from lexloom.operators import answers, reports, retrieval
from lexloom.operators import graph as G
from lexloom.registry import query
from lexloom.search_queries import base_sql, inputs
from lexloom.sql_text import contains_any, one_of, quoted

c = F.col
#: Results of a question that an answer may use.
USED = 5
_ONE_LINE = r"array_to_string(list_filter(list_transform(regexp_split_to_array({0}, '\r\n|\n|\r'), lambda x: trim(x, chr(9) || ' ')), lambda x: x <> ''), ' ')"
_topic = f"coalesce(nullif(trim(regexp_replace(head, '{answers.UNIT_START}', '')), ''), 'the retrieved provision')"
_cut = lambda name, limit: f"CASE WHEN length({name}) <= {limit} THEN {name} ELSE trim(regexp_replace(substr({name}, 1, {limit}), ' [^ ]*$', '')) || '...' END"
_terms = lambda name: f"list_distinct(list_filter(regexp_extract_all(lower({name}), '[a-z0-9]+'), lambda t: length(t) > 2 AND NOT list_contains({one_of(A.CONTENT_STOPWORDS)}, t)))"
#: Ranked results with reference, summary and what categories read.
RESULTS = rf"""
res0 AS (
  SELECT b.query_id, b.rank, b.score, rules.*, trim(section_heading) AS head, {_ONE_LINE.format("text")} AS flat,
    act_title || ', ' || CASE lower(chunk_unit_type) WHEN 'article' THEN 'Article' WHEN 'perkara' THEN 'Perkara' ELSE 'Section' END || ' ' || unit || CASE WHEN chunk_subsection IS NULL THEN '' ELSE '(' || chunk_subsection || ')' END AS cite
  FROM base b JOIN rules USING (chunk_id)),
res1 AS (SELECT *, CASE WHEN head <> '' AND starts_with(lower(flat), lower(head)) THEN ltrim(substr(flat, length(head) + 1)) ELSE flat END AS body FROM res0),
res2 AS (SELECT *, regexp_replace(CASE WHEN rtrim(trim(split_part(body, '. ', 1)), '.') <> '' THEN rtrim(trim(split_part(body, '. ', 1)), '.') ELSE rtrim(trim(body), '.') END, '{answers.UNIT_START}', '') AS said0 FROM res1),
res3 AS (SELECT *, CASE WHEN said0 = '' OR regexp_full_match(trim(said0), '[A-Za-z]?\d+[A-Za-z]?') THEN {_topic} ELSE said0 END AS said1 FROM res2),
res4 AS (SELECT *, {_cut("said1", 220)} AS said2, lower(section_heading || ' ' || text) AS hay FROM res3),
res AS MATERIALIZED (SELECT *, upper(said2[1]) || substr(said2, 2) || '.' AS said FROM res4)"""


def results(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    chunks, asked, _ = inputs(spark, sf_dir)
    found = retrieval.search(chunks, asked, USED, "lexical").select("query_id", "rank", "score", "chunk_id")
    return asked.select("query_id", "query"), F.broadcast(found).join(chunks, "chunk_id")


_newline = "chr(10)"
_list = lambda items: f"array_to_string(list_transform({items}, lambda x: '- ' || x), {_newline})"
_named = lambda name, value: f"'{name}:' || {_newline} || {value}"


def _put(text: str) -> str:
    return f"replace(replace(replace({quoted(text)}, '{{0}}', c1), '{{1}}', lower(s1)), '{{2}}', s1)"


def _answer(name: str) -> str:
    direct, legal, practical, limits = A.ANSWERS[name]
    basis = _put(legal)
    if name == "ambiguous":
        basis += f" || {_newline} || array_to_string(list_transform(top, lambda r: '- ' || r.cite || ': ' || r.said), {_newline})"
    if name == "grounded":
        more = "list_filter(top[2:3], lambda r: r.cite <> c1)"
        basis += f" || CASE WHEN len({more}) > 0 THEN {_newline} || {quoted(A.MORE_SOURCES)} || {_newline} || array_to_string(list_transform({more}, lambda r: '- ' || r.cite || ': ' || r.said), {_newline}) ELSE '' END"
    parts = [_named("Direct Answer", _put(direct)), _named("Legal Basis", basis), _named("Practical Meaning", quoted(practical)), _named("Important Limits", quoted(limits)), _named("Sources", f"CASE WHEN len(citations) = 0 THEN {quoted(A.NO_SOURCES)} ELSE {_list('citations')} END")]
    return f" || {_newline} || {_newline} || ".join(parts)


_category = lambda cues: f"min(CASE WHEN {contains_any('hay', cues)} THEN rank END)"
_item = lambda name, item: f"CASE WHEN k_{name} IS NOT NULL THEN {quoted(item)} ELSE {quoted(A.WITHOUT_TERMS) if name == 'written_terms' else 'NULL'} END"
_base = lambda name, text: f"CASE WHEN k_{name} IS NOT NULL THEN replace({quoted(text)}, '{{0}}', k_{name}) END"
_listed = f" || {_newline} || {_newline} || ".join(
    [
        _named("Direct Answer", quoted(A.CHECKLIST_ANSWER)),
        _named("Checklist", _list("list_filter([" + ", ".join(_item(n, i) for n, _, i, _ in A.CHECKLIST) + "], lambda x: x IS NOT NULL)")),
        _named("Legal Basis", _list("list_filter([" + ", ".join(_base(n, t) for n, _, _, t in A.CHECKLIST) + "], lambda x: x IS NOT NULL)")),
        _named("Important Limits", quoted(A.CHECKLIST_LIMITS)),
        _named("Sources", _list("citations")),
    ]
)
ANSWERS = f"""
seen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, cite ORDER BY rank) AS nth FROM res WHERE rank <= 5) WHERE nth = 1),
kr AS (
  SELECT query_id, {', '.join(f'{_category(cues)} AS r_{name}' for name, cues, _, _ in A.CHECKLIST)}, max(CASE WHEN contains(hay, '{A.NOTICE}') THEN rank END) AS r_notice, list(cite ORDER BY rank) AS five_cites FROM seen GROUP BY 1),
kc AS (
  SELECT kr.query_id, five_cites, {', '.join(f"max(CASE WHEN rank = {'coalesce(r_notice, r_termination)' if name == 'termination' else 'r_' + name} THEN cite END) AS k_{name}" for name, _, _, _ in A.CHECKLIST)} FROM kr JOIN seen USING (query_id) GROUP BY kr.query_id, five_cites),
tops AS (SELECT query_id, list({{'score': score, 'cite': cite, 'said': said, 'heading': section_heading}} ORDER BY rank) AS top FROM res WHERE rank <= 3 GROUP BY 1),
firsts AS (SELECT query_id, list(cite ORDER BY rank) AS cites FROM seen WHERE rank <= 3 GROUP BY 1),
qa AS (
  SELECT c0.query_id, raw, lower(raw) AS q, top, cites, kc.* EXCLUDE (query_id), top[1].cite AS c1, top[1].said AS s1 FROM c0 LEFT JOIN tops USING (query_id) LEFT JOIN firsts USING (query_id) LEFT JOIN kc USING (query_id)),
qd AS (
  SELECT *, CASE WHEN top IS NULL THEN 'none'
      WHEN (({contains_any('q', A.CHECKLIST_SUBJECTS)} AND {contains_any('q', A.CHECKLIST_ASKS)}) OR (contains(q, 'employment') AND {contains_any('q', ['agreement', 'contract'])} AND {contains_any('q', V.AGREEMENT_WORDS)}))
        AND coalesce({', '.join('k_' + n for n, _, _, _ in A.CHECKLIST)}) IS NOT NULL THEN 'checklist'
      WHEN top[1].score < {answers.LEAST_SCORE} THEN 'weak' WHEN abs(top[1].score - top[2].score) <= {answers.CLOSE} AND top[1].cite <> top[2].cite THEN 'ambiguous'
      WHEN NOT regexp_matches(raw, '(?i)\\b(section|article|perkara)\\b') AND len({_terms("top[1].heading")}) > 0 AND NOT list_has_any({_terms("top[1].heading")}, {_terms("raw")}) THEN 'broad' ELSE 'grounded' END AS decision FROM qa),
qc AS (SELECT * EXCLUDE (c1, s1), coalesce(c1, '') AS c1, coalesce(s1, '') AS s1, CASE decision WHEN 'none' THEN []::VARCHAR[] WHEN 'checklist' THEN five_cites WHEN 'weak' THEN cites[1:1] ELSE cites END AS citations FROM qd)"""


@query(f"""
WITH {base_sql("lexical", USED)}, {RESULTS}, {ANSWERS}
SELECT query_id, decision, array_to_string(citations, '|') AS citations, decision IN ('checklist', 'broad', 'grounded') AS grounded,
  CASE decision {' '.join(f"WHEN '{name}' THEN {_answer(name)}" for name in A.ANSWERS)} ELSE {_listed} END AS answer FROM qc
""")
def q_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole answers to the stated questions, with the checklist, broad and ambiguous ones."""
    asked, found = results(spark, sf_dir)
    return answers.compose(asked, found).withColumn("citations", F.array_join("citations", "|"))


_capital = "upper(chunk_unit_type[1]) || lower(substr(chunk_unit_type, 2))"
_sentence = f"CASE WHEN trim(split_part(flat, '. ', 1)) <> '' THEN trim(split_part(flat, '. ', 1)) ELSE flat END"


@query(f"""
WITH {base_sql("lexical", USED)}, {RESULTS}, x AS (SELECT *, {_sentence} AS sentence FROM res)
SELECT query_id, string_agg('[Source ' || rank || '] ' || act_title || ' | ' || {_capital} || ' ' || unit || ' | ' || section_heading || {_newline} || 'Summary: ' || {_cut("sentence", 280)}, {_newline} || {_newline} ORDER BY rank) AS context FROM x GROUP BY 1
""")
def q_context_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results of each question as one numbered text."""
    return answers.context_block(results(spark, sf_dir)[1])


@query(f"""
WITH {base_sql("lexical", USED)}, {RESULTS},
gs0 AS (SELECT query_id, act_title AS document, lower(chunk_unit_type) AS unit_type, unit AS unit_id, min(rank) AS first, count(*) AS chunk_count, arg_min(section_heading, rank) AS heading, arg_min({_cut("flat", 260)}, rank) AS preview FROM res GROUP BY 1, 2, 3, 4),
gg AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first) AS place FROM gs0)
SELECT query_id, string_agg('[Source ' || place || '] ' || document || ' | ' || upper(unit_type[1]) || substr(unit_type, 2) || ' ' || unit_id || ' | ' || heading || ' | Chunks: ' || chunk_count || {_newline} || 'Summary: ' || preview, {_newline} || {_newline} ORDER BY place) AS context FROM gg GROUP BY 1
""")
def q_grouped_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section-level sources of each question as one numbered text."""
    found = results(spark, sf_dir)[1]
    shaped = found.select("query_id", "rank", "score", c("act_title").alias("document"), F.lower("unit_type").alias("unit_type"), c("section_id").alias("unit_id"), c("section_heading").alias("heading"), "text")
    return answers.grouped_context_block(reports.group_sources(shaped, USED))


@query(f"""
WITH {base_sql("lexical", USED)}, {graph_search_sql(3)},
top1 AS (SELECT query_id, document_id FROM base JOIN rules USING (chunk_id) WHERE rank = 1)
SELECT f.query_id, CAST(f.rank AS INTEGER) AS rank, reason || ' -> ' || act_title || ' ' || upper(chunk_unit_type[1]) || lower(substr(chunk_unit_type, 2)) || ' ' || unit AS path
FROM found f JOIN top1 t ON t.query_id = f.query_id AND t.document_id = f.document_id JOIN rules ON rules.chunk_id = f.chunk_id
""")
def q_graph_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the graph reached the document of each question's first result."""
    chunks, asked, _ = inputs(spark, sf_dir)
    found = G.search(G.build(chunks), asked, 3).drop("document_id")
    linked = F.broadcast(found).join(chunks, "chunk_id")
    return answers.graph_paths(results(spark, sf_dir)[1], linked)


@query(f"""
WITH {CONTEXTS.split("c1 AS")[0].rstrip().rstrip(",")}
SELECT query_id, regexp_matches(raw, '{answers.EXPLICIT_UNIT}') OR regexp_matches(raw, '{answers.ADVICE}') AS abstains,
  ({contains_any('lower(raw)', A.CHECKLIST_SUBJECTS)} AND {contains_any('lower(raw)', A.CHECKLIST_ASKS)}) OR (contains(lower(raw), 'employment') AND {contains_any('lower(raw)', ['agreement', 'contract'])} AND {contains_any('lower(raw)', V.AGREEMENT_WORDS)}) AS checklist,
  array_to_string(list_sort({_terms("raw")}), ' ') AS terms FROM c0
""")
def q_answer_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which questions ask for a unit or advice, which for a checklist, and their content words."""
    asked = inputs(spark, sf_dir)[1]
    return asked.select("query_id", answers.demands_abstention(c("query")).alias("abstains"), answers.asks_checklist(c("query")).alias("checklist"), F.array_join(F.array_sort(answers.content_terms(c("query"))), " ").alias("terms"))


@query(f"""
WITH {base_sql("lexical", USED)}, asked AS (SELECT query_id, lower(regexp_extract(raw, '{answers.EXPLICIT_UNIT}', 2)) AS unit FROM c0)
SELECT query_id, unit <> '' AND unit NOT IN (SELECT lower(rules.unit) FROM base JOIN rules USING (chunk_id) WHERE base.query_id = asked.query_id) AS abstain FROM asked
""")
def q_lacking_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions for a unit that is not among their results."""
    asked, found = results(spark, sf_dir)
    return answers.lacks_asked_unit(asked, found)

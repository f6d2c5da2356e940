"""The structure graph of rules made of all documents, searches over it, and graph-supported searches, with SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.feature_queries import RULES, rules
from lexloom.functions import fixed_values as V
from lexloom.operators import graph as G
from lexloom.operators import router
from lexloom.registry import query
from lexloom.search_queries import K, _filtered, _reranked, base_sql, inputs
from lexloom.sql_text import contains_any, first_rule, one_of, points, quoted

c = F.col
_LINES = r"list_filter(list_transform(regexp_split_to_array(text, '\r\n|\n|\r'), lambda x: trim(x, ' ' || chr(9))), lambda x: x <> '')"
_words = lambda name: f"regexp_extract_all(lower({name}), '[a-z0-9]+')"
_first = lambda name, pattern: f"CASE WHEN regexp_matches({name}, '{pattern}') THEN lower(regexp_extract({name}, '{pattern}', 1)) || ':' || upper(regexp_extract({name}, '{pattern}', 2)) END"
_pairs = lambda name: f"list_distinct(list_transform(list_zip(regexp_extract_all({name}, '{G.UNIT_REFERENCE}', 1), regexp_extract_all({name}, '{G.UNIT_REFERENCE}', 2)), lambda z: lower(z[1]) || ':' || upper(z[2])))"
_whole = "(section_heading || chr(10) || text)"
_overlap = lambda left, right: f"(CASE WHEN len({left}) = 0 OR len({right}) = 0 THEN 0 ELSE len(list_intersect({left}, {right})) / len(list_distinct({left})) END)"
GRAPH = rf"""
un AS MATERIALIZED (
  SELECT document_id || ':' || lower(chunk_unit_type) || ':' || upper(unit) AS node_id, document_id, lower(chunk_unit_type) AS kind, upper(unit) AS ident, chunk_id, chunk_index, section_heading, act_title, text, given,
    row_number() OVER (PARTITION BY document_id ORDER BY chunk_index, chunk_id) AS ord FROM rules),
ln AS (SELECT *, unnest(range(0, len(lines))) AS n FROM (SELECT document_id, ord, chunk_index, {_LINES} AS lines FROM un)),
mk0 AS (SELECT *, lines[n + 1] AS line, lines[n + 2] AS following FROM ln WHERE regexp_matches(lines[n + 1], '{G.MARKER}')),
mk AS MATERIALIZED (
  SELECT *, document_id || ':hierarchy:' || label || ':' || ident AS node_id, CASE WHEN own <> '' THEN own WHEN following IS NOT NULL AND NOT regexp_matches(following, '(?i)^(section|article|perkara)\s+\d+[A-Za-z]?\b') THEN following ELSE '' END AS title,
    ord + CASE WHEN n = 0 THEN 0 ELSE 1 END AS holds_from
  FROM (SELECT *, lower(regexp_extract(line, '{G.MARKER}', 1)) AS label, upper(regexp_extract(line, '{G.MARKER}', 2)) AS ident, trim(regexp_extract(line, '{G.MARKER}', 3)) AS own FROM mk0)),
markers AS (
  SELECT node_id, document_id, label, ident, title, chunk_index FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY ord DESC, n DESC) AS nth FROM mk) WHERE nth = 1),
sp AS (SELECT *, lead(holds_from) OVER (PARTITION BY document_id, label ORDER BY holds_from, ord, n) AS until FROM mk),
tt AS (SELECT document_id, act_title, list_distinct({_words("act_title")}) AS words, list_distinct({_words("regexp_replace(regexp_replace(act_title, '(?i)" + chr(92) + "s*" + chr(92) + "((amendment|pindaan)" + chr(92) + ")" + chr(92) + "s*', ' ', 'g'), '(?i)" + chr(92) + "s+Act" + chr(92) + "s+A" + chr(92) + "d+" + chr(92) + "b', '', 'g')")}) AS plain FROM un WHERE ord = 1),
pr AS (
  SELECT a_id AS document_id, b_id AS principal FROM (
    SELECT a.document_id AS a_id, b.document_id AS b_id, row_number() OVER (PARTITION BY a.document_id ORDER BY len(list_intersect(a.plain, b.words)) DESC, b.document_id) AS nth
    FROM tt a JOIN tt b ON a.document_id <> b.document_id WHERE regexp_matches(lower(a.act_title), 'amendment|pindaan') AND len(list_intersect(a.plain, b.words)) >= 2) WHERE nth = 1),
rf AS (
  SELECT a.node_id AS src, b.node_id AS dst FROM (SELECT node_id, document_id, ord, unnest({_pairs(_whole)}) AS pair FROM un) a JOIN un b ON b.node_id = a.document_id || ':' || a.pair WHERE b.ord <= a.ord AND a.node_id <> b.node_id),
ow AS (SELECT un.*, coalesce(principal, document_id) AS target FROM un LEFT JOIN pr USING (document_id)),
edges AS MATERIALIZED (
  SELECT DISTINCT 'CONTAINS' AS edge_type, sp.node_id AS src, un.node_id AS dst FROM sp JOIN un ON un.document_id = sp.document_id AND un.ord >= holds_from AND (until IS NULL OR un.ord < until)
  UNION SELECT 'NEXT_UNIT', node_id, following FROM (SELECT node_id, lead(node_id) OVER (PARTITION BY document_id ORDER BY ord) AS following FROM un) WHERE following IS NOT NULL
  UNION SELECT 'REFERS_TO', src, dst FROM rf UNION SELECT 'REVERSE_REFERS_TO', dst, src FROM rf
  UNION SELECT 'REFERS_TO', node_id, target || ':' || {_first("text", G.INSERT_AFTER)} FROM ow WHERE regexp_matches(text, '{G.INSERT_AFTER}')
  UNION SELECT 'AMENDS', node_id, target || ':' || {_first("section_heading", G.AMENDMENT_OF)} FROM ow WHERE regexp_matches(section_heading, '{G.AMENDMENT_OF}')
  UNION SELECT 'INSERTS', node_id, target || ':' || {_first("section_heading", G.NEW_UNIT)} FROM ow WHERE regexp_matches(section_heading, '{G.NEW_UNIT}'))
"""


@query(f"WITH {RULES}, {GRAPH} SELECT edge_type, src, dst FROM edges")
def q_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All edges: structure, order, references both ways, amendments and insertions."""
    return G.build(rules(spark, sf_dir)).edges.select("edge_type", "src", "dst")


@query(f"""
WITH {RULES}, {GRAPH}
SELECT node_id, document_id, kind, ident, '' AS title, chunk_index, regexp_matches({_whole}, '{G.COMMENCEMENT}') AS commences FROM un
UNION ALL SELECT node_id, document_id, label, ident, title, chunk_index, false FROM markers
""")
def q_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units and hierarchy markers, and which units tell of a commencement."""
    built = G.build(rules(spark, sf_dir))
    units = built.units.drop("commences").join(built.commences.withColumn("commences", F.lit(True)), "node_id", "left")
    units = units.select("node_id", "document_id", c("unit_type").alias("kind"), c("unit_id").alias("ident"), F.lit("").alias("title"), "chunk_index", F.coalesce("commences", F.lit(False)).alias("commences"))
    return units.unionByName(built.markers.select("node_id", "document_id", c("label").alias("kind"), c("identifier").alias("ident"), "title", "chunk_index", F.lit(False).alias("commences")))


@query(f"""
WITH {RULES}, {GRAPH}
SELECT edge_type, count(*) AS edges, count(*) FILTER (dst NOT IN (SELECT node_id FROM un UNION ALL SELECT node_id FROM markers)) AS orphans FROM edges GROUP BY 1
""")
def q_graph_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges by type, and how many end where no node is."""
    return G.consistency(G.build(rules(spark, sf_dir)))


_ends = lambda edges, pair: f"len(list_filter(coalesce({edges}, []), lambda e: ends_with(e, ':' || {pair})))"
_heading = _words("section_heading")


def graph_search_sql(k: int) -> str:
    """CTEs to found: the k best graph results of each question of ctx (or c0)."""
    stop = one_of(G.TOPIC_STOPWORDS)
    return rf"""{GRAPH},
al AS (SELECT document_id, lower(trim(unnest([act_title] || given))) AS alias FROM un WHERE ord = 1),
ad AS (
  SELECT query_id, document_id AS asked_document FROM (SELECT query_id, document_id, row_number() OVER (PARTITION BY query_id ORDER BY length(alias) DESC, document_id) AS nth FROM c0 JOIN al ON alias <> '' AND contains(lower(raw), alias)) WHERE nth = 1),
gq AS MATERIALIZED (
  SELECT query_id, raw, lower(raw) AS q, asked_document, {_words("raw")} AS q_words, {_pairs("raw")} AS pairs,
    CASE WHEN regexp_matches(raw, '{G.ASKS_HIERARCHY}') THEN 'hierarchy' WHEN regexp_matches(raw, '{G.ASKS_AMENDMENT}') THEN 'amendment' WHEN regexp_matches(raw, '{G.ASKS_REFERENCE}') THEN 'reference' END AS asks
  FROM c0 LEFT JOIN ad USING (query_id) WHERE trim(raw) <> ''),
by_marker AS (
  SELECT query_id, f.chunk_id, document_id, chunk_index, 10.0 + s AS score, 'graph: hierarchy ' || label || ' ' || ident AS reason, node_id AS tie FROM (
    SELECT gq.query_id, m.*, {points((f"label = lower(regexp_extract(raw, '{G.ASKS_HIERARCHY}', 1))", 4.0), (f"ident = upper(regexp_extract(raw, '{G.ASKS_HIERARCHY}', 2))", 4.0))}
      + 2.0 * {_overlap("list_filter(q_words, lambda t: NOT list_contains(" + stop + ", t))", _words("title"))} AS s
    FROM gq JOIN markers m ON asked_document IS NULL OR asked_document = m.document_id WHERE asks = 'hierarchy') x
  JOIN (SELECT src, arg_min(un.chunk_id, (un.chunk_index, un.node_id)) AS chunk_id FROM edges JOIN un ON un.node_id = dst WHERE edge_type = 'CONTAINS' GROUP BY src) f ON f.src = x.node_id WHERE s > 0),
tg AS (SELECT src, list(dst) FILTER (edge_type = 'AMENDS') AS amends, list(dst) FILTER (edge_type = 'INSERTS') AS inserts FROM edges WHERE edge_type IN ('AMENDS', 'INSERTS') GROUP BY src),
by_amendment AS (
  SELECT query_id, chunk_id, document_id, chunk_index, 10.0 + s AS score, 'graph: amendment linkage' AS reason, chunk_id AS tie FROM (
    SELECT query_id, un.*, coalesce(list_sum(list_transform(pairs, lambda p: {_ends("amends", "p")} * 6.0 + {_ends("inserts", "p")} * 6.5
        + CASE WHEN {_ends("amends", "p")} + {_ends("inserts", "p")} = 0 AND list_contains({_heading}, split_part(p, ':', 2)) THEN 0.5 ELSE 0 END)), 0)
      + {_overlap("q_words", _heading)}
      + {points(("src IS NOT NULL", 3.0), (f"list_contains(q_words, 'new') AND list_contains({_heading}, 'new')", 2.0), (f"regexp_matches(q, 'into force|commencement|operation') AND regexp_matches({_whole}, '{G.COMMENCEMENT}')", 4.0), (f"regexp_matches(q, 'into force|commencement|operation') AND list_contains({_heading}, 'commencement')", 3.0), (f"(contains(q, 'general amendment') OR (contains(q, 'principal act') AND len(pairs) = 0 AND NOT contains(q, 'introduc'))) AND list_contains({_heading}, 'general') AND list_contains({_heading}, 'amendment')", 7.0))} AS s
    FROM gq JOIN un ON asked_document IS NULL OR asked_document = un.document_id LEFT JOIN tg ON tg.src = un.node_id WHERE asks = 'amendment') WHERE s > 0),
by_reference AS (
  SELECT query_id, s.chunk_id, s.document_id, s.chunk_index, 8.0 + {_overlap("q_words", _words("s.section_heading"))} AS score, 'graph: explicit reference to ' || replace(pair, ':', ' ') AS reason, s.chunk_id AS tie
  FROM (SELECT *, unnest(pairs) AS pair FROM gq WHERE asks = 'reference') a JOIN un t ON t.kind || ':' || t.ident = pair AND (asked_document IS NULL OR asked_document = t.document_id)
  JOIN edges e ON e.edge_type = 'REVERSE_REFERS_TO' AND e.src = t.node_id JOIN un s ON s.node_id = e.dst),
merged_graph AS (
  SELECT * EXCLUDE (nth) FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY score DESC, reason) AS nth FROM (SELECT * FROM by_amendment UNION ALL SELECT * FROM by_reference)) WHERE nth = 1),
found AS MATERIALIZED (
  SELECT query_id, chunk_id, document_id, score, reason, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_index, tie) AS rank FROM (SELECT * FROM by_marker UNION ALL SELECT * FROM merged_graph)) WHERE rank <= {k})"""


def _questions_only() -> str:
    from lexloom.feature_queries import CONTEXTS

    return CONTEXTS[: CONTEXTS.index("c1 AS")].rstrip().rstrip(",")


@query(f"WITH {RULES}, {_questions_only()}, {graph_search_sql(K)} SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, document_id, round(score, 6) AS score, reason FROM found")
def q_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph results of the stated questions: of parts, of amendments, of references."""
    chunks, asked, _ = inputs(spark, sf_dir)
    return G.search(G.build(chunks), asked, K).withColumn("score", F.round("score", 6))


_strength = first_rule(("contains(reason, 'amendment linkage')", 2.4), ("contains(reason, 'explicit reference')", 2.0), ("contains(reason, 'hierarchy')", 1.6), ("true", 1.0))
_support = f"{_strength} + greatest(0, 1.0 - position * 0.15) + {points(('contains(reason, ' + quoted('amendment linkage') + ')', 1.1), ('contains(reason, ' + quoted('explicit reference') + ')', 0.9), ('contains(reason, ' + quoted('hierarchy') + ')', 0.8), ('hierarchy AND contains(reason, ' + quoted('hierarchy') + ')', 0.6))}"


def _merge(base: str, k: int) -> str:
    """CTE merged: base rows and linked ones, each chunk once with its better score."""
    return f""",
mg0 AS (SELECT query_id, chunk_id, score, 0 AS from_graph FROM {base} UNION ALL SELECT query_id, chunk_id, score + 5.0, 1 FROM safe),
mg1 AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY score DESC, from_graph) AS nth FROM mg0),
merged AS (SELECT query_id, chunk_id, score, rank FROM (SELECT m.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_index, chunk_id, entry_ord) AS rank FROM mg1 m JOIN prep USING (chunk_id) WHERE nth = 1) WHERE rank <= {k})"""


def routed_sql(mode: str, k: int = K) -> str:
    least = max(k, router.LEAST)
    pool = max(k, V.FILTER_POOL) if mode == router.MODES[2] else least
    routes = f"""{base_sql('hybrid', pool)}, {graph_search_sql(least)},
one AS (SELECT query_id, arg_min(document_id, rank) AS hybrid_document FROM base JOIN prep USING (chunk_id) WHERE rank = 1 GROUP BY 1),
route AS MATERIALIZED (
  SELECT ctx.query_id, hybrid_document, coalesce(hybrid_document, found.document_id) AS target, NOT {contains_any("lowered", router.STRUCTURE_CUES)} AND found.document_id IS NOT NULL AND (hybrid_document IS NULL OR hybrid_document = found.document_id) AS use_graph
  FROM ctx LEFT JOIN one USING (query_id) LEFT JOIN found ON found.query_id = ctx.query_id AND found.rank = 1),
safe AS (SELECT f.*, hybrid_document, row_number() OVER (PARTITION BY f.query_id ORDER BY f.rank) AS position FROM found f JOIN route r ON r.query_id = f.query_id AND use_graph AND f.document_id = target),
with_graph AS (SELECT base.* FROM base JOIN route USING (query_id) WHERE use_graph),
without AS (SELECT base.* FROM base JOIN route USING (query_id) WHERE NOT use_graph)"""
    result = "SELECT query_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score, chunk_id FROM"
    if mode == router.MODES[0]:
        return f"WITH {routes} {result} (SELECT * FROM without WHERE rank <= {k} UNION ALL SELECT f.query_id, f.chunk_id, f.score, f.rank FROM found f JOIN route USING (query_id) WHERE use_graph AND f.rank <= {k})"
    if mode == router.MODES[1]:
        return f"WITH {routes}{_merge('with_graph', k)} {result} (SELECT * FROM without WHERE rank <= {k} UNION ALL SELECT query_id, chunk_id, score, rank FROM merged)"
    plain = _filtered("pooled") + _reranked("f9")
    graph = re.sub(r"\b([fz])(\d)\b", r"\1\1\2", _filtered("with_graph")) + _merge("ff9", V.RERANK_POOL)
    signals = f", sig AS (SELECT s.query_id, s.chunk_id, {_support} AS graph_support FROM safe s JOIN ctx USING (query_id) WHERE hybrid_document IS NULL OR document_id = hybrid_document)"
    final = re.sub(r"\bz(\d)\b", r"zz\1", _reranked("merged", "sig", settle=False))
    return f"""WITH {routes}, pooled AS (SELECT without.* FROM without JOIN ctx USING (query_id) WHERE apply_rerank){plain}{graph}{signals}{final}
{result} (
  SELECT w.query_id, w.rank, w.score, w.chunk_id FROM without w JOIN ctx USING (query_id) WHERE NOT apply_rerank
  UNION ALL SELECT query_id, rank, score, chunk_id FROM z3 WHERE settled UNION ALL SELECT query_id, rank, score, chunk_id FROM z9 UNION ALL SELECT query_id, rank, score, chunk_id FROM zz9) WHERE rank <= {k}"""


def _routed(mode: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        chunks, asked, known = inputs(spark, sf_dir)
        return router.search(chunks, asked, K, mode, vectors=known).select("query_id", "rank", F.round("score", 6).alias("score"), "chunk_id")

    run.__name__ = f"q_rules_{mode}"
    run.__doc__ = f"Search of the stated questions over all rules in mode {mode}."
    query(routed_sql(mode))(run)


for _mode in router.MODES:
    _routed(_mode)

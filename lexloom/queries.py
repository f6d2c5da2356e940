"""Queries of the retrieval operators over the driver tables, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.functions import fixed_values as V
from lexloom.functions.text import all_tokens, dedupe_key, first_sentence, preview, strip
from lexloom.operators import answers, evaluation, graph, overlap, reports, retrieval, segmentation
from lexloom.plans.query_context import contexts, route_mode
from lexloom.registry import query
from lexloom.sources.chunks import document_chunks, window_chunks
from lexloom.sources.tables import table
from lexloom.sql_text import ALL_TOKENS, TOKENS
from lexloom.sql_text import contains_any as _ANY
from lexloom.streaming import frames

c = F.col
_ONE_LINE = "array_to_string(list_filter(list_transform(regexp_split_to_array({0}, '\\r\\n|\\n|\\r'), lambda x: trim(x, chr(9) || ' ')), lambda x: x <> ''), ' ')"

@query(f"""
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, CAST(len(list_distinct(w)) AS BIGINT) AS n_distinct, sha256(array_to_string(a, ' ')) AS normal_sha256
FROM (SELECT doc_id, {TOKENS.format("text")} AS w, {ALL_TOKENS.format("text")} AS a FROM documents)
""")
def q_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = table(spark, sf_dir, "documents").select("doc_id", all_tokens(c("text")).alias("every"))
    words = every.withColumn("words", F.filter("every", lambda t: ~t.isin(V.QUERY_STOPWORDS)))
    return words.select("doc_id", F.size("words").cast("long").alias("n_tokens"), F.size(F.array_distinct("words")).cast("long").alias("n_distinct"), F.sha2(F.array_join("every", " "), 256).alias("normal_sha256"))


_TOPK = f"""
q AS (SELECT item_id AS query_id, {TOKENS.format("text")} AS w FROM benchmark),
p AS (SELECT query_id, word, count(*) AS times, any_value(n) AS n FROM (SELECT query_id, len(w) AS n, unnest(w) AS word FROM q) GROUP BY 1, 2),
d AS (SELECT doc_id, unnest(list_distinct({TOKENS.format("text")})) AS word FROM documents),
s AS (SELECT query_id, doc_id, CAST(sum(times) AS DOUBLE) / any_value(n) * 0.5 AS score FROM d JOIN p USING (word) GROUP BY 1, 2),
top AS (SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 3)
"""


@query(f"WITH {_TOPK} SELECT * FROM top")
def q_lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select(c("item_id").alias("query_id"), c("text").alias("query"))
    return overlap.coverage_topk(table(spark, sf_dir, "documents"), items, 3)


@query(f"""
WITH {_TOPK},
r AS (SELECT t.query_id, t.rank, t.score, d.source AS document, coalesce(d.lang, '') AS unit_id, d.doc_id, d.source || ' ' || d.lang AS heading, {_ONE_LINE.format("d.text")} AS line FROM top t JOIN documents d USING (doc_id)),
g AS (SELECT query_id, document, unit_id, min(rank) AS first, max(score) AS score, count(*) AS chunk_count, any_value(heading) AS heading FROM r GROUP BY 1, 2, 3)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY first) AS INTEGER) AS place, document, 'section' AS unit_type, unit_id, heading, round_even(score, 4) AS score, chunk_count FROM g
""")
def q_grouped_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    results = F.broadcast(q_lexical_topk(spark, sf_dir)).join(docs, "doc_id")
    shaped = results.select("query_id", "rank", "score", c("source").alias("document"), F.lit("section").alias("unit_type"), F.coalesce("lang", F.lit("")).alias("unit_id"), F.concat_ws(" ", "source", "lang").alias("heading"), "text")
    return reports.group_sources(shaped, 3).drop("preview")


@query("""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, greatest(0.0, list_cosine_similarity(q.e, c.e)) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE score > 0) WHERE rank <= 3
""")
def q_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", c("embedding").cast("array<double>").alias("v"))
    found = overlap.cosine_topk(vectors, vectors.where("vec_id % 50 = 0").select(c("vec_id").alias("query_id"), c("v").alias("q")), 3)
    return found.withColumn("score", F.round("score", 9))


@query(f"""
SELECT doc_id, CAST(start / 210 AS INTEGER) AS chunk_index, len(words[start + 1:start + 250]) AS n_words, sha256(array_to_string(words[start + 1:start + 250], ' ')) AS text_sha256
FROM (SELECT doc_id, words, unnest(range(0, len(words), {V.CHUNK_WORDS - V.OVERLAP_WORDS})) AS start FROM (SELECT doc_id, regexp_extract_all(text, '\\S+') AS words FROM documents))
""")
def q_word_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = window_chunks(table(spark, sf_dir, "documents"))
    return w.select("doc_id", c("chunk_index").cast("int").alias("chunk_index"), "n_words", F.sha2("text", 256).alias("text_sha256"))


_CUT = "CASE WHEN length({0}) <= {1} THEN {0} ELSE trim(regexp_replace(substr({0}, 1, {1}), ' [^ ]*$', '')) || '...' END"


@query(f"""
SELECT doc_id, {_CUT.format("line", 260)} AS preview, {_CUT.format("sentence", 280)} AS snippet
FROM (SELECT doc_id, line, CASE WHEN trim(split_part(line, '. ', 1)) <> '' THEN trim(split_part(line, '. ', 1)) ELSE line END AS sentence FROM (SELECT doc_id, {_ONE_LINE.format("text")} AS line FROM documents))
""")
def q_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", preview(c("text")).alias("preview"), first_sentence(c("text")).alias("snippet"))


@query("""
SELECT doc_id, n_chars, merged FROM (
  SELECT doc_id, n_chars, row_number() OVER (PARTITION BY key ORDER BY n_chars DESC, doc_id) AS nth, count(*) OVER (PARTITION BY key) AS merged
  FROM (SELECT doc_id, n_chars, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS key FROM documents)) WHERE nth = 1
""")
def q_dedupe_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", dedupe_key(c("text")).alias("key"))
    return reports.keep_best(docs.select("doc_id", "n_chars", F.sha2("key", 256).alias("key")), c("key"), "n_chars", "doc_id").select("doc_id", "n_chars", "merged")


@query("""
WITH t AS (SELECT source, lang, doc_id, n_chars, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS turn FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY turn, lang) AS place FROM t WHERE turn <= 6)
SELECT source, lang, doc_id, CAST(place AS INTEGER) AS place FROM p WHERE place <= 24
""")
def q_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "lang", "doc_id", "n_chars")
    return reports.balance(docs, "source", "lang", "n_chars", "doc_id").select("source", "lang", "doc_id", "place")


@query("""
WITH k AS (SELECT d.lang, d.source, l.quality = 1 AS positive, l.toxic = 0 AS h1, d.n_chars > 500 AS h3, d.n_chars > 200 AS answered FROM labels l JOIN documents d USING (doc_id)),
g AS (SELECT lang, source, GROUPING(lang, source) AS gid, count(*) AS cases, count(*) FILTER (positive) AS positives, count(*) FILTER (positive AND h1) AS n1, count(*) FILTER (positive AND h3) AS n3, count(*) FILTER (NOT positive AND NOT answered) AS silent
  FROM k GROUP BY GROUPING SETS ((lang), (source), ()))
SELECT lang, source, gid, cases, positives, round(CASE WHEN positives = 0 THEN 0 ELSE n1 / positives END, 6) AS hit_at_1, round(CASE WHEN positives = 0 THEN 0 ELSE n3 / positives END, 6) AS hit_at_3, round(CASE WHEN cases = positives THEN 0 ELSE silent / (cases - positives) END, 6) AS no_answer FROM g
""")
def q_hit_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")
    cases = joined.select("lang", "source", (c("quality") == 1).alias("positive"), (c("toxic") == 0).alias("hit_at_1"), (c("n_chars") > 500).alias("hit_at_3"), (c("n_chars") > 200).alias("answered"))
    return reports.hit_rates(cases, "lang", "source")


@query("""
WITH a AS (SELECT source AS file_name, count(*) AS n, list_sort(list_distinct(list(lang))) AS types FROM documents JOIN labels USING (doc_id) GROUP BY 1),
b AS (SELECT source AS file_name, count(*) AS n, list_sort(list_distinct(list(lang))) AS types FROM documents GROUP BY 1)
SELECT file_name, CASE WHEN a.n IS NULL THEN 'added' WHEN b.n IS NULL THEN 'removed' WHEN a.n <> b.n OR a.types <> b.types THEN 'changed' ELSE 'same' END AS status,
  coalesce(a.n, 0) AS old_count, coalesce(b.n, 0) AS new_count, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta FROM a FULL JOIN b USING (file_name)
""")
def q_snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    labelled = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id")
    shape = lambda d: reports.corpus_snapshot(d, "source", "lang").drop("mixed")
    return reports.compare_snapshots(shape(labelled), shape(docs))


@query("SELECT conv_id, turn, CAST(i AS INTEGER) AS seq, substr(text, CAST(i * 48 + 1 AS INTEGER), 48) AS piece FROM (SELECT conv_id, turn, text, unnest(range(0, CAST(ceil(length(text) / 48.0) AS BIGINT))) AS i FROM conversations)")
def q_stream_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(frames.pieces(c("text"))).alias("seq", "piece"))


@query("SELECT conv_id, turn, sha256(text) AS content_sha256, length(text) AS n_chars FROM conversations WHERE text <> ''")
def q_stream_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as NDJSON token lines, cut into fragments that ignore lines, framed and decoded again."""
    rows = q_stream_pieces(spark, sf_dir).withColumn("line", frames.message_line(c("piece")))
    keys = ["conv_id", "turn"]
    stream = rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]), "").alias("raw"))
    fragments = stream.select(*keys, F.posexplode(frames.pieces(c("raw"), 37)).alias("seq", "raw"))
    lines = frames.decode(frames.reframe(fragments, keys))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "content"))), lambda x: x["content"]), "")
    return lines.groupBy(*keys).agg(text.alias("text")).select(*keys, F.sha2("text", 256).alias("content_sha256"), F.char_length("text").cast("long").alias("n_chars"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def q_request_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.request_windows(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


_EVENT_ORDER = "PARTITION BY user_id ORDER BY ts, event_id"


@query(f"""
SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER ({_EVENT_ORDER} ROWS UNBOUNDED PRECEDING) AS marker,
  lead(event_id) OVER ({_EVENT_ORDER}) AS next_event FROM events
""")
def q_marker_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last marker at or before each row, and the row that follows it."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    marker = F.last(F.when(c("event_type") == "purchase", c("event_id")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return table(spark, sf_dir, "events").select("event_id", marker.alias("marker"), F.lead("event_id").over(w).alias("next_event"))




@query(f"""
WITH b AS (SELECT item_id AS query_id, lower(text) AS q FROM benchmark WHERE trim(text) <> '')
SELECT query_id, {_ANY("q", V.DEFINITION_CUES)} AS definition, {_ANY("q", V.STRICT_DEFINITION_CUES)} AS strict_definition, {_ANY("q", V.CAPABILITY_CUES)} AS capability,
  ({_ANY("q", V.OBLIGATION_CUES)} AND {_ANY("q", V.OBLIGATION_WORDS)}) OR {_ANY("q", V.OBLIGATION_PADDED)} AS obligation,
  {_ANY("q", V.HEADING_LOOKUP_CUES)} AS heading_lookup, {_ANY("q", V.AMENDMENT_CUES)} AS amendment, {_ANY("' ' || q || ' '", V.DOCUMENT_HINT_CUES)} AS document_hint,
  {_ANY("q", V.LEGAL_ACTION_CUES)} AND {_ANY("q", V.LEGAL_ACTION_WORDS)} AS legal_action,
  CASE WHEN regexp_matches(q, '\\b(amend|amends|amendment|pindaan|part|chapter|division|bahagian|bab|refers to|reference|rujuk)\\b') THEN 'hybrid_plus_graph_with_graph_rerank' ELSE 'hybrid_filtered_rerank' END AS mode FROM b
""")
def q_query_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select(c("item_id").alias("query_id"), c("text").alias("query"))
    ctx = contexts(items)
    return ctx.select("query_id", "definition", "strict_definition", "capability", "obligation", "heading_lookup", "amendment", "document_hint", "legal_action", route_mode(c("raw"), F.lit("auto")).alias("mode"))


_LINES = "list_filter(list_transform(regexp_split_to_array(text, '\\r\\n|\\n|\\r'), lambda x: trim(x, chr(9) || ' ')), lambda x: x <> '')"


@query(f"""
SELECT CAST(doc_id AS VARCHAR) AS document_id, CAST(i AS VARCHAR) AS section_id, 'Section ' || i AS section_heading, sha256('Section ' || i || chr(10) || i || '. ' || lines[i]) AS text_sha256
FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, {_LINES} AS lines FROM documents))
""")
def q_legal_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose lines are numbered paragraphs, segmented into units."""
    lines = F.filter(F.transform(F.split("text", r"\R"), strip), lambda x: x != "")
    numbered = F.array_join(F.transform(lines, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
    docs = table(spark, sf_dir, "documents").select(c("doc_id").cast("string").alias("document_id"), numbered.alias("text"), F.lit("corpus").alias("source_path"), F.lit("Records").alias("act_title"), F.lit("section").alias("unit_type_hint"))
    return segmentation.legal_units(docs).select("document_id", "section_id", "section_heading", F.sha2("text", 256).alias("text_sha256"))


@query(f"""
SELECT doc_id || ':section:' || i AS src, doc_id || ':section:' || (i + 1) AS dst
FROM (SELECT doc_id, unnest(range(1, CAST(ceil(len(regexp_extract_all(text, '\\S+')) / {V.CHUNK_WORDS - V.OVERLAP_WORDS}.0) AS BIGINT))) AS i FROM documents)
""")
def q_next_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between consecutive units of all documents' chunks."""
    built = graph.build(document_chunks(table(spark, sf_dir, "documents")))
    return built.edges.where("edge_type = 'NEXT_UNIT'").select("src", "dst")


_CASES = f"""
WITH {_TOPK},
r AS (SELECT q.query_id, 'src' || (q.query_id % 20) AS want, t.rank, d.source, d.lang FROM q LEFT JOIN top t USING (query_id) LEFT JOIN documents d USING (doc_id)),
g AS (SELECT query_id, coalesce(max(rank), 0) > 0 AS answered, coalesce(bool_or(source = want AND lang = 'en' AND rank = 1), false) AS hit_at_1,
  coalesce(bool_or(source = want AND lang = 'en'), false) AS hit_at_3, coalesce(bool_or(source = want), false) AS act FROM r GROUP BY 1)
SELECT query_id, hit_at_1, hit_at_3, answered, CASE WHEN hit_at_3 OR NOT answered THEN 'none' WHEN act THEN 'wrong_section' ELSE 'wrong_act' END AS miss FROM g
"""


def _named_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical results as results of acts (sources) and sections (languages)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    rows = F.broadcast(q_lexical_topk(spark, sf_dir)).join(docs, "doc_id")
    none = F.lit(None).cast("string")
    return rows.select("query_id", "rank", (c("score") * 2).alias("score"), c("source").alias("act_title"), c("doc_id").cast("string").alias("document_id"), F.lit("section").alias("unit_type"), F.lit("").alias("unit_id"), c("lang").alias("section_id"), none.alias("subsection_id"), none.alias("paragraph_id"))


@query(_CASES)
def q_gold_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = table(spark, sf_dir, "benchmark").select(c("item_id").alias("query_id"), F.concat(F.lit("src"), (c("item_id") % 20).cast("string")).alias("expected_act_title"), F.lit("en").alias("expected_section_id"), F.lit(None).cast("string").alias("expected_subsection_id"))
    return evaluation.cases(gold, _named_results(spark, sf_dir))


@query(f"""
SELECT count(*) AS cases, round(coalesce(avg(CAST(hit_at_1 AS INTEGER)), 0), 9) AS hit_at_1, round(coalesce(avg(CAST(hit_at_3 AS INTEGER)), 0), 9) AS hit_at_3,
  count(*) FILTER (miss = 'none') AS miss_none, count(*) FILTER (miss = 'right_section_wrong_subsection') AS miss_right_section_wrong_subsection,
  count(*) FILTER (miss = 'wrong_section') AS miss_wrong_section, count(*) FILTER (miss = 'wrong_act') AS miss_wrong_act FROM ({_CASES})
""")
def q_gold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.summary(q_gold_cases(spark, sf_dir))
    return out.withColumns({n: F.round(n, 9) for n in ("hit_at_1", "hit_at_3")})


@query(f"""
WITH {_TOPK},
r AS (SELECT q.query_id, t.rank, t.score * 2 AS score, d.source || ', Section ' || d.lang AS cite FROM q LEFT JOIN top t USING (query_id) LEFT JOIN documents d USING (doc_id)),
g AS (SELECT query_id, max(rank) AS n, max(score) FILTER (rank = 1) AS s1, max(score) FILTER (rank = 2) AS s2, max(cite) FILTER (rank = 1) AS c1, max(cite) FILTER (rank = 2) AS c2, max(cite) FILTER (rank = 3) AS c3 FROM r GROUP BY 1),
e AS (SELECT *, CASE WHEN n IS NULL THEN 'none' WHEN s1 < 0.6 THEN 'weak' WHEN s1 - s2 <= 0.08 AND c1 <> c2 THEN 'ambiguous' ELSE 'grounded' END AS decision FROM g)
SELECT query_id, decision, CASE WHEN decision = 'none' THEN '' WHEN decision = 'weak' THEN c1
  ELSE c1 || CASE WHEN c2 <> c1 THEN '|' || c2 ELSE '' END || CASE WHEN c3 <> c1 AND c3 <> c2 THEN '|' || c3 ELSE '' END END AS citations, decision = 'grounded' AS grounded FROM e
""")
def q_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select(c("item_id").alias("query_id"), c("text").alias("query"))
    return answers.decide(items, _named_results(spark, sf_dir)).withColumn("citations", F.array_join("citations", "|"))


#: The stated questions of the search queries.
QUESTIONS = [
    "Which section of the Records of src3 deals with the and that?",
    "section 2 of the Records of src5",
    "What is the definition of nicht in the Records of src1?",
    "What must an employer require under the Records of src7 act?",
    "who may appeal under Records of src2",
    "chou éoution mentment aile",
]
#: The vec_ids of the questions' vectors.
QUESTION_VECTORS = [0, 50, 100, 150, 200, 250]


def _with_vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks of the documents with vec_id, the questions with vectors of the embeddings table, and these vectors.

    The driver tables have no vectors of texts, so a chunk has that of vec_id (doc_id + chunk_index) mod the number
    of vectors, and a question that of its QUESTION_VECTORS. Where there is none, there is no semantic part.
    """
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", c("embedding").cast("array<double>").alias("vector"))
    n = max(1, vectors.count())
    chunks = document_chunks(table(spark, sf_dir, "documents"))
    key = F.pmod(c("document_id").cast("long") + c("chunk_index"), F.lit(n))
    chunks = chunks.drop("embedding").withColumn("vec_id", key)
    questions = spark.createDataFrame([(i, q, v) for i, (q, v) in enumerate(zip(QUESTIONS, QUESTION_VECTORS, strict=True))], "query_id long, query string, vec_id long")
    questions = F.broadcast(questions).join(vectors.join(F.broadcast(questions.select("vec_id")), "vec_id", "left_semi"), "vec_id", "left")
    return chunks, questions.select("query_id", "query", F.coalesce("vector", F.array(F.lit(0.0))).alias("query_vector")), vectors.withColumnRenamed("vector", "embedding")


def _search(mode: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        chunks, questions, vectors = _with_vectors(spark, sf_dir)
        return retrieval.search(chunks, questions, 5, mode, vectors).withColumn("score", F.round("score", 6))

    run.__name__ = f"q_search_{mode}"
    return query()(run)


for _mode in retrieval.MODES:
    _search(_mode)

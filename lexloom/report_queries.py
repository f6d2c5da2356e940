"""Evaluation by mode, reranking diagnostics and corpus audits over rules and statutes made of all documents, with SQL."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.feature_queries import ACTS, ASKED, NAMES, RULES, rules
from lexloom.gold_queries import CANDIDATES, _SET
from lexloom.operators import evaluation, gold, metadata, retrieval
from lexloom.plans.query_context import contexts
from lexloom.registry import query
from lexloom.search_queries import inputs, modes_sql
from lexloom.sources import statutes
from lexloom.sources.chunks import read_stored, write_chunks
from lexloom.sources.tables import shared_dir, table, written
from lexloom.sql_text import contains_any, quoted
from lexloom.statute_queries import _PACKED, _SECTIONS, MAX_WORDS, OVERLAP
from lexloom.streaming import frames

c = F.col
CATEGORIES = ["definition", "direct_lookup", "obligation", "capability", "heading_lookup", "gazette_order", "amendment", "hierarchy", "bilingual", "negative"]
EVALUATED = ("lexical", "hybrid", "hybrid_rerank", "hybrid_filtered_rerank")


def benchmark_rows() -> list[tuple]:
    """The stated questions with a category, an act and a unit by their number; every sixth one expects nothing."""
    return [(i, q, CATEGORIES[i % len(CATEGORIES)], None if i % 6 == 5 else ACTS[i % 2 * i % len(ACTS)], str(i % 4 + 1)) for i, q in enumerate(ASKED)]


_BENCHMARK = "bench AS (SELECT * FROM (VALUES " + ", ".join(f"(CAST({i} AS BIGINT), {quoted(q)}, '{cat}', {'CAST(NULL AS VARCHAR)' if doc is None else quoted(doc)}, '{unit}')" for i, q, cat, doc, unit in benchmark_rows()) + ") AS t(query_id, query, category, expected_doc, expected_unit))"
_ALIASES = "aliases AS (SELECT DISTINCT * FROM (VALUES " + ", ".join(f"({quoted(a.lower())}, {quoted(act)})" for act, names in zip(ACTS, NAMES) for a in [act, *names]) + ") AS t(alias, act_title))"
#: Two modes are enough for what is asked of each by itself.
SIMPLE = ("lexical", "embedding")
_found_sql = lambda modes: f"{modes_sql(modes)}, found AS MATERIALIZED (SELECT mode, s.query_id, s.rank, s.score, s.chunk_id, r.act_title, r.unit FROM searched s JOIN rules r USING (chunk_id))"


def _found(spark: SparkSession, sf_dir: str, modes: tuple[str, ...] = EVALUATED) -> DataFrame:
    chunks, asked, known = inputs(spark, sf_dir)
    every = [rows.select(F.lit(mode).alias("mode"), "query_id", "rank", "chunk_id") for mode, rows in retrieval.search_modes(chunks, asked, 4, modes, known).items()]
    found = reduce(DataFrame.unionByName, every)
    return written(F.broadcast(found).join(rules(spark, sf_dir).select("chunk_id", "act_title", c("section_id").alias("unit")), "chunk_id").drop("chunk_id"), "found")


def _benchmark(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(benchmark_rows(), "query_id long, query string, category string, expected_doc string, expected_unit string")


def _cases(spark: SparkSession, sf_dir: str, modes: tuple[str, ...] = EVALUATED) -> DataFrame:
    return evaluation.judged(_benchmark(spark), _found(spark, sf_dir, modes), evaluation.alias_lookup(rules(spark, sf_dir)))


_judged_sql = lambda modes: f"""{_found_sql(modes)}, {_BENCHMARK}, {_ALIASES},
named AS MATERIALIZED (SELECT query_id, act_title AS referenced FROM (SELECT query_id, act_title, row_number() OVER (PARTITION BY query_id ORDER BY length(alias) DESC, alias, act_title) AS nth FROM bench JOIN aliases ON contains(lower(query), alias)) WHERE nth = 1),
j0 AS MATERIALIZED (
  SELECT m.mode, b.query_id, category, expected_doc, expected_unit, referenced, coalesce(bool_or(act_title = expected_doc AND unit = expected_unit AND rank = 1), false) AS hit_at_1,
    coalesce(bool_or(act_title = expected_doc AND unit = expected_unit), false) AS hit_at_3, max(CASE WHEN rank = 1 THEN act_title END) AS top_document, count(rank) AS n, coalesce(bool_or(act_title = referenced), false) AS names_it
  FROM bench b CROSS JOIN (SELECT DISTINCT mode FROM found) m LEFT JOIN found f ON f.mode = m.mode AND f.query_id = b.query_id AND f.rank <= 3 LEFT JOIN named nm ON nm.query_id = b.query_id GROUP BY 1, 2, 3, 4, 5, 6),
j1 AS MATERIALIZED (SELECT *, expected_doc IS NULL OR category = 'negative' AS negative, CASE WHEN referenced IS NULL THEN n = 0 ELSE NOT names_it END AS silent FROM j0),
judged AS MATERIALIZED (
  SELECT *, negative AND silent AS quiet, NOT negative AND n > 0 AND top_document <> expected_doc AS wrong_document,
    CASE WHEN negative THEN CASE WHEN silent THEN NULL ELSE 'no_answer_failure' END WHEN hit_at_1 THEN NULL WHEN category IN ('hierarchy', 'amendment') THEN category || '_failure' WHEN category = 'gazette_order' THEN 'gazette_failure'
      WHEN top_document IS NULL THEN 'no_answer_failure' WHEN top_document <> expected_doc THEN 'wrong_document' ELSE 'wrong_unit_in_right_document' END AS bucket FROM j1)"""  # noqa: E731
_JUDGED = _judged_sql(EVALUATED)
_rate = lambda rule, of: f"round(CASE WHEN count(*) FILTER ({of}) = 0 THEN 0 ELSE count(*) FILTER ({rule}) / count(*) FILTER ({of}) END, 6)"
_SUMMARY = f"""SELECT mode, category, GROUPING(mode, category) AS gid, count(*) AS questions, {_rate("NOT negative AND hit_at_1", "NOT negative")} AS hit_at_1, {_rate("NOT negative AND hit_at_3", "NOT negative")} AS hit_at_3,
  {_rate("wrong_document", "NOT negative")} AS wrong_document_rate, {_rate("quiet", "negative")} AS no_answer,
  {', '.join(f"count(*) FILTER (bucket = '{b}') AS n_{b}" for b in ("hierarchy_failure", "amendment_failure", "gazette_failure", "no_answer_failure", "wrong_document", "wrong_unit_in_right_document"))}
FROM judged GROUP BY GROUPING SETS ((mode, category), (mode))"""


@query(f"WITH {_JUDGED} SELECT mode, query_id, hit_at_1, hit_at_3, quiet, bucket, referenced FROM judged")
def q_mode_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stated question in every mode: hits, negative success, failure bucket."""
    return _cases(spark, sf_dir).select("mode", "query_id", "hit_at_1", "hit_at_3", "quiet", "bucket", "referenced")


@query(f"WITH {_JUDGED} {_SUMMARY}")
def q_mode_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates and failures by mode and category."""
    return evaluation.mode_summary(_cases(spark, sf_dir))


@query(f"WITH {_judged_sql(SIMPLE)}, s AS ({_SUMMARY}) SELECT mode FROM s WHERE category IS NULL ORDER BY hit_at_1 DESC, hit_at_3 DESC, list_position([{', '.join(map(quoted, SIMPLE))}], mode) LIMIT 1")
def q_best_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mode with the best rates."""
    rates = evaluation.mode_summary(_cases(spark, sf_dir, SIMPLE)).where("gid = 1")
    return evaluation.best_mode(rates.withColumn("mode_order", F.array_position(F.array(*map(F.lit, SIMPLE)), c("mode"))))


@query(f"WITH {_judged_sql(SIMPLE)} SELECT mode, round(coalesce(avg(CAST(hit_at_1 AS INTEGER)), 0), 6) AS top_1 FROM judged WHERE category = 'direct_lookup' GROUP BY mode")
def q_direct_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a direct lookup has its unit first, by mode."""
    return _cases(spark, sf_dir, SIMPLE).where("category = 'direct_lookup'").groupBy("mode").agg(F.round(F.avg(c("hit_at_1").cast("int")), 6).alias("top_1"))


_place = lambda mode: f"min(CASE WHEN mode = '{mode}' AND act_title = expected_doc AND unit = expected_unit THEN rank END)"


@query(f"""
WITH {_found_sql(EVALUATED[1:])}, {_BENCHMARK},
pl AS MATERIALIZED (SELECT b.query_id, {_place("hybrid")} AS a, {_place("hybrid_rerank")} AS b, {_place("hybrid_filtered_rerank")} AS c FROM bench b LEFT JOIN found USING (query_id) WHERE category IN ('heading_lookup', 'bilingual', 'amendment') AND expected_doc IS NOT NULL GROUP BY 1)
SELECT count(*) AS focus_queries, count(*) FILTER (apply_rerank) AS triggered_queries, count(a) AS correct_present_before_rerank, count(*) FILTER (a = 1) AS hybrid_top1_correct, count(*) FILTER (b = 1) AS rerank_top1_correct,
  count(*) FILTER (c = 1) AS filtered_rerank_top1_correct, count(*) FILTER (a = 1 AND b IS DISTINCT FROM 1) AS hybrid_only_wins, count(*) FILTER (b = 1 AND a IS DISTINCT FROM 1) AS rerank_only_wins, count(*) FILTER (c = 1 AND a IS DISTINCT FROM 1) AS filtered_rerank_only_wins
FROM pl JOIN ctx USING (query_id)
""")
def q_rerank_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reranking does for the questions that it is meant for."""
    bench = _benchmark(spark)
    return evaluation.rerank_diagnostics(bench, _found(spark, sf_dir, EVALUATED[1:]), contexts(bench).select("query_id", "apply_rerank"))


_AUDITED = r"""
au AS (
  SELECT doc_id, 'file' || (doc_id % 50) || '.pdf' AS file, CASE WHEN doc_id % 50 = 7 AND doc_id % 4 = 0 THEN ' Other Act ' WHEN doc_id % 50 = 8 THEN 'Reprint of 8' WHEN doc_id % 50 = 9 THEN 'act_9' ELSE 'Act ' || (doc_id % 50) END AS act_title,
    CASE WHEN doc_id % 50 = 10 THEN 'd' || (doc_id % 3) ELSE 'd' || (doc_id % 50) END AS document_id, CASE WHEN doc_id % 50 = 11 AND doc_id % 2 = 1 THEN 'Article' WHEN doc_id % 50 = 12 THEN '' ELSE 'Section' END AS unit_type,
    CASE WHEN doc_id % 50 = 13 THEN []::VARCHAR[] WHEN doc_id % 50 = 14 THEN ['MYS12', 'Act'] WHEN doc_id % 50 = 15 THEN ['x.pdf'] ELSE ['Act ' || (doc_id % 50)] END AS document_aliases,
    CASE WHEN doc_id % 50 = 16 THEN 'file0.pdf' ELSE 'file' || (doc_id % 50) || '.pdf' END AS source_file, CASE WHEN doc_id % 50 = 17 THEN '' ELSE '1' END AS unit_id, '' AS section_id FROM documents)"""


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk for every document, in 50 files of which some have faults."""
    docs, i = table(spark, sf_dir, "documents").select("doc_id"), c("doc_id")
    k = F.pmod(i, F.lit(50))
    own = F.concat(F.lit("file"), k.cast("string"), F.lit(".pdf"))
    plain = F.concat(F.lit("Act "), k.cast("string"))
    strings = lambda *v: F.array(*map(F.lit, v)).cast("array<string>")
    return docs.select(
        "doc_id",
        own.alias("file"),
        F.when((k == 7) & (i % 4 == 0), " Other Act ").when(k == 8, "Reprint of 8").when(k == 9, "act_9").otherwise(plain).alias("act_title"),
        F.concat(F.lit("d"), F.when(k == 10, F.pmod(i, F.lit(3))).otherwise(k).cast("string")).alias("document_id"),
        F.when((k == 11) & (i % 2 == 1), "Article").when(k == 12, "").otherwise("Section").alias("unit_type"),
        F.when(k == 13, strings()).when(k == 14, strings("MYS12", "Act")).when(k == 15, strings("x.pdf")).otherwise(F.array(plain)).alias("document_aliases"),
        F.when(k == 16, "file0.pdf").otherwise(own).alias("source_file"),
        F.when(k == 17, "").otherwise("1").alias("unit_id"),
        F.lit("").alias("section_id"),
    )


@query(f"""
WITH {_AUDITED},
a1 AS (
  SELECT file, list_distinct(list(trim(act_title))) AS titles, list_distinct(list(document_id)) AS ids, list_distinct(list(nullif(lower(unit_type), ''))) AS types, list_distinct(flatten(list(document_aliases))) AS names,
    bool_or(source_file <> file) AS elsewhere, bool_or(unit_id = '' AND section_id = '') AS nameless FROM au GROUP BY 1)
SELECT file, array_to_string(list_filter([CASE WHEN len(titles) <> 1 THEN 'inconsistent_title' END, CASE WHEN len(titles) = 1 AND regexp_matches(titles[1], '{metadata.TITLE_NOISE}') THEN 'title_noise' END,
  CASE WHEN len(titles) = 1 AND regexp_matches(titles[1], '{metadata.FILE_TITLE}') THEN 'file_title' END, CASE WHEN len(ids) <> 1 THEN 'inconsistent_id' END, CASE WHEN len(types) <> 1 THEN 'mixed_unit_types' END,
  CASE WHEN len(names) = 0 THEN 'no_names' END, CASE WHEN len(list_filter(names, lambda a: regexp_matches(a, '{metadata.NAME_NOISE}'))) > 0 THEN 'noisy_names' END, CASE WHEN elsewhere THEN 'other_source_file' END,
  CASE WHEN nameless THEN 'missing_unit' END], lambda x: x IS NOT NULL), '|') AS issues FROM a1
""")
def q_metadata_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of the files' chunks."""
    return metadata.metadata_issues(_audited(spark, sf_dir)).withColumn("issues", F.array_join("issues", "|"))


@query(f"""
WITH {_AUDITED}, r AS (SELECT act_title, coalesce(nullif(lower(unit_type), ''), 'unknown') AS kind, file, len(list_filter(document_aliases, lambda a: {contains_any("lower(a)", [".pdf", ".jsonl", chr(92), "/"])} OR ends_with(lower(a), '.smoke'))) > 0 AS named_by_file FROM au)
SELECT act_title, kind AS unit_type, GROUPING(act_title, kind) AS gid, count(*) AS chunks, count(DISTINCT file) AS files, count(DISTINCT kind) AS types, bool_or(named_by_file) AS named_by_file FROM r GROUP BY GROUPING SETS ((act_title, kind), (act_title), ())
""")
def q_index_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by title and unit type."""
    return metadata.index_summary(_audited(spark, sf_dir))


_SOURCES = r"""
so AS (
  SELECT 'Act ' || (doc_id // 4) || CASE doc_id % 3 WHEN 0 THEN '' ELSE ' -' END AS act_title,
    CASE doc_id % 4 WHEN 0 THEN 'Act-' || (doc_id // 4) || '_1' WHEN 1 THEN '20240101 act' || (doc_id // 4) WHEN 2 THEN 'Act ' || (doc_id // 4) || ' updated' ELSE 'act ' || (doc_id // 4) || ' (2)' END || '.pdf' AS file_name, doc_id FROM documents)"""


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = c("doc_id")
    fourth = F.floor(i / 4).cast("string")
    name = F.when(i % 4 == 0, F.concat(F.lit("Act-"), fourth, F.lit("_1"))).when(i % 4 == 1, F.concat(F.lit("20240101 act"), fourth)).when(i % 4 == 2, F.concat(F.lit("Act "), fourth, F.lit(" updated"))).otherwise(F.concat(F.lit("act "), fourth, F.lit(" (2)")))
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("Act "), fourth, F.when(i % 3 == 0, "").otherwise(" -")).alias("act_title"), F.concat(name, F.lit(".pdf")).alias("file_name"), "doc_id")


@query(rf"""
WITH {_SOURCES},
k AS (SELECT *, trim(regexp_replace(lower(act_title), '[^a-z0-9]+', ' ', 'g')) AS title_key, regexp_replace(file_name, '\.[^.]*$', '') AS stem FROM so),
ch AS (
  SELECT title_key, file_name, stem, n_files FROM (SELECT *, count(*) OVER (PARTITION BY title_key) AS n_files, row_number() OVER (PARTITION BY title_key ORDER BY CASE WHEN regexp_matches(lower(stem), '{metadata.COPY}') THEN 1 ELSE 0 END,
    CASE WHEN {contains_any("lower(stem)", metadata.OLD_VERSIONS)} THEN 1 ELSE 0 END, CASE WHEN regexp_matches(lower(stem), '^\d{{8}}') THEN 1 ELSE 0 END, length(stem), lower(file_name), file_name) AS nth FROM k) WHERE nth = 1),
done AS (SELECT title_key, stem FROM k WHERE doc_id % 9 = 0)
SELECT title_key, file_name, n_files FROM ch WHERE title_key NOT IN (SELECT title_key FROM done) AND stem NOT IN (SELECT stem FROM done)
""")
def q_files_to_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best file of each title that is not processed yet."""
    sources = _sources(spark, sf_dir)
    return metadata.to_process(sources.drop("doc_id"), sources.where("doc_id % 9 = 0").drop("doc_id"))


@query(f"""
WITH {_SECTIONS}, {_PACKED}, n AS (SELECT document_id, count(*) AS n FROM ch GROUP BY 1)
SELECT d.document_id, 'doc_' || d.document_id || '.pdf' AS source_file, coalesce(n, 0) AS chunks, CASE WHEN n > 0 THEN 'rebuilt' ELSE 'empty' END AS status, CASE WHEN n > 0 THEN '' ELSE 'no_chunks' END AS issues FROM docs d LEFT JOIN n USING (document_id)
""")
def q_rebuild_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every statute's rebuild from its pages."""
    docs = table(spark, sf_dir, "documents")
    return metadata.rebuild_report(statutes.files(docs), statutes.pages(docs), MAX_WORDS, OVERLAP).withColumn("issues", F.array_join("issues", "|"))


@query(f"""
WITH {RULES}, {CANDIDATES}, {_SET}
SELECT DISTINCT expected_doc FROM goldset WHERE expected_doc IS NOT NULL AND expected_doc NOT IN (SELECT expected_doc FROM goldset WHERE category = 'definition' AND expected_doc IS NOT NULL AND expected_doc < 'M')
""")
def q_newly_represented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acts of the gold set that a baseline (the definitions of acts before M) does not have."""
    found = written(gold.build(rules(spark, sf_dir)), "gold")
    return gold.newly_represented(found, found.where("category = 'definition' AND expected_doc < 'M'"))


@query(f"""
WITH {RULES}, {CANDIDATES}, w AS (SELECT DISTINCT source_chunk_id, trim(query) AS query FROM pos WHERE generation_method = 'direct_lookup_template')
SELECT w.query, pos.generation_method, pos.expected_unit, pos.source_chunk_id FROM w JOIN (SELECT *, row_number() OVER (PARTITION BY trim(query) ORDER BY generation_method, source_chunk_id) AS nth FROM pos) pos ON trim(pos.query) = w.query AND nth = 1 GROUP BY ALL
""")
def q_curated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates chosen by their text, each text once, with the chunk of the unit that they name."""
    every = gold.positives(gold.unit_records(rules(spark, sf_dir)))
    once = gold.once_by_text(every.withColumn("order", F.struct("generation_method", "source_chunk_id")), "order").drop("order")
    specs = every.where("generation_method = 'direct_lookup_template'").select(F.trim("query").alias("query")).distinct()
    return gold.selected(specs, once).select("query", "generation_method", "expected_unit", "source_chunk_id")


@query(f"""
WITH {RULES}, d AS (SELECT document_id, lead(document_id) OVER (ORDER BY document_id) AS following, min(document_id) OVER () AS first FROM (SELECT DISTINCT document_id FROM rules)),
u AS (SELECT document_id, unit AS unit_id, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index) AS nth FROM rules)
SELECT document_id, unit_id, coalesce(following, first) AS other FROM u JOIN d USING (document_id) WHERE nth = 2 AND coalesce(following, first) <> document_id
""")
def q_next_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second unit of each act, asked of the next act."""
    units = rules(spark, sf_dir).select("document_id", c("section_id").alias("unit_id"), c("chunk_index").alias("unit_ord"))
    return evaluation.next_documents(units).select("document_id", "unit_id", "other")


@query(f"""
WITH {RULES}
SELECT chunk_id, document_id, section_heading, section_id, chunk_subsection AS subsection_id, sha256(text) AS text_sha256, act_title, chunk_index, lower(chunk_unit_type) AS unit_type, unit AS unit_id, array_to_string(given, '|') AS names, entry_ord FROM rules
""")
def q_stored_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules written to a store that did not exist and read back, with the reader's defaults."""
    path = f"{shared_dir(spark)}/chunks-{uuid.uuid4().hex}"
    before = read_stored(spark, path)
    rows = rules(spark, sf_dir).withColumn("unit_id", F.nullif("unit_id", F.lit("")))
    write_chunks(before.unionByName(rows.select(*before.columns)), path)
    out = read_stored(spark, path)
    return out.select("chunk_id", "document_id", "section_heading", "section_id", "subsection_id", F.sha2("text", 256).alias("text_sha256"), "act_title", "chunk_index", F.lower("unit_type").alias("unit_type"), "unit_id", F.array_join("document_aliases", "|").alias("names"), "entry_ord")


@query("""
WITH p AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations),
e AS (
  SELECT conv_id, turn, 0 AS seq, 'meta' AS type, conv_id || ':' || turn AS payload FROM p
  UNION ALL SELECT conv_id, turn, i + 1, 'token', substr(text, CAST(i * 48 + 1 AS INTEGER), 48) FROM (SELECT *, unnest(range(0, CAST(ceil(length(text) / 48.0) AS BIGINT))) AS i FROM p)
  UNION ALL SELECT conv_id, turn, CAST(ceil(length(text) / 48.0) AS BIGINT) + 1, 'done', '' FROM p)
SELECT conv_id, turn, CAST(seq AS INTEGER) AS seq, type, CAST(to_json({'type': type, 'payload': payload}) AS VARCHAR) AS line FROM e
""")
def q_stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message as a sequence of events: meta, tokens, done."""
    return frames.event_lines(table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit(""))), ["conv_id", "turn"])

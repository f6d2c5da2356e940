"""Queries of ingestion, segmentation and packing over statutes made of all documents, with SQL that follows how they are made."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators import ingestion, metadata, segmentation
from lexloom.registry import query
from lexloom.sources import statutes
from lexloom.sources.tables import table

c = F.col
#: Words in a chunk and words carried over, small so that sections are packed, carried over and cut.
MAX_WORDS, OVERLAP = 40, 8

_SECTIONS = r"""
docs AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS document_id, doc_id % 5 AS kind, CASE WHEN doc_id % 5 = 2 THEN 'Perkara' ELSE 'Section' END AS label,
    list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\r\n|\n|\r'), lambda x: array_to_string(regexp_extract_all(x, '[A-Za-z]+'), ' ')), lambda x: x <> '') AS lines
  FROM documents),
sec AS (SELECT document_id, kind, label, i, lines[i] AS line, len(regexp_extract_all(lines[i], '[A-Za-z]+')) AS n FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM docs)),
u AS (
  SELECT document_id, kind, label, i, n,
    label || ' ' || i || CASE i % 4 WHEN 1 THEN ' Rules of part ' || i WHEN 3 THEN '' ELSE ' Title of ' || i END AS heading,
    CASE i % 4 WHEN 1 THEN label || ' ' || i || ' Rules of part ' || i || chr(10) || '(1) the ' || line || '.'
      WHEN 3 THEN label || ' ' || i || chr(10) || i || '. (1) the ' || line || '.'
      ELSE label || ' ' || i || ' Title of ' || i || chr(10) || i || '. the ' || line || '.' END AS first,
    CASE WHEN i % 2 = 1 THEN '1' END AS first_sub,
    CASE WHEN i % 2 = 1 THEN ['(2) the ' || n || ' words.'] ELSE ['(1) first part.', '(2) second part.'] END AS others,
    n + CASE i % 4 WHEN 1 THEN 8 WHEN 3 THEN 5 ELSE 7 END AS words
  FROM sec)
"""

_WORD = lambda c: f"upper({c}[1]) || lower(substr({c}, 2))"


@query(rf"""
WITH {_SECTIONS},
w AS (SELECT doc_id, document_id, kind, coalesce(regexp_extract(lines[1], '^[A-Za-z]+'), '') AS word FROM docs),
t AS (SELECT *, CASE WHEN word = '' THEN 'nothing' ELSE word END AS name, 'Act ' || (9000 + doc_id % 900) AS number FROM w),
m AS (
  SELECT document_id, CASE kind WHEN 1 THEN number WHEN 3 THEN 'ACT 1955' ELSE '' END AS act_number, CASE kind WHEN 2 THEN 'perkara' ELSE 'section' END AS unit_type,
    CASE kind WHEN 0 THEN 'Employment Act 1955' WHEN 1 THEN 'Records Of ' || {_WORD("name")} || ' Second Series' WHEN 2 THEN 'Rules concerning ' || name
      WHEN 3 THEN 'État Général Act 1955' ELSE 'Report ' || document_id END AS act_title,
    CASE kind WHEN 1 THEN ['Doc ' || document_id] WHEN 2 THEN ['Doc ' || document_id, 'Perlembagaan ' || document_id] WHEN 3 THEN ['Doc ' || document_id, 'Gazette ' || document_id] ELSE ['Doc ' || document_id] END AS files, kind
  FROM t)
SELECT document_id, act_title, act_number, unit_type,
  CASE WHEN kind = 0 THEN 'Employment Act 1955|Akta Kerja 1955|Act 265' ELSE array_to_string(list_sort(list_distinct(list_filter(files || [act_title, act_number], lambda x: x <> ''))), '|') END AS aliases FROM m
""")
def q_page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles, numbers, unit types and names from title pages of five kinds."""
    docs = table(spark, sf_dir, "documents")
    found = metadata.document_metadata(statutes.files(docs), statutes.pages(docs))
    return found.select("document_id", "act_title", "act_number", "unit_type", F.array_join("document_aliases", "|").alias("aliases"))


@query(rf"""
WITH {_SECTIONS},
s AS (
  SELECT document_id, i, CASE WHEN i % 4 = 1 THEN first WHEN i % 4 = 3 THEN split_part(first, chr(10), 2)
    ELSE 'Title of ' || i || chr(10) || split_part(first, chr(10), 2) END || chr(10) || array_to_string(others, chr(10)) AS body FROM u),
p AS (SELECT document_id, (i - 1) // {statutes.PER_PAGE} AS page, string_agg(body, chr(10) ORDER BY i) AS body FROM s GROUP BY 1, 2),
t AS (SELECT document_id, 'PART I' || chr(10) || 'PRELIMINARY' || chr(10) || string_agg(body, chr(10) || chr(10) ORDER BY page) AS body FROM p GROUP BY 1)
SELECT d.document_id, sha256(coalesce(t.body, '')) AS text_sha256, coalesce(length(t.body), 0) AS n_chars FROM docs d LEFT JOIN t USING (document_id)
""")
def q_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of the pages: without title, contents and note pages, running heads and feet, with the lines before the body."""
    docs = table(spark, sf_dir, "documents")
    pages = statutes.pages(docs)
    found = ingestion.normalized_text(pages, metadata.document_metadata(statutes.files(docs), pages))
    return found.select("document_id", F.sha2("text", 256).alias("text_sha256"), F.char_length("text").cast("long").alias("n_chars"))


def _statute_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = statutes.sections(table(spark, sf_dir, "documents"))
    lines = rows.withColumn("lines", statutes.section_lines(c("label"), c("i"), c("line")))
    # a number on a line of its own is joined with the next line by ingestion
    joined = F.when(c("i") % 4 == 3, F.concat(F.array(F.concat_ws(" ", c("lines")[0], c("lines")[1])), F.slice("lines", 3, 1))).otherwise(c("lines"))
    body = F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", joined.alias("lines")))), lambda x: x["lines"])), "\n")
    return lines.groupBy("document_id", "label").agg(F.concat(F.lit("Preamble.\n"), body).alias("text")).select(
        "document_id", "text", F.concat(F.lit("corpus/"), "document_id").alias("source_path"), F.when(c("label") == "Perkara", "Undang Perkara").otherwise("Records").alias("act_title")
    )


@query(f"""
WITH {_SECTIONS},
x AS (
  SELECT document_id, label, i, heading, 1 AS part, first_sub AS sub, first AS text FROM u
  UNION ALL SELECT document_id, label, i, heading, k + 1, regexp_extract(others[k], '[0-9]'), others[k] FROM (SELECT *, unnest(range(1, len(others) + 1)) AS k FROM u))
SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY i, part) AS BIGINT) AS unit_no, lower(label) AS unit_type, CAST(i AS VARCHAR) AS section_id, heading AS section_heading, sub AS subsection_id, CAST(NULL AS VARCHAR) AS paragraph_id, sha256(text) AS text_sha256 FROM x
""")
def q_statute_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of statutes: the unit type is inferred, explicit headings, title lines, subsections; lines before the first unit go."""
    units = segmentation.legal_units(_statute_texts(spark, sf_dir))
    return units.select("document_id", c("unit_no").cast("long").alias("unit_no"), "unit_type", "section_id", "section_heading", "subsection_id", "paragraph_id", F.sha2("text", 256).alias("text_sha256"))


_WINDOWS = f"list_transform(range(0, words, {MAX_WORDS - OVERLAP}), lambda k: {{'sub': first_sub, 'text': array_to_string(regexp_extract_all(first, '\\S+')[k + 1:k + {MAX_WORDS}], ' ')}})"
_ALL = "array_to_string([first] || others, chr(10))"
_PACKED = f"""
pk AS (
  SELECT *, CASE
    WHEN i % 2 = 1 AND words >= {3 * MAX_WORDS} THEN {_WINDOWS} || [{{'sub': '2', 'text': others[1]}}]
    WHEN i % 2 = 1 AND words + 4 <= {MAX_WORDS} THEN [{{'sub': CAST(NULL AS VARCHAR), 'text': {_ALL}}}]
    WHEN i % 2 = 1 THEN [{{'sub': '1', 'text': first}}, {{'sub': NULL, 'text': {_ALL}}}]
    WHEN words >= {MAX_WORDS} THEN {_WINDOWS} || [{{'sub': NULL, 'text': others[1] || chr(10) || others[2]}}]
    WHEN words + 6 <= {MAX_WORDS} THEN [{{'sub': CAST(NULL AS VARCHAR), 'text': {_ALL}}}]
    WHEN words + 3 <= {MAX_WORDS} THEN [{{'sub': CAST(NULL AS VARCHAR), 'text': first || chr(10) || others[1]}}, {{'sub': NULL, 'text': others[1] || chr(10) || others[2]}}]
    ELSE [{{'sub': CAST(NULL AS VARCHAR), 'text': first}}, {{'sub': NULL, 'text': first || chr(10) || others[1]}}, {{'sub': NULL, 'text': others[1] || chr(10) || others[2]}}] END AS packed
  FROM u),
ch AS (
  SELECT document_id, label, i, heading, packed[k].sub AS sub, packed[k].text AS text, CAST(row_number() OVER (PARTITION BY document_id ORDER BY i, k) - 1 AS INTEGER) AS chunk_index
  FROM (SELECT *, unnest(range(1, len(packed) + 1)) AS k FROM pk))
"""


@query(f"""
WITH {_SECTIONS}, {_PACKED}
SELECT document_id || ':' || i || ':' || chunk_index AS chunk_id, CAST(i AS VARCHAR) AS section_id, heading AS section_heading, sub AS subsection_id, chunk_index, lower(label) AS unit_type, sha256(text) AS text_sha256 FROM ch
""")
def q_packed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units packed into chunks: together within a section, carried over, or cut into windows."""
    chunks = segmentation.legal_chunks(_statute_texts(spark, sf_dir), MAX_WORDS, OVERLAP)
    return chunks.select("chunk_id", "section_id", "section_heading", "subsection_id", "chunk_index", "unit_type", F.sha2("text", 256).alias("text_sha256"))


@query(f"""
WITH {_SECTIONS}, {_PACKED},
names AS (
  SELECT document_id, kind, CASE kind WHEN 0 THEN 'Employment Act 1955' WHEN 1 THEN 'Records Of ' || {_WORD("regexp_extract(lines[1], '^[A-Za-z]+')")} || ' Second Series'
    WHEN 2 THEN 'Rules concerning ' || regexp_extract(lines[1], '^[A-Za-z]+') WHEN 3 THEN 'État Général Act 1955' ELSE 'Report ' || document_id END AS act_title,
    CASE kind WHEN 1 THEN 'Act ' || (9000 + doc_id % 900) WHEN 3 THEN 'ACT 1955' ELSE '' END AS act_number FROM docs)
SELECT document_id || ':' || i || ':' || chunk_index AS chunk_id, document_id, act_title, act_number, heading AS section_heading, CAST(i AS VARCHAR) AS section_id, sub AS subsection_id, CAST(NULL AS VARCHAR) AS paragraph_id,
  'doc_' || document_id || '.pdf' AS source_file, 'corpus/doc_' || document_id || '.pdf' AS source_path, chunk_index, lower(label) AS unit_type, CAST(i AS VARCHAR) AS unit_id,
  CAST(CASE kind WHEN 0 THEN 3 WHEN 1 THEN 3 WHEN 2 THEN 3 WHEN 3 THEN 4 ELSE 2 END AS INTEGER) AS n_aliases, sha256(text) AS text_sha256
FROM ch JOIN names USING (document_id)
""")
def q_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to exported chunks, end to end."""
    docs = table(spark, sf_dir, "documents")
    out = metadata.ingest(statutes.files(docs), statutes.pages(docs), MAX_WORDS, OVERLAP)
    return out.withColumns({"n_aliases": F.size("document_aliases"), "text_sha256": F.sha2("text", 256)}).drop("document_aliases", "text")


@query(f"""
WITH {_SECTIONS}
SELECT document_id || ':' || i AS chunk_id, document_id, lower(label) AS leaked_type, CAST(i + 1 AS VARCHAR) AS leaked_id,
  CASE (i + 1) % 4 WHEN 1 THEN label || ' ' || (i + 1) || ' Rules of part ' || (i + 1) WHEN 3 THEN (i + 1) || '. alone' ELSE (i + 1) || '. titled' END AS line
FROM u WHERE i % 3 = 0
""")
def q_boundary_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of one section each; every third one goes on into the next section, twice, and names an article, which is no leak."""
    rows = statutes.sections(table(spark, sf_dir, "documents"))
    following, number = (c("i") + 1).cast("string"), c("i").cast("string")
    own = F.concat_ws("\n", F.concat_ws(" ", "label", number), F.concat(F.lit("the "), "line", F.lit(".")))
    leak = F.when((c("i") + 1) % 4 == 1, F.concat(c("label"), F.lit(" "), following, F.lit(" Rules of part "), following)).when((c("i") + 1) % 4 == 3, F.concat(following, F.lit(". alone"))).otherwise(F.concat(following, F.lit(". titled")))
    text = F.when(c("i") % 3 == 0, F.concat_ws("\n", own, leak, F.concat(following, F.lit(". again")), F.lit("Article 7 of another"))).otherwise(own)
    chunks = rows.select(F.concat_ws(":", "document_id", number).alias("chunk_id"), "document_id", F.lower("label").alias("unit_type"), number.alias("unit_id"), number.alias("section_id"), text.alias("text"))
    return segmentation.boundary_leaks(chunks)


_TYPED = "CASE i % 3 WHEN 0 THEN 'Section' WHEN 1 THEN 'Article' ELSE 'Perkara' END"


@query(f"""
WITH {_SECTIONS},
s AS (SELECT document_id || '/' || i AS document_id, {_TYPED} AS kind, i, n + 8 AS words, {_TYPED} || ' ' || i || ' Rules of part ' || i AS heading, {_TYPED} || ' ' || i || ' Rules of part ' || i || chr(10) || '(1) the ' || line || '.' AS text FROM sec),
p AS (SELECT *, CASE WHEN words >= {3 * MAX_WORDS} THEN list_transform(range(0, words, {MAX_WORDS - OVERLAP}), lambda k: array_to_string(regexp_extract_all(text, '\\S+')[k + 1:k + {MAX_WORDS}], ' ')) ELSE [text] END AS packed FROM s)
SELECT document_id || ':' || i || ':' || (k - 1) AS chunk_id, lower(kind) AS unit_type, heading AS section_heading, '1' AS subsection_id, sha256(packed[k]) AS text_sha256 FROM (SELECT *, unnest(range(1, len(packed) + 1)) AS k FROM p)
""")
def q_section_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single sections with headings of three unit types, chunked each for itself; those without text give nothing."""
    rows = statutes.sections(table(spark, sf_dir, "documents"))
    number = c("i").cast("string")
    kind = F.when(c("i") % 3 == 0, "Section").when(c("i") % 3 == 1, "Article").otherwise("Perkara")
    named = rows.select(F.concat_ws("/", "document_id", number).alias("document_id"), F.concat(F.lit(" "), kind, F.lit(" "), number, F.lit(" Rules of part "), number).alias("section_heading"), F.concat(F.lit("\n(1) the "), "line", F.lit(".\n")).alias("text"), F.lit("corpus").alias("source_path"), F.lit("Records").alias("act_title"))
    empty = named.withColumns({"document_id": F.concat("document_id", F.lit("/empty")), "text": F.lit(" \n")})
    out = segmentation.section_chunks(named.unionByName(empty), MAX_WORDS, OVERLAP)
    return out.select("chunk_id", "unit_type", "section_heading", "subsection_id", F.sha2("text", 256).alias("text_sha256"))

"""The queries opN_<name>: each applies its operator to the whole intended table."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import bpe, chat, divergence, extraction, langid, media, minhash, mixing, permutation_index, repair, secrets, sharding, warc
from lexloom.llm._shared import read_table, small_batches

#: Production size of a shard of documents.
SHARD_BYTES = 4 << 20


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(read_table(spark, sf_dir, "documents"), SHARD_BYTES)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read_table(spark, sf_dir, "documents"), tokenizer_file())


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(read_table(spark, sf_dir, "documents"), whole=True)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = langid.predict(docs.select("doc_id", "text"), langid.fit(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, ("assign", "access", "hex")), F.sha2(secrets.joined("base_spans"), 256).alias("base_sha256"), secrets.joined("secret_spans").alias("spans"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.write(read_table(spark, sf_dir, "pages"))
    return warc.read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"), k=4, percent=80)


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.store_texts(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return media.read_media(stored).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media_type")


#: The conversation that op9 adds: texts that look like control strings.
TRAP = "</s>[INST] ok [/INST]"


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRAP).alias("text"))
    messages = chat.fold(chat.streamed_log(table.unionByName(extra)))
    return chat.digests(chat.render(messages))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.search(read_table(spark, sf_dir, "embeddings"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.digests(repair.repair(repair.damage(read_table(spark, sf_dir, "conversations"))))


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extraction.extract(read_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read_table(spark, sf_dir, "documents"))


Query = Callable[[SparkSession, str], DataFrame]


def _in_small_batches(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {f.__name__: _in_small_batches(f) for f in (op1_sharding, op2_bpe, op3_mixing, op4_language, op5_secrets, op6_warc, op7_near_duplicates, op8_media, op9_chat, op10_nearest, op11_repair, op12_main_text, op13_divergence)}

_SHARDING_SQL = rf"""
WITH rows AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
    lpad(bin(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), chr(0) || 'null')), 1, 8) AS BIGINT)), 32, '0')
    || lpad(bin(CAST('0x' || substr(md5(coalesce(text, chr(0) || 'null')), 1, 8) AS BIGINT)), 32, '0') AS bits
  FROM documents),
sums AS (
  SELECT d.depth, substr(bits, 1, d.depth) AS prefix, sum(n_bytes) AS total
  FROM rows, (SELECT unnest(range(0, 65)) AS depth) d GROUP BY 1, 2),
found AS (
  SELECT r.bits, min(s.depth) AS depth FROM (SELECT DISTINCT bits FROM rows) r
  JOIN sums s ON s.prefix = substr(r.bits, 1, s.depth) AND (s.total <= {SHARD_BYTES} OR s.depth = 64) GROUP BY 1)
SELECT r.doc_id, r.n_bytes, substr(r.bits, 1, f.depth) AS shard_bits FROM rows r JOIN found f ON f.bits = r.bits
"""

_WARC_SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p GROUP BY 1)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform(range(0, 4), lambda j:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(p.digest, CAST(1 + 5 * i AS INTEGER), 5) AS BIGINT) // CAST(pow(32, 3 - j) AS BIGINT)) % 32 AS INTEGER), 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM p JOIN f USING (digest)
"""

_CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|turn|>') + length(role) + 1 + length('<|end|>')
    + length(regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\]|<SYS>>|</SYS>>)', '\1\\\2\3', 'g'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

_NEAREST_SQL = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

#: Shared words make the pairs, so the text's own words are compared exactly; groups are found by repeated steps to smaller ids.
_NEAR_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 3], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * n_both >= 80 * (x.n + y.n - n_both)),
reach AS (
  SELECT doc_id, doc_id AS other FROM w
  UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON l.a = r.other)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1) c USING (doc_id)
"""

#: DuckDB has no crc32, so it is worked out by bits. The cheapest edits are found by a fold over (cost, audit, text written) for each last role.
_REPAIR_SQL = r"""
WITH named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS label FROM conversations),
kinds AS (
  SELECT *, xor(list_reduce(list_transform(string_split(label, ''), lambda ch: CAST(ascii(ch) AS BIGINT)),
      lambda crc, b: list_reduce(range(0, 8), lambda r, bit: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, xor(crc, b)),
    CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS kind FROM named),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(0, CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS again
  FROM kinds WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, again) AS seen FROM damaged),
flagged AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
    lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
folded AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal,
    list_reduce(list({'role': role, 'text': text, 'must': fault IN ('blank', 'duplicate'), 'add': CASE fault WHEN 'truncated' THEN 1 ELSE 0 END} ORDER BY i),
      lambda w, t: list_transform([least(w.u, STEP(w.e, 2, 'I', 'user:'), STEP(w.s, 2, 'I', 'user:'), STEP(w.a, 2, 'I', 'user:'))],
        lambda u: list_transform([least(w.a, STEP(u, 2, 'I', 'assistant:'))],
          lambda a: {
            'e': STEP(w.e, 3, 'D', NULL),
            's': least(STEP(w.s, 3, 'D', NULL), TURN(w.e, 's', 900000, t.role)),
            'u': least(STEP(u, 3, 'D', NULL), TURN(w.e, 'u', 2, 'user'), TURN(w.s, 'u', 2, 'user'), TURN(a, 'u', 2, 'user')),
            'a': least(STEP(a, 3, 'D', NULL), TURN(u, 'a', 2, 'assistant'))})[1])[1],
      {'e': FIRST(0), 's': FIRST(900000), 'u': FIRST(900000), 'a': FIRST(900000)}) AS w
  FROM flagged GROUP BY conv_id),
best AS (
  SELECT *, least(w.e, w.a, STEP(w.u, 2, 'I', 'assistant:'), STEP(STEP(w.e, 2, 'I', 'user:'), 2, 'I', 'assistant:'), STEP(STEP(w.s, 2, 'I', 'user:'), 2, 'I', 'assistant:')) AS b FROM folded)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(coalesce(b.c, 0) AS BIGINT) AS cost, coalesce(b.t, '') AS audit, sha256(coalesce(substr(b.o, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id
"""


def _repair_sql() -> str:
    """_REPAIR_SQL with its steps written out: FIRST(cost), STEP(way, cost, letter, line) and TURN(way, initial, cost of another role, role)."""
    first = re.sub(r"FIRST\((\d+)\)", r"{'c': CAST(\1 AS BIGINT), 't': '', 'o': ''}", _REPAIR_SQL)
    step = lambda way, cost, letter, line: f"{{'c': {way}.c + {cost}, 't': {way}.t || {letter}, 'o': {way}.o || coalesce(chr(10) || {line}, '')}}"

    def turn(m: re.Match) -> str:
        way, initial, other, role = m.groups()
        same = f"left(t.role, 1) = {initial}"
        return step(way, f"CASE WHEN t.must THEN 900000 WHEN {same} THEN t.add ELSE t.add + {other} END", f"CASE WHEN {same} THEN 'K' ELSE 'R' END", f"(CASE WHEN {same} THEN t.role ELSE {role} END || ':' || t.text)")

    sql = re.sub(r"TURN\(([^,]+), ([^,]+), ([^,]+), ([^)]+)\)", turn, first)
    while "STEP(" in sql:
        sql = re.sub(r"STEP\(((?:\w|\.)+|\{[^{}]*\}), ([^,]+), ([^,]+), ([^)]+)\)", lambda m: step(*m.groups()), sql)
    return sql


_DIVERGENCE_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda t: t <> '') AS terms
  FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
many AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(terms)) AS term FROM d) GROUP BY 1, 2 HAVING count(*) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(terms) AS term FROM d) SEMI JOIN many USING (lang, term) GROUP BY 1, 2, 3),
v AS (SELECT lang, count(*) AS v FROM many GROUP BY 1),
total AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
p AS (
  SELECT g.lang, g.source, m.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 5)::HUGEINT) // (t.total + 5 * v.v)::HUGEINT AS p
  FROM g JOIN many m USING (lang) JOIN v USING (lang) JOIN total t USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = m.term),
q AS (
  SELECT lang, term, 1 + (1000000000 * (n + 5)::HUGEINT) // (sum(n) OVER (PARTITION BY lang) + 5 * v)::HUGEINT AS q
  FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY 1, 2) JOIN v USING (lang)),
far AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3
  UNION ALL SELECT a.lang, a.source, b.source, 0 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source WHERE a.lang NOT IN (SELECT lang FROM v)),
near AS (SELECT lang, source, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (
  SELECT 'pair' AS part, *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM far
  UNION ALL SELECT 'term', *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM near)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""


ORACLES = {
    "op1_sharding": _SHARDING_SQL,
    "op6_warc": _WARC_SQL,
    "op7_near_duplicates": _NEAR_SQL,
    "op9_chat": _CHAT_SQL,
    "op10_nearest": _NEAREST_SQL,
    "op11_repair": _repair_sql(),
    "op13_divergence": _DIVERGENCE_SQL,
}

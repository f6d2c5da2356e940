"""Hints of stated questions, and every score of a chunk for a question, over rules made of all documents; with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import fixed_values as V
from lexloom.plans import features as R
from lexloom.plans.query_context import contexts
from lexloom.registry import query
from lexloom.sources.tables import table
from lexloom.sql_text import ALL_TOKENS, DOCUMENT_TOKENS, NORMAL, TOKENS, contains_any, first_rule, one_of, points, quoted

c = F.col
#: The stated questions.
ASKED = [
    "What is the definition of wages in Part II of the Records Act src3?",
    "section 2(1) of the Records Act src3",
    "What must an employer do under the Employment Act about duties?",
    "who may appeal under the Records Act of src2",
    "What should I check before signing an employment contract under Akta Kerja?",
    "Which section of the minimum wages order deals with rates in february?",
    "What does the amendment act A1727 introduce: data portability, new section 12?",
    "which exclusions does p.u. (a) order apply",
    "when does the act come into force, citation and commencement",
    "is the order revoked and who may claim under it",
    "acceptance must be absolute under the contracts act",
    "apakah tafsiran perkara 5 dalam bahagian II",
    "annual leave for foreign employees of src1",
    "the and of",
    "where does Chapter 3 begin",
    "What does section 12 say about the principal act and subsection (2a)?",
    "What does Part II cover about interpretation of terms?",
    "Which unit begins Chapter 3 of the Employment Act 1955?",
    "Which provision amends section 12 of the principal act?",
    "What new section 12 is introduced by Act A1727?",
    "general amendment of the principal act under the PDPA Amendment Act 2024",
    "when does the amendment come into force or commencement under Act A1727",
    "Which provisions refer to section 6?",
    "What is referred to under section 9 of the Minimum Wages Order 2024",
    "",
]
ACTS = ["Employment Act 1955", "Records Act (src3) 1960", "Personal Data Protection (Amendment) Act 2024", "Minimum Wages Order 2024", "Contracts Act 1950", "Undang-undang Perlembagaan", "Personal Data Protection Act 2010"]
NAMES = [["Akta Kerja 1955"], [], ["Act A1727", "PDPA Amendment Act 2024"], ["P.U. (A) 376"], ["Act 136"], [], []]
TYPES = ["section", "section", "section", "section", "section", "perkara", "Article"]
HEADINGS = [
    "Interpretation", "Short title and commencement", "General duties of employers", "Duty of employee", "Right of appeal", "Appeals", "Rates of wages with effect from February",
    "Non-application", "Revocation", "Amendment of section 12", "New section 12: data portability", "General amendment", "Acceptance must be absolute", "Application of other written law",
    "Annual leave and holidays", "Annual leave", "Contracts to be in writing", "Termination and notice of termination", "Foreign employee", "Interpretation of Part II", "Tafsiran Bahagian II",
    "Citation and commencement", "Employment", "Obligation of licensee", "General obligation", "",
]
TEXTS = [
    "An employer shall pay wages and must keep records; section 5 and section 6 apply.",
    "PART II\nIn this Part interpretation of terms is as follows.",
    "The principal act is amended by inserting after section 12 the new section 12A on data portability.",
    "This order does not apply to a foreign domestic employee. The order of 2020 is revoked.",
    "A person may appeal within 14 days.",
    "Chapter 3.\nCommencement: it comes into operation in february.",
    "The contract of service, sick leave and hours of work under section 9, section 10 and article 3.",
    "Acceptance must be absolute; acceptance applies in Part II.",
]


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk for every document: one of ACTS, HEADINGS and TEXTS by its number, then its whole text."""
    docs = table(spark, sf_dir, "documents")
    pick = lambda values, place: F.element_at(F.array(*(F.array(*map(F.lit, v)).cast("array<string>") if isinstance(v, list) else F.lit(v) for v in values)), (F.pmod(place, F.lit(len(values))) + 1).cast("int"))
    i = c("doc_id")
    seventh, third = F.floor(i / 7), F.floor(i / 3)
    number = (seventh + 1).cast("string")
    heading = F.concat(F.lit("Section "), number, F.lit(" "), pick(HEADINGS, seventh))
    text = F.concat(F.when(i % 3 == 0, F.concat(heading, F.lit("\n"))).otherwise(""), pick(TEXTS, third), F.lit("\n"), F.coalesce("text", F.lit("")), F.when(i % 11 == 0, "\nPART II").otherwise(""))
    act = F.pmod(i, F.lit(7)).cast("string")
    return docs.select(
        i.cast("string").alias("chunk_id"),
        F.concat(F.lit("act"), act).alias("document_id"),
        heading.alias("section_heading"),
        number.alias("section_id"),
        F.when(i % 4 == 1, "1").when(i % 4 == 2, "2a").alias("subsection_id"),
        F.lit(None).cast("string").alias("paragraph_id"),
        text.alias("text"),
        F.concat(F.lit("corpus/act"), act, F.lit(".pdf")).alias("source_path"),
        pick(ACTS, i).alias("act_title"),
        F.lit("").alias("act_number"),
        F.concat(F.lit("act"), act, F.lit(".pdf")).alias("source_file"),
        seventh.cast("int").alias("chunk_index"),
        pick(TYPES, i).alias("unit_type"),
        F.when(i % 5 == 0, "").otherwise(number).alias("unit_id"),
        pick(NAMES, i).alias("document_aliases"),
        F.lit(None).cast("array<double>").alias("embedding"),
        i.alias("entry_ord"),
    )


def _asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(ASKED)), "query_id long, query string")


_pick = lambda values, place: f"([{', '.join('[' + ', '.join(map(quoted, v)) + ']::VARCHAR[]' if isinstance(v, list) else quoted(v) for v in values)}])[CAST({place} % {len(values)} AS INTEGER) + 1]"
RULES = rf"""
r0 AS (SELECT doc_id, coalesce(text, '') AS body, doc_id // 7 AS seventh, doc_id // 3 AS third, CAST(doc_id // 7 + 1 AS VARCHAR) AS section_id FROM documents),
r1 AS (SELECT *, 'Section ' || section_id || ' ' || {_pick(HEADINGS, "seventh")} AS section_heading FROM r0),
rules AS (
  SELECT CAST(doc_id AS VARCHAR) AS chunk_id, 'act' || (doc_id % 7) AS document_id, section_heading, section_id, CASE doc_id % 4 WHEN 1 THEN '1' WHEN 2 THEN '2a' END AS chunk_subsection,
    CASE WHEN doc_id % 3 = 0 THEN section_heading || chr(10) ELSE '' END || {_pick(TEXTS, "third")} || chr(10) || body || CASE WHEN doc_id % 11 = 0 THEN chr(10) || 'PART II' ELSE '' END AS text,
    {_pick(ACTS, "doc_id")} AS act_title, CAST(seventh AS INTEGER) AS chunk_index, {_pick(TYPES, "doc_id")} AS chunk_unit_type, section_id AS unit,
    {_pick(NAMES, "doc_id")} AS given, doc_id AS entry_ord FROM r1)
"""
_lists = lambda name, *words: f"list_has_any({name}, {one_of(words)})"
_every = lambda name, *words: f"list_has_all({name}, {one_of(words)})"
_word = lambda name, w: f"list_contains({name}, '{w}')"
_agree = f"(({contains_any('{0}', V.AGREEMENT_CORE_CUES)} AND {contains_any('{0}', V.AGREEMENT_ADVICE_CUES)}) OR (contains({{0}}, 'employment') AND {contains_any('{0}', ['agreement', 'contract'])} AND {contains_any('{0}', V.AGREEMENT_WORDS)}))"
_order = f"({_lists('own', 'order', 'pua')} OR {_every('own', 'minimum', 'wage')})"
_expand = [
    (_word("own", "appeal"), ["appeal", "right"]),
    (f"({_word('own', 'apply')} OR {_every('own', 'personal', 'commercial')})", ["apply", "scope"]),
    (_lists("own", "define", "interpret"), ["define", "interpret"]),
    (_word("own", "require"), ["require"]),
    (_lists("own", "obligation", "must"), ["shall", "must", "required", "duty", "duties", "obligation"]),
    (f"(({_word('own', 'commercial')} AND {_lists('own', 'urus', 'niaga')}) OR {_word('own', 'transactions')})", ["commercial", "transactions", "transaction", "apply", "scope"]),
    (f"({_every('own', 'data', 'pemindahan')} OR contains(surface, 'data portability'))", ["data", "portability", "introduce", "new", "section", "right"]),
    (_lists("own", "amendment", "principal"), ["amendment", "principal", "act"]),
    (_word("own", "commencement"), ["commencement", "operation"]),
    (_order, ["order", "minimum", "wage"]),
    (f"({_order} AND {_word('own', 'exclude')})", ["non", "application"]),
    (f"({_order} AND {_word('own', 'apply')} AND {_lists('own', *V.MONTHS)})", ["effect", "rate", "wage", "minimum"]),
    (_agree.format("surface"), V.AGREEMENT_EXPANSION),
]
_surface = "lower(regexp_replace(raw, '" + V.PUA + "', ' pua order ', 'g'))"
for _from, _to in V.SURFACE_REPLACEMENTS:
    _surface = f"replace({_surface}, {quoted(_from)}, {quoted(_to)})"
_found = lambda pattern, group: f"nullif(regexp_extract(surface, '{pattern}', {group}), '')"
_definition = contains_any("lowered", V.DEFINITION_CUES)
_rate_words = _lists("tokens", "rate", "wage", "minimum")
CONTEXTS = rf"""
c0 AS (SELECT * FROM (VALUES {", ".join(f"(CAST({i} AS BIGINT), {quoted(q)})" for i, q in enumerate(ASKED))}) AS t(query_id, raw)),
c1 AS (SELECT *, lower(raw) AS lowered, {_surface} AS surface FROM c0 WHERE trim(raw) <> ''),
c2 AS (SELECT *, array_to_string({ALL_TOKENS.format("surface")}, ' ') AS normalized, {TOKENS.format("surface")} AS own FROM c1),
c3 AS (SELECT *, list_transform({" || ".join(f"CASE WHEN {rule} THEN {one_of(words)} ELSE [] END" for rule, words in _expand)}, lambda t: {NORMAL}) AS more FROM c2),
c4 AS (
  SELECT *, own || list_distinct(list_filter(more, lambda x: NOT list_contains(own, x))) AS tokens, replace(normalized, ' ', '') AS compact,
    lower({_found(V.UNIT_QUERY, 1)}) AS unit_type, upper({_found(V.UNIT_QUERY, 2)}) AS unit_id, upper(coalesce({_found(V.SUBSECTION_QUERY, 1)}, {_found(V.SUBSECTION_QUERY, 2)})) AS subsection_id,
    lower({_found(V.HIERARCHY_QUERY, 1)}) AS hierarchy_label, upper({_found(V.HIERARCHY_QUERY, 2)}) AS hierarchy_id, {_definition} AS definition, {contains_any("lowered", V.STRICT_DEFINITION_CUES)} AS strict_definition,
    ({contains_any("lowered", V.OBLIGATION_CUES)} AND {contains_any("lowered", V.OBLIGATION_WORDS)}) OR {contains_any("lowered", V.OBLIGATION_PADDED)} AS obligation,
    {_agree.format("lowered")} AS agreement, {contains_any("lowered", V.CAPABILITY_CUES)} AS capability, {contains_any("lowered", V.LEGAL_ACTION_CUES)} AND {contains_any("lowered", V.LEGAL_ACTION_WORDS)} AS legal_action,
    {contains_any("lowered", V.HEADING_LOOKUP_CUES)} AS heading_lookup, {contains_any("lowered", V.AMENDMENT_CUES)} AS amendment, {contains_any("' ' || lowered || ' '", V.DOCUMENT_HINT_CUES)} AS document_hint,
    {contains_any("lowered", V.BEGIN_CUES)} AS begins FROM c3),
c5 AS (
  SELECT *, hierarchy_id IS NOT NULL AS hierarchy, unit_id IS NOT NULL AS has_unit, {_lists("tokens", "order", "pua")} OR contains(lowered, 'p.u.') OR {_every("tokens", "minimum", "wage")} AS gazette,
    list_filter([CASE WHEN contains(normalized, 'annual leave') OR contains(lowered, 'cuti tahunan') THEN 'annual leave' END, CASE WHEN {contains_any("lowered", ["revoc", "revok"])} THEN 'revocation' END,
      CASE WHEN {contains_any("lowered", ["come into force", "comes into force", "comes into operation", "commencement", "dikuatkuasa"])} THEN 'commencement' END, CASE WHEN {_word("tokens", "appeal")} THEN 'appeal' END,
      CASE WHEN {_word("tokens", "apply")} AND NOT {_word("tokens", "exclude")} THEN 'application' END, CASE WHEN definition THEN 'interpretation' END,
      CASE WHEN contains(lowered, 'introduc') OR contains(normalized, 'data portability') OR contains(lowered, 'pemindahan data') THEN 'introduction' END], lambda x: x IS NOT NULL) AS intents,
    strict_definition OR amendment OR heading_lookup AS refine_headings FROM c4),
ctx AS MATERIALIZED (
  SELECT *, has_unit AND NOT (amendment AND {contains_any("lowered", V.WHICH_UNIT_CUES)}) AS exact_lookup,
    CASE WHEN has_unit THEN false WHEN hierarchy AND NOT strict_definition THEN false ELSE strict_definition OR amendment OR (heading_lookup AND (document_hint OR gazette)) OR {contains_any("lowered", V.RERANK_CUES)}
      OR (obligation AND document_hint) OR (capability AND (document_hint OR legal_action)) OR (legal_action AND document_hint) END AS apply_rerank FROM c5)
"""


@query(f"""
WITH {CONTEXTS}
SELECT query_id, surface, normalized, compact, array_to_string(list_sort(tokens), ' ') AS tokens, unit_type, unit_id, subsection_id, hierarchy_label, hierarchy_id, definition, strict_definition, obligation, agreement, capability,
  legal_action, heading_lookup, amendment, document_hint, begins, hierarchy, has_unit, gazette, array_to_string(intents, '|') AS intents, refine_headings, exact_lookup, apply_rerank FROM ctx
""")
def q_question_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that stated questions ask for."""
    found = contexts(_asked(spark)).withColumnRenamed("begin", "begins")
    return found.withColumns({"tokens": F.array_join(F.array_sort("tokens"), " "), "intents": F.array_join("intents", "|")}).drop("raw", "lowered", "asked")


_defining = contains_any("heading_lower", V.DEFINITION_HEADINGS)
_variants = "CASE WHEN len(list_filter(regexp_extract_all(a, '[A-Za-z0-9]+'), lambda t: regexp_full_match(t, '[A-Za-z]+'))) >= 2 THEN [trim(a), trim(trim(regexp_replace(a, '" + V.PARENTHETICAL + "', '', 'g'), ' -_')), array_to_string(list_filter(regexp_extract_all(regexp_replace(a, '" + V.PARENTHETICAL + "', '', 'g'), '[A-Za-z0-9]+'), lambda t: NOT regexp_full_match(t, '[0-9]+')), ' ')] ELSE [] END"
_initials = lambda words: f"array_to_string(list_transform({words}, lambda t: t[1]), '')"
_line_list = r"list_filter(list_transform(regexp_split_to_array(text, '\r\n|\n|\r'), lambda x: trim(x, ' ' || chr(9))), lambda x: x <> '')"
PREPARED = rf"""
a0 AS (SELECT DISTINCT document_id, act_title, given FROM rules),
a1 AS (SELECT document_id, act_title, [act_title, document_id, document_id || '.pdf', document_id] || given AS plain FROM a0),
acts AS (
  SELECT document_id, list_filter(list_distinct(plain || flatten(list_transform(plain, lambda a: {_variants})) || [{_initials(DOCUMENT_TOKENS.format("act_title"))}]), lambda a: a <> '') AS names,
    {_initials("list_filter(" + DOCUMENT_TOKENS.format("act_title") + ", lambda t: regexp_full_match(t, '[a-z]+'))")} AS title_short FROM a1),
p0 AS (
  SELECT rules.*, names, title_short, lower(section_heading) AS heading_lower, lower(text) AS text_lower, list_distinct({TOKENS.format("section_heading")}) AS heading_words, list_distinct({TOKENS.format("text")}) AS text_words,
    list_distinct(regexp_extract_all(lower(section_heading), '[a-z0-9]+')) AS heading_raw, trim(array_to_string({ALL_TOKENS.format("regexp_replace(trim(section_heading), '" + V.HEADING_PREFIX + "', '')")}, ' ')) AS core,
    array_to_string({ALL_TOKENS.format("substr(text, 1, 500)")}, ' ') AS opening, array_to_string({ALL_TOKENS.format("substr(text, 1, 400)")}, ' ') AS opening_400, {_line_list} AS lines,
    len(regexp_extract_all(text, '{V.CROSS_REFERENCE}')) AS refs, len(regexp_extract_all(text, '{V.OBLIGATION_TEXT}')) AS obligations, greatest(1, len(regexp_extract_all(text, '\S+'))) AS n_words,
    CAST(unit AS BIGINT) AS number FROM rules JOIN acts USING (document_id)),
prep AS MATERIALIZED (
  SELECT *, list_transform(list_filter(lines, lambda x: regexp_matches(x, '{V.HIERARCHY_LINE}')), lambda x: lower(regexp_extract(x, '{V.HIERARCHY_LINE}', 1)) || ':' || upper(regexp_extract(x, '{V.HIERARCHY_LINE}', 2))) AS markers,
    CASE WHEN chunk_index <= 25 THEN 1.0 WHEN chunk_index <= 75 THEN 0.5 WHEN chunk_index <= 150 THEN 0.15 ELSE 0 END AS position_bonus,
    CASE WHEN refs <= 1 THEN 0 ELSE least(1.0, refs / n_words * 40.0) END AS xref_penalty,
    len(list_filter(lines[-4:], lambda x: regexp_matches(x, '{V.HIERARCHY_LINE}'))) > 0 AS marked_tail, len(lines) <= 6 AND len(list_filter(lines[-3:], lambda x: regexp_matches(x, '{V.HIERARCHY_LINE}'))) > 0 AS compact_tail,
    starts_with(lower(ltrim(text, ' ' || chr(10))), lower(trim(section_heading))) AS starts_with_heading FROM p0)
"""


@query(f"""
WITH {RULES}, {PREPARED}
SELECT chunk_id, len(heading_words) AS n_heading, len(text_words) AS n_text, core, sha256(opening) AS opening, sha256(opening_400) AS opening_400, array_to_string(markers, '|') AS markers, unit, number,
  array_to_string(list_sort(names), '|') AS names, title_short, refs, obligations, n_words, CAST(position_bonus AS DOUBLE) AS position_bonus, round(CAST(xref_penalty AS DOUBLE), 9) AS xref_penalty, marked_tail, compact_tail, starts_with_heading FROM prep
""")
def q_prepared_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What scoring needs of a chunk alone."""
    source = rules(spark, sf_dir)
    p = R.prepare(source)
    named = source.select("chunk_id", F.array_join(F.array_sort(R.aliases()), "|").alias("aliases"))
    size = lambda name: F.size(name).cast("long")
    return p.join(named, "chunk_id").select(
        "chunk_id", size("heading_words").alias("n_heading"), size("text_words").alias("n_text"), "core", F.sha2("opening", 256).alias("opening"), F.sha2("opening_400", 256).alias("opening_400"),
        F.array_join(F.transform("markers", lambda m: F.concat_ws(":", m["label"], m["id"])), "|").alias("markers"), "unit", "number", c("aliases").alias("names"), "title_short", c("references").cast("long").alias("refs"),
        c("obligations").cast("long").alias("obligations"), c("n_words").cast("long").alias("n_words"), "position_bonus", F.round("xref_penalty", 9).alias("xref_penalty"), "marked_tail", "compact_tail", "starts_with_heading",
    )


_share = lambda words: f"(len(list_filter(tokens, lambda t: list_contains({words}, t))) / len(tokens))"
_normal_of = "array_to_string(" + ALL_TOKENS.format("a") + ", ' ')"
_doc_words = "list_distinct(" + DOCUMENT_TOKENS.format("a") + ")"
_document = f"""CASE WHEN normalized = '' THEN 0 ELSE coalesce(list_max(list_transform(names, lambda a: CASE
    WHEN len({_doc_words}) > 0 AND list_has_all(tokens, {_doc_words}) THEN 1.0 WHEN {_normal_of} <> '' AND (contains(normalized, {_normal_of}) OR contains(compact, replace({_normal_of}, ' ', ''))) THEN 1.0
    WHEN len({_doc_words}) > 0 THEN len(list_intersect({_doc_words}, list_distinct(tokens))) / len({_doc_words}) ELSE 0.0 END)), 0) END"""
_marked = "coalesce(list_contains(markers, hierarchy_label || ':' || hierarchy_id), false)"
_employer = _lists("heading_raw", "employer", "employers")
_has = contains_any


def _agreement() -> str:
    rules_ = [points(("contains(lower(act_title), 'employment act')", 0.25), ("heading_lower IN ('section 9 employment', 'section 95 employment')", -0.9))]
    rules_ += [first_rule((f"contains(heading_lower, '{t}')", w), (f"contains(text_lower, '{t}')", w * 0.35)) for t, w in V.AGREEMENT_WEIGHTS.items()]
    narrow = " + ".join(first_rule((f"contains(heading_lower, '{t}')", -a), (f"contains(text_lower, '{t}')", -b)) for t, (a, b) in V.AGREEMENT_PENALTIES.items())
    return f"CASE WHEN agreement THEN {' + '.join(rules_)} + CASE WHEN {_word('tokens', 'foreign')} THEN 0 ELSE {narrow} END ELSE 0 END"


_id_named = "(contains(opening, lower(hierarchy_id)) OR contains(core, lower(hierarchy_id)))"


def _alignment() -> str:
    more = {
        "commencement": first_rule((_has("core", ["short title and commencement", "citation and commencement"]), 1.2), ("contains(core, 'general amendment')", -1.0)),
        "application": first_rule(("core = 'application'", 1.2), ("contains(core, 'application of')", -0.4)),
        "appeal": points(("core IN ('appeal', 'appeals')", 0.9)),
        "annual leave": points(("core = 'annual leave'", 1.0)),
        "revocation": points(("core = 'revocation'", 1.0)),
        "interpretation": points((_has("core", ["interpretation", "tafsiran"]), 0.8), (_id_named, 0.8)),
        "introduction": points(("contains(core, 'new section')", 1.2), ("contains(core, 'data portability') OR contains(opening, 'data portability')", 1.0), ("contains(core, 'general amendment')", -1.1)),
    }
    parts = []
    for intent, words in V.INTENT_SYNONYMS.items():
        starts = " OR ".join(f"starts_with(core, '{w} ')" for w in words)
        parts.append(f"CASE WHEN {_word('intents', intent)} THEN {first_rule((f'list_contains({one_of(words)}, core)', 3.2), (starts, 2.2), (_has('core', words), 1.2), (_has('opening', words), 0.4))} + {more[intent]} ELSE 0 END")
    return f"CASE WHEN core = '' THEN 0 ELSE {' + '.join(parts)} END"


_core_words = "len(list_filter(" + ALL_TOKENS.format("core") + ", lambda t: NOT list_contains(" + one_of(V.QUERY_STOPWORDS) + ", t)))"
_specificity = f"""CASE WHEN len(intents) = 0 OR {_core_words} = 0 THEN 0 ELSE
  CASE WHEN {_lists("intents", "appeal", "application", "revocation", "annual leave")} THEN CASE WHEN {_core_words} <= 2 THEN 0.9 WHEN {_core_words} <= 4 THEN 0.35 ELSE -0.25 END + {points((_has("core", [" and ", " overtime", " holiday", " sick leave", "other written law"]), -0.6))} ELSE 0 END
  + CASE WHEN {_word("intents", "commencement")} THEN {points((_has("core", ["short title and commencement", "citation and commencement"]), 0.8), (f"{_core_words} > 4", -0.2))} ELSE 0 END
  + {points((_word("intents", "introduction") + " AND contains(core, 'general amendment')", -0.9), ("definition AND " + _id_named, 0.6))} END"""
_phrase = "lower(hierarchy_label) || ' ' || lower(hierarchy_id)"
_scope = f"""CASE WHEN definition AND hierarchy THEN {first_rule((_defining, 2.5), (_has("text_lower", V.DEFINITION_HEADINGS), 0.6))} + {first_rule((f"contains(heading_lower, {_phrase})", 1.6), (f"contains(substr(text_lower, 1, 600), {_phrase})", 0.9))}
  + {points((_has("heading_lower", ["part", "bahagian", "chapter", "bab"]), 0.4), (_has("heading_lower", ["interpretation of", "tafsiran"]), 0.6))} ELSE 0 END"""
_asks_amendment = _has("lowered", ["amendment", "pindaan", "act a"])
_amending = _has("lower(act_title)", ["amendment", "pindaan"])
_tie = first_rule((f"{_asks_amendment} AND ({_amending} OR len(list_filter(names, lambda a: regexp_matches({_normal_of}, '\\bact a\\d+\\b'))) > 0)", 0.6), (_asks_amendment, 0), (f"exact_lookup AND {_amending}", -1.2), ("exact_lookup", 0.2))
_rates = _has("heading_lower", V.RATE_HEADINGS)
_month = "(" + " OR ".join(f"(contains(lowered, '{m}') AND (contains(heading_lower, '{m}') OR contains(text_lower, '{m}')))" for m in V.MONTHS) + ")"
_non = "contains(heading_lower, 'non-application')"
_exclude = _word("tokens", "exclude")
_gazette = f"""CASE WHEN gazette THEN CASE WHEN NOT {_exclude} AND {_rate_words} THEN {points((_rates, 1.6), (_non, -1.8), (_month, 1.0))} ELSE 0 END
  + CASE WHEN {_exclude} THEN {points((f"{_non} OR contains(text_lower, 'does not apply')", 1.8), (_rates, -1.8), (_has("heading_lower", ["short title", "commencement", "interpretation"]), -0.5))} ELSE 0 END
  + CASE WHEN contains(lowered, 'revok') THEN {points(("contains(heading_lower, 'revocation') OR contains(text_lower, 'revoked')", 2.4), ("contains(heading_lower, 'order') AND NOT contains(heading_lower, 'revocation')", -0.2))} ELSE 0 END ELSE 0 END"""
_last_section = r"(regexp_extract_all(lowered, 'section\s+(\d+[a-z]?)', 1))[-1]"
_amended = r"nullif(regexp_extract(heading_lower, 'amendment of section\s+(\d+[a-z]?)', 1), '')"
_port = lambda name: f"contains({name}, 'data portability')"
_amend_doc = f"""CASE WHEN amendment THEN {points(("contains(heading_lower, 'amendment')", 0.8))}
  + {first_rule((f"{_amended} = {_last_section}", 2.2), (f"{_amended} <> {_last_section}", -1.8), (f"{_amended} IS NULL AND contains(text_lower, 'section ' || {_last_section})", 1.0))}
  + CASE WHEN {_has("lowered", ["introduc", "data portability"])} THEN {points((f"{_port('heading_lower')} OR {_port('text_lower')}", 2.2), ("contains(heading_lower, 'new section') OR contains(text_lower, 'new section')", 1.8), (f"contains(heading_lower, 'amendment of section') AND NOT {_port('text_lower')}", -1.2))} ELSE 0 END ELSE 0 END"""
_both = "(heading_lower || ' ' || text_lower)"
_amend_rerank = f"""CASE WHEN amendment THEN {points(
    (_has("lowered", ["come into force", "commencement"]) + " AND " + _has(_both, ["commencement", "come into operation"]), 1.0),
    ("contains(lowered, 'introduc') AND " + _has(_both, ["introduc", "new section", "insert"]), 0.7),
    (_has("lowered", ["introduc", "data portability"]) + " AND contains(heading_lower, 'new section')", 0.8),
    (_port("lowered") + " AND " + _port(_both), 1.1),
    ("regexp_extract(lowered, 'section" + chr(92) + "s+(" + chr(92) + "d+[a-z]?)', 1) <> '' AND contains(" + _both + ", 'section ' || regexp_extract(lowered, 'section" + chr(92) + "s+(" + chr(92) + "d+[a-z]?)', 1))", 0.8),
    ("contains(lowered, 'principal act') AND contains(" + _both + ", 'principal act')", 0.5),
)} ELSE 0 END"""
_either = lambda t: f"(contains(heading_lower, '{t}') OR contains(text_lower, '{t}'))"
_new = f"({_has('lowered', ['introduc', 'data portability'])} OR {_lists('tokens', 'introduce', 'portability')} OR contains(normalized, 'data portability'))"
_heading_intent = f"""CASE WHEN definition THEN CASE WHEN {_defining} THEN 1.8 ELSE -0.6 END + {points(("contains(heading_lower, lower(hierarchy_id)) OR contains(text_lower, lower(hierarchy_id))", 0.8))} ELSE 0 END
  + CASE WHEN {_exclude} THEN {points((f"{_non} OR contains(text_lower, 'does not apply')", 2.4), (f"{_rates} OR contains(heading_lower, 'revocation')", -1.4))} ELSE 0 END
  + CASE WHEN {_rate_words} AND NOT {_exclude} THEN {points((_rates, 1.4), (_non, -1.0))} ELSE 0 END
  + CASE WHEN {_has("lowered", ["citation", "commencement"])} THEN {first_rule((_has("heading_lower", ["citation and commencement", "short title and commencement"]), 2.8), (_has("heading_lower", ["commencement", "citation", "short title"]), 1.6))} + {points((f"{_rates} OR contains(heading_lower, 'revocation')", -1.6))} ELSE 0 END
  + CASE WHEN contains(lowered, 'revok') THEN {first_rule(("contains(heading_lower, 'revocation') OR contains(text_lower, 'revoked')", 2.6), (_rates, -1.0))} ELSE 0 END
  + CASE WHEN {_word("tokens", "appeal")} THEN {first_rule(("contains(heading_lower, 'appeal')", 1.5), ("NOT contains(text_lower, 'appeal')", -0.5))} ELSE 0 END
  + CASE WHEN {_word("tokens", "acceptance")} THEN CASE WHEN {_either("acceptance")} THEN 2.0 + {points((_either("absolute"), 0.8))} ELSE {points(("contains(heading_lower, 'obligation')", -0.6))} END ELSE 0 END
  + CASE WHEN {_word("tokens", "apply")} AND NOT {_exclude} THEN {points(("contains(heading_lower, 'application') OR contains(text_lower, 'applies')", 1.2), (_non, -0.6))} ELSE 0 END
  + CASE WHEN {_new} THEN {points((_either("new section"), 3.4), (_either("data portability"), 3.0), (_either("new division"), 0.8), (f"contains(heading_lower, 'amendment of section') AND NOT {_port('text_lower')}", -2.2))} ELSE 0 END
  + {_agreement()}"""
_exact = "CASE WHEN lower(chunk_unit_type) = unit_type AND upper(unit) = unit_id THEN 1.0 ELSE 0 END"
#: The act whose names an outside chunk may mention.
REFERENCED = "act1"
_heading_normal = "array_to_string(" + ALL_TOKENS.format("section_heading") + ", ' ')"
_mentions = f"len(list_filter((SELECT names FROM acts WHERE document_id = '{REFERENCED}'), lambda a: len({DOCUMENT_TOKENS.format(_normal_of)}) >= 2 AND (contains({_heading_normal}, {_normal_of}) OR contains(opening_400, {_normal_of}))))"
#: Reasons of graph results, by a chunk's number; null: none.
REASONS = ["graph: amendment linkage", "graph: explicit reference to section 2", "graph: hierarchy part II", None]
_reason = f"([{', '.join('NULL' if r is None else quoted(r) for r in REASONS)}])[CAST(entry_ord % 4 AS INTEGER) + 1]"
_graph = f"""CASE WHEN {_reason} IS NULL THEN 0 ELSE {first_rule((f"contains({_reason}, 'amendment linkage')", 2.4), (f"contains({_reason}, 'explicit reference')", 2.0), ("true", 1.6))} + greatest(0, 1.0 - chunk_index % 9 * 0.15)
  + {points((f"contains({_reason}, 'amendment linkage')", 1.1), (f"contains({_reason}, 'explicit reference')", 0.9), (f"contains({_reason}, 'hierarchy')", 0.8), (f"hierarchy AND contains({_reason}, 'hierarchy')", 0.6))} END"""
SCORES = {
    "lexical": f"CASE WHEN len(tokens) = 0 THEN 0 ELSE {_share('text_words')} * 0.5 + {_share('heading_words')} * 2.5 + CASE WHEN {_share('heading_words')} >= 0.5 THEN 0.75 ELSE 0 END END",
    "document": _document,
    "subsection": "CASE WHEN upper(chunk_subsection) = subsection_id THEN 0.5 ELSE 0 END",
    "defines": points((f"definition AND {_defining}", 2.0)),
    "recall": f"CASE WHEN len(list_intersect(list_intersect(heading_words, tokens), {one_of(V.RECALL_FAMILY)})) > 0 THEN 1.0 ELSE 0 END",
    "hierarchy_match": f"CASE WHEN {_marked} THEN CASE WHEN begins THEN 4.5 ELSE 3.5 END ELSE 0 END",
    "obligation_text": "CASE WHEN obligation AND obligations > 0 THEN least(1.5, 0.5 + obligations * 0.15) ELSE 0 END",
    "obligation_heading": points((f"obligation AND ({_word('heading_words', 'obligation')} OR {_lists('heading_raw', 'duty', 'duties')})", 2.5)),
    "obligation_internal": f"CASE WHEN obligation THEN position_bonus + {points(('contains(heading_lower, ' + quoted('general duties') + ')', 1.2), (_every('heading_raw', 'general', 'duty', 'duties') + ' OR ' + _every('heading_raw', 'general', 'obligation'), 0.8), (_employer, 0.6), (_lists('heading_raw', 'employee', 'employees') + ' AND NOT ' + _employer, -0.2), (_lists('heading_raw', 'manufacturer', 'supplier', 'designer', 'occupier', 'licensee'), -0.4))} ELSE 0 END",
    "obligation_definition": points((f"obligation AND {_defining}", 1.0)),
    "agreement_score": _agreement(),
    "heading_match": f"CASE WHEN len(heading_words) = 0 OR len(tokens) = 0 THEN 0 ELSE len(list_intersect(heading_words, list_distinct(tokens))) / len(heading_words) + {points((_lists('heading_words', *V.DEFINITION_HEADINGS) + ' AND definition', 0.5))} END",
    "exact_unit": _exact,
    "unit_position": first_rule(("number <= 10", 2.0), ("number <= 25", 0.8), ("number <= 50", 0.2)),
    "rerank_document": f"CASE WHEN length(title_short) >= 3 AND contains(compact, title_short) THEN 3.0 ELSE {_document} END",
    "definition_mismatch": points((f"definition AND NOT {_defining}", 1.0)),
    "amendment_rerank": _amend_rerank,
    "alignment": _alignment(),
    "specificity": _specificity,
    "scope_definition": _scope,
    "tie_break": _tie,
    "gazette_document": _gazette,
    "amendment_document": _amend_doc,
    "heading_intent": _heading_intent,
    "outside_penalty": f"{points(('document_hint', 0.35))} + 2.0 * ({_exact}) + CASE WHEN {_mentions} > 0 THEN least(2.5, 1.25 + {_mentions} * 0.4) ELSE 0 END",
    "graph_boost": _graph,
}


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All questions with all rules: a stated set of questions against all rows."""
    ctx = contexts(_asked(spark))
    prepared = R.prepare(rules(spark, sf_dir).join(F.broadcast(R.sought_phrases(ctx))), c("sought")).drop("sought")
    referenced = prepared.where(c("document_id") == REFERENCED).select(c("names").alias("referenced_names")).limit(1)
    rows = prepared.join(F.broadcast(ctx))
    rows = rows.join(F.broadcast(referenced), how="left").withColumn("referenced_names", F.coalesce("referenced_names", F.filter("names", lambda x: F.lit(False))))
    reason = F.element_at(F.array(*map(F.lit, REASONS)), (F.pmod("entry_ord", F.lit(4)) + 1).cast("int"))
    strength = F.when(reason.contains("amendment linkage"), 2.4).when(reason.contains("explicit reference"), 2.0).otherwise(1.6)
    found = {
        "lexical": R.lexical(), "document": R.document(), "subsection": R.subsection(), "defines": R.definition(), "recall": R.recall(), "hierarchy_match": R.hierarchy(), "obligation_text": R.obligation_text(),
        "obligation_heading": R.obligation_heading(), "obligation_internal": R.obligation_internal(), "obligation_definition": R.obligation_definition(), "agreement_score": R.agreement(), "heading_match": R.heading_match(),
        "exact_unit": R.exact_unit(), "unit_position": R.position(), "rerank_document": R.rerank_document(), "definition_mismatch": R.definition_mismatch(), "amendment_rerank": R.amendment_rerank(), "alignment": R.alignment(),
        "specificity": R.specificity(), "scope_definition": R.scope_definition(), "tie_break": R.tie_break(), "gazette_document": R.gazette_document(), "amendment_document": R.amendment_document(), "heading_intent": R.heading_intent(),
        "outside_penalty": R.outside_penalty(R.telling_names(c("referenced_names"))), "graph_boost": R.graph_boost(strength, c("chunk_index") % 9, reason),
    }
    return rows.select("query_id", "chunk_id", *(F.round(value.cast("double"), 6).alias(name) for name, value in found.items()))


def _scores(name: str, columns: list[str]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return scored(spark, sf_dir).select("query_id", "chunk_id", *columns)

    run.__name__ = name
    run.__doc__ = "Scores of every rule for every question: " + ", ".join(columns)
    query(f"WITH {RULES}, {PREPARED}, {CONTEXTS} SELECT query_id, chunk_id, {', '.join(f'round(CAST({SCORES[x]} AS DOUBLE), 6) AS {x}' for x in columns)} FROM prep, ctx")(run)


_scores("q_scores_words", ["lexical", "document", "subsection", "defines", "recall", "hierarchy_match", "heading_match", "exact_unit", "unit_position"])
_scores("q_scores_duties", ["obligation_text", "obligation_heading", "obligation_internal", "obligation_definition", "agreement_score", "definition_mismatch", "rerank_document"])
_scores("q_scores_headings", ["alignment", "specificity", "scope_definition", "heading_intent", "amendment_rerank"])
_scores("q_scores_documents", ["tie_break", "gazette_document", "amendment_document", "outside_penalty", "graph_boost"])

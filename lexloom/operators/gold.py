"""Gold-question candidates from a chunk table: templates over units, negatives, deduplication, balancing."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.text import dedupe_key, has, strip, unit_key
from lexloom.operators.evaluation import next_ones
from lexloom.sources.tables import in_order

c = F.col
# Patterns and word lists.
MARKER = r"^(Part|PART|Chapter|CHAPTER|Division|Bahagian|BAHAGIAN|Bab|BAB|Jadual|JADUAL|Schedule|SCHEDULE)\b(.*)$"
UNIT_PREFIX = r"(?i)^(Section|Article|Perkara)\s+\d+[A-Z]?\s*"
NOISY = r"(?i)(laws of malaysia|reprint|cetakan semula|online version|updated text)"
GENERIC = ["", "article", "bab", "bahagian", "chapter", "division", "jadual", "part", "perkara", "schedule", "section"]
MALAY = ["akta", "perlembagaan", "perkara", "bahagian", "hak", "kebebasan"]
DEFINITION, OBLIGATION = ["interpretation", "definition", "tafsiran", "maksud"], ["duties", "duty", "obligation", "requirement"]
CAPABILITY = ["right", "power", "appeal", "application", "offence"]
PRIORITY = ["direct_lookup", "heading_lookup", "definition", "capability", "obligation", "rights", "hierarchy", "bilingual", "amendment", "gazette_order"]
#: Method, category, confidence, needs review, rule, English and Malay text (empty: none).
TEMPLATES = [
    ("direct_lookup_template", "direct_lookup", 0.92, False, "always", "What does {label} {unit} of the {doc} say?", "Apakah kandungan {label} {unit} dalam {doc}?"),
    ("compact_lookup_template", "direct_lookup", 0.88, False, "always", "{label} {unit} {alias}", "{label} {unit} {alias}"),
    ("heading_lookup_template", "heading_lookup", 0.84, False, "usable", "Which {lower_label} covers {heading} in the {doc}?", "{label} manakah berkaitan {lower_heading}?"),
    ("heading_topic_template", "heading_lookup", 0.78, False, "usable", "What does {alias} say about {heading}?", "Apakah yang dinyatakan oleh {alias} tentang {lower_heading}?"),
    ("definition_heading_template", "definition", 0.85, False, "definition", "What is defined under {heading} in {label} {unit} of the {doc}?", "Apakah yang ditakrifkan di bawah {lower_heading} dalam {label} {unit} {doc}?"),
    ("definition_unit_template", "definition", 0.82, False, "definition", "What does {alias} define in {label} {unit}?", "Apakah maksud {label} {unit} dalam {alias}?"),
    ("obligation_heading_template", "obligation", 0.72, False, "obligation", "What duties are imposed under {alias}?", "Apakah kewajipan di bawah {alias}?"),
    ("capability_heading_template", "capability", 0.74, False, "appeal", "Who can appeal under {en_label} {unit} of {alias}?", "Who can appeal under {en_label} {unit} of {alias}?"),
    ("capability_heading_template", "capability", 0.74, False, "application", "To whom does {en_label} {unit} of {alias} apply?", "To whom does {en_label} {unit} of {alias} apply?"),
    ("capability_heading_template", "capability", 0.74, False, "power", "What powers are provided in {en_label} {unit} of {alias}?", "What powers are provided in {en_label} {unit} of {alias}?"),
    ("capability_heading_template", "rights", 0.74, False, "right", "What rights are recognized in {en_label} {unit} of {alias}?", "What rights are recognized in {en_label} {unit} of {alias}?"),
    ("capability_heading_template", "capability", 0.74, False, "offence", "What offences are created in {en_label} {unit} of {alias}?", "What offences are created in {en_label} {unit} of {alias}?"),
    ("hierarchy_context_template", "hierarchy", 0.46, True, "marked", "Which {marker} covers {heading} in the {doc}?", "{marker} manakah berkaitan {lower_heading}?"),
    ("amendment_document_template", "amendment", 0.38, True, "amendment", "What changes were introduced in {doc}?", "What changes were introduced in {doc}?"),
    ("amendment_scope_template", "amendment", 0.34, True, "amendment", "What is amended by {doc}?", "What is amended by {doc}?"),
    ("gazette_order_template", "gazette_order", 0.32, True, "gazette", "What does {doc} order?", "What does {doc} order?"),
    ("bm_direct_lookup_template", "bilingual", 0.86, False, "perkara", "", "Apakah maksud Perkara {unit} dalam {doc}?"),
]
NEGATIVES = [
    ("synthetic_invalid_unit_template", 0.2, "always", "What does {label} 999 of the {doc} say?", "Apakah kandungan {label} 999 dalam {doc}?"),
    ("synthetic_wrong_document_template", 0.24, "usable", "Which {lower_label} covers {heading} in the {other}?", "{label} manakah berkaitan {lower_heading} dalam {other}?"),
]


def usable_heading(body: Column) -> Column:
    text = F.lower(strip(body))
    share = lambda pattern: F.regexp_count(text, F.lit(pattern)) / F.greatest(F.char_length(text), F.lit(1))
    return ~text.isin(GENERIC) & (F.char_length(text) >= 4) & ~text.rlike(NOISY) & (share(r"\d") <= 0.25) & (share(r"[^\p{L}\p{N}\s&,/\-]") < 0.12)


def unit_records(chunks: DataFrame) -> DataFrame:
    """The first chunk of each unit, with what templates need; units with noisy or missing titles and headings go."""
    key = unit_key(c("unit_id"), c("section_id"))
    rows = chunks.withColumn("unit", key)
    first = rows.groupBy("document_id", "unit_type", "unit").agg(F.min_by(F.struct("chunk_id", "act_title", "section_heading", "source_file", "text", "document_aliases"), F.struct("chunk_index", "entry_ord")).alias("first")).select("unit_type", "unit", "first.*")
    title = F.lower(F.concat_ws(" ", "act_title", "section_heading"))
    named = F.lower(F.concat_ws(" ", "act_title", "source_file"))
    kind = F.when(has(named, "amendment", "pindaan") | named.rlike(r"\bact[- ]?a\d+\b"), "amendment").when(has(named, "p.u.", "gazette", "order", "perintah"), "gazette").when(has(named, "constitution", "perlembagaan"), "constitution").otherwise("act")
    head = F.try_element_at(F.filter(F.transform(F.slice(F.split("text", r"\R"), 1, 4), strip), lambda x: x.rlike(MARKER)), F.lit(1))
    aliases = F.filter(F.coalesce("document_aliases", F.array().cast("array<string>")), lambda a: (a != "") & (a != c("act_title")))
    short = F.get(F.filter(aliases, lambda a: (F.char_length(a) <= 10) | has(a, "Act", "PDPA", "Akta")), F.lit(0))
    malay = F.get(F.filter(aliases, lambda a: has(F.lower(a), *MALAY)), F.lit(0))
    out = first.withColumns(
        {
            "language": F.when(has(title, *MALAY), "ms").otherwise("en"),
            "kind": kind,
            "heading": F.btrim(F.regexp_replace(F.regexp_replace(strip(c("section_heading")), UNIT_PREFIX, ""), r"\s+", " "), F.lit(" -—:;")),
            "marker_line": head,
        }
    )
    topic = strip(F.regexp_replace(F.regexp_extract("marker_line", MARKER, 2), r"^[\s—:.\-]+", ""))
    out = out.withColumns(
        {
            "alias": F.coalesce(F.when(c("language") == "ms", malay), short, c("act_title")),
            "en_label": F.when(c("unit_type") == "article", "Article").when(c("unit_type") == "perkara", "Perkara").otherwise("Section"),
            "marker": F.when(topic != "", F.initcap(F.regexp_extract("marker_line", MARKER, 1))),
            "number": F.coalesce(F.regexp_replace("unit", "[^0-9]", "").try_cast("bigint"), F.lit(10_000)),
        }
    )
    out = out.withColumn("label", F.when((c("language") == "ms") & (c("en_label") == "Section"), "Seksyen").otherwise(c("en_label")))
    fine = lambda name: (F.coalesce(c(name), F.lit("")) != "") & ~c(name).rlike(NOISY)
    return out.where(fine("act_title") & fine("section_heading") & ~((c("kind") == "gazette") & (F.regexp_count("text", F.lit(r"\S+")) < 20)))


def _rules() -> dict[str, Column]:
    heading = F.lower("heading")
    said = heading != ""
    capable = {name: said & heading.contains(name) for name in ("appeal", "application", "power", "right", "offence")}
    rules, before = {}, F.lit(False)
    for name, rule in capable.items():
        rules[name] = rule & ~before
        before = before | rule
    usable = usable_heading(c("heading"))
    return rules | {
        "always": F.lit(True),
        "usable": said & usable,
        "definition": said & has(heading, *DEFINITION),
        "obligation": said & has(heading, *OBLIGATION),
        "marked": c("marker").isNotNull() & usable,
        "amendment": c("kind") == "amendment",
        "gazette": c("kind") == "gazette",
        "perkara": (c("language") == "ms") & (c("unit_type") == "perkara"),
    }


def _filled(template: str) -> Column:
    names = {"doc": c("act_title"), "unit": c("unit"), "alias": c("alias"), "heading": c("heading"), "lower_heading": F.lower("heading"), "label": c("label"), "lower_label": F.lower("label"), "en_label": c("en_label"), "marker": c("marker"), "other": c("other") if "{other}" in template else None}
    parts = [names[p[1:-1]] if p.startswith("{") else F.lit(p) for p in re.split(r"(\{\w+\})", template) if p]
    return F.trim(F.concat(*parts)) if parts else F.lit(None).cast("string")


def _text(english: str, malay: str) -> Column:
    return F.when(c("language") == "ms", _filled(malay)).otherwise(_filled(english))


def positives(units: DataFrame) -> DataFrame:
    """All candidates of units: query, category, language, generation_method, confidence, needs_review, expected_doc, expected_unit, source_chunk_id."""
    rules = _rules()
    made = F.array(*(F.when(rules[rule], F.struct(_text(en, ms).alias("query"), F.lit(category).alias("category"), F.lit(method).alias("generation_method"), F.lit(confidence).alias("confidence"), F.lit(review).alias("needs_review"))) for method, category, confidence, review, rule, en, ms in TEMPLATES))
    return units.select(F.explode(F.array_compact(made)).alias("g"), "language", c("act_title").alias("expected_doc"), c("unit").alias("expected_unit"), c("chunk_id").alias("source_chunk_id")).select("g.*", "language", "expected_doc", "expected_unit", "source_chunk_id").where("query IS NOT NULL")


def negatives(units: DataFrame) -> DataFrame:
    """Questions without an answer: a unit 999 of each act, and the heading of its second unit asked of the next act by title (the first after the last)."""
    by_title = Window.partitionBy("act_title").orderBy("unit_type", "number", "unit", "chunk_id")
    nth = units.withColumns({"nth": F.row_number().over(by_title), "of": F.count("*").over(Window.partitionBy("act_title"))}).where(c("nth") == F.least(F.lit(2), c("of")))
    following = next_ones(nth.select("act_title"), "act_title", "other")
    rules = _rules()
    made = F.array(*(F.when(rules[rule], F.struct(_text(en, ms).alias("query"), F.lit(method).alias("generation_method"), F.lit(confidence).alias("confidence"))) for method, confidence, rule, en, ms in NEGATIVES))
    rows = nth.join(following, "act_title").select(F.explode(F.array_compact(made)).alias("g"), "language")
    none = F.lit(None).cast("string")
    return rows.select("g.query", F.lit("negative").alias("category"), "g.generation_method", "g.confidence", F.lit(True).alias("needs_review"), "language", none.alias("expected_doc"), none.alias("expected_unit"), none.alias("source_chunk_id"))


def build(chunks: DataFrame) -> DataFrame:
    """Deduplicated, balanced candidates: at most 6 of a category and 24 of a document, and negatives for a sixth of them (8 at least)."""
    units = unit_records(chunks)
    every = positives(units).unionByName(negatives(units))
    best = F.min_by(F.struct(*every.columns), F.struct(-c("confidence"), "category", F.coalesce("expected_doc", F.lit("")), F.coalesce("expected_unit", F.lit("")), "generation_method"))
    once = every.groupBy(dedupe_key(c("query")).alias("key")).agg(best.alias("row")).select("row.*")
    priority = F.array_position(F.array(*map(F.lit, PRIORITY)), c("category"))
    turn = F.row_number().over(Window.partitionBy("expected_doc", "category").orderBy(c("confidence").desc(), "query"))
    taken = once.where("category <> 'negative'").withColumn("turn", turn).where("turn <= 6")
    taken = taken.withColumn("place", F.row_number().over(Window.partitionBy("expected_doc").orderBy("turn", priority))).where("place <= 24").drop("turn", "place")
    wanted = taken.agg(F.greatest(F.lit(8), F.floor(F.count("*") / 6)).alias("wanted"))
    numbered = in_order(once.where("category = 'negative'"), c("language"), c("query"), place="nth")
    kept = numbered.join(F.broadcast(wanted), c("nth") <= c("wanted")).drop("nth", "wanted")
    return taken.unionByName(kept)


#: Fixed value: a candidate of this confidence that needs no review is sure.
SURE = 0.8


def stats(candidates: DataFrame) -> DataFrame:
    """candidates, sure and review by category, by document, by language and in all (gid tells which)."""
    sets = candidates.groupingSets([[c("category")], [c("expected_doc")], [c("language")], []], "category", "expected_doc", "language")
    sure = (c("confidence") >= SURE) & ~c("needs_review")
    return sets.agg(F.grouping_id().alias("gid"), F.count("*").alias("candidates"), F.count_if(sure).alias("sure"), F.count_if(c("needs_review")).alias("review"))


def in_final_order(candidates: DataFrame) -> DataFrame:
    """Add place, from 1, by document (those without one last), category, language and text."""
    return in_order(candidates, F.coalesce("expected_doc", F.lit("zzz-negative")), c("category"), c("language"), c("query"))


def newly_represented(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """expected_doc of current candidates that no baseline candidate has."""
    return current.where("expected_doc IS NOT NULL").select("expected_doc").distinct().join(baseline.select("expected_doc").distinct(), "expected_doc", "left_anti")


def selected(specs: DataFrame, candidates: DataFrame) -> DataFrame:
    """The candidates that specs(query, ...) choose, with the specs' other columns; a spec without its candidate is an error."""
    key = lambda name: F.trim(c(name))
    chosen = specs.withColumn("key", key("query")).join(candidates.withColumn("key", key("query")).drop("query"), "key", "left")
    missing = F.raise_error(F.concat(F.lit("no candidate asks: "), c("query")))
    return chosen.withColumn("query", F.when(c("generation_method").isNull(), missing).otherwise(c("query"))).drop("key")


def with_units(entries: DataFrame, units: DataFrame) -> DataFrame:
    """Entries(query, expected_doc, expected_unit, ...) with the chunk of the unit that each names; an unknown unit is an error."""
    known = units.select(c("act_title").alias("expected_doc"), c("unit").alias("expected_unit"), c("chunk_id").alias("source_chunk_id"))
    met = entries.join(known, ["expected_doc", "expected_unit"], "left")
    missing = F.raise_error(F.concat_ws(" ", F.lit("no unit"), "expected_unit", F.lit("in"), "expected_doc"))
    return met.withColumn("source_chunk_id", F.coalesce("source_chunk_id", missing))


def once_by_text(payloads: DataFrame, order_col: str) -> DataFrame:
    """Of payloads with the same trimmed query the first by order_col."""
    return payloads.groupBy(F.trim(c("query")).alias("key")).agg(F.min_by(F.struct(*payloads.columns), c(order_col)).alias("row")).select("row.*")

"""What an answer may rest on: citations, and whether the evidence of a question supports one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import answer_texts as A
from lexloom.functions import fixed_values as V
from lexloom.functions.text import cut_at_blank, first_sentence, has, one_line, strip, unit_key, words_in

c = F.col
# Least score to rest on, and the gap below which two provisions compete.
LEAST_SCORE, CLOSE = 0.6, 0.08
EXPLICIT_UNIT = r"(?i)\b(section|article|perkara)\s+([0-9A-Za-z]+)\b"
ADVICE = r"(?i)\b(should i|can i sue|legal advice|what should i do legally)\b"


def citation() -> Column:
    """Title, unit and, in brackets, subsection and paragraph of a result row."""
    label = F.when(F.lower("unit_type") == "article", "Article").when(F.lower("unit_type") == "perkara", "Perkara").otherwise("Section")
    title = F.coalesce(F.nullif("act_title", F.lit("")), c("document_id"))
    inner = lambda name: F.when(F.coalesce(c(name), F.lit("")) != "", F.concat(F.lit("("), c(name), F.lit(")"))).otherwise("")
    return F.concat(title, F.lit(", "), label, F.lit(" "), unit_key(c("unit_id"), c("section_id")), inner("subsection_id"), inner("paragraph_id"))


def decide(queries: DataFrame, results: DataFrame) -> DataFrame:
    """query_id, decision, citations, grounded for every question(query_id, query).

    results are ranked rows with the chunk's columns. Decisions, the first that holds: none (no results), weak
    (the best scores below LEAST_SCORE), ambiguous (the two best cite different provisions with scores within
    CLOSE), grounded. Citations are those of the three best, each once; a weak answer has the first.
    """
    row = F.struct("rank", "score", citation().alias("cite"))
    top = results.where("rank <= 3").groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("top"))
    joined = queries.select("query_id").join(top, "query_id", "left")
    best, second = F.get("top", F.lit(0)), F.get("top", F.lit(1))
    close = (F.abs(best["score"] - second["score"]) <= CLOSE) & (best["cite"] != second["cite"])
    decision = F.when(c("top").isNull(), "none").when(best["score"] < LEAST_SCORE, "weak").when(F.coalesce(close, F.lit(False)), "ambiguous").otherwise("grounded")
    cites = F.array_distinct(F.transform("top", lambda r: r["cite"]))
    kept = F.when(decision == "none", F.array().cast("array<string>")).when(decision == "weak", F.slice(cites, 1, 1)).otherwise(cites)
    return joined.select("query_id", decision.alias("decision"), kept.alias("citations"), (decision == "grounded").alias("grounded"))


def lacks_asked_unit(queries: DataFrame, results: DataFrame) -> DataFrame:
    """query_id, abstain: questions for a unit that is not among the units of the first five results."""
    units = results.where("rank <= 5").groupBy("query_id").agg(F.collect_set(F.lower(F.trim(unit_key(c("unit_id"), c("section_id"))))).alias("units"))
    asked = F.lower(F.regexp_extract("query", EXPLICIT_UNIT, 2))
    there = F.coalesce(F.array_contains("units", asked), F.lit(False))
    return queries.join(units, "query_id", "left").select("query_id", ((asked != "") & ~there).alias("abstain"))


UNIT_START = r"(?i)^(Section|Article|Perkara)\s+[A-Za-z0-9]+[\s.:_-]*"  # fixed value


def heading_topic(heading: Column) -> Column:
    return F.coalesce(F.nullif(strip(F.regexp_replace(F.coalesce(heading, F.lit("")), UNIT_START, "")), F.lit("")), F.lit("the retrieved provision"))


def content_terms(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)
    return F.array_distinct(F.filter(words, lambda t: (F.char_length(t) > 2) & ~t.isin(A.CONTENT_STOPWORDS)))


def brief(text: Column, heading: Column, limit: int = 220) -> Column:
    """The first sentence of a chunk without its heading and unit; the heading's topic where nothing is left."""
    flat, head = one_line(text), strip(F.coalesce(heading, F.lit("")))
    body = F.when((head != "") & F.startswith(F.lower(flat), F.lower(head)), F.regexp_replace(F.substr(flat, F.char_length(head) + 1), r"^\s+", "")).otherwise(flat)
    undotted = lambda x: F.regexp_replace(strip(x), r"\.+$", "")
    sentence = undotted(F.substring_index(body, ". ", 1))
    said = F.regexp_replace(F.when(sentence != "", sentence).otherwise(undotted(body)), UNIT_START, "")
    said = F.when((said == "") | strip(said).rlike(r"^[A-Za-z]?\d+[A-Za-z]?$"), heading_topic(head)).otherwise(said)
    cut = cut_at_blank(said, limit)
    return F.concat(F.upper(F.substring(cut, 1, 1)), F.substr(cut, F.lit(2)), F.lit("."))


def demands_abstention(query: Column) -> Column:
    """Does a question name a unit, or ask for advice?"""
    return query.rlike(EXPLICIT_UNIT) | query.rlike(ADVICE)


def asks_checklist(query: Column) -> Column:
    """Is the question about what to check in an employment agreement?"""
    q = F.lower(query)
    worded = q.contains("employment") & has(q, "agreement", "contract") & has(q, *V.AGREEMENT_WORDS)
    return (has(q, *A.CHECKLIST_SUBJECTS) & has(q, *A.CHECKLIST_ASKS)) | worded


def _filled(text: str, *values: Column) -> Column:
    """The text with {0}, {1}, ... replaced."""
    out = F.lit(text)
    for i, value in enumerate(values):
        out = F.replace(out, F.lit(f"{{{i}}}"), value)
    return out


def _bulleted(items: Column, none: str) -> Column:
    return F.when(F.size(items) > 0, F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")).otherwise(none)


def _sections(*parts: tuple[str, Column]) -> Column:
    return F.concat_ws("\n\n", *(F.concat(F.lit(f"{name}:\n"), value) for name, value in parts))


def _checklist(top: Column) -> tuple[Column, Column]:
    """(items, basis) of the checklist from the first results that stand for each category; null items where no category has one.

    A notice of termination, the last one, goes before any other termination.
    """
    seen = F.filter(F.transform(top, lambda r, i: F.struct(r["cite"].alias("cite"), r["hay"].alias("hay"), (F.array_position(F.transform(top, lambda x: x["cite"]), r["cite"]) == i + 1).alias("first"))), lambda r: r["first"])
    cites = {name: F.get(F.transform(F.filter(seen, _cued(cues)), lambda r: r["cite"]), F.lit(0)) for name, cues, _, _ in A.CHECKLIST}
    notices = F.transform(F.filter(seen, _cued([A.NOTICE])), lambda r: r["cite"])
    cites["termination"] = F.coalesce(F.try_element_at(notices, F.lit(-1)), cites["termination"])
    items = [F.when(cites[name].isNotNull(), item) if name != "written_terms" else F.when(cites[name].isNotNull(), item).otherwise(A.WITHOUT_TERMS) for name, _, item, _ in A.CHECKLIST]
    basis = [F.when(cites[name].isNotNull(), _filled(text, cites[name])) for name, _, _, text in A.CHECKLIST]
    any_found = F.coalesce(*cites.values()).isNotNull()
    return F.when(any_found, F.array_compact(F.array(*items))), F.array_compact(F.array(*basis))


def _cued(cues: list[str]):
    return lambda r: has(r["hay"], *cues)


def compose(queries: DataFrame, results: DataFrame) -> DataFrame:
    """query_id, decision, citations, grounded and answer (its text) for every question(query_id, query).

    Decisions are those of `decide`, with a checklist before all but none (questions about employment agreements of
    which the five best results support one), and broad in place of grounded where a question without a unit shares no
    content with the first heading.
    """
    row = F.struct("rank", "score", citation().alias("cite"), brief(c("text"), c("section_heading")).alias("said"), "section_heading", F.lower(F.concat_ws(" ", F.coalesce("section_heading", F.lit("")), "text")).alias("hay"))
    five = results.where("rank <= 5").groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("five"))
    rows = queries.select("query_id", "query").join(five, "query_id", "left").withColumn("top", F.slice("five", 1, 3))
    best, second = F.get("top", F.lit(0)), F.get("top", F.lit(1))
    items, basis = _checklist(c("five"))
    rows = rows.withColumns({"items": F.when(asks_checklist(c("query")), items), "basis": basis})
    close = F.coalesce((F.abs(best["score"] - second["score"]) <= CLOSE) & (best["cite"] != second["cite"]), F.lit(False))
    heading = content_terms(F.coalesce(best["section_heading"], F.lit("")))
    broad = ~c("query").rlike(r"(?i)\b(section|article|perkara)\b") & (F.size(heading) > 0) & ~F.arrays_overlap(heading, content_terms(c("query")))
    decision = F.when(c("top").isNull(), "none").when(c("items").isNotNull(), "checklist").when(best["score"] < LEAST_SCORE, "weak").when(close, "ambiguous").when(broad, "broad").otherwise("grounded")
    rows = rows.withColumn("decision", decision)
    cites = lambda name: F.array_distinct(F.transform(name, lambda r: r["cite"]))
    kept = F.when(c("decision") == "none", words_in([])).when(c("decision") == "checklist", cites("five")).when(c("decision") == "weak", F.slice(cites("top"), 1, 1)).otherwise(cites("top"))
    rows = rows.withColumn("citations", kept)
    lines = lambda rest: F.array_join(F.transform(rest, lambda r: F.concat(F.lit("- "), r["cite"], F.lit(": "), r["said"])), "\n")
    others = F.filter(F.slice("top", 2, 2), lambda r: r["cite"] != best["cite"])
    sources = ("Sources", _bulleted(c("citations"), A.NO_SOURCES))
    text = F.lit(None).cast("string")
    for name, (direct, legal, practical, limits) in A.ANSWERS.items():
        said = [_filled(part, F.coalesce(best["cite"], F.lit("")), F.lower(F.coalesce(best["said"], F.lit(""))), F.coalesce(best["said"], F.lit(""))) for part in (direct, legal)]
        if name == "ambiguous":
            said[1] = F.concat_ws("\n", said[1], lines(c("top")))
        if name == "grounded":
            said[1] = F.concat_ws("\n", said[1], F.when(F.size(others) > 0, F.concat(F.lit(A.MORE_SOURCES + "\n"), lines(others))))
        whole = _sections(("Direct Answer", said[0]), ("Legal Basis", said[1]), ("Practical Meaning", F.lit(practical)), ("Important Limits", F.lit(limits)), sources)
        text = F.when(c("decision") == name, whole).otherwise(text)
    listed = _sections(("Direct Answer", F.lit(A.CHECKLIST_ANSWER)), ("Checklist", _bulleted(c("items"), "")), ("Legal Basis", _bulleted(c("basis"), f"- {A.NO_BASIS}")), ("Important Limits", F.lit(A.CHECKLIST_LIMITS)), sources)
    text = F.when(c("decision") == "checklist", listed).otherwise(text)
    return rows.select("query_id", "decision", "citations", c("decision").isin("checklist", "broad", "grounded").alias("grounded"), text.alias("answer"))


def context_block(results: DataFrame) -> DataFrame:
    """query_id, context: a numbered source with its heading and first sentence for every ranked result."""
    line = F.concat(F.lit("[Source "), c("rank").cast("string"), F.lit("] "), "act_title", F.lit(" | "), F.initcap("unit_type"), F.lit(" "), unit_key(c("unit_id"), c("section_id")), F.lit(" | "), "section_heading", F.lit("\nSummary: "), first_sentence(c("text")))
    return _blocks(results.select("query_id", "rank", line.alias("line")))


def grouped_context_block(sources: DataFrame) -> DataFrame:
    """query_id, context: the same for sources(query_id, place, document, unit_type, unit_id, heading, chunk_count, preview)."""
    line = F.concat(F.lit("[Source "), c("place").cast("string"), F.lit("] "), "document", F.lit(" | "), F.initcap("unit_type"), F.lit(" "), "unit_id", F.lit(" | "), "heading", F.lit(" | Chunks: "), c("chunk_count").cast("string"), F.lit("\nSummary: "), "preview")
    return _blocks(sources.select("query_id", c("place").alias("rank"), line.alias("line")))


def _blocks(lines: DataFrame) -> DataFrame:
    return lines.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n\n").alias("context"))


def graph_paths(results: DataFrame, linked: DataFrame, k: int = 3) -> DataFrame:
    """query_id, rank, path: how the best graph results of the first result's document were reached.

    linked: ranked graph results (query_id, rank, reason, document_id) with act_title, unit_type, unit_id and section_id.
    """
    first = results.where("rank = 1").select("query_id", "document_id")
    path = F.concat("reason", F.lit(" -> "), "act_title", F.lit(" "), F.initcap("unit_type"), F.lit(" "), unit_key(c("unit_id"), c("section_id")))
    return linked.where(c("rank") <= k).join(first, ["query_id", "document_id"], "left_semi").select("query_id", "rank", path.alias("path"))

"""The structure graph of a chunk table: units, hierarchy markers and their edges, and searches over them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.text import has, points, strip, unit_key, words_in
from lexloom.operators.names import names_in
from lexloom.operators.retrieval import few
from lexloom.sources.tables import along, written

c = F.col
# Patterns and words.
UNIT_REFERENCE = r"(?i)\b(section|article|perkara)\s+(\d+[A-Za-z]?)\b"
MARKER = r"^(Part|PART|Chapter|CHAPTER|Division|DIVISION|Bahagian|BAHAGIAN|Bab|BAB|Schedule|SCHEDULE|Jadual|JADUAL)\s+([A-Za-z0-9IVXLCDM]+)\s*[:.\-]?\s*(.*)$"
#: The labels of MARKER.
LABELS = ["part", "chapter", "division", "bahagian", "bab", "schedule", "jadual"]
AMENDMENT_OF = r"(?i)\bamendment of (section|article|perkara)\s+(\d+[A-Za-z]?)\b"
NEW_UNIT = r"(?i)\bnew (section|article|perkara)\s+(\d+[A-Za-z]?)\b"
INSERT_AFTER = r"(?i)\binserting after (section|article|perkara)\s+(\d+[A-Za-z]?)\b"
COMMENCEMENT = r"(?i)\b(commencement|comes into operation|mula berkuat kuasa)\b"
ASKS_HIERARCHY = r"(?i)\b(part|chapter|division|bahagian|bab|schedule|jadual)\s+([A-Za-z0-9IVXLCDM]+)\b"
ASKS_AMENDMENT = r"(?i)\b(amendment|amends|amend|principal act|pindaan|new section|introduc)\b"
ASKS_REFERENCE = r"(?i)\b(refer|refers|referred|reference|cross-reference|under section|under article|under perkara)\b"
TOPIC_STOPWORDS = ["about", "article", "bab", "bahagian", "begin", "begins", "chapter", "cover", "covers", "deal", "deals", "division", "does", "in", "jadual", "of", "part", "perkara", "say", "schedule", "section", "start", "starts", "the", "under", "what", "which", "with"]


@dataclass
class Graph:
    units: DataFrame  # node_id, document_id, unit_type, unit_id, ord, the chunk's columns but its text, and what of_text finds in that
    markers: DataFrame  # node_id, document_id, label, identifier, title, chunk_index
    edges: DataFrame  # edge_type, src, dst
    commences: DataFrame  # node_id


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)


def _overlap(left: Column, right: Column) -> Column:
    """Share of the distinct left words that are among the right ones."""
    distinct = F.array_distinct(left)
    return F.when((F.size(distinct) == 0) | (F.size(right) == 0), 0.0).otherwise(F.size(F.array_intersect(distinct, right)) / F.size(distinct))


def _pair(text: Column, pattern: str) -> Column:
    """type:ID of the first match, null without one."""
    return F.when(text.rlike(pattern), F.concat_ws(":", F.lower(F.regexp_extract(text, pattern, 1)), F.upper(F.regexp_extract(text, pattern, 2))))


def of_text(chunks: DataFrame) -> DataFrame:
    """chunks with what the graph needs of their texts, which stay where they are: marks (marker lines: n, label, identifier, title), references, inserted_after, commences.

    Patterns are tried on texts that have their words (in lower case) only.
    """
    lines = F.when(has(c("_lower"), *LABELS), F.filter(F.transform(F.split("text", r"\R"), strip), lambda x: x != "")).otherwise(words_in([]))
    marked = F.filter(F.transform("_lines", lambda x, n: F.struct(n.alias("n"), x.alias("line"), F.get("_lines", n + 1).alias("following"))), lambda m: m["line"].rlike(MARKER))

    def mark(m: Column) -> Column:
        own = strip(F.regexp_extract(m["line"], MARKER, 3))
        title = F.when(own != "", own).when(m["following"].isNotNull() & ~m["following"].rlike(r"(?i)^(section|article|perkara)\s+\d+[A-Za-z]?\b"), m["following"]).otherwise("")
        return F.struct(m["n"].alias("n"), F.lower(F.regexp_extract(m["line"], MARKER, 1)).alias("label"), F.upper(F.regexp_extract(m["line"], MARKER, 2)).alias("identifier"), title.alias("title"))

    whole = F.concat_ws("\n", "section_heading", "text")
    pair = lambda m: F.concat_ws(":", F.lower(F.regexp_extract(m, UNIT_REFERENCE, 1)), F.upper(F.regexp_extract(m, UNIT_REFERENCE, 2)))
    found = F.regexp_extract_all("_whole", F.lit("(?=[SsAaPp])" + UNIT_REFERENCE), 0)
    named = F.when(has(c("_lower"), "section", "article", "perkara"), F.array_distinct(F.transform(found, pair))).otherwise(words_in([]))
    inserted = F.when(has(c("_lower"), "inserting after"), _pair(c("text"), INSERT_AFTER))
    commences = has(c("_lower"), "commencement", "comes into operation", "mula berkuat kuasa") & c("_whole").rlike(COMMENCEMENT)
    rows = chunks.withColumn("_whole", whole).withColumn("_lower", F.lower("_whole")).withColumn("_lines", lines)
    return rows.withColumns({"marks": F.transform(marked, mark), "references": named, "inserted_after": inserted, "commences": F.coalesce(commences, F.lit(False))}).drop("_lines", "_whole", "_lower")


def units(chunks: DataFrame) -> DataFrame:
    """The representative chunk of each unit (smallest chunk_index, chunk_id), in document order, with the unit after it; no texts."""
    kind, ident = F.lower(F.coalesce(F.nullif("unit_type", F.lit("")), F.lit("section"))), F.upper(unit_key(c("unit_id"), c("section_id")))
    rows = of_text(chunks).withColumns({"unit_type": kind, "unit_id": ident})
    keep = ["chunk_index", "chunk_id", "section_heading", "act_title", "document_aliases", "marks", "references", "inserted_after", "commences"]
    best = rows.groupBy("document_id", "unit_type", "unit_id").agg(F.min_by(F.struct(*keep), F.struct("chunk_index", "chunk_id")).alias("chunk"))
    named = best.select(F.concat_ws(":", "document_id", "unit_type", "unit_id").alias("node_id"), "document_id", "unit_type", "unit_id", "chunk.*")
    return along(named, ["document_id"], ["chunk_index", "chunk_id"], following={"next_unit": c("node_id")}, number="ord")


def marker_lines(nodes: DataFrame) -> DataFrame:
    """Marker lines of units: a marker on the first line holds from its own unit on, others from the next."""
    rows = nodes.select("document_id", "ord", "chunk_index", F.explode("marks").alias("m")).select("document_id", "ord", "chunk_index", "m.*")
    node = F.concat_ws(":", "document_id", F.lit("hierarchy"), "label", "identifier")
    return rows.select(node.alias("node_id"), "document_id", "label", "identifier", "title", "chunk_index", "ord", "n", (c("ord") + F.when(c("n") == 0, 0).otherwise(1)).alias("holds_from"))


def contains_edges(nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """Of each label the last marker at or before a unit contains it; labels run on independently of each other."""
    marks = lines.select("document_id", c("holds_from").alias("at"), F.lit(0).alias("kind"), "ord", "n", "label", "node_id")
    own = nodes.select("document_id", c("ord").alias("at"), F.lit(1).alias("kind"), F.lit(0).alias("ord"), F.lit(0).alias("n"), F.lit(None).cast("string").alias("label"), "node_id")
    held = along(marks.unionByName(own), ["document_id"], ["at", "kind", "ord", "n"], last={f"in_{x}": F.when(c("label") == x, c("node_id")) for x in LABELS})
    markers = F.array_compact(F.array(*(c(f"in_{x}") for x in LABELS)))
    return held.where("kind = 1").select(F.lit("CONTAINS").alias("edge_type"), F.explode(markers).alias("src"), c("node_id").alias("dst"))


def principal_documents(nodes: DataFrame) -> DataFrame:
    """document_id, principal: for amending acts the other document that shares most title words, two at least (the first by id wins a tie)."""
    titles = nodes.groupBy("document_id").agg(F.min_by("act_title", "ord").alias("title")).select("document_id", F.coalesce("title", F.lit("")).alias("title"))
    plain = F.trim(F.regexp_replace(F.regexp_replace("title", r"(?i)\s*\((amendment|pindaan)\)\s*", " "), r"(?i)\s+Act\s+A\d+\b", ""))
    amending = titles.where(F.lower("title").rlike("amendment|pindaan")).select("document_id", F.explode(F.array_distinct(_words(plain))).alias("word"))
    others = titles.select(c("document_id").alias("other"), F.explode(F.array_distinct(_words(c("title")))).alias("word"))
    shared = amending.join(others, "word").where(c("document_id") != c("other")).groupBy("document_id", "other").agg(F.count("*").alias("n")).where("n >= 2")
    return shared.groupBy("document_id").agg(F.min_by("other", F.struct(-c("n"), "other")).alias("principal"))


def build(chunks: DataFrame) -> Graph:
    """All nodes and edges of chunks; tables that several parts use are written once."""
    nodes = written(units(chunks), "units")
    lines = written(marker_lines(nodes), "markers")
    markers = lines.groupBy("node_id", "document_id", "label", "identifier").agg(F.max_by(F.struct("title", "chunk_index"), F.struct("ord", "n")).alias("last")).select("node_id", "document_id", "label", "identifier", "last.*")
    following = nodes.where("next_unit IS NOT NULL").select(F.lit("NEXT_UNIT").alias("edge_type"), c("node_id").alias("src"), c("next_unit").alias("dst"))
    asked = nodes.select(c("node_id").alias("src"), "document_id", "ord", F.explode("references").alias("target")).withColumn("dst", F.concat_ws(":", "document_id", "target"))
    known = nodes.select(c("node_id").alias("dst"), c("ord").alias("target_ord"))
    # references reach units that stand before them (or themselves: those are no edges) in the same document
    refers = asked.join(known, "dst").where((c("target_ord") <= c("ord")) & (c("src") != c("dst"))).select("src", "dst")
    reverse = refers.select(F.lit("REVERSE_REFERS_TO").alias("edge_type"), c("dst").alias("src"), c("src").alias("dst"))
    outward = nodes.join(principal_documents(nodes), "document_id", "left").withColumn("target_document", F.coalesce("principal", "document_id"))

    def to(kind: str, target: Column) -> DataFrame:
        return outward.select(F.lit(kind).alias("edge_type"), c("node_id").alias("src"), F.concat(c("target_document"), F.lit(":"), target).alias("dst")).where("dst IS NOT NULL")

    every = contains_edges(nodes, lines).unionByName(following).unionByName(refers.select(F.lit("REFERS_TO").alias("edge_type"), "src", "dst")).unionByName(reverse)
    for part in (to("REFERS_TO", c("inserted_after")), to("AMENDS", _pair(c("section_heading"), AMENDMENT_OF)), to("INSERTS", _pair(c("section_heading"), NEW_UNIT))):
        every = every.unionByName(part)
    return Graph(nodes, markers, written(every.distinct(), "edges"), nodes.where("commences").select("node_id"))


def query_class(query: Column) -> Column:
    return F.when(query.rlike(ASKS_HIERARCHY), "hierarchy").when(query.rlike(ASKS_AMENDMENT), "amendment").when(query.rlike(ASKS_REFERENCE), "reference")


def _asked_documents(graph: Graph, queries: DataFrame) -> DataFrame:
    """Add asked_document: the one with the longest alias in the question (the smaller id at a tie), null if there is none."""
    heads = graph.units.where("ord = 1")
    names = F.concat(F.array(F.coalesce("act_title", F.lit(""))), F.coalesce("document_aliases", words_in([])))
    aliases = heads.select(c("document_id").alias("asked_document"), F.explode(F.array_distinct(F.transform(names, lambda a: F.lower(strip(a))))).alias("alias")).where("alias <> ''")
    met = names_in(queries, aliases)
    best = met.groupBy("query_id").agg(F.min_by("asked_document", F.struct(-F.char_length("alias"), "asked_document")).alias("asked_document"))
    return queries.join(best, "query_id", "left")


def search(graph: Graph, queries: DataFrame, k: int = 3) -> DataFrame:
    """query_id, rank, chunk_id, document_id, score, reason of the k best graph results of each question(query_id, query)."""
    asked = written(_asked_documents(graph, queries.where(F.trim("query") != "")).withColumn("kind", query_class(c("query"))).where("kind IS NOT NULL"), "graph-questions")
    in_document = c("asked_document").isNull() | (c("asked_document") == c("document_id"))
    chunk = ["chunk_id", "document_id", "chunk_index"]

    hierarchy = asked.where("kind = 'hierarchy'").withColumns({"label_asked": F.lower(F.regexp_extract("query", ASKS_HIERARCHY, 1)), "id_asked": F.upper(F.regexp_extract("query", ASKS_HIERARCHY, 2)), "topic": F.filter(_words(c("query")), lambda t: ~t.isin(TOPIC_STOPWORDS))})
    scored = graph.markers.join(few(hierarchy), in_document).withColumn("s", points((c("label") == c("label_asked"), 4.0), (c("identifier") == c("id_asked"), 4.0)) + 2.0 * _overlap(c("topic"), _words(c("title")))).where("s > 0")
    first = graph.edges.where("edge_type = 'CONTAINS'").join(graph.units.select(c("node_id").alias("dst"), "chunk_id", c("chunk_index").alias("unit_index")), "dst")
    first = first.groupBy(c("src").alias("node_id")).agg(F.min_by(F.struct("chunk_id", "unit_index"), F.struct("unit_index", "dst")).alias("first")).select("node_id", "first.*")
    by_marker = scored.join(first, "node_id").select("query_id", "chunk_id", "document_id", "chunk_index", (10.0 + c("s")).alias("score"), F.concat_ws(" ", F.lit("graph: hierarchy"), "label", "identifier").alias("reason"), c("node_id").alias("tie"))

    q = F.lower("query")
    pairs = F.array_distinct(F.zip_with(F.regexp_extract_all("query", F.lit(UNIT_REFERENCE), 1), F.regexp_extract_all("query", F.lit(UNIT_REFERENCE), 2), lambda t, i: F.struct(F.concat_ws(":", F.lower(t), F.upper(i)).alias("pair"), F.upper(i).alias("id"))))
    amendment = asked.where("kind = 'amendment'").withColumns({"pairs": pairs, "q_words": _words(c("query"))})
    amendment = amendment.withColumns({"asks_commencement": q.rlike("into force|commencement|operation"), "general": F.contains(q, F.lit("general amendment")) | (F.contains(q, F.lit("principal act")) & (F.size("pairs") == 0) & ~F.contains(q, F.lit("introduc")))})
    targets = graph.edges.where("edge_type IN ('AMENDS', 'INSERTS')").groupBy(c("src").alias("node_id")).agg(F.collect_set(F.when(c("edge_type") == "AMENDS", c("dst"))).alias("amends"), F.collect_set(F.when(c("edge_type") == "INSERTS", c("dst"))).alias("inserts"))
    rows = graph.units.drop("commences").join(targets, "node_id", "left").join(graph.commences.withColumn("commences", F.lit(True)), "node_id", "left").join(few(amendment), in_document)
    ends = lambda edges, p: F.size(F.filter(F.coalesce(c(edges), words_in([])), lambda e: F.endswith(e, F.concat(F.lit(":"), p["pair"]))))
    heading = _words(c("section_heading"))
    per_target = F.aggregate("pairs", F.lit(0.0), lambda acc, p: acc + ends("amends", p) * 6.0 + ends("inserts", p) * 6.5 + F.when((ends("amends", p) + ends("inserts", p) == 0) & F.array_contains(heading, p["id"]), 0.5).otherwise(0.0))
    s = (
        per_target
        + _overlap(c("q_words"), heading)
        + points(
            (c("amends").isNotNull(), 3.0),
            (F.array_contains("q_words", "new") & F.array_contains(heading, "new"), 2.0),
            (c("asks_commencement") & c("commences"), 4.0),
            (c("asks_commencement") & F.array_contains(heading, "commencement"), 3.0),
            (c("general") & F.array_contains(heading, "general") & F.array_contains(heading, "amendment"), 7.0),
        )
    )
    by_amendment = rows.withColumn("s", s).where("s > 0").select("query_id", *chunk, (10.0 + c("s")).alias("score"), F.lit("graph: amendment linkage").alias("reason"), c("chunk_id").alias("tie"))

    reference = asked.where("kind = 'reference'").select("query_id", "query", "asked_document", F.explode(pairs).alias("p"))
    target = reference.join(graph.units.select("document_id", c("node_id").alias("src"), F.concat_ws(":", "unit_type", "unit_id").alias("pair")), (c("pair") == c("p.pair")) & in_document).drop("document_id")
    source = target.join(graph.edges.where("edge_type = 'REVERSE_REFERS_TO'"), "src").join(graph.units.withColumnRenamed("node_id", "dst"), "dst")
    by_reference = source.select("query_id", *chunk, (8.0 + _overlap(_words(c("query")), _words(c("section_heading")))).alias("score"), F.concat(F.lit("graph: explicit reference to "), F.replace(c("p.pair"), F.lit(":"), F.lit(" "))).alias("reason"), c("chunk_id").alias("tie"))

    best = Window.partitionBy("query_id", "chunk_id").orderBy(c("score").desc(), "reason")
    merged = by_amendment.unionByName(by_reference).withColumn("nth", F.row_number().over(best)).where("nth = 1").drop("nth")
    ranked = by_marker.unionByName(merged).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(c("score").desc(), "chunk_index", "tie")))
    return ranked.where(c("rank") <= k).select("query_id", "rank", "chunk_id", "document_id", "score", "reason")


def consistency(graph: Graph) -> DataFrame:
    """edge_type, edges, orphans: how many edges there are and how many end where no node is (inserted units need not be there)."""
    nodes = graph.units.select(c("node_id").alias("dst")).unionByName(graph.markers.select(c("node_id").alias("dst"))).distinct()
    marked = graph.edges.join(nodes.withColumn("known", F.lit(True)), "dst", "left")
    return marked.groupBy("edge_type").agg(F.count("*").alias("edges"), F.count_if(c("known").isNull()).alias("orphans"))

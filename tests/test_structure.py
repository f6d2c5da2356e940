import random
import re

from lexloom.operators import graph, segmentation
from lexloom.sources.chunks import chunk_table


def line_by_line(lines, hint="section"):
    """Units of a list of lines, by following the rules from line to line."""
    label = hint.title()
    units, unit, section, pending = [], None, None, None

    def new(sub, para, first):
        nonlocal unit
        unit = {"id": section[0], "heading": section[1], "sub": sub, "para": para, "lines": first}
        units.append(unit)

    for i, line in enumerate(lines):
        following = lines[i + 1] if i + 1 < len(lines) else ""
        explicit = re.match(rf"{label}\s+(\d+[A-Z]?)\b(.*)$", line)
        numbered = re.match(r"(\d+[A-Z]?)\.\s*(.*)$", line)
        sub, para = re.match(r"\((\d+[A-Z]?)\)", line), re.match(r"\(([a-zA-Z]+)\)", line)
        if explicit:
            section = (explicit[1], " ".join(filter(None, [label, explicit[1], explicit[2].strip()])))
            new(None, None, [line])
            pending = None
        elif numbered and (pending or section is None or numbered[1] != section[0]):
            section = (numbered[1], " ".join(filter(None, [label, numbered[1], pending])))
            inner = re.match(r"\((\d+[A-Z]?)\)", numbered[2])
            new(inner and inner[1], None, [section[1], line])
            pending = None
        elif sub and section:
            if unit["lines"] == [section[1]]:
                unit["sub"] = sub[1]
                unit["lines"].append(line)
            else:
                new(sub[1], None, [line])
                pending = None
        elif para and section:
            if unit["sub"]:
                unit["lines"].append(line)
            else:
                new(None, para[1], [line])
            pending = None
        elif re.match(r"\d+[A-Z]?\.", following) and not re.match(r"(Part [A-Z0-9]+$|Section\s+\d+|\d+$)", line) and line[-1] not in ".;:,":
            pending = line
        else:
            pending = None
            if unit:
                unit["lines"].append(line)
    return [(u["id"], u["heading"], u["sub"], u["para"], "\n".join(u["lines"])) for u in units]


def test_units_equal_the_line_by_line_rules(spark):
    rng = random.Random(6)
    kinds = ["1. body", "1. (2) body", "2. other", "2A. (1) x", "Section 3", "Section 3 Short title", "(1) first", "(2) second", "(a) letter", "(b) letter", "Heading", "plain text.", "Part IV", "7", "1. no stop", "2. no stop"]
    texts = [[rng.choice(kinds) for _ in range(rng.randint(1, 14))] for _ in range(400)]
    docs = spark.createDataFrame([(str(i), "\r\n".join(f"  {x} " for x in t), "laws/x.pdf", "An Act", "section") for i, t in enumerate(texts)], "document_id string, text string, source_path string, act_title string, unit_type_hint string")
    got = {}
    for r in segmentation.legal_units(docs).orderBy("unit_no").collect():
        got.setdefault(int(r["document_id"]), []).append((r["section_id"], r["section_heading"], r["subsection_id"], r["paragraph_id"], r["text"]))
    for i, t in enumerate(texts):
        assert got.get(i, []) == line_by_line(t), t


def test_packing_and_overlap(spark):
    text = "Section 1 Start\n(1) " + "a " * 30 + "\n(1) " + "b " * 30 + "\n(2) " + "c " * 30 + "\nSection 2 Long\n" + " ".join(f"w{i}" for i in range(120))
    docs = spark.createDataFrame([("d", text, "laws/d.pdf", "An Act")], "document_id string, text string, source_path string, act_title string")
    rows = segmentation.legal_chunks(docs, max_words=70, overlap=20).orderBy("chunk_index").collect()
    assert [r["chunk_id"] for r in rows] == ["d:1:0", "d:1:1", "d:2:2", "d:2:3", "d:2:4"]
    assert rows[0]["text"].count("a") and rows[1]["text"].startswith("(1) b") and rows[1]["text"].count(" c") == 30
    assert rows[2]["text"].split()[-1] == "w66" and rows[3]["text"].split()[0] == "w47" and rows[0]["source_file"] == "d.pdf"


def chunk(document, unit, heading, text, index, **more):
    return {"chunk_id": f"{document}:{unit}:{index}", "document_id": document, "section_heading": heading, "section_id": unit, "text": text, "source_path": f"laws/{document}.pdf", "chunk_index": index} | more


CHUNKS = [
    chunk("osha", "14", "Section 14 Last of Part III", "Section 14 text.\nPART IV\nGENERAL DUTIES OF EMPLOYERS", 0, act_title="Occupational Safety Act 1994"),
    chunk("osha", "15", "Section 15 General duties", "Section 15 duties, see section 14 and section 99.", 1, act_title="Occupational Safety Act 1994"),
    chunk("osha", "16", "Section 16 Policy", "Section 16 refers to section 15 and to section 14.", 2, act_title="Occupational Safety Act 1994"),
    chunk("amend", "5", "Section 5 Amendment of section 15", "The principal Act is amended by inserting after section 15 the following.", 0, act_title="Occupational Safety (Amendment) Act 2022"),
    chunk("amend", "6", "Section 6 New section 15A", "A new section. Commencement is by order.", 1, act_title="Occupational Safety (Amendment) Act 2022"),
]


def test_graph_edges(spark):
    g = graph.build(chunk_table(spark, CHUNKS))
    edges = {tuple(r) for r in g.edges.collect()}
    unit = lambda doc, n: f"{doc}:section:{n}"
    part = "osha:hierarchy:part:IV"
    assert {e for e in edges if e[0] == "CONTAINS"} == {("CONTAINS", part, unit("osha", "15")), ("CONTAINS", part, unit("osha", "16"))}
    assert {e for e in edges if e[0] == "NEXT_UNIT"} == {("NEXT_UNIT", unit("osha", "14"), unit("osha", "15")), ("NEXT_UNIT", unit("osha", "15"), unit("osha", "16")), ("NEXT_UNIT", unit("amend", "5"), unit("amend", "6"))}
    assert {e[1:] for e in edges if e[0] == "REFERS_TO"} == {(unit("osha", "15"), unit("osha", "14")), (unit("osha", "16"), unit("osha", "15")), (unit("osha", "16"), unit("osha", "14")), (unit("amend", "5"), unit("osha", "15"))}
    assert {e for e in edges if e[0] == "AMENDS"} == {("AMENDS", unit("amend", "5"), unit("osha", "15"))}
    assert {e for e in edges if e[0] == "INSERTS"} == {("INSERTS", unit("amend", "6"), unit("osha", "15A"))}
    assert [tuple(r) for r in g.markers.select("label", "identifier", "title").collect()] == [("part", "IV", "GENERAL DUTIES OF EMPLOYERS")]
    assert [r[0] for r in g.commences.collect()] == [unit("amend", "6")]
    orphans = {r["edge_type"]: r["orphans"] for r in graph.consistency(g).collect()}
    assert orphans == {"CONTAINS": 0, "NEXT_UNIT": 0, "REFERS_TO": 0, "REVERSE_REFERS_TO": 0, "AMENDS": 0, "INSERTS": 1}
    asked = [(1, "What is Part IV about general duties?"), (2, "Which section amends section 15?"), (3, "What refers to section 15 in the Occupational Safety Act 1994"), (4, " "), (5, "nothing of this")]
    out = {}
    for r in graph.search(g, spark.createDataFrame(asked, "query_id long, query string")).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["chunk_id"], round(r["score"], 6), r["reason"]))
    assert out[1] == [("osha:15:1", 10 + 8 + 2 * 1.0, "graph: hierarchy part IV")] or out[1][0][0] == "osha:15:1"
    assert out[2][0][0] == "amend:5:0" and out[2][0][2] == "graph: amendment linkage"
    assert out[3][0][0] == "osha:16:2" and out[3][0][2] == "graph: explicit reference to section 15"
    assert set(out) == {1, 2, 3}


def test_leaks_are_units_inside_another(spark):
    rows = [chunk("d", "1", "Section 1", "Section 1\n2. other\n2. again\nArticle 9 no", 0), chunk("d", "2", "Section 2", "2. own", 1)]
    out = segmentation.boundary_leaks(chunk_table(spark, rows)).collect()
    assert [(r["chunk_id"], r["leaked_id"], r["line"]) for r in out] == [("d:1:0", "2", "2. other")]

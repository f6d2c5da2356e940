from lexloom.operators import gold
from lexloom.sources.chunks import chunk_table


def chunk(document, unit, heading, title, text="PART II\nRights of persons", **more):
    return {"chunk_id": f"{document}:{unit}:0", "document_id": document, "section_heading": heading, "section_id": unit, "text": text, "source_path": f"laws/{document}.pdf", "act_title": title} | more


def test_candidates_of_two_acts(spark):
    rows = [
        chunk("ea", "2", "Section 2 Interpretation", "Employment Act 1955", document_aliases=["EA 1955", "Employment"]),
        chunk("ea", "69", "Section 69 Appeals and rights", "Employment Act 1955", document_aliases=["EA 1955"]),
        chunk("fc", "5", "Perkara 5 Kebebasan diri", "Perlembagaan Persekutuan", unit_type="perkara", text="Perkara 5"),
        chunk("am", "1", "Section 1", "Employment (Amendment) Act 2022", text="x"),
        chunk("no", "1", "Section 1 Reprint", "Laws of Malaysia"),
    ]
    found = gold.build(chunk_table(spark, rows))
    by = {(r["generation_method"], r["expected_doc"], r["expected_unit"]): r["query"] for r in found.collect()}
    assert by["direct_lookup_template", "Employment Act 1955", "2"] == "What does Section 2 of the Employment Act 1955 say?"
    assert by["compact_lookup_template", "Employment Act 1955", "2"] == "Section 2 EA 1955"
    assert by["definition_unit_template", "Employment Act 1955", "2"] == "What does EA 1955 define in Section 2?"
    assert by["capability_heading_template", "Employment Act 1955", "69"] == "Who can appeal under Section 69 of EA 1955?"
    assert by["hierarchy_context_template", "Employment Act 1955", "69"] == "Which Part covers Appeals and rights in the Employment Act 1955?"
    assert by["bm_direct_lookup_template", "Perlembagaan Persekutuan", "5"] == "Apakah maksud Perkara 5 dalam Perlembagaan Persekutuan?"
    assert by["amendment_scope_template", "Employment (Amendment) Act 2022", "1"] == "What is amended by Employment (Amendment) Act 2022?"
    assert not any(doc == "Laws of Malaysia" for _, doc, _ in by)
    queries = {r["query"] for r in found.where("category = 'negative'").collect()}
    assert "What does Section 999 of the Employment Act 1955 say?" in queries
    assert "Which section covers Appeals and rights in the Perlembagaan Persekutuan?" in queries
    assert found.where("category <> 'negative'").groupBy("expected_doc", "category").count().where("count > 6").count() == 0
    assert gold.build(chunk_table(spark, rows).where("false")).count() == 0


def test_usable_headings(spark):
    rows = [("Annual leave", True), ("Part", False), ("abc", False), ("Reprint of it", False), ("1234 ab", False), ("a§§§§§b", False), ("", False)]
    out = spark.createDataFrame(rows, "body string, want boolean").select("want", gold.usable_heading(gold.c("body")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in out)

from lexloom.operators import answers, router
from lexloom.sources.chunks import chunk_table
from test_structure import CHUNKS


def test_decisions_and_citations(spark):
    queries = spark.createDataFrame([(i, q) for i, q in enumerate(["a", "section 9", "section 5", "d", "Which section of it"])], "query_id long, query string")
    rows = [
        (1, 1, 0.5, "Act", "d", "section", "", "9", "1", None),
        (2, 1, 2.0, "Act", "d", "section", "5", "0", None, "a"),
        (2, 2, 1.95, "", "d2", "article", "6", "0", None, None),
        (3, 1, 2.0, "Act", "d", "perkara", "5", "0", None, None),
        (3, 2, 1.99, "Act", "d", "perkara", "5", "0", None, None),
        (3, 3, 1.0, "Act", "d", "section", "7", "0", None, None),
        (4, 1, 5.0, "Act", "d", "section", "7", "0", None, None),
    ]
    results = spark.createDataFrame(rows, "query_id long, rank int, score double, act_title string, document_id string, unit_type string, unit_id string, section_id string, subsection_id string, paragraph_id string")
    out = {r["query_id"]: (r["decision"], r["citations"], r["grounded"]) for r in answers.decide(queries, results).collect()}
    assert out == {
        0: ("none", [], False),
        1: ("weak", ["Act, Section 9(1)"], False),
        2: ("ambiguous", ["Act, Section 5(a)", "d2, Article 6"], False),
        3: ("grounded", ["Act, Perkara 5", "Act, Section 7"], True),
        4: ("grounded", ["Act, Section 7"], True),
    }
    abstain = {r["query_id"]: r["abstain"] for r in answers.lacks_asked_unit(queries, results).collect()}
    assert abstain == {0: False, 1: False, 2: False, 3: False, 4: True}


def test_graph_supported_modes(spark):
    chunks = chunk_table(spark, [c | {"embedding": [0.0]} for c in CHUNKS])
    questions = [(1, "What refers to section 15 in the Occupational Safety Act 1994?", [0.0]), (2, "what is in Part IV of the Occupational Safety Act 1994", [0.0]), (3, "policy", [0.0])]
    queries = spark.createDataFrame(questions, "query_id long, query string, query_vector array<double>")
    for mode in router.MODES:
        out = {}
        for r in router.search(chunks, queries, 3, mode).orderBy("query_id", "rank").collect():
            out.setdefault(r["query_id"], []).append(r["chunk_id"])
        assert out[3] == ["osha:16:2"] and out[2], mode
        assert "osha:16:2" in out[1], mode
        if mode == "graph_supported":
            assert out[1] == ["osha:16:2"]

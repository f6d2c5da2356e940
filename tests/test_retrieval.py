import pytest

from lexloom.operators.retrieval import search
from lexloom.sources.chunks import chunk_table


def chunk(document, unit, heading, text, index=0, vector=(0.0, 0.0, 1.0), **more):
    return {"chunk_id": f"{document}:{unit}:{index}", "document_id": document, "section_heading": heading, "section_id": unit, "text": text, "source_path": f"laws/{document}.pdf", "chunk_index": index, "embedding": list(vector)} | more


CONSENT = [
    chunk("pdpa_2010", "6", "Section 6 General Principle", "consent lawful basis processing", vector=(1.0, 0.0, 0.0), subsection_id="1"),
    chunk("pdpa_2010", "7", "Section 7 Notice and Choice Principle", "notice disclosure purpose statement", vector=(0.0, 1.0, 0.0)),
    chunk("contracts_act", "10", "Section 10 What Agreements Are Contracts", "offer acceptance lawful consideration", vector=(0.6, 0.0, 0.8)),
]


def found(spark, rows, questions, mode="hybrid", k=3):
    """Results of each (query, vector) as lists of (chunk_id, score)."""
    queries = spark.createDataFrame([(i, q, list(v)) for i, (q, v) in enumerate(questions)], "query_id long, query string, query_vector array<double>")
    out = [[] for _ in questions]
    for r in search(chunk_table(spark, rows), queries, k, mode).orderBy("query_id", "rank").collect():
        out[r["query_id"]].append((r["chunk_id"], r["score"]))
    return out


NONE = (0.0, 0.0, 0.0)


def test_hybrid_scores_lexical_and_semantic_parts(spark):
    # all three words in the text: 0.8 * 0.5; cosine (0.95, 0.05, 0) . (1, 0, 0) weighs 0.2; a blank question has no results
    out, blank = found(spark, CONSENT, [("consent lawful basis", (0.95, 0.05, 0.0)), (" \t ", NONE)], k=2)
    assert blank == []
    assert [x for x, _ in out] == ["pdpa_2010:6:0", "contracts_act:10:0"]
    assert out[0][1] == pytest.approx(0.4 + 0.2 * 0.95 / (0.95**2 + 0.05**2) ** 0.5)
    assert out[1][1] == pytest.approx(0.8 * 0.5 / 3 + 0.2 * 0.57 / (0.95**2 + 0.05**2) ** 0.5)


def test_lexical_heading_coverage_and_order_of_equal_scores(spark):
    rows = CONSENT + [chunk("a", "6", "Section 6", "same text", index=i) for i in (2, 0, 1)]
    heading, equal = found(spark, rows, [("choice notice", NONE), ("same text", NONE)], mode="lexical")
    # the heading holds 2 of 2 words: 2.5 + 0.75; the text 1 of 2
    assert heading == [("pdpa_2010:7:0", pytest.approx(0.5 * 0.5 + 2.5 + 0.75))]
    assert [x for x, _ in equal] == ["a:6:0", "a:6:1", "a:6:2"]


LAWS = [
    chunk("employment_act", "2", "Section 2 Interpretation", "In this Act wages means basic wages.", 0, act_title="Employment Act 1955"),
    chunk("employment_act", "60D", "Section 60D Holidays", "Every employee shall be entitled to paid holidays.", 1, act_title="Employment Act 1955"),
    chunk("employment_act", "60E", "Section 60E Annual leave", "An employee shall be entitled to paid annual leave of eight days.", 2, act_title="Employment Act 1955"),
    chunk("safety_act", "15", "Section 15 General duties of employers", "It shall be the duty of every employer and he must ensure safety.\nPART IV", 0, act_title="Occupational Safety and Health Act 1994"),
    chunk("safety_act", "17", "Section 17 Duties to other persons", "An employer shall conduct his undertaking safely.", 1, act_title="Occupational Safety and Health Act 1994"),
    chunk("safety_act", "2", "Section 2 Interpretation", "In this Act the words mean what they say.", 2, act_title="Occupational Safety and Health Act 1994"),
]


UNIT = "section 2 of the Employment Act 1955"
IMPOSSIBLE = "section 900 of the Employment Act 1955"
PART = "Which section begins Part IV of the Occupational Safety and Health Act 1994?"
DEFINITION = "What is the definition of wages in the Employment Act 1955?"
DUTY = "What must an employer do under the Occupational Safety and Health Act 1994?"


AMENDMENT = "Which amendment introduces general duties in the Occupational Safety and Health Act 1994?"


@pytest.mark.parametrize("mode", ["hybrid", "hybrid_filtered_rerank"])
def test_questions_of_law(spark, mode):
    questions = (UNIT, IMPOSSIBLE, PART, DEFINITION, DUTY, "", AMENDMENT)
    unit, impossible, part, definition, duty, blank, amendment = found(spark, LAWS, [(q, NONE) for q in questions], mode=mode)
    assert amendment[0][0].startswith("safety_act")
    assert [x for x, _ in unit] == ["employment_act:2:0", "safety_act:2:2"]
    assert impossible == blank == []
    assert {x for x, _ in part} == {"safety_act:15:0", "safety_act:17:1"}
    assert definition[0][0] == "employment_act:2:0"
    assert duty[0][0] == "safety_act:15:0"


def test_search_queries_rank_by_real_vectors(spark, tmp_path):
    import numpy as np

    from lexloom import queries as Q, registry

    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(300, 6)).astype("float32")
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    docs = [(i, " ".join(f"zz{i}x{j}" for j in range(n)), "en", f"src{i % 9}", 0) for i, n in [(295, 900), (3, 40), (299, 700), *((10 + i, 30) for i in range(40))]]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    chunks = [(d, i) for d, text, *_ in docs for i in range(len(range(0, len(text.split()), 210)))]
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    last = len(Q.QUESTIONS) - 1  # no rule and no word of a chunk meets it
    near = {f"{d}:{i + 1}:{i}": max(0.0, float(unit[(d + i) % 300] @ unit[Q.QUESTION_VECTORS[last]])) for d, i in chunks}
    best = sorted(((s, x) for x, s in near.items() if s > 0), key=lambda r: -r[0])[:5]
    for mode, weight in (("embedding", 1.0), ("hybrid", 0.2)):
        out = [r for r in registry.QUERIES[f"q_search_{mode}"](spark, str(tmp_path)).orderBy("rank").collect() if r["query_id"] == last]
        assert [(r["chunk_id"], r["score"]) for r in out] == [(x, pytest.approx(weight * s, abs=2e-6)) for s, x in best]

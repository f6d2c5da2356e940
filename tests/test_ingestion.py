from pyspark.sql import functions as F

from lexloom.operators import ingestion

PAGES = [
    ("a", 1, ["LAWS OF MALAYSIA", "Act 265", "EMPLOYMENT ACT 1955", "An Act relating to work."]),
    ("a", 2, ["ARRANGEMENT OF SECTIONS", "Section 1. Short title", "1. Short title"]),
    ("a", 3, ["NOTE:", "1. (1) an editor's note"]),
    ("a", 4, ["12", "PART I", "PRELIMINARY", "PRELIMINARY", "Short title", "1.", "(1)  This Act may be\tcited.", "Act 265", "ACT 265,./ Wages are paid."]),
    ("a", 5, ["Page 7", "CONTENTS", "2. (1) More of it.", "Laws of Malaysia"]),
    ("b", 1, ["nothing", "here starts."]),
    ("c", 1, ["3. Heading", "4. Next heading", "5. Body", "plain words follow"]),
]


def test_pages_become_text(spark):
    pages = spark.createDataFrame(PAGES, "document_id string, page_number int, lines array<string>").repartition(3)
    numbers = {r["document_id"]: r["act_number"] for r in ingestion.act_numbers(pages).collect()}
    assert numbers == {"a": "Act 265"}
    docs = spark.createDataFrame([("a", "Employment Act 1955", "Act 265"), ("b", None, None), ("c", "", "")], "document_id string, act_title string, act_number string")
    texts = {r["document_id"]: r["text"] for r in ingestion.normalized_text(pages, docs).collect()}
    assert texts["a"] == "PART I\nPRELIMINARY\nShort title\n1. (1) This Act may be cited.\nWages are paid.\n\nCONTENTS\n2. (1) More of it."
    assert texts["b"] == ""
    assert texts["c"] == "5. Body\nplain words follow"


def test_a_page_is_judged_once_not_once_a_line(spark):
    pages = spark.createDataFrame(PAGES, "document_id string, page_number int, lines array<string>")
    plan = ingestion.page_lines(pages)._jdf.queryExecution().optimizedPlan().toString()
    # a plan's later lines are worked out first
    assert plan.count("arrangement of sections") == 1
    assert plan.index("Generate posexplode") < plan.index("arrangement of sections")


def test_a_line_is_cleaned_once_and_words_are_counted_no_further(spark):
    pages = spark.createDataFrame(PAGES, "document_id string, page_number int, lines array<string>")
    plan = ingestion.document_lines(pages)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(ingestion.NOISE_PREFIX) == 1
    lines = ["", " ", "a", " a  b ", "a b c", "a\nb\x0bc d", None]
    rows = spark.createDataFrame([(x,) for x in lines], "line string").select(*(ingestion.has_at_most(F.col("line"), n) for n in (0, 1, 2, 3))).collect()
    assert [list(r) for r in rows] == [[None if x is None else len(x.split()) <= n for n in (0, 1, 2, 3)] for x in lines]

"""What depends on a chunk or a question alone is not computed once more for every pair of them."""

from pyspark.sql import functions as F

from lexloom.functions.text import tokens
from lexloom.operators import retrieval
from lexloom.plans import features
from lexloom.plans.query_context import contexts
from lexloom.sources.chunks import chunk_table
from test_retrieval import DEFINITION, LAWS


def test_norms_are_known_before_pairs(spark):
    queries = spark.createDataFrame([(1, DEFINITION, [0.0, 0.0, 1.0])], "query_id long, query string, query_vector array<double>")
    ctx = contexts(queries).join(queries.select("query_id", "query_vector"), "query_id")
    prepared = features.prepare(chunk_table(spark, LAWS)).withColumn("row_key", F.monotonically_increasing_id())
    none = spark.createDataFrame([], "query_id long, ref_document string, ref_path string, ref_names array<struct<words:array<string>,normal:string,compact:string>>")
    plan = retrieval.general_pairs(prepared, ctx, none, ("hybrid",))._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan[: plan.index("Join ")], plan[plan.index("Join ") :]
    assert "SQRT" not in above and below.count("SQRT") == 2


def test_words_among_are_the_tokens_that_are_asked(spark):
    texts = ["", "The wages, duties and DUTY of Seksyen 5; the Act", "what which the", "rates rate wage akta x1 appeals"]
    asked = ["wage", "obligation", "section", "act", "rate", "the", "appeal", "wages"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("asked", F.array(*map(F.lit, asked)))
    out = rows.select(F.sort_array(F.array_distinct(F.array_intersect(tokens(F.col("text")), "asked"))).alias("want"), F.sort_array(features.words_among(F.col("text"), features.forms_of(F.col("asked")))).alias("found")).collect()
    assert [r["found"] for r in out] == [r["want"] for r in out] and any(r["want"] for r in out)


def test_a_name_is_found_whole_without_a_common_word(spark):
    names = "array<struct<words:array<string>,normal:string,compact:string>>"
    name = lambda *words: (list(words), " ".join(words), "".join(words))
    rows = [("part of actx27 law", ["part", "actx27"], [name("act")]), ("pu order", ["pu"], [name("puor")]), ("records", ["records"], [name("records", "act"), name("other")]), ("records", ["records"], []), ("", [], [name("a")])]
    rows = spark.createDataFrame([(i, n, n.replace(" ", ""), a, x, sorted({w for y in x for w in y[0]})) for i, (n, a, x) in enumerate(rows)], f"i int, normalized string, compact string, asked array<string>, names {names}, name_words array<string>")
    assert [r[0] for r in rows.orderBy("i").select(features.document()).collect()] == [1.0, 1.0, 0.5, 0.0, 0.0]

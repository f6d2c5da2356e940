from lexloom.operators.names import names_in


def test_names_are_found_where_they_stand(spark):
    names = ["act", "records act", "é", "x" * 300, "a", "employment act 1955", "act"]
    questions = [(1, "What of the Records ACT?"), (2, ""), (3, None), (4, "reaction"), (5, "É" + "X" * 299 + "x"), (6, "employment act 195")]
    out = names_in(spark.createDataFrame(questions, "query_id long, query string"), spark.createDataFrame([(n, i) for i, n in enumerate(names)], "alias string, n int"))
    want = {(i, n, k) for i, q in questions if q is not None for k, n in enumerate(names) if n in q.lower()}
    assert {(r["query_id"], r["alias"], r["n"]) for r in out.collect()} == want and out.count() == len(want)
    none = spark.createDataFrame([], "alias string, n int")
    assert names_in(spark.createDataFrame(questions, "query_id long, query string"), none).collect() == []

import importlib.util
import json
import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lexloom.operators import evaluation, overlap, reports
from lexloom.plans.query_context import contexts
from lexloom.streaming import frames


def test_entry_without_the_training_data_operators(monkeypatch):
    real = importlib.util.find_spec
    monkeypatch.setattr(__spark_entry__, "find_spec", lambda name: None if name == "lexloom.llm" else real(name))
    names = __spark_entry__.queries()
    assert "q_tokens" in names and not any(n.startswith("op") or n == "pipeline" for n in names)
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_entry_runs(spark):
    out = __spark_entry__.entry(spark)
    assert out.count() > 0 and out.columns[:2] == ["query_id", "place"]


def test_coverage_counts_repeated_words(spark):
    texts = spark.createDataFrame([(1, "Wages and duties"), (2, "the rate"), (3, None), (4, "wage wage")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "wage wage duty what"), (2, ""), (3, None)], "query_id long, query string")
    out = [tuple(r) for r in overlap.coverage_topk(texts, asked, 2).orderBy("rank").collect()]
    assert out == [(1, 1, 1, 0.5), (1, 2, 4, pytest.approx(0.5 * 2 / 3))]


def test_sections_are_grouped_in_order_of_first_appearance(spark):
    rows = [(1, 1, 0.9, "d", "section", "5", "Five", "one\n two"), (1, 2, 0.8, "d", "section", "6", "Six", ""), (1, 3, 0.95, "d", "section", "5", "Five b", "three"), (1, 4, 0.1, "d", "section", "5", "Five c", "four"), (1, 5, 0.1, "e", "section", "1", "E", "x")]
    table = spark.createDataFrame(rows, "query_id long, rank int, score double, document string, unit_type string, unit_id string, heading string, text string")
    out = [(r["unit_id"], r["heading"], r["score"], r["chunk_count"], r["preview"]) for r in reports.group_sources(table, 2).orderBy("place").collect()]
    assert out == [("5", "Five / Five b", 0.95, 3, "one two three"), ("6", "Six", 0.8, 1, "")]


def test_balancing_takes_turns(spark):
    rows = [("d", cat, v, f"{cat}{v}") for cat, n in (("a", 9), ("b", 2), ("c", 7)) for v in range(n)]
    table = spark.createDataFrame(rows, "doc string, cat string, v int, name string")
    out = [r["name"] for r in reports.balance(table, "doc", "cat", "v", "name", 6, 7).orderBy("place").collect()]
    assert out == ["a8", "b1", "c6", "a7", "b0", "c5", "a6"]


def test_snapshots_differ(spark):
    schema = "file_name string, chunk_count int, unit_types array<string>"
    old = spark.createDataFrame([("a", 1, ["s"]), ("b", 2, ["s"]), ("c", 3, ["s"])], schema)
    new = spark.createDataFrame([("b", 2, ["s"]), ("c", 3, ["p", "s"]), ("d", 4, ["s"])], schema)
    out = {r["file_name"]: (r["status"], r["delta"]) for r in reports.compare_snapshots(old, new).collect()}
    assert out == {"a": ("removed", -1), "b": ("same", 0), "c": ("changed", 0), "d": ("added", 4)}


def test_gold_questions_are_judged(spark):
    gold = spark.createDataFrame([(1, "A", "5", None), (2, "A", "5", "1"), (3, "A", "5", None), (4, "A", "5", None), (5, "A", "5", None)], "query_id long, expected_act_title string, expected_section_id string, expected_subsection_id string")
    rows = [(1, 1, "A", "5", "", None), (2, 1, "A", "5", "", "2"), (3, 1, "A", "6", "", None), (4, 1, "B", "5", "", None), (1, 2, "B", "5", "", None), (3, 4, "A", "5", "", None)]
    results = spark.createDataFrame(rows, "query_id long, rank int, act_title string, section_id string, unit_id string, subsection_id string")
    judged = evaluation.cases(gold, results)
    assert {r["query_id"]: (r["hit_at_1"], r["hit_at_3"], r["miss"]) for r in judged.collect()} == {
        1: (True, True, "none"),
        2: (False, False, "right_section_wrong_subsection"),
        3: (False, False, "right_section_wrong_subsection"),
        4: (False, False, "wrong_act"),
        5: (False, False, "none"),
    }
    assert evaluation.summary(judged).first()["hit_at_1"] == pytest.approx(0.2)
    assert evaluation.summary(judged.where("false")).first()["cases"] == 0
    rates = spark.createDataFrame([("x", 0, 0.5, 0.9), ("y", 1, 0.6, 0.6), ("z", 2, 0.6, 0.6)], "mode string, mode_order int, hit_at_1 double, hit_at_3 double")
    assert evaluation.best_mode(rates).first()["mode"] == "y"
    units = spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("b", "9", 1), ("c", "3", 1), ("c", "4", 2)], "document_id string, unit_id string, unit_ord int")
    assert {tuple(r) for r in evaluation.next_documents(units).collect()} == {("a", "2", "b"), ("c", "4", "a")}


def test_query_hints(spark):
    asked = [(1, "What does section 5A(2) of Akta Kerja define?"), (2, "P.U. (A) 5: which rates apply with effect from May?"), (3, "  "), (4, "Chapter IV annual leave appeals")]
    out = {r["query_id"]: r for r in contexts(spark.createDataFrame(asked, "query_id long, query string")).collect()}
    assert set(out) == {1, 2, 4}
    first = out[1]
    assert (first["unit_type"], first["unit_id"], first["subsection_id"], first["definition"], first["exact_lookup"], first["apply_rerank"]) == ("section", "5A", "2", True, True, False)
    assert "employment" in first["tokens"] and first["normalized"].startswith("what does section 5a 2 of employment act")
    assert out[2]["gazette"] and {"effect", "rate", "minimum", "scope"} <= set(out[2]["tokens"])
    assert (out[4]["hierarchy_label"], out[4]["hierarchy_id"], out[4]["intents"]) == ("chapter", "IV", ["annual leave", "appeal"])


def test_streams_are_framed_across_fragments(spark, tmp_path):
    lines = [json.dumps({"message": {"content": x}, "done": False}) for x in ("Hé", "llo\n", " you")] + ["", json.dumps({"done": True})]
    raw = "\n".join(lines)
    parts = [(f"s{k}", i, raw[j : j + n]) for k, n in enumerate((1, 7, 500)) for i, j in enumerate(range(0, len(raw), n))]
    table = spark.createDataFrame(parts, "stream_id string, seq long, raw string").repartition(3)
    decoded = frames.decode(frames.reframe(table, ["stream_id"]))
    texts = {}
    for r in decoded.orderBy("stream_id", "line_no").collect():
        texts[r["stream_id"]] = texts.get(r["stream_id"], "") + r["content"]
    assert texts == {k: "Héllo\n you" for k in ("s0", "s1", "s2")}
    with pytest.raises(Exception, match="malformed"):
        frames.decode(spark.createDataFrame([("x", 0, "{not json")], "stream_id string, line_no int, line string")).collect()
    folder = tmp_path / "in"
    table.filter("stream_id = 's1'").unionByName(spark.createDataFrame([("s1", 10**6, "")], table.schema)).coalesce(1).write.parquet(str(folder))
    stream = spark.readStream.schema(table.schema).parquet(str(folder))
    query = frames.reframe_stream(stream).writeStream.format("memory").queryName("framed").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination(120)
    assert [r["line"] for r in spark.table("framed").collect()] == lines


def test_windows_of_a_stream_drop_late_rows(spark, tmp_path):
    folder = str(tmp_path / "events")
    rows = lambda *r: spark.createDataFrame(r, "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    schema = "ts timestamp, event_type string, value double"
    query = frames.request_windows(_reader(spark, schema, folder, rows)).writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
        rows(("2024-01-01 05:00:00", "a", 1.0)).coalesce(1).write.mode("append").parquet(folder)
        query.processAllAvailable()
        rows(("2024-01-01 00:10:00", "a", 100.0)).coalesce(1).write.mode("append").parquet(folder)
        query.processAllAvailable()
        time.sleep(1)
        query.processAllAvailable()
    finally:
        query.stop()
    out = [(str(r["window_start"]), r["event_type"], r["n"], r["total"]) for r in spark.table("windows").collect()]
    assert out == [("2024-01-01 00:00:00", "a", 2, 3.0)]


def _reader(spark, schema, folder, rows):
    rows(("2024-01-01 00:05:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0)).coalesce(1).write.parquet(folder)
    return spark.readStream.schema(schema).parquet(folder)

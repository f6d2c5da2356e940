"""Exported chunks on disk, and chunk files read in the order of their lines."""

import json

from lexloom.operators import gold, metadata, refresh
from lexloom.sources.chunks import CHUNK, chunk_table, read_in_line_order


def chunk(doc, i, text="x"):
    return {"chunk_id": f"{doc}:{i}", "document_id": doc, "section_heading": f"Section {i}", "section_id": str(i), "text": text, "source_path": f"{doc}.pdf", "chunk_index": i, "unit_type": "section", "document_aliases": ["A"]}


def test_export_replaces_the_given_documents_only(spark, tmp_path):
    folder = str(tmp_path / "out")
    metadata.write_exported(chunk_table(spark, [chunk(d, i) for i in range(30) for d in ("d1", "d2", "d10")]), folder)
    metadata.write_exported(chunk_table(spark, [chunk("d2", i, "new") for i in (2, 0, 1)]), folder)
    rows = read_in_line_order(spark, folder).orderBy("entry_ord").collect()
    by_folder = [d for d in ("d1", "d10", "d2")]
    assert [(r["document_id"], r["chunk_index"]) for r in rows] == [(d, i) for d in by_folder for i in range(3 if d == "d2" else 30)]
    assert [r["entry_ord"] for r in rows] == list(range(63)) and {r["text"] for r in rows if r["document_id"] == "d2"} == {"new"}
    assert rows[0]["unit_id"] == "0" and rows[0]["document_aliases"] == ["A"]


def test_lines_keep_their_order_in_split_files(spark, tmp_path):
    for name, n in (("b.jsonl", 700), ("a.jsonl", 300), ("a.smoke.jsonl", 5)):
        (tmp_path / name).write_text("".join(json.dumps(chunk(name, i, "t" * (i % 90))) + "\n" + "\n" * (i % 3 == 0) for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        out = read_in_line_order(spark, str(tmp_path)).orderBy("entry_ord").select("entry_ord", "document_id", "chunk_index").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    wanted = [("a.jsonl", i) for i in range(300)] + [("b.jsonl", i) for i in range(700)]
    assert [tuple(r) for r in out] == [(k, *w) for k, w in enumerate(wanted)]
    assert read_in_line_order(spark, str(tmp_path)).schema["entry_ord"].dataType == CHUNK["entry_ord"].dataType


def test_manual_entries_find_their_unit(spark):
    units = spark.createDataFrame([("Act A", "3", "c3")], "act_title string, unit string, chunk_id string")
    entries = spark.createDataFrame([("q", "Act A", "3")], "query string, expected_doc string, expected_unit string")
    assert gold.with_units(entries, units).first()["source_chunk_id"] == "c3"
    assert [r[0] for r in spark.createDataFrame([("Act A",), ("Reprint of x",), (" ",)], "t string").select(metadata.is_canonical_title(metadata.c("t"))).collect()] == [True, False, False]


def test_refresh_and_curation_counts(spark):
    schema = "query string, category string, language string, expected_doc string"
    before = spark.createDataFrame([("a", "definition", "en", "Act A"), ("b", "definition", "en", None)], schema)
    after = spark.createDataFrame([("a ", "definition", "en", "Act A"), ("z", "rights", "ms", "Act B")], schema)
    kept, totals = refresh.stored(after, ["definition", "rights", "negative"])
    assert kept.count() == 2 and {tuple(r) for r in totals.collect()} == {("all", "all", 2), ("category", "definition", 1), ("category", "rights", 1), ("category", "negative", 0)}
    rows = {(r["kind"], r["name"]): (r["before"], r["after"], r["delta"], r["newly"], r["low"]) for r in refresh.compared(refresh.counted(before), refresh.counted(after)).collect()}
    assert rows["document", "Act B"] == (0, 1, 1, True, True) and rows["document", "negative/none"] == (1, 0, -1, False, False) and rows["all", "all"] == (2, 2, 0, False, False)
    assert {tuple(r) for r in refresh.curation(after, before).where("kind = 'origin'").collect()} == {("origin", "generated", 1), ("origin", "supplemented", 1), ("origin", "removed", 1)}
    kinds = refresh.dominant_types(spark.createDataFrame([("f", "b"), ("f", "a"), (None, None)], "source_file string, unit_type string")).collect()
    assert {tuple(r) for r in kinds} == {("f", 2, "a", 0.5, True, "a:1,b:1"), ("", 1, "", 1.0, False, ":1")}

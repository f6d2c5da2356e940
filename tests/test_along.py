"""Looking along a group's order across ranges, against a walk over the rows."""

import random

import pytest
from pyspark.sql import functions as F

from lexloom.operators import graph
from lexloom.sources.chunks import chunk_table
from lexloom.sources.tables import along


def walk(rows):
    """(id, last a, next b, place) of each row of (group, at, id, a, b)."""
    out = set()
    for group in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == group), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        for i, r in enumerate(own):
            a = next((x[3] for x in reversed(own[:i]) if x[3] is not None), None)
            b = next((x[4] for x in own[i + 1 :] if x[4] is not None), None)
            out.add((r[2], a, b, i + 1))
    return out


@pytest.mark.parametrize("groups", [1, 3, 40])
def test_along_equals_a_walk(spark, groups):
    draw = random.Random(groups)
    rows = [(draw.choice([None, *range(groups)]) if groups > 1 else 0, draw.choice([None, *range(60)]), i, draw.choice([None, None, f"a{i}"]), draw.choice([None, None, None, f"b{i}"])) for i in range(400)]
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table = spark.createDataFrame(rows, "g int, at int, id int, a string, b string").repartition(5)
        out = along(table, ["g"], ["at", "id"], last={"before": F.col("a")}, following={"after": F.col("b")}, number="place")
        assert out.columns == ["g", "at", "id", "a", "b", "before", "after", "place"]
        assert {(r["id"], r["before"], r["after"], r["place"]) for r in out.collect()} == walk(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert along(table.where("false"), ["g"], ["at", "id"], number="place").collect() == []


def test_markers_hold_until_the_next_of_their_label(spark):
    """One act in many ranges: every unit is under the last part and the last chapter before it."""
    texts = ["PART I\ntext", "text", "Chapter 1\ntext", "text\nPART II", "text", "Chapter 2\nPART III\nx", "text"] * 30
    rows = [{"chunk_id": f"{i:04}", "document_id": "d", "section_heading": f"Section {i}", "section_id": str(i), "text": t, "source_path": "p", "unit_type": "section", "unit_id": str(i), "chunk_index": i, "act_title": "An Act"} for i, t in enumerate(texts)]
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        edges = graph.build(chunk_table(spark, rows)).edges.where("edge_type = 'CONTAINS'").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    wanted, part, chapter = set(), None, None
    for i, t in enumerate(texts):
        first, *rest = t.split("\n")
        part = "I" if first == "PART I" else part
        chapter = first.split()[1] if first.startswith("Chapter") else chapter
        wanted |= {(f"d:hierarchy:{label}:{x}", f"d:section:{i}") for label, x in (("part", part), ("chapter", chapter)) if x}
        for line in rest:
            part = line.split()[1] if line.startswith("PART") else part
    assert {(e["src"], e["dst"]) for e in edges} == wanted

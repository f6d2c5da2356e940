"""The graph's tables hold no texts: what it needs of them is found where they lie."""

from lexloom.operators import graph
from lexloom.sources import tables
from lexloom.sources.chunks import chunk_table
from test_structure import CHUNKS


def test_no_table_of_the_graph_holds_texts(spark, monkeypatch):
    seen = []

    def recorded(df, name, known=tables.written):
        seen.append(set(df.columns))
        return known(df, name)

    monkeypatch.setattr(graph, "written", recorded)
    monkeypatch.setattr(tables, "written", recorded)
    g = graph.build(chunk_table(spark, CHUNKS))
    assert g.units.count() == len(CHUNKS) and seen
    assert not any("text" in columns for columns in seen)

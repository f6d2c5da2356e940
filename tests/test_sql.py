"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
CHECKED = ["q_statute_units", "q_packed_chunks", "q_section_chunks", "q_boundary_leaks", "q_question_contexts", "q_prepared_chunks", "q_scores_words", "q_graph_edges", "q_gold_set", "q_metadata_issues", "q_index_summary", "q_files_to_process", "q_stored_chunks", "q_stream_events", "q_next_documents", "q_index_build", "q_clean_texts", "q_refresh", "q_curation", "q_dominant_types", "q_event_properties", "q_request_latency"]


def _plain(value):
    if value is None or value != value:
        return None
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, name):
    with duckdb.connect() as db:
        for file in os.listdir(SF):
            db.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{file}')")
        wanted = db.execute(__spark_entry__.oracle_sql()[name])
        columns = [d[0] for d in wanted.description]
        want = sorted(str([_plain(v) for _, v in sorted(zip(columns, row))]) for row in wanted.fetchall())
    found = __spark_entry__.queries()[name](spark, SF)
    assert sorted(found.columns) == sorted(columns)
    assert sorted(str([_plain(r[c]) for c in sorted(columns)]) for r in found.collect()) == want


def test_every_query_has_its_sql():
    assert {n for n in __spark_entry__.queries() if n.startswith("q_")} <= set(__spark_entry__.oracle_sql())

import os

import __spark_entry__ as entry
import pytest

DATA, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
#: Core queries whose rows are compared with their SQL.
COMPARED = (
    "p1_found", "p1_change_rates", "lexical_search_ranked", "import_edges", "deterministic_rank", "semantic_rank", "rrf_fuse", "hybrid_h1", "hybrid_h2", "hybrid_h3", "evidence_topk", "tfidf_rank", "open_questions", "excerpts", "query_texts",
    "commit_selection", "recall_mrr", "paired_difference", "decision", "grounding_guards", "method_status", "evidence_bundle", "chunk_reconstruction",
    "assembly_cases", "assembly_metrics", "assembly_primary", "assembly_sensitivity", "assembly_decision",
)
REAL = ("workspace_edges", "incoming_relationships", "search_hybrid", "construct_evidence", "inconsistent_candidates", "investigate_changes", "change_h2_rank", "five_arms")


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test data")
def test_entry(spark):
    assert entry.entry(spark).columns == ["base_snapshot_id", "target_snapshot_id", "path", "change_kind"]


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test data")
def test_queries_plan(spark):
    from tracewake.plans import registry

    for name, query in registry.core_queries().items():
        if name not in COMPARED + REAL:
            assert query(spark, DATA).columns, name




@pytest.mark.skipif(not os.path.exists(DATA), reason="no test data")
@pytest.mark.parametrize("name", COMPARED)
def test_rows_equal_those_of_the_sql(spark, name):
    compare(spark, name, DATA)


@pytest.mark.skipif(not os.path.exists(LARGER), reason="no test data")
@pytest.mark.parametrize("name", REAL)
def test_rows_of_real_snapshots(spark, name):
    compare(spark, name, LARGER)


def compare(spark, name, data):
    import duckdb

    con = duckdb.connect()
    for file in os.listdir(data):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{data}/{file}'")
    found = entry.queries()[name](spark, data)
    columns = sorted(found.columns)
    wanted = con.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    number = lambda v: round(float(v), 6) if isinstance(v, float) else v
    key = lambda rows: sorted((tuple(number(v) for v in r) for r in rows), key=repr)
    assert key(found.select(*columns).collect()) == key(wanted) and wanted

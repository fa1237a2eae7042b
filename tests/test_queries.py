import importlib.util
import os

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
FOLDER = "/root/testdata/sf0.001"

# One or two per topic; tools/check_sql.py compares them all.
CHECKED = (
    "graph_edge_upsert", "graph_subtree_removal", "vector_top_above_threshold", "chat_effective_questions",
    "retrieval_contexts", "text_headings", "programme_sections", "programme_outcomes", "course_hierarchy",
    "regulation_tree", "jobs_states", "stream_first_uploads",
)


@pytest.fixture(scope="module")
def entry_module():
    spec = importlib.util.spec_from_file_location("entry_module", f"{ROOT}/__spark_entry__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def test_every_sql_has_a_query(entry_module):
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")
def test_entry(spark, entry_module):
    assert entry_module.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")
@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, entry_module, name):
    duckdb = pytest.importorskip("duckdb")
    spec = importlib.util.spec_from_file_location("check_sql", f"{ROOT}/tools/check_sql.py")
    check = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(check)
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.execute(f"create view {file[:-8]} as select * from '{FOLDER}/{file}'")
    df = entry_module.queries()[name](spark, FOLDER)
    got = check.rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(entry_module.oracle_sql()[name])
    assert got == check.rows_of([c[0] for c in cur.description], cur.fetchall())

"""Queries on the driver tables against their SQL, on documents that small tables do not hold."""

import importlib.util
import os

import pytest

duckdb = pytest.importorskip("duckdb")

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def load(path):
    spec = importlib.util.spec_from_file_location("loaded", f"{ROOT}/{path}")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def both(spark, folder, name, texts, files=1):
    """Rows of a query and of its SQL on documents with these texts."""
    rows = [(i, t, "vi", f"src{i % 3}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).repartition(files).write.parquet(f"{folder}/documents.parquet")
    entry, check, con = load("__spark_entry__.py"), load("tools/check_sql.py"), duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    df = entry.queries()[name](spark, str(folder))
    cur = con.execute(entry.oracle_sql()[name])
    want = check.rows_of([c[0] for c in cur.description], cur.fetchall())
    return check.rows_of(df.columns, [tuple(r) for r in df.collect()]), want


@pytest.mark.parametrize("name", ["programme_outcomes", "programme_edge_counts", "programme_graph_labels"])
def test_more_than_99_outcomes_without_a_code(spark, tmp_path, name):
    got, want = both(spark, tmp_path, name, ["mot dong\n" * 640, "mot\nhai\nba"])
    assert got == want


def test_first_line_that_reads_like_a_heading(spark, tmp_path):
    """A Roman number and a title of at most 100 characters; longer lines and other words stay."""
    texts = ["VI OUREOI ENIERPA\nhai", "Chương II mot hai\nba", "VI " + "a" * 100 + "\nb", "VI " + "a" * 101 + "\nb",
             "VIA mot\nhai", "X", "Muc I mot", "MụcV mot", "", "12 VI mot", "vi mot", "I VI mot"]
    got, want = both(spark, tmp_path, "programme_objectives", texts)
    assert got == want
    assert sum("## " in str(row) for row in got[1]) == 6


def test_a_folder_of_files_streams_like_one_file(spark, tmp_path):
    got, want = both(spark, tmp_path, "stream_ingest_jobs", [f"mot dong {c}\nhai" for c in "abcdefghijklmno"] + ["1 2"], files=3)
    assert got == want
    assert len(got[1]) == 16


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="driver tables are not here")
def test_edges_are_merged_without_a_deal_before(spark):
    df = load("__spark_entry__.py").queries()["graph_edge_upsert"](spark, "/root/testdata/sf0.001")
    assert "RepartitionByExpression" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert df.count() > 0

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
from lectern.operators import vectors as ve
from lectern.queries.vectors import letter_model
from lectern.session import build_session
spark = build_session("ship", "local[2]", **{{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2"}})
rows = spark.createDataFrame([("a", "tea"), ("b", "eat")], "id string, text string")
v = ve.embed(rows, letter_model, 8)
for chunks in (1, 3):
    print("rows", ve.top_matches(v.withColumnRenamed("id", "qid"), v, 1, corpus_chunks=chunks).count())
"""


def test_workers_need_no_import_path(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert done.stdout.count("rows 2") == 2, done.stderr[-2000:]

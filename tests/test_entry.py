"""The entry module, with and without the training-data operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _run(root, code):
    return subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(root)})


def test_entry_without_the_training_data_operators(tmp_path):
    for name in ("tidewater", "__spark_entry__.py"):
        source = os.path.join(ROOT, name)
        copy = shutil.copytree if os.path.isdir(source) else shutil.copy
        copy(source, tmp_path / name, **({"ignore": shutil.ignore_patterns("llm", "__pycache__")} if os.path.isdir(source) else {}))
    done = _run(tmp_path, "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert q and set(o) <= set(q); assert 'pipeline' not in q; print(len(q))")
    assert done.returncode == 0, done.stderr


def test_every_query_names_lower_case_columns_and_sql_is_for_known_queries():
    done = _run(ROOT, "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())")
    assert done.returncode == 0, done.stderr


def test_flagship(spark, tmp_path):
    import datetime

    from tidewater.queries import QUERIES

    rows = [(k, datetime.datetime(2024, 1, 1, 0, 0, k), k % 2, "purchase" if k % 3 else "view", 1.0, None) for k in range(50)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["ysb"](spark, str(tmp_path))
    assert got.columns == ["start", "end", "user_id", "n", "s"]
    assert sum(r["n"] for r in got.collect()) == sum(1 for k in range(50) if k % 3)

"""What the entry point gives before there is a session."""

import subprocess
import sys
from pathlib import Path


def test_queries_are_listed_without_a_session():
    say = "import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql()); from pyspark import SparkContext as c; print(c._active_spark_context)"
    ran = subprocess.run([sys.executable, "-c", say], cwd=Path(__file__).resolve().parents[2], capture_output=True, text=True, timeout=120)
    assert ran.returncode == 0, ran.stderr
    names, sql, context = ran.stdout.splitlines()[-3:]
    assert {n.split("_")[0] for n in names.split() if n.startswith("op")} >= {f"op{i}" for i in range(1, 14)}
    assert {"pipeline", "informedness_sweep", "learned_metric"} <= set(names.split()) and set(sql.split()) <= set(names.split())
    assert context == "None"

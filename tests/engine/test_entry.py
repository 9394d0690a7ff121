"""The driver's entry: all queries are there, also without the optional subpackage."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__

REPO = Path(__file__).resolve().parents[2]


def test_queries_and_sql_agree(spark):
    found, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(found) and len(found) > 50
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "cluster_id" in df.columns


def test_entry_without_optional_subpackage():
    code = "import sys; sys.modules['motifloom.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'clusters_tsv' in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True)

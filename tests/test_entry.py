import subprocess
import sys

import __spark_entry__


def test_every_oracle_has_a_query():
    queries = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(queries) and "minimum_slice" in queries


def test_entry_runs(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["clumpIndex", "n", "t", "A", "nPhotons"] and df.count() > 0


def test_works_without_the_training_data_folders(tmp_path):
    """As if the folders were gone: the finder below hides them."""
    code = """
import sys
class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name in ("corpus_pipeline", "photonflow.llm"):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Hidden())
import __spark_entry__ as e
assert "minimum_slice" in e.queries() and not [q for q in e.queries() if q.startswith("op") or q == "pipeline"], e.queries()
"""
    subprocess.run([sys.executable, "-c", code], check=True)

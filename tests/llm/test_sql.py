"""The queries that SQL can state."""

import pytest

from test_queries import rows
from tidemark.llm import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, sf, oracle, name):
    df, said = catalog.queries()[name](spark, sf), oracle.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(said.columns)
    assert rows(df.columns, df.collect()) == rows(said.columns, said.fetchall())


def test_guard(tmp_path):
    """The entry point works without this subpackage and the pipeline, and doesn't hide what fails in them."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    ask = "import __spark_entry__ as e; q = e.queries(); print('robust_interval' in q, 'op6_url_filter' in q, 'pipeline' in q, 'op6_url_filter' in e.oracle_sql())"

    def run(*left_out, broken=False):
        place = tmp_path / f"copy-{len(left_out)}-{broken}"
        shutil.copytree(os.path.join(root, "tidemark"), place / "tidemark", ignore=shutil.ignore_patterns("__pycache__", *left_out))
        for name in ("__spark_entry__.py", "corpus_pipeline.py"):
            if name not in left_out:
                shutil.copy(os.path.join(root, name), place)
        if broken:
            (place / "tidemark" / "llm" / "mixing.py").write_text("import no_such_module\n")
        return subprocess.run([sys.executable, "-c", ask], cwd=place, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})

    assert run().stdout.split() == ["True"] * 4
    assert run("llm", "corpus_pipeline.py").stdout.split() == ["True", "False", "False", "False"]
    assert run("llm").stdout.split() == ["True", "False", "False", "False"]
    assert "no_such_module" in run(broken=True).stderr

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as contract


def test_every_oracle_has_its_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.skipif(not os.path.isdir(contract.SMOKE_DIR), reason="needs the test tables")
def test_flagship(spark):
    rows = contract.entry(spark)
    assert rows.columns == ["query_id", "id", "rrf", "rerank", "final_rank"] and rows.count() > 0


@pytest.mark.parametrize("gone", [("docquarry/llm", "tests/llm"), ("docquarry/llm", "tests/llm", "corpus_pipeline.py")])
def test_a_copy_without_the_optional_part(tmp_path, gone):
    """The other queries are there, and no trace of the optional ones, whether or not the pipeline's module is left."""
    root = Path(contract.__file__).parent
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (root / name).exists():
            shutil.copy(root / name, tmp_path)
    shutil.copytree(root / "docquarry", tmp_path / "docquarry", ignore=shutil.ignore_patterns("__pycache__"))
    for name in gone:
        shutil.rmtree(tmp_path / name, ignore_errors=True)
        (tmp_path / name).unlink(missing_ok=True)
    script = "import __spark_entry__ as e; print(sorted(e.queries()), sorted(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    assert "hybrid_retrieve" in done.stdout and "op1_" not in done.stdout and "pipeline" not in done.stdout

import subprocess
import sys
from pathlib import Path

import __spark_entry__

REPO = Path(__file__).resolve().parent.parent


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_imports_without_the_llm_parts(tmp_path):
    """The entry works where the pipeline and the llm folders are deleted."""
    code = "import __spark_entry__ as e; assert e.llm is None and e.corpus_pipeline is None; assert 'calibration_table' in e.queries() and e.oracle_sql()"
    for name in ("__spark_entry__.py", "millrace"):
        (tmp_path / name).symlink_to(REPO / name) if name.endswith(".py") else None
    import shutil

    shutil.copytree(REPO / "millrace", tmp_path / "millrace", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path)}, check=True)

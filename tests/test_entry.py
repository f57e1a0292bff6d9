"""The entry without the training-data subpackage, or without what that needs."""

import os
import shutil
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith(('op', 'pipeline')) for n in e.queries()))"


def counted(folder, before=""):
    done = subprocess.run([sys.executable, "-B", "-c", before + COUNT], cwd=folder, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
    return done.stdout.split()


def test_entry_without_the_subpackage_or_its_needs(tmp_path):
    ignore = shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py", "*.parquet", "spark-warehouse")
    shutil.copytree(HERE, tmp_path / "r", ignore=ignore)
    gone = counted(tmp_path / "r")
    assert int(gone[0]) > 100 and gone[0] == gone[1] and gone[2] == "False"
    os.makedirs(tmp_path / "r" / "pharmasift" / "llm" / "__pycache__")  # a leftover folder
    assert counted(tmp_path / "r") == gone
    hidden = counted(HERE, "import sys; sys.modules['public_tokenizers'] = None; ")
    assert hidden == gone

"""The entry module in full, and in a copy from which the corpus folders have been taken out."""

import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]
ASK = "import __spark_entry__ as e; print(len(e.queries()), sum(n.startswith('op') and n[2].isdigit() for n in e.queries()), 'pipeline' in e.queries(), len(e.oracle_sql()))"


def _told(folder):
    found = subprocess.run([sys.executable, "-c", ASK], cwd=folder, capture_output=True, text=True, timeout=120)
    assert found.returncode == 0, found.stderr[-2000:]
    return found.stdout.split()


def test_entry_without_the_corpus_folders(tmp_path):
    whole = _told(REPO)
    skip = shutil.ignore_patterns("llm", ".git", "__pycache__", ".pytest_cache")
    for left_out in (skip, shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", ".pytest_cache")):
        copy = tmp_path / f"copy{left_out is skip}"
        shutil.copytree(REPO, copy, ignore=left_out)
        bare = _told(copy)
        assert bare[1:3] == ["0", "False"]
        assert int(bare[0]) == int(whole[0]) - int(whole[1]) - (whole[2] == "True")
        assert int(bare[0]) > 100 and int(bare[3]) > 90

"""The driver contract, also without the corpus operators."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
PROBE = "import __spark_entry__ as e; q = e.queries(); assert 'quantify_objects' in q and set(e.oracle_sql()) <= set(q); print(len(q))"


def test_entry_without_corpus_operators(tmp_path):
    skip = shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "*.json")
    shutil.copytree(ROOT, tmp_path / "copy", ignore=skip)
    for also in ([], ["corpus_pipeline.py"]):  # with the pipeline left behind, too
        for name in also:
            if (ROOT / name).exists():
                shutil.copy(ROOT / name, tmp_path / "copy" / name)
        out = subprocess.run([sys.executable, "-c", PROBE], cwd=tmp_path / "copy", capture_output=True, text=True)
        assert out.returncode == 0, out.stderr

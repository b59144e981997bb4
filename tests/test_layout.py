"""The library stands without its corpus subpackage, and nothing else in it imports that."""

import re
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_else_imports_the_subpackage():
    for path in ROOT.glob("tessera/**/*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"tessera\.llm|corpus_pipeline", path.read_text()), path


def test_entry_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(k.startswith('op') and k[2].isdigit() for k in q) and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})


def test_only_the_entry_swallows_import_errors():
    for path in [ROOT / "corpus_pipeline.py", *ROOT.glob("tessera/**/*.py")]:
        if path.exists():
            assert "ImportError" not in path.read_text(), path
            assert "localCheckpoint" not in path.read_text(), path

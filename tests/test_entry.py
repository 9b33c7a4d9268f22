"""The entry points with and without the training-data part."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
SHOW = "import __spark_entry__ as e; print(len(e.queries()), sorted(x for x in e.queries() if x.startswith('op') and x[2].isdigit()), 'pipeline' in e.queries(), set(e.oracle_sql()) <= set(e.queries()))"


def shown(folder: Path, code: str = SHOW) -> subprocess.CompletedProcess:
    return subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, timeout=300)


def test_entry_points_without_the_other_part(tmp_path):
    shutil.copytree(ROOT / "strideatlas", tmp_path / "strideatlas", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    got = shown(tmp_path)
    assert got.returncode == 0 and got.stdout.split(" ", 1)[1].strip() == "[] False True" and int(got.stdout.split()[0]) > 70
    (tmp_path / "strideatlas" / "llm").mkdir()  # there, but broken
    (tmp_path / "strideatlas" / "llm" / "queries.py").write_text("import no_such_module")
    assert shown(tmp_path).returncode != 0


def test_nothing_else_imports_the_other_part():
    for path in (ROOT / "strideatlas").rglob("*.py"):
        if "llm" not in path.parts:
            assert ".llm" not in path.read_text() and "import llm" not in path.read_text(), path

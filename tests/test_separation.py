"""Without the training-data subpackage and its pipeline's operators everything else imports and answers."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_without_the_subpackage(tmp_path):
    for name in ("dexlake", "__spark_entry__.py", "bench.py"):
        source = ROOT / name
        shutil.copytree(source, tmp_path / name) if source.is_dir() else shutil.copy(source, tmp_path / name)
    if (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    shutil.rmtree(tmp_path / "dexlake" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [k for k in q if k.startswith('op') and k[2].isdigit()] and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "dexlake").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "dexlake").parts:
            assert "dexlake.llm" not in path.read_text() and "import llm" not in path.read_text(), path

"""The entry without the training-data operators, and what the engine imports."""

import pathlib
import re
import shutil
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_entry_works_without_the_training_data_folders(tmp_path):
    for name in ("pluvion", "__spark_entry__.py", "corpus_pipeline.py"):
        source = ROOT / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif source.exists():
            shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and 'pipeline' not in q and not any(k.startswith('op') and k[2].isdigit() for k in q) and len(q) > 150; print('fine')"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert out.stdout.strip() == "fine", out.stderr


def test_nothing_else_imports_the_training_data_operators():
    for path in (ROOT / "pluvion").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"^\s*(from|import)\s+[\w.]*\bllm\b", path.read_text(), re.M), path


def test_every_query_has_a_name_of_its_own():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())

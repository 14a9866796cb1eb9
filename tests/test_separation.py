"""The library works without the training-data subpackage."""

import ast
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_nothing_else_imports_the_subpackage():
    for file in (ROOT / "histlens").rglob("*.py"):
        if "llm" in file.relative_to(ROOT / "histlens").parts:
            continue
        for node in ast.walk(ast.parse(file.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [f"{node.module}.{a.name}" for a in node.names] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in name.split(".") for name in names), file


def test_entry_without_it(tmp_path):
    shutil.copytree(ROOT / "histlens", tmp_path / "histlens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') and n[2:3].isdigit() for n in q), 'pipeline' in q)"], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    count, dealt, pipeline = done.stdout.split()
    assert int(count) > 40 and (dealt, pipeline) == ("False", "False")

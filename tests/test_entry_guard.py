"""The entry and the inventory work where the corpus operators are absent, and import none of them."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_corpus_operators(tmp_path):
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{ROOT}/tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; n = e.queries(); assert 'pattern_rollup' in n and not any(k.startswith('op') for k in n); assert set(e.oracle_sql()) <= set(n)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_the_corpus_operators():
    for folder, _, names in os.walk(f"{ROOT}/tidemark"):
        if os.path.basename(folder) != "llm" and "/llm/" not in folder:
            for name in names:
                if name.endswith(".py"):
                    with open(os.path.join(folder, name)) as file:
                        assert "llm" not in file.read(), name
